"""Ranked lexical search over document-sharded postings.

Documents are indexed where they are read, in shards of bounded size that never leave their task: the terms of a shard,
how many of its documents hold each, and, in that order, which documents and with which impact (compressed sparse rows).
Impacts are whole numbers that hold the frequency and the document's length; they are written once the counts of the
whole table are known. A search walks each shard term by term, adds weighted impacts into a dense array of its
documents, and keeps the best with all ties; the few rows that each task keeps are merged per item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_batches, read, small

TOP = 10
# The scale of an impact, how fast a term saturates, and the share of the length in it (of 100).
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 90
POSTINGS_PER_SHARD = 1 << 19
DOCS_PER_SHARD = 1 << 16  # a place in a shard takes two bytes
#: Terms of items searched at once, sent to every task; further items take another pass.
TERMS_AT_ONCE = 200_000
_TEXT_AT_ONCE = 1 << 20
#: A-Z become small, other letters, digits and every byte of a longer character stay, and the rest parts terms.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())  # lower() is of ASCII only

RAW = "doc_ids array<bigint>, lengths array<int>, with_terms bigint, n_terms bigint, terms array<string>, held array<int>, places binary, counts binary"
SHARD = "doc_ids array<bigint>, terms array<string>, held array<int>, places binary, impacts binary"


def count_terms(text: bytes | None) -> Counter:
    """How often each term (UTF-8) occurs in a text; long texts are taken in pieces that end between terms."""
    if not text:
        return Counter()
    folded = text.translate(_FOLD)
    if len(folded) <= _TEXT_AT_ONCE:
        return Counter(folded.split())
    out, at = Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + _TEXT_AT_ONCE)
        end = len(folded) if end < 0 else end
        out.update(folded[at:end].split())
        at = end
    return out


class _Shard:
    """The documents gathered for one shard."""

    def __init__(self) -> None:
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.sizes: list[int] = []  # postings of each document
        self.terms: dict[bytes, int] = {}
        self.term: list[int] = []
        self.count: list[int] = []

    def add(self, doc_id: int | None, found: Counter) -> None:
        number = self.terms.setdefault
        self.term += [number(t, len(self.terms)) for t in found]
        self.count += found.values()
        self.doc_ids.append(doc_id)
        self.lengths.append(found.total())
        self.sizes.append(len(found))

    def full(self) -> bool:
        return len(self.term) >= POSTINGS_PER_SHARD or len(self.doc_ids) >= DOCS_PER_SHARD

    def row(self) -> tuple:
        term = np.array(self.term, np.int32)
        order = np.argsort(term, kind="stable")
        places = np.repeat(np.arange(len(self.sizes), dtype=np.uint16), self.sizes)[order]
        counts = np.array(self.count, np.int32)[order]
        held = np.bincount(term, minlength=len(self.terms)).astype(np.int32)
        some = sum(n > 0 for n in self.lengths)
        return self.doc_ids, self.lengths, some, sum(self.lengths), [t.decode() for t in self.terms], held, places.tobytes(), counts.tobytes()


def _arrow(schema: T.StructType):
    """What tasks need to know of ``schema``; a task cannot parse it itself."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], arrow):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _gather(arrow):
    def run(batches) -> Iterator:
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, count_terms(text.as_py()))
                if shard.full():
                    yield _batch([shard.row()], arrow)
                    shard = _Shard()
        if shard.doc_ids:
            yield _batch([shard.row()], arrow)

    return run


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Impact of ``counts`` occurrences in documents of ``lengths`` terms, where ``documents`` have ``terms`` in all."""
    wide = object if LENGTH_SHARE * documents * int(lengths.max(initial=0)) >= 1 << 63 else np.int64
    damping = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths.astype(wide) * documents) // max(terms, 1)
    counts = counts.astype(np.int64)
    return (SCALE * counts) // (1_000 * counts + SATURATION * damping.astype(np.int64))


@dataclass
class LexicalIndex:
    """``shards`` (SHARD): one row per shard. ``documents``: how many have a term. ``terms``: how many they have together."""

    shards: DataFrame
    documents: int
    terms: int

    def document_frequencies(self, wanted: DataFrame | None = None) -> DataFrame:
        """(term, df) over all documents, of all terms or of those of ``wanted`` (term, without repeats) that occur."""
        each = self.shards.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).select("t.terms", "t.held").toDF("term", "held")
        if wanted is not None:
            wanted = small(wanted)
            each = each.join(wanted, "term", "left_semi")
        return each.groupBy("term").agg(F.sum("held").alias("df"))


def build_index(docs: DataFrame, scratch: Scratch | None = None) -> LexicalIndex:
    """The index of ``docs`` (doc_id, text) in the shared folder.

    Null texts and those without letters and digits have no terms and are never found; repeated rows and rows without an
    id are documents of their own. Texts are indexed whole. Other columns are ignored. An empty table gives an index
    without shards. Each task writes its own shards, so no document moves.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    gathered = map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")), _gather(_arrow(T.StructType.fromDDL(RAW))), RAW)
    raw = scratch.save(gathered, **_BLOCKS)
    documents, terms = raw.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    arrow = _arrow(T.StructType.fromDDL(SHARD))

    def weigh(batches):
        for batch in batches:
            for doc_ids, lengths, names, held, places, counts in zip(*(batch.column(c) for c in ("doc_ids", "lengths", "terms", "held", "places", "counts"))):
                at = np.frombuffer(places.as_py(), np.uint16)
                of = lengths.values.to_numpy()[at]
                made = impacts(np.frombuffer(counts.as_py(), np.int32), of, documents, terms)
                yield _batch([(doc_ids.as_py(), names.as_py(), held.as_py(), places.as_py(), made.astype(np.int32).tobytes())], arrow)

    shards = scratch.save(map_batches(raw.drop("with_terms", "n_terms"), weigh, SHARD), **_BLOCKS)
    scratch.drop(raw)
    return LexicalIndex(shards, documents, terms)


#: Rows of an index are a few MB each, so row groups are kept small.
_BLOCKS = {"parquet.block.size": 16 << 20}


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), without repeats, of ``items`` (item_id, text)."""
    folded = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.regexp_extract_all(folded, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    return items.select("item_id", F.explode(F.array_distinct(parts)).alias("term")).distinct()


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest positive scores and of all that tie with the last of them."""
    least = 1
    if np.count_nonzero(scores > 0) > k:
        least = max(1, int(scores[np.argpartition(scores, len(scores) - k)[len(scores) - k :]].min()))
    return np.flatnonzero(scores >= least)


def _merge(kept: tuple | None, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """The ``k`` best of what was kept and of the new ones: highest scores, then smallest ids, null ids (flag 1) last."""
    if kept is not None:
        scores, ids = np.concatenate([kept[0], scores]), np.concatenate([kept[1], ids])
    order = np.lexsort((ids[:, 0], ids[:, 1], -scores))[:k]
    return scores[order], ids[order]


def _search_shard(doc_ids: np.ndarray, terms: list[str], held: np.ndarray, places: np.ndarray, made: np.ndarray, items: list, kept: list, k: int) -> None:
    """Scores every document of a shard for every item, term by term."""
    ends = np.cumsum(held, dtype=np.int64)
    number = dict(zip(terms, range(len(terms))))
    total = np.zeros(len(doc_ids), np.int64)
    for i, wanted in enumerate(items):
        total[:] = 0
        for term, weight in wanted:
            t = number.get(term)
            if t is not None:
                a, b = int(ends[t] - held[t]), int(ends[t])
                total[places[a:b]] += weight * made[a:b]  # a document stands once in a term's list
        if kept[i] is not None and len(kept[i][0]) == k:  # lower scores cannot get in
            found = np.flatnonzero(total >= max(1, int(kept[i][0][-1])))
            found = found[_best(total[found], k)] if len(found) > k else found
        else:
            found = _best(total, k)
        if len(found):
            kept[i] = _merge(kept[i], total[found], doc_ids[found], k)


def _items_of(block: DataFrame) -> tuple[list, list]:
    """Item ids and (term, weight) lists of a block of items, TERMS_AT_ONCE terms or so, on the driver."""
    ids, lists, place = [], [], {}
    for item_id, term, weight in block.select("item_id", "term", "weight").collect():
        if item_id not in place:
            place[item_id] = len(ids)
            ids.append(item_id)
            lists.append([])
        lists[place[item_id]].append((term, weight))
    return ids, lists


def search(index: LexicalIndex, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of the highest positive score, ties to smaller ids.

    ``items``: item_id, text. Rows of one item_id are one item with the terms of all of them; a null id is an item.
    Items without terms, or whose terms no document holds, give no rows. Every item meets every shard; items go to the
    tasks in blocks of about TERMS_AT_ONCE terms, a block a pass, so neither the items nor the results of all documents
    are ever in one place: a task keeps ``k`` rows an item.
    """
    spark = index.shards.sparkSession
    scratch = Scratch(spark)
    wanted = scratch.save(item_terms(items))
    df = index.document_frequencies(wanted.select("term").distinct())
    weight = F.floor(F.lit(1_000.0) * F.log(F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double")))
    weighed = scratch.save(wanted.join(df.select("term", weight.cast("bigint").alias("weight")), "term"))
    blocks = max(1, -(-weighed.count() // TERMS_AT_ONCE))
    kind = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    out = None
    for b in range(blocks):
        ids, lists = _items_of(weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b))
        found = map_batches(index.shards, _searcher(spark.sparkContext.broadcast((ids, lists)), k, _arrow(schema)), schema)
        found = scratch.save(found)
        out = found if out is None else out.unionByName(found)
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searcher(shared, k: int, arrow):
    def run(batches):
        ids, lists = shared.value
        kept: list = [None] * len(ids)
        for batch in batches:
            for doc_ids, terms, held, places, made in zip(*(batch.column(c) for c in ("doc_ids", "terms", "held", "places", "impacts"))):
                own = doc_ids.values
                known = own.is_valid().to_numpy(zero_copy_only=False)
                pairs = np.stack([own.fill_null(0).to_numpy(), ~known], axis=1).astype(np.int64)
                _search_shard(
                    pairs, terms.as_py(), held.values.to_numpy(), np.frombuffer(places.as_py(), np.uint16), np.frombuffer(made.as_py(), np.int32).astype(np.int64), lists, kept, k
                )
        rows = [(ids[i], None if null else doc, score) for i, best in enumerate(kept) if best is not None for score, (doc, null) in zip(best[0].tolist(), best[1].tolist())]
        if rows:
            yield _batch(rows, arrow)

    return run


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
g AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
q AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
m AS (SELECT r, doc_id, 100 - 90 + (90 * CAST(len(ts) AS BIGINT) * n_docs) // n_terms AS m FROM d, g WHERE len(ts) > 0),
scored AS (
  SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scored JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
