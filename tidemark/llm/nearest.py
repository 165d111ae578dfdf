"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Unit vectors are turned by principal axes and iterative quantisation, several times from different starts, and keep one
sign bit per axis. Every row is indexed: its code is cut into substrings of about log2(rows) bits, and each substring is
an entry of a table of its own. Two codes within Hamming radius r agree in one of m substrings up to r // m bits, in one
of the first r % m + 1 even that far and else one bit less, so probing all values that near retrieves every code within
r. What the probes touch and whose whole code is near enough is reranked by the cosine of the original vectors in double
precision. Both radii are learned on a bounded sample, as the smallest that keep its true neighbours.

Tables are dealt to tasks by (table, leading bits of the value); a value that many rows share is cut into shards. Only
ids and codes travel there, a task holds one shard and reads the queries as a stream, and a pair found in several tables
is passed on by the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, map_batches, read, small

NEAREST = 5
EVERY = 50  # rows whose id this divides are queries
SAMPLE = 8_000  # bound on the vectors of one length that rotations and radii are fitted on
SAMPLE_QUERIES = 400
PROBED, WITHIN = 0.93, 0.99  # shares of the sample's true neighbours that probing finds and the code radius keeps
WORDS = 6  # 64-bit words of a code
ROUNDS = 20  # of iterative quantisation
SHARD_ROWS = 16_384
MOST_LEADING = 8  # bits of a value that deal a table to tasks
INDEXED_LENGTHS = 4  # vector lengths, the commonest, that get codes; vectors of rarer ones are compared one by one
MOST_BROADCAST = 20_000  # query vectors sent to every executor; beyond, they are joined by a shuffle


@dataclass
class Codes:
    rotation: np.ndarray  # dimensions x 64 * WORDS
    width: int  # bits of a substring
    reach: int  # Hamming radius within which probing finds every code
    radius: int  # of whole codes that are reranked

    @property
    def tables(self) -> int:
        return 64 * WORDS // self.width

    def of(self, unit: np.ndarray) -> np.ndarray:
        """uint64 words of each row's code."""
        return np.packbits(unit @ self.rotation > 0, axis=1, bitorder="little").view(np.uint64)

    def substrings(self, words: np.ndarray) -> np.ndarray:
        """Values of each row's substrings, one column a table."""
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, : self.tables * self.width]
        return bits.reshape(len(words), self.tables, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))

    def reaches(self) -> list[int]:
        """How many bits off each table is probed; -1: not at all."""
        whole, extra = divmod(self.reach, self.tables)
        return [whole if t <= extra else whole - 1 for t in range(self.tables)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # exact, and squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that of ``b``, in double precision."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a, b))
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def distances(words: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words ^ code).sum(axis=-1, dtype=np.int64)


def learn_codes(sample: np.ndarray, rows: int, seed: int = 6, k: int = NEAREST) -> Codes:
    """Rotations and radii from sampled vectors (none of them zero) of a table of ``rows``."""
    unit = _unit(sample)
    dimensions = unit.shape[1]
    _, axes = np.linalg.eigh(unit.T @ unit)
    kept = min(64, dimensions)
    axes = axes[:, ::-1][:, :kept]
    flat, rng, turned = unit @ axes, np.random.default_rng(seed), []
    while len(turned) * kept < 64 * WORDS:
        turn = np.linalg.qr(rng.normal(size=(kept, kept)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ vt).T
        turned.append(axes @ turn)
    width = int(np.clip(round(np.log2(max(rows, 2))), 20, 24))
    codes = Codes(np.hstack(turned)[:, : 64 * WORDS], width, 64 * WORDS, 64 * WORDS)
    own = codes.of(unit)
    values = codes.substrings(own)
    needed, apart = [], []  # probing radius that finds a true neighbour, and its distance
    for q in rng.permutation(len(unit))[:SAMPLE_QUERIES].tolist():
        score = unit @ unit[q]
        score[q] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(k, len(unit) - 1)]
        off = np.bitwise_count(values[best] ^ values[q]).astype(np.int64)
        needed += (off * codes.tables + np.arange(codes.tables)).min(axis=1).tolist()
        apart += distances(own[best], own[q]).tolist()
    if apart:
        codes.reach = min(codes.reach, int(np.quantile(needed, PROBED, method="higher")))
        codes.radius = int(np.quantile(apart, WITHIN, method="higher"))
    return codes


class Table:
    """One table's entries of one task: rows by substring value."""

    def __init__(self, codes: Codes, table: int, leading: int, rows: np.ndarray, words: np.ndarray, values: np.ndarray):
        self.codes, self.table, self.low = codes, table, codes.width - leading
        order = np.argsort(values, kind="stable")
        self.rows, self.words, self.values = rows[order], words[order], values[order]
        self.low_values, self.first, self.n = np.unique(self.values & ((1 << self.low) - 1), return_index=True, return_counts=True)  # one leading value here
        self.reach = codes.reaches()
        self.flips = None
        if sum(comb(self.low, n) for n in range(self.reach[table] + 1)) < len(self.low_values):  # else all values are looked at
            self.flips = np.array([sum(1 << b for b in c) for n in range(self.reach[table] + 1) for c in combinations(range(self.low), n)], np.int64)
            self.flipped = np.bitwise_count(self.flips)

    def near(self, words: np.ndarray, value: int) -> np.ndarray:
        """Rows that this table is the first to find and whose code is within the radius."""
        if not len(self.values):
            return self.rows
        left = self.reach[self.table] - int(value >> self.low ^ int(self.values[0]) >> self.low).bit_count()
        value &= (1 << self.low) - 1
        if self.flips is None:
            hit = np.flatnonzero(np.bitwise_count(self.low_values ^ value) <= left)
        else:
            asked = value ^ self.flips[: np.searchsorted(self.flipped, left, side="right")]
            hit = np.minimum(np.searchsorted(self.low_values, asked), len(self.low_values) - 1)
            hit = hit[self.low_values[hit] == asked]
        first, n = self.first[hit], self.n[hit]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at = at[distances(self.words[at], words) <= self.codes.radius]
        if len(at) and self.table:
            off = np.bitwise_count(self.codes.substrings(self.words[at]) ^ self.codes.substrings(words[None]))[:, : self.table]
            at = at[~(off.astype(np.int64) <= np.array(self.reach[: self.table])).any(axis=1)]
        return self.rows[at]


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _candidates(rows: DataFrame, total: int, dimensions: int, codes: Codes, scratch: Scratch) -> DataFrame:
    """(asking, row) that the probes find, for ``rows`` (row, asks, v) of one length."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = codes.of(_unit(_matrix(batch, "v", dimensions)))
            values = codes.substrings(words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("asks"), *(pa.array(words[:, i].view(np.int64)) for i in range(WORDS)), _lists(values)],
                names=["row", "asks", *(f"c{i}" for i in range(WORDS)), "values"],
            )

    words = [f"c{i}" for i in range(WORDS)]
    coded = scratch.save(map_batches(rows.select("row", "asks", "v"), encode, f"row bigint, asks boolean, {', '.join(c + ' bigint' for c in words)}, values array<bigint>"))
    leading = int(np.clip(np.ceil(np.log2(max(total, 1) / SHARD_ROWS)), 0, min(MOST_LEADING, codes.width)))
    low = codes.width - leading
    within = F.element_at(F.array(*map(F.lit, codes.reaches())), F.col("t") + 1)
    entries = coded.select("row", *words, F.posexplode("values").alias("t", "value")).where(within >= 0).withColumn("lead", F.shiftright("value", low))
    per = scratch.save(entries.groupBy("t", "lead").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards")))  # tables x 2^MOST_LEADING rows at most
    index = entries.join(F.broadcast(per), ["t", "lead"]).select("t", "lead", F.pmod(F.xxhash64("row"), "shards").cast("int").alias("shard"), F.lit(0).alias("asks"), "row", *words, "value")
    probes = coded.where("asks").select("row", *words, F.posexplode("values").alias("t", "value")).join(F.broadcast(per), "t")
    probes = probes.where(F.bit_count(F.col("lead").bitwiseXOR(F.shiftright("value", low))) <= within).select(
        "t", "lead", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("asks"), "row", *words, "value"
    )
    dealt = index.unionByName(probes).repartition("t", "lead", "shard").sortWithinPartitions("t", "lead", "shard", "asks")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, table = None, [], None
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy()
            where, asks = np.stack([column("t"), column("lead"), column("shard")], axis=1), column("asks")
            row, value, code = column("row"), column("value"), np.stack([column(c) for c in words], axis=1).view(np.uint64)
            cuts = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(axis=1) | (asks[1:] != asks[:-1])))
            found: tuple[list, list] = ([], [])
            for a, b in zip(cuts, np.append(cuts[1:], len(row))):
                if tuple(where[a]) != key:
                    key, parts, table = tuple(where[a]), [], None
                if not asks[a]:
                    parts.append((row[a:b].copy(), code[a:b].copy(), value[a:b].copy()))
                    continue
                if not parts:
                    continue
                table = table or Table(codes, int(key[0]), leading, *map(np.concatenate, zip(*parts)))
                for i in range(a, b):
                    near = table.near(code[i], int(value[i]))
                    found[0].append(np.full(len(near), row[i]))
                    found[1].append(near)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["asking", "row"])

    return map_batches(dealt, answer, "asking bigint, row bigint").where("asking <> row")


def _matrix(batch: pa.RecordBatch, name: str, dimensions: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def _rerank(pairs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(asking, query_id, rank, vec_id, score): the ``k`` best of ``pairs`` (asking, row), from the vectors in ``rows``."""
    asked = rows.where("asks").select(F.col("row").alias("asking"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    both = pairs.join(rows.select("row", "vec_id", "v"), "row").join(small(asked, MOST_BROADCAST), "asking").select("asking", "query_id", "row", "vec_id", "q", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, v = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in ("q", "v"))
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            score, ends = np.empty(len(lengths)), np.cumsum(lengths)
            for d in np.unique(lengths):
                of = np.flatnonzero(lengths == d)
                at = (ends[of] - d)[:, None] + np.arange(d)
                score[of] = cosines(q[at], v[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("asking", "query_id", "row", "vec_id")), pa.array(score)], names=["asking", "query_id", "row", "vec_id", "score"])

    scored = map_batches(both, run, "asking bigint, query_id bigint, row bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("asking").orderBy(F.col("score").desc(), "vec_id", "row"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("asking", "query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: Column, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``vectors`` (vec_id, embedding) where
    ``queries`` holds, among all other rows of its length; ties go to the smaller vec_id, fewer rows give fewer ranks.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Rows
    that share an id are rows of their own, each a query where ``queries`` holds and each a candidate of the other.
    Vectors of different lengths are never neighbours. Other columns are ignored. An empty table gives no rows.

    The ``INDEXED_LENGTHS`` commonest lengths are indexed. Queries of rarer lengths, and those for which the index finds
    fewer than ``k``, are compared with all rows of their length.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.where(_usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col("embedding").alias("v"), F.size("embedding").alias("d")
    )
    rows = scratch.save(rows)  # the numbers stay as they are from here on
    common = rows.groupBy("d").count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(INDEXED_LENGTHS).collect()
    found = []
    for dimensions, total in common:
        of = rows.where(F.col("d") == dimensions)
        sample = exact_sample(of, total)
        codes = learn_codes(sample.reshape(-1, dimensions), total, k=k)
        found.append(scratch.save(_rerank(_candidates(of, total, dimensions, codes, scratch), of, k)))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    out = reduce(DataFrame.unionByName, found)
    full = out.groupBy("asking").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("asking").alias("row"))
    open_ = scratch.save(rows.where("asks").join(full, "row", "left_anti").select("row", "d"))
    if not open_.isEmpty():
        pairs = open_.withColumnRenamed("row", "asking").join(rows.select("row", "d"), "d").where("asking <> row").select("asking", "row")
        out = out.join(open_.select(F.col("row").alias("asking")), "asking", "left_anti").unionByName(_rerank(pairs, rows, k))
    return out.select("query_id", "rank", "vec_id", "score")


def exact_sample(rows: DataFrame, total: int) -> np.ndarray:
    """Components of ``SAMPLE`` vectors at most: those of least hash of the row's number among a few more."""
    near = bounded_sample(rows, F.col("row"), int(SAMPLE * 0.95), "codes") if total > SAMPLE else rows
    table = near.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toArrow()
    return table.column("v").combine_chunks().flatten().to_numpy().astype(np.float64)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
