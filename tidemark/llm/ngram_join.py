"""N-gram Jaccard self-join: T-occurrence search over inverted lists, distributed by exact part signatures.

Documents with equal shingle sets are one node. Two different sets A, B that link differ in at most |smaller| / 9
shingles. So if the shingles are dealt by hash to more parts than that, the two agree on a whole part: nodes that share
the signature of a part are candidates, and no link is lost. Sizes fall into classes, each with its own number of
parts; a node also takes the scheme of the class below if a partner could be there.

Nodes connected by shared signatures form a neighbourhood. In each one an inverted index answers, for every node, which
others hold at least T of its shingles: the short lists are merged on a heap, and what occurs often enough there is
probed for in the long ones (DivideSkip). The index lists components instead of nodes, one entry for all that have been
joined, so a group of near copies costs no more than its shingles; members of a component are searched in the same way,
only if the component as a whole holds T shingles and none of a few members tried first links.

Texts of one template share parts without linking. So a neighbourhood larger than a task's share is first taken apart by
its rare shingles: two sets that link share one of their rarest, if each gives one more than a partner may lack. Sets that
share none of those are alone, the others form smaller neighbourhoods. One that is still larger is cut into blocks that
all hold one common leader; members that its component does not take in are searched against all blocks afterwards.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_batches, map_rows, read, small
from .components import connected_components

WORDS = 3
PERCENT = 90
GROWTH = 1.5  # of the size classes' bounds
BLOCK = 1_000_000  # shingles of a neighbourhood that one task takes
_K1, _K2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _K1
    h = (h ^ (h >> _S)) * _K2
    return h ^ (h >> _S)


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; fewer words: the whole sequence; none: empty."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # ASCII case and white space only
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(ids))
    h = _mix(ids[: len(ids) - width + 1] + np.uint64(width))
    for k in range(1, width):
        h = _mix(h + ids[k : len(ids) - width + 1 + k])
    return np.unique(h)


def _class_bounds(top: int = 1 << 40) -> list[int]:
    bounds = [1]
    while bounds[-1] < top:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * GROWTH)))
    return bounds


BOUNDS = _class_bounds()


def differing(size: int, percent: int = PERCENT) -> int:
    """Most shingles in which a set of ``size`` and a larger or equal one may differ and still link."""
    return size * (100 - percent) // percent


def part_signatures(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of the parts of a set under the schemes of its class and, if needed, the class below.

    A scheme has more parts than a linked pair of its class can differ in, and some to spare. Empty parts have no
    signature unless a set has more of them than there are to spare: then it gives them all, so that two such sets
    still agree on one.
    """
    size = len(shingles)
    if not differing(-(-size * 100 // percent), percent):
        return np.zeros(0, np.uint64)  # such a small set links with its equals alone
    own = int(np.searchsorted(BOUNDS, size, side="right")) - 1
    out = []
    for c in (own, own - 1):
        if c < 0 or (c < own and BOUNDS[c + 1] - 1 < -(-size * percent // 100)):
            continue
        most = differing(BOUNDS[c + 1] - 1, percent)
        spare = 3 + most // 60
        parts = most + 1 + spare
        part = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascending, as the shingles are
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sums, numbers = np.add.reduceat(_mix(shingles), starts), part[starts]
        if parts - len(starts) > spare:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), numbers)
            sums, numbers = np.append(sums, np.zeros(len(empty), np.uint64)), np.append(numbers, empty)
        out.append(_mix(sums + _mix(numbers + np.uint64(c << 40) + np.uint64(1))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def node_of(shingles: np.ndarray) -> int | None:
    """One number for a set: a 64-bit hash of all of it; null for the empty set."""
    from xxhash import xxh3_64_intdigest

    return None if not len(shingles) else int(np.uint64(xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))).astype(np.int64))


def occurring(lists: list[list[int]], least: int, mu: float = 0.002) -> Iterator[tuple[int, int]]:
    """(item, occurrences) of the items that are in ``least`` or more of ``lists``, which are ascending (DivideSkip).

    The L longest lists, about least / (mu * log2(longest) + 1), are left out of the merge: an item must then be in
    least - L of the others, and is looked up in the long ones by binary search.
    """
    if len(lists) < least:
        return
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    long_lists = min(least - 1, int(least / (mu * (longest.bit_length() - 1) + 1)))
    short, rest = lists[: len(lists) - long_lists], lists[len(lists) - long_lists :]
    for item, found in groupby(merge(*short)):
        n = sum(1 for _ in found)
        if n < least - long_lists:
            continue
        for k, probed in enumerate(rest):
            if n + len(rest) - k < least:
                break
            at = bisect_left(probed, item)
            n += at < len(probed) and probed[at] == item
        if n >= least:
            yield item, n


class Joined:
    """Sets that are added one by one, the components of those that link, and an index of both.

    ``of``: token -> ascending components that hold it. A component of several sets has an index of its own, token ->
    ascending members. When two components join, the smaller moves into the larger.
    """

    TRIED = 4  # members of a component that are compared before its index is searched

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        sizes = np.array([len(s) for s in sets])
        _, token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        ends = np.cumsum(sizes)
        several = n[token] > 1  # no other set holds the rest
        self.tokens = [token[e - k : e][several[e - k : e]].tolist() for e, k in zip(ends.tolist(), sizes.tolist())]
        self.sizes, self.percent = sizes.tolist(), percent
        self.up = list(range(len(sets)))
        self.of: dict[int, list[int]] = {}
        self.members: dict[int, list[int]] = {}
        self.inner: dict[int, dict[int, list[int]]] = {}

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def add(self, i: int) -> None:
        self.members[i] = [i]
        for t in self.tokens[i]:
            _insert(self.of.setdefault(t, []), i)

    def join(self, i: int, j: int) -> int:
        """Makes the components of two added sets one; its number."""
        a, b = self.find(i), self.find(j)
        if a == b:
            return a
        if len(self.members[a]) > len(self.members[b]):
            a, b = b, a
        into = self.inner.get(b)
        if into is None:
            into = self.inner[b] = {t: [b] for t in self.tokens[b]}
        mine = self.inner.pop(a, None) or {t: [a] for t in self.tokens[a]}
        for t, some in mine.items():
            components = self.of[t]
            del components[bisect_left(components, a)]
            have = into.get(t)
            if have is None:
                into[t] = some
                _insert(components, b)
            elif len(some) == 1:
                _insert(have, some[0])
            else:
                into[t] = sorted(have + some)
        self.members[b] += self.members.pop(a)
        self.up[a] = b
        return b

    def links(self, i: int, j: int, both: int) -> bool:
        return 100 * both >= self.percent * (self.sizes[i] + self.sizes[j] - both)

    def search(self, q: int) -> None:
        """Adds ``q`` and joins it to every component with a member that it links with."""
        own = self.tokens[q]
        least = -(-self.sizes[q] * self.percent // 100)
        found = [c for c, _ in occurring([self.of[t] for t in own if t in self.of], least)]
        mine = set(own) if found else ()
        linked = []
        for c in found:
            members = self.members[c]
            tried = members if len(members) <= self.TRIED else (*members[: self.TRIED // 2], *members[-self.TRIED // 2 :])
            if any(self.links(q, m, len(mine.intersection(self.tokens[m]))) for m in tried):
                linked.append(c)
            elif len(members) > len(tried):
                inner = self.inner[c]
                if any(self.links(q, m, both) for m, both in occurring([inner[t] for t in own if t in inner], least)):
                    linked.append(c)
        self.add(q)
        for c in linked:
            self.join(c, q)


def _insert(items: list[int], item: int) -> None:
    if not items or items[-1] < item:
        items.append(item)
    else:
        items.insert(bisect_left(items, item), item)


def divide_skip_links(sets: list[np.ndarray], queries: list[int], percent: int = PERCENT, labels: list[int] | None = None) -> Joined:
    """Components of the linked sets: every query is searched against all sets, the others are only there to be found.
    Sets with one label are known to be in one component."""
    joined = Joined(sets, percent)
    asked, first = set(queries), {}
    for i in range(len(sets)):
        if i not in asked:
            joined.add(i)
            if labels is not None:
                joined.join(first.setdefault(labels[i], i), i)
    for q in queries:
        joined.search(q)
    return joined


def _search_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node of a block (key columns g1, g2, g3) with the smallest of those it is joined with; itself if alone.

    ``rows``: g1, g2, g3, node, query (whether it is searched for), label (of its known component), shingles array<bigint>.
    A block is within a task's share.
    """
    ordered = rows.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "node")

    def links(block: dict[int, tuple[bool, int, np.ndarray]]) -> tuple[list[int], list[int]]:
        nodes = list(block)
        sets = [s for _, _, s in block.values()]
        if len(nodes) < 2:
            return nodes, nodes
        queries = sorted((i for i, (q, _, _) in enumerate(block.values()) if q), key=lambda i: len(sets[i]))
        union = divide_skip_links(sets, queries, percent, [label for _, label, _ in block.values()])
        least: dict[int, int] = {}
        roots = [union.find(i) for i in range(len(nodes))]
        for i, r in enumerate(roots):
            least[r] = min(least.get(r, nodes[i]), nodes[i])
        return nodes, [least[r] for r in roots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, {}
        for batch in chain(batches, [None]):
            if batch is not None:
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("g1", "g2", "g3"))))
                nodes, asked, labels = (batch.column(c).to_pylist() for c in ("node", "query", "label"))
                column = batch.column("shingles")
                values, offsets = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            for i in range(batch.num_rows if batch is not None else 1):
                if batch is None or keys[i] != key:
                    if block:
                        a, b = links(block)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                    block = {}
                    if batch is None:
                        return
                    key = keys[i]
                old = block.get(nodes[i])
                block[nodes[i]] = (asked[i] or bool(old and old[0]), labels[i], values[offsets[i] : offsets[i + 1]].copy())

    return map_batches(ordered, run, "a bigint, b bigint")


def _stars(keyed: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(node, root) of the nodes of ``keyed`` (node, ``key``) that share a key with another, connected by shared keys.

    Here and below a table of unique keys is written before it is joined: adaptive execution then splits the join where
    a key is hot, and a task that still has one streams its rows past a single row of the table.
    """
    shared = keyed.groupBy(key).agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    edges = keyed.join(scratch.save(shared.drop("most")), key).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    return scratch.save(connected_components(edges, scratch))


def _taken_apart(sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """``sets`` of large neighbourhoods with new roots: those that share rare shingles; sets that share none are left out.

    Shingles are ordered by how many sets here have them, then by value. A set of n that links with another lacks
    n - ceil(n * percent / 100) of the common shingles at most, so the rarest of these is among its first one more.
    Shingles of one set alone come first in that order and match nothing: only the places they leave are given.
    """
    each = sets.select("node", "n", F.explode("shingles").alias("shingle"))
    several = scratch.save(each.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1"))
    held = each.join(several, "shingle").groupBy("node", "n").agg(F.array_sort(F.collect_set(F.struct("holders", "shingle"))).alias("held"))
    given = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("held"))
    rare = held.select("node", F.explode(F.slice("held", 1, F.greatest(given, F.lit(0)).cast("int"))).alias("s")).select("node", F.col("s.shingle").alias("shingle"))
    roots = _stars(scratch.save(rare), "shingle", scratch)
    return sets.drop("root").join(small(roots, 500_000), "node").select("node", "root", "n", "shingles")


def _linked(sets: DataFrame, scratch: Scratch, percent: int, block: int) -> DataFrame:
    """(node, root): the components of the linked nodes of ``sets`` (node, root, n, shingles), a node at most once."""
    large = F.broadcast(scratch.save(sets.groupBy("root").agg(F.sum("n").alias("all")).where(F.col("all") > block).select("root")))  # all shingles / block of them at most
    if not large.isEmpty():
        apart = _taken_apart(sets.join(large, "root", "left_semi"), scratch, percent)
        sets = scratch.save(sets.join(large, "root", "left_anti").select("node", "root", "n", "shingles").unionByName(apart))
    big = F.broadcast(scratch.save(sets.groupBy("root").agg(F.sum("n").alias("n"), F.min("node").alias("leader")).where(F.col("n") > block)))  # all shingles / block of them at most
    big = big.select("root", F.ceil(F.col("n") / block).alias("blocks"), "leader")
    dealt = sets.join(big, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    zero, yes = F.lit(0).cast("bigint"), F.lit(True)
    every = F.explode(F.sequence(zero, F.col("blocks") - 1))
    rows = lambda g2, g3, asks, label: (F.col("root").alias("g1"), g2.alias("g2"), g3.alias("g3"), "node", asks.alias("query"), label.alias("label"), "shingles")
    member = dealt.select(*rows(F.col("block"), zero, yes, F.col("node")))
    if big.isEmpty():
        return scratch.save(_search_blocks(member, percent).toDF("node", "root"))  # no neighbourhood has two blocks
    dealt = scratch.save(dealt.where("blocks > 1")).select("*")
    leaders = dealt.where("node = leader").select(*rows(every, zero, yes, F.col("node")))
    first = scratch.save(_search_blocks(member.unionByName(leaders), percent))
    labels = scratch.save(connected_components(first, scratch))
    # members of large neighbourhoods that the leader's component has not taken in are searched against all blocks
    labelled = dealt.join(labels, "node", "left").select(dealt["*"], F.coalesce(labels["root"], F.col("node")).alias("label"))
    labelled = scratch.save(labelled)
    core = F.broadcast(labelled.where("node = leader").select("root", F.col("label").alias("core")))
    outside = labelled.join(core, "root").where("label <> core")
    parts = F.broadcast(outside.groupBy("root").agg(F.ceil(F.sum("n") / block).alias("parts")))  # as many as the askers fill
    asking = outside.join(parts, "root").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")))
    q = asking.select(*rows(every, F.col("part"), yes, F.col("label")))
    i = labelled.join(parts, "root").withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1))).select(*rows(F.col("block"), F.col("part"), F.lit(False), F.col("label")))
    second = scratch.save(_search_blocks(q.unionByName(i), percent))
    return scratch.save(connected_components(first.unionByName(second), scratch))


def ngram_components(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, component) and the columns ``carry`` for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest id of the component, ``component`` a number of its own, as ids may repeat; null if
    the row is in none. A document without words has 0 shingles and is linked with nothing. A null id links nothing and
    has a null component; repeated rows and rows that share an id are rows of their own. Very long texts are taken
    whole. An empty table gives no rows. Shingles and sets are compared by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    carried = [f"_carry{i}" for i in range(len(carry))]  # their own names may be those of columns made here
    source = docs.select("doc_id", "text", *(F.col(c).alias(a) for c, a in zip(carry, carried)))

    def make():
        def run(texts):
            sets = list(map(shingle_set, texts))
            return [len(s) for s in sets], list(map(node_of, sets)), [part_signatures(s, percent).view(np.int64) for s in sets]

        return run

    base = scratch.save(map_rows(source, ("doc_id", *carried), ("text",), make, "n bigint, node bigint, signatures array<bigint>"))
    known = base.where("node is not null and doc_id is not null")
    signed = known.select("node", F.explode("signatures").alias("signature"))
    near = _stars(signed, "signature", scratch)
    reps = scratch.save(known.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    wanted = scratch.save(near.join(reps, "node").select("doc_id", "node", "root"))

    def make_sets():
        def run(nodes, texts):
            sets = [shingle_set(t) for t in texts]
            same = [node_of(s) == node for s, node in zip(sets, nodes)]  # rows that share an id may hold other texts
            return [len(s) if k else None for s, k in zip(sets, same)], [s.view(np.int64) if k else None for s, k in zip(sets, same)]

        return run

    texts = docs.select("doc_id", "text").join(small(wanted, 500_000), "doc_id")
    sets = map_rows(texts, ("node", "root"), ("node", "text"), make_sets, "n bigint, shingles array<bigint>").where("n is not null")
    sets = scratch.save(sets)
    labels = _linked(sets, scratch, percent, block)
    named = scratch.save(reps.join(labels, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")))
    least = scratch.save(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    of_node = scratch.save(named.join(least, "root").select("node", "root", "component_id"))
    scratch.drop(sets, labels, near)
    named_id = F.col("doc_id").isNotNull()
    return base.select("doc_id", *carried, "n", "node").join(of_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(named_id, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(named_id, F.col("root")).alias("component"), *(F.col(a).alias(c) for c, a in zip(carry, carried)),
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM (SELECT * FROM sh JOIN n USING (doc_id)) a JOIN (SELECT * FROM sh JOIN n USING (doc_id)) b
    ON a.s = b.s AND a.doc_id <> b.doc_id AND a.n * 90 <= b.n * 100 AND b.n * 90 <= a.n * 100
  GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
