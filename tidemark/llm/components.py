"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint), root being the smallest node of its component.

    Large and small stars in turn (Kiveris et al., 2014) until one of each changes nothing: every node then hangs on its
    root. Each star is a table in the shared folder; only its counts come to the driver. The least neighbours are a
    table too, so their join is one that adaptive execution splits where a node has very many neighbours.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        hung = both.join(least, "a")
        if large:
            out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # pairs are (larger, smaller) here
            out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = scratch.save(out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        scratch.drop(least)
        return after

    def totals(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, large, unchanged = totals(now), True, 0
    while state[0] and unchanged < 2:
        after = star(now, large)
        seen, state, large = state, totals(after), not large
        unchanged = unchanged + 1 if state == seen else 0
        scratch.drop(now)
        now = after
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
