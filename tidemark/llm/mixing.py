"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Every document gets a virtual finish time, the running total of its source's words in shuffled order divided by the
source's target. A source whose target exceeds its size runs through its documents again, three times at most. All
finish times are put in one global order, and the mix is the longest prefix whose words fit the total budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read, small, words

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
SEED = "mix-1"
ROWS_PER_BUCKET = 10_000
INTERVALS = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, target) from (source, size): water filling under caps of ``passes`` times the size.

    Sources are ranked by code point, null last, and take the weights in turn. Sorted by cap over weight, a source is
    capped if its cap lies below the level that the sources from it on would share. The windows run over one row per
    source, after aggregation.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", rank.alias("rank"), weight.cast("bigint").alias("weight"))
    order = W.orderBy(F.col("source_size") * float(passes) / F.col("weight"), "rank")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cap = F.col("source_size") * passes
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double") / F.sum(
        "weight"
    ).over(after)
    per = per.withColumn("capped", cap < level * F.col("weight"))
    left = F.sum("source_size").over(every) - F.sum(F.when(F.col("capped"), cap).otherwise(0)).over(every)
    share = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    return per.withColumn("share", share).withColumn("left", left.cast("double")).select(
        "source",
        "source_size",
        F.when(F.col("capped"), cap.cast("double"))
        .otherwise(F.col("left") / F.nullif(F.col("share").cast("double"), F.lit(0.0)) * F.col("weight"))
        .alias("target"),
    )


def _cutoff(items: DataFrame, budget: int, rows_per_task: int = ROWS_PER_BUCKET):
    """The last item of the longest prefix, in the order (finish, shuffle_key, doc_id, pass), whose words fit ``budget``.

    None if all items fit. The interval of finish times that holds the boundary is split again until it is small
    enough for one sort.
    """
    bounds = items.agg(F.min("finish"), F.max("finish"), F.sum("size"), F.count("*")).first()
    lo, hi, total, rows = bounds
    if total is None or total <= budget:
        return None
    done, inside = 0, items
    while rows > rows_per_task and hi > lo:
        width = (hi - lo) / INTERVALS
        slot = F.least(F.floor((F.col("finish") - lo) / width), F.lit(INTERVALS - 1))
        parts = inside.groupBy(slot.alias("slot")).agg(F.sum("size"), F.count("*"), F.min("finish"), F.max("finish"))
        for _, words_here, n, low, high in sorted(parts.collect()):  # INTERVALS rows at most
            if done + words_here > budget:
                break
            done += words_here
        if n == rows:
            break
        lo, hi, rows = low, high, n
        inside = items.where(F.col("finish").between(lo, hi))
    key = ("finish", "shuffle_key", "doc_id", "pass")
    running = F.sum("size").over(W.orderBy(*key).rowsBetween(W.unboundedPreceding, 0))
    last = (
        inside.withColumn("running", running)
        .where(F.col("running") <= budget - done)
        .orderBy(*(F.col(k).desc() for k in key))
        .select(*key)
        .first()
    )
    return tuple(last) if last else (lo, "", None, 0)


def mix_sources(docs: DataFrame, weights=WEIGHTS, passes: int = MAX_PASSES, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, repeats) and the columns ``carry``, one row per row of ``docs``.

    ``docs``: doc_id, text, source; other columns are ignored. Null or blank text: size 0, taken 0. Null source: a
    source of its own, last. Repeated rows are rows of their own; equal rows share an order that makes no difference.
    An empty table gives no rows. The shuffle is a hash of the id with ``seed``, so reruns agree.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    carried = [f"_carry{i}" for i in range(len(carry))]  # their own names may be those of columns made here
    base = scratch.save(
        docs.select(
            "doc_id",
            "source",
            *(F.col(c).alias(a) for c, a in zip(carry, carried)),
            F.size(words(F.col("text"))).cast("bigint").alias("size"),
            F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("shuffle_key"),
        )
    )
    budget, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    name = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    targets = source_targets(base, weights, passes)
    targets = scratch.save(targets.select(name.alias("name"), "source_size", F.coalesce("target", F.lit(0.0)).alias("target")))
    # Running totals per source without one task per source: totals of hash buckets first, then within the buckets.
    buckets = max(256, -(-rows // ROWS_PER_BUCKET))
    bucket = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint") * buckets / F.lit(float(1 << 32)))
    base = base.select(name.alias("name"), "doc_id", *carried, "size", "shuffle_key", bucket.alias("bucket"))
    by_bucket = base.groupBy("name", "bucket").agg(F.sum("size").alias("words"))
    offset = F.coalesce(F.sum("words").over(W.partitionBy("name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.save(by_bucket.select("name", "bucket", offset.alias("offset")))
    within = W.partitionBy("name", "bucket").orderBy("shuffle_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    queued = scratch.save(
        base.withColumn("running", F.sum("size").over(within))
        .join(small(offsets), ["name", "bucket"])
        .join(small(targets), "name")
        .select("doc_id", *carried, "size", "source_size", "target", "shuffle_key", (F.col("running") + F.col("offset")).alias("running"))
    )

    def finish(n):
        return (F.col("running") + F.col("source_size") * (n - 1)).cast("double") / F.col("target")

    items = queued.where("size > 0 and target > 0").select(
        "doc_id", "size", "shuffle_key", F.inline(F.array(*(F.struct(F.lit(p).alias("pass"), finish(p).alias("finish")) for p in range(1, passes + 1))))
    )
    last = _cutoff(items, budget)
    if last is None:
        repeats = F.lit(passes)
    else:
        end, end_key, end_id, end_pass = last
        taken_pass = []
        for p in range(1, passes + 1):
            tie = (F.col("shuffle_key") < end_key) | (
                (F.col("shuffle_key") == end_key)
                & ((F.coalesce(F.col("doc_id") < F.lit(end_id), F.col("doc_id").isNull())) | (F.col("doc_id").eqNullSafe(F.lit(end_id)) & F.lit(p <= end_pass)))
            )
            f = finish(p)
            taken_pass.append(F.when((f < end) | ((f == end) & tie), 1).otherwise(0))
        repeats = sum(taken_pass[1:], taken_pass[0])
    repeats = F.when((F.col("size") > 0) & (F.col("target") > 0), repeats).otherwise(0)
    return queued.withColumn("repeats", repeats.cast("int")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", *(F.col(a).alias(c) for c, a in zip(carry, carried))
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).drop("repeats")


OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM base GROUP BY source),
weighed AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
levels AS (
  SELECT *, CAST(sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY s * 3.0::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER (ORDER BY s * 3.0::DOUBLE / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
capped AS (SELECT *, 3 * s < level * w AS c FROM levels),
targets AS (
  SELECT source, s, coalesce(CASE WHEN c THEN CAST(3 * s AS DOUBLE)
              ELSE CAST(sum(s) OVER () - sum(CASE WHEN c THEN 3 * s ELSE 0 END) OVER () AS DOUBLE)
                   / nullif(CAST(sum(CASE WHEN c THEN 0 ELSE w END) OVER () AS DOUBLE), 0) * w END, 0) AS target
  FROM capped),
queued AS (
  SELECT b.doc_id, b.k, b.size, t.s, t.target,
         CAST(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT doc_id, k, size, p, CAST(run + s * (p - 1) AS DOUBLE) / target AS f
  FROM queued, (VALUES (1), (2), (3)) v(p) WHERE size > 0 AND target > 0),
kept AS (
  SELECT doc_id, count(*) AS n
  FROM (SELECT *, sum(size) OVER (ORDER BY f, k, doc_id, p ROWS UNBOUNDED PRECEDING) AS total FROM items)
  WHERE total <= (SELECT sum(size) FROM base) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.s AS source_size, q.target, CAST(q.size * coalesce(kept.n, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN kept USING (doc_id)
"""
