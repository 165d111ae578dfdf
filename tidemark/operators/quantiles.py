"""Exact quantiles of any number of groups without one task that holds a group's values.

A quantile is interpolated between two order statistics, and an order statistic is found by narrowing the range that it
lies in: approximate quantiles of a range cut it, exact counts of the parts tell which part holds the wanted rank, and so
on until a part is small enough to be sorted. A round keeps about one part in CUTS, so few rounds serve any table. Ranges
are rows of a table; only the size of the largest comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import place
from .scratch import MOST_BROADCAST, saved

#: Rows of a range that one task sorts.
MOST_SORTED = 500_000
CUTS = 256


def _narrowed(values: DataFrame, targets: DataFrame, hint) -> DataFrame:
    """``targets`` with the part of their range that holds their rank."""
    key = ["g", "lo", "hi"]
    rows = _rows_of(values, targets.select(*key).distinct(), hint)
    fine = [(i + 1) / CUTS for i in range(CUTS - 1)]
    cuts = rows.groupBy(*key).agg(F.array_sort(F.array_distinct(F.percentile_approx("value", fine, 8 * CUTS))).alias("cuts"))
    # A part holds the values from one cut to below the next; a cut itself is a part of its own, so ties end the search.
    cut = hint(saved(cuts).toDF("_g", "_lo", "_hi", "cuts"))
    parted = rows.join(cut, (F.col("g") == F.col("_g")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")))
    at = place(F.col("cuts"), F.col("value"))
    part = 2 * at + F.when((at > 0) & (F.get("cuts", at - 1) == F.col("value")), 0).otherwise(1)
    parts = parted.groupBy(*key, part.alias("part")).agg(F.count("*").alias("rows"), F.min("value").alias("least"), F.max("value").alias("most"))
    order = W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # 2 * CUTS rows at most
    parts = parts.withColumn("below", F.coalesce(F.sum("rows").over(order), F.lit(0))).drop("part")
    inside = (F.col("rank") >= F.col("before") + F.col("below")) & (F.col("rank") < F.col("before") + F.col("below") + F.col("rows"))
    return targets.drop("inside").join(parts, key).where(inside).select(
        "g", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("below")).alias("before"), F.col("rows").alias("inside")
    )


def _rows_of(values: DataFrame, ranges: DataFrame, hint) -> DataFrame:
    """``values`` with the columns of the range (g, lo, hi and others) that they lie in, one of their group's at most."""
    ranges = hint(ranges.withColumnRenamed("g", "_g"))
    return values.join(ranges, (F.col("g") == F.col("_g")) & F.col("value").between(F.col("lo"), F.col("hi"))).drop("_g")


def order_statistics(values: DataFrame, targets: DataFrame, hint=lambda df: df) -> DataFrame:
    """(g, rank, value): the value at each rank, counted from 0, of the sorted values of a group.

    ``values``: g, value (double, neither null nor NaN); they are read twice a round, and once in the end. ``targets``: g,
    rank (below the group's size, without repeats), and the group's lo, hi (least and largest value) and inside (size).
    ``hint`` marks tables of a row per rank for broadcast if they are known to be small.
    """
    targets = saved(targets.withColumn("before", F.lit(0).cast("bigint")))
    done = None
    while True:
        open_ = (F.col("lo") < F.col("hi")) & (F.col("inside") > MOST_SORTED)
        ready = targets.where(~open_)
        done = ready if done is None else done.unionByName(ready)
        if targets.where(open_).isEmpty():
            break
        targets = saved(_narrowed(values, targets.where(open_), hint))
    same = done.where(F.col("lo") >= F.col("hi")).select("g", "rank", F.col("lo").alias("value"))
    left = done.where(F.col("lo") < F.col("hi")).groupBy("g", "lo", "hi", "before").agg(F.collect_set(F.col("rank") - F.col("before")).alias("places"))
    order = W.partitionBy("g", "lo", "hi").orderBy("value")  # MOST_SORTED rows at most
    numbered = _rows_of(values, left, hint).withColumn("at", (F.row_number().over(order) - 1).cast("bigint"))
    found = numbered.where(F.array_contains("places", F.col("at"))).select("g", (F.col("at") + F.col("before")).alias("rank"), "value")
    return same.unionByName(found)


def exact_quantiles(df: DataFrame, column: str, shares: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``by`` columns, n, and quantiles array<double>: the exact quantiles of ``column`` at ``shares``, interpolated
    between the two values around index (n - 1) * share.

    Null and NaN values are left out, and so are groups without any other; null keys are a group. Without ``by`` there is
    one row, and none for a table without values. A group may hold any part of all rows. Infinite values count; between
    two equal ones the quantile is theirs.
    """
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    group = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by))) if by else F.struct(F.lit(0).alias("k0"))
    values = df.select(group.alias("g"), value.alias("value")).where("value is not null")
    groups = saved(values.groupBy("g").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    few = groups.limit(MOST_BROADCAST + 1).count() * 2 * len(shares) <= MOST_BROADCAST
    hint = F.broadcast if few else (lambda t: t)
    spots = F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(s))).alias("at")) for i, s in enumerate(shares)))
    ends = F.array(F.struct(F.floor("at").alias("rank"), F.lit(True).alias("low")), F.struct(F.ceil("at").alias("rank"), F.lit(False).alias("low")))
    wanted = groups.select("*", F.inline(spots)).select("*", F.inline(ends))
    found = order_statistics(values, wanted.select("g", "rank", "lo", "hi", F.col("n").alias("inside")).distinct(), hint)
    pair = lambda low: F.max(F.when(F.col("low") == low, F.col("value")))
    both = hint(wanted).join(found, ["g", "rank"]).groupBy("g", "n", "i").agg(pair(True).alias("a"), pair(False).alias("b"), F.first("at").alias("at"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    out = both.groupBy("g", "n").agg(F.sort_array(F.collect_list(F.struct("i", between.alias("v")))).alias("q"))  # one entry a share
    return out.select(*(F.col(f"g.k{i}").alias(c) for i, c in enumerate(by)), "n", F.transform("q", lambda e: e["v"]).alias("quantiles"))
