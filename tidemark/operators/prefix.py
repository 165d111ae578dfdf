"""Running totals and order statistics over a whole table without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_RANGE, MOST_RANGES = 100_000, 1_024


def place(bounds: Column, value: Column) -> Column:
    """How many of the sorted array ``bounds`` are at most ``value``, by halving; 0 for a null value."""
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size(bounds) + F.lit(1.0))).cast("int"), F.lit(1)))
    range_ = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(now: Column, _: Column) -> Column:
        mid = F.shiftright(now["lo"] + now["hi"], 1)
        return F.when((now["lo"] < now["hi"]) & (F.get(bounds, mid) <= value), range_(mid + 1, now["hi"])).otherwise(range_(now["lo"], F.least(mid, now["hi"])))

    return F.aggregate(steps, range_(F.lit(0), F.size(bounds)), halve, lambda now: now["lo"])


def _place_among(bounds: list, value: Column) -> Column:
    """:func:`place` among bounds known to the driver: a tree of comparisons where they are few."""
    if len(bounds) > 64:
        return place(F.lit(bounds), value)

    def tree(lo: int, hi: int) -> Column:
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(F.lit(bounds[mid]) <= value, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def running_before(df: DataFrame, key: str, sums: dict[str, str], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Adds to each row, for every ``name: column`` of ``sums``, the total of the column over rows with a smaller key
    (larger, if ``descending``). Keys must be distinct and not null.

    Up to ROWS_PER_RANGE rows are one task's. More are cut at approximate quantiles of the key, into as many ranges as
    the counted rows need; totals of the ranges come first, then sums within each range.
    """
    rows = df.count()
    ranges = ranges or min(MOST_RANGES, -(-rows // ROWS_PER_RANGE))
    if ranges <= 1:  # ROWS_PER_RANGE rows at most: one task's share
        everything = W.orderBy(F.col(key).desc() if descending else F.col(key)).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(everything), F.lit(0)) for n, c in sums.items()})
    fine = [(i + 1) / MOST_RANGES for i in range(MOST_RANGES - 1)]
    cuts = df.agg(F.percentile_approx(key, fine, 4 * MOST_RANGES)).first()[0]
    bounds = sorted({cuts[round(MOST_RANGES * (i + 1) / ranges) - 1] for i in range(ranges - 1)} if cuts else ())
    placed = df.withColumn("_range", _place_among(bounds, F.col(key)))
    order = (lambda c: F.col(c).desc()) if descending else F.col
    earlier = W.orderBy(order("_range")).rowsBetween(W.unboundedPreceding, -1)  # MOST_RANGES rows at most
    totals = placed.groupBy("_range").agg(*(F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())))
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))))
    within = W.partitionBy("_range").orderBy(order(key)).rowsBetween(W.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), "_range")
    local = {n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_o{i}") for i, (n, c) in enumerate(sums.items())}
    return out.withColumns(local).drop("_range", *(f"_o{i}" for i in range(len(sums))))


MOST_HOT = 10_000
PARTS_OF_A_KEY = 256


def row_index(df: DataFrame, key: str, tie: str, name: str = "position", per_task: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds each row's position, from 0, in the order (``key``, ``tie``): numbers, ``tie`` distinct within a key. Rows
    without a key are left out; a null tie comes first.

    Rows are counted per key, keys get the totals of those before them, and rows are numbered within their key. A key
    with more than ``per_task`` rows, and more than one in MOST_HOT of all, is cut at approximate quantiles of its ties
    into parts that are counted and numbered on their own, so it is never one task's; other rows join by a shuffle.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    placed = running_before(counts, key, {"_before": "_n"})
    most = max(per_task, total // MOST_HOT)
    rest = df.join(placed.where(F.col("_n") <= most).drop("_n"), key).withColumn("_part", F.lit(0))
    hot = placed.where(F.col("_n") > most).drop("_n")  # MOST_HOT rows at most
    inside = df.join(F.broadcast(hot), key)
    fine = [(i + 1) / PARTS_OF_A_KEY for i in range(PARTS_OF_A_KEY - 1)]
    cuts = inside.groupBy(key).agg(F.array_sort(F.array_distinct(F.percentile_approx(tie, fine, 8 * PARTS_OF_A_KEY))).alias("_cuts"))
    inside = inside.join(F.broadcast(cuts), key).withColumn("_part", F.coalesce(place(F.col("_cuts"), F.col(tie)), F.lit(0))).drop("_cuts")
    earlier = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # PARTS_OF_A_KEY rows at most
    parts = inside.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    offsets = parts.select(key, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    split = inside.join(offsets, [key, "_part"]).withColumn("_before", F.col("_before") + F.col("_offset")).drop("_offset")
    own = F.row_number().over(W.partitionBy(key, "_part").orderBy(tie)) - 1
    return rest.unionByName(split).withColumn(name, F.col("_before") + own).drop("_before", "_part")


def values_at(df: DataFrame, key: str, shares: tuple[float, ...]) -> DataFrame:
    """One row with v0, v1, ...: the values at index floor(n * share) of the sorted keys, counted from 0."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    placed = running_before(counts, key, {"_before": "_n"})
    total = counts.agg(F.sum("_n").alias("_total"))
    wanted = placed.crossJoin(F.broadcast(total))  # one row
    return wanted.agg(*(F.min(F.when(F.col("_before") + F.col("_n") > F.floor(F.col("_total") * F.lit(s)), F.col(key))).alias(f"v{i}") for i, s in enumerate(shares)))


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row; none if that table is empty. The query fails if it has more rows."""
    rows = scalar.limit(2).agg(F.collect_list(F.struct("*")).alias("rows"))
    one = rows.select(F.inline(F.when(F.size("rows") <= 1, F.col("rows")).otherwise(F.raise_error(F.lit("a table of one row has several")))))
    return df.crossJoin(F.broadcast(one))


def hash_order(id_: Column, seed: int) -> Column:
    """A shuffle key that any SQL engine can repeat."""
    return F.md5(F.concat(id_.cast("string"), F.lit(f":{seed}")).cast("binary"))
