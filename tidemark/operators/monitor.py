"""Drift by the population stability index, and daily performance under labels that arrive late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import place, with_scalar
from .quantiles import exact_quantiles
from .scratch import saved

# Floor of an empty bin's share, and the levels of drift.
EPS, MODERATE, MAJOR = 1e-4, 0.1, 0.25
MISSING = "<missing>"
DAY = 86_400


def _index(p: Column, q: Column) -> Column:
    p, q = F.greatest(p, F.lit(EPS)), F.greatest(q, F.lit(EPS))
    return (q - p) * F.log(q / p)


def _shares(binned: DataFrame) -> DataFrame:
    """(feature, p, q) per bin from (feature, bin, in_ref): shares of the reference and of the current rows."""
    counts = binned.groupBy("feature", "bin").agg(F.sum(F.col("in_ref").cast("bigint")).alias("ref"), F.sum((~F.col("in_ref")).cast("bigint")).alias("cur"))
    totals = counts.groupBy("feature").agg(F.sum("ref").alias("all_ref"), F.sum("cur").alias("all_cur"))
    return counts.join(totals, "feature")


def drift_report(reference: DataFrame, current: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...] = (), bins: int = 10) -> DataFrame:
    """(feature, psi, level) for every column, from current against reference rows.

    Numeric columns are cut at the reference's exact deciles, missing values in a bin of their own; others are compared
    value by value. Empty bins count with the floor. All columns are done together.
    """
    shares = [(i + 1) / bins for i in range(bins - 1)]
    flag = lambda df, is_ref: df.withColumn("in_ref", F.lit(is_ref))
    parts = []
    if numeric:
        known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        values = reference.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), known(c).alias("value")) for c in numeric))))
        deciles = saved(exact_quantiles(values, "value", tuple(shares), ("feature",)))  # one row a feature
        of = lambda c: F.coalesce(F.max(F.when(F.col("feature") == c, F.array_sort(F.array_distinct("quantiles")))), F.array().cast("array<double>"))
        edges = deciles.agg(*(of(c).alias(f"_e_{c}") for c in numeric))
        both = flag(reference.select(*numeric), True).unionByName(flag(current.select(*numeric), False))
        bin_of = lambda c: F.when(known(c).isNull(), 0).otherwise(place(F.col(f"_e_{c}"), known(c)) + 1)
        long = with_scalar(both, edges).select("in_ref", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin")) for c in numeric))))
        seen = _shares(long)
        # bins that no row falls in still count with the floor
        wanted = edges.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.size(f"_e_{c}").alias("edges")) for c in numeric))))
        per = seen.groupBy("feature").agg(F.sum(_index(F.col("ref") / F.nullif("all_ref", F.lit(0)), F.col("cur") / F.nullif("all_cur", F.lit(0)))).alias("psi"))
        parts.append(wanted.join(per, "feature").select("feature", "psi"))  # both floors: an empty bin adds nothing
    if categorical:
        value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        both = flag(reference.select(*categorical), True).unionByName(flag(current.select(*categorical), False))
        long = both.select("in_ref", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), value(c).alias("bin")) for c in categorical))))
        parts.append(_shares(long).groupBy("feature").agg(F.sum(_index(F.col("ref") / F.nullif("all_ref", F.lit(0)), F.col("cur") / F.nullif("all_cur", F.lit(0)))).alias("psi")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.withColumn("psi", F.bround("psi", 4))
    level = F.when(F.col("psi") >= MAJOR, "major").when(F.col("psi") >= MODERATE, "moderate").otherwise("stable")
    return out.withColumn("level", level)


def level_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("level").agg(F.count("*").alias("features"))


def daily_report(scored: DataFrame, threshold: float, as_of: DataFrame) -> DataFrame:
    """One row per day: what was true in the end, and what labels known at ``as_of`` (one row, as_of) showed.

    ``scored``: TransactionDT, label_available_at, isFraud, score. Ratios are null where there is nothing to divide by.
    """
    first = scored.agg(F.min("TransactionDT").alias("_first"))
    alert = F.coalesce(F.col("score") >= F.lit(threshold), F.lit(False))
    fraud, known = F.col("isFraud") == 1, F.coalesce(F.col("label_available_at") <= F.col("as_of"), F.lit(False))
    day = F.floor((F.col("TransactionDT") - F.col("_first")) / F.lit(float(DAY))).cast("bigint")
    count = lambda c: F.sum(c.cast("bigint"))
    ratio = lambda a, b: F.bround(a / F.nullif(b, F.lit(0)), 3)
    rows = with_scalar(with_scalar(scored, first), as_of)
    return rows.groupBy(day.alias("day")).agg(
        F.count("*").alias("transactions"),
        count(alert).alias("alerts"),
        count(fraud).alias("fraud"),
        ratio(count(alert & fraud), count(alert)).alias("precision"),
        ratio(count(alert & fraud), count(fraud)).alias("recall"),
        ratio(count(known), F.count("*")).alias("labels_known"),
        count(fraud & known).alias("fraud_known"),
        ratio(count(alert & fraud & known), count(fraud & known)).alias("recall_known"),
    )
