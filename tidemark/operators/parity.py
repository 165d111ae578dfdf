"""Does one feature table equal another? Row by row, feature by feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spec import LABEL_FEATURES, PIT_FEATURES

FEATURES = (*PIT_FEATURES, *LABEL_FEATURES)
RTOL = ATOL = 1e-6


def close(a: Column, b: Column) -> Column:
    """Both null, or |a - b| <= ATOL + RTOL * |b|: ``b`` is the side that is right."""
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= ATOL + RTOL * F.abs(b), F.lit(False))


def _paired(online: DataFrame, offline: DataFrame, features: tuple[str, ...]) -> DataFrame:
    a = online.select("TransactionID", F.lit(True).alias("_a"), *(F.col(f).cast("double").alias(f"a_{f}") for f in features))
    b = offline.select("TransactionID", F.lit(True).alias("_b"), *(F.col(f).cast("double").alias(f"b_{f}") for f in features))
    return a.join(b, "TransactionID", "full_outer")


def compare_features(online: DataFrame, offline: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(feature, mismatches, max_abs_diff) per feature, and the row '*': rows with any mismatch, of ``rows`` in all.

    Raises if the two tables do not hold the same transactions.
    """
    pairs = _paired(online, offline, features)
    both = pairs.where("_a and _b")
    alone = pairs.where("_a is null or _b is null").limit(1).count()
    if alone:
        raise ValueError("the tables hold different transactions")
    bad = {f: ~close(F.col(f"a_{f}"), F.col(f"b_{f}")) for f in features}
    any_bad = None
    for c in bad.values():
        any_bad = c if any_bad is None else any_bad | c
    sums = [F.count("*").alias("rows"), F.coalesce(F.sum(any_bad.cast("bigint")), F.lit(0)).alias("bad_rows")]
    for f in features:
        sums += [F.coalesce(F.sum(bad[f].cast("bigint")), F.lit(0)).alias(f"m_{f}"), F.coalesce(F.max(F.abs(F.col(f"a_{f}") - F.col(f"b_{f}"))), F.lit(0.0)).alias(f"d_{f}")]
    one = both.agg(*sums)
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mismatches"), F.col(f"d_{f}").alias("max_abs_diff")) for f in features]
    whole = F.struct(F.lit("*").alias("feature"), F.col("bad_rows").alias("mismatches"), F.greatest(*(F.col(f"d_{f}") for f in features)).alias("max_abs_diff"))
    return one.select("rows", F.inline(F.array(whole, *rows))).select("feature", "rows", "mismatches", "max_abs_diff")
