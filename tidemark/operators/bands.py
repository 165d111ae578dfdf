"""Joins on ranges of time, by bands: rows meet only where their bands are the same or next to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spec import DAY


def _band(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(float(width))).cast("bigint")


def window_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, width: float, how: str = "inner") -> DataFrame:
    """Pairs of rows of one ``key`` with ``left_time`` - ``width`` <= ``right_time`` <= ``left_time``.

    A right row has one band of ``width`` and a left row looks into two, so each pair is met once and, for a fixed width,
    the candidates grow with the rows, spread over a key's bands. The right columns are named right_ and their name.
    ``how``: inner or left; a left row without a partner then has nulls. Null keys and times have no partners.
    """
    if width <= 0:
        raise ValueError("the width must be above 0")
    there = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    there = there.select(*(F.col(c).alias(f"right_{c}") for c in right.columns)).withColumn("_band", _band(F.col(f"right_{right_time}"), width))
    own = _band(F.col(left_time), width)
    numbered = left.withColumn("_row", F.monotonically_increasing_id()) if how == "left" else left
    here = numbered.where(F.col(key).isNotNull() & F.col(left_time).isNotNull()).withColumn("_probe", F.explode(F.array(own - 1, own)))
    inside = F.col(f"right_{right_time}").between(F.col(left_time) - F.lit(width), F.col(left_time))
    pairs = here.join(there, (F.col(key) == F.col(f"right_{key}")) & (F.col("_probe") == F.col("_band")) & inside).drop("_probe", "_band")
    if how == "inner":
        return pairs
    if how != "left":
        raise ValueError(f"how is inner or left, not {how}")
    alone = numbered.join(pairs.select("_row").distinct(), "_row", "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True).drop("_row")


def labels_by_bands(tx: DataFrame, width: float = DAY) -> DataFrame:
    """TransactionID, card_labeled_cnt and card_fraud_cnt: the labels of its card that had arrived by each transaction.

    Labels of whole earlier bands come as running totals of a card's bands; only labels of the transaction's own band are
    compared one by one. Null cards and times see no label. An independent check of the features' label counts.
    """
    known = tx.where("card_id is not null and label_available_at is not null")
    labels = known.select("card_id", F.col("label_available_at").alias("at"), F.coalesce("isFraud", F.lit(0)).alias("fraud"))
    per = labels.groupBy("card_id", _band(F.col("at"), width).alias("band")).agg(F.count("*").alias("labeled"), F.sum("fraud").alias("fraud"))
    asked = tx.where("card_id is not null and TransactionDT is not null").select("TransactionID", "card_id", F.col("TransactionDT").alias("t"), _band(F.col("TransactionDT"), width).alias("band"))
    every = per.unionByName(asked.select("card_id", "band", F.lit(0).cast("bigint").alias("labeled"), F.lit(0).cast("bigint").alias("fraud")).distinct())
    bands = every.groupBy("card_id", "band").agg(F.sum("labeled").alias("labeled"), F.sum("fraud").alias("fraud"))
    earlier = W.partitionBy("card_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)  # a row a band of a card
    before = bands.select("card_id", "band", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("labeled", "fraud")))
    own = asked.join(labels.withColumn("band", _band(F.col("at"), width)), ["card_id", "band"]).where("at <= t")
    own = own.groupBy("TransactionID").agg(F.count("*").alias("labeled"), F.sum("fraud").alias("fraud"))
    found = asked.join(before, ["card_id", "band"]).join(own, "TransactionID", "left")
    total = lambda c: F.coalesce(F.col(f"{c}_before"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))
    counts = found.select("TransactionID", total("labeled").alias("labeled"), total("fraud").alias("fraud"))
    out = tx.select("TransactionID").join(counts, "TransactionID", "left")
    return out.select("TransactionID", F.coalesce("labeled", F.lit(0)).alias("card_labeled_cnt"), F.coalesce("fraud", F.lit(0)).alias("card_fraud_cnt"))
