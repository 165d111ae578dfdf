"""Dataset assembly: periods cut on time, label delays, joins to side tables, and exact splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import hash_order, row_index, running_before, values_at, with_scalar

# Shares of the periods, delays in days, share of training rows that stop a fit early.
TRAIN_SHARE, VALID_SHARE = 0.70, 0.15
FRAUD_DELAY_MEDIAN, FRAUD_DELAY_SIGMA, FRAUD_DELAY_LEAST, FRAUD_DELAY_MOST = 14.0, 0.6, 1.0, 90.0
LEGIT_DELAY = 30.0
STOP_SHARE = 0.15
DAY, SEED = 86_400, 42


def period_cutoffs(tx: DataFrame) -> DataFrame:
    """One row (valid_from, holdout_from): the times at which 70% and 85% of the rows have passed."""
    cuts = values_at(tx.select("TransactionDT"), "TransactionDT", (TRAIN_SHARE, TRAIN_SHARE + VALID_SHARE))
    return cuts.select(F.col("v0").alias("valid_from"), F.col("v1").alias("holdout_from"))


def assign_period(tx: DataFrame) -> DataFrame:
    """Adds period (train, valid, holdout); rows of one second share a period, rows without a time have none."""
    t = F.col("TransactionDT")
    period = F.when(t < F.col("valid_from"), "train").when(t < F.col("holdout_from"), "valid").when(t.isNotNull(), "holdout")
    return with_scalar(tx, period_cutoffs(tx)).withColumn("period", period).drop("valid_from", "holdout_from")


def simulate_label_delay(tx: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds label_available_at: lognormal delays for fraud, within 1 to 90 days, 30 days for the rest.

    The draw is a hash of the id made normal (Box-Muller), so it depends on neither row order nor partitioning.
    """

    def uniform(k: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed * 2 + k), F.col("TransactionID")), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))

    normal = F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * F.pi() * uniform(1))
    drawn = F.exp(F.log(F.lit(FRAUD_DELAY_MEDIAN)) + FRAUD_DELAY_SIGMA * normal)
    fraud = F.least(F.greatest(drawn, F.lit(FRAUD_DELAY_LEAST)), F.lit(FRAUD_DELAY_MOST))
    days = F.when(F.col("isFraud") == 1, fraud).otherwise(F.lit(LEGIT_DELAY))
    return tx.withColumn("label_available_at", F.col("TransactionDT") + days * DAY)


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join that fails if a key repeats on either side."""
    for side in (left, right):
        if side.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is not unique")
    return left.join(right, key, how)


def build_dataset(transactions: DataFrame, identity: DataFrame, seed: int = SEED) -> DataFrame:
    """Transactions with their identity columns (null where there are none), period and label time; no row is lost."""
    extra = [c for c in identity.columns if c == "TransactionID" or c not in transactions.columns]
    whole = join_one_to_one(transactions, identity.select(*extra), "TransactionID")
    return simulate_label_delay(assign_period(whole), seed)


def period_summary(tx: DataFrame) -> DataFrame:
    """Rows, days covered and fraud rate of each period."""
    day = lambda c: F.round(c / F.lit(float(DAY)), 1)
    return tx.groupBy("period").agg(
        F.count("*").alias("rows"),
        day(F.min("TransactionDT")).alias("from_day"),
        day(F.max("TransactionDT")).alias("to_day"),
        F.sum("isFraud").alias("frauds"),
        F.round(F.lit(100.0) * F.sum("isFraud") / F.count("isFraud"), 2).alias("fraud_pct"),
    )


def mature(tx: DataFrame, period: str, cutoff: DataFrame) -> DataFrame:
    """Rows of a period whose label had arrived by the time in the one-row table ``cutoff`` (cutoff)."""
    return with_scalar(tx.where(F.col("period") == period), cutoff).where("label_available_at <= cutoff").drop("cutoff")


def time_ordered_split(tx: DataFrame, stop_share: float = STOP_SHARE) -> DataFrame:
    """Adds part: 'train' for the first rows in (time, id) order, 'stop' for the last ``stop_share`` of them, exactly.

    Rows are counted per second, which tells in which second the cut lies; only that second's rows are put in order.
    """
    timed, t = tx.where("TransactionDT is not null"), F.col("TransactionDT")
    counts = timed.groupBy(t).agg(F.count("*").alias("_n"))
    cut = math.floor((counts.agg(F.sum("_n")).first()[0] or 0) * (1 - stop_share))
    edge = running_before(counts, "TransactionDT", {"_before": "_n"}).where((F.col("_before") <= cut) & (F.col("_before") + F.col("_n") > cut)).first()
    if edge is None:  # no rows, or none to stop on
        return timed.withColumn("part", F.lit("train"))
    second, left = edge["TransactionDT"], cut - edge["_before"]
    if not left:
        return timed.withColumn("part", F.when(t < second, "train").otherwise("stop"))
    placed = row_index(timed.where(t == second), "TransactionDT", "TransactionID", "_position")
    inside = placed.withColumn("part", F.when(F.col("_position") < left, "train").otherwise("stop")).drop("_position")
    return timed.where(t != second).withColumn("part", F.when(t < second, "train").otherwise("stop")).unionByName(inside)


def random_split(tx: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds part: a shuffled 70/15/15 split of exact sizes into train, stop and test.

    Rows are counted per prefix of their hash, and only the two prefixes in which the cuts lie have their rows put in order.
    """
    keyed = tx.withColumn("_hash", hash_order(F.col("TransactionID"), seed))
    prefix = keyed.withColumn("_prefix", F.substring("_hash", 1, 4))  # 65,536 at most
    totals = prefix.groupBy("_prefix").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = totals.select("_prefix", before.alias("_before"), (before + F.col("_n")).alias("_to"))
    ends = with_scalar(placed, totals.agg(*(F.floor(F.sum("_n") * F.lit(s)).alias(c) for s, c in ((0.70, "_train"), (0.85, "_stop")))))
    inside = lambda cut: (F.col("_before") < F.col(cut)) & (F.col("_to") > F.col(cut))
    within = lambda cut: F.max(F.when(F.col("_to") <= F.col(cut), F.col("_prefix")))
    at = ends.agg(
        within("_train").alias("train"), within("_stop").alias("stop"), F.max("_train").alias("train_rows"), F.max("_stop").alias("stop_rows"),
        F.collect_list(F.when(inside("_train") | inside("_stop"), F.struct("_prefix", "_before"))).alias("cut"),
    ).first()
    cut = {r["_prefix"]: r["_before"] for r in at["cut"] if r["_prefix"] is not None}  # two at most
    part = lambda of, train, stop: F.when(of <= F.lit(train), "train").when(of <= F.lit(stop), "stop").otherwise("test")
    whole = prefix.where(F.col("_prefix").isNotNull() & ~F.col("_prefix").isin(*cut)).withColumn("part", part(F.col("_prefix"), at["train"], at["stop"]))
    rank = F.row_number().over(W.partitionBy("_prefix").orderBy("_hash", "TransactionID"))
    for p, rows_before in cut.items():
        own = prefix.where(F.col("_prefix") == p).withColumn("_rank", F.lit(rows_before) + rank)
        whole = whole.unionByName(own.withColumn("part", part(F.col("_rank"), at["train_rows"], at["stop_rows"])).drop("_rank"))
    return whole.drop("_hash", "_prefix")
