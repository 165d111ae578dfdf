"""The careless features, kept to measure what they leak, and what production could really serve of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spec import moments

GLOBAL_AGGREGATES = ("card_tx_count", "card_amt_mean", "card_amt_std", "amt_vs_card_mean")
TARGET_ENCODING = ("card_fraud_rate", "card_fraud_count")


def _per_card(tx: DataFrame, totals: dict) -> DataFrame:
    """Totals of each card joined to its rows: unlike a window, the sums are partial before the shuffle and the join
    splits the rows of a large card."""
    per = tx.groupBy(F.col("card_id").alias("_card")).agg(*(c.alias(n) for n, c in totals.items()))
    return tx.join(per, tx["card_id"].eqNullSafe(per["_card"])).drop("_card")


def _amount_totals(counted: Column) -> dict[str, Column]:
    cents = F.when(counted, F.col("cents"))
    return {"total_n": F.count(F.when(counted, F.col("TransactionAmt"))), "total_cents": F.sum(cents), "total_squares": F.sum((cents * cents).cast("decimal(20,0)"))}


def _label_totals(counted: Column) -> dict[str, Column]:
    fraud = F.when(counted, F.col("isFraud"))
    return {"total_labeled": F.count(fraud), "total_fraud": F.sum(fraud)}


def card_totals(counted: Column) -> dict[str, Column]:
    """Aggregates over the rows of a card for which ``counted`` is true, of which :func:`from_totals` makes the features."""
    return _amount_totals(counted) | _label_totals(counted)


def _from_amounts(rows: DataFrame) -> DataFrame:
    got = moments(F.col("total_n"), F.col("total_cents"), F.col("total_squares"))
    out = rows.withColumns({"card_tx_count": F.col("total_n"), "card_amt_mean": got["mean"], "card_amt_std": got["std"]})
    return out.withColumn("amt_vs_card_mean", F.col("TransactionAmt") / F.nullif("card_amt_mean", F.lit(0.0))).drop("total_n", "total_cents", "total_squares")


def _from_labels(rows: DataFrame) -> DataFrame:
    out = rows.withColumns({"card_fraud_count": F.col("total_fraud"), "card_fraud_rate": F.col("total_fraud") / F.nullif("total_labeled", F.lit(0))})
    return out.drop("total_labeled", "total_fraud")


def from_totals(rows: DataFrame) -> DataFrame:
    """Adds GLOBAL_AGGREGATES and TARGET_ENCODING to rows that have their card's totals, which go."""
    return _from_labels(_from_amounts(rows))


def global_aggregates(tx: DataFrame) -> DataFrame:
    """Adds a card's count, mean and deviation over all its rows, later ones included, and the ratio to the mean."""
    return _from_amounts(_per_card(tx, _amount_totals(F.lit(True))))


def target_encoding(tx: DataFrame) -> DataFrame:
    """Adds a card's fraud rate and count over all its rows, the row's own label included."""
    return _from_labels(_per_card(tx, _label_totals(F.lit(True))))


def served_aggregates(features: DataFrame) -> DataFrame:
    """The careless features as they can be served: history so far and this row, and labels that have arrived.

    ``features``: ``pit_features(..., sums=True)``. The exact sums of the history take in the row's own amount, so the
    values are those that ``global_aggregates`` would give if the table ended with this row.
    """
    x = F.coalesce("cents", F.lit(0))
    n = F.col("card_cnt_all") + 1
    got = moments(n, F.col("card_cents_all") + x, F.col("card_squares_all") + (x * x).cast("decimal(20,0)"))
    served = {"card_tx_count": n, "card_amt_mean": got["mean"], "card_amt_std": got["std"], "card_fraud_count": F.col("card_fraud_cnt")}
    served["card_fraud_rate"] = F.col("card_fraud_cnt") / F.nullif("card_labeled_cnt", F.lit(0))
    return features.withColumns(served).withColumn("amt_vs_card_mean", F.col("TransactionAmt") / F.nullif("card_amt_mean", F.lit(0.0)))
