"""The feature specification: declared once, compiled to batch columns and to streaming state alike.

In terms of events: a transaction's event is seen from the next second on, a label's event from the second in which it
arrives, and a window of w seconds lets an event go w seconds after it took it in. So what shares a second sees the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY, WEEK = 3_600, 86_400, 604_800
FUNCTIONS = ("count", "sum", "mean", "std", "min_t", "max_t")


@dataclass(frozen=True)
class HistoryFeature:
    """An aggregate over a card's earlier transactions, of the last ``window_s`` seconds or of all time."""

    name: str
    func: str
    window_s: int | None = None

    def __post_init__(self) -> None:
        if self.func not in FUNCTIONS:
            raise ValueError(f"{self.name}: {self.func!r} is none of {FUNCTIONS}")
        if self.window_s is not None and self.func not in ("count", "sum"):
            raise ValueError(f"{self.name}: only counts and sums can be windowed")


# The features and their windows.
HISTORY = (
    HistoryFeature("card_cnt_1h", "count", HOUR),
    HistoryFeature("card_cnt_24h", "count", DAY),
    HistoryFeature("card_cnt_7d", "count", WEEK),
    HistoryFeature("card_amt_sum_24h", "sum", DAY),
    HistoryFeature("card_amt_sum_7d", "sum", WEEK),
    HistoryFeature("card_cnt_all", "count"),
    HistoryFeature("card_amt_mean_all", "mean"),
    HistoryFeature("card_amt_std_all", "std"),
    HistoryFeature("card_first_t", "min_t"),
    HistoryFeature("card_last_t", "max_t"),
)
LABEL_COUNTS = ("card_labeled_cnt", "card_fraud_cnt")
PIT_FEATURES = (
    "card_cnt_1h", "card_cnt_24h", "card_cnt_7d", "card_amt_sum_24h", "card_amt_sum_7d", "card_cnt_all",
    "card_amt_mean_all", "card_amt_std_all", "secs_since_last_tx", "card_age_s", "amt_vs_card_mean",
)
LABEL_FEATURES = (*LABEL_COUNTS, "card_fraud_rate")


def moments(n: Column, cents: Column, squares: Column) -> dict[str, Column]:
    """sum, mean and sample deviation of amounts from exact integer sums; mean null for no row, deviation below two."""
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products beyond 64 bits stay exact
    spread = (wide(n) * squares.cast("decimal(30,0)") - wide(cents) * wide(cents)).cast("double")
    return {
        "sum": F.coalesce(cents, F.lit(0)) / F.lit(100.0),
        "mean": cents / F.lit(100.0) / F.nullif(n, F.lit(0)),
        "std": F.when(n > 1, F.sqrt(spread / (wide(n) * wide(n - 1)).cast("double")) / 100.0),
    }


def derive(t: Column, amount: Column) -> dict[str, Column]:
    """Features of a row that already has the raw aggregates. Division by zero gives null."""
    return {
        "secs_since_last_tx": t - F.col("card_last_t"),
        "card_age_s": t - F.col("card_first_t"),
        "amt_vs_card_mean": amount / F.nullif(F.col("card_amt_mean_all"), F.lit(0.0)),
        "card_fraud_rate": F.col("card_fraud_cnt") / F.nullif(F.col("card_labeled_cnt"), F.lit(0)),
    }
