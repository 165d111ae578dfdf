"""Point-in-time features of every transaction.

Each transaction becomes events of its card: it adds its amount, leaves the 1-hour, 24-hour and 7-day windows again,
and its label arrives. Every feature is then a running total over the events of earlier seconds, so the cost is linear
however long a window or a card's history is. A card with many rows has its totals taken within chunks of its time,
after totals of the chunks before, so it is spread over its chunks; other cards are shuffled whole, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spec import HISTORY, LABEL_COUNTS, LABEL_FEATURES, PIT_FEATURES, WEEK, derive, moments

CHUNK_S = WEEK
#: Rows of a card that one task takes.
MOST_ROWS = 20_000
_WINDOWS = tuple(sorted({f.window_s for f in HISTORY if f.window_s}))
_SUMMED = tuple(sorted({f.window_s for f in HISTORY if f.window_s and f.func == "sum"}))
_ROW = ("TransactionID", "TransactionDT", "TransactionAmt")
_ARRIVES, _LABEL = 0, -1  # kinds of events; the others are the windows left, in seconds


def _events(tx: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The events of each transaction; ``_at`` is the last second that does not see one yet. What only the transaction
    itself needs is in ``_row``, which its arrival alone has, so the other events are narrow."""
    t = F.col("TransactionDT")
    event = lambda kind, at: F.struct(F.lit(kind).alias("_kind"), at.cast("bigint").alias("_at"))
    every = [event(_ARRIVES, t), *(event(w, t + w) for w in _WINDOWS), event(_LABEL, F.ceil("label_available_at") - 1)]
    known = F.filter(F.array(*every), lambda e: e["_at"].isNotNull())
    events = tx.select("card_id", "_own_cents", F.col("isFraud").alias("_own_fraud"), F.struct(*_ROW, *keep).alias("_row"), F.inline(known))
    return events.withColumn("_row", F.when(F.col("_kind") == _ARRIVES, F.col("_row")))


def _asks() -> Column:
    return F.col("_kind") == _ARRIVES


def _summands() -> dict[str, Column]:
    """What each event adds to the running totals; squares of a long history pass 64 bits."""
    zero, one, kind, cents = F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.col("_kind"), F.col("_own_cents")
    label = kind == _LABEL
    in_window = lambda w, value: F.when(_asks(), value).when(kind == w, -value).otherwise(zero)
    return {
        "n": F.when(_asks(), one).otherwise(zero),
        "cents": F.when(_asks(), cents).otherwise(zero),
        "squares": F.when(_asks(), cents * cents).otherwise(zero).cast("decimal(20,0)"),
        **{f"n_{w}": in_window(w, one) for w in _WINDOWS},
        **{f"cents_{w}": in_window(w, cents) for w in _SUMMED},
        "labeled": F.when(label, one).otherwise(zero),
        "fraud": F.when(label, F.col("_own_fraud").cast("bigint")).otherwise(zero),
    }


def _light(tx: DataFrame, keep: tuple[str, ...], per_card: dict[str, Column]) -> DataFrame:
    """Running totals of each transaction whose card's rows fit into one task: rows are shuffled once, by card, before
    they become events, and sorted before the totals' summands are derived."""
    events = _events(tx.repartition("card_id"), keep).sortWithinPartitions("card_id", "_at")
    whole = W.partitionBy("card_id")
    earlier = whole.orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    own = F.when(_asks(), F.col("_at"))
    out = events.select(
        "card_id", "_row", "_own_cents", _asks().alias("_asks"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{s}") for s, c in _summands().items()),
        F.min(own).over(earlier).alias("_first"), F.max(own).over(earlier).alias("_last"),
    ).where("_asks").drop("_asks")
    out = out.select("card_id", "_row.*", *(c for c in out.columns if c not in ("card_id", "_row")))
    return out.withColumns({n: c.over(whole) for n, c in per_card.items()})


def _heavy(tx: DataFrame, chunk_s: int, keep: tuple[str, ...], per_card: dict[str, Column]) -> DataFrame:
    """The same of cards with more rows: totals within chunks of a card's time, after totals of the chunks before."""
    if per_card:
        per = tx.groupBy(F.col("card_id").alias("_card")).agg(*(c.alias(n) for n, c in per_card.items()))  # as few rows as there are such cards
        tx = tx.join(F.broadcast(per), tx["card_id"].eqNullSafe(per["_card"])).drop("_card")
        keep = (*keep, *per_card)
    events = _events(tx, keep).withColumn("chunk", F.floor(F.col("_at") / chunk_s))
    keys, summands = ["card_id", "chunk"], _summands()
    own = F.when(_asks(), F.col("_at"))
    totals = events.groupBy(*keys).agg(*(F.sum(c).alias(f"{s}_0") for s, c in summands.items()), F.min(own).alias("first_0"), F.max(own).alias("last_0"))
    past = W.partitionBy("card_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        F.col("card_id").alias("card_b"), F.col("chunk").alias("chunk_b"), *(F.coalesce(F.sum(f"{s}_0").over(past), F.lit(0)).alias(f"{s}_b") for s in summands),
        F.min("first_0").over(past).alias("first_b"), F.max("last_0").over(past).alias("last_b"),
    )
    earlier = W.partitionBy(*keys).orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    within = events.repartition(*keys).select(
        "card_id", "_row", "_own_cents", "chunk", _asks().alias("_asks"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(s) for s, c in summands.items()),
        F.min(own).over(earlier).alias("first"), F.max(own).over(earlier).alias("last"),
    ).where("_asks")
    joined = within.join(before, within["card_id"].eqNullSafe(before["card_b"]) & (within["chunk"] == before["chunk_b"]))
    total = {s: F.col(s) + F.col(f"{s}_b") for s in summands}
    return joined.select("card_id", "_row.*", "_own_cents", *(c.alias(f"_{s}") for s, c in total.items()), F.least("first", "first_b").alias("_first"), F.greatest("last", "last_b").alias("_last"))


def pit_features(tx: DataFrame, instant_labels: bool = False, chunk_s: int = CHUNK_S, sums: bool = False, most_rows: int = MOST_ROWS, keep: tuple[str, ...] = (), per_card: dict[str, Column] | None = None) -> DataFrame:
    """TransactionID, TransactionDT, TransactionAmt, card_id and every history, label and derived feature.

    ``tx``: columns of ``sources.tables.TX_COLUMNS``. ``instant_labels`` is the deliberate leak: a label is known one
    second after its transaction. A null card is a card of its own; rows without a time are left out. Null
    amounts count as rows and add nothing. ``sums`` adds cents and the exact sums of the history, card_cents_all and
    card_squares_all. ``keep``: further columns of ``tx`` that stay with their row, so that nothing has to be joined to it
    again. ``per_card``: aggregates of kept columns over all rows of a card, later ones included; nulls must not count.

    Cards with at most ``most_rows`` rows are each one task's, and their transactions are shuffled once; those with more
    are cut into chunks of ``chunk_s`` seconds.
    """
    if instant_labels:
        tx = tx.withColumn("label_available_at", F.col("TransactionDT") + F.lit(1.0))
    keep, per_card = tuple(c for c in keep if c not in (*_ROW, "card_id")), per_card or {}
    needed = (*_ROW, "card_id", "isFraud", "label_available_at")
    tx = tx.select(*needed, F.coalesce("cents", F.lit(0)).alias("_own_cents"), *(c for c in keep if c not in needed))
    hot = tx.groupBy(F.col("card_id").alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_n") > most_rows).select("_hot")  # one in most_rows at most
    is_hot = tx["card_id"].eqNullSafe(hot["_hot"])
    light, heavy = (tx.join(F.broadcast(hot), is_hot, how) for how in ("left_anti", "left_semi"))
    raw = _light(light, keep, per_card).unionByName(_heavy(heavy, chunk_s, keep, per_card))
    whole = moments(F.col("_n"), F.when(F.col("_n") > 0, F.col("_cents")), F.col("_squares"))
    columns = {}
    for f in HISTORY:
        if f.func == "count":
            columns[f.name] = F.col(f"_n_{f.window_s}" if f.window_s else "_n")
        elif f.func == "sum":
            columns[f.name] = F.col(f"_cents_{f.window_s}" if f.window_s else "_cents") / F.lit(100.0)
        else:
            columns[f.name] = {"mean": whole["mean"], "std": whole["std"], "min_t": F.col("_first"), "max_t": F.col("_last")}[f.func]
    columns |= dict(zip(LABEL_COUNTS, (F.col("_labeled"), F.col("_fraud"))))
    out = raw.withColumns(columns).withColumns(derive(F.col("TransactionDT"), F.col("TransactionAmt")))
    own = [] if "cents" in keep else [F.col("_own_cents").alias("cents")]
    exact = [*own, F.col("_cents").alias("card_cents_all"), F.col("_squares").alias("card_squares_all")] if sums else []
    derived = (c for c in (*PIT_FEATURES, *LABEL_FEATURES) if c not in {f.name for f in HISTORY} | set(LABEL_COUNTS))
    return out.select("TransactionID", "TransactionDT", "TransactionAmt", "card_id", *(f.name for f in HISTORY), *LABEL_COUNTS, *derived, *exact, *keep, *per_card)
