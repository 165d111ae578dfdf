"""The online path: labels and transactions in one ordered stream, features from keyed state.

Order matters only within a card: labels first at equal time, then transactions. All transactions of a card in one
second see the same history, so what travels is one row per card and second: its transactions are summed where they are
read, the state turns each second into features, and these join back to the transactions. A card with half of all
events thus meets its state with one row a second at most, while its transactions stay spread.

The state is held by ``transformWithStateInPandas``: counters, and a log of cumulative totals in blocks
(:mod:`.history`), which a batch extends at its end instead of rewriting a week. Its keys are buckets of cards, which are
taken in together; each card has its own entries in a bucket's maps.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.spec import DAY, HISTORY, WEEK, derive
from .history import BLOCK, NEVER, NOTHING, CardLog, to_bytes, to_rows

EVENT = "kind int, t double, card_id string, txid bigint, cents bigint, is_fraud int"
LABEL, TX = 0, 1
#: Events of one kind, card and second, as they reach the state: how many, their cents, squared cents, and frauds.
SECOND = "slice int, kind int, t double, card_id string, n bigint, cents bigint, hi bigint, lo bigint, fraud bigint"
_FEATURES = ", ".join(f"{f.name} {'bigint' if f.func in ('count', 'min_t', 'max_t') else 'double'}" for f in HISTORY)
#: Features of a second; or, with a null time, what came late for a card in a batch.
OUTPUT = f"slice int, card_id string, TransactionDT bigint, {_FEATURES}, card_labeled_cnt bigint, card_fraud_cnt bigint, late_tx bigint, dropped_tx bigint, late_labels bigint"
COUNTERS = "first bigint, seen double, labeled bigint, fraud bigint, tail bigint, starts binary, last binary"
BLOCKS = "rows binary"
CARD = "card_id string, known boolean"  # a null card: empty and not known
#: Keys of the state, each with the cards of one hash; fixed for the life of a stream.
BUCKETS = 1_024
_WINDOWS = tuple(sorted({f.window_s for f in HISTORY if f.window_s}))
INITIAL = (
    "card_id string, first bigint, seen double, labeled bigint, fraud bigint, n bigint, cents bigint, hi bigint, lo bigint, last bigint, "
    "block bigint, block_t array<bigint>, block_n array<bigint>, block_cents array<bigint>, block_hi array<bigint>, block_lo array<bigint>"
)
#: A transaction may come this much later than its card's newest event and still be taken in with its right history.
LATENESS = DAY
#: Added to times that a watermark is kept of. It begins at 0 and whatever is not after it counts as late, so times must be
#: above 0: those up to 2,000 years before the zero of the events are.
_EPOCH = float(1 << 36)
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LOW = (1 << 32) - 1


def build_events(tx: DataFrame, start: float | None = None, end: float | None = None, closed: bool = False) -> DataFrame:
    """Label arrivals and transactions with ``start`` <= t < ``end`` (<= ``end`` if ``closed``), each by its own time;
    label events keep the id of their transaction, so redelivered ones can be told apart. Null amounts stay null."""
    labels = tx.where("label_available_at is not null").select(
        F.lit(LABEL).alias("kind"), F.col("label_available_at").alias("t"), "card_id", F.col("TransactionID").alias("txid"), F.lit(None).cast("bigint").alias("cents"), F.col("isFraud").alias("is_fraud")
    )
    transactions = tx.where("TransactionDT is not null").select(
        F.lit(TX).alias("kind"), F.col("TransactionDT").cast("double").alias("t"), "card_id", F.col("TransactionID").alias("txid"), "cents", F.lit(None).cast("int").alias("is_fraud")
    )
    events = labels.unionByName(transactions)
    if start is not None:
        events = events.where(F.col("t") >= start)
    if end is not None:
        events = events.where(F.col("t") <= end if closed else F.col("t") < end)
    return events


def without_repeats(stream: DataFrame, late: str = "8 days") -> DataFrame:
    """Events delivered once: a repeat of a transaction or label that comes within ``late`` of the newest event is left
    out, and so are events later than that, which Spark counts as rows dropped by the watermark."""
    moment = F.timestamp_seconds(F.col("t") + F.lit(_EPOCH))
    return stream.withColumn("_moment", moment).withWatermark("_moment", late).dropDuplicatesWithinWatermark(["kind", "txid", "card_id"]).drop("_moment")


def ordered(events: DataFrame) -> DataFrame:
    return events.orderBy("t", "kind", "txid")


def _amounts() -> dict:
    """What one event adds to its second; a transaction without an amount adds nothing but itself."""
    square = F.coalesce(F.col("cents") * F.col("cents"), F.lit(0))
    return {
        "n": F.lit(1).cast("bigint"), "cents": F.coalesce("cents", F.lit(0)), "hi": F.shiftright(square, 32), "lo": square.bitwiseAND(F.lit(_LOW)),
        "fraud": F.coalesce(F.col("is_fraud").cast("bigint"), F.lit(0)),
    }


def as_seconds(events: DataFrame) -> DataFrame:
    """Each event of a stream as a row of SECOND of its own (``slice`` 0 if the stream has none)."""
    if "slice" not in events.columns:
        events = events.withColumn("slice", F.lit(0))
    return events.select("slice", "kind", "t", "card_id", *(c.alias(n) for n, c in _amounts().items()))


def per_second(events: DataFrame) -> DataFrame:
    """The rows of :func:`as_seconds` summed per kind, card and second, partly where they are read."""
    rows = as_seconds(events)
    return rows.groupBy("slice", "kind", "t", "card_id").agg(*(F.sum(c).alias(c) for c in ("n", "cents", "hi", "lo", "fraud")))


def history_state(tx: DataFrame, start: float, lateness: int = LATENESS) -> DataFrame:
    """The state that all events before ``start`` leave behind, for the first batch of a stream (schema INITIAL).

    One row per card, or per block of its log where the last week has transactions. Transactions are summed per second
    first, so what a card orders is one row a second of a week (and of ``lateness``) at most.
    """
    past = per_second(build_events(tx, end=start))
    horizon = int(np.ceil(start)) - WEEK - lateness
    is_tx, second = F.col("kind") == TX, F.col("t").cast("bigint")
    old = is_tx & (F.col("t") < horizon)
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    cards = past.groupBy("card_id").agg(
        F.min(F.when(is_tx, second)).alias("first"), F.max("t").alias("seen"), total("n", ~is_tx).alias("labeled"), total("fraud", ~is_tx).alias("fraud"),
        *(total(c, old).alias(c) for c in ("n", "cents", "hi", "lo")), F.max(F.when(old, second)).alias("last"),
    )
    recent = past.where(is_tx & ~old).select("card_id", second.alias("t"), "n", "cents", "hi", "lo")
    order = W.partitionBy("card_id").orderBy("t")
    numbered = recent.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("bigint"))
    entry = F.sort_array(F.collect_list(F.struct("t", "n", "cents", "hi", "lo")))  # BLOCK at most
    blocks = numbered.groupBy(F.col("card_id").alias("_card"), "block").agg(entry.alias("e"))
    parts = (F.col("e")[c].alias(f"block_{c}") for c in ("t", "n", "cents", "hi", "lo"))
    blocks = blocks.select("_card", "block", *parts)
    out = cards.join(blocks, cards["card_id"].eqNullSafe(blocks["_card"]), "left").drop("_card")
    return out.select(*(F.col(c.split()[0]) for c in INITIAL.split(", ")))


class CardProcessor(StatefulProcessor):
    """Features of each second of a card, see OUTPUT."""

    def __init__(self, lateness: int = LATENESS):
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", COUNTERS)
        self.blocks = handle.getMapState("blocks", "block bigint", BLOCKS)

    def close(self) -> None:
        pass

    def _load(self, number: int) -> np.ndarray | None:
        found = self.blocks.getValue((number,))
        return None if found is None or found[0] is None else to_rows(bytes(found[0]))

    def _log(self, starts: np.ndarray, tail: int, last: np.ndarray) -> CardLog:
        return CardLog(starts, tail, last, self._load, lambda number, rows: self.blocks.updateValue((number,), (to_bytes(rows),)), lambda number: self.blocks.removeKey((number,)))

    def _restore(self) -> tuple:
        saved = self.counters.get()
        if saved is None:
            return None, None, 0, 0, self._log(np.zeros(0, np.int64), -1, NOTHING)
        first, seen, labeled, fraud, tail, starts, last = saved
        return first, seen, labeled, fraud, self._log(np.frombuffer(bytes(starts), np.int64), tail, np.frombuffer(bytes(last), np.int64))

    def _save(self, first, seen, labeled, fraud, log: CardLog) -> None:
        self.counters.update((first, seen, int(labeled), int(fraud), int(log.tail), to_bytes(log.starts), to_bytes(log.last)))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Rows of :func:`history_state`; a card's blocks may come in any order and in several frames."""
        frame = initialState.sort_values("block") if len(initialState) > 1 else initialState
        first, seen, labeled, fraud, log = self._restore()
        for r in frame.itertuples(index=False):
            if seen is None:
                base = np.array([NEVER if pd.isna(r.last) else int(r.last), r.n, r.cents, r.hi, r.lo], np.int64)
                first, seen, labeled, fraud = None if pd.isna(r.first) else int(r.first), float(r.seen), int(r.labeled), int(r.fraud)
                log = self._log(np.zeros(0, np.int64), -1, base)
            if not pd.isna(r.block):
                log.put(np.array(r.block_t, np.int64), np.column_stack([np.array(c, np.int64) for c in (r.block_n, r.block_cents, r.block_hi, r.block_lo)]))
        if seen is not None:
            self._save(first, seen, labeled, fraud, log)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """A micro-batch of one card. A transaction earlier than what the card has seen is late: it is taken in, with its
        own history, if by no more than ``lateness``, else dropped. A late label counts from this batch on."""
        events = _columns(rows)
        late, found = self.take(*events[1:])
        if late is not None:
            yield _reports([(int(events[0][0]), key[0], *late)])
        if found is not None:
            yield _features([(int(events[0][0]), key[0], *found)])

    def take(self, kind: np.ndarray, t: np.ndarray, amounts: np.ndarray, frauds: np.ndarray) -> tuple[tuple | None, tuple | None]:
        """Takes a micro-batch into the state: what came late (transactions, dropped ones, labels), None if nothing did,
        and what :func:`_features` makes features of, None without transactions."""
        first, seen, labeled, fraud, log = self._restore()
        before, newest = (-np.inf if seen is None else seen), max(t.max(), -np.inf if seen is None else seen)
        is_tx = kind == TX
        late = is_tx & (t < before)
        dropped = late & ((t < before - self.lateness) | (t <= log.before_all())) if late.any() else late
        late_labels = ~is_tx & (t < before)
        n = amounts[:, 0]
        report = (n[late].sum(), n[dropped].sum(), n[late_labels].sum()) if late.any() or late_labels.any() else None
        taken = is_tx & ~dropped
        label_t, label = t[~is_tx], np.stack([n[~is_tx], frauds[~is_tx]], axis=1)
        order = np.argsort(label_t, kind="stable")
        arrived = np.concatenate([[[labeled, fraud]], [labeled, fraud] + np.cumsum(label[order], axis=0)]).astype(np.int64)
        found = None
        if taken.any():
            seconds, place = np.unique(t[taken].astype(np.int64), return_inverse=True)
            totals = np.zeros((len(seconds), 4), np.int64)
            np.add.at(totals, place, amounts[taken])
            first = int(seconds[0]) if first is None else min(first, int(seconds[0]))
            log.put(seconds, totals)
            known = arrived[np.searchsorted(label_t[order], seconds, side="right")]
            found = seconds, np.full(len(seconds), first, np.int64), known, log.before(seconds), *(log.before(seconds - w) for w in _WINDOWS)
        log.trim(int(np.ceil(newest)) - WEEK - self.lateness)
        self._save(first, float(newest), *arrived[-1].tolist(), log)
        return report, found


class _Entry:
    """A card's entry of a map state, as a value state."""

    def __init__(self, states, own: tuple):
        self.states, self.own = states, own

    def get(self):
        return self.states.getValue(self.own)

    def update(self, value) -> None:
        self.states.updateValue(self.own, value)


class _Entries(_Entry):
    """A card's entries of a map state, as a map state."""

    def getValue(self, key):  # noqa: N802
        return self.states.getValue((*self.own, *key))

    def updateValue(self, key, value) -> None:  # noqa: N802
        self.states.updateValue((*self.own, *key), value)

    def removeKey(self, key) -> None:  # noqa: N802
        self.states.removeKey((*self.own, *key))


class BucketProcessor(StatefulProcessor):
    """:class:`CardProcessor` for the cards of a bucket, each with its own entries in the state: a call has its cost in
    Spark and pandas, and most cards have few rows in a micro-batch."""

    def __init__(self, lateness: int = LATENESS):
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getMapState("counters", CARD, COUNTERS)
        self.blocks = handle.getMapState("blocks", f"{CARD}, block bigint", BLOCKS)

    def close(self) -> None:
        pass

    def _card(self, card: str | None) -> CardProcessor:
        one, own = CardProcessor(self.lateness), (card or "", card is not None)
        one.counters, one.blocks = _Entry(self.counters, own), _Entries(self.blocks, own)
        return one

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for card, places in _by_card(initialState["card_id"]):
            self._card(card).handleInitialState((card,), initialState.iloc[places], timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        slices, kind, t, amounts, fraud = _columns(frames)
        late, found = [], []
        for card, places in _by_card(pd.concat([f["card_id"] for f in frames])):
            report, seconds = self._card(card).take(kind[places], t[places], amounts[places], fraud[places])
            if report is not None:
                late.append((int(slices[places[0]]), card, *report))
            if seconds is not None:
                found.append((int(slices[places[0]]), card, *seconds))
        if late:
            yield _reports(late)
        if found:
            yield _features(found)


def _columns(frames) -> tuple[np.ndarray, ...]:
    """slice, kind, t, amounts (n, cents, hi, lo) and fraud of SECOND rows."""
    frames = list(frames)
    events = frames[0] if len(frames) == 1 else pd.concat(frames)
    amounts = np.column_stack([events[c].to_numpy(np.int64) for c in ("n", "cents", "hi", "lo")])
    return events["slice"].to_numpy(), events["kind"].to_numpy(), events["t"].to_numpy(), amounts, events["fraud"].to_numpy(np.int64)


def _by_card(cards: pd.Series) -> Iterator[tuple[str | None, np.ndarray]]:
    """Each card, null included, and where its rows are."""
    codes, names = pd.factorize(cards)  # null: -1
    order = np.argsort(codes, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if len(places):
            yield (None if codes[places[0]] < 0 else names[codes[places[0]]]), places


def _reports(late: list[tuple]) -> pd.DataFrame:
    """OUTPUT of (slice, card, late transactions, dropped ones, late labels), without a time."""
    row = {c.split()[0]: [None] * len(late) for c in OUTPUT.split(", ")}
    names = ("slice", "card_id", "late_tx", "dropped_tx", "late_labels")
    frame = pd.DataFrame(row | {c: [v if c == "card_id" else int(v) for v in values] for c, values in zip(names, zip(*late))})
    return frame.astype({c.split()[0]: "Int64" if c.split()[1] == "bigint" else "float64" for c in OUTPUT.split(", ") if c.split()[1] in ("bigint", "double")})


def _features(found: list[tuple]) -> pd.DataFrame:
    """OUTPUT of (slice, card, seconds, first second of the card, labels and frauds known, totals before each second, and
    before each of _WINDOWS)."""
    sizes = [len(f[2]) for f in found]
    seconds, first, known, now, *starts = (np.concatenate(c) for c in list(zip(*found))[2:])
    past = {w: now - start for w, start in zip(_WINDOWS, starts)}
    n, cents = now[:, 1], now[:, 2]
    cards = np.empty(len(found), object)
    cards[:] = [f[1] for f in found]
    out = {"slice": np.repeat(np.array([f[0] for f in found], np.int32), sizes), "card_id": np.repeat(cards, sizes), "TransactionDT": seconds}
    whole = lambda values, there: pd.arrays.IntegerArray(values, ~there)
    for f in HISTORY:
        window = past[f.window_s] if f.window_s else now
        if f.func == "count":
            out[f.name] = window[:, 1]
        elif f.func == "sum":
            out[f.name] = window[:, 2] / 100.0
        elif f.func == "mean":
            out[f.name] = np.where(n > 0, cents / 100.0 / np.maximum(n, 1), np.nan)
        elif f.func == "std":
            exact = zip(n.tolist(), cents.tolist(), now[:, 3].tolist(), now[:, 4].tolist())
            out[f.name] = [sqrt(float(m * ((hi << 32) + lo) - c * c) / float(m * (m - 1))) / 100.0 if m > 1 else np.nan for m, c, hi, lo in exact]
        else:
            out[f.name] = whole(first, first < seconds) if f.func == "min_t" else whole(now[:, 0].copy(), now[:, 0] > NEVER)
    none = whole(np.zeros(len(seconds), np.int64), np.zeros(len(seconds), bool))
    counts = {"card_labeled_cnt": known[:, 0], "card_fraud_cnt": known[:, 1]}
    return pd.DataFrame(out | counts | dict.fromkeys(("late_tx", "dropped_tx", "late_labels"), none), copy=False)


def online_features(seconds: DataFrame, history: DataFrame | None = None, lateness: int = LATENESS) -> DataFrame:
    """OUTPUT of a stream of SECOND rows, over the state ``history`` (:func:`history_state`) if given.

    The stream must run on the RocksDB state store, see :func:`state_store`. Blocks older than a week and ``lateness`` are
    removed as a card's time goes on.
    """
    bucket = F.pmod(F.hash("card_id"), F.lit(BUCKETS)).alias("bucket")
    initial = None if history is None else history.select("*", bucket).groupBy("bucket")
    return seconds.select("*", bucket).groupBy("bucket").transformWithStateInPandas(BucketProcessor(lateness), OUTPUT, "append", "None", initial)


@contextmanager
def state_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which writes what changed; the session's own choice returns."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, _STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_derived(raw: DataFrame) -> DataFrame:
    return raw.withColumns(derive(F.col("TransactionDT"), F.col("TransactionAmt")))


def join_back(features: DataFrame, events: DataFrame) -> DataFrame:
    """Raw features of each transaction of ``events`` (EVENT and slice): those of its card and second in its slice.
    Transactions dropped as too late have none and are left out."""
    rows = events.where(F.col("kind") == TX).select(
        "slice", F.col("txid").alias("TransactionID"), F.col("t").cast("bigint").alias("TransactionDT"), (F.col("cents") / 100.0).alias("TransactionAmt"), "card_id"
    )
    found = features.where("TransactionDT is not null").drop("late_tx", "dropped_tx", "late_labels").withColumnsRenamed({"slice": "_slice", "card_id": "_card", "TransactionDT": "_t"})
    same = (rows["TransactionDT"] == found["_t"]) & (rows["slice"] == found["_slice"]) & rows["card_id"].eqNullSafe(found["_card"])
    return rows.join(found, same).drop("_slice", "_card", "_t", "slice")


class Replay:
    """Events run through the stream, one micro-batch per slice of time.

    Each slice between two of the bounds ``slices`` of the column ``by`` is summed per second, written to the source in
    parallel, and taken in whole, so slices follow in order and none passes through one task. ``folder`` is shared by the
    cluster. ``by``: t, or another column that says when an event is delivered. ``history``: the state to begin with.
    ``score``: a function of a DataFrame applied to each batch's transactions before they are written, such as a model's
    transform. ``once`` leaves out events that are delivered again. ``speed`` paces the replay: so many seconds of event
    time pass in one second.

    After :meth:`run`, ``progress`` has one row per slice: slice, events, rows (what the state was given), write_s,
    take_s and events_per_s, the last over the time of taking in.
    """

    def __init__(self, events: DataFrame, slices: list[float], folder: str, *, by: str = "t", history: DataFrame | None = None, score=None, once: bool = False, speed: float | None = None):
        self.spark, self.slices, self.by, self.history, self.score, self.once, self.speed = events.sparkSession, list(slices), by, history, score, once, speed
        number = F.size(F.filter(F.lit(self.slices), lambda b: b <= F.col(by))) if self.slices else F.lit(0)
        self.events = events.withColumn("slice", number.cast("int"))
        self.source, self.out, self.checkpoint = (f"{folder}/{part}" for part in ("events", "features", "checkpoint"))
        self.progress: list[dict] = []

    def run(self) -> DataFrame:
        """Raw features of every transaction that was taken in, or what ``score`` made of them."""
        began = time.monotonic()
        with state_store(self.spark):
            for k in range(len(self.slices) + 1):
                if self.speed and k > 1:
                    time.sleep(max(0.0, (self.slices[k - 1] - self.slices[0]) / self.speed - (time.monotonic() - began)))
                self._take(k)
        written = self.spark.read.parquet(self.out)
        return written if self.score else join_back(written, self._transactions(self.events))

    def late(self) -> DataFrame:
        """(kind, late, kept): transactions and labels that came later than what their card had seen, after :meth:`run`
        without ``score``. Labels are always kept: they count from their arrival on."""
        written = self.spark.read.parquet(self.out).where("TransactionDT is null")
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        counts = written.agg(total("late_tx").alias("tx"), total("dropped_tx").alias("dropped"), total("late_labels").alias("labels"))
        rows = F.array(
            F.struct(F.lit("tx").alias("kind"), F.col("tx").alias("late"), (F.col("tx") - F.col("dropped")).alias("kept")),
            F.struct(F.lit("label").alias("kind"), F.col("labels").alias("late"), F.col("labels").alias("kept")),
        )
        return counts.select(F.inline(rows))

    def _transactions(self, events: DataFrame) -> DataFrame:
        """Each transaction once, in the slice that delivered it first."""
        return events.groupBy("kind", "t", "card_id", "txid", "cents").agg(F.min("slice").alias("slice")) if self.once else events

    def _take(self, k: int) -> None:
        seen, began = Observation(), time.monotonic()
        part = self.events.where(F.col("slice") == k).observe(seen, F.count("*").alias("events"))
        rows = part.select("slice", "kind", "t", "card_id", "txid", "cents", "is_fraud") if self.once else per_second(part)
        rows.write.mode("append").parquet(self.source)
        wrote = time.monotonic()
        stream = self.spark.readStream.schema(rows.schema).parquet(self.source)
        if self.once:
            stream = as_seconds(without_repeats(stream))
        features = online_features(stream, self.history)
        if self.score is None:
            writer = features.writeStream.format("parquet").option("path", self.out)
        else:
            transactions = self._transactions(self.events.where(F.col("slice") == k))
            writer = features.writeStream.foreachBatch(lambda batch, _: self.score(with_derived(join_back(batch, transactions))).write.mode("append").parquet(self.out))
        query = writer.option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        took = time.monotonic() - wrote
        events, given = seen.get["events"], sum(p["numInputRows"] for p in query.recentProgress)
        self.progress.append({"slice": k, "events": events, "rows": given, "write_s": wrote - began, "take_s": took, "events_per_s": events / took})


def replay(events: DataFrame, slices: list[float], folder: str, score=None, **options) -> DataFrame:
    """The features that a :class:`Replay` writes."""
    return Replay(events, slices, folder, score=score, **options).run()
