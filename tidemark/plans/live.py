"""Queries that run a stream or fit models."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset, decide, monitor, parity
from ..operators.pit import pit_features
from ..operators.scratch import saved, shared_folder
from ..sources.tables import table, transactions_from_orders, write_document
from ..streaming import online
from . import ladder, registry

DAY = 86_400.0
START = 20 * DAY  # of the live part of the event table, which spans 30 days
_COLUMNS = tuple(registry._FULL)


def _stream(spark: SparkSession, sf_dir: str, start: float | None, slices: list[float], score=None, tx: DataFrame | None = None) -> DataFrame:
    """Online features of the events from ``start`` on, over state seeded with the history before it."""
    tx = registry.tx(spark, sf_dir) if tx is None else tx
    history = None if start is None else online.history_state(tx, start)
    return online.replay(online.build_events(tx, start=start), slices, shared_folder(spark), score, history=history)


def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the stream in three micro-batches."""
    return online.with_derived(_stream(spark, sf_dir, None, [10 * DAY, 20 * DAY])).select(*_COLUMNS)


def stream_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the stream is delivered twice; the features are those of one delivery."""
    events = online.build_events(registry.tx(spark, sf_dir))
    twice = events.unionByName(events)
    return online.with_derived(online.replay(twice, [10 * DAY, 20 * DAY], shared_folder(spark), once=True)).select(*_COLUMNS)


def stream_missing_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online against batch features where amounts and labels are missing."""
    tx = registry.tx(spark, sf_dir)
    gone = F.col("TransactionID") % 7 == 0
    null = lambda c: F.when(~gone, F.col(c))
    tx = tx.withColumns({"TransactionAmt": null("TransactionAmt"), "cents": null("cents"), "isFraud": F.when(F.col("TransactionID") % 11 > 0, F.col("isFraud"))})
    live = online.with_derived(_stream(spark, sf_dir, START, [25 * DAY], tx=tx))
    return parity.compare_features(live, pit_features(tx).where(F.col("TransactionDT") >= START))


def stream_backfill_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live part through the stream, over state seeded by aggregation."""
    return online.with_derived(_stream(spark, sf_dir, START, [25 * DAY])).select(*_COLUMNS)


def stream_hot_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online against batch features where one card has half of all events, many of them in the same second."""
    tx = registry.tx(spark, sf_dir)
    hot = F.col("TransactionID") % 2 == 0
    minute = F.col("TransactionDT") - F.col("TransactionDT") % 60
    tx = tx.withColumns({"card_id": F.when(hot, F.lit("hot")).otherwise(F.col("card_id")), "TransactionDT": F.when(hot, minute).otherwise(F.col("TransactionDT"))})
    live = online.with_derived(_stream(spark, sf_dir, START, [25 * DAY], tx=tx))
    return parity.compare_features(live, pit_features(tx).where(F.col("TransactionDT") >= START))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, late, kept): every twentieth event comes five days after its time, every third of the others half a day."""
    number = F.col("txid")
    delay = F.when(number % 20 == 0, 5 * DAY).when(number % 3 == 0, 0.5 * DAY).otherwise(0.0)
    events = online.build_events(registry.tx(spark, sf_dir)).withColumn("delivered", F.col("t") + delay)
    replay = online.Replay(events, [10 * DAY, 20 * DAY], shared_folder(spark), by="delivered")
    replay.run()
    return replay.late()


def parity_run(spark: SparkSession, tx: DataFrame, start: float, slices: list[float], folder: str, path: str | None = None) -> dict:
    """Online against batch features of the transactions from ``start`` on, with the run's rates; saved as JSON at
    ``path`` if given.

    rows, mismatched_rows, max_abs_diff, features (name: mismatches, max_abs_diff), history_cards, live_events,
    prepare_s (history's state), write_s, take_s, events_per_s, and slices, one entry a slice of :class:`online.Replay`.
    """
    began = time.monotonic()
    history = saved(online.history_state(tx, start))
    cards = history.select("card_id").distinct().count()
    prepared = time.monotonic() - began
    replay = online.Replay(online.build_events(tx, start=start), slices, folder, history=history)
    live = online.with_derived(replay.run())
    batch = pit_features(tx).where(F.col("TransactionDT") >= start)
    found = {r["feature"]: r for r in parity.compare_features(live, batch).collect()}  # one row a feature
    total = found.pop("*")
    per = {f: {"mismatches": r["mismatches"], "max_abs_diff": r["max_abs_diff"]} for f, r in found.items()}
    events, take = sum(p["events"] for p in replay.progress), sum(p["take_s"] for p in replay.progress)
    report = {
        "rows": total["rows"], "mismatched_rows": total["mismatches"], "max_abs_diff": max((r["max_abs_diff"] or 0.0 for r in per.values()), default=0.0), "features": per,
        "history_cards": cards, "live_events": events, "prepare_s": prepared, "write_s": sum(p["write_s"] for p in replay.progress), "take_s": take, "events_per_s": events / take,
        "slices": replay.progress,
    }
    if path:
        write_document(spark, report, path)
    return report


def stream_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online against batch features of the live transactions, feature by feature."""
    live = online.with_derived(_stream(spark, sf_dir, START, [25 * DAY]))
    batch = pit_features(registry.tx(spark, sf_dir)).where(F.col("TransactionDT") >= START)
    return parity.compare_features(live, batch)


BASE, CATEGORIES = ("TransactionAmt", "hour", "day"), ("weekday",)
#: Most rounds of a model of the ladders: a stage of ten takes seconds.
ROUNDS = 200


def _with_base(spark: SparkSession, sf_dir: str, source=registry.tx) -> DataFrame:
    day = F.floor(F.col("TransactionDT") / DAY)
    weekday = F.concat(F.lit("day "), F.pmod(day, F.lit(7)))
    return source(spark, sf_dir).withColumns({"hour": F.pmod(F.floor(F.col("TransactionDT") / 3600), F.lit(24)), "day": day, "weekday": weekday})


def _orders_with_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = lambda spark, sf_dir: transactions_from_orders(table(spark, sf_dir, "orders"), F.col("o_orderpriority").alias("priority"))
    return _with_base(spark, sf_dir, orders)


def ladder_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.leakage_ladder(_with_base(spark, sf_dir), BASE, ROUNDS, CATEGORIES)


def honest_ladder_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.honest_ladder(_with_base(spark, sf_dir), BASE, ROUNDS, CATEGORIES)


def headline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.headline(_with_base(spark, sf_dir), BASE, ROUNDS, CATEGORIES)


def _history_model(spark: SparkSession, sf_dir: str) -> ladder.Model:
    """A model of the history, saved and loaded again, as a service would load it."""
    history = pit_features(registry.tx(spark, sf_dir)).where(F.col("TransactionDT") < START)
    rows = history.join(registry.tx(spark, sf_dir).select("TransactionID", "isFraud"), "TransactionID")
    cut = F.col("TransactionDT") < 0.85 * START
    path = f"{shared_folder(spark)}/model"
    ladder.fit(rows.where(cut), rows.where(~cut), registry.PIT_FEATURES, trees=ROUNDS).save(path)
    return ladder.Model.load(spark, path)


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live part scored in the stream by a model of the history: (TransactionID, score)."""
    model = _history_model(spark, sf_dir)
    return _stream(spark, sf_dir, START, [25 * DAY], lambda batch: model.score(batch).select("TransactionID", "score"))


def online_batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (rows, unscored, max_abs_diff): scores of the stream against scores of the batch features."""
    model = _history_model(spark, sf_dir)
    live = _stream(spark, sf_dir, START, [25 * DAY], lambda batch: model.score(batch).select("TransactionID", "score"))
    batch = model.score(pit_features(registry.tx(spark, sf_dir)).where(F.col("TransactionDT") >= START)).select("TransactionID", F.col("score").alias("batch"))
    both = batch.join(live, "TransactionID", "full_outer")
    return both.agg(
        F.count("*").alias("rows"), F.sum((F.col("score").isNull() | F.col("batch").isNull()).cast("bigint")).alias("unscored"), F.max(F.abs(F.col("score") - F.col("batch"))).alias("max_abs_diff")
    )


def ladder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, train_rows, stop_rows, test_rows, train_frauds) of every rung: what the models are fitted to and judged on."""
    rows = _with_base(spark, sf_dir)
    out = None
    for name, parts, _ in (*ladder.leaky_rungs(rows, BASE), *ladder.honest_rungs(rows, BASE)):
        of = lambda part: F.sum((F.col("part") == part).cast("bigint"))
        one = parts.agg(F.lit(name).alias("variant"), of("train").alias("train_rows"), of("stop").alias("stop_rows"), of("test").alias("test_rows"), F.sum(F.when(F.col("part") == "train", F.col("isFraud"))).alias("train_frauds"))
        out = one if out is None else out.unionByName(one)
    return out


def scored_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy table of the models' own scores."""
    sets = ladder.scored_sets(_orders_with_base(spark, sf_dir), BASE, categorical=(*CATEGORIES, "priority"))
    return decide.policy_table(sets.honest, sets.careless, sets.holdout)


def scored_set_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set, rows, frauds, unscored): which rows choose the thresholds and which judge them."""
    sets = ladder.scored_sets(_orders_with_base(spark, sf_dir), BASE, trees=10, categorical=(*CATEGORIES, "priority"))
    parts = {"honest": sets.honest, "careless": sets.careless, "holdout": sets.holdout.withColumn("score", F.col("score_honest") + F.col("score_naive"))}
    count = lambda name, df: df.agg(F.lit(name).alias("set"), F.count("*").alias("rows"), F.sum("isFraud").cast("bigint").alias("frauds"), F.sum(F.col("score").isNull().cast("bigint")).alias("unscored"))
    first, *rest = (count(name, df) for name, df in parts.items())
    for more in rest:
        first = first.unionByName(more)
    return first


def score_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the honest model's score and of all its inputs, selection rows against the holdout."""
    categorical = (*CATEGORIES, "priority")
    selection, holdout = ladder.honest_inputs(_orders_with_base(spark, sf_dir), BASE, categorical=categorical)
    return monitor.drift_report(selection, holdout, ("score_honest", *BASE, *ladder.HONEST), categorical)


_FULL_SQL = registry._pit_sql(registry._EVENTS) + f"SELECT {', '.join(_COLUMNS)} FROM feat"
_PARITY_SQL = f"""WITH {registry._EVENTS} SELECT f AS feature, (SELECT count(*) FROM tx WHERE TransactionDT >= {int(START)}) AS rows, 0::BIGINT AS mismatches, 0.0::DOUBLE AS max_abs_diff
FROM (SELECT unnest(['*', {", ".join(f"'{f}'" for f in parity.FEATURES)}]) AS f)"""
_HOT_SQL = f"""WITH {registry._EVENTS},
moved AS (SELECT CASE WHEN TransactionID % 2 = 0 THEN TransactionDT - TransactionDT % 60 ELSE TransactionDT END AS moment FROM tx)
SELECT f AS feature, (SELECT count(*) FROM moved WHERE moment >= {int(START)}) AS rows, 0::BIGINT AS mismatches, 0.0::DOUBLE AS max_abs_diff
FROM (SELECT unnest(['*', {", ".join(f"'{f}'" for f in parity.FEATURES)}]) AS f)"""
_LATE_SQL = f"""WITH {registry._EVENTS},
e AS (
  SELECT 'tx' AS kind, CAST(TransactionDT AS DOUBLE) AS t, card_id, TransactionID AS txid FROM tx
  UNION ALL SELECT 'label', label_available_at, card_id, TransactionID FROM tx WHERE label_available_at IS NOT NULL),
d AS (SELECT *, t + CASE WHEN txid % 20 = 0 THEN {5 * DAY} WHEN txid % 3 = 0 THEN {0.5 * DAY} ELSE 0 END AS delivered FROM e),
s AS (SELECT *, CASE WHEN delivered < {10 * DAY} THEN 0 WHEN delivered < {20 * DAY} THEN 1 ELSE 2 END AS slice FROM d),
m AS (SELECT card_id, slice, max(t) AS newest FROM s GROUP BY card_id, slice),
j AS (
  SELECT s.kind, s.t, s.card_id, s.txid, max(m.newest) AS seen
  FROM s JOIN m ON m.card_id IS NOT DISTINCT FROM s.card_id AND m.slice < s.slice GROUP BY ALL)
SELECT kind, count(*) FILTER (t < seen) AS late, count(*) FILTER (t < seen AND (kind = 'label' OR t >= seen - {online.LATENESS})) AS kept FROM j GROUP BY kind"""


def _splits(source: str) -> str:
    return f"""WITH {source}, {registry._PERIODS},
dev AS (SELECT * FROM per WHERE period <> 'holdout'),
start AS (SELECT min(TransactionDT) FILTER (period = 'valid') AS valid, min(TransactionDT) FILTER (period = 'holdout') AS holdout FROM per),
train AS (SELECT 'all' AS k, * FROM per WHERE period = 'train' UNION ALL SELECT 'mature', * FROM per WHERE period = 'train' AND label_available_at <= (SELECT valid FROM start)),
placed AS (SELECT k, isFraud, row_number() OVER (PARTITION BY k ORDER BY TransactionDT, TransactionID) AS i, count(*) OVER (PARTITION BY k) AS n FROM train),
timed AS (SELECT k, isFraud, CASE WHEN i <= floor(n * {1 - dataset.STOP_SHARE}::DOUBLE) THEN 'train' ELSE 'stop' END AS part FROM placed
  UNION ALL SELECT k, isFraud, 'test' FROM dev, (VALUES ('all'), ('mature')) v(k) WHERE period = 'valid'),
dealt AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(TransactionID AS VARCHAR) || ':42'), TransactionID) AS i, count(*) OVER () AS n FROM dev),
mixed AS (SELECT *, CASE WHEN i <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.85::DOUBLE) THEN 'stop' ELSE 'test' END AS part FROM dealt),
parts AS (SELECT k, isFraud, part FROM timed UNION ALL SELECT 'mixed', isFraud, part FROM mixed)
"""


_ROWS_SQL = _splits(registry._EVENTS) + """SELECT variant, count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'stop') AS stop_rows, count(*) FILTER (part = 'test') AS test_rows,
  CAST(sum(isFraud) FILTER (part = 'train') AS BIGINT) AS train_frauds
FROM parts JOIN (VALUES ('time_split_base', 'all'), ('random_base', 'mixed'), ('random_global_aggs', 'mixed'), ('random_target_enc', 'mixed'), ('base_mature', 'mature'),
  ('pit_instant_labels', 'all'), ('pit_honest', 'mature')) v(variant, k) USING (k) GROUP BY variant"""
_SETS_SQL = _splits(registry._ORDERS) + f"""SELECT s AS set, count(*) AS rows, CAST(sum(isFraud) AS BIGINT) AS frauds, 0::BIGINT AS unscored FROM (
  SELECT 'honest' AS s, isFraud FROM per WHERE period = 'valid' AND TransactionDT <= (SELECT holdout FROM start) - {int(dataset.LEGIT_DELAY * dataset.DAY)}
  UNION ALL SELECT 'careless', isFraud FROM mixed WHERE part = 'test' UNION ALL SELECT 'holdout', isFraud FROM per WHERE period = 'holdout') GROUP BY s"""
QUERIES = {
    "stream_features": (stream_features, _FULL_SQL),
    "stream_backfill_features": (stream_backfill_features, _FULL_SQL + f" WHERE TransactionDT >= {int(START)}"),
    "stream_parity": (stream_parity, _PARITY_SQL),
    "stream_redelivery": (stream_redelivery, _FULL_SQL),
    "stream_hot_card": (stream_hot_card, _HOT_SQL),
    "stream_late": (stream_late, _LATE_SQL),
    "stream_missing_amounts": (stream_missing_amounts, _PARITY_SQL),
    "stream_scores": (stream_scores, None),
    "online_batch_scores": (online_batch_scores, f"WITH {registry._EVENTS} SELECT count(*) AS rows, 0::BIGINT AS unscored, 0.0::DOUBLE AS max_abs_diff FROM tx WHERE TransactionDT >= {int(START)}"),
    "ladder_rows": (ladder_rows, _ROWS_SQL),
    "scored_set_rows": (scored_set_rows, _SETS_SQL),
    "scored_policies": (scored_policies, None),
    "score_drift": (score_drift, None),
    "ladder_metrics": (ladder_metrics, None),
    "honest_ladder_metrics": (honest_ladder_metrics, None),
    "headline_metrics": (headline_metrics, None),
}
