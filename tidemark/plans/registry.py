"""Registered queries of the engine: name -> function of (spark, sf_dir), and the SQL that each is held against.

Scores are deterministic stand-ins, ``((id * 7919) % 997) / 997``, so that SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spec import LABEL_FEATURES, PIT_FEATURES
from ..operators import dataset, decide, leaky, monitor, parity
from ..operators.bands import labels_by_bands, window_join
from ..operators.pit import pit_features
from ..sources.tables import TX_COLUMNS, card_id, read_csv, read_periods, read_report, table, transactions_from_events, transactions_from_orders, write_ordered, write_report
from ..operators.prefix import row_index
from ..operators.quantiles import exact_quantiles
from ..streaming import online

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(table(spark, sf_dir, "events"))


def order_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_orders(table(spark, sf_dir, "orders"))


def tied_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five cards and times floored to the hour, so that most rows have others in their second."""
    return tx(spark, sf_dir).withColumns(
        {"card_id": (F.col("card_id").cast("bigint") % 5).cast("string"), "TransactionDT": F.floor(F.col("TransactionDT") / 3600) * 3600}
    )


def scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", ((F.col("TransactionID") * 7919) % 997) / F.lit(997.0))


_EVENTS = """tx AS (
  SELECT event_id AS TransactionID, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS TransactionDT, value AS TransactionAmt,
         CAST(round(value * 100) AS BIGINT) AS cents, CAST(user_id AS VARCHAR) AS card_id, CAST(event_type = 'error' AS INTEGER) AS isFraud,
         CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts)
              + (CASE WHEN event_type = 'error' THEN 1 + (event_id * 7919) % 7 ELSE 8 END) * 86400 AS DOUBLE) AS label_available_at
  FROM events)"""
_ORDERS = """tx AS (
  SELECT o_orderkey AS TransactionID, date_diff('second', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS TransactionDT, o_totalprice AS TransactionAmt,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(o_custkey AS VARCHAR) AS card_id, CAST(o_orderstatus = 'P' AS INTEGER) AS isFraud,
         CAST(date_diff('second', TIMESTAMP '1995-01-01 00:00:00', o_orderdate)
              + (CASE WHEN o_orderstatus = 'P' THEN 1 + (o_orderkey * 7919) % 89 ELSE 30 END) * 86400 AS DOUBLE) AS label_available_at
  FROM orders)"""
_TIED = _EVENTS.replace("tx AS (", "tx0 AS (") + """,
tx AS (SELECT * REPLACE (CAST(CAST(card_id AS BIGINT) % 5 AS VARCHAR) AS card_id, CAST(floor(TransactionDT / 3600) * 3600 AS BIGINT) AS TransactionDT) FROM tx0)"""

_MOMENTS = """CAST({s} AS DOUBLE) / 100.0::DOUBLE / nullif({n}, 0) AS {mean},
  CASE WHEN {n} > 1 THEN sqrt(CAST({n} * {q} - {s} * {s} AS DOUBLE) / CAST({n} * ({n} - 1) AS DOUBLE)) / 100.0::DOUBLE END AS {std}"""


def _pit_sql(source: str, instant: bool = False) -> str:
    back = lambda s: f"OVER (PARTITION BY card_id ORDER BY TransactionDT RANGE BETWEEN {s} PRECEDING AND 1 PRECEDING)"
    every = back("UNBOUNDED")
    arrival = "TransactionDT + 1.0" if instant else "label_available_at"
    whole = _MOMENTS.format(n="n", s="s", q="q", mean="card_amt_mean_all", std="card_amt_std_all")
    return f"""
WITH {source},
win AS (
  SELECT TransactionID, TransactionDT, TransactionAmt, card_id,
    count(*) {back(3600)} AS card_cnt_1h, count(*) {back(86400)} AS card_cnt_24h, count(*) {back(604800)} AS card_cnt_7d,
    CAST(coalesce(sum(cents) {back(86400)}, 0) AS DOUBLE) / 100.0::DOUBLE AS card_amt_sum_24h,
    CAST(coalesce(sum(cents) {back(604800)}, 0) AS DOUBLE) / 100.0::DOUBLE AS card_amt_sum_7d,
    count(*) {every} AS n, CAST(sum(cents) {every} AS HUGEINT) AS s, CAST(sum(cents * cents) {every} AS HUGEINT) AS q,
    min(TransactionDT) {every} AS card_first_t, max(TransactionDT) {every} AS card_last_t
  FROM tx),
ev AS (
  SELECT card_id, CAST({arrival} AS DOUBLE) AS moment, 0 AS kind, isFraud AS fraud, NULL::BIGINT AS id FROM tx
  UNION ALL SELECT card_id, CAST(TransactionDT AS DOUBLE), 1, 0, TransactionID FROM tx),
run AS (
  SELECT id, kind, CAST(sum(1 - kind) OVER w AS BIGINT) AS card_labeled_cnt, CAST(sum(fraud) OVER w AS BIGINT) AS card_fraud_cnt
  FROM ev WINDOW w AS (PARTITION BY card_id ORDER BY moment, kind ROWS UNBOUNDED PRECEDING)),
raw AS (
  SELECT win.* EXCLUDE (n, s, q), n AS card_cnt_all, {whole}, card_labeled_cnt, card_fraud_cnt
  FROM win JOIN run ON run.id = win.TransactionID AND run.kind = 1),
feat AS (
  SELECT *, TransactionDT - card_last_t AS secs_since_last_tx, TransactionDT - card_first_t AS card_age_s,
         TransactionAmt / nullif(card_amt_mean_all, 0) AS amt_vs_card_mean,
         CAST(card_fraud_cnt AS DOUBLE) / nullif(card_labeled_cnt, 0) AS card_fraud_rate
  FROM raw)
"""


def _pit_query(name: str, columns: tuple[str, ...], source=tx, source_sql: str = _EVENTS, instant: bool = False) -> None:
    @query(name, _pit_sql(source_sql, instant) + f"SELECT {', '.join(columns)} FROM feat")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pit_features(source(spark, sf_dir), instant_labels=instant).select(*columns)


_RAW = ("card_cnt_1h", "card_cnt_24h", "card_cnt_7d", "card_amt_sum_24h", "card_amt_sum_7d", "card_cnt_all", "card_amt_mean_all", "card_amt_std_all", "card_first_t", "card_last_t", "card_labeled_cnt", "card_fraud_cnt")
_FULL = ("TransactionID", *_RAW, "secs_since_last_tx", "card_age_s", "amt_vs_card_mean", "card_fraud_rate")
_pit_query("pit_features_full", _FULL)
_pit_query("pit_counts", ("TransactionID", "card_cnt_1h", "card_cnt_24h", "card_cnt_7d"))
_pit_query("pit_amount_sums", ("TransactionID", "card_amt_sum_24h", "card_amt_sum_7d"))
_pit_query("pit_all_history", ("TransactionID", "card_cnt_all", "card_amt_mean_all", "card_amt_std_all"))
_pit_query("pit_first_last", ("TransactionID", "card_first_t", "card_last_t"))
_pit_query("pit_label_counts", ("TransactionID", "card_labeled_cnt", "card_fraud_cnt"))
_pit_query("pit_derived", ("TransactionID", "secs_since_last_tx", "card_age_s", "amt_vs_card_mean", "card_fraud_rate"))
_pit_query("pit_orders_ties", _FULL, order_tx, _ORDERS)
_pit_query("pit_hourly_ties", _FULL, tied_tx, _TIED)
_pit_query("pit_instant_labels", ("TransactionID", "card_labeled_cnt", "card_fraud_cnt", "card_fraud_rate"), instant=True)


@query("tx_view", f"WITH {_EVENTS} SELECT * FROM tx")
def tx_view(spark, sf_dir):
    return tx(spark, sf_dir).select(*TX_COLUMNS)


@query(
    "pit_asof_theta_crosscheck",
    f"""WITH {_EVENTS} SELECT a.TransactionID, count(b.TransactionID) AS card_labeled_cnt, CAST(coalesce(sum(b.isFraud), 0) AS BIGINT) AS card_fraud_cnt
FROM tx a LEFT JOIN tx b ON a.card_id = b.card_id AND b.label_available_at <= a.TransactionDT GROUP BY a.TransactionID""",
)
def pit_asof_theta_crosscheck(spark, sf_dir):
    return labels_by_bands(tx(spark, sf_dir))


@query(
    "window_join_six_hours",
    f"""WITH {_EVENTS} SELECT a.TransactionID, b.TransactionID AS right_TransactionID, CAST(a.TransactionDT - b.TransactionDT AS BIGINT) AS gap_s
FROM tx a LEFT JOIN tx b ON a.card_id = b.card_id AND b.TransactionDT BETWEEN a.TransactionDT - 21600 AND a.TransactionDT AND b.isFraud = 1""",
)
def window_join_six_hours(spark, sf_dir):
    """Each transaction with the frauds of its card in the six hours up to it."""
    rows = tx(spark, sf_dir).select("TransactionID", "TransactionDT", "card_id", "isFraud")
    pairs = window_join(rows.drop("isFraud"), rows.where("isFraud = 1"), "card_id", "TransactionDT", "TransactionDT", 21_600, "left")
    return pairs.select("TransactionID", "right_TransactionID", (F.col("TransactionDT") - F.col("right_TransactionDT")).alias("gap_s"))


@query(
    "card_id_build",
    """SELECT o_orderkey AS TransactionID, concat_ws('|', CAST(o_custkey AS VARCHAR), coalesce(nullif(o_orderstatus, 'F'), ''), o_orderpriority,
  coalesce(CAST(CAST(floor(date_diff('second', TIMESTAMP '1995-01-01', o_orderdate) / 86400.0::DOUBLE - nullif(o_orderkey % 7, 0)) AS INTEGER) AS VARCHAR), '')) AS card_id FROM orders""",
)
def card_id_build(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    t = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1995-01-01 00:00:00', o_orderdate)")
    parts = (F.col("o_custkey"), F.expr("nullif(o_orderstatus, 'F')"), F.col("o_orderpriority"))
    return orders.select(F.col("o_orderkey").alias("TransactionID"), card_id(parts, t, F.expr("nullif(o_orderkey % 7, 0)")).alias("card_id"))


_AT = "(SELECT list_sort(list(TransactionDT))[CAST(floor(count(*) * {s}::DOUBLE) AS BIGINT) + 1] FROM tx)"
_CUTS = f"cuts AS (SELECT {_AT.format(s=0.70)} AS valid_from, {_AT.format(s=0.70 + 0.15)} AS holdout_from)"
_PERIODS = f"{_CUTS}, per AS (SELECT tx.*, CASE WHEN TransactionDT < valid_from THEN 'train' WHEN TransactionDT < holdout_from THEN 'valid' ELSE 'holdout' END AS period FROM tx, cuts)"


@query("period_cutoffs", f"WITH {_ORDERS}, {_CUTS} SELECT * FROM cuts")
def period_cutoffs(spark, sf_dir):
    return dataset.period_cutoffs(order_tx(spark, sf_dir))


@query("assign_period", f"WITH {_ORDERS}, {_PERIODS} SELECT TransactionID, TransactionDT, period FROM per")
def assign_period(spark, sf_dir):
    return dataset.assign_period(order_tx(spark, sf_dir)).select("TransactionID", "TransactionDT", "period")


@query(
    "period_summary",
    f"""WITH {_ORDERS}, {_PERIODS} SELECT period, count(*) AS rows, round(min(TransactionDT) / 86400.0::DOUBLE, 1) AS from_day, round(max(TransactionDT) / 86400.0::DOUBLE, 1) AS to_day,
  CAST(sum(isFraud) AS BIGINT) AS frauds, round(100.0::DOUBLE * CAST(sum(isFraud) AS DOUBLE) / count(isFraud), 2) AS fraud_pct FROM per GROUP BY period""",
)
def period_summary(spark, sf_dir):
    return dataset.period_summary(dataset.assign_period(order_tx(spark, sf_dir)))


@query("label_available_at", f"WITH {_ORDERS} SELECT TransactionID, label_available_at, (label_available_at - TransactionDT) / 86400.0::DOUBLE AS delay_days FROM tx")
def label_available_at(spark, sf_dir):
    delay = (F.col("label_available_at") - F.col("TransactionDT")) / F.lit(86400.0)
    return order_tx(spark, sf_dir).select("TransactionID", "label_available_at", delay.alias("delay_days"))


@query("identity_left_join", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def identity_left_join(spark, sf_dir):
    left, right = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return dataset.join_one_to_one(left, right, "doc_id")


_LEAKY_SQL = f"""WITH {_EVENTS},
per AS (SELECT card_id, count(*) AS n, CAST(sum(cents) AS HUGEINT) AS s, CAST(sum(cents * cents) AS HUGEINT) AS q, CAST(sum(isFraud) AS BIGINT) AS f FROM tx GROUP BY card_id),
agg AS (SELECT card_id, n AS card_tx_count, {_MOMENTS.format(n="n", s="s", q="q", mean="card_amt_mean", std="card_amt_std")}, f AS card_fraud_count, CAST(f AS DOUBLE) / n AS card_fraud_rate FROM per)
"""


@query("leaky_card_aggs", _LEAKY_SQL + "SELECT TransactionID, card_tx_count, card_amt_mean, card_amt_std, TransactionAmt / nullif(card_amt_mean, 0) AS amt_vs_card_mean FROM tx JOIN agg USING (card_id)")
def leaky_card_aggs(spark, sf_dir):
    return leaky.global_aggregates(tx(spark, sf_dir)).select("TransactionID", *leaky.GLOBAL_AGGREGATES)


@query("leaky_target_encoding", _LEAKY_SQL + "SELECT TransactionID, card_fraud_rate, card_fraud_count FROM tx JOIN agg USING (card_id)")
def leaky_target_encoding(spark, sf_dir):
    return leaky.target_encoding(tx(spark, sf_dir)).select("TransactionID", *leaky.TARGET_ENCODING)


_UP_TO = "OVER (PARTITION BY card_id ORDER BY TransactionDT RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "naive_serving",
    _pit_sql(_EVENTS)
    + f""", tot AS (
  SELECT TransactionID AS id, count(*) {_UP_TO} AS n, CAST(sum(cents) {_UP_TO} AS HUGEINT) AS s, CAST(sum(cents * cents) {_UP_TO} AS HUGEINT) AS q, cents AS c FROM tx),
own AS (SELECT id, 1 + coalesce(n, 0) AS n, coalesce(s, 0) + c AS s, coalesce(q, 0) + c * c AS q FROM tot),
now AS (SELECT feat.*, own.n, {_MOMENTS.format(n="own.n", s="s", q="q", mean="mean", std="std")} FROM feat JOIN own ON own.id = feat.TransactionID)
SELECT TransactionID, n AS card_tx_count, mean AS card_amt_mean, std AS card_amt_std, TransactionAmt / nullif(mean, 0) AS amt_vs_card_mean,
  CAST(card_fraud_cnt AS DOUBLE) / nullif(card_labeled_cnt, 0) AS card_fraud_rate, card_fraud_cnt AS card_fraud_count FROM now""",
)
def naive_serving(spark, sf_dir):
    out = leaky.served_aggregates(pit_features(tx(spark, sf_dir), sums=True))
    return out.select("TransactionID", *leaky.GLOBAL_AGGREGATES, *leaky.TARGET_ENCODING)


@query(
    "event_stream_order",
    f"""WITH {_EVENTS}, ev AS (SELECT label_available_at AS t, 0 AS kind, TransactionID AS txid, card_id FROM tx UNION ALL SELECT CAST(TransactionDT AS DOUBLE), 1, TransactionID, card_id FROM tx)
SELECT kind, t, txid, card_id, row_number() OVER (PARTITION BY card_id ORDER BY t, kind, txid) AS position FROM ev""",
)
def event_stream_order(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("card_id").orderBy("t", "kind", "txid"))
    return online.build_events(tx(spark, sf_dir)).select("kind", "t", "txid", "card_id", place.cast("bigint").alias("position"))


@query(
    "event_range_split",
    f"""WITH {_EVENTS}, ev AS (SELECT label_available_at AS t, 0 AS kind FROM tx UNION ALL SELECT CAST(TransactionDT AS DOUBLE), 1 FROM tx)
SELECT kind, CAST(sum(CAST(t < 1728000 AS INTEGER)) AS BIGINT) AS history, CAST(sum(CAST(t >= 1728000 AS INTEGER)) AS BIGINT) AS live FROM ev GROUP BY kind""",
)
def event_range_split(spark, sf_dir):
    start, rows = 20 * 86_400.0, tx(spark, sf_dir)
    parts = [online.build_events(rows, end=start).select("kind", F.lit(1).alias("h")), online.build_events(rows, start=start).select("kind", F.lit(0).alias("h"))]
    return parts[0].unionByName(parts[1]).groupBy("kind").agg(F.sum("h").alias("history"), F.sum(1 - F.col("h")).alias("live"))


@query("mature_rows", f"WITH {_ORDERS}, {_PERIODS} SELECT TransactionID FROM per WHERE period = 'train' AND label_available_at <= (SELECT min(TransactionDT) FROM per WHERE period = 'valid')")
def mature_rows(spark, sf_dir):
    rows = dataset.assign_period(order_tx(spark, sf_dir))
    cutoff = rows.where("period = 'valid'").agg(F.min("TransactionDT").alias("cutoff"))
    return dataset.mature(rows, "train", cutoff).select("TransactionID")


@query(
    "time_ordered_split",
    f"""WITH {_ORDERS} SELECT TransactionID, CASE WHEN row_number() OVER (ORDER BY TransactionDT, TransactionID) <= floor(count(*) OVER () * {1 - dataset.STOP_SHARE}::DOUBLE) THEN 'train' ELSE 'stop' END AS part FROM tx""",
)
def time_ordered_split(spark, sf_dir):
    return dataset.time_ordered_split(order_tx(spark, sf_dir)).select("TransactionID", "part")


@query(
    "row_index_hot_second",
    f"""WITH {_ORDERS}, m AS (SELECT TransactionID, CASE WHEN TransactionID % 2 = 0 THEN 86400 ELSE TransactionDT END AS moment FROM tx)
SELECT TransactionID, row_number() OVER (ORDER BY moment, TransactionID) - 1 AS position FROM m""",
)
def row_index_hot_second(spark, sf_dir):
    """Positions in (time, id) order where one second holds half of all rows; parts of 1,000 rows, to split it at any size."""
    moved = order_tx(spark, sf_dir).withColumn("TransactionDT", F.when(F.col("TransactionID") % 2 == 0, F.lit(86_400)).otherwise(F.col("TransactionDT")))
    return row_index(moved.select("TransactionID", "TransactionDT"), "TransactionDT", "TransactionID", per_task=1_000).select("TransactionID", "position")


@query(
    "random_split_exact",
    f"""WITH {_EVENTS}, r AS (SELECT TransactionID, row_number() OVER (ORDER BY md5(CAST(TransactionID AS VARCHAR) || ':42'), TransactionID) AS k, count(*) OVER () AS n FROM tx)
SELECT TransactionID, CASE WHEN k <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.85::DOUBLE) THEN 'stop' ELSE 'test' END AS part FROM r""",
)
def random_split_exact(spark, sf_dir):
    return dataset.random_split(tx(spark, sf_dir)).select("TransactionID", "part")


_LIVE = "TransactionID IN (SELECT doc_id FROM labels WHERE toxic = 0)"


@query("semi_live_ids", f"WITH {_EVENTS} SELECT TransactionID, card_id FROM tx WHERE {_LIVE}")
def semi_live_ids(spark, sf_dir):
    live = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("TransactionID"))
    return tx(spark, sf_dir).select("TransactionID", "card_id").join(live, "TransactionID", "left_semi")


@query("anti_live_ids", f"WITH {_EVENTS} SELECT TransactionID, card_id FROM tx WHERE NOT {_LIVE}")
def anti_live_ids(spark, sf_dir):
    live = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("TransactionID"))
    return tx(spark, sf_dir).select("TransactionID", "card_id").join(live, "TransactionID", "left_anti")


@query(
    "feature_parity_report",
    _pit_sql(_EVENTS)
    + f""", b AS (SELECT count(*) AS n, CAST(sum(CAST(TransactionID % 1000 = 7 AS INTEGER)) AS BIGINT) AS bad FROM feat)
SELECT f AS feature, n AS rows, CASE WHEN f IN ('*', 'card_cnt_24h') THEN bad ELSE 0 END AS mismatches, CASE WHEN f IN ('*', 'card_cnt_24h') AND bad > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS max_abs_diff
FROM b, (SELECT unnest(['*', {", ".join(f"'{f}'" for f in parity.FEATURES)}]) AS f)""",
)
def feature_parity_report(spark, sf_dir):
    """One feature is put off by one in some rows; the report finds exactly those."""
    right = pit_features(tx(spark, sf_dir))
    off = right.withColumn("card_cnt_24h", F.col("card_cnt_24h") + F.when(F.col("TransactionID") % 1000 == 7, 1).otherwise(0))
    return parity.compare_features(off, right)


_SCORE = "CAST((TransactionID * 7919) % 997 AS DOUBLE) / 997.0::DOUBLE AS score"
_SCORED = f"{_EVENTS}, sc AS (SELECT *, {_SCORE} FROM tx)"
_PER = "p AS (SELECT score, count(*) AS n, CAST(sum(isFraud) AS BIGINT) AS pos, CAST(sum(CASE WHEN isFraud = 1 THEN cents ELSE 0 END) AS BIGINT) AS c FROM {src} GROUP BY score)"
_CURVE = """{p}, {t}t AS (SELECT CAST(sum(n) AS BIGINT) AS N_, CAST(sum(pos) AS BIGINT) AS P_, CAST(sum(c) AS BIGINT) AS C_ FROM {t}p),
{t}below AS (SELECT score, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS nb, CAST(coalesce(sum(pos) OVER w, 0) AS BIGINT) AS pb, CAST(coalesce(sum(c) OVER w, 0) AS BIGINT) AS cb
  FROM {t}p WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) UNION ALL SELECT 'inf'::DOUBLE, N_, P_, C_ FROM {t}t),
{t}curve AS (SELECT score AS threshold, N_ - nb AS alerts, CAST(cb AS DOUBLE) / 100.0::DOUBLE + 5.0::DOUBLE * (N_ - nb) AS cost,
  1 - CAST(pb + (N_ - nb) - (P_ - pb) AS DOUBLE) / N_ AS accuracy FROM {t}below, {t}t)"""


def _curve_sql(src: str = "sc", tag: str = "") -> str:
    return _CURVE.format(p=tag + _PER.format(src=src), t=tag)


@query("cost_curve", f"WITH {_SCORED}, {_curve_sql()} SELECT * FROM curve")
def cost_curve(spark, sf_dir):
    return decide.cost_curve(scored(tx(spark, sf_dir)))


@query("choose_threshold_cost", f"WITH {_SCORED}, {_curve_sql()} SELECT * FROM curve ORDER BY cost, threshold LIMIT 1")
def choose_threshold_cost(spark, sf_dir):
    return decide.choose(decide.cost_curve(scored(tx(spark, sf_dir))), "cost")


@query("choose_threshold_accuracy", f"WITH {_SCORED}, {_curve_sql()} SELECT * FROM curve ORDER BY accuracy DESC, threshold LIMIT 1")
def choose_threshold_accuracy(spark, sf_dir):
    return decide.choose(decide.cost_curve(scored(tx(spark, sf_dir))), "accuracy")


def _evaluate_sql(rows: str, policies: str) -> str:
    """Halves are rounded to even, as round_even does."""
    a, f = "(score >= threshold)", "(isFraud = 1)"
    count = lambda c: f"CAST(sum(CAST({c} AS INTEGER)) AS BIGINT)"
    amount = lambda c: f"CAST(sum(CASE WHEN {c} THEN cents ELSE 0 END) AS DOUBLE) / 100.0::DOUBLE"
    ratio = lambda x, y: f"round_even(CAST({x} AS DOUBLE) / nullif({y}, 0), 4)"
    missed = amount(f"{f} AND NOT {a}")
    cost = f"({missed} + 5.0::DOUBLE * {count(a)})"
    return f"""SELECT policy, CASE WHEN threshold < 'inf'::DOUBLE THEN round_even(threshold, 4) END AS threshold, {count(a)} AS alerts, {ratio(count(a), "count(*)")} AS alert_rate,
  {ratio(count(f"{a} AND {f}"), count(a))} AS precision, {ratio(count(f"{a} AND {f}"), count(f))} AS recall, CAST(round_even({amount(f"{f} AND {a}")}, 0) AS BIGINT) AS fraud_caught_amt,
  CAST(round_even({missed}, 0) AS BIGINT) AS fraud_missed_amt, CAST(round_even(5.0::DOUBLE * {count(a)}, 0) AS BIGINT) AS review_cost, CAST(round_even({cost}, 0) AS BIGINT) AS total_cost,
  round_even({cost} / count(*) * 1000, 1) AS cost_per_1k_tx
FROM {rows}, {policies} GROUP BY policy, threshold"""


@query("evaluate_policy", f"WITH {_SCORED}, pol(policy, threshold) AS (VALUES ('low', 0.2::DOUBLE), ('high', 0.9::DOUBLE), ('never', 'inf'::DOUBLE)) " + _evaluate_sql("sc", "pol"))
def evaluate_policy(spark, sf_dir):
    policies = spark.createDataFrame([("low", 0.2), ("high", 0.9), ("never", float("inf"))], "policy string, threshold double")
    return decide.evaluate(scored(tx(spark, sf_dir)), policies)


_HALVES = f"""{_EVENTS}, sc AS (SELECT *, {_SCORE}, CAST((TransactionID * 104729) % 991 AS DOUBLE) / 991.0::DOUBLE AS score2 FROM tx),
honest AS (SELECT score, isFraud, cents FROM sc WHERE TransactionDT < 1296000), careless AS (SELECT score2 AS score, isFraud, cents FROM sc WHERE TransactionDT < 1296000),
live_h AS (SELECT score, isFraud, cents FROM sc WHERE TransactionDT >= 1296000), live_n AS (SELECT score2 AS score, isFraud, cents FROM sc WHERE TransactionDT >= 1296000)"""
_PICK = "SELECT '{name}' AS policy, threshold FROM (SELECT * FROM {tag}curve ORDER BY {by}, threshold LIMIT 1)"


def _policies_sql() -> str:
    curves = ",\n".join(_curve_sql(src, tag) for src, tag in (("honest", "h_"), ("careless", "n_"), ("live_h", "lh_"), ("live_n", "ln_")))
    h = [_PICK.format(name="honest_accuracy_threshold", tag="h_", by="accuracy DESC"), _PICK.format(name="honest_cost_threshold", tag="h_", by="cost")]
    n = [_PICK.format(name="naive_cost_threshold", tag="n_", by="cost")]
    return f"""WITH {_HALVES}, {curves},
hp AS ({" UNION ALL ".join(h)}), np AS ({n[0]}),
hl AS (SELECT 'no_model' AS policy, 'inf'::DOUBLE AS threshold UNION ALL SELECT * FROM hp UNION ALL {_PICK.format(name="honest_hindsight", tag="lh_", by="cost")}),
nl AS (SELECT * FROM np UNION ALL {_PICK.format(name="naive_hindsight", tag="ln_", by="cost")}),
he AS ({_evaluate_sql("live_h", "hl")}), ne AS ({_evaluate_sql("live_n", "nl")}), hs AS ({_evaluate_sql("honest", "hp")}), ns AS ({_evaluate_sql("careless", "np")})
SELECT e.*, s.cost_per_1k_tx AS promised_cost_per_1k_tx
FROM (SELECT * FROM he UNION ALL SELECT * FROM ne) e LEFT JOIN (SELECT * FROM hs UNION ALL SELECT * FROM ns) s USING (policy)"""


@query("policy_table", _policies_sql())
def policy_table(spark, sf_dir):
    rows = scored(tx(spark, sf_dir)).withColumn("score2", ((F.col("TransactionID") * 104729) % 991) / F.lit(991.0))
    before, after = rows.where("TransactionDT < 1296000"), rows.where("TransactionDT >= 1296000")
    careless = before.select(F.col("score2").alias("score"), "isFraud", "cents")
    live = after.select("isFraud", "cents", F.col("score").alias("score_honest"), F.col("score2").alias("score_naive"))
    return decide.policy_table(before.select("score", "isFraud", "cents"), careless, live)


@query(
    "roc_auc",
    f"""WITH {_SCORED}, {_PER.format(src="sc")}, r AS (SELECT *, n - pos AS neg, coalesce(sum(n - pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM p)
SELECT round_even(CAST(sum(pos * (2 * nb + neg)) AS DOUBLE) / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) * 2, 0), 4) AS roc_auc FROM r""",
)
def roc_auc(spark, sf_dir):
    return decide.roc_auc(scored(tx(spark, sf_dir)))


@query(
    "average_precision",
    f"""WITH {_SCORED}, {_PER.format(src="sc")}, r AS (SELECT *, sum(n) OVER w AS na, sum(pos) OVER w AS pa FROM p WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round_even(sum(CAST(pos * pa AS DOUBLE) / na) / CAST(nullif(sum(pos), 0) AS DOUBLE), 4) AS pr_auc FROM r""",
)
def average_precision(spark, sf_dir):
    return decide.average_precision(scored(tx(spark, sf_dir)))


def _psi_sql(numeric: dict[str, str], categorical: dict[str, str], halves: str) -> str:
    """``numeric`` and ``categorical``: feature -> expression over the view ``h`` (with is_ref)."""
    parts = []
    for f, e in numeric.items():
        edges = f"(SELECT list_sort(list_distinct(quantile_cont({e}, [{', '.join(f'{(i + 1) / 10}' for i in range(9))}]))) FROM h WHERE is_ref)"
        parts.append(f"SELECT '{f}' AS feature, CAST(CASE WHEN x IS NULL THEN 0 ELSE len(list_filter(edges, lambda e: e <= x)) + 1 END AS VARCHAR) AS bin, is_ref FROM (SELECT {e} AS x, is_ref, {edges} AS edges FROM h)")
    for f, e in categorical.items():
        parts.append(f"SELECT '{f}' AS feature, coalesce({e}, '<missing>') AS bin, is_ref FROM h")
    return f"""WITH h AS ({halves}), b AS ({" UNION ALL ".join(parts)}),
c AS (SELECT feature, bin, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM b GROUP BY feature, bin),
s AS (SELECT feature, greatest(CAST(r AS DOUBLE) / sum(r) OVER w, 1e-4::DOUBLE) AS p, greatest(CAST(c AS DOUBLE) / sum(c) OVER w, 1e-4::DOUBLE) AS q FROM c WINDOW w AS (PARTITION BY feature)),
rep AS (SELECT feature, round_even(sum((q - p) * ln(q / p)), 4) AS psi FROM s GROUP BY feature)
"""


_LEVEL = "SELECT feature, psi, CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS level FROM rep"
_EVENT_HALVES = "SELECT *, ts < TIMESTAMP '2024-01-16' AS is_ref FROM events"
_ORDER_HALVES = "SELECT *, o_orderdate < TIMESTAMP '1998-01-01' AS is_ref FROM orders"


def _halves(df: DataFrame, condition: str) -> tuple[DataFrame, DataFrame]:
    return df.where(condition), df.where(f"not ({condition})")


@query("psi_numeric", _psi_sql({"value": "value"}, {}, _EVENT_HALVES) + _LEVEL)
def psi_numeric(spark, sf_dir):
    ref, cur = _halves(table(spark, sf_dir, "events"), "ts < TIMESTAMP_NTZ'2024-01-16 00:00:00'")
    return monitor.drift_report(ref, cur, ("value",))


@query("psi_categorical", _psi_sql({}, {"o_orderpriority": "o_orderpriority", "o_orderstatus": "nullif(o_orderstatus, 'P')"}, _ORDER_HALVES) + _LEVEL)
def psi_categorical(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    ref, cur = _halves(orders, "o_orderdate < TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    return monitor.drift_report(ref, cur, (), ("o_orderpriority", "o_orderstatus"))


_DRIFT_SQL = _psi_sql({"value": "value", "hour": "CAST(hour(ts) AS DOUBLE)", "user_id": "CAST(nullif(user_id % 50, 7) AS DOUBLE)"}, {"event_type": "event_type"}, _EVENT_HALVES)


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts").cast("double"))
    events = events.withColumn("user_id", F.expr("nullif(user_id % 50, 7)").cast("double"))
    ref, cur = _halves(events, "ts < TIMESTAMP_NTZ'2024-01-16 00:00:00'")
    return monitor.drift_report(ref, cur, ("value", "hour", "user_id"), ("event_type",))


@query("drift_report", _DRIFT_SQL + _LEVEL)
def drift_report(spark, sf_dir):
    return _drift(spark, sf_dir)


@query("topk_features", _DRIFT_SQL + _LEVEL + " ORDER BY psi DESC, feature LIMIT 3")
def topk_features(spark, sf_dir):
    return _drift(spark, sf_dir).orderBy(F.col("psi").desc(), "feature").limit(3)


@query("drift_levels", _DRIFT_SQL + f"SELECT level, count(*) AS features FROM ({_LEVEL}) GROUP BY level")
def drift_levels(spark, sf_dir):
    return monitor.level_counts(_drift(spark, sf_dir))


@query(
    "daily_report",
    f"""WITH {_SCORED}, f AS (SELECT *, CAST(floor((TransactionDT - (SELECT min(TransactionDT) FROM sc)) / 86400.0::DOUBLE) AS BIGINT) AS day, score >= 0.7 AS a, isFraud = 1 AS fr,
  label_available_at <= (SELECT max(TransactionDT) FROM sc) AS k FROM sc),
g AS (SELECT day, count(*) AS n, count(*) FILTER (a) AS a, count(*) FILTER (fr) AS f, count(*) FILTER (a AND fr) AS c, count(*) FILTER (k) AS k, count(*) FILTER (fr AND k) AS fk, count(*) FILTER (a AND fr AND k) AS ck FROM f GROUP BY day)
SELECT day, n AS transactions, a AS alerts, f AS fraud, round_even(CAST(c AS DOUBLE) / nullif(a, 0), 3) AS precision, round_even(CAST(c AS DOUBLE) / nullif(f, 0), 3) AS recall,
  round_even(CAST(k AS DOUBLE) / n, 3) AS labels_known, fk AS fraud_known, round_even(CAST(ck AS DOUBLE) / nullif(fk, 0), 3) AS recall_known FROM g""",
)
def daily_report(spark, sf_dir):
    rows = scored(tx(spark, sf_dir))
    return monitor.daily_report(rows, 0.7, rows.agg(F.max("TransactionDT").alias("as_of")))


@query("latency_percentiles", "SELECT round_even(quantile_cont(value, 0.5), 2) AS p50, round_even(quantile_cont(value, 0.95), 2) AS p95, round_even(quantile_cont(value, 0.99), 2) AS p99 FROM events")
def latency_percentiles(spark, sf_dir):
    out = exact_quantiles(table(spark, sf_dir, "events"), "value", (0.5, 0.95, 0.99))
    return out.select(*(F.bround(F.col("quantiles")[i], 2).alias(n) for i, n in enumerate(("p50", "p95", "p99"))))


@query(
    "latency_by_type",
    """SELECT event_type, count(value) AS n, round_even(quantile_cont(value, 0.5), 6) AS p50, round_even(quantile_cont(value, 0.95), 6) AS p95, round_even(quantile_cont(value, 0.99), 6) AS p99
FROM events WHERE value IS NOT NULL GROUP BY event_type""",
)
def latency_by_type(spark, sf_dir):
    out = exact_quantiles(table(spark, sf_dir, "events"), "value", (0.5, 0.95, 0.99), ("event_type",))
    return out.select("event_type", "n", *(F.bround(F.col("quantiles")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))))


@query(
    "unpivot_report",
    f"""WITH {_ORDERS}, {_PERIODS}, s AS (SELECT period, count(*) AS rows, CAST(sum(isFraud) AS BIGINT) AS frauds FROM per GROUP BY period)
SELECT period, 'rows' AS measure, rows AS amount FROM s UNION ALL SELECT period, 'frauds', frauds FROM s""",
)
def unpivot_report(spark, sf_dir):
    summary = dataset.period_summary(dataset.assign_period(order_tx(spark, sf_dir)))
    return summary.unpivot(["period"], ["rows", "frauds"], "measure", "amount")


@query("recode_labels", "SELECT event_id, CASE event_type WHEN 'error' THEN 'fraud' WHEN 'purchase' THEN 'sale' END AS mapped, CASE event_type WHEN 'error' THEN 'fraud' WHEN 'purchase' THEN 'sale' ELSE event_type END AS replaced FROM events")
def recode_labels(spark, sf_dir):
    names = F.create_map(F.lit("error"), F.lit("fraud"), F.lit("purchase"), F.lit("sale"))
    mapped = F.try_element_at(names, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", mapped.alias("mapped"), F.coalesce(mapped, "event_type").alias("replaced"))


@query(
    "event_json_roundtrip",
    f"""WITH {_EVENTS}, ev AS (SELECT label_available_at AS t, 0 AS kind, TransactionID AS txid, card_id, NULL::BIGINT AS cents, isFraud AS is_fraud FROM tx
UNION ALL SELECT CAST(TransactionDT AS DOUBLE), 1, TransactionID, card_id, cents, NULL FROM tx) SELECT kind, t, card_id, txid, cents, is_fraud FROM ev""",
)
def event_json_roundtrip(spark, sf_dir):
    from ..streaming.kafka import from_messages, to_messages

    return from_messages(to_messages(online.build_events(tx(spark, sf_dir)))).drop("seed")


@query("instant_vs_delayed_labels", _pit_sql(_EVENTS, True) + ", late AS (" + _pit_sql(_EVENTS).strip() + " SELECT TransactionID, card_labeled_cnt FROM feat)\nSELECT count(*) AS rows, CAST(sum(CAST(feat.card_labeled_cnt > late.card_labeled_cnt AS INTEGER)) AS BIGINT) AS sees_more FROM feat JOIN late USING (TransactionID)")
def instant_vs_delayed_labels(spark, sf_dir):
    rows = tx(spark, sf_dir)
    now = pit_features(rows, instant_labels=True).select("TransactionID", F.col("card_labeled_cnt").alias("now"))
    late = pit_features(rows).select("TransactionID", F.col("card_labeled_cnt").alias("late"))
    return now.join(late, "TransactionID").agg(F.count("*").alias("rows"), F.sum((F.col("now") > F.col("late")).cast("bigint")).alias("sees_more"))


@query("drop_null_rows", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IS NOT NULL AND l.quality IS NOT NULL")
def drop_null_rows(spark, sf_dir):
    return identity_left_join(spark, sf_dir).select("doc_id", "lang", "quality").na.drop()


@query("inner_one_to_one", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def inner_one_to_one(spark, sf_dir):
    left, right = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return dataset.join_one_to_one(left, right, "doc_id", "inner")


@query("event_closed_range", f"""WITH {_EVENTS}, ev AS (SELECT label_available_at AS t, 0 AS kind, TransactionID AS txid FROM tx UNION ALL SELECT CAST(TransactionDT AS DOUBLE), 1, TransactionID FROM tx)
SELECT kind, txid FROM ev WHERE t BETWEEN (SELECT min(label_available_at) FROM tx) AND (SELECT max(TransactionDT) FROM tx)""")  # fmt: skip
def event_closed_range(spark, sf_dir):
    """Both ends are times of events, so a half-open range would lose one."""
    rows = tx(spark, sf_dir)
    low, high = rows.agg(F.min("label_available_at"), F.max("TransactionDT")).first()
    return online.build_events(rows, start=low, end=float(high), closed=True).select("kind", "txid")


@query("first_matching_policy", f"WITH {_SCORED}, {_curve_sql()} SELECT threshold, cost FROM curve WHERE alerts <= 0.1 * (SELECT count(*) FROM sc) ORDER BY threshold LIMIT 1")
def first_matching_policy(spark, sf_dir):
    """The first threshold that alerts a tenth of the rows at most."""
    rows = scored(tx(spark, sf_dir))
    curve = dataset.with_scalar(decide.cost_curve(rows), rows.agg(F.count("*").alias("n")))
    return curve.where(F.col("alerts") <= 0.1 * F.col("n")).orderBy("threshold").limit(1).select("threshold", "cost")


@query(
    "category_codes",
    f"""WITH {_ORDERS}, {_PERIODS}, p AS (SELECT per.TransactionID, period, CASE WHEN period = 'holdout' AND o_orderkey % 5 = 0 THEN 'new' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS c
  FROM per JOIN orders ON o_orderkey = TransactionID),
codes AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS code FROM p WHERE period = 'train' AND c IS NOT NULL GROUP BY c)
SELECT TransactionID, CAST(coalesce(code, (SELECT count(*) FROM codes)) AS DOUBLE) AS code FROM p LEFT JOIN codes USING (c)""",
)
def category_codes(spark, sf_dir):
    """Codes learned on the train period; a category seen later and null share the code after the last."""
    from .ladder import category_codes as learn

    periods = dataset.assign_period(order_tx(spark, sf_dir)).select("TransactionID", "period")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "TransactionID").select("TransactionID", "o_orderpriority")
    key = F.col("TransactionID")
    value = F.when((F.col("period") == "holdout") & (key % 5 == 0), "new").when(key % 7 != 0, F.col("o_orderpriority"))
    rows = periods.join(orders, "TransactionID").withColumn("c", value)
    return learn(rows.where("period = 'train'"), ("c",)).transform(rows).select("TransactionID", F.col("c_index").alias("code"))


@query(
    "dataset_build",
    f"""WITH {_ORDERS}, {_PERIODS} SELECT TransactionID, period, nullif(o_orderkey % 3, 0) AS device, isFraud = 1 AS may_vary, CASE WHEN isFraud = 0 THEN (TransactionDT + 30 * 86400)::DOUBLE END AS legit_known_at
FROM per JOIN orders ON o_orderkey = TransactionID""",
)
def dataset_build(spark, sf_dir):
    """Both files joined, periods cut and labels delayed; fraud's drawn delays are checked by bounds in the tests."""
    rows = order_tx(spark, sf_dir).drop("label_available_at")
    identity = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("TransactionID"), (F.col("o_orderkey") % 3).alias("device"))
    whole = dataset.build_dataset(rows, identity)
    return whole.select("TransactionID", "period", "device", (F.col("isFraud") == 1).alias("may_vary"), F.when(F.col("isFraud") == 0, F.col("label_available_at")).alias("legit_known_at"))


@query("csv_scan", "SELECT o_orderkey AS TransactionID, CAST(o_orderstatus = 'P' AS INTEGER) AS isFraud, nullif(o_totalprice, 0) AS TransactionAmt, NULL::DOUBLE AS dist1, nullif(o_orderstatus, 'F') AS card4 FROM orders")
def csv_scan(spark, sf_dir):
    """Columns by name from a CSV file that lacks some, its empty fields null."""
    from ..operators.scratch import shared_folder

    path = f"{shared_folder(spark)}/csv"
    rows = order_tx(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("TransactionID"), F.expr("nullif(o_orderstatus, 'F')").alias("card4")), "TransactionID")
    rows.select("card4", "TransactionID", "isFraud", "TransactionAmt").write.option("header", True).csv(path)
    return read_csv(spark, path, "TransactionID bigint, isFraud int, TransactionAmt double, dist1 double, card4 string")


@query("ordered_parquet", f"WITH {_ORDERS}, {_PERIODS} SELECT TransactionID, TransactionDT, row_number() OVER (ORDER BY TransactionDT, TransactionID) AS position FROM per WHERE period IN ('valid', 'holdout')")
def ordered_parquet(spark, sf_dir):
    """Written by period in time order and read by period; the position is that in the order read."""
    from ..operators.scratch import shared_folder

    path = f"{shared_folder(spark)}/ordered"
    write_ordered(dataset.assign_period(order_tx(spark, sf_dir)), path, ("period",))
    rows = read_periods(spark, path, ("valid", "holdout"), ("TransactionID", "TransactionDT"))
    within, part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), F.spark_partition_id()
    placed = rows.select("TransactionID", "TransactionDT", part.alias("part"), within.alias("within"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = sizes.select("part", before.alias("before"))
    return placed.join(F.broadcast(offsets), "part").select("TransactionID", "TransactionDT", (F.col("before") + F.col("within") + 1).alias("position"))


@query("report_roundtrip", f"WITH {_ORDERS}, {_PERIODS} SELECT period, count(*) AS rows, CASE WHEN period <> 'train' THEN CAST(sum(isFraud) AS BIGINT) END AS frauds FROM per GROUP BY period")
def report_roundtrip(spark, sf_dir):
    """A report written as JSON records, nulls included, and read again; a missing one is None."""
    from ..operators.scratch import shared_folder

    folder = shared_folder(spark)
    if read_report(spark, f"{folder}/none") is not None:
        raise ValueError("there is no such report")
    summary = dataset.period_summary(dataset.assign_period(order_tx(spark, sf_dir)))
    write_report(summary.select("period", "rows", F.expr("case when period <> 'train' then frauds end").alias("frauds")), f"{folder}/report")
    return read_report(spark, f"{folder}/report").select("period", "rows", "frauds")


from . import live  # noqa: E402  registers the streaming and model queries

LIVE_QUERIES = live.QUERIES
for _name, (_run, _sql) in LIVE_QUERIES.items():
    query(_name, _sql)(_run)
FEATURES = (*PIT_FEATURES, *LABEL_FEATURES)
