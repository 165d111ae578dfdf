"""What the scored sets shuffle and write: rows go by card once, and no row is joined to its own features."""

import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_operators import TX, random_tx

from tidemark.operators import dataset, leaky
from tidemark.operators.pit import pit_features
from tidemark.plans import boosting, ladder, registry

FEATURES = (*leaky.GLOBAL_AGGREGATES, *leaky.TARGET_ENCODING)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_set_joins_rows_to_their_features(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ladder, "saved", lambda df, keep=ladder.saved: plans.append(_plan(df)) or keep(df))
    ladder.scored_sets(spark.createDataFrame(random_tx(600, seed=4), TX), ("TransactionAmt",), trees=1)
    assert len(plans) == 7  # rows, start, what each model is fitted to, the three sets
    assert not [p for p in plans if re.search(r"Join Inner, \(.*TransactionID", p)]


def test_order_rows_are_not_joined_to_their_priority(spark):
    rows = registry.live._orders_with_base(spark, SF)
    assert "Join" not in _plan(rows) and rows.where("priority is null").count() == 0


@pytest.mark.parametrize("most_rows", [3, 20_000])
def test_totals_of_a_card_and_kept_columns_equal_the_joins(spark, most_rows):
    tx = spark.createDataFrame(random_tx(400, seed=7), TX).where("TransactionDT is not null")
    counted = F.col("TransactionID") % 3 != 0
    rows = pit_features(tx, keep=("isFraud", "cents"), per_card=leaky.card_totals(counted), most_rows=most_rows)
    got = leaky.from_totals(rows.where(counted)).select("TransactionID", "isFraud", "cents", *FEATURES)
    want = leaky.target_encoding(leaky.global_aggregates(tx.where(counted))).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_only_the_second_of_the_cut_is_put_in_order(spark):
    tx = spark.range(1_000).selectExpr("id as TransactionID", "id div 50 as TransactionDT")
    on_an_edge = dataset.time_ordered_split(tx)  # 850 rows are 17 whole seconds
    assert "Window" not in _plan(on_an_edge) and "Join" not in _plan(on_an_edge)
    for df, rows in ((tx, 850), (tx.where("TransactionID < 990"), 841), (tx.withColumn("TransactionDT", F.lit(5)), 850), (tx.limit(0), 0)):
        train = dataset.time_ordered_split(df).where("part = 'train'").agg(F.count("*"), F.max("TransactionID")).first()
        assert tuple(train) == (rows, rows - 1 if rows else None)


def test_only_prefixes_of_the_cuts_are_put_in_order(spark):
    tx = spark.range(3_001).selectExpr("id as TransactionID")
    out = dataset.random_split(tx)
    assert "Join" not in _plan(out)
    order = [r[0] for r in tx.orderBy(dataset.hash_order(F.col("TransactionID"), dataset.SEED)).collect()]
    parts = {r["TransactionID"]: r["part"] for r in out.collect()}
    assert [parts[i] for i in order] == ["train"] * 2_100 + ["stop"] * 450 + ["test"] * 451
    same = dataset.random_split(spark.range(100).selectExpr("7L as TransactionID"))  # one prefix holds both cuts
    assert dict(map(tuple, same.groupBy("part").count().collect())) == {"train": 70, "stop": 15, "test": 15}


def test_the_last_stage_writes_the_margins_of_stop_rows_alone(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(boosting, "saved", lambda df, keep=boosting.saved: sizes.append((df.count(), "features" in df.columns)) or keep(df))
    rows = spark.range(1_200).selectExpr("id as TransactionID", "id % 10 + 0.0D as x", "cast(id % 10 > 6 as int) as isFraud")
    ladder.fit(rows.where("TransactionID < 900"), rows.where("TransactionID >= 900"), ("x",), trees=20)
    assert sizes == [(1_200, True), (300, False)]


def _plain_psi(reference, current):
    """Deciles of the reference, missing values in a bin of their own; texts value by value."""
    if isinstance(next(v for v in reference if v is not None), str):
        keys = sorted({str(v) for v in (*reference, *current)})
        shares = [np.array([[str(v) for v in values].count(k) for k in keys]) / len(values) for values in (reference, current)]
    else:
        known = [float(v) for v in reference if v is not None]
        edges = np.unique(np.quantile(known, [(i + 1) / 10 for i in range(9)]))
        bins = lambda values: [0 if v is None else np.searchsorted(edges, float(v), side="right") + 1 for v in values]
        shares = [np.bincount(bins(values), minlength=len(edges) + 2) / len(values) for values in (reference, current)]
    p, q = (np.clip(s, 1e-4, None) for s in shares)
    return float(np.sum((q - p) * np.log(q / p)))


def test_score_drift_allows_every_round_and_has_every_input_of_the_model(spark, monkeypatch):
    allowed = []
    monkeypatch.setattr(boosting, "boost", lambda rows, so_far, rounds, *rest: allowed.append(rounds) or boosting.Boosted(0.0, [], [(0, None)]))
    gone = lambda c: F.when(F.col("TransactionID") % 7 > 0, F.col(c)).alias(c)
    tx = registry.live._orders_with_base(spark, SF).withColumns({c: gone(c) for c in ("TransactionAmt", "cents")})
    monkeypatch.setattr(registry.live, "_orders_with_base", lambda *_: tx)
    got = {r["feature"]: r["psi"] for r in registry.QUERIES["score_drift"](spark, SF).collect()}
    assert allowed == [boosting.MOST_ROUNDS]  # of the honest model, on which alone the drift depends
    inputs = ("TransactionAmt", "hour", "day", *ladder.PIT_FEATURES, *ladder.LABEL_FEATURES, "weekday", "priority")
    assert set(got) == {"score_honest", *inputs} and got["score_honest"] == 0
    rows = pit_features(dataset.assign_period(tx), keep=("period", "hour", "day", "weekday", "priority")).collect()
    holdout = [r for r in rows if r["period"] == "holdout"]
    until = min(r["TransactionDT"] for r in holdout) - dataset.LEGIT_DELAY * dataset.DAY
    selection = [r for r in rows if r["period"] == "valid" and r["TransactionDT"] <= until]
    assert any(r["TransactionAmt"] is None for r in selection)
    for c in inputs:
        assert got[c] == pytest.approx(_plain_psi([r[c] for r in selection], [r[c] for r in holdout]), abs=1e-4), c


def test_scored_policies_allow_both_models_every_round(spark, monkeypatch):
    allowed = []
    monkeypatch.setattr(boosting, "boost", lambda rows, so_far, rounds, *rest: allowed.append(rounds) or boosting.Boosted(0.0, [], [(0, None)]))
    assert registry.QUERIES["scored_policies"](spark, SF).count() == 6
    assert allowed == [boosting.MOST_ROUNDS] * 2
