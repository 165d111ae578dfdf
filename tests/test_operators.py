"""Operators on small made-up tables: defining examples, ties, nulls, empty tables."""

import math
import random

import pytest

from tidemark.functions.spec import HistoryFeature
from tidemark.operators import dataset, decide, leaky, monitor, parity, prefix
from tidemark.operators.pit import pit_features
from tidemark.sources import tables
from tidemark.streaming import online

TX = "TransactionID bigint, TransactionDT bigint, TransactionAmt double, cents bigint, card_id string, isFraud int, label_available_at double"
DAY = 86_400


def random_tx(n=400, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        t = 5_000 if 100 <= i < 110 else rng.randrange(40 * DAY)
        cents, fraud = rng.randrange(1, 50_000), int(rng.random() < 0.15)
        delay = rng.uniform(1, 19) * DAY if fraud else 30 * DAY
        rows.append((i, t, cents / 100, cents, None if i % 97 == 0 else f"c{rng.randrange(12)}", fraud, float(t + delay)))
    return rows


def brute_pit(rows):
    found = {}
    for i, t, amt, _, card, _, _ in rows:
        past = [r for r in rows if r[4] == card and r[1] <= t - 1]
        known = [r for r in rows if r[4] == card and r[6] <= t]
        cents = [r[3] for r in past]
        n, mean = len(past), sum(cents) / 100 / len(past) if past else None
        std = math.sqrt(sum((c / 100 - mean) ** 2 for c in cents) / (n - 1)) if n > 1 else None
        win = lambda s: [r[3] for r in past if r[1] >= t - s]
        found[i] = {
            "card_cnt_1h": len(win(3600)), "card_cnt_24h": len(win(DAY)), "card_cnt_7d": len(win(7 * DAY)),
            "card_amt_sum_24h": sum(win(DAY)) / 100, "card_amt_sum_7d": sum(win(7 * DAY)) / 100, "card_cnt_all": n,
            "card_amt_mean_all": mean, "card_amt_std_all": std,
            "secs_since_last_tx": t - max(r[1] for r in past) if past else None, "card_age_s": t - min(r[1] for r in past) if past else None,
            "amt_vs_card_mean": amt / mean if mean else None, "card_labeled_cnt": len(known), "card_fraud_cnt": sum(r[5] for r in known),
            "card_fraud_rate": sum(r[5] for r in known) / len(known) if known else None,
        }
    return found


def check_pit(got, rows):
    want = brute_pit(rows)
    assert len(got) == len(want)
    for r in got:
        for f, v in want[r["TransactionID"]].items():
            assert (r[f] is None) == (v is None) and (v is None or math.isclose(r[f], v, rel_tol=1e-9, abs_tol=1e-9)), (f, r[f], v)


def test_pit_features_against_brute_force(spark):
    rows = random_tx()
    check_pit(pit_features(spark.createDataFrame(rows, TX)).collect(), rows)


def test_pit_features_do_not_depend_on_the_chunk(spark):
    rows = random_tx(120)
    check_pit(pit_features(spark.createDataFrame(rows, TX), chunk_s=3600).collect(), rows)


def test_pit_same_second_and_label_boundaries(spark):
    rows = [(1, 100, 1.0, 100, "a", 1, 500.0), (2, 500, 2.0, 200, "a", 0, 900.0), (3, 500, 4.0, 400, "a", 0, 900.0), (4, 900, 1.0, 100, "a", 0, 2000.0)]
    got = {r["TransactionID"]: r for r in pit_features(spark.createDataFrame(rows, TX)).collect()}
    assert [got[i]["card_cnt_all"] for i in (1, 2, 3, 4)] == [0, 1, 1, 3]
    assert [got[i]["card_labeled_cnt"] for i in (1, 2, 3, 4)] == [0, 1, 1, 3]
    assert got[2]["card_fraud_cnt"] == 1


def test_pit_of_no_rows(spark):
    assert pit_features(spark.createDataFrame([], TX)).count() == 0


def test_spec_rejects_what_it_cannot_compute():
    with pytest.raises(ValueError):
        HistoryFeature("x", "median")
    with pytest.raises(ValueError):
        HistoryFeature("x", "mean", 3600)


def test_leaky_aggregates(spark):
    rows = [(i, i, a, int(a * 100), c, f, 0.0) for i, (c, a, f) in enumerate([("a", 10.0, 1), ("a", 20.0, 0), ("a", 60.0, 0), ("b", 5.0, 1)])]
    got = leaky.target_encoding(leaky.global_aggregates(spark.createDataFrame(rows, TX))).orderBy("TransactionID").collect()
    assert [r["card_tx_count"] for r in got] == [3, 3, 3, 1]
    assert [r["card_amt_mean"] for r in got] == [30.0, 30.0, 30.0, 5.0]
    assert got[0]["card_amt_std"] == pytest.approx(math.sqrt(700)) and got[3]["card_amt_std"] is None
    assert got[0]["card_fraud_rate"] == pytest.approx(1 / 3) and got[3]["card_fraud_rate"] == 1.0


def test_served_aggregates_follow_history_and_row(spark):
    history = spark.createDataFrame(
        [(1, 5.0, 500, 3, 9_000, 41_000_000, 2, 1), (2, 40.0, 4_000, 0, 0, 0, 0, 0)],
        "TransactionID int, TransactionAmt double, cents bigint, card_cnt_all bigint, card_cents_all bigint, card_squares_all bigint, card_labeled_cnt bigint, card_fraud_cnt bigint",
    )
    a, b = leaky.served_aggregates(history).orderBy("TransactionID").collect()
    assert a["card_tx_count"] == 4 and a["card_amt_mean"] == pytest.approx(23.75)
    assert a["card_amt_std"] == pytest.approx(math.sqrt(sum((x - 23.75) ** 2 for x in (10, 20, 60, 5)) / 3))
    assert b["card_tx_count"] == 1 and b["card_amt_mean"] == 40.0 and b["card_amt_std"] is None and b["card_fraud_rate"] is None


def test_periods_keep_a_second_together(spark):
    rows = [(i, 1 if i < 7 else 2, 1.0, 100, "a", 0, 0.0) for i in range(10)]
    got = dataset.assign_period(spark.createDataFrame(rows, TX)).groupBy("TransactionDT").agg({"period": "count"}).count()
    assert got == 2
    periods = {(r["TransactionDT"], r["period"]) for r in dataset.assign_period(spark.createDataFrame(rows, TX)).collect()}
    assert len(periods) == 2


def test_label_delay_bounds(spark):
    rows = [(i, i * 60, 1.0, 100, "a", i % 2, None) for i in range(2_000)]
    out = dataset.simulate_label_delay(spark.createDataFrame(rows, TX)).selectExpr("isFraud", "(label_available_at - TransactionDT) / 86400 as d")
    fraud, legit = out.where("isFraud = 1"), out.where("isFraud = 0")
    lo, hi, mid = fraud.selectExpr("min(d)", "max(d)", "percentile(d, 0.5)").first()
    assert lo >= 1 and hi <= 90 and 12.5 < mid < 15.5
    assert legit.selectExpr("min(d)", "max(d)").first() == (30.0, 30.0)


def test_build_dataset_keeps_every_row(spark):
    tx = spark.createDataFrame(random_tx(200), TX).drop("label_available_at")
    identity = spark.createDataFrame([(i, "mobile") for i in range(100)], tables.IDENTITY_CSV)
    out = dataset.build_dataset(tx, identity)
    assert out.count() == 200 and out.where("DeviceType is not null").count() == 100
    with pytest.raises(ValueError):
        dataset.build_dataset(tx, identity.unionAll(identity))


def test_exact_splits(spark):
    tx = spark.createDataFrame(random_tx(200), TX)
    assert dict(map(tuple, dataset.random_split(tx).groupBy("part").count().collect())) == {"train": 140, "stop": 30, "test": 30}
    assert dict(map(tuple, dataset.time_ordered_split(tx).groupBy("part").count().collect())) == {"train": 170, "stop": 30}


SCORED = [(0.1, 0, 5000), (0.2, 0, 5000), (0.3, 1, 40000), (0.6, 0, 5000), (0.7, 1, 2000), (0.9, 1, 30000)]


def test_threshold_by_cost(spark):
    scored = spark.createDataFrame(SCORED, "score double, isFraud int, cents bigint")
    curve = decide.cost_curve(scored, 10.0)
    assert decide.choose(curve, "cost").first()[["threshold", "cost"].index("threshold")] == 0.3
    assert decide.choose(curve, "cost").first()["cost"] == 40.0
    assert curve.where("threshold = double('inf')").first()["cost"] == 720.0
    assert decide.choose(decide.cost_curve(scored, 250.0), "cost").first()["threshold"] == 0.9
    assert decide.cost_curve(scored.limit(0)).count() == 0


def test_ranking_metrics(spark):
    scored = spark.createDataFrame(SCORED, "score double, isFraud int, cents bigint")
    assert decide.roc_auc(scored).first()[0] == pytest.approx(8 / 9, abs=1e-4)  # only (0.3, 0.6) is out of order
    assert decide.average_precision(scored).first()[0] == pytest.approx((1 + 1 + 3 / 4) / 3, abs=1e-4)
    assert decide.roc_auc(scored.where("isFraud = 0")).first()[0] is None


def test_policies_on_halves(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.1), rng.randrange(100, 50_000), rng.random(), rng.random()) for _ in range(2_000)]
    live = spark.createDataFrame(rows, "isFraud int, cents bigint, score_honest double, score_naive double")
    chosen = live.selectExpr("score_honest as score", "isFraud", "cents")
    got = {r["policy"]: r for r in decide.policy_table(chosen, chosen, live).collect()}
    assert got["no_model"]["alerts"] == 0 and got["no_model"]["precision"] is None
    assert got["honest_hindsight"]["total_cost"] <= got["honest_cost_threshold"]["total_cost"] <= got["no_model"]["total_cost"]


def test_drift_levels(spark):
    rng = random.Random(7)
    frame = lambda shift, gone: spark.createDataFrame([(None if rng.random() < gone else rng.gauss(shift, 1), "a") for _ in range(3_000)], "x double, c string")
    ref = frame(0, 0)
    psi = lambda cur: {r["feature"]: r["psi"] for r in monitor.drift_report(ref, cur, ("x",), ("c",)).collect()}
    assert psi(frame(0, 0))["x"] < 0.02
    assert psi(frame(1, 0))["x"] > 0.25 and psi(frame(0, 0.3))["x"] > 0.25
    other = ref.selectExpr("x", "'b' as c")
    assert psi(other)["c"] > 0.25


def test_daily_report_knows_only_arrived_labels(spark):
    rows = [(0, 1, 0.9, 1.0 * DAY), (10, 0, 0.8, 9.0 * DAY), (20, 1, 0.1, 2.0 * DAY), (DAY + 5, 1, 0.7, 9.0 * DAY), (DAY + 6, 0, 0.2, 9.0 * DAY)]
    df = spark.createDataFrame(rows, "TransactionDT bigint, isFraud int, score double, label_available_at double")
    as_of = spark.createDataFrame([(3 * DAY,)], "as_of bigint")
    first, second = monitor.daily_report(df, 0.5, as_of).orderBy("day").collect()
    assert (first["alerts"], first["precision"], first["recall"], first["fraud_known"], first["recall_known"]) == (2, 0.5, 0.5, 2, 0.5)
    assert (second["fraud_known"], second["recall_known"], second["labels_known"]) == (0, None, 0.0)


def test_parity_finds_each_difference(spark):
    right = pit_features(spark.createDataFrame(random_tx(150), TX))
    off = right.selectExpr("*", "card_cnt_24h + if(TransactionID < 7, 1, 0) as c").drop("card_cnt_24h").withColumnRenamed("c", "card_cnt_24h")
    got = {r["feature"]: r["mismatches"] for r in parity.compare_features(off, right).collect()}
    assert got["*"] == got["card_cnt_24h"] == 7 and sum(got.values()) == 14
    with pytest.raises(ValueError):
        parity.compare_features(right.where("TransactionID > 0"), right)


def test_event_order(spark):
    rows = [(1, 100, 1.0, 100, "a", 1, 500.0), (2, 500, 2.0, 200, "a", 0, 900.0)]
    events = online.ordered(online.build_events(spark.createDataFrame(rows, TX))).collect()
    assert [(e["kind"], e["t"]) for e in events] == [(1, 100.0), (0, 500.0), (1, 500.0), (0, 900.0)]


def test_csv_by_declared_names(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TransactionDT,TransactionID,TransactionAmt,extra\n5,1,2.5,x\n6,2,,y\n")
    out = tables.read_csv(spark, str(tmp_path / "t.csv"), "TransactionID bigint, isFraud int, TransactionDT bigint, TransactionAmt double")
    assert [tuple(r) for r in out.orderBy("TransactionID").collect()] == [(1, None, 5, 2.5, "x"), (2, None, 6, None, "y")]


def test_sinks_round_trip(spark, tmp_path):
    tx = dataset.assign_period(spark.createDataFrame(random_tx(100), TX))
    tables.write_ordered(tx, str(tmp_path / "tx"))
    back = tables.read_periods(spark, str(tmp_path / "tx"), ("valid",), ("TransactionID", "TransactionDT", "period"))
    assert back.count() == tx.where("period = 'valid'").count()
    assert tables.read_report(spark, str(tmp_path / "none.json")) is None


def test_a_table_of_one_row_must_have_one(spark):
    rows, two = spark.range(3), spark.range(2).withColumnRenamed("id", "x")
    assert prefix.with_scalar(rows, two.limit(1)).count() == 3 and prefix.with_scalar(rows, two.limit(0)).count() == 0
    with pytest.raises(Exception, match="several"):
        prefix.with_scalar(rows, two).collect()


def test_every_policy_is_evaluated(spark):
    scored = spark.createDataFrame([(i / 10, i % 2, 100) for i in range(10)], "score double, isFraud int, cents bigint")
    policies = spark.range(150).selectExpr("concat('p', id) as policy", "id / 150 as threshold")
    assert decide.evaluate(scored, policies).select("policy").distinct().count() == 150
    with pytest.raises(ValueError):
        decide.evaluate(scored, spark.range(decide.MOST_POLICIES + 1).selectExpr("cast(id as string) as policy", "id / 10 as threshold"))


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_running_totals_do_not_depend_on_the_ranges(spark, ranges):
    rng = random.Random(4)
    rows = sorted({rng.randrange(5_000) for _ in range(400)})
    df = spark.createDataFrame([(k, k % 13) for k in rows], "k bigint, v bigint").repartition(3)
    got = {r["k"]: r["s"] for r in prefix.running_before(df, "k", {"s": "v"}, ranges=ranges).collect()}
    assert got == {k: sum(j % 13 for j in rows if j < k) for k in rows}


def test_replay_can_be_paced(spark, tmp_path):
    import time

    events = online.build_events(spark.createDataFrame([(i, i * 10, 1.0, 100, "a", 0, 1e6) for i in range(4)], TX))
    began = time.monotonic()
    assert online.replay(events, [10.0, 60.0], str(tmp_path), speed=10).count() == 4
    assert time.monotonic() - began >= 5  # the last slice comes 50 seconds of event time after the one before


def test_late_repeats_are_dropped(spark, tmp_path):
    """A repeat in a later slice is known, and an event from beyond the watermark is late."""
    tx = spark.createDataFrame([(1, 100, 1.0, 100, "a", 0, 1e9), (2, 20 * DAY, 1.0, 100, "a", 0, 1e9), (3, 40 * DAY, 1.0, 100, "a", 0, 1e9)], TX)
    events = online.build_events(tx).where("kind = 1")
    out = online.replay(events.unionByName(events), [10.0 * DAY, 30.0 * DAY], str(tmp_path), once=True)
    assert sorted((r["TransactionID"], r["card_cnt_all"]) for r in out.collect()) == [(1, 0), (2, 1), (3, 2)]


def test_models_are_saved_with_their_columns(spark, tmp_path):
    from tidemark.plans import ladder

    rng = random.Random(8)
    rows = [(i, float(rng.randrange(100)), rng.choice(["a", "b", None]), int(rng.random() < 0.3)) for i in range(900)]
    df = spark.createDataFrame(rows, "TransactionID bigint, x double, c string, isFraud int")
    model = ladder.fit(df.where("TransactionID < 700"), df.where("TransactionID >= 700"), ("x",), ("c",), trees=3)
    model.save(str(tmp_path / "m"))
    again = ladder.Model.load(spark, str(tmp_path / "m"))
    odd = spark.createDataFrame([(1, None, None), (2, 5.0, "never seen"), (3, 5.0, "a")], "TransactionID bigint, x double, c string")
    both = model.score(odd).join(again.score(odd).select("TransactionID", "score").withColumnRenamed("score", "again"), "TransactionID")
    assert both.where("score = again").count() == 3 and (again.numeric, again.categorical) == (("x",), ("c",))


def test_runs_are_logged(spark, tmp_path):
    from tidemark.plans import ladder

    metrics = spark.createDataFrame([("v", 0.9)], "variant string, roc_auc double")
    for name in ("one", "two"):
        ladder.log_runs(metrics, str(tmp_path / "runs"), name)
    assert sorted(r["experiment"] for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == ["one", "two"]


@pytest.mark.parametrize("most_rows", [0, 20, 10**6])
def test_cards_with_many_rows_go_by_chunks_and_others_whole(spark, most_rows):
    rows = random_tx(300, seed=3)
    out = pit_features(spark.createDataFrame(rows, TX), chunk_s=7200, most_rows=most_rows)
    check_pit(out.collect(), rows)
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ("chunk" in final) == (most_rows < 10**6)  # nothing is shuffled by chunks where no card is large
