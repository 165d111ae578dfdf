"""Exact quantiles against NumPy, halving, and policies from totals against policies from rows."""

import random

import numpy as np
import pytest

from tidemark.operators import decide, prefix, quantiles
from pyspark.sql import functions as F

SHARES = (0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0)


def values_of(kind, n, rng):
    return {
        "spread": lambda: rng.gauss(0, 1), "tied": lambda: float(rng.randrange(3)), "one": lambda: 7.25, "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300),
        "skewed": lambda: 0.0 if rng.random() < 0.7 else rng.random() ** 9, "infinite": lambda: rng.choice([float("-inf"), float("inf"), rng.random()]),
    }[kind]


@pytest.mark.parametrize("most", [5, 40, 50_000])
def test_quantiles_of_groups_against_numpy(spark, monkeypatch, most):
    """Ranges narrowed over several rounds, over few, and sorted at once."""
    monkeypatch.setattr(quantiles, "MOST_SORTED", most)
    monkeypatch.setattr(quantiles, "CUTS", 8)
    rng, want, rows = random.Random(most), {}, []
    for kind, n in (("spread", 900), ("tied", 500), ("one", 300), ("wide", 700), ("skewed", 800), ("infinite", 11), ("spread", 1)):
        key = f"{kind}{n}" if n > 1 else None
        found = [values_of(kind, n, rng)() for _ in range(n)]
        with np.errstate(invalid="ignore"):
            want[key] = np.quantile(found, SHARES) if kind != "infinite" else None
        rows += [(key, v) for v in found]
        if kind == "infinite":
            infinite = sorted(found)
    rows += [("none", None), ("none", float("nan")), ("spread900", None), ("spread900", float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").withColumns({"g": F.lit(1), "n": F.lit(2), "rank": F.lit(3)})
    got = {r["k"]: r for r in quantiles.exact_quantiles(df, "v", SHARES, ("k",)).collect()}
    assert set(got) == set(want) and got["spread900"]["n"] == 900
    for k, q in want.items():
        if q is not None:
            assert got[k]["quantiles"] == pytest.approx(q.tolist(), rel=1e-12), k
    assert got["infinite11"]["quantiles"][0] == infinite[0] and got["infinite11"]["quantiles"][-1] == infinite[-1]


def test_quantiles_without_groups_and_without_values(spark):
    df = spark.range(101).selectExpr("cast(id as double) as v")
    assert quantiles.exact_quantiles(df, "v", (0.5, 0.955)).first()["quantiles"] == [50.0, 95.5]
    assert quantiles.exact_quantiles(df.limit(0), "v", (0.5,)).count() == 0


def test_no_task_sorts_more_than_its_share(spark, monkeypatch):
    """A million distinct values of one column: what is left to sort after narrowing is a small part of them."""
    monkeypatch.setattr(quantiles, "MOST_SORTED", 10_000)
    df = spark.range(0, 1_000_000, 1, 8).selectExpr("cast((id * 7919) % 1000003 as double) as v", "'all' as k")
    seen = []
    whole = quantiles._rows_of

    def counted(values, ranges, hint):
        out = whole(values, ranges, hint)
        if "places" in ranges.columns:
            seen.append(out.groupBy("g", "lo", "hi").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "_rows_of", counted)
    shares = (0.1, 0.5, 0.9)
    got = quantiles.exact_quantiles(df, "v", shares, ("k",)).first()["quantiles"]
    assert got == df.selectExpr("percentile(v, array(0.1, 0.5, 0.9))").first()[0]
    assert seen and seen[0] <= 10_000


def test_place_is_the_count_of_bounds_below(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 7, 8, 1_000):
        bounds = sorted({rng.random() for _ in range(n)})
        values = [None, -1.0, 2.0, *bounds, *(rng.random() for _ in range(30))]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = df.select("v", prefix.place(F.lit(bounds).cast("array<double>"), F.col("v")).alias("p")).collect()
        assert all(r["p"] == (0 if r["v"] is None else sum(b <= r["v"] for b in bounds)) for r in got), n


def test_policies_from_totals_against_rows(spark):
    """Ties of scores and thresholds, null and infinite ones, null scores, policies that share a threshold."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 0.0, 0.25, 0.5, 0.5, 1.0, rng.random()]), rng.randrange(2), rng.randrange(9_000)) for _ in range(500)]
    marks = [0.5, 0.5, 0.25, -1.0, 1.0, 1.5, float("inf"), None, *(rng.random() for _ in range(40))]
    scored = spark.createDataFrame(rows, "score double, isFraud int, cents bigint")
    policies = spark.createDataFrame([(f"p{i}", m) for i, m in enumerate(marks)], "policy string, threshold double")
    got = {r["policy"]: r for r in decide.evaluate(scored, policies).collect()}
    assert len(got) == len(marks)
    for i, m in enumerate(marks):
        alert = [r for r in rows if m is not None and r[0] is not None and r[0] >= m]
        frauds, caught = sum(r[1] for r in rows), sum(r[1] for r in alert)
        r = got[f"p{i}"]
        assert r["alerts"] == len(alert) and r["recall"] == pytest.approx(caught / frauds, abs=5e-5)
        assert (r["precision"] is None) == (not alert) and (not alert or r["precision"] == pytest.approx(caught / len(alert), abs=5e-5))
        cost = sum(x[2] for x in rows if x[1] and x not in alert) / 100 + 5 * len(alert)
        assert r["total_cost"] == pytest.approx(cost, abs=0.51)
    assert decide.evaluate(scored.limit(0), policies).count() == 0


def test_ten_thousand_policies_cost_one_pass(spark):
    scored = spark.range(20_000).selectExpr("(id * 7919 % 20011) / 20011D as score", "cast(id % 3 = 0 as int) as isFraud", "id % 500 as cents")
    policies = spark.range(decide.MOST_POLICIES).selectExpr("concat('p', id) as policy", "id / 10000D as threshold")
    out = decide.evaluate(scored, policies)
    assert out.count() == decide.MOST_POLICIES
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    assert out.where("policy = 'p5000'").first()["alerts"] == scored.where("score >= 0.5").count()


@pytest.mark.parametrize("per_task", [20, 100_000])
def test_row_index_with_a_hot_key(spark, monkeypatch, per_task):
    monkeypatch.setattr(prefix, "PARTS_OF_A_KEY", 8)
    rng = random.Random(5)
    rows = [(7 if i % 2 else rng.randrange(40), i) for i in rng.sample(range(10_000), 900)] + [(None, -1)]
    df = spark.createDataFrame(rows, "t bigint, id bigint").withColumn("n", F.lit(1)).repartition(5)
    got = sorted((r["position"], r["t"], r["id"]) for r in prefix.row_index(df, "t", "id", per_task=per_task).collect())
    assert got == [(p, *r) for p, r in enumerate(sorted(r for r in rows if r[0] is not None))]
    assert prefix.row_index(df.limit(0), "t", "id").count() == 0


def test_reading_a_period_opens_no_other(spark, tmp_path):
    import shutil

    from test_operators import TX, random_tx

    from tidemark.operators import dataset
    from tidemark.sources import tables

    tx = dataset.assign_period(spark.createDataFrame(random_tx(200), TX))
    tables.write_ordered(tx, str(tmp_path / "tx"), ("period",))
    rows = tables.read_periods(spark, str(tmp_path / "tx"), ("valid",), ("TransactionID", "TransactionDT"))
    plan = rows._jdf.queryExecution().explainString(rows._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) if hasattr(rows, "_jvm") else rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    (shutil.rmtree(tmp_path / "tx" / "period=train"), shutil.rmtree(tmp_path / "tx" / "period=holdout"))
    assert [r["TransactionID"] for r in rows.collect()] == [r["TransactionID"] for r in tx.where("period = 'valid'").orderBy("TransactionDT", "TransactionID").collect()]
