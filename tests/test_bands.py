"""Joins by bands of time against comparing every pair."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import TX, brute_pit, random_tx

from tidemark.operators import bands


@pytest.mark.parametrize("how", ["inner", "left"])
def test_window_join_against_every_pair(spark, how):
    rng = random.Random(6)
    make = lambda n: [(i, rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(-50, 50)), rng.uniform(-50, 50)])) for i in range(n)]
    left, right = make(120), make(90)
    left += left[:3]  # repeated rows keep their partners each
    df = lambda rows: spark.createDataFrame(rows, "id int, k string, t double")
    got = sorted(((r["id"], r["right_id"]) for r in bands.window_join(df(left), df(right), "k", "t", "t", 7.5, how).collect()), key=str)
    want = [(i, j) for i, k, t in left for j, l, s in right if k and k == l and t is not None and s is not None and t - 7.5 <= s <= t]
    if how == "left":
        met = {i for i, _ in want}
        want += [(i, None) for i, _, _ in left if i not in met]
    assert got == sorted(want, key=str)
    with pytest.raises(ValueError):
        bands.window_join(df(left), df(right), "k", "t", "t", 0)


@pytest.mark.parametrize("width", [3_600, 86_400, 10**9])
def test_labels_by_bands(spark, width):
    rows = random_tx(200)
    want = brute_pit([r for r in rows if r[4]])
    got = {r["TransactionID"]: (r["card_labeled_cnt"], r["card_fraud_cnt"]) for r in bands.labels_by_bands(spark.createDataFrame(rows, TX), width).collect()}
    assert got == {r[0]: (want[r[0]]["card_labeled_cnt"], want[r[0]]["card_fraud_cnt"]) if r[4] else (0, 0) for r in rows}


def test_candidates_grow_with_the_rows(spark):
    """One card, four times the rows over four times the time: the pairs that are compared grow four times, not sixteen."""

    def met(n):
        rows = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") * 10).alias("t"))
        pairs = bands.window_join(rows, rows, "k", "t", "t", 100)
        return pairs.count()

    assert met(1_000) * 3.9 < met(4_000) < met(1_000) * 4.1
