"""Boosting in stages: the rounds chosen, continuing from a saved model, and cases without anything to learn."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import boosting, ladder

SCHEMA = "TransactionID bigint, x double, y double, c string, isFraud int"


def _rows(n, seed, signal=1.0):
    """Fraud follows x, and a category with 80 values; y is noise."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, c = rng.random(), rng.randrange(80)
        p = 1 / (1 + math.exp(-signal * (4 * x - 3 + (c % 2))))
        out.append((i, x, rng.random(), f"c{c}", int(rng.random() < p)))
    return out


@pytest.fixture(scope="module")
def parts(spark):
    make = lambda n, seed: spark.createDataFrame(_rows(n, seed), SCHEMA)
    return make(3000, 1), make(1500, 2)


@pytest.fixture(scope="module")
def model(parts):
    return ladder.fit(*parts, ("x", "y"), ("c",), trees=400)


def test_the_chosen_round_lies_inside(model):
    best = max(auc for _, auc in model.history)
    assert best > 0.7 and 0 < model.rounds < model.history[-1][0] < 400
    assert model.rounds == min(n for n, auc in model.history if auc == best)
    assert model.history[-1][0] - model.rounds == boosting.PATIENCE
    assert len(model.boosted().trees) == model.rounds


def test_the_score_is_the_sum_of_its_trees(spark, parts, model):
    scored = model.score(parts[1].limit(50))
    rows = model.pipeline.transform(ladder.filled(parts[1].limit(50), model.numeric)).select("TransactionID", "features").collect()
    got = {r["TransactionID"]: r["score"] for r in scored.collect()}
    trees = model.boosted().trees
    for r in rows:
        margin = model.start + boosting.STEP * sum(t.predict(r["features"]) for t in trees)
        assert got[r["TransactionID"]] == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-9)


def test_a_saved_model_is_continued(spark, parts, tmp_path):
    first = ladder.fit(*parts, ("x", "y"), ("c",), trees=10)
    first.save(str(tmp_path / "m"))
    loaded = ladder.Model.load(spark, str(tmp_path / "m"))
    assert (loaded.rounds, loaded.history) == (first.rounds, first.history)
    more = ladder.fit(*parts, (), trees=30, so_far=loaded)
    at_once = ladder.fit(*parts, ("x", "y"), ("c",), trees=30)
    splits = lambda m: [t.toDebugString.split("\n")[1:] for t in m.boosted().trees]  # noqa: E731  without the id
    assert splits(more)[:10] == splits(first)
    assert more.rounds == at_once.rounds and more.history[-1] == at_once.history[-1]
    loss = lambda m: m.score(parts[0]).agg(F.avg(-F.log(F.when(F.col("isFraud") == 1, F.col("score")).otherwise(1 - F.col("score"))))).first()[0]
    assert loss(more) < loss(first)


def test_nothing_to_learn_gives_the_rate(spark, parts):
    train, stop = parts
    same = train.withColumn("isFraud", F.lit(0))
    flat = ladder.fit(same, stop, ("x",))
    assert flat.rounds == 0 and flat.score(stop).agg(F.max("score")).first()[0] < 1e-5
    none = ladder.fit(train.limit(0), stop, ("x",))
    assert none.rounds == 0 and {r["score"] for r in none.score(stop).select("score").distinct().collect()} == {0.5}


def test_without_both_classes_to_stop_on_patience_is_the_number_of_rounds(spark, parts):
    train, stop = parts
    model = ladder.fit(train, stop.where("isFraud = 0"), ("x",), trees=400, patience=20)
    assert model.rounds == 20 and {auc for _, auc in model.history} == {None}


def test_rows_are_written_once_a_stage(spark, parts, monkeypatch):
    writes = []
    monkeypatch.setattr(boosting, "saved", lambda df, keep=boosting.saved: writes.append(1) or keep(df))
    model = ladder.fit(*parts, ("x", "y"), trees=20)
    assert model.history[-1][0] == 20 and len(writes) == 2


def test_rows_are_fitted_in_equal_parts_and_released(spark, parts, monkeypatch):
    """However unequal the partitions of the rows are; what a stage keeps in memory goes with it."""
    sizes, kept = [], spark.sparkContext._jsc.getPersistentRDDs().size()

    def boost(rows, *rest, own=boosting.boost):
        sizes.extend(r["n"] for r in rows.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect())
        return own(rows, *rest)

    monkeypatch.setattr(boosting, "boost", boost)
    train, stop = parts
    ladder.fit(train.coalesce(1), stop.limit(200).coalesce(1), ("x", "y"), trees=10)
    assert sum(sizes) == 3200 and len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) <= 1.1 * min(sizes)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
