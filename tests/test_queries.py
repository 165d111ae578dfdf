"""Every registered query of the engine against its SQL; those without SQL against what must hold of them."""

import random

import pytest
from conftest import SF
from test_operators import TX, random_tx

from tidemark.plans import ladder, registry
from tidemark.plans.ship import ship


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, agrees, name):
    ship(spark)
    agrees(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name])


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_scores_cover_the_live_part(spark):
    out = registry.QUERIES["stream_scores"](spark, SF)
    live = registry.tx(spark, SF).where("TransactionDT >= 20 * 86400")
    assert out.count() == live.count()
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_careless_rungs_look_better_than_they_are(spark):
    """Fraud sits on a few cards, and the amount says nothing: only the leaks can see it."""
    rng, rows = random.Random(11), []
    for i in range(4_000):
        card = rng.randrange(100)
        fraud = int(card < 8 and rng.random() < 0.6)
        amount = rng.randrange(100, 9_000)
        rows.append((i, i * 2_000, amount / 100, amount, f"c{card}", fraud, i * 2_000 + 86_400.0 * (10 if fraud else 30)))
    tx = spark.createDataFrame(rows, "TransactionID bigint, TransactionDT bigint, TransactionAmt double, cents bigint, card_id string, isFraud int, label_available_at double")
    got = {r["variant"]: r for r in ladder.leakage_ladder(tx, ("TransactionAmt",), trees=3).collect()}
    assert list(got) == ["time_split_base", "random_base", "random_global_aggs", "random_target_enc"]
    assert got["random_target_enc"]["roc_auc"] > max(0.85, got["random_base"]["roc_auc"] + 0.15)


def test_headline_holds_both_models(spark):
    rows = spark.createDataFrame(random_tx(500, seed=9), TX)
    table = {r["model"]: r for r in ladder.headline(rows, ("TransactionAmt",), trees=1).collect()}
    assert set(table) == {"naive", "honest"}
    for r in table.values():
        assert 0 <= r["roc_auc_live"] <= 1 and r["roc_auc_gap"] == pytest.approx(r["roc_auc_offline"] - r["roc_auc_live"], abs=2e-4)


def test_headline_fits_each_model_once(spark, monkeypatch):
    """Offline and live the careless model is fitted to the same rows, so it is one model; the honest one learns anew."""
    fits = []
    monkeypatch.setattr(ladder, "fit", lambda *a, own=ladder.fit: fits.append(a[2]) or own(*a))
    table = {r["model"]: r for r in ladder.headline(spark.createDataFrame(random_tx(500, seed=9), TX), ("TransactionAmt",), trees=1).collect()}
    assert len(fits) == 3 and len(set(fits)) == 2
    assert table["naive"]["rounds_offline"] == table["naive"]["rounds_live"]
