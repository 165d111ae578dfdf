"""The online path: the card's log against plain sums, what a batch writes, late events, hot cards, rates."""

import random

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_operators import DAY, TX, brute_pit, check_pit, random_tx

from tidemark.plans import registry
from tidemark.plans.ship import ship
from tidemark.sources import tables
from tidemark.streaming import history, online


class Value:
    def __init__(self):
        self.saved, self.bytes = None, 0

    def get(self):
        return self.saved

    def update(self, value):
        self.saved = value
        self.bytes += sum(len(v) if isinstance(v, bytes) else 8 for v in value)


class Blocks:
    def __init__(self):
        self.saved, self.writes, self.reads, self.bytes = {}, 0, 0, 0

    def getValue(self, key):  # noqa: N802
        self.reads += 1
        return self.saved.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.saved[key] = value
        self.writes += 1
        self.bytes += len(value[0])

    def removeKey(self, key):  # noqa: N802
        self.writes += 1
        self.saved.pop(key, None)


def processor(lateness=online.LATENESS):
    p = online.CardProcessor(lateness)
    p.counters, p.blocks = Value(), Blocks()
    return p


def batch(transactions, labels=(), slice_=0):
    """Frame of SECOND rows: transactions (t, cents), labels (t, fraud)."""
    rows = [(slice_, online.TX, float(t), "a", 1, c, c * c >> 32, c * c & 0xFFFFFFFF, 0) for t, c in transactions]
    rows += [(slice_, online.LABEL, float(t), "a", 1, 0, 0, 0, f) for t, f in labels]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in online.SECOND.split(", ")])


def feed(p, *frames):
    out = pd.concat(list(p.handleInputRows(("a",), iter(frames), None)) or [pd.DataFrame()])
    return out.astype(object).where(out.notna(), None).to_dict("records")


def expected(past, t):
    earlier = [(s, c) for s, c in past if s < t]
    window = lambda w: [c for s, c in earlier if s >= t - w]
    n, cents = len(earlier), [c for _, c in earlier]
    spread = n * sum(c * c for c in cents) - sum(cents) ** 2
    return {
        "card_cnt_1h": len(window(3_600)), "card_cnt_24h": len(window(DAY)), "card_cnt_7d": len(window(7 * DAY)), "card_amt_sum_24h": sum(window(DAY)) / 100, "card_amt_sum_7d": sum(window(7 * DAY)) / 100,
        "card_cnt_all": n, "card_amt_mean_all": sum(cents) / 100 / n if n else None, "card_amt_std_all": (float(spread) / float(n * (n - 1))) ** 0.5 / 100 if n > 1 else None,
        "card_first_t": min(s for s, _ in earlier) if n else None, "card_last_t": max(s for s, _ in earlier) if n else None,
    }


@pytest.mark.parametrize("block", [1, 3, 256])
def test_features_of_a_busy_card_against_plain_sums(monkeypatch, block):
    """Batches of one to many events, seconds shared within and between batches, long gaps, large amounts."""
    monkeypatch.setattr(history, "BLOCK", block)
    rng, p, past, t = random.Random(block), processor(), [], 0
    for _ in range(150):
        transactions = []
        for _ in range(rng.choice([1, 1, 2, 9])):
            t += rng.choice([0, 0, 1, 60, 4_000, 90_000])
            transactions.append((t, rng.choice([5, 1_000, 3_000_000_000])))
        rng.shuffle(transactions)
        got = {r["TransactionDT"]: r for r in feed(p, batch(transactions))}
        past += transactions
        assert set(got) == {s for s, _ in transactions}
        for second, row in got.items():
            for name, value in expected(past, second).items():
                assert row[name] == (pytest.approx(value, rel=1e-12) if isinstance(value, float) else value), (name, second)


def test_late_transactions_get_their_own_history_and_change_what_follows(monkeypatch):
    monkeypatch.setattr(history, "BLOCK", 4)
    rng, p, past, newest, dropped = random.Random(9), processor(2 * DAY), [], 0, 0
    for _ in range(200):
        t = max(0, newest + rng.choice([10, 3_000, 40_000, -3_000, -100_000, -3 * DAY]))
        late = t < newest
        rows = feed(p, batch([(t, 100)]))
        report = [r for r in rows if r["TransactionDT"] is None]
        assert len(report) == late
        if late:
            assert report[0]["late_tx"] == 1
        if late and t < newest - 2 * DAY:
            assert report[0]["dropped_tx"] == 1 and len(rows) == 1
            dropped += 1
            continue
        past.append((t, 100))
        row = rows[-1]
        for name, value in expected(past, t).items():
            assert row[name] == (pytest.approx(value, rel=1e-12, abs=1e-9) if isinstance(value, float) else value), (name, t, newest)
        newest = max(newest, t)
    assert dropped > 5


def test_labels_count_from_their_second_on_and_late_ones_from_their_batch(monkeypatch):
    p = processor()
    a = feed(p, batch([(10, 1), (20, 1)], [(19.5, 1), (20.0, 0)]))
    assert [(r["card_labeled_cnt"], r["card_fraud_cnt"]) for r in a] == [(0, 0), (2, 1)]
    b = feed(p, batch([(30, 1)], [(5.0, 1), (40.0, 1)]))
    assert b[0]["late_labels"] == 1 and b[0]["late_tx"] == 0
    assert (b[1]["card_labeled_cnt"], b[1]["card_fraud_cnt"]) == (3, 2)


def test_one_event_on_a_card_with_a_long_week_writes_a_bounded_delta():
    p = processor()
    feed(p, batch([(i * 6, 100) for i in range(100_000)]))  # within a week
    assert len(p.blocks.saved) == -(-100_000 // history.BLOCK)
    p.blocks.writes = p.blocks.reads = p.blocks.bytes = p.counters.bytes = 0
    row = feed(p, batch([(600_000, 100)]))[0]
    assert row["card_cnt_7d"] == 100_000
    assert p.blocks.writes == 1 and p.blocks.reads <= 4
    assert p.blocks.bytes + p.counters.bytes <= (history.BLOCK + 2) * 40 + 8 * len(p.blocks.saved) + 200
    feed(p, batch([(600_000 + 30 * DAY, 100)]))  # the week has passed
    assert len(p.blocks.saved) <= 2


def test_expired_blocks_leave_the_totals(monkeypatch):
    monkeypatch.setattr(history, "BLOCK", 2)
    p, past = processor(), [(t, 100 + t) for t in (0, 5, 10, 15, 20)]
    feed(p, batch(past))
    p.blocks.saved.pop((0,))  # as a time to live would
    for t in (25 + 7 * DAY, 50 + 20 * DAY):
        row = feed(p, batch([(t, 1)]))[0]
        past.append((t, 1))
        assert {k: row[k] for k in ("card_cnt_all", "card_cnt_7d", "card_last_t")} == {k: expected(past, t)[k] for k in ("card_cnt_all", "card_cnt_7d", "card_last_t")}
        p.blocks.saved.clear()


def test_initial_state_is_what_the_history_would_have_left(spark):
    """One batch over seeded state gives what the stream of all events gives, whatever the order of a card's blocks."""
    rows = random_tx(600, seed=4)
    tx, start = spark.createDataFrame(rows, TX), 25 * DAY
    seeds = online.history_state(tx, start).toPandas()
    rng = random.Random(1)
    for card in ("c1", "c5"):
        seeded, whole = processor(), processor()
        own = [r for r in rows if r[4] == card]
        frame = lambda keep: batch([(r[1], r[3]) for r in own if keep(r[1])], [(r[6], r[5]) for r in own if keep(r[6])])
        feed(whole, frame(lambda t: t < start))
        seed = seeds[seeds["card_id"] == card].sample(frac=1, random_state=rng.randrange(99))
        for part in np.array_split(np.arange(len(seed)), 1):
            seeded.handleInitialState((card,), seed.iloc[part], None)
        assert feed(seeded, frame(lambda t: t >= start)) == feed(whole, frame(lambda t: t >= start))


def test_stream_against_brute_force(spark, tmp_path):
    """Null cards, shared seconds, missing amounts and labels; in one, and in several micro-batches over a history."""
    ship(spark)
    rows = random_tx(300, seed=8)
    tx = spark.createDataFrame(rows, TX)
    check_pit(online.with_derived(online.replay(online.build_events(tx), [], str(tmp_path / "a"))).collect(), rows)
    start = 12.5 * DAY
    out = online.replay(online.build_events(tx, start=start), [20.0 * DAY, 33.0 * DAY], str(tmp_path / "b"), history=online.history_state(tx, start))
    got, want = online.with_derived(out).collect(), brute_pit(rows)
    assert len(got) == sum(r[1] >= start for r in rows)
    for r in got:
        for f in ("card_cnt_7d", "card_cnt_all", "card_labeled_cnt", "card_fraud_cnt", "card_age_s"):
            assert r[f] == want[r["TransactionID"]][f], f


def test_a_hot_card_meets_its_state_with_one_row_a_second(spark, tmp_path):
    ship(spark)
    rows = [(i, (i // 500) * 7, 1.0, 100 + i, "hot" if i % 2 else f"c{i % 50}", 0, 1e9) for i in range(20_000)]
    events = online.build_events(spark.createDataFrame(rows, TX)).where("kind = 1")
    replay = online.Replay(events, [], str(tmp_path))
    out = replay.run()
    assert out.count() == 20_000
    (taken,) = replay.progress
    assert taken["events"] == 20_000 and taken["rows"] <= 40 * 26  # 40 seconds, 26 cards
    last = out.where("card_id = 'hot'").agg(F.max("card_cnt_all")).first()[0]
    assert last == sum(r[1] < 39 * 7 and r[4] == "hot" for r in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_parity_run_reports_rates(spark, tmp_path):
    ship(spark)
    tx = registry.tx(spark, SF)
    report = registry.live.parity_run(spark, tx, 20.0 * DAY, [25.0 * DAY], str(tmp_path / "run"), str(tmp_path / "report"))
    rows = tx.where(f"TransactionDT >= {20 * DAY}").count()
    assert (report["rows"], report["mismatched_rows"], report["max_abs_diff"]) == (rows, 0, 0.0)
    assert report["live_events"] == online.build_events(tx, start=20.0 * DAY).count() == sum(s["events"] for s in report["slices"])
    assert report["events_per_s"] == pytest.approx(report["live_events"] / report["take_s"]) and report["history_cards"] > 0
    assert len(report["features"]) == 14 and len(report["slices"]) == 2 and min(report["prepare_s"], report["write_s"]) > 0
    back = tables.read_report(spark, str(tmp_path / "report")).first()
    assert back["rows"] == rows and back["features"]["card_cnt_1h"]["mismatches"] == 0


def test_redelivered_events_of_the_first_second_and_before_are_kept(spark, tmp_path):
    ship(spark)
    rows = [(i, t, 1.0, 100, "a", i % 2, t + 5.5) for i, t in enumerate((-9 * DAY, -3, 0, 0, 1, 12 * DAY))]
    events = online.build_events(spark.createDataFrame(rows, TX))
    out = online.replay(events.unionByName(events), [10.0 * DAY], str(tmp_path), once=True)
    want = brute_pit(rows)
    assert {r["TransactionID"]: r["card_cnt_all"] for r in out.collect()} == {i: want[i]["card_cnt_all"] for i in range(6)}


class Entries(Blocks):
    def updateValue(self, key, value):  # noqa: N802
        self.saved[key] = value


def test_a_bucket_gives_each_card_its_own_features_in_one_frame():
    """Null and empty cards are two; each card's rows are those that a state of its own gives."""
    rng, bucket, own = random.Random(3), online.BucketProcessor(), {}
    bucket.counters, bucket.blocks = Entries(), Entries()
    for k in range(12):
        parts = []
        for card in (None, "", "a", "b"):
            times = [k * 50_000 + rng.randrange(-20_000, 50_000) for _ in range(rng.randrange(1, 6))]
            part = batch([(max(t, 0), 100 + t % 7) for t in times], [(max(t, 0) + 0.5, t % 2) for t in times], k)
            parts.append(part.assign(card_id=card))
        mixed = pd.concat(parts).sample(frac=1, random_state=k)
        frames = list(bucket.handleInputRows((0,), iter(np.array_split(mixed, 2)), None))
        assert len(frames) <= 2  # late ones and features
        got = pd.concat(frames)
        for card in (None, "", "a", "b"):
            mine = lambda df: df[df["card_id"].isna() if card is None else df["card_id"] == card]
            p = own.setdefault(card, processor())
            want = pd.concat(list(p.handleInputRows((card,), iter([mine(mixed)]), None)))
            pd.testing.assert_frame_equal(mine(got).reset_index(drop=True), want.reset_index(drop=True), check_dtype=False)
