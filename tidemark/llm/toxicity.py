"""Toxicity: non-negative positive-unlabelled learning of a linear classifier over words and word stems.

Confirmed toxic texts are the positives; texts of all kinds are the unlabelled set. The class prior, the share of toxic
texts among labelled ones, corrects the risk, and the part of it that stands for the negatives is kept from falling
below zero: when it does, the step goes uphill on that part.

Weights found on a bounded sample are only where the fit starts: passes over all confirmed and all unlabelled rows, whose
losses and gradients are summed per partition, then lower the risk of the whole table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold, map_batches, map_rows, read, small

_word = re.compile(r"[^\W\d_]+").findall
STEMS = (3, 4, 5, 6)  # lengths of word beginnings that are features of their own
#: Bounds on the sampled rows that the fit starts from; features and the final passes cover all rows.
POSITIVES = 3_000
UNLABELLED = 9_000
MOST_COUNTED = 200_000  # features that a task counts before it passes its counts on
MOST_BROADCAST = 500_000  # confirmed ids up to which they are sent to every executor
MOST_WORDS, LONGEST_WORD = 100_000, 64  # words whose features a task remembers, and their length in characters
LEAST_POSITIVES = 3  # confirmed texts that must have a feature
SIGNIFICANCE = 15.0  # least G statistic of its enrichment
LEAST_LIFT = 3.0  # share among the confirmed over share among all; in a large table any small difference is significant
SMOOTHING, MOST_RATE = 50, 5.0
STEPS = 300
RATE, DECAY = 0.1, 1e-5
PASSES = 8  # over all rows, at most
ENOUGH = 1e-3  # relative fall of the risk in a pass below which they end


def features(text: str | None) -> set[str]:
    """Distinct lower-case words, marked by =, and beginnings of longer words."""
    if not text:
        return set()
    words = set(_word(text.lower()))
    found = {"=" + w for w in words}
    for n in STEMS:
        found.update([w[:n] for w in words if len(w) > n])
    return found


class Rates:
    """Occurrences per 100 words of the features in ``known``, as if a text had ``SMOOTHING`` words more, up to ``MOST_RATE``.

    A long text holds a word of any kind by chance; only how dense such words are tells the two kinds apart."""

    def __init__(self, known):
        self.known = known
        self.of_word: dict[str, tuple[str, ...]] = {}  # known features of the words met, MOST_WORDS at most

    def __call__(self, text: str | None) -> dict[str, float]:
        words = _word(text.lower()) if text else []
        found: dict[str, float] = {}
        for word, n in Counter(words).items():
            has = self.of_word.get(word)
            if has is None:
                has = self._look_up(word)
            for f in has:
                found[f] = found.get(f, 0) + n
        return {f: min(100.0 * n / (len(words) + SMOOTHING), MOST_RATE) for f, n in sorted(found.items())}

    def _look_up(self, word: str) -> tuple[str, ...]:
        has = tuple(f for f in ("=" + word, *(word[:k] for k in STEMS if len(word) > k)) if f in self.known)
        if len(self.of_word) >= MOST_WORDS:
            self.of_word.clear()
        if len(word) <= LONGEST_WORD:
            self.of_word[word] = has
        return has


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self._rates = Rates(self.weights)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] * x for f, x in self._rates(text).items())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


class SparseRows:
    """Matrix of few values a row, for products with vectors from both sides."""

    __array_ufunc__ = None  # vector @ rows comes here

    def __init__(self, rows: list[tuple[list[int], list[float]]], columns: int):
        self.shape = len(rows), columns
        self.row = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
        self.at = np.fromiter((i for at, _ in rows for i in at), np.int64, len(self.row))
        self.value = np.fromiter((x for _, values in rows for x in values), np.float64, len(self.row))

    def __len__(self) -> int:
        return self.shape[0]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], self.shape[0])

    def __rmatmul__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * x[self.row], self.shape[1])


def non_negative_pu(pos: np.ndarray | SparseRows, unl: np.ndarray | SparseRows, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative PU risk under the logistic loss (Adam over the whole of both samples)."""
    w = np.zeros(pos.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        zp, zu = pos @ w[:-1] + w[-1], unl @ w[:-1] + w[-1]
        sp, su = (1 / (1 + np.exp(-np.clip(z, -50, 50))) for z in (zp, zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_negative = np.append(su @ unl, su.sum()) / len(unl) - prior * np.append(sp @ pos, sp.sum()) / len(pos)
        # below zero the negatives' risk has been overfitted: go back on it alone
        grad = -grad_negative if negative < 0 else prior * np.append((sp - 1) @ pos, (sp - 1).sum()) / len(pos) + grad_negative
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def feature_frequencies(texts: DataFrame) -> DataFrame:
    """(feature, p, u): confirmed rows and all rows of ``texts`` (text, confirmed) that have each feature; '' is in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Counter[str] = Counter()
        u: Counter[str] = Counter()

        def counts() -> pa.RecordBatch:
            found = [pa.array(u.keys(), pa.string()), pa.array([p[f] for f in u], pa.int64()), pa.array(u.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(found, names=["feature", "p", "u"])

        for batch in batches:
            for text, confirmed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = features(text)
                found.add("")
                u.update(found)
                if confirmed:
                    p.update(found)
                if len(u) >= MOST_COUNTED:
                    yield counts()
                    p.clear()
                    u.clear()
        yield counts()

    counted = map_batches(texts.select("text", "confirmed"), run, "feature string, p bigint, u bigint")
    return counted.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def enriched_features(texts: DataFrame) -> list[str]:
    """Features whose share among the confirmed rows of ``texts`` (text, confirmed) is ``LEAST_LIFT`` times that among all
    rows or more, and significantly so (G statistic). Every row counts, and every such feature is in the result."""
    scratch = Scratch(texts.sparkSession)
    both = scratch.save(feature_frequencies(texts).where(F.col("p") >= LEAST_POSITIVES))
    totals = both.where("feature = ''").first()
    if not totals:  # fewer confirmed rows than a feature must have
        scratch.drop(both)
        return []
    n_pos, n_unl = totals["p"], totals["u"]

    share = (F.col("p") + F.col("u")) / float(n_pos + n_unl)
    g = F.lit(0.0)
    for n, total in ((F.col("p"), n_pos), (F.col("u"), n_unl)):
        for cell, expected in ((n, share * total), (total - n, (1 - share) * total)):
            g = g + 2 * F.when(cell > 0, cell * F.log(cell / expected)).otherwise(0.0)
    kept = both.where("feature <> ''").where(F.col("p") / n_pos >= LEAST_LIFT * F.col("u") / n_unl).withColumn("g", g).where(F.col("g") > SIGNIFICANCE)
    found = sorted(r["feature"] for r in kept.select("feature").collect())
    scratch.drop(both)
    return found


def _whole_risk(rows: DataFrame, w: np.ndarray, b: float, prior: float, totals: tuple[int, int]) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative PU risk over all ``rows`` (confirmed, at, rate), its gradient and the diagonal of its curvature."""
    columns = len(w) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, columns))  # gradients and curvatures: confirmed, all
        loss = np.zeros(4)
        for batch in batches:
            at, rate = batch.column("at"), batch.column("rate")
            n = np.diff(at.offsets.to_numpy())
            row, at, rate = np.repeat(np.arange(len(n)), n), at.flatten().to_numpy(), rate.flatten().to_numpy().astype(np.float64)
            z = np.bincount(row, rate * w[at], len(n)) + b
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            confirmed = batch.column("confirmed").to_numpy(zero_copy_only=False).astype(bool)
            for k, x in ((0, confirmed * (p - 1)), (1, confirmed * p), (2, p), (3, p * (1 - p))):
                sums[k, :-1] += np.bincount(at, (rate * rate if k == 3 else rate) * x[row], columns - 1)
                sums[k, -1] += x.sum()
            loss += [np.logaddexp(0, -z)[confirmed].sum(), np.logaddexp(0, z)[confirmed].sum(), np.logaddexp(0, z).sum(), 0.0]
        some = np.flatnonzero(sums.any(axis=0))
        values = np.hstack([sums[:, some], loss[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, columns)), *map(pa.array, values)], names=["i", "a", "b", "c", "d"])

    got = map_batches(rows.select("confirmed", "at", "rate"), run, "i bigint, a double, b double, c double, d double")
    sums = np.zeros((4, columns + 1))
    for i, *values in got.groupBy("i").agg(*(F.sum(c).alias(c) for c in "abcd")).collect():  # a row for each feature
        sums[:, i] = values
    n_pos, n_all = totals
    (pos, pos_as_negative, unlabelled), g = sums[:3, -1], sums[:, :-1]
    negative = unlabelled / n_all - prior * pos_as_negative / n_pos
    grad = prior * g[0] / n_pos
    if negative > 0:
        grad = grad + g[2] / n_all - prior * g[1] / n_pos
    grad[:-1] += DECAY * w
    risk = prior * pos / n_pos + max(0.0, negative) + 0.5 * DECAY * float(w @ w)
    return risk, grad, g[3] / n_all + DECAY + 1e-6


def descend(rows: DataFrame, w: np.ndarray, b: float, prior: float, totals: tuple[int, int], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias after steps down the risk of all ``rows``; a step that would raise it is halved and tried again."""
    now = np.append(w, b)
    risk, grad, curve = _whole_risk(rows, w, b, prior, totals)
    length = 0.5
    for _ in range(passes - 1):
        step = np.clip(length * grad / curve, -0.5, 0.5)
        after, g, c = _whole_risk(rows, (now - step)[:-1], float((now - step)[-1]), prior, totals)
        if after < risk:
            fallen, now, risk, grad, curve = (risk - after) / risk, now - step, after, g, c
            if fallen < ENOUGH:
                break
        else:
            length /= 4
    return now[:-1], float(now[-1])


def least_drawn(rows: DataFrame, total: int, n: int) -> list[tuple[list[int], list[float]]]:
    """(at, rate) of the ``n`` rows of least ``draw`` among the ``total`` ones, all if there are no more.

    Rows above a threshold that leaves about twice as many as wanted stay where they are, and equal ones go once with their
    number, so that what comes to the driver does not grow with the partitions or with one text's repetitions."""
    if 2 * n < total:
        rows = rows.where(F.col("draw") < (2 * n << 64) // total - (1 << 63))
    each = rows.groupBy("draw", "at", "rate").agg(F.count("*").alias("times")).orderBy("draw", "at", "rate").limit(n)
    found: list[tuple[list[int], list[float]]] = []
    for at, rate, times in each.select("at", "rate", "times").collect():
        found += [(at, rate)] * min(times, n - len(found))
    return found


def train_toxicity_model(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicityModel:
    """Fits on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both restricted to what may be learned from.

    The features are those of :func:`enriched_features` over all rows. Their weights start from ``positives`` confirmed
    texts and ``unlabelled`` texts at most, those of least hash of id and text, and are then fitted to all rows, see
    :func:`descend`. A document with several labels is toxic if one says so; every row of a confirmed id is confirmed,
    repeated rows count as often as they are there. Rows without an id are unlabelled, null texts count as empty, other
    columns are ignored. Without confirmed texts, and for empty tables, the model scores every text near zero.
    """
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, labelled = labels.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not toxic:
        return ToxicityModel({}, -10.0)
    prior = min(0.5, toxic / labelled)
    scratch = Scratch(docs.sparkSession)
    confirmed = labels.where("toxic = 1").select("doc_id", F.lit(True).alias("confirmed"))
    marked = docs.select("doc_id", "text").join(small(confirmed, MOST_BROADCAST), "doc_id", "left")
    chosen = enriched_features(marked)
    place = {f: i for i, f in enumerate(chosen)}

    def make():
        rates = Rates(place)

        def run(texts):
            found = list(map(rates, texts))
            return [[place[f] for f in x] for x in found], [list(x.values()) for x in found]

        return run

    marked = marked.select(F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.xxhash64(F.lit("toxic"), "doc_id", "text").alias("draw"), "text")
    rows = scratch.save(map_rows(marked, ("confirmed", "draw"), ("text",), make, "at array<int>, rate array<float>"))
    n_pos, n_all = rows.agg(F.coalesce(F.sum(F.col("confirmed").cast("bigint")), F.lit(0)), F.count("*")).first()
    if not n_pos:  # the confirmed ids are in no row of docs
        return ToxicityModel({}, -10.0)

    w, b = non_negative_pu(
        SparseRows(least_drawn(rows.where("confirmed"), n_pos, positives), len(chosen)),
        SparseRows(least_drawn(rows, n_all, unlabelled), len(chosen)),
        prior,
    )
    w, b = descend(rows, w, b, prior, (n_pos, n_all))
    scratch.drop(rows)
    return ToxicityModel(dict(zip(chosen, w.tolist())), b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score (0 to 1) for every row of ``docs`` (text), from its whole text.

    Null counts as empty, repeated rows stay, other columns are dropped, an empty table gives no rows.
    """

    def make():
        return lambda texts: [list(map(model.score, texts))]

    return map_rows(docs, keep, ("text",), make, "score double")


def training_part(rows: DataFrame) -> DataFrame:
    """Rows that may be learned from; a row without an id is not one."""
    return rows.where(fold(F.col("doc_id"), 3) != 1)


#: Documents with this score or more count as toxic.
THRESHOLD = 0.7


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train_toxicity_model(training_part(docs), training_part(read(spark, sf_dir, "labels")))
    out = score_toxicity(docs, model)
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
