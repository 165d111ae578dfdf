"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all training texts. The weights are learned by follow-the-regularised-leader with an
elastic net on a bounded sample per language. A part of the sample that the weights never saw, as whole texts and as
pieces of a few words, sets the strength of the L1 penalty, the largest that costs little there, and the temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold, map_batches, map_rows, read

BITS = 15
SIZE = 1 << BITS
ORDERS = (1, 2, 3)
#: Sampled training documents per language: the bound on what the fit sees.
DOCS_PER_LANGUAGE = 500
EPOCHS = 3
BATCH = 16
RATE, BETA, L2 = 0.5, 1.0, 1e-5
L1 = (0.01, 0.03, 0.1, 0.3, 1.0)  # tried in this order
COSTS_LITTLE = 1.1, 0.01  # factor and addition to the least loss within which a stronger penalty is taken
PIECES = (1, 2, 4, 8)  # words
TEMPERATURES = tuple(np.geomspace(0.005, 20, 140).tolist())
CALIBRATION_PART = 5  # one sampled document in so many
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """True for the code points of letters; built once a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of lower-case letters, other characters as one space between; None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return None
    keep = letter | np.append(True, letter[:-1])
    points = np.where(letter, points, 32)[keep].astype(np.uint32)
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    counts = np.zeros(SIZE, np.int64)
    hashed = np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        hashed = hashed[: len(points) - n + 1] * np.uint32(0x9E3779B1) + (points[n - 1 :] + np.uint32(n))
        if n in ORDERS:
            mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            counts += np.bincount(mixed >> np.uint32(32 - BITS), minlength=SIZE)
    return counts


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the unit vector of log counts times idf."""
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / norm if norm > 0 else value


@dataclass
class LanguageModel:
    """``slot`` holds the row of ``weights`` of each gram; grams whose weights are all zero share the last, a zero row."""

    languages: list[str]
    idf: np.ndarray
    slot: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        at, value = tf_idf(counts, self.idf)
        p = _softmax((value @ self.weights[self.slot[at]] + self.bias) / self.temperature)
        best = int(p.argmax())  # ties go to the first language by code point
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _follow_the_leader(rows, y: np.ndarray, classes: int, l1: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after EPOCHS passes of FTRL-proximal with elastic-net penalties over mini-batches."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))
    rng = np.random.default_rng(seed)

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - np.where(at == SIZE, 0.0, l1)[:, None], 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / RATE + L2)

    bias = np.array([SIZE])
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            at = np.unique(np.concatenate([bias, *(rows[i][0] for i in batch)]))
            x = np.zeros((len(batch), len(at)))
            for r, i in enumerate(batch):
                x[r, np.searchsorted(at, rows[i][0])] = rows[i][1]
            x[:, -1] = 1.0  # the bias has the largest position
            w = weights(at)
            error = _softmax(x @ w)
            error[np.arange(len(batch)), y[batch]] -= 1
            g = x.T @ error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) * RATE**-1 * w
            n[at] += g * g
    w = weights(np.arange(SIZE + 1))
    return w[:SIZE], w[SIZE]


def _temperature(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature of least negative log likelihood on a grid, and that loss (both under a standard normal prior of
    the temperature's logarithm, so that a few right answers do not make the model sure without limit)."""
    if not len(y):
        return 1.0, 0.0
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-300)).mean() + np.log(t) ** 2 / 2 / len(y) for t in TEMPERATURES]
    best = int(np.argmin(loss))
    return TEMPERATURES[best], float(loss[best])


def pieces(text: str) -> list[str]:
    """Runs of PIECES words from the middle of a text that has more."""
    words = text.split()
    return [" ".join(words[len(words) // 2 :][:n]) for n in PIECES if len(words) > 2 * n]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each hashed n-gram, and documents with letters, over every row of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = gram_counts(text)
                if counts is not None:
                    seen += counts > 0
                    docs += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, SIZE)), pa.array(np.append(seen[at], docs))], names=["gram", "n"])

    sums = map_batches(texts.select("text"), run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    found = np.zeros(SIZE + 1, np.int64)
    for gram, n in sums.collect():  # SIZE + 1 rows at most
        found[gram] = n
    return found[:SIZE], int(found[SIZE])


def train_language_model(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, seed: int = 9) -> LanguageModel:
    """Fits on ``docs`` (doc_id, text, lang): rows with a null lang are left out.

    The sample has at most ``docs_per_language`` rows of each language, those of least hash of id and text, so all of a
    rare language is used; repeated rows hash alike and count against the bound. Null texts and texts without letters
    teach nothing. Other columns are ignored. No rows: a model without languages, which answers 'und'. The driver holds
    SIZE weights a language, about half a megabyte.
    """
    docs = docs.where("lang is not null").select("doc_id", "text", "lang")
    per = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(per)
    empty = LanguageModel(languages, np.ones(SIZE, np.float32), np.zeros(SIZE, np.int32), np.zeros((1, len(languages)), np.float32), np.zeros(len(languages)), 1.0)
    if not languages:
        return empty
    seen, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + seen)) + 1
    # somewhat more rows than wanted pass the threshold, then the bound is exact
    rate = F.element_at(F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, 1.3 * docs_per_language / per[k])))), F.col("lang"))
    drawn = docs.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40))).where(F.col("draw") / float(1 << 40) < rate)
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id"))
    held = F.pmod(F.col("draw"), F.lit(CALIBRATION_PART)) == 0
    drawn = drawn.withColumn("place", place).where(F.col("place") <= docs_per_language).select("doc_id", "lang", "draw", held.alias("held"), F.when(held, "text").alias("held_text"), "text")

    def make():
        def vector(text):
            counts = gram_counts(text)
            return None if counts is None else tf_idf(counts, idf)

        def run(texts, held):
            found = [[v for v in map(vector, [t or "", *pieces(h or "")]) if v is not None] for t, h in zip(texts, held)]
            return [[v[0] for v in row] for row in found], [[v[1].astype(np.float32) for v in row] for row in found]

        return run

    spread = drawn.repartition(docs.sparkSession.sparkContext.defaultParallelism, "draw")
    sample = map_rows(spread, ("lang", "draw", "held"), ("text", "held_text"), make, "at array<array<int>>, value array<array<float>>")
    table = sample.orderBy("draw", "lang").toArrow()  # docs_per_language of each language at most; as Python lists it would be ten times as large
    parts: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}
    for lang, held, *row in zip(*(table.column(c) for c in ("lang", "held", "at", "value"))):
        for at, value in zip(*(x.values for x in row)):
            parts[held.as_py()][0].append((at.values.to_numpy().astype(np.int64), value.values.to_numpy().astype(np.float64)))
            parts[held.as_py()][1].append(languages.index(lang.as_py()))
    train, y = parts[False][0], np.array(parts[False][1], int)
    tune, tune_y = parts[True][0], np.array(parts[True][1], int)
    if not len(y):
        train, y = tune, tune_y
    if not len(y):
        return empty
    fits = []
    for l1 in L1:
        w, b = _follow_the_leader(train, y, len(languages), l1, seed)
        temperature, loss = _temperature(np.array([v @ w[at] + b for at, v in tune]), tune_y)
        fits.append((loss, w, b, temperature))
    most = min(f[0] for f in fits) * COSTS_LITTLE[0] + COSTS_LITTLE[1]
    _, w, b, temperature = [f for f in fits if f[0] <= most][-1 if len(tune_y) else 0]
    used = np.flatnonzero((w != 0).any(axis=1))
    slot = np.full(SIZE, len(used), np.int32)
    slot[used] = np.arange(len(used))
    return LanguageModel(languages, idf.astype(np.float32), slot, np.vstack([w[used], np.zeros((1, len(languages)))]).astype(np.float32), b, temperature)


def identify_language(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score for every row of ``docs`` (text), from its whole text.

    'und' with score 0 for a null text, a text without a letter, or a model without languages. Repeated rows stay,
    other columns are dropped, an empty table gives no rows.
    """

    def make():
        return lambda texts: list(zip(*map(model.predict, texts))) or [[], []]

    return map_rows(docs, keep, ("text",), make, "lang_pred string, score double")


def training_part(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from; a row without an id is not one."""
    return docs.where(fold(F.col("doc_id"), 3) != 1)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train_language_model(training_part(docs))
    out = identify_language(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
