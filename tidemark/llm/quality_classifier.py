"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

The statistics of each whole text are standardised by the mean and deviation over all documents. Random cosines of
them approximate a Gaussian kernel. Each partition sums its part of the normal equations, Spark adds the parts, and
the driver solves one small system. Training rows that the regression did not see give the isotonic calibration.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold, map_batches, map_rows, read

STATISTICS = (
    "log_words", "log_chars", "word_length", "upper", "digit", "space", "comma_stop", "symbol", "exclamation", "bar",
    "other_ascii", "non_ascii", "shouted_words", "distinct_words", "distinct_pairs", "top_word", "log_lines", "line_words",
    "distinct_lines", "marked_words", "symbol_words",
)
COSINES = 256
WIDTH = 3.0  # of the kernel, in deviations of a statistic
RIDGE = 1e-2
SEED = 4
CALIBRATION_PART = 4  # one training row in so many calibrates
BINS = 4096

_CLASS = np.zeros(256, np.int64)
for _name, _bytes in enumerate((b"", bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c", b".,;:", b"#*$%&<>", b"!", b"|"), 0):
    _CLASS[list(_bytes)] = _name
_CLASS[128:] = 8
for _b in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
    if _CLASS[_b] == 0:
        _CLASS[_b] = 9
_PUNCTUATION = ".,;:!?\"'()"
_SYMBOLS = "#*$%&|<>"


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for a whole text; null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_CLASS[raw], minlength=10) / max(len(raw), 1)
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    shouted = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in _PUNCTUATION)
    bare = sum(c for w, c in counts.items() if w[0] in _SYMBOLS)
    return [
        np.log1p(len(words)), np.log1p(len(text)), min(sum(len(w) * c for w, c in counts.items()) / n, 100.0), *share[1:4], share[4], share[5], share[6], share[7],
        share[9], share[8], shouted / n, len(counts) / n, pairs / max(len(words) - 1, 1) if len(words) > 1 else 1.0, max(counts.values(), default=0) / n,
        np.log1p(len(lines)), np.log1p(n / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), marked / n, bare / n,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray  # of the cosines, then the constant
    knots: np.ndarray  # raw scores and their calibrated values
    values: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(x.shape[1], COSINES)) / WIDTH
        phase = rng.uniform(0, 2 * np.pi, COSINES)
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ w + phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def document_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and x array<double>, the statistics of text."""

    def make():
        return lambda texts: [[statistics(t) for t in texts]]

    return map_rows(docs, keep, ("text",), make, "x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over ``rows`` (x, y): one sum per partition, added up per cell."""
    size = COSINES + 1
    upper = np.triu_indices(size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            z = np.hstack([model.cosines(_matrix(batch)), batch.column("y").to_numpy()[:, None]])
            total += z.T @ z
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], names=["cell", "v"])

    cells = map_batches(rows.select("x", F.col("y").cast("double")), run, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    table = cells.toPandas().set_index("cell")["v"].reindex(range(len(upper[0])), fill_value=0.0).to_numpy()
    full = np.zeros((size + 1, size + 1))
    full[upper] = table
    full = full + np.triu(full, 1).T
    return full[:size, :size], full[:size, size]


def _isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit to means ``y`` at ``x`` with counts ``n``: pooled blocks at their mean places."""
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, b, c in zip(x, y, n):
        blocks.append([b * c, c, a * c])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def train_quality_model(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fits on ``stats`` (doc_id, x) of all documents and ``labels`` (doc_id, quality) that may be learned from.

    All labelled rows count. A document with several labels has their mean. Without labels every score is one half;
    with a single class every score is that class.
    """
    dims = range(len(STATISTICS))
    moments = stats.agg(*(F.avg(F.col("x")[i]) for i in dims), *(F.stddev_pop(F.col("x")[i]) for i in dims)).first()
    got = np.array([0.0 if v is None else v for v in moments])
    deviation = got[len(STATISTICS) :]
    model = QualityModel(got[: len(STATISTICS)], np.where(deviation > 1e-9, deviation, 1.0), np.zeros(COSINES + 1), np.array([0.0]), np.array([0.5]))
    labels = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    rows = stats.join(labels, "doc_id").withColumn("part", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(CALIBRATION_PART)))
    gram, right = _normal_equations(rows.where("part <> 0"), model)
    n = gram[-1, -1]
    if not n:
        return model
    model.weights = np.linalg.solve(gram + RIDGE * np.eye(len(gram)) * max(1.0, n / 1000), right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch)), -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor((raw + 1) / 3 * (BINS - 1)).astype(np.int64)), pa.array(raw), batch.column("y")], names=["bin", "raw", "y"])

    scored = map_batches(rows.where("part = 0").select("x", "y"), run, "bin bigint, raw double, y double")
    bins = scored.groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    if len(bins):
        model.knots, model.values = _isotonic(bins["raw"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(float))
    else:  # too few rows to calibrate
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_quality(stats: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score for every row of ``stats`` (x)."""

    def make():
        return lambda x: [model.score(np.array(x).reshape(len(x), len(STATISTICS)))]

    return map_rows(stats, keep, ("x",), make, "score double")


THRESHOLD = 0.7


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Scratch(spark).save(document_statistics(read(spark, sf_dir, "documents")))
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    out = score_quality(stats, train_quality_model(stats, labels))
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
