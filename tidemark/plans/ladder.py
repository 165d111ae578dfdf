"""The leakage ladder: one model, trained with one more careless step at each rung, and its honest counterpart."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import HISTORY, LABEL_COUNTS, LABEL_FEATURES, PIT_FEATURES, derive
from ..operators import dataset, decide, leaky
from ..operators.pit import pit_features
from ..operators.scratch import discard, saved
from . import boosting

FILES_A_CORE = 2  # of the rows that a model is fitted to: equal ones, so that no core waits for another in a pass
ABSENT = -1.0  # stands for null, which the trees cannot take


@dataclass
class Model:
    """A fitted pipeline, the columns that it reads, the log odds it starts from and its rounds of boosting.

    ``history``: (rounds, AUC of the stop rows) after every stage that was tried.
    """

    pipeline: PipelineModel
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    start: float = 0.0
    rounds: int = 0
    history: tuple[tuple[int, float | None], ...] = ()

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with score, the probability of fraud. Values of a category that training did not have, and nulls,
        share one code."""
        out = self.pipeline.transform(filled(rows, self.numeric))
        return out.drop("features", "margin", *(f"{c}_index" for c in self.categorical))

    def save(self, path: str) -> None:
        """The pipeline and a JSON file of its columns below ``path``, in place of what was there."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        columns = json.dumps({"numeric": self.numeric, "categorical": self.categorical, "start": self.start, "rounds": self.rounds, "history": self.history})
        _session().createDataFrame([(columns,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        own = json.loads(spark.read.text(f"{path}/columns").first()["value"])
        history = tuple((n, auc) for n, auc in own["history"])
        return cls(PipelineModel.load(f"{path}/pipeline"), tuple(own["numeric"]), tuple(own["categorical"]), own["start"], own["rounds"], history)

    def boosted(self) -> boosting.Boosted:
        trees = [t for stage in self.pipeline.stages if isinstance(stage, GBTRegressionModel) for t in boosting.trees_of(stage)]
        return boosting.Boosted(self.start, trees, list(self.history))


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def category_codes(train: DataFrame, categorical: tuple[str, ...]) -> Pipeline:
    """Stages that code each category of ``train`` by frequency, then by name; all else gets the code after the last."""
    return Pipeline(stages=[StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="frequencyDesc") for c in categorical]).fit(train)


def fit(train: DataFrame, stop: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...] = (), trees: int = boosting.MOST_ROUNDS, patience: int = boosting.PATIENCE, seed: int = 42, so_far: Model | None = None) -> Model:
    """Boosted trees on ``numeric`` and ``categorical`` columns, as many rounds, ``trees`` at most, as the AUC of the rows of
    ``stop`` says. Codes of categories come from ``train`` alone. ``so_far``, a model fitted or loaded before, is continued
    with its own columns and codes."""
    if so_far is not None:
        numeric, categorical = so_far.numeric, so_far.categorical
        codes = [s for s in so_far.pipeline.stages if hasattr(s, "labels")]
    else:
        codes = category_codes(train, categorical).stages
    rows = train.withColumn("stop", F.lit(False)).unionByName(stop.withColumn("stop", F.lit(True)))
    assembler = VectorAssembler(inputCols=[*numeric, *(f"{c}_index" for c in categorical)], outputCol="features")
    features = PipelineModel([*codes, assembler]).transform(filled(rows, numeric)).select("features", "isFraud", "stop")
    features = saved(features.repartition(FILES_A_CORE * _session().sparkContext.defaultParallelism))
    bins = max([boosting.BINS, *(len(c.labels) + 1 for c in codes)])  # a category needs a bin for each of its codes
    model = boosting.boost(features, so_far.boosted() if so_far else None, trees, patience, bins, seed)
    discard(features)
    trained = model.ensemble()
    margin = "margin" if trained is not None else "0"
    score = SQLTransformer(statement=f"SELECT *, 1 / (1 + exp(-({model.start!r}D + {margin}))) AS score FROM __THIS__")
    return Model(PipelineModel([*codes, assembler, *([trained] if trained is not None else []), score]), tuple(numeric), tuple(categorical), model.start, model.rounds, tuple(model.history))


def filled(rows: DataFrame, numeric: tuple[str, ...]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(ABSENT)) for c in numeric})


def run_variant(name: str, rows: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...] = (), trees: int = boosting.MOST_ROUNDS, tests: tuple[str, ...] = ("test",)) -> DataFrame:
    """A row of metrics, with the rounds kept and tried, for each ``part`` of ``tests``: one model, fitted to the rows whose
    ``part`` is train or stop, judged on each. Test rows are scored once, for their totals per score."""
    rows = saved(rows.select("TransactionID", "isFraud", "cents", "part", *numeric, *categorical))
    model = fit(rows.where("part = 'train'"), rows.where("part = 'stop'"), numeric, categorical, trees)
    per = saved(decide.score_totals(model.score(rows.where(F.col("part").isin(*tests))), ("part",)))
    counts = lambda part: rows.agg(F.sum((F.col("part") == part).cast("bigint")).alias("test_rows"), F.sum(F.col("part").isin("train", "stop").cast("bigint")).alias("train_rows"))
    out = []
    for part in tests:
        own = per.where(F.col("part") == part).drop("part")
        metrics = decide.roc_auc_of(own).crossJoin(F.broadcast(decide.average_precision_of(own)))  # a row each
        out.append(metrics.crossJoin(F.broadcast(counts(part))).select(
            F.lit(name).alias("variant"), "roc_auc", "pr_auc", "test_rows", "train_rows", F.lit(model.rounds).alias("rounds"), F.lit(model.history[-1][0]).alias("rounds_tried"), F.lit(part).alias("part")
        ))
    return _union(out)


def _time_parts(periods: DataFrame, only_mature: bool = False) -> DataFrame:
    """Development rows of ``periods`` (rows with period), with part: train and stop from the train period, test from the
    valid period."""
    periods = periods.where("period <> 'holdout'")
    valid = periods.where("period = 'valid'")
    train = periods.where("period = 'train'")
    if only_mature:
        train = dataset.mature(periods, "train", valid.agg(F.min("TransactionDT").alias("cutoff")))
    return dataset.time_ordered_split(train).unionByName(valid.withColumn("part", F.lit("test")))


def leaky_rungs(tx: DataFrame, base: tuple[str, ...]) -> Iterator[tuple[str, DataFrame, tuple[str, ...]]]:
    """(name, rows with part, columns): time split; random split; card aggregates over all rows; card fraud rate over all rows."""
    periods = saved(dataset.assign_period(tx))
    shuffled = dataset.random_split(periods.where("period <> 'holdout'"))
    aggregates = leaky.global_aggregates(shuffled)
    yield "time_split_base", _time_parts(periods), base
    yield "random_base", shuffled, base
    yield "random_global_aggs", aggregates, (*base, *leaky.GLOBAL_AGGREGATES)
    yield "random_target_enc", leaky.target_encoding(aggregates), (*base, *leaky.GLOBAL_AGGREGATES, *leaky.TARGET_ENCODING)


def honest_rungs(tx: DataFrame, base: tuple[str, ...]) -> Iterator[tuple[str, DataFrame, tuple[str, ...]]]:
    """(name, rows with part, columns): base on mature rows; history, instant labels, all rows; history, delayed labels, mature rows."""
    history = lambda **k: pit_features(tx, **k).drop("TransactionDT", "TransactionAmt", "card_id")
    columns = (*base, *PIT_FEATURES, *LABEL_FEATURES)
    periods = saved(dataset.assign_period(tx))
    yield "base_mature", _time_parts(periods, True), base
    yield "pit_instant_labels", _time_parts(periods).join(history(instant_labels=True), "TransactionID"), columns
    yield "pit_honest", _time_parts(periods, True).join(history(), "TransactionID"), columns


def leakage_ladder(tx: DataFrame, base: tuple[str, ...], trees: int = boosting.MOST_ROUNDS, categorical: tuple[str, ...] = ()) -> DataFrame:
    """A row of metrics for each of :func:`leaky_rungs`; every rung has the ``categorical`` columns too."""
    return _union([run_variant(*rung, categorical, trees) for rung in leaky_rungs(tx, base)]).drop("part")


def honest_ladder(tx: DataFrame, base: tuple[str, ...], trees: int = boosting.MOST_ROUNDS, categorical: tuple[str, ...] = ()) -> DataFrame:
    """A row of metrics for each of :func:`honest_rungs`; every rung has the ``categorical`` columns too."""
    return _union([run_variant(*rung, categorical, trees) for rung in honest_rungs(tx, base)]).drop("part")


def _before_and_from(history: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``history`` before and from the time in the one-row table ``start`` (cutoff) on; all are before if it has none."""
    placed = dataset.with_scalar(history, start)
    live = F.coalesce(F.col("TransactionDT") >= F.col("cutoff"), F.lit(False))
    return placed.where(~live).drop("cutoff"), placed.where(live).drop("cutoff")


@dataclass
class ScoredSets:
    """Rows (isFraud, cents, score) that choose the thresholds of each model, and the holdout with both scores."""

    honest: DataFrame
    careless: DataFrame
    holdout: DataFrame


def scored_sets(tx: DataFrame, base: tuple[str, ...], trees: int = boosting.MOST_ROUNDS, known_after: float = dataset.LEGIT_DELAY * dataset.DAY, categorical: tuple[str, ...] = ()) -> ScoredSets:
    """What thresholds, drift and daily reports are made of.

    The honest model is fitted to mature rows of the train period and chooses on those of the valid period for which
    both classes could be labelled when the holdout begins: ``known_after`` seconds, when the slowest labels have come.
    The careless one chooses on its random test rows. The holdout has features as they can be served.
    """
    leaks = (*leaky.GLOBAL_AGGREGATES, *leaky.TARGET_ENCODING)
    columns, rows, start = _table_of_sets(tx, base, categorical)
    honest_model, choosing, live = _honest(columns, rows, start, base, trees, known_after, categorical)
    careless = leaky.from_totals(dataset.random_split(rows.where("period <> 'holdout'"))).select("part", *columns, *leaks)
    careless_model = fit(_part(careless, "train"), _part(careless, "stop"), (*base, *leaks), categorical, trees)
    scored = honest_model.score(live).withColumnRenamed("score", "score_honest")
    # the two models know some features by one name
    asked = scored.select(F.struct(*columns, *HONEST, "score_honest").alias("_row"), *{"TransactionAmt", "cents", *base, *categorical, *_SERVED})
    scored = careless_model.score(leaky.served_aggregates(asked)).select("_row.*", F.col("score").alias("score_naive"))
    return ScoredSets(saved(honest_model.score(choosing)), saved(careless_model.score(_part(careless, "test"))), saved(scored))


def honest_inputs(tx: DataFrame, base: tuple[str, ...], trees: int = boosting.MOST_ROUNDS, known_after: float = dataset.LEGIT_DELAY * dataset.DAY, categorical: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Selection rows and holdout of the honest model of :func:`scored_sets`: score_honest and every column that the model
    reads, nulls as they are. Nothing here depends on the careless model, so it is not fitted."""
    columns, rows, start = _table_of_sets(tx, base, categorical)
    model, *sets = _honest(columns, rows, start, base, trees, known_after, categorical)
    inputs = (*model.numeric, *model.categorical)
    known = lambda rows: rows.select(*inputs, F.struct(*inputs).alias("_inputs"))  # noqa: E731  a score fills nulls
    selection, holdout = (saved(model.score(known(rows)).select("_inputs.*", F.col("score").alias("score_honest"))) for rows in sets)
    return selection, holdout


def _table_of_sets(tx: DataFrame, base: tuple[str, ...], categorical: tuple[str, ...]) -> tuple[tuple[str, ...], DataFrame, DataFrame]:
    """The columns that stay with a row, the rows of :func:`_set_rows`, and the time at which the holdout begins."""
    own = ("TransactionID", "TransactionDT", "label_available_at", "isFraud", "cents")
    columns = (*own, *(c for c in (*base, *categorical) if c not in own))
    rows = saved(_set_rows(dataset.assign_period(tx), columns))
    return columns, rows, saved(rows.where("period = 'holdout'").agg(F.min("TransactionDT").alias("cutoff")))  # one row


def _honest(columns: tuple[str, ...], rows: DataFrame, start: DataFrame, base: tuple[str, ...], trees: int, known_after: float, categorical: tuple[str, ...]) -> tuple[Model, DataFrame, DataFrame]:
    """The honest model of :func:`scored_sets`, the rows that it chooses on and the holdout, neither scored."""
    known = rows.withColumns(derive(F.col("TransactionDT"), F.col("TransactionAmt")))
    honest = _time_parts(known, True).select("part", *columns, *HONEST)
    model = fit(_part(honest, "train"), _part(honest, "stop"), (*base, *HONEST), categorical, trees)
    choosing = dataset.with_scalar(_part(honest, "test"), start).where(F.col("TransactionDT") <= F.col("cutoff") - known_after).drop("cutoff")
    return model, choosing, known.where("period = 'holdout'")


def _part(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("part") == name).drop("part")


HONEST = (*PIT_FEATURES, *LABEL_FEATURES)  # what the honest model knows beyond the base columns
_SERVED = ("card_cnt_all", "card_cents_all", "card_squares_all", *LABEL_COUNTS)  # of which served_aggregates makes what is served


def _set_rows(periods: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of ``periods`` with ``columns``, period, what the history features derive from, on development rows a card's
    totals over all of them, and on live rows the exact sums of the history. Rows are shuffled once, by card."""
    dev, live = F.col("period") != "holdout", F.col("period") == "holdout"
    totals = leaky.card_totals(dev)
    rows = pit_features(periods, sums=True, keep=("period", *columns), per_card=totals)
    only = {**{c: F.when(dev, F.col(c)) for c in totals}, **{c: F.when(live, F.col(c)) for c in ("card_cents_all", "card_squares_all")}}
    rows = rows.withColumns(only)
    return rows.select("period", *dict.fromkeys((*columns, "TransactionAmt", *(f.name for f in HISTORY), *LABEL_COUNTS, *only)))


def headline(tx: DataFrame, base: tuple[str, ...], trees: int = boosting.MOST_ROUNDS, categorical: tuple[str, ...] = ()) -> DataFrame:
    """(model, roc_auc_offline, roc_auc_live, roc_auc_gap, the same for pr_auc, rounds_offline, rounds_live) of the careless
    and the honest model.

    Offline is what each promised on development rows. Live is the holdout, with features as they can be served there:
    the careless model gets its aggregates from history and arrived labels alone. Raises if a live row has no features.
    """
    extra = (*PIT_FEATURES, *LABEL_FEATURES)
    leaks = (*leaky.GLOBAL_AGGREGATES, *leaky.TARGET_ENCODING)
    periods = saved(dataset.assign_period(tx))
    dev, holdout = periods.where("period <> 'holdout'"), periods.where("period = 'holdout'").withColumn("part", F.lit("test"))
    start = saved(holdout.agg(F.min("TransactionDT").alias("cutoff")))  # one row
    history = saved(pit_features(periods, sums=True))
    past, now = _before_and_from(history, start)
    served = leaky.served_aggregates(now).select("TransactionID", *leaks)
    known, known_live = past.select("TransactionID", *extra), now.select("TransactionID", *extra)
    if holdout.join(now, "TransactionID", "left_anti").limit(1).count():
        raise ValueError("live rows without features")
    careless = leaky.target_encoding(leaky.global_aggregates(dataset.random_split(dev)))
    mature = dataset.with_scalar(dev, start).where("label_available_at <= cutoff").drop("cutoff")
    honest = dataset.time_ordered_split(mature).join(known, "TransactionID")
    columns = ("TransactionID", "isFraud", "cents", "part", *base, *categorical)
    seen_live = lambda features, extra: holdout.join(features, "TransactionID").select(*columns, *extra)
    # the careless model of both is fitted to the same rows, so there is one; the honest one learns more before it goes live
    naive = careless.select(*columns, *leaks).unionByName(seen_live(served, leaks).withColumn("part", F.lit("live")))
    runs = [
        run_variant("naive", naive, (*base, *leaks), categorical, trees, ("test", "live")),
        run_variant("honest", _time_parts(periods, True).join(known, "TransactionID"), (*base, *extra), categorical, trees),
        run_variant("honest", honest.where("part <> 'test'").select(*columns, *extra).unionByName(seen_live(known_live, extra)), (*base, *extra), categorical, trees).withColumn("part", F.lit("live")),
    ]
    rows = _union(runs).withColumn("seen", F.when(F.col("part") == "live", "live").otherwise("offline"))
    out = rows.groupBy(F.col("variant").alias("model")).agg(*(F.max(F.when(F.col("seen") == seen, F.col(m))).alias(f"{m}_{seen}") for m in ("roc_auc", "pr_auc", "rounds") for seen in ("offline", "live")))
    return out.withColumns({f"{m}_gap": F.bround(F.col(f"{m}_offline") - F.col(f"{m}_live"), 4) for m in ("roc_auc", "pr_auc")})


def _union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def log_runs(metrics: DataFrame, path: str, experiment: str) -> None:
    """Appends metrics to the table of runs at ``path``."""
    metrics.withColumns({"experiment": F.lit(experiment), "logged_at": F.current_timestamp()}).write.mode("append").parquet(path)
