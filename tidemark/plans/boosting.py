"""Boosted trees in stages: each stage is a few Spark jobs over rows that carry their margin, and starts from any earlier model.

A stage fits the second-order expansion of the log loss at the current margins: with p the probability, the target is
(y - p) / (p (1 - p)), weighted by p (1 - p), so a leaf's weighted mean is its Newton step. The trees of a stage are
grown side by side as one forest on different rows and columns, which takes as many passes over the data as one tree is
deep, then each is added with the step size. Rows are written with their new margins after every stage, so no plan grows
with the number of stages and a lost executor costs only its tasks; after the last one only the margins of the stop rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decide
from ..operators.scratch import discard, saved

STEP = 0.05  # of a tree
LEAST_LEAF_ROWS = 100
DEPTH = 5
BINS = 64
SIDE_BY_SIDE = 10  # trees of a stage
MOST_ROUNDS = 2_000
PATIENCE = 50  # rounds without a better AUC on the stop rows
LEAST_WEIGHT = 1e-6


@dataclass
class Boosted:
    """Trees in the order they were added, each with weight STEP, on top of the log odds ``start``.

    ``history``: (rounds, AUC of the stop rows) after every stage tried, the first without trees; ``rounds`` of them are kept.
    """

    start: float
    trees: list = field(default_factory=list)
    history: list[tuple[int, float | None]] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return len(self.trees)

    def ensemble(self, features: str = "features", margin: str = "margin") -> GBTRegressionModel | None:
        """The sum of the trees as one model of Spark's, which is saved and loaded with the pipeline it is part of."""
        if not self.trees:
            return None
        model = _ensemble(self.trees, [STEP] * len(self.trees))
        return model.setFeaturesCol(features).setPredictionCol(margin)


def _ensemble(trees: list, weights: list[float]) -> GBTRegressionModel:
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    array = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    numbers = sc._gateway.new_array(sc._jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        array[i], numbers[i] = tree._java_obj, weight
    uid = sc._jvm.org.apache.spark.ml.util.Identifiable.randomUID("boosted")
    return GBTRegressionModel(sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, array, numbers))


def trees_of(model: GBTRegressionModel) -> list[DecisionTreeRegressionModel]:
    return [DecisionTreeRegressionModel(t) for t in model._java_obj.trees()]


def boost(rows: DataFrame, so_far: Boosted | None = None, rounds: int = MOST_ROUNDS, patience: int = PATIENCE, bins: int = BINS, seed: int = 42) -> Boosted:
    """Trees fitted to ``rows`` (features, isFraud, stop): those with stop choose the number of rounds by their AUC.

    ``so_far`` is continued: its trees come first and count among ``rounds``. The rounds kept are those of the best AUC,
    the fewest if several have it; ``patience`` rounds without a better one end the search. Without both classes among
    the stop rows nothing can be told apart: ``patience`` rounds are fitted and kept. Without both classes among the
    others there are no trees, and the score is their rate (one half without rows).
    """
    n, positive = rows.where("not stop").agg(F.count("isFraud"), F.coalesce(F.sum("isFraud"), F.lit(0))).first()
    if so_far is None:
        rate = min(max(positive / n, LEAST_WEIGHT), 1 - LEAST_WEIGHT) if n else 0.5
        so_far = Boosted(math.log(rate / (1 - rate)))
    trees, start = list(so_far.trees), so_far.start
    if not n or positive in (0, n):
        return Boosted(start, trees, [(len(trees), None)])
    fresh = rows.select("features", "isFraud", "stop", F.lit(start).alias("margin"))
    now = saved(_add(fresh, trees)) if trees else None
    margins = fresh if now is None else now  # without trees, all have the same margin and nothing is written
    best, kept = _auc(margins), len(trees)
    history = [(len(trees), best)]
    judged = best is not None
    while len(trees) < rounds and len(trees) - kept < patience:
        stage = _stage(margins, min(SIDE_BY_SIDE, rounds - len(trees)), bins, seed + len(trees))
        trees += stage
        added, before = _add(margins, stage), now
        if len(trees) >= rounds:  # nothing is fitted to the last margins, only the stop rows are judged
            added = added.where("stop").select("margin", "isFraud", "stop")
        now = saved(added)
        if before is not None:
            discard(before)
        margins = now
        auc = _auc(now) if judged else None
        history.append((len(trees), auc))
        if auc is not None and auc > best:
            best, kept = auc, len(trees)
    if now is not None:
        discard(now)
    return Boosted(start, trees[:kept] if judged else trees, history)


def _add(rows: DataFrame, trees: list) -> DataFrame:
    """``rows`` with the trees added to their margins."""
    if not trees:
        return rows
    added = _ensemble(trees, [STEP] * len(trees)).setFeaturesCol("features").setPredictionCol("_added").transform(rows)
    return added.withColumn("margin", F.col("margin") + F.col("_added")).drop("_added")


def _stage(rows: DataFrame, trees: int, bins: int, seed: int) -> list[DecisionTreeRegressionModel]:
    p = 1 / (1 + F.exp(-F.col("margin")))
    weight = F.greatest(p * (1 - p), F.lit(LEAST_WEIGHT))
    target = rows.where("not stop").select("features", weight.alias("weight"), ((F.col("isFraud") - p) / weight).alias("target"))
    forest = RandomForestRegressor(
        labelCol="target", weightCol="weight", numTrees=trees, maxDepth=DEPTH, minInstancesPerNode=LEAST_LEAF_ROWS, maxBins=bins,
        subsamplingRate=0.8, bootstrap=False, featureSubsetStrategy="0.5", seed=seed,
    )
    target.persist()  # a fit passes over its rows three times before it keeps its own copy
    try:
        return [DecisionTreeRegressionModel(t) for t in forest.fit(target)._java_obj.trees()]
    finally:
        target.unpersist()


def _auc(rows: DataFrame) -> float | None:
    return decide.roc_auc(rows.where("stop").select(F.col("margin").alias("score"), "isFraud", F.lit(0).cast("bigint").alias("cents"))).first()["roc_auc"]
