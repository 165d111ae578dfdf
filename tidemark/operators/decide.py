"""Alert thresholds chosen by cost, ranking metrics, and the policies that follow from them.

A missed fraud costs its amount, an alert costs a review. Rows are counted per distinct score before anything is
ordered, and running totals over the scores are taken range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import place, running_before, with_scalar
from .scratch import saved

REVIEW_COST = 5.0
MOST_POLICIES = 10_000  # sent to every executor


def score_totals(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(score, n, pos, fraud_cents) per distinct score, null included, and per group of the columns ``by``: all that
    thresholds and metrics need of ``scored`` (score, isFraud, cents)."""
    fraud = F.col("isFraud") == 1
    return scored.groupBy(*by, "score").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(fraud.cast("bigint")), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.when(fraud, F.col("cents"))), F.lit(0)).alias("fraud_cents")
    )


def cost_curve(scored: DataFrame, review_cost: float = REVIEW_COST) -> DataFrame:
    """(threshold, alerts, cost, accuracy) at every distinct score and at infinity, where nothing is alerted.

    ``scored``: score, isFraud, cents. Rows without a score are left out; an empty table has no curve.
    """
    return curve_of(score_totals(scored), review_cost)


def curve_of(per: DataFrame, review_cost: float = REVIEW_COST) -> DataFrame:
    """The curve of :func:`cost_curve` from :func:`score_totals`."""
    per = per.where("score is not null")
    sums = {"n_below": "n", "pos_below": "pos", "cents_below": "fraud_cents"}
    totals = per.agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"), F.sum("fraud_cents").alias("all_cents"))
    at_scores = with_scalar(running_before(per, "score", sums), totals)
    columns = ["score", "n_below", "pos_below", "cents_below", "all_n", "all_pos"]
    above_all = totals.where("all_n is not null").select(F.lit(float("inf")).alias("score"), F.col("all_n").alias("n_below"), F.col("all_pos").alias("pos_below"), F.col("all_cents").alias("cents_below"), "all_n", "all_pos")
    alerts = F.col("all_n") - F.col("n_below")
    false_alerts = alerts - (F.col("all_pos") - F.col("pos_below"))
    return at_scores.select(*columns).unionByName(above_all).select(
        F.col("score").alias("threshold"),
        alerts.alias("alerts"),
        (F.col("cents_below") / F.lit(100.0) + F.lit(review_cost) * alerts).alias("cost"),
        (1 - (F.col("pos_below") + false_alerts) / F.col("all_n")).alias("accuracy"),
    )


def choose(curve: DataFrame, by: str) -> DataFrame:
    """The row of least cost or of highest accuracy; the smallest threshold among equals."""
    best = F.col("cost").asc() if by == "cost" else F.col("accuracy").desc()
    return curve.orderBy(best, "threshold").limit(1)


def _measures(review_cost: float) -> list[Column]:
    """Of a policy's alerts, caught and caught_cents, among all_n rows with all_pos frauds of all_cents."""
    alerts, n, caught = F.col("alerts"), F.col("all_n"), F.col("caught")
    missed = (F.col("all_cents") - F.col("caught_cents")) / F.lit(100.0)
    cost = missed + F.lit(review_cost) * alerts
    ratio = lambda a, b: F.bround(a / F.nullif(b, F.lit(0)), 4)
    return [
        "alerts",
        ratio(alerts, n).alias("alert_rate"),
        ratio(caught, alerts).alias("precision"),
        ratio(caught, F.col("all_pos")).alias("recall"),
        F.bround(F.col("caught_cents") / F.lit(100.0)).cast("bigint").alias("fraud_caught_amt"),
        F.bround(missed).cast("bigint").alias("fraud_missed_amt"),
        F.bround(F.lit(review_cost) * alerts).cast("bigint").alias("review_cost"),
        F.bround(cost).cast("bigint").alias("total_cost"),
        F.bround(cost / F.nullif(n, F.lit(0)) * 1000, 1).alias("cost_per_1k_tx"),
    ]


def evaluate(scored: DataFrame, thresholds: DataFrame, review_cost: float = REVIEW_COST) -> DataFrame:
    """What each policy of ``thresholds`` (policy, threshold) does to ``scored`` (score, isFraud, cents).

    The threshold is rounded in the output, null for infinity. Without alerts there is no precision, without fraud no
    recall; a null score is never alerted, a null threshold alerts nothing, and no rows give no output. More than
    ``MOST_POLICIES`` are refused.
    """
    return evaluate_totals(score_totals(scored), thresholds, review_cost)


def evaluate_totals(per: DataFrame, thresholds: DataFrame, review_cost: float = REVIEW_COST) -> DataFrame:
    """:func:`evaluate` from :func:`score_totals`.

    Each score is placed among the sorted thresholds by halving and summed with the others of its place; a policy's
    figures are then totals of the places from its own on. So the cost is that of one pass, whatever the policies.
    """
    if thresholds.limit(MOST_POLICIES + 1).count() > MOST_POLICIES:
        raise ValueError(f"more than {MOST_POLICIES} policies")
    bounds = thresholds.agg(F.array_sort(F.collect_set("threshold")).alias("bounds"))
    placed = with_scalar(per, bounds).groupBy(place(F.col("bounds"), F.col("score")).alias("place"))
    places = placed.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("fraud_cents").alias("cents"))  # MOST_POLICIES + 1 rows at most
    every = places.agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"), F.sum("cents").alias("all_cents")).where("all_n is not null")
    own = F.coalesce(F.array_position("bounds", F.col("threshold")), F.lit(MOST_POLICIES + 1)).cast("int")
    asked = with_scalar(thresholds, bounds).select("policy", "threshold", own.alias("place"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("cents"))
    both = places.select(F.lit(None).cast("string").alias("policy"), F.lit(None).cast("double").alias("threshold"), "place", "n", "pos", "cents", F.lit(False).alias("asks"))
    both = both.unionByName(asked.withColumn("asks", F.lit(True)))
    from_own = W.orderBy(F.col("place").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    totals = both.select("policy", "threshold", "asks", *(F.sum(c).over(from_own).alias(a) for c, a in (("n", "alerts"), ("pos", "caught"), ("cents", "caught_cents"))))
    shown = F.when(F.col("threshold") < float("inf"), F.bround("threshold", 4)).alias("threshold")
    return with_scalar(totals.where("asks"), every).select("policy", shown, *_measures(review_cost))


def policy_table(honest: DataFrame, careless: DataFrame, holdout: DataFrame, review_cost: float = REVIEW_COST) -> DataFrame:
    """One row per policy on the holdout: none, thresholds chosen beforehand, and the best in hindsight.

    ``honest`` and ``careless``: selection rows (score, isFraud, cents). ``holdout``: isFraud, cents, score_honest,
    score_naive. ``promised_cost_per_1k_tx`` is what the choice looked like on its selection rows. Each set of rows is
    read once, for its totals per score; the chosen thresholds, four numbers, come to the driver.
    """
    spark, out = holdout.sparkSession, None
    scores = F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"score_{m}").alias("score")) for m in ("honest", "naive"))))
    lives = saved(score_totals(holdout.select("isFraud", "cents", scores), ("model",)))
    for name, selection in (("honest", honest), ("naive", careless)):
        before = saved(score_totals(selection))
        live = lives.where(F.col("model") == name).drop("model")
        best = _best(curve_of(before, review_cost))
        picks = [(f"{name}_{by}_threshold", best[by]) for by in (("accuracy", "cost") if name == "honest" else ("cost",)) if by in best]
        chosen = spark.createDataFrame(picks, "policy string, threshold double")
        promised = evaluate_totals(before, chosen, review_cost).select("policy", F.col("cost_per_1k_tx").alias("promised_cost_per_1k_tx"))
        hindsight = [(f"{name}_hindsight", best["cost"]) for best in [_best(curve_of(live, review_cost))] if best]
        nothing = [("no_model", float("inf"))] if name == "honest" else []
        policies = spark.createDataFrame(nothing + picks + hindsight, "policy string, threshold double")
        rows = evaluate_totals(live, policies, review_cost).join(promised, "policy", "left")
        out = rows if out is None else out.unionByName(rows)
    return out


def _best(curve: DataFrame) -> dict[str, float]:
    """The thresholds that :func:`choose` picks by cost and by accuracy, in one pass; none of an empty curve."""
    cost, accuracy = curve.agg(F.min(F.struct("cost", "threshold")), F.min(F.struct(-F.col("accuracy"), "threshold"))).first()
    return {} if cost is None else {"cost": cost["threshold"], "accuracy": accuracy["threshold"]}


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row (roc_auc), ties counted half, rounded to 4 places; null without both classes."""
    return roc_auc_of(score_totals(scored))


def roc_auc_of(per: DataFrame) -> DataFrame:
    """:func:`roc_auc` from :func:`score_totals`."""
    per = per.where("score is not null").withColumn("neg", F.col("n") - F.col("pos"))
    placed = running_before(per, "score", {"neg_below": "neg"})
    # twice the pairs in order, in whole numbers
    pairs = F.sum(F.col("pos").cast("decimal(38,0)") * (2 * F.col("neg_below") + F.col("neg")))
    every = F.sum("pos").cast("double") * F.sum("neg").cast("double") * 2
    return placed.agg(F.bround(pairs.cast("double") / F.nullif(every, F.lit(0.0)), 4).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row (pr_auc): precision at each score weighted by the recall it adds, rounded to 4 places."""
    return average_precision_of(score_totals(scored))


def average_precision_of(per: DataFrame) -> DataFrame:
    """:func:`average_precision` from :func:`score_totals`."""
    per = per.where("score is not null")
    placed = running_before(per, "score", {"n_above": "n", "pos_above": "pos"}, descending=True)
    step = F.col("pos") * (F.col("pos") + F.col("pos_above")) / (F.col("n") + F.col("n_above"))
    return placed.agg(F.bround(F.sum(step) / F.nullif(F.sum("pos"), F.lit(0)), 4).alias("pr_auc"))
