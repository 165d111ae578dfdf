"""Quality rules with risk-controlled thresholds (DataFrame operations only).

Base statistics are exact and come from the whole text. The rules above the base ones are cutoffs on ratios of those
statistics. They are tightened along one path: step by step, rule after rule, from the most lenient cutoffs to the
strictest. For each stratum the steps are tested in that order on the good documents of a labelled holdout: an exact
binomial bound must show that all rules of the step together reject at most ALPHA of the good documents. Testing stops
at the first step that is not proven, so a stratum costs one test however long the path is (fixed-sequence testing), and
the error level is divided by the number of strata alone (Bonferroni). With probability 1 - DELTA, no stratum loses more
than ALPHA of its good documents to the rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, Scratch, let, read, small, words

SYMBOLS = "#*$%&|<>"
ALPHA = 0.08
DELTA = 0.05


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose ``measure`` (SQL over the base statistics) is above the cutoff in use."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]  # from the most lenient to the strictest


RULES = (
    Rule("symbols", "n_symbols / cast(greatest(n_words, 1) as double)", (4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2)),
    Rule("repeats", "n_repeat_words / cast(greatest(n_words, 1) as double)", (0.45, 0.4, 0.35, 0.3)),
    Rule("lines", "n_dup_lines / cast(greatest(n_words, 1) as double)", (0.2, 0.1, 0.05)),
    Rule("long_words", "word_chars / cast(greatest(n_words, 1) as double)", (40.0, 25.0, 18.0)),
    Rule("short_words", "-word_chars / cast(greatest(n_words, 1) as double)", (-1.0, -1.5, -2.0)),
)


def path(rules) -> tuple[tuple[int, str, float], ...]:
    """(step, rule, cutoff): which rule each step tightens to which cutoff; the others stay as they are."""
    levels = max((len(r.cutoffs) for r in rules), default=0)
    turns = [(r.name, r.cutoffs[i]) for i in range(levels) for r in rules if i < len(r.cutoffs)]
    return tuple((step, name, cutoff) for step, (name, cutoff) in enumerate(turns))


def first_step(rules) -> Column:
    """The first step of the path that rejects a document with the base statistics; null if none does."""
    measure = {r.name: r.measure for r in rules}
    steps = [F.when(F.expr(measure[name]) > cutoff, F.lit(step)) for step, name, cutoff in path(rules)]
    return F.coalesce(*steps, F.lit(None).cast("int"))


def _repeat_words(tokens: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""

    def repeated(rows: Column) -> Column:
        """Places, in order, of the values in ``rows`` (array of struct v, i) that are there twice or more."""
        return let(
            F.sort_array(rows),
            lambda r: F.sort_array(F.array_compact(F.transform(r, lambda x, k: F.when((F.get(r, k - 1)["v"] == x["v"]) | (F.get(r, k + 1)["v"] == x["v"]), x["i"])))),
        )

    window = lambda make, places: F.transform(places, lambda i: F.struct(make(F.get(tokens, i - 1), F.get(tokens, i), F.get(tokens, i + 1)).alias("v"), i.alias("i")))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    covered = lambda places: F.aggregate(
        places, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"]
    )
    every = F.sequence(F.lit(1), F.size(tokens) - 2)
    # hashes first; only windows whose hash repeats are compared as words
    words_of = lambda places: F.when(F.size(places) == 0, F.lit(0).cast("bigint")).otherwise(covered(repeated(window(lambda *w: F.concat_ws(" ", *w), places))))
    return F.when(F.size(tokens) < 4, F.lit(0).cast("bigint")).otherwise(let(repeated(window(F.xxhash64, every)), words_of))


def base_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint) and base_failed to ``docs``.

    Null or blank text has no words, so it fails. Columns of ``docs`` with those names are replaced.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    split = docs.withColumn("_words", words(F.col("text")))
    return (
        split.withColumns(
            {
                "n_words": F.size("_words").cast("bigint"),
                "word_chars": F.length(bare).cast("bigint"),
                "n_symbols": (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("bigint"),
                "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
                "n_repeat_words": _repeat_words(F.col("_words")),
            }
        )
        .drop("_words")
        .withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    )


def _binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k); 1 if k >= n * p, where no bound below one half exists.

    Terms are summed from the largest, that of k, down. Below the mean they fall at least as those of a bell curve, so
    12 standard deviations and 40 terms on they are below e^-70 of the largest, and the sum ends: it has about
    12 * sqrt(n * p) terms, not k.
    """
    log_term = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    back = F.greatest(k - F.ceil(F.lit(12.0) * F.sqrt(n * F.lit(p)) + 40), F.lit(0).cast("bigint"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        # from the term of j to that of j - 1, as a share of the largest
        term = acc["term"] * j * F.lit((1 - p) / p) / (n - j + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    ranks = F.when(k > 0, F.sequence(k, back + 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k.cast("double") >= n * p, F.lit(1.0)).otherwise(F.exp(log_term) * F.aggregate(ranks, start, step, lambda acc: acc["total"]))


def _log_factorial(n: Column) -> Column:
    """ln n!: summed up to 20, beyond that by Stirling's series, whose error there is below 1e-15."""
    x = n.cast("double")
    few = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda acc, j: acc + F.when(j <= n, F.log(j.cast("double"))).otherwise(0.0))
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(n <= 20, few).otherwise(x * F.log(x) - x + F.log(2 * F.lit(math.pi) * x) / 2 + series)


def proven_steps(good: DataFrame, rules=RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, step): the last step of the path proven for each stratum; no row where not even the first is.

    ``good``: good labelled documents, stratum (not null) and first_step.
    """
    steps = len(path(rules))
    hits = good.groupBy("stratum", "first_step").agg(F.count("*").alias("n"))  # a few rows for each stratum
    strata = hits.select("stratum").distinct().agg(F.count("*").alias("strata"))
    per = hits.groupBy("stratum").agg(F.sum("n").alias("n"), F.collect_list(F.struct("first_step", "n")).alias("hits"))
    each = per.select("stratum", "n", "hits", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    k = F.aggregate("hits", F.lit(0).cast("bigint"), lambda acc, h: acc + F.when(h["first_step"] <= F.col("step"), h["n"]).otherwise(0))
    proven = each.crossJoin(F.broadcast(strata)).withColumn("passes", _binomial_tail(k, F.col("n"), alpha) <= F.lit(delta) / F.col("strata"))  # one row
    so_far = F.min(F.col("passes").cast("int")).over(W.partitionBy("stratum").orderBy("step"))
    return proven.withColumn("so_far", so_far).where("so_far = 1").groupBy("stratum").agg(F.max("step").alias("step"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules=RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Base statistics, base_failed and kept for every row of ``docs`` (doc_id, text, the stratum's column).

    ``labels``: doc_id, quality; rows with quality 1 are good, null ids match nothing. Several labels of a document
    count once, good if one is. A null stratum is one of its own. A stratum with too few good labels to prove anything
    (52 at the default levels and four strata) has no cutoffs and keeps whatever passes the base rules: no guarantee is
    borrowed from other strata. Repeated rows stay. Empty tables: no rows, or no cutoffs. Other columns are dropped.
    """
    stats = base_statistics(docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))).drop("text")
    scratch = Scratch(docs.sparkSession)
    stats = scratch.save(stats.withColumn("first_step", first_step(rules)))  # numbers only: the texts are read once
    good = labels.where("quality = 1").select("doc_id").distinct()
    steps = proven_steps(stats.where("not base_failed").join(good, "doc_id", "left_semi"), rules, alpha, delta)
    hit = F.coalesce(F.col("first_step") <= F.col("step"), F.lit(False))
    return stats.join(small(scratch.save(steps)), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~hit).drop("first_step", "step", "stratum")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _sql() -> str:
    measure = {r.name: r.measure for r in RULES}
    first = "CASE " + " ".join(f"WHEN {measure[name]} > {cutoff}::DOUBLE THEN {step}" for step, name, cutoff in path(RULES)) + " END"
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
reps AS (SELECT doc_id, CAST(count(DISTINCT i + d) AS BIGINT) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, CAST(count(*) - count(DISTINCT l) AS BIGINT) AS n_dup_lines FROM lines GROUP BY doc_id),
stats AS (
  SELECT w.doc_id, coalesce(lang, '') AS stratum, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {first} AS first_step FROM stats),
good AS (SELECT * FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
counts AS (
  SELECT stratum, step, count(*) AS n, count(*) FILTER (first_step <= step) AS k
  FROM good, range(0, {len(path(RULES))}) t(step) GROUP BY ALL),
proven AS (
  SELECT *, CASE WHEN k >= n * {ALPHA} THEN 1.0 ELSE (
      SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))
      FROM range(0, CAST(k AS BIGINT) + 1) r(j)) END
      <= {DELTA} / (SELECT count(DISTINCT stratum) FROM counts) AS passes
  FROM counts),
used AS (
  SELECT stratum, max(step) AS step
  FROM (SELECT *, bool_and(passes) OVER (PARTITION BY stratum ORDER BY step) AS so_far FROM proven)
  WHERE so_far GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(first_step <= used.step, false) AS kept
FROM judged LEFT JOIN used USING (stratum)
"""


OP3_SQL = _sql()
