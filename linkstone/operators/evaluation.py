"""Scores of predictions against the truth. predicted and truth: (s1, target) pairs; queries: all s1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstone.sources.scratch import large

from . import resolution


def fbeta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    """F-beta of one query: 1 if nothing is true or predicted, 0 if only one of them is empty."""
    b2 = beta * beta
    below = (1 + b2) * tp + b2 * fn + fp
    return F.when((tp + fp + fn) == 0, 1.0).when(tp == 0, 0.0).otherwise((1 + b2) * tp / below)


def per_query(queries: DataFrame, predicted: DataFrame, truth: DataFrame, beta: float, *by: str) -> DataFrame:
    keys = [*by, "s1", "target"]
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("t", F.lit(1))
    counts = p.join(large(t), keys, "full").groupBy(*by, "s1").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    all_ = queries.select(*by, "s1").distinct().join(large(counts), [*by, "s1"], "left").fillna(0, ["tp", "fp", "fn"])
    return all_.withColumn("score", fbeta(F.col("tp"), F.col("fp"), F.col("fn"), beta))


def macro_fbeta(queries: DataFrame, predicted: DataFrame, truth: DataFrame, beta: float = 0.5) -> DataFrame:
    """One row. beta = 2 gives the production pipeline's own evaluator, whose weights of misses and false matches are exchanged."""
    return per_query(queries, predicted, truth, beta).agg(F.count(F.lit(1)).alias("n_queries"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("macro"))


#: Thresholds that each profile's sweep tries, in hundredths.
SWEEP = {"P": range(20, 71, 2), "V6": range(40, 96, 5), "C": range(50, 91, 5)}


def sweep(scored: DataFrame, queries: DataFrame, truth: DataFrame, profile: str = "P", beta: float = 0.5) -> DataFrame:
    """(tau, macro, best): resolution and score at each threshold in one plan; the first of equal maxima is best.

    Profile P gives each target one owner and a query six targets; V6 and C keep
    three targets of each source, the most probable first, and no owner.
    """
    taus = F.array(*[F.lit(t) for t in SWEEP[profile]])
    at = scored.withColumn("tau", F.explode(taus)).where(F.col("prob") >= F.col("tau") / 100.0)
    if profile == "P":
        won = resolution.ranked(resolution.owners(at, 0.0, "tau"), 6, by="tau, s1")
    else:
        won = resolution.ranked(at, 3, by="tau, s1, source")
    everywhere = lambda df: df.withColumn("tau", F.explode(taus))
    scores = per_query(everywhere(queries.select("s1")), won, everywhere(truth.select("s1", "target")), beta, "tau").groupBy("tau").agg(F.round(F.avg("score"), 6).alias("macro"))
    return scores.withColumn("best", F.col("tau") == F.expr("max_by(tau, struct(macro, -tau)) OVER ()"))


def coverage(queries: DataFrame, predicted: DataFrame) -> DataFrame:
    """Queries and matched queries of each country, with the share in percent."""
    has = predicted.select("s1").distinct().withColumn("hit", F.lit(1))
    out = queries.join(large(has), "s1", "left").groupBy("country").agg(F.count(F.lit(1)).alias("n_queries"), F.count("hit").alias("n_matched"))
    return out.withColumn("percent", F.round(100.0 * F.col("n_matched") / F.col("n_queries"), 4))


def class_balance(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def auc(rows: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """One row: area under the ROC curve and average precision, exact with ties, from counts of each distinct score.

    Running sums go over distinct scores only; round scores to bound their number.
    """
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) > 0).cast("long")).alias("p"), F.sum((F.col(label) <= 0).cast("long")).alias("n"))
    run = by.selectExpr("p", "n", "sum(p) OVER (ORDER BY s DESC) AS cp", "sum(n) OVER (ORDER BY s DESC) AS cn")
    total = run.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"), F.sum(F.col("n") * (F.col("cp") - F.col("p") / 2.0)).alias("area"), F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cn"))).alias("ap"))
    return total.select(F.round(F.col("area") / F.nullif(F.col("tp") * F.col("tn"), F.lit(0)), 6).alias("auc_roc"), F.round(F.col("ap") / F.nullif(F.col("tp"), F.lit(0)), 6).alias("average_precision"))
