"""Training sets, splits and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.sources import tsv
from linkstone.sources.scratch import cut, large


def bucket(id_col: str, n: int, seed: int = 42) -> Column:
    """A reproducible number from 0 to n - 1: the first 28 bits of the MD5 of id and seed, modulo n."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.col(id_col), F.lit(f"#{seed}"))), 1, 7), 16, 10).cast("long"), F.lit(n))


def sample_distractors(records: DataFrame, needed: DataFrame, percent: int = 5, limit: int | None = None) -> DataFrame:
    """Records that are needed (ids), and a hashed share of the others; limit: at most so many others, in id order."""
    base = records.join(large(needed.select(F.col("entity_id").alias("_n")).distinct()), records["entity_id"] == F.col("_n"), "left")
    others = base.where(F.col("_n").isNull() & (bucket("entity_id", 100) < percent))
    if limit is not None:
        others = others.orderBy("seq", "entity_id").limit(limit)
    return base.where(F.col("_n").isNotNull()).unionByName(others).drop("_n")


def split(rows: DataFrame, id_col: str, train_percent: int = 80) -> DataFrame:
    return rows.withColumn("part", F.when(bucket(id_col, 100) < train_percent, "train").otherwise("validation"))


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """Column _at: a row's place in the order, from 0.

    Rows are sorted by range partitions; a row's place is the count of the
    partitions before its own plus its place there, so no task sees all rows.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = cut(rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), "ordered")
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = counts.select("_part", F.expr("sum(_n) OVER (ORDER BY _part) - _n").alias("_before"))
    return ordered.join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def split_by_position(rows: DataFrame, order: str, percent: int = 80) -> DataFrame:
    """The first percent of the rows in order are for training."""
    placed = _placed(rows, order)
    return placed.withColumn("part", F.when(F.col("_at") < placed.count() * percent // 100, "train").otherwise("validation")).drop("_at")


def slices(rows: DataFrame, id_col: str, train: int = 60_000, validation: int = 15_000) -> DataFrame:
    """A seeded shuffle, by hash and id, of which the first rows are for training and the next for validation; the others are left out."""
    shuffled = _placed(rows.withColumn("_h", bucket(id_col, 1 << 28)), "_h", id_col).drop("_h")
    return shuffled.where(F.col("_at") < train + validation).withColumn("part", F.when(F.col("_at") < train, "train").otherwise("validation")).drop("_at")


def needed_targets(truth: DataFrame) -> DataFrame:
    """All target ids of lists (s1_id, target_ids)."""
    return truth.select(F.explode("target_ids").alias("entity_id")).distinct()


def hard_negatives(candidates: DataFrame, truth: DataFrame, per_query: int = 4) -> DataFrame:
    """The first candidates of each query that aren't true."""
    wrong = candidates.join(large(truth.select("s1", "target")), ["s1", "target"], "left_anti")
    return wrong.withColumn("neg_pos", F.expr("row_number() OVER (PARTITION BY s1 ORDER BY source, cand_pos, target)")).where(F.col("neg_pos") <= per_query)


def training_pairs(candidates: DataFrame, truth: DataFrame, targets: DataFrame, per_query: int = 4) -> DataFrame:
    """(s1, target, label): all true pairs with a known target, and hard negatives."""
    true = truth.join(large(targets.select(F.col("entity_id").alias("target"))), "target", "left_semi").select("s1", "target", F.lit(1).alias("label"))
    return true.unionByName(hard_negatives(candidates, truth, per_query).select("s1", "target", F.lit(0).alias("label")))


def labelled_candidates(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Profile L: every candidate, labelled by whether it is true."""
    return candidates.join(large(truth.select("s1", "target").distinct().withColumn("_t", F.lit(1))), ["s1", "target"], "left").select("s1", "target", F.coalesce("_t", F.lit(0)).alias("label"))


def fit_boosted(rows: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 5, rate: float = 0.08, weight: str | None = None, seed: int = 42):
    """Gradient-boosted trees as a pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=1.0, minInstancesPerNode=1)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), gbt]).fit(rows.withColumn(label, F.col(label).cast("double")))


def fit_linear(rows: DataFrame, features: list[str], label: str = "label"):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label, maxIter=30, regParam=1e-3)]).fit(rows.withColumn(label, F.col(label).cast("double")))


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Column weight: n / (2 * size of the class)."""
    n = {r["label"]: r["n"] for r in rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, w = sum(n.values()), F.lit(1.0)
    for k, v in n.items():
        w = F.when(F.col(label) == k, total / (len(n) * v)).otherwise(w)
    return rows.withColumn("weight", w)


def score(model, rows: DataFrame, name: str = "prob") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def save_scorer(spark: SparkSession, path: str, model, idf: DataFrame, threshold: float) -> None:
    """Model, IDF table and threshold below one folder; what stood there is replaced."""
    model.write().overwrite().save(f"{path}/model")
    idf.select("token", "idf").write.mode("overwrite").parquet(f"{path}/idf")
    spark.createDataFrame([(str(threshold),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/threshold")


def load_scorer(spark: SparkSession, path: str, default: float = 0.55):
    """(model, idf, threshold) of save_scorer; without a threshold the default."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), tsv.read_idf(spark, f"{path}/idf"), tsv.read_value(spark, f"{path}/threshold", default)
