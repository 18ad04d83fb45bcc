"""Tab-separated sources and sinks: no quoting, UTF-8, header, explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_raw(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).option("mode", "PERMISSIVE").csv(path)


def with_seq(df: DataFrame) -> DataFrame:
    """seq: the place of a row in file order, from file, block and row within the block."""
    return df.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Entity records; rows with fewer than four columns are left out, empty fields are ''."""
    df = with_seq(read_raw(spark, path, RECORD)).where("country IS NOT NULL")
    return df.select("entity_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("business_name", "business_address")], F.trim("country").alias("country"), F.substring("entity_id", 1, 2).alias("source"), "seq")


def rejected_rows(spark: SparkSession, path: str) -> DataFrame:
    return read_raw(spark, path, RECORD).where("country IS NULL").agg(F.count(F.lit(1)).alias("rejected"))


def read_truth(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """s1_id, target_ids; first: only the first rows of the file, of these the ones with matches."""
    ids = F.filter(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: x != "")
    df = with_seq(read_raw(spark, path, TRUTH))
    if first is not None:
        df = df.orderBy("seq").limit(first)
    df = df.select(F.col("source1_entity_id").alias("s1_id"), F.array_distinct(ids).alias("target_ids"))
    return df.where(F.size("target_ids") > 0) if first is not None else df


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_raw(spark, path, RECORD).select(F.trim("entity_id").alias("entity_id")).where("entity_id <> ''").distinct()


def write_lists(lists: DataFrame, path: str, columns: tuple[str, str], order: str = "seq", files: int = 1) -> None:
    """s1_id, ids and an order column as two text columns; one row for each S1 record, in input order."""
    out = lists.orderBy(order).select(F.col("s1_id").alias(columns[0]), F.array_join("ids", ",").alias(columns[1]))
    (out.coalesce(files) if files else out).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def save_shard(df: DataFrame, path: str) -> None:
    """Checkpoint by country: only the countries in df are overwritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country").parquet(path)


def missing_shards(df: DataFrame, done: DataFrame) -> DataFrame:
    return df.join(done.select("country").distinct(), "country", "left_anti")


def read_value(spark: SparkSession, path: str, default: float) -> float:
    """A number from a text file such as a threshold; default if there is none."""
    try:
        rows = spark.read.text(path).limit(1).collect()
    except Exception as e:  # noqa: BLE001  Spark's own error class depends on the catalog
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return default
    return float(rows[0]["value"]) if rows else default


def read_idf(spark: SparkSession, path: str) -> DataFrame:
    """token, idf; empty if the table doesn't exist."""
    try:
        return spark.read.parquet(path).select("token", "idf")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "token string, idf double")
