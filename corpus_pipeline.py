"""The corpus pipeline: documents through five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from linkstone.llm import decontamination, exact_dedup, jaccard_join, quality, sentencepiece_codec
from linkstone.llm.common import drop_since, load, tables
from linkstone.llm.queries import TOKENIZERS
from linkstone.sources.scratch import shared_dir, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 3) rejects go.

    Null and empty texts are scored as empty; repeated rows share their fate.
    Without labels to learn from, all stay.
    """
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays, once (operator 5).

    Null counts as empty.  Of fully repeated rows, or rows without an id, one stays.
    """
    return exact_dedup.keep_one_copy(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of the exact Jaccard join lead to, the smallest doc_id stays (operator 9, at five words and 0.80).

    Empty texts and rows without an id stay.
    """
    return jaccard_join.keep_one_of_each(docs, shingle=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go (operator 8). Null and empty texts stay, and so do all if the benchmark is empty."""
    return decontamination.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """doc_id, ids, n_tokens of every document that is left, and whether decoding gives its text back (operator 10).

    Null and empty texts have no ids.
    """
    return sentencepiece_codec.encode_and_check(docs, sentencepiece_codec.read_model(model)).select("doc_id", "ids", "n_tokens", "round_trip")


STAGES = [
    ("quality", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("encoding", encoding),
]

#: Learnt scores and the tokenizer's merges can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, home: str | None = None) -> DataFrame:
    """The last stage's rows. Each stage is written below home; with a home given, finished stages are read instead of run again.

    A stage's own tables go once it is written.
    """
    docs = load(spark, sf_dir, "documents")
    home = home or f"{shared_dir(spark).rstrip('/')}/linkstone/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        if not written(spark, f"{home}/{name}"):
            mark = tables()
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{home}/{name}")
            drop_since(mark)
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
