"""The queries of this package, with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontamination, exact_dedup, jaccard_join, quality, sentencepiece_codec, sharding, substring_dedup, token_counts, toxicity, url_filter
from .common import load


#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"


def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_sharding(spark, sf_dir):
    return sharding.shard_by_bytes(load(spark, sf_dir, "documents"), shards=24)


def op3_quality(spark, sf_dir):
    return quality.quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(load(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(load(spark, sf_dir, "documents"))


def op6_url_filter(spark, sf_dir):
    return url_filter.url_verdicts(load(spark, sf_dir, "pages"))


def op7_token_counts(spark, sf_dir, vocabulary=f"{TOKENIZERS}/byte_bpe_50k.json"):
    return token_counts.token_counts(load(spark, sf_dir, "documents"), token_counts.read_vocabulary(vocabulary))


def op8_decontamination(spark, sf_dir):
    return decontamination.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(load(spark, sf_dir, "documents"))


def op10_sentencepiece(spark, sf_dir, model=f"{TOKENIZERS}/piece_bpe_32k.model"):
    return sentencepiece_codec.encode_and_check(load(spark, sf_dir, "documents"), sentencepiece_codec.read_model(model))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_quality, op4_substring_dedup, op5_exact_dedup, op6_url_filter, op7_token_counts, op8_decontamination, op9_jaccard_join, op10_sentencepiece)}
#: Learnt scores, differencing, the automaton and merges can't be expressed in SQL.
ORACLE_SQL = {
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_url_filter": url_filter.oracle(),
    "op8_decontamination": decontamination.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
}
