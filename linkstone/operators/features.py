"""Pairwise features of each profile, as columns over a table of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstone.functions import similarity as S
from linkstone.sources.scratch import large

P = ["name_ratio", "name_partial_ratio", "name_token_sort", "name_token_set", "name_comp_ratio", "core_jaccard", "core_overlap_count", "core_idf_sum", "addr_ratio",
     "addr_token_set", "door_match", "pin_match", "phone_match", "ak_overlap", "comp_interaction", "synthetic_name_corrupt"]
C = ["name_jw", "name_tset", "name_tsort", "name_lev", "name_len_diff", "name_containment", "name_3gram_jaccard", "shared_core_count", "shared_token_idf_sum",
     "max_shared_token_idf", "comp_exact", "has_addr_s1", "has_addr_tgt", "addr_tset", "addr_lev", "addr_containment", "pin_status", "pin_prefix_status", "door_status",
     "shared_phone", "is_source2", "both_have_address", "name_addr_interaction", "door_name_interaction"]
V6 = ["name_jw", "name_tset", "name_tsort", "name_lev", "name_len_diff", "shared_core_count", "comp_exact", "addr_tset", "addr_lev", "has_addr_s1", "has_addr_tgt",
      "pin_status", "door_status", "shared_phone", "is_source2"]
L = ["name_jaccard", "name_ratio", "name_token_sort", "addr_ratio", "digit_overlap", "exact_name", "is_s2"]
NAMES = {"P": P, "C": C, "V6": V6, "L": L}
READS = {"L": ["clean_name", "clean_addr", "digits"]}
_READS = ["clean_name", "compressed", "core", "tokens", "clean_addr", "door", "pin", "phone", "addr_keys"]


def pairs(candidates: DataFrame, queries: DataFrame, targets: DataFrame, profile: str = "P") -> DataFrame:
    """candidates (s1, target, ...) with the columns of both records, prefixed a_ and b_; targets that are unknown drop out."""
    reads = READS.get(profile, _READS)
    a = queries.select(F.col("entity_id").alias("s1"), *[F.col(c).alias("a_" + c) for c in reads])
    b = targets.select(F.col("entity_id").alias("target"), *[F.col(c).alias("b_" + c) for c in reads])
    return candidates.join(large(a), "s1").join(large(b), "target")


def _both(name: str) -> Column:
    return (F.col("a_" + name) != "") & (F.col("b_" + name) != "")


def _if(condition: Column, value: Column, other: float = 0.0) -> Column:
    return F.when(condition, value).otherwise(F.lit(other))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _idf_of(tokens: Column, idf_map: Column | None, default: float) -> Column:
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(idf_map, t), F.lit(default)) if idf_map is not None else F.lit(default))


def with_shared_idf(rows: DataFrame, idf: DataFrame, array: str, default: float) -> DataFrame:
    """idf_sum and idf_max over the shared tokens in column `array`: a join on the token, not a map in memory."""
    each = rows.select("s1", "target", F.explode(array).alias("token")).join(large(idf.select("token", "idf")), "token", "left")
    sums = each.groupBy("s1", "target").agg(F.sum(F.coalesce("idf", F.lit(default))).alias("idf_sum"), F.max(F.coalesce("idf", F.lit(default))).alias("idf_max"))
    return rows.join(large(sums), ["s1", "target"], "left").fillna(0.0, ["idf_sum", "idf_max"])


def production(rows: DataFrame, idf: DataFrame, default_idf: float = 12.0) -> DataFrame:
    """The 16 features of profile P. With an empty IDF table core_idf_sum is 0, else tokens that it lacks count default_idf."""
    default_idf = 0.0 if idf.isEmpty() else default_idf
    a, b = (lambda n: F.col("a_" + n)), (lambda n: F.col("b_" + n))
    rows = with_shared_idf(rows.withColumn("_shared", F.array_intersect("a_core", "b_core")), idf, "_shared", default_idf)
    rows = rows.withColumn("name_ratio", S.indel_ratio("a_clean_name", "b_clean_name")).withColumn("name_partial_ratio", S.partial_ratio("a_clean_name", "b_clean_name"))
    rows = rows.withColumn("name_token_sort", S.token_sort_ratio("a_clean_name", "b_clean_name")).withColumn("name_token_set", S.token_set_ratio("a_clean_name", "b_clean_name"))
    rows = rows.withColumn("_comp", S.indel_ratio("a_compressed", "b_compressed")).withColumn("_addr", S.indel_ratio("a_clean_addr", "b_clean_addr")).withColumn("_aset", S.token_set_ratio("a_clean_addr", "b_clean_addr"))
    rows = rows.withColumns({
        "name_comp_ratio": _if(_both("compressed"), F.col("_comp")),
        "core_jaccard": S.jaccard(a("core"), b("core")),
        "core_overlap_count": F.size("_shared").cast("double"),
        "core_idf_sum": F.col("idf_sum"),
        "addr_ratio": _if(_both("clean_addr"), F.col("_addr")),
        "addr_token_set": _if(_both("clean_addr"), F.col("_aset")),
        "door_match": S.three_way(a("door"), b("door")),
        "pin_match": S.three_way(a("pin"), b("pin")),
        "phone_match": _flag((a("phone") != "") & (a("phone") == b("phone"))),
        "ak_overlap": F.size(F.array_intersect("a_addr_keys", "b_addr_keys")).cast("double"),
    })
    rows = rows.withColumn("comp_interaction", F.col("name_token_set") / 100.0 * (F.col("addr_token_set") / 100.0))
    rows = rows.withColumn("synthetic_name_corrupt", _flag((F.col("ak_overlap") > 0) & (F.col("name_token_set") < 45.0)))
    return rows.select("s1", "target", *P)


def _shared_part(rows: DataFrame) -> DataFrame:
    """What profiles C and V6 have in common."""
    named, addressed = _both("clean_name"), _both("clean_addr")
    size_a, size_b = F.length("a_clean_name"), F.length("b_clean_name")
    for name, f in (("_jw", S.jaro_winkler_similarity), ("_tset", S.token_set_ratio), ("_tsort", S.token_sort_ratio), ("_lev", S.indel_ratio)):
        rows = rows.withColumn(name, f("a_clean_name", "b_clean_name"))
    rows = rows.withColumn("_aset", S.token_set_ratio("a_clean_addr", "b_clean_addr")).withColumn("_alev", S.indel_ratio("a_clean_addr", "b_clean_addr"))
    return rows.withColumns({
        "name_jw": _if(named, F.col("_jw")), "name_tset": _if(named, F.col("_tset") / 100.0), "name_tsort": _if(named, F.col("_tsort") / 100.0),
        "name_lev": _if(named, F.col("_lev") / 100.0), "name_len_diff": _if(named, F.abs(size_a - size_b) / F.greatest(size_a, size_b, F.lit(1)), 1.0),
        "shared_core_count": F.size(F.array_intersect("a_core", "b_core")).cast("double"),
        "comp_exact": _flag((F.col("a_compressed") != "") & (F.col("a_compressed") == F.col("b_compressed"))),
        "has_addr_s1": _flag(F.col("a_clean_addr") != ""), "has_addr_tgt": _flag(F.col("b_clean_addr") != ""),
        "addr_tset": _if(addressed, F.col("_aset") / 100.0), "addr_lev": _if(addressed, F.col("_alev") / 100.0),
        "pin_status": S.three_way(F.col("a_pin"), F.col("b_pin")), "door_status": S.three_way(F.col("a_door"), F.col("b_door")),
        "shared_phone": _flag((F.col("a_phone") != "") & (F.col("a_phone") == F.col("b_phone"))), "is_source2": _flag(F.col("target").startswith("S2-")),
    })


def older(rows: DataFrame) -> DataFrame:
    """The 15 features of profile V6."""
    return _shared_part(rows).select("s1", "target", *V6)


def championship(rows: DataFrame, idf: DataFrame, default_idf: float) -> DataFrame:
    """The 24 features of profile C."""
    named, addressed = _both("clean_name"), _both("clean_addr")
    rows = with_shared_idf(rows.withColumn("_shared", F.when(named, F.array_intersect("a_tokens", "b_tokens")).otherwise(F.array().cast("array<string>"))), idf, "_shared", default_idf)
    rows = _shared_part(rows).withColumns({
        "name_containment": _if(named, S.containment(F.col("a_tokens"), F.col("b_tokens"))),
        "name_3gram_jaccard": _if(named, S.trigram_jaccard(F.col("a_compressed"), F.col("b_compressed"))),
        "shared_token_idf_sum": F.col("idf_sum"), "max_shared_token_idf": F.col("idf_max"),
        "addr_containment": _if(addressed, S.containment(F.split("a_clean_addr", " "), F.split("b_clean_addr", " "))),
        "pin_prefix_status": _if(_both("pin"), F.when(F.substring("a_pin", 1, 3) == F.substring("b_pin", 1, 3), 1.0).otherwise(-1.0)),
        "both_have_address": _flag(addressed),
    })
    return rows.withColumns({"name_addr_interaction": F.col("name_tset") * F.col("addr_tset"), "door_name_interaction": F.col("door_status") * F.col("name_jw")}).select("s1", "target", *C)


def basic(rows: DataFrame) -> DataFrame:
    """The 7 features of profile L."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    rows = rows.withColumn("_ratio", S.indel_ratio("a_clean_name", "b_clean_name")).withColumn("_sort", S.token_sort_ratio("a_clean_name", "b_clean_name")).withColumn("_aset", S.token_set_ratio("a_clean_addr", "b_clean_addr"))
    return rows.select(
        "s1", "target", S.jaccard(words("a_clean_name"), words("b_clean_name")).alias("name_jaccard"), (F.col("_ratio") / 100.0).alias("name_ratio"), (F.col("_sort") / 100.0).alias("name_token_sort"),
        _if(_both("clean_addr"), F.col("_aset") / 100.0).alias("addr_ratio"), _flag(F.size(F.array_intersect("a_digits", "b_digits")) > 0).alias("digit_overlap"),
        _flag((F.col("a_clean_name") != "") & (F.col("a_clean_name") == F.col("b_clean_name"))).alias("exact_name"), _flag(F.col("target").startswith("S2-")).alias("is_s2"),
    )
