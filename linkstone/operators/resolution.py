"""From scored candidates to matches: owners of targets, caps, thresholds and the candidate superset.

scored: (s1, s1_seq, target, target_seq, source, prob, cand_pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstone.sources.scratch import large

#: Thresholds of each profile.
THRESHOLD = {"P": 0.55, "C": 0.85, "V6": 0.80, "L": 0.65}
PREFILTER = 0.35
#: Weights of a pinned logistic score over the production features, for plans without a trained model.
LOGISTIC = {"name_token_set": 0.06, "name_comp_ratio": 0.02, "core_jaccard": 2.0, "door_match": 0.8, "pin_match": 1.2, "ak_overlap": 0.7, "addr_token_set": 0.02, "synthetic_name_corrupt": 1.5}
LOGISTIC_BIAS = -7.0


def logistic(weights: dict[str, float] | None = None, bias: float = LOGISTIC_BIAS) -> Column:
    z = F.lit(bias)
    for name, w in (LOGISTIC if weights is None else weights).items():
        z = z + F.lit(w) * F.col(name)
    return 1.0 / (1.0 + F.exp(-z))


def blend(first: Column, second: Column, share: float = 0.65) -> Column:
    return F.lit(share) * first + F.lit(1.0 - share) * second


def adaptive_threshold(base: float = THRESHOLD["C"]) -> Column:
    """Stricter without an address on either side, looser if door and PIN agree; over pair columns a_ and b_."""
    same = lambda n: (F.col("a_" + n) != "") & (F.col("a_" + n) == F.col("b_" + n))
    missing = (F.col("a_clean_addr") == "") | (F.col("b_clean_addr") == "")
    return F.when(missing, F.lit(max(base, 0.88))).when(same("door") & same("pin"), F.lit(min(base, 0.75))).otherwise(F.lit(base))


def owners(scored: DataFrame, threshold: float | Column, *by: str) -> DataFrame:
    """Of all queries that reach the threshold, each target goes to the most probable; the earliest query wins ties.

    A maximum by struct is combined before the shuffle, so a target that many
    queries want doesn't gather them in one task.
    """
    best = F.max_by(F.struct("s1", "s1_seq", "target_seq", "source", "cand_pos", "prob"), F.struct("prob", -F.col("s1_seq"), -F.col("cand_pos")))
    won = scored.where(F.col("prob") >= threshold).groupBy("target", *by).agg(best.alias("w"))
    return won.select(*by, "w.s1", "w.s1_seq", "target", "w.target_seq", "w.source", "w.cand_pos", "w.prob")


def ranked(matches: DataFrame, cap: int | None, order: str = "prob DESC, source, cand_pos, target_seq", by: str = "s1") -> DataFrame:
    out = matches.withColumn("match_pos", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY {order})"))
    return out if cap is None else out.where(F.col("match_pos") <= cap)


def bipartite(scored: DataFrame, threshold: float = THRESHOLD["P"], cap: int = 6) -> DataFrame:
    """Profile P: one owner a target, at most cap targets a query; what the cap drops isn't given to others."""
    return ranked(owners(scored, threshold), cap)


def exclusive(scored: DataFrame, threshold: float | Column = "threshold") -> DataFrame:
    """Profile C: one owner a target by each pair's own threshold, no cap."""
    return ranked(owners(scored, F.col(threshold) if isinstance(threshold, str) else threshold), None)


def top_per_source(scored: DataFrame, threshold: float = THRESHOLD["V6"], cap: int = 3) -> DataFrame:
    """Profile V6: the best targets of each source above the threshold; targets may have several owners."""
    return ranked(scored.where(F.col("prob") >= threshold), cap, by="s1, source")


def candidates_per_source(scored: DataFrame, cap: int = 4) -> DataFrame:
    """Profile V6: the most probable candidates of each source, whatever the threshold."""
    return ranked(scored, cap, by="s1, source")


def plain(scored: DataFrame, threshold: float = THRESHOLD["L"]) -> DataFrame:
    """Profile L: all above the threshold, in candidate order."""
    return ranked(scored.where(F.col("prob") >= threshold), None, order="cand_pos, target")


def lists(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """(s1_id, seq, ids): one row for each query, an empty list without matches. Lists are as short as the cap."""
    got = matches.groupBy("s1").agg(F.transform(F.array_sort(F.collect_list(F.struct("match_pos", "source", "target"))), lambda x: x["target"]).alias("ids"))
    return queries.select(F.col("entity_id").alias("s1"), "seq").join(large(got), "s1", "left").select(F.col("s1").alias("s1_id"), "seq", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def pool(candidates: DataFrame, size: int = 10, compat: bool = True) -> DataFrame:
    """The first candidates of a query over both sources: all of S2 first (compat), or by position in either source."""
    order = "source, cand_pos" if compat else "cand_pos, source"
    first = candidates.withColumn("pool_pos", F.expr(f"row_number() OVER (PARTITION BY s1 ORDER BY {order}, target)")).where(F.col("pool_pos") <= size)
    return first.groupBy("s1").agg(F.transform(F.array_sort(F.collect_list(F.struct("pool_pos", "target"))), lambda x: x["target"]).alias("pool"))


def superset(matched: DataFrame, pools: DataFrame, least: int = 6) -> DataFrame:
    """(s1_id, seq, ids): matches, then candidates up to `least`; with that many matches, the first candidate still joins them."""
    both = matched.join(large(pools.withColumnRenamed("s1", "s1_id")), "s1_id", "left")
    rest = F.array_except(F.coalesce("pool", F.array().cast("array<string>")), "ids")
    head = F.slice("pool", 1, 1)
    full = F.when(F.col("pool").isNull() | F.array_contains("ids", F.try_element_at("pool", F.lit(1))), F.col("ids")).otherwise(F.concat("ids", head))
    return both.select("s1_id", "seq", F.when(F.size("ids") < least, F.slice(F.concat("ids", rest), 1, least)).otherwise(full).alias("ids"))
