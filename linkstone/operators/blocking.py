"""Candidate generation: postings by channel, probes, weights, and the best candidates of each query.

A key's frequency is a partial aggregate joined back (not a window).  That join
does meet all postings of a hot key that keeps its first rows; adaptive execution
splits such a partition.  Only keys below a cap, or the first rows of a key, are
probed; first rows come from row_number with a limit, for which Spark keeps the
best rows on the map side already.

Probes meet postings by numbers, not ids.  Queries are dealt into buckets; the
targets of a key move once to each bucket that asks for it, and pairs are made,
summed and cut to the best there, in memory: they are never rows of a table.
Rounds over the buckets bound the disk that the lists take.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstone.functions import lexicons as X
from linkstone.sources.scratch import cut, drop, large

SHARD = ["country", "source"]
KEY = ["key", "channel", *SHARD]  # the most selective first: sorts compare it first


@dataclass(frozen=True)
class Channel:
    """A blocking channel. cap: postings of a key at most, else the key is dropped or, with `first`, cut to its first rows and weakened."""

    name: str
    weight: float | None
    cap: int
    first: int | None = None
    weaken: float = 1.0


#: Channels of each profile. A weight of None is the token's IDF.
CHANNELS = {
    "P": [Channel("token", None, 500, 300, 0.1), Channel("addr_key", 15.0, 99), Channel("pin", 3.0, 199), Channel("prefix", 4.0, 200, 200)],
    "V6": [Channel("token", 2.0, 250), Channel("door", 3.0, 100), Channel("pin", 1.5, 250)],
    "C": [Channel("token", None, 250), Channel("door", 4.0, 100), Channel("pin", 2.0, 250)],
    "L": [Channel("token", 1.0, 1200)],
}
#: Candidates kept, by profile (for L over both sources together).
TOP_K = {"P": 20, "V6": 8, "C": 8, "L": 25}


def keys(records: DataFrame, profile: str, distinct_tokens: bool) -> DataFrame:
    """(record columns, channel, key, pos): one row for each key of a record; repeated address keys stay."""
    base = ["entity_id", *SHARD, "seq"]
    tokens = F.col("tokens")
    if profile != "P":
        tokens = F.filter("tokens", lambda t: (F.length(t) >= 3) & ~F.array_contains(F.array(*map(F.lit, X.GENERIC[profile] or [""])), t))
    if distinct_tokens:
        tokens = F.array_distinct(tokens)
    parts = [records.select(*base, F.posexplode(tokens).alias("pos", "key")).withColumn("channel", F.lit("token"))]
    if profile == "P":
        parts.append(records.select(*base, F.posexplode("addr_keys").alias("pos", "key")).withColumn("channel", F.lit("addr_key")))
        parts.append(records.where(F.length("compressed") >= 5).select(*base, F.lit(0).alias("pos"), F.substring("compressed", 1, 5).alias("key"), F.lit("prefix").alias("channel")))
    if profile in ("V6", "C"):
        parts.append(records.where("door <> ''").select(*base, F.lit(0).alias("pos"), F.col("door").alias("key"), F.lit("door").alias("channel")))
    if profile != "L":
        parts.append(records.where("pin <> ''").select(*base, F.lit(0).alias("pos"), F.col("pin").alias("key"), F.lit("pin").alias("channel")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def postings(targets: DataFrame, profile: str = "P") -> DataFrame:
    return keys(targets, profile, distinct_tokens=True)


def frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("df"))


def admitted(posts: DataFrame, profile: str = "P") -> DataFrame:
    """Postings that take part, with df and rank; dropped keys and rows beyond a key's first ones are gone."""
    by_name = {c.name: c for c in CHANNELS[profile]}
    pick = lambda f: F.create_map(*[x for n, c in by_name.items() for x in (F.lit(n), F.lit(f(c)))])[F.col("channel")]
    cap, first = pick(lambda c: c.cap), pick(lambda c: c.first or 0)
    live = posts.join(large(frequencies(posts).where((F.col("df") <= cap) | (first > 0))), KEY)
    few = live.where(F.col("df") <= cap).withColumn("rank", F.lit(0))
    if not any(c.first for c in by_name.values()):
        return few
    # only keys beyond their cap are ranked, and each task keeps their first rows before the shuffle
    most = max(c.first or 0 for c in by_name.values())
    ranked = live.where(F.col("df") > cap).withColumn("rank", F.expr("row_number() OVER (PARTITION BY key, channel, country, source ORDER BY seq, entity_id, pos)"))
    return few.unionByName(ranked.where(F.col("rank") <= most).where(F.col("rank") <= first))


#: The first postings of a key that training sets are blocked with.
TRAINING_FIRST = {"V6": {"token": 100, "door": 50, "pin": 50}, "C": {"token": 80, "door": 50, "pin": 50}}


def first_postings(posts: DataFrame, profile: str = "V6") -> DataFrame:
    """Training sets cut every key to its first postings and drop none."""
    first = TRAINING_FIRST[profile]
    ranked = posts.withColumn("rank", F.expr("row_number() OVER (PARTITION BY key, channel, country, source ORDER BY seq, entity_id, pos)")).where(F.col("rank") <= max(first.values()))
    return ranked.where(F.col("rank") <= F.create_map(*[F.lit(x) for kv in first.items() for x in kv])[F.col("channel")])


def idf_production(posts: DataFrame, targets: DataFrame) -> DataFrame:
    """(country, source, token, df, idf) with idf = ln((N + 1) / (df + 1)) + 1 in each shard."""
    n = targets.groupBy(*SHARD).agg(F.count(F.lit(1)).alias("n"))
    df = posts.where("channel = 'token'").groupBy(*SHARD, F.col("key").alias("token")).agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, SHARD).select(*SHARD, "token", "df", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def idf_lexicon(records: DataFrame, min_df: int = 2) -> DataFrame:
    """(token, df, idf) over all records: round(ln(1 + N / (1 + df)), 3) for tokens of min_df records or more."""
    n = records.count()
    df = records.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return df.select("token", "df", F.round(F.log(1.0 + F.lit(n) / (1.0 + F.col("df"))), 3).alias("idf"))


def probes(queries: DataFrame, idf: DataFrame | None, profile: str = "P", default_idf: float = 2.0) -> DataFrame:
    """(s1, country, channel, key, source or null, weight, probe_no): what each query looks up. Repeated keys probe twice in profile P."""
    k = keys(queries, profile, distinct_tokens=profile != "P").withColumnRenamed("entity_id", "s1").drop("source", "seq")
    weight = F.lit(None).cast("double")
    for c in CHANNELS[profile]:
        weight = F.when(F.col("channel") == c.name, F.lit(c.weight).cast("double")).otherwise(weight)
    k = k.withColumn("weight", weight)
    sources = F.explode(F.array(F.lit("S2"), F.lit("S3"))).alias("source")
    k = k.select("*", sources)
    if profile == "P":
        tokens = k.where("channel = 'token'").drop("weight").join(large(idf.withColumnRenamed("token", "key").select(*SHARD, "key", F.col("idf").alias("weight"))), [*SHARD, "key"])
        top = tokens.withColumn("probe_no", F.expr("row_number() OVER (PARTITION BY s1, source ORDER BY weight DESC, pos)")).where("probe_no <= 4")
        return top.unionByName(k.where("channel <> 'token'").withColumn("probe_no", F.col("pos")))
    if profile == "C" and idf is not None:
        own = idf.select(F.col("token").alias("key"), "idf")
        k = k.join(large(own), "key", "left").withColumn("weight", F.when(F.col("channel") == "token", F.coalesce("idf", F.lit(default_idf))).otherwise(F.col("weight"))).drop("idf")
    return k.withColumn("probe_no", F.col("pos"))


def _numbered(queries: DataFrame, targets: DataFrame, reads: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides as tables with `no`: one number for each query id; for targets one that grows with (seq, entity_id), odd in S3."""
    q = cut(queries.select("entity_id", *SHARD, "seq", *reads, F.monotonically_increasing_id().alias("no")), "queries")
    t = cut(targets.select("entity_id", *SHARD, "seq", *reads), "targets")
    place = F.monotonically_increasing_id() * 2 + (F.col("source") == "S3").cast("long")
    numbered = cut(t.orderBy("seq", "entity_id").withColumn("no", place), "numbered")
    drop(t)
    return q.withColumn("no", F.expr("min(no) OVER (PARTITION BY entity_id)")), numbered


def _pairs_of_shortened(look: DataFrame, live: DataFrame) -> DataFrame:
    """(bucket, s1s, weights, nos): the pairs of a key and a bucket of queries, not multiplied out.

    However many queries of a bucket have a key, its targets move there once.
    """
    asks = look.groupBy("bucket", *KEY).agg(F.collect_list(F.struct("s1", "weight")).alias("q"))
    return asks.join(large(live), KEY).select("bucket", F.col("q.s1").alias("s1s"), F.transform("q.weight", lambda w: w * F.col("factor")).alias("weights"), "nos")


#: Pairs that are multiplied out at once; probes whose lists move at once.
AT_ONCE, PROBES_AT_ONCE = 1 << 20, 8_000_000
_BEST = "s1 bigint, no bigint, block_score double, cand_pos int"


def _best_of(k: int, by_source: bool):
    """Function from the lists of a bucket to the best k targets of each query (and source): sums of weights, then target order."""

    def flat(column):
        column = column.combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        s1, per_key = flat(table["s1s"])
        weight, _ = flat(table["weights"])
        targets, lengths = flat(table["nos"])
        starts = np.cumsum(lengths) - lengths
        names, codes = np.unique(targets, return_inverse=True)
        order = np.argsort(s1, kind="stable")
        row = np.repeat(np.arange(len(per_key)), per_key)[order]
        s1, weight, size, start = s1[order], weight[order], lengths[row], starts[row]
        first = np.flatnonzero(np.r_[True, s1[1:] != s1[:-1]])  # of each query's probes
        ends, sums = np.r_[first[1:], len(s1)], np.r_[0, np.cumsum(size)]
        out, at = [], 0
        while at < len(first):
            most = sums[first[at]] + AT_ONCE
            to = max(at + 1, int(np.searchsorted(sums[ends], most, side="right")))
            p = slice(first[at], ends[to - 1])
            n = size[p]
            total = int(n.sum())
            code = codes[np.repeat(start[p] - (np.cumsum(n) - n), n) + np.arange(total)]
            query = np.repeat(np.searchsorted(first[at:to], np.arange(p.start, p.stop), side="right") - 1, n)
            pair, each = query * len(names) + code, np.repeat(weight[p], n)
            if (to - at) * len(names) <= 2 * total:  # dense enough for a cell each
                met = np.flatnonzero(np.bincount(pair, minlength=1))
                score = np.bincount(pair, weights=each)[met]
            else:
                by = np.argsort(pair, kind="stable")
                pair = pair[by]
                begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                met, score = pair[begin], np.add.reduceat(each[by], begin)
            score = np.rint(score * 1e6)
            query, no = met // len(names), names[met % len(names)]
            group = query * 2 + no % 2 if by_source else query
            best = np.lexsort((no, -score, group))
            group = group[best]
            begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(begin, np.diff(np.r_[begin, len(group)])) + 1
            best, place = best[place <= k], place[place <= k]
            out.append((s1[first[at:to]][query[best]], no[best], score[best] / 1e6, place.astype(np.int32)))
            at = to
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], names=["s1", "no", "block_score", "cand_pos"])

    return run


def block(queries: DataFrame, targets: DataFrame, profile: str = "P", idf: DataFrame | None = None, top_k: int | None = None, only: str | None = None) -> DataFrame:
    """(s1, source, target, block_score, cand_pos): the best targets of each query, by score, then target order.

    only: candidates of this channel alone.  In profile L both sources share one list; cand_pos counts within it.
    """
    q, t = _numbered(queries, targets, ["tokens", *(["addr_keys", "compressed", "door", "pin"] if profile != "L" else [])])
    posts = cut(postings(t.withColumn("seq", F.col("no")), profile), "postings")
    live = admitted(posts, profile).select(*KEY, "df", F.col("seq").alias("no"))
    if profile == "P" and idf is None:
        idf = idf_production(posts, t)
    look = probes(q.withColumn("entity_id", F.col("no")).drop("no"), idf, profile)
    if only is not None:
        look, live = look.where(F.col("channel") == only), live.where(F.col("channel") == only)
    factor = F.lit(1.0)
    for c in CHANNELS[profile]:
        if c.first is not None:
            factor = F.when((F.col("channel") == c.name) & (F.col("df") > c.cap), c.weaken).otherwise(factor)
    live = cut(live.groupBy(*KEY).agg(F.array_sort(F.collect_list("no")).alias("nos"), F.max(factor).alias("factor")), "live")
    buckets = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    look = cut(look.select("s1", *KEY, "weight", F.expr(f"pmod(hash(s1), {buckets})").alias("bucket")), "look")
    drop(posts)
    rounds, best = min(buckets, look.count() // PROBES_AT_ONCE + 1), None
    for r in range(rounds):
        lists = _pairs_of_shortened(look.where(F.col("bucket") % rounds == r), live)
        found = cut(lists.groupBy("bucket").applyInArrow(_best_of(top_k or TOP_K[profile], profile != "L"), _BEST), "best")
        best = best.unionByName(found) if best is not None else found
    named = best.withColumnRenamed("s1", "_q").join(large(q.select(F.col("no").alias("_q"), F.col("entity_id").alias("s1")).dropDuplicates(["_q"])), "_q")
    return named.join(large(t.select("no", "source", F.col("entity_id").alias("target"))), "no").select("s1", "source", "target", "block_score", "cand_pos")


def pruned_keys(posts: DataFrame, profile: str, per: int = 1) -> DataFrame:
    """Keys that occur more often than their channel's cap, divided by `per`, allows."""
    cap = F.lit(None)
    for c in CHANNELS[profile]:
        cap = F.when(F.col("channel") == c.name, F.lit(c.cap // per)).otherwise(cap)
    return frequencies(posts).where(F.col("df") > cap)


def recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true pairs, those among the candidates, and their share. truth: (s1, target)."""
    hit = truth.join(large(candidates.select("s1", "target").distinct().withColumn("hit", F.lit(1))), ["s1", "target"], "left")
    return hit.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("found")).withColumn("recall", F.round(F.when(F.col("true_pairs") > 0, F.col("found") / F.col("true_pairs")).otherwise(0.0), 6))
