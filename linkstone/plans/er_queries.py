"""The queries: each applies operators to the entity views of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstone.functions import similarity as S
from linkstone.functions import text as T
from linkstone.operators import blocking, evaluation, features, resolution, similar_sets, training, validation
from linkstone.sources import entity_views
from linkstone.sources.scratch import cut, large

DIGITS = 6
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _records(spark, sf_dir, view: str = "synthetic") -> DataFrame:
    return entity_views.synthetic(spark, sf_dir) if view == "synthetic" else entity_views.from_documents(spark, sf_dir)


def _sides(records: DataFrame, profile: str = "P") -> tuple[DataFrame, DataFrame]:
    r = T.profiled(records, profile)
    return r.where("source = 'S1'"), r.where("source <> 'S1'")


def _truth(records: DataFrame) -> DataFrame:
    a = records.where("source = 'S1'").select("entity", F.col("entity_id").alias("s1"))
    return a.join(large(records.where("source <> 'S1'").select("entity", F.col("entity_id").alias("target"))), "entity").select("s1", "target")


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- views and normalisation ---------------------------------------------------------------------------------------


@query
def view_synthetic(spark, sf_dir):
    return _records(spark, sf_dir).drop("entity")


@query
def view_documents(spark, sf_dir):
    return _records(spark, sf_dir, "documents").drop("entity")


@query
def clean_name(spark, sf_dir):
    r = _records(spark, sf_dir).unionByName(_records(spark, sf_dir, "documents"))
    p = T.profiled(r)
    return p.select("entity_id", "source", "seq", "clean_name", "compressed", F.array_join(F.array_sort("core"), " ").alias("core"))


def _clean_name_of(profile):
    def run(spark, sf_dir):
        r = _records(spark, sf_dir)
        tokens = T.name_tokens("business_name", profile)
        return r.select("entity_id", F.array_join(tokens, " ").alias("clean_name"), F.array_join(tokens, "").alias("compressed"), F.array_join(F.array_sort(T.core_tokens(tokens, profile)), " ").alias("core"))

    return run


for _p in ("C", "V6", "L"):
    QUERIES[f"clean_name_{_p.lower()}"] = _clean_name_of(_p)


@query
def clean_addr(spark, sf_dir):
    return _records(spark, sf_dir).select("entity_id", *[T.clean_addr("business_address", p).alias(f"addr_{p.lower()}") for p in ("P", "C", "V6", "L")])


@query
def domain_stem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.domain_stem(F.col("url")).alias("stem"))


@query
def anchors(spark, sf_dir):
    a = "business_address"
    return _records(spark, sf_dir).select("entity_id", T.door(a).alias("door"), T.pin(a).alias("pin"), T.phone(a).alias("phone"))


@query
def anchor_sets(spark, sf_dir):
    all_, pins, phones = T.anchor_sets("business_address")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return _records(spark, sf_dir).select("entity_id", joined(all_).alias("anchors"), joined(pins).alias("pins"), joined(phones).alias("phones"), joined(F.array_except(all_, pins)).alias("doors"), joined(T.digit_tokens("business_address")).alias("digits"))


@query
def addr_keys(spark, sf_dir):
    return T.profiled(_records(spark, sf_dir)).select("entity_id", F.array_join("addr_keys", " ").alias("addr_keys"))


@query
def transliterate(spark, sf_dir):
    return _records(spark, sf_dir, "documents").select("entity_id", T.transliterate(F.col("business_name")).alias("name"))


# --- blocking ------------------------------------------------------------------------------------------------------


@query
def token_idf_prod(spark, sf_dir):
    _, targets = _sides(_records(spark, sf_dir))
    return _round(blocking.idf_production(blocking.postings(targets), targets))


@query
def token_idf_lexicon(spark, sf_dir):
    tokens = T.name_tokens("business_name", "IDF")
    return _round(blocking.idf_lexicon(_records(spark, sf_dir).withColumn("tokens", tokens)))


@query
def doc_freq(spark, sf_dir):
    return blocking.frequencies(blocking.postings(_sides(_records(spark, sf_dir))[1]))


@query
def stop_key_prune(spark, sf_dir):
    _, targets = _sides(_records(spark, sf_dir), "V6")
    return blocking.pruned_keys(blocking.postings(targets, "V6"), "V6", per=10)


@query
def postings_token(spark, sf_dir):
    posts = blocking.postings(_sides(_records(spark, sf_dir))[1])
    return posts.where("channel = 'token'").select("country", "source", F.col("key").alias("token"), "entity_id")


def _block(profile, only=None):
    def run(spark, sf_dir):
        r = _records(spark, sf_dir)
        a, b = _sides(r, profile)
        idf = None
        if profile == "C":
            idf = blocking.idf_lexicon(r.withColumn("tokens", T.name_tokens("business_name", "IDF")))
        return _round(blocking.block(a, b, profile, idf, only=only))

    return run


QUERIES |= {"block_multi_topk": _block("P"), "block_v6": _block("V6"), "block_champ": _block("C"), "block_basic": _block("L")}
QUERIES |= {"block_token": _block("P", "token"), "block_anchor": _block("P", "addr_key"), "block_pin": _block("P", "pin"), "block_prefix": _block("P", "prefix")}


@query
def candidate_recall(spark, sf_dir):
    r = _records(spark, sf_dir)
    return blocking.recall(blocking.block(*_sides(r)), _truth(r))


def _similar_texts(spark, sf_dir) -> DataFrame:
    """(s1, target): pairs across sources, of one lang, whose texts' distinct words have a Jaccard similarity of at least 0.7."""
    docs, alike = similar_sets.similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    both = alike.unionByName(alike.toDF("y", "x")).unionByName(docs.select("x", F.col("x").alias("y")).distinct())
    entity = F.concat(F.lit("S"), F.col("doc_id") % 3 + 1, F.lit("-"), "doc_id")
    queries = docs.where("doc_id % 3 = 0").select("x", entity.alias("s1"))
    targets = docs.where("doc_id % 3 <> 0").select(F.col("x").alias("y"), entity.alias("target"))
    return cut(queries.join(large(both), "x").join(large(targets), "y").select("s1", "target"), "similar")


@query
def candidate_recall_documents(spark, sf_dir):
    """Pairs of similar texts across sources, found through names and addresses alone."""
    truth = _similar_texts(spark, sf_dir)
    return blocking.recall(blocking.block(*_sides(_records(spark, sf_dir, "documents")), "L"), truth)


# --- features ------------------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir, profile):
    """Candidates for the features: all pairs of S1 with the targets of their country that share a door."""
    a, b = _sides(_records(spark, sf_dir), profile)
    key = lambda df, name: df.select(F.col("entity_id").alias(name), F.col("door").alias("_d"), F.col("country").alias("_c"))
    near = key(a.where("door <> ''"), "s1").join(large(key(b.where("door <> ''"), "target")), ["_d", "_c"]).select("s1", "target")
    return features.pairs(near, a, b, profile), a, b


@query
def features_prod(spark, sf_dir):
    rows, _, targets = _pairs(spark, sf_dir, "P")
    idf = blocking.idf_lexicon(_records(spark, sf_dir).withColumn("tokens", T.name_tokens("business_name", "IDF")))
    return _round(features.production(rows, idf).drop("name_partial_ratio"))


@query
def features_champ(spark, sf_dir):
    rows, _, _ = _pairs(spark, sf_dir, "C")
    idf = blocking.idf_lexicon(_records(spark, sf_dir).withColumn("tokens", T.name_tokens("business_name", "IDF")))
    return _round(features.championship(rows, idf, 2.0))


@query
def features_v6(spark, sf_dir):
    return _round(features.older(_pairs(spark, sf_dir, "V6")[0]))


@query
def features_basic(spark, sf_dir):
    return _round(features.basic(_pairs(spark, sf_dir, "L")[0]))


@query
def partial_ratio(spark, sf_dir):
    rows, _, _ = _pairs(spark, sf_dir, "P")
    return _round(rows.select("s1", "target", S.partial_ratio("a_clean_name", "b_clean_name").alias("name_partial_ratio")))


def _similarity(f, a, b, profile="P"):
    def run(spark, sf_dir):
        rows, _, _ = _pairs(spark, sf_dir, profile)
        return _round(rows.select("s1", "target", f(F.col("a_" + a), F.col("b_" + b)).alias("similarity")))

    return run


def _similarity_of_lists(kind, column="clean_name", profile="P"):
    """The same pairs, made in memory from the records of a door: each name moves once to the others, not once a pair."""

    def run(spark, sf_dir):
        sides = _sides(_records(spark, sf_dir), profile)

        def lists(df, name):
            df = df.where("door <> ''").select("door", "country", F.struct(F.col("entity_id").alias("id"), F.coalesce(column, F.lit("")).alias("text")).alias(name))
            df = df.withColumn("part", F.expr(f"(row_number() OVER (PARTITION BY door, country ORDER BY {name}.id) - 1) DIV {S.LIST}"))
            return df.groupBy("door", "country", "part").agg(F.collect_list(name).alias(name)).drop("part")

        met = lists(sides[0], "a").join(large(lists(sides[1], "b")), ["door", "country"])
        met = met.select(F.col("a.id").alias("s1"), F.col("a.text").alias("a"), F.col("b.id").alias("target"), F.col("b.text").alias("b"))
        return _round(met.mapInArrow(S.over_lists(kind), "s1 string, target string, similarity double"))

    return run


QUERIES |= {
    "indel_ratio": _similarity_of_lists("indel"), "token_sort_ratio": _similarity(S.token_sort_ratio, "clean_name", "clean_name"),
    "token_set_ratio": _similarity(S.token_set_ratio, "clean_name", "clean_name"), "jaro_winkler": _similarity_of_lists("jaro_winkler"),
    "char_trigram_jaccard": _similarity(S.trigram_jaccard, "compressed", "compressed"), "token_jaccard": _similarity(S.jaccard, "tokens", "tokens"),
    "token_containment": _similarity(S.containment, "tokens", "tokens"),
}


# --- scores and resolution -----------------------------------------------------------------------------------------


def _scored(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates with a score from shared tokens and anchors that both engines compute alike: (scored, queries, records)."""
    r = _records(spark, sf_dir)
    a, b = _sides(r)
    cand = blocking.block(a, b)
    rows = features.pairs(cand, a, b)
    score = 0.2 + 0.4 * S.jaccard(F.col("a_core"), F.col("b_core")) + 0.2 * S.three_way(F.col("a_door"), F.col("b_door")) + 0.2 * S.three_way(F.col("a_pin"), F.col("b_pin"))
    rows = rows.withColumn("prob", F.round(F.greatest(F.lit(0.0), score), DIGITS))
    rows = rows.join(large(a.select(F.col("entity_id").alias("s1"), F.col("seq").alias("s1_seq"))), "s1").join(large(b.select(F.col("entity_id").alias("target"), F.col("seq").alias("target_seq"))), "target")
    return rows, a, r


def _scored_columns(rows):
    return rows.select("s1", "s1_seq", "target", "target_seq", "source", "prob", "cand_pos")


@query
def logistic_score(spark, sf_dir):
    rows, _, _ = _pairs(spark, sf_dir, "P")
    idf = blocking.idf_lexicon(_records(spark, sf_dir).withColumn("tokens", T.name_tokens("business_name", "IDF")))
    return features.production(rows, idf).select("s1", "target", F.round(resolution.logistic(), DIGITS).alias("prob"))


@query
def ensemble_blend(spark, sf_dir):
    rows, _, _ = _scored(spark, sf_dir)
    other = S.jaccard(F.col("a_tokens"), F.col("b_tokens"))
    return _round(rows.select("s1", "target", resolution.blend(F.col("prob"), other).alias("prob")).where(F.col("prob") >= resolution.PREFILTER))


@query
def adaptive_threshold(spark, sf_dir):
    rows, _, _ = _scored(spark, sf_dir)
    return rows.select("s1", "target", resolution.adaptive_threshold().alias("threshold"))


def _match_columns(df):
    return df.select("s1", "target", "prob", "match_pos")


@query
def resolve_bipartite(spark, sf_dir):
    return _match_columns(resolution.bipartite(_scored_columns(_scored(spark, sf_dir)[0])))


@query
def resolve_exclusive_global(spark, sf_dir):
    rows, _, _ = _scored(spark, sf_dir)
    return _match_columns(resolution.exclusive(rows.withColumn("threshold", resolution.adaptive_threshold(0.7)).select("s1", "s1_seq", "target", "target_seq", "source", "prob", "cand_pos", "threshold")))


@query
def resolve_top3_per_source(spark, sf_dir):
    return _match_columns(resolution.top_per_source(_scored_columns(_scored(spark, sf_dir)[0]), 0.5))


@query
def candidates_top4_per_source(spark, sf_dir):
    return _match_columns(resolution.candidates_per_source(_scored_columns(_scored(spark, sf_dir)[0])))


@query
def resolve_threshold(spark, sf_dir):
    return resolution.plain(_scored_columns(_scored(spark, sf_dir)[0])).select("s1", "target", "prob")


@query
def resolve_minimal(spark, sf_dir):
    """The smallest whole run: names, shared tokens, core Jaccard, one owner a target, one row for each query."""
    a, b = _sides(_records(spark, sf_dir))
    rows = features.pairs(blocking.block(a, b, top_k=5), a, b).withColumn("prob", F.round(S.jaccard(F.col("a_core"), F.col("b_core")), DIGITS))
    rows = rows.join(large(a.select(F.col("entity_id").alias("s1"), F.col("seq").alias("s1_seq"))), "s1").withColumn("target_seq", F.substring_index("target", "-", -1).cast("long"))
    return resolution.lists(resolution.bipartite(rows), a).select("s1_id", F.array_join("ids", ",").alias("matched_entity_ids"))


@query
def matching_output(spark, sf_dir):
    rows, a, _ = _scored(spark, sf_dir)
    return resolution.lists(resolution.bipartite(_scored_columns(rows)), a).select("s1_id", F.array_join("ids", ",").alias("matched_entity_ids"))


@query
def candidate_superset(spark, sf_dir):
    rows, a, _ = _scored(spark, sf_dir)
    matched = resolution.lists(resolution.bipartite(_scored_columns(rows)), a)
    return resolution.superset(matched, resolution.pool(rows)).select("s1_id", F.array_join("ids", ",").alias("candidate_entity_ids"))


# --- evaluation and training sets ----------------------------------------------------------------------------------


def _macro(beta):
    def run(spark, sf_dir):
        rows, a, r = _scored(spark, sf_dir)
        return evaluation.macro_fbeta(a.select(F.col("entity_id").alias("s1")), resolution.bipartite(_scored_columns(rows)), _truth(r), beta)

    return run


QUERIES |= {"macro_fbeta_05": _macro(0.5), "macro_fbeta_2": _macro(2.0)}


@query
def threshold_sweep(spark, sf_dir):
    rows, a, r = _scored(spark, sf_dir)
    return evaluation.sweep(_scored_columns(rows), a.select(F.col("entity_id").alias("s1")), _truth(r))


def _sweep(profile):
    def run(spark, sf_dir):
        rows, a, r = _scored(spark, sf_dir)
        return evaluation.sweep(_scored_columns(rows), a.select(F.col("entity_id").alias("s1")), _truth(r), profile)

    return run


QUERIES |= {"threshold_sweep_v6": _sweep("V6"), "threshold_sweep_champ": _sweep("C")}


@query
def country_coverage(spark, sf_dir):
    rows, a, _ = _scored(spark, sf_dir)
    return evaluation.coverage(a.select(F.col("entity_id").alias("s1"), "country"), resolution.bipartite(_scored_columns(rows)))


@query
def hard_negatives(spark, sf_dir):
    r = _records(spark, sf_dir)
    return training.hard_negatives(blocking.block(*_sides(r)), _truth(r)).select("s1", "target", "neg_pos")


@query
def training_pairs(spark, sf_dir):
    r = _records(spark, sf_dir)
    a, b = _sides(r)
    return training.training_pairs(blocking.block(a, b), _truth(r), b)


@query
def label_pairs(spark, sf_dir):
    r = _records(spark, sf_dir)
    return training.labelled_candidates(blocking.block(*_sides(r, "L"), "L", top_k=15), _truth(r))


@query
def class_balance(spark, sf_dir):
    r = _records(spark, sf_dir)
    a, b = _sides(r)
    return evaluation.class_balance(training.training_pairs(blocking.block(a, b), _truth(r), b))


@query
def sample_distractors(spark, sf_dir):
    r = _records(spark, sf_dir)
    needed = r.where("source <> 'S1' AND seq % 10 = 0").select("entity_id")
    return training.sample_distractors(r.where("source <> 'S1'"), needed).select("entity_id")


@query
def hash_split(spark, sf_dir):
    return training.split(_records(spark, sf_dir).where("source = 'S1'"), "entity_id").select("entity_id", "part")


@query
def position_split(spark, sf_dir):
    return training.split_by_position(_records(spark, sf_dir).where("source = 'S1'"), "seq").select("entity_id", "part")


@query
def needed_targets(spark, sf_dir):
    r = _records(spark, sf_dir)
    sampled = _truth(r).join(large(training.split(r.where("source = 'S1'"), "entity_id", 20).where("part = 'train'").select(F.col("entity_id").alias("s1"))), "s1", "left_semi")
    return training.needed_targets(sampled.groupBy(F.col("s1").alias("s1_id")).agg(F.collect_list("target").alias("target_ids")))


@query
def auc(spark, sf_dir):
    rows, _, r = _scored(spark, sf_dir)
    labelled = rows.join(large(_truth(r).withColumn("_t", F.lit(1))), ["s1", "target"], "left").select("prob", F.coalesce("_t", F.lit(0)).alias("label"))
    return evaluation.auc(labelled)


@query
def gbt_score(spark, sf_dir):
    """Trees on the 16 production features of labelled pairs; scores of all pairs with their part. 20 trees of depth 5, Spark's own."""
    r = _records(spark, sf_dir)
    a, b = _sides(r)
    labelled = cut(training.training_pairs(blocking.block(a, b), _truth(r), b), "labelled")
    idf = blocking.idf_lexicon(r.withColumn("tokens", T.name_tokens("business_name", "IDF")))
    x = features.production(features.pairs(labelled.select("s1", "target"), a, b), idf)
    x = cut(training.split(x.join(large(labelled), ["s1", "target"]), "s1"), "scored")
    model = training.fit_boosted(x.where("part = 'train'"), features.P)
    return training.score(model, x).select("s1", "target", "label", "part", F.round("prob", DIGITS).alias("prob"))


@query
def shuffle_slices(spark, sf_dir):
    return training.slices(_records(spark, sf_dir).where("source = 'S1'"), "entity_id", 600, 150).select("entity_id", "part")


@query
def training_postings_v6(spark, sf_dir):
    posts = blocking.postings(_sides(_records(spark, sf_dir), "V6")[1], "V6")
    return blocking.first_postings(posts).select("country", "source", "channel", "key", "entity_id")


# --- validation ----------------------------------------------------------------------------------------------------


def _broken_lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Match lists with every fault in some rows, by the entity's number; and the queries that are required."""
    r = _records(spark, sf_dir)
    s1 = r.where("source = 'S1'").select(F.col("entity_id").alias("s1"), "seq")
    k = F.col("seq")
    text = F.concat(F.lit("S2-"), k.cast("string"))
    ids = (
        F.when(k % 97 == 1, F.array(text, text)).when(k % 89 == 2, F.array(F.concat(F.lit("S1-"), k))).when(k % 83 == 3, F.array(F.lit(""), text))
        .when(k % 79 == 4, F.array(F.concat(F.lit("S3-x"), k))).when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(text))
    )
    rows = s1.where(k % 71 != 5).select("s1", ids.alias("ids"), "seq")
    twice = rows.where(F.col("seq") % 101 == 6)
    extra = rows.where(F.col("seq") % 103 == 7).withColumn("s1", F.concat("s1", F.lit("e")))
    return rows.unionByName(twice).unionByName(extra), s1.select("s1")


@query
def validate_lists(spark, sf_dir):
    rows, required = _broken_lists(spark, sf_dir)
    known = _records(spark, sf_dir).where("source <> 'S1'").select("entity_id")
    return validation.list_rules(rows, required, known).select("rule", "level", "n", F.array_join("examples", ",").alias("examples"))


@query
def list_counts(spark, sf_dir):
    return validation.counts(_broken_lists(spark, sf_dir)[0])


def _validate(rule):
    def run(spark, sf_dir):
        return validate_lists(spark, sf_dir).where(F.col("rule").isin(rule))

    return run


QUERIES |= {
    "validate_duplicates": _validate(["duplicate_query", "repeated_id"]), "validate_prefix": _validate(["self_match", "bad_prefix"]),
    "validate_required": _validate(["missing_query", "extra_query"]), "validate_unknown_ids": _validate(["unknown_id"]),
}


@query
def validate_subset(spark, sf_dir):
    rows, _ = _broken_lists(spark, sf_dir)
    candidates = rows.where("seq % 5 <> 0").withColumn("ids", F.array_union("ids", F.array(F.lit("S3-0"))))
    return validation.subset_rule(rows, candidates).select("rule", "level", "n", F.array_join("examples", ",").alias("examples"))


@query
def invariants(spark, sf_dir):
    """Counts of what must not happen in the resolved matches: all zero."""
    rows, a, r = _scored(spark, sf_dir)
    m = cut(resolution.bipartite(_scored_columns(rows)), "matches")
    owner = m.groupBy("target").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    many = m.groupBy("s1").agg(F.count(F.lit(1)).alias("c")).where("c > 6")
    outside = m.join(large(rows.select("s1", "target")), ["s1", "target"], "left_anti")
    place = lambda name: r.select(F.col("entity_id").alias(name), F.col("country").alias(name + "_country"))
    abroad = m.join(large(place("s1")), "s1").join(large(place("target")), "target").where("s1_country <> target_country")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("invariant"), "n")
    return count(owner, "two_owners").unionByName(count(many, "over_cap")).unionByName(count(outside, "outside_candidates")).unionByName(count(abroad, "other_country"))
