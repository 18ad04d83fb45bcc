"""Joins of tables that grow with the input must not send one of them through the driver, however small the planner takes it to be."""

import re

import pytest
from pyspark.sql import functions as F

from linkstone.functions import text as T
from linkstone.operators import blocking
from linkstone.plans import catalog
from linkstone.sources import entity_views


@pytest.mark.parametrize("name", ["block_anchor", "block_pin", "block_prefix", "adaptive_threshold", "macro_fbeta_05", "macro_fbeta_2", "country_coverage", "hard_negatives", "class_balance", "matching_output", "block_multi_topk"])
def test_no_growing_table_is_broadcast(spark, sf, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan is the one that runs
    try:
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sent = re.findall(r"Broadcast\w*Join \[[^\]]*\]", plan)
    assert "SortMergeJoin" in plan and not [x for x in sent if not re.fullmatch(r"BroadcastHashJoin \[country#\d+, source#\d+\]", x)]  # one row for each country and source


def test_shortened_keys_are_shared_and_change_nothing(spark, sf, monkeypatch):
    """Against each query paired with every posting that its keys admit."""
    channels = [blocking.Channel("token", None, 12, 8, 0.1), blocking.Channel("addr_key", 15.0, 3), blocking.Channel("pin", 3.0, 2), blocking.Channel("prefix", 4.0, 3, 3)]
    monkeypatch.setitem(blocking.CHANNELS, "P", channels)
    r = T.profiled(entity_views.synthetic(spark, sf))
    a, b = r.where("source = 'S1'"), r.where("source <> 'S1'")
    posts = blocking.postings(b)
    every = blocking.probes(a, blocking.idf_production(posts, b)).join(blocking.admitted(posts).select(*blocking.KEY, "df", "seq", "entity_id"), blocking.KEY)
    weight = F.when((F.col("channel") == "token") & (F.col("df") > 12), F.col("weight") * 0.1).otherwise(F.col("weight"))
    scored = every.groupBy("s1", "source", F.col("entity_id").alias("target"), "seq").agg(F.round(F.sum(weight), 6).alias("block_score"))
    best = scored.withColumn("cand_pos", F.expr("row_number() OVER (PARTITION BY s1, source ORDER BY block_score DESC, seq)")).where("cand_pos <= 2")
    rows = lambda df: sorted((x.s1, x.target, round(x.block_score, 5), x.cand_pos) for x in df.select("s1", "target", "block_score", "cand_pos").collect())
    met = []
    kept = blocking._pairs_of_shortened
    monkeypatch.setattr(blocking, "_pairs_of_shortened", lambda *x: met.append(kept(*x)) or met[0])
    assert rows(blocking.block(a, b, top_k=2)) == rows(best)
    assert met[0].count() < every.count()
