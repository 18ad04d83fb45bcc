import math

import pytest

import __spark_entry__
from linkstone.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", ["clean_name", "anchor_sets", "candidate_recall_documents", "block_multi_topk", "block_champ", "features_prod", "features_champ", "features_basic", "candidate_superset", "threshold_sweep", "threshold_sweep_v6", "candidates_top4_per_source", "training_postings_v6", "shuffle_slices", "list_counts", "validate_lists"])
def test_against_sql(spark, sf, con, name):
    want = con.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, sf).select(*want.columns)
    rows = lambda r: sorted((tuple(map(plain, x)) for x in r), key=str)
    assert rows(got.collect()) == rows(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
