"""Pairs are made in memory from lists; tables of pairs, and calls for each pair, would not fit the limits at size."""

import numpy as np

from linkstone.functions import similarity as S
from linkstone.functions import text as T
from linkstone.operators import blocking
from linkstone.plans import er_queries
from linkstone.sources import entity_views


def test_lists_of_a_key_move_once_to_each_bucket(spark, sf, monkeypatch):
    r = T.profiled(entity_views.synthetic(spark, sf), "L")
    a, b = r.where("source = 'S1'"), r.where("source <> 'S1'")
    met, made = [], blocking._pairs_of_shortened
    monkeypatch.setattr(blocking, "_pairs_of_shortened", lambda *x: met.append(made(*x)) or met[0])
    blocking.block(a, b, "L")
    pairs = blocking.probes(a, None, "L").join(blocking.admitted(blocking.postings(b, "L"), "L"), blocking.KEY).count()
    assert sum(len(x.nos) for x in met[0].collect()) < pairs


def test_rounds_change_nothing(spark, sf, monkeypatch):
    r = T.profiled(entity_views.synthetic(spark, sf))
    a, b = r.where("source = 'S1'"), r.where("source <> 'S1'")
    whole = sorted(blocking.block(a, b).collect())
    monkeypatch.setattr(blocking, "PROBES_AT_ONCE", 1500)
    monkeypatch.setattr(blocking, "AT_ONCE", 300)
    assert sorted(blocking.block(a, b).collect()) == whole


def test_similarities_of_lists():
    texts = ["", "a", "ab", "acme steel", "steel acme", "acme acme", "x" * 63, "x" * 64 + " acme", "zq lan", "dwayne", "duane", "martha", "marhta"]
    import pyarrow as pa

    ids = [str(k) for k in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"s1": [ids], "a": [texts], "target": [ids], "b": [texts]})
    for kind, f in (("indel", S.indel), ("jaro_winkler", S.jaro_winkler)):
        got = pa.Table.from_batches(S.over_lists(kind)([batch])).to_pylist()
        assert {(x["s1"], x["target"]): x["similarity"] for x in got} == {(i, j): f(texts[int(i)], texts[int(j)]) for i in ids for j in ids}
    assert np.array_equal(S.indel_of_one("", S._masks([""]), np.array([0])), [100.0])


def test_no_row_for_each_pair_goes_to_python(spark, sf):
    for name in ("indel_ratio", "jaro_winkler"):
        plan = er_queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
