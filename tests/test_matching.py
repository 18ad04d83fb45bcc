from pyspark.sql import functions as F

from linkstone.functions import text as T
from linkstone.operators import blocking, evaluation, resolution, training
from linkstone.streaming import incremental

RECORD = "entity_id string, business_name string, business_address string, country string, source string, seq long"


def records(spark, rows):
    return T.profiled(spark.createDataFrame([(e, n, a, "US", e[:2], i) for i, (e, n, a) in enumerate(rows)], RECORD))


TARGETS = [("S2-99999", "DREXTAVO", "300 SWIFT AVE, DURHAM, NC"), ("S2-11111", "http://www.sakshisai.com", "PRANAVAMCHUZHIKATTU HOUSE, KM 4/109/5, VYTHIRI, Kerala"), ("S3-7", "Other Name", "1 Elm Street")]


def test_golden_candidates(spark):
    q = records(spark, [("S1-1", "Advanced Intelligence Products", "300 Swift Avenue, Unit 5, Durham, NC"), ("S1-2", "Sakshi Sai Private Limited", "Pranavamchuzhikattu House, Km 4/109/5, Vythiri, Wayanad, Kerala")])
    got = {(r.s1, r.target): r.block_score for r in blocking.block(q, records(spark, TARGETS), top_k=5).collect()}
    assert got["S1-1", "S2-99999"] == 15.0 and got["S1-2", "S2-11111"] == 49.0


def test_caps_cut_and_drop_keys(spark):
    t = records(spark, [(f"S2-{i}", "common rare" + str(i), f"{5} Main, Town, 12345") for i in range(8)])
    posts = blocking.postings(t)
    old = blocking.CHANNELS["P"]
    blocking.CHANNELS["P"] = [blocking.Channel("token", None, 5, 3, 0.1), blocking.Channel("addr_key", 15.0, 7), blocking.Channel("pin", 3.0, 8), blocking.Channel("prefix", 4.0, 2, 2)]
    try:
        live = blocking.admitted(posts).groupBy("channel", "key").count().collect()
    finally:
        blocking.CHANNELS["P"] = old
    n = {(r["channel"], r["key"]): r["count"] for r in live}
    assert n["token", "common"] == 3 and n["token", "rare3"] == 1 and n["pin", "12345"] == 8 and n["prefix", "commo"] == 2 and not any(c == "addr_key" for c, _ in n)


def test_stream_gives_the_same_candidates(spark, tmp_path):
    q = spark.createDataFrame([("S1-1", "Drextavo", "300 Swift Ave", "US", "S1", 0), ("S1-2", "Sakshi Sai", "", "US", "S1", 1)], RECORD)
    q.write.json(str(tmp_path / "in"))
    t, got = records(spark, TARGETS), []
    stream = spark.readStream.schema(RECORD).json(str(tmp_path / "in"))
    incremental.match_stream(stream, t, lambda df, _: got.extend(df.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, got)) == sorted(map(tuple, blocking.block(T.profiled(q), t).collect()))


def scored(spark, rows):
    seq = {s: i for i, s in enumerate(dict.fromkeys(r[0] for r in rows))}
    return spark.createDataFrame([(s, seq[s], t, int("".join(c for c in t if c.isdigit()) or 0), t[:2], float(p), k) for k, (s, t, p) in enumerate(rows)], "s1 string, s1_seq long, target string, target_seq long, source string, prob double, cand_pos int")


def test_resolution(spark):
    def ids(rows, queries, threshold=0.5):
        q = spark.createDataFrame([(s, i) for i, s in enumerate(queries)], "entity_id string, seq long")
        return {r.s1_id: r.ids for r in resolution.lists(resolution.bipartite(scored(spark, rows), threshold), q).collect()}

    assert ids([("S1-A", "S2-1", 0.7), ("S1-A", "S2-2", 0.9), ("S1-B", "S2-1", 0.95)], ["S1-A", "S1-B", "S1-C"]) == {"S1-A": ["S2-2"], "S1-B": ["S2-1"], "S1-C": []}
    assert ids([("S1-A", "S2-1", 0.8), ("S1-B", "S2-1", 0.8)], ["S1-A", "S1-B"]) == {"S1-A": ["S2-1"], "S1-B": []}
    seven = ids([("S1-A", f"S2-{i}", 0.9 - i / 100) for i in range(7)] + [("S1-B", "S2-6", 0.6)], ["S1-A", "S1-B"])
    assert len(seven["S1-A"]) == 6 and "S2-6" not in seven["S1-A"] and seven["S1-B"] == []
    assert ids([("S1-A", "S2-1", 0.5)], ["S1-A"]) == {"S1-A": ["S2-1"]}


def test_superset(spark):
    m = spark.createDataFrame([("a", 0, ["x"]), ("b", 1, list("123456")), ("c", 2, list("123456")), ("d", 3, [])], "s1_id string, seq long, ids array<string>")
    p = spark.createDataFrame([("a", list("xyzuvwt")), ("b", ["9", "8"]), ("c", ["1", "9"])], "s1 string, pool array<string>")
    assert {r.s1_id: "".join(r.ids) for r in resolution.superset(m, p).collect()} == {"a": "xyzuvw", "b": "1234569", "c": "123456", "d": ""}


def test_metric(spark):
    cases = {"A": ([], []), "B": (["A"], []), "C": ([], ["A"]), "D": (["A", "B"], ["A", "B"]), "E": (["A"], ["A", "B"])}
    q = spark.createDataFrame([(c,) for c in cases], "s1 string")
    pairs = lambda k: spark.createDataFrame([(c, t) for c, v in cases.items() for t in v[k]], "s1 string, target string")
    score = lambda beta: {r.s1: round(r.score, 4) for r in evaluation.per_query(q, pairs(1), pairs(0), beta).collect()}
    assert score(2.0) == {"A": 1, "B": 0, "C": 0, "D": 1, "E": 0.8333} and score(0.5)["E"] == 0.5556
    f = spark.createDataFrame([(1, 0, 1), (3, 2, 5), (2, 4, 1)], "tp int, fp int, fn int").select(*[F.round(evaluation.fbeta(F.col("tp"), F.col("fp"), F.col("fn"), b), 6) for b in (0.5, 2.0)]).collect()
    assert [tuple(r) for r in f] == [(0.833333, 0.555556), (0.535714, 0.405405), (0.370370, 0.555556)]
    empty = spark.createDataFrame([], "s1 string")
    assert evaluation.macro_fbeta(empty, pairs(1).limit(0), pairs(0).limit(0)).first().macro == 0.0


def test_models(spark):
    rows = training.split(spark.range(400).selectExpr("cast(id as string) as s1", "cast(id % 17 as double) as a", "cast(id % 5 as double) as b", "cast((id % 17) > 8 as int) as label"), "s1")
    train = rows.where("part = 'train'")
    boosted, linear = training.fit_boosted(train, ["a", "b"], trees=4, depth=3), training.fit_linear(train, ["a", "b"])
    both = training.score(linear, training.score(boosted, rows.where("part = 'validation'"), "p1"), "p2").withColumn("prob", resolution.blend(F.col("p1"), F.col("p2")))
    assert evaluation.auc(both).first().auc_roc > 0.98 and training.importances(boosted, ["a", "b"])[0][0] == "a"
    assert {round(r.w, 6) for r in training.balanced_weights(rows).groupBy("label").agg(F.sum("weight").alias("w")).collect()} == {200.0}


def test_idf_sum_of_an_empty_table_is_nothing(spark):
    from linkstone.operators import features

    names = [f"{side}_{c}" for side in "ab" for c in ("clean_name", "compressed", "clean_addr", "door", "pin", "phone")]
    row = {"s1": "q", "target": "S2-t", **dict.fromkeys(names, "x")}
    arrays = {f"{side}_{c}": ["x", "y"] for side in "ab" for c in ("core", "addr_keys")}
    schema = "s1 string, target string, " + ", ".join(f"{n} string" for n in names) + ", " + ", ".join(f"{n} array<string>" for n in arrays)
    pairs = spark.createDataFrame([(row | arrays)], schema)
    value = lambda idf: features.production(pairs, spark.createDataFrame(idf, "token string, idf double")).first()["core_idf_sum"]
    assert value([]) == 0.0 and value([("x", 2.5)]) == 14.5
