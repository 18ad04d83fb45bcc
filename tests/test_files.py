from linkstone.operators import validation
from linkstone.sources import tsv


def put(path, *lines):
    path.write_text("".join(line + "\n" for line in lines), encoding="utf-8")
    return str(path)


HEAD = "source1_entity_id\tmatched_entity_ids"
CHEAD = "source1_entity_id\tcandidate_entity_ids"


def test_records(spark, tmp_path):
    p = put(tmp_path / "s1.tsv", "entity_id\tbusiness_name\tbusiness_address\tcountry", 'S1-1\t"Q" Ltd\t\t US ', "S1-2\tshort row", "S1-3\ta\tb\tFrance")
    got = [(r.entity_id, r.business_name, r.business_address, r.country, r.source) for r in tsv.read_records(spark, p).orderBy("seq").collect()]
    assert got == [("S1-1", '"Q" Ltd', "", "US", "S1"), ("S1-3", "a", "b", "France", "S1")] and tsv.rejected_rows(spark, p).first().rejected == 1
    assert tsv.read_ids(spark, p).count() == 3


def test_truth_and_lists(spark, tmp_path):
    p = put(tmp_path / "t.tsv", HEAD, "S1-1\tS2-1,S3-2", "S1-2\t", "S1-3\tS2-9")
    assert {r.s1_id: r.target_ids for r in tsv.read_truth(spark, p).collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": [], "S1-3": ["S2-9"]}
    assert [r.s1_id for r in tsv.read_truth(spark, p, first=2).collect()] == ["S1-1"]
    lists = spark.createDataFrame([("S1-2", 1, []), ("S1-1", 0, ["S2-1", "S3-2"])], "s1_id string, seq long, ids array<string>")
    tsv.write_lists(lists, str(tmp_path / "out"), ("source1_entity_id", "matched_entity_ids"))
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))
    assert text == f"{HEAD}\nS1-1\tS2-1,S3-2\nS1-2\t\n"


def test_defaults_and_shards(spark, tmp_path):
    assert tsv.read_value(spark, str(tmp_path / "none.txt"), 0.8) == 0.8 and tsv.read_value(spark, put(tmp_path / "v.txt", "0.85"), 0.8) == 0.85
    assert tsv.read_idf(spark, str(tmp_path / "noidf")).count() == 0
    df = spark.createDataFrame([("a", "US"), ("b", "India")], "id string, country string")
    tsv.save_shard(df, str(tmp_path / "shards"))
    tsv.save_shard(df.where("country = 'US'").union(df.where("country = 'US'")), str(tmp_path / "shards"))
    done = spark.read.parquet(str(tmp_path / "shards"))
    assert done.count() == 3 and tsv.missing_shards(spark.createDataFrame([("c", "France"), ("d", "US")], "id string, country string"), done).count() == 1


def report(spark, tmp_path, lines, candidates=None, known=None):
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    ids = None if known is None else spark.createDataFrame([(k,) for k in known], "entity_id string")
    m = put(tmp_path / "m.tsv", *lines)
    c = None if candidates is None else put(tmp_path / "c.tsv", *candidates)
    return {r.rule: (r.level, r.n, r.examples) for r in validation.validate(spark, m, c, required, ids).collect()}


def test_rules(spark, tmp_path):
    ok = report(spark, tmp_path, [" Source1_Entity_ID \tMATCHED_entity_ids", "S1-1\tS2-1", "", "S1-2\t"], [CHEAD, "S1-1\tS2-1,S3-1", "S1-2\t"], ["S2-1", "S3-1"])
    assert ok == {}
    bad = report(spark, tmp_path, [HEAD, "S1-1\tS2-1,S2-1", "S1-1\tS1-4", "no tab", "S1-9\tS2-1, S2-2,", "S1-9\tS2-77"], [CHEAD, "S1-1\tS2-5", "S1-2\t"], ["S2-1"])
    assert set(bad) == {"line_without_tab", "duplicate_query", "repeated_id", "self_match", "bad_prefix", "missing_query", "extra_query", "unknown_id", "match_outside_candidates", "candidate_unknown_id"}
    assert bad["bad_prefix"][1:] == (2, ["", " S2-2"]) and bad["match_outside_candidates"][0] == "warning" and bad["missing_query"][2] == ["S1-2"]
    assert set(report(spark, tmp_path, ["a,b", "x"])) == {"comma_header"} and set(report(spark, tmp_path, ["a\tb", "x"])) == {"wrong_header"}
    notes = report(spark, tmp_path, [HEAD, "S1-1\t", "S1-2\t"])
    assert set(notes) == {"ids_unchecked", "no_candidate_file"} and all(v[0] == "warning" for v in notes.values())
    missing = validation.validate(spark, str(tmp_path / "no.tsv"), None, spark.createDataFrame([], "s1 string"))
    assert missing.first().rule == "missing_file" and not validation.passes(missing)
    (tmp_path / "latin.tsv").write_bytes((HEAD + "\nS1-1\t\xe9\nS1-2\t\n").encode("latin-1"))
    assert "not_utf8" in {r.rule for r in validation.validate(spark, str(tmp_path / "latin.tsv"), None, spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")).collect()}


def test_command(spark, tmp_path, capsys):
    from linkstone import check_lists

    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    source = put("s1.tsv", head + "S1-1\ta\tb\tUS\nS1-2\ta\tb\tUS\n")
    targets = put("s2.tsv", head + "S2-1\ta\tb\tUS\n")
    good = put("good.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    more = put("more.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\tS2-1\n")
    assert check_lists.main([good, "--candidate", more, "--source", source, "--targets", targets], spark) == 0
    assert "2 rows, 1 empty, 1 with ids" in capsys.readouterr().out
    bad = put("bad.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-9\n")
    assert check_lists.main([bad, "--source", source, "--targets", targets], spark) == 1
    said = capsys.readouterr().out
    assert "error: unknown_id: 1 (S2-9)" in said and "error: missing_query: 1 (S1-2)" in said and said.endswith("FAIL\n")
    (tmp_path / "bytes.tsv").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\xff\n")
    assert check_lists.main([str(tmp_path / "bytes.tsv"), "--source", source], spark) == 1
    assert "not_utf8" in capsys.readouterr().out
    assert check_lists.main([str(tmp_path / "none.tsv"), "--source", source], spark) == 1


def test_scorer_is_saved_and_loaded(spark, tmp_path):
    from linkstone.operators import training

    rows = spark.createDataFrame([(float(k % 7), float(k % 3), int(k % 7 > 3)) for k in range(70)], "x double, y double, label int")
    model = training.fit_boosted(rows, ["x", "y"], trees=2, depth=2)
    training.save_scorer(spark, str(tmp_path / "s"), model, spark.createDataFrame([("a", 1.5)], "token string, idf double"), 0.42)
    again, idf, threshold = training.load_scorer(spark, str(tmp_path / "s"))
    assert training.score(again, rows).collect() == training.score(model, rows).collect()
    assert [tuple(r) for r in idf.collect()] == [("a", 1.5)] and threshold == 0.42
