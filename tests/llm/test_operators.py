import hashlib
import random

import brute
import numpy as np
import pytest

from linkstone.llm import common, decontamination, exact_dedup, jaccard_join, quality, queries, sentencepiece_codec, sharding, substring_dedup, token_counts, toxicity, url_filter

LONG = " ".join(f"w{i % 977}" for i in range(300_000))
PASSAGE = " ".join(f"p{i}" for i in range(80))
#: Null ids and texts, empty and very long texts, repeated rows, ties, and columns with names that operators use themselves.
EDGE = [
    (1, "a b c d e", "en"), (2, None, None), (3, "", "en"), (1, "a b c d e", "en"), (None, "x y", "en"), (5, LONG, "en"), (6, LONG + " tail", None), (7, " \t\n", "en"),
    (8, "A  B c D e", "de"), (9, PASSAGE, "en"), (10, "start " + PASSAGE + " end", "en"), (11, "naïve Ünï 日本語 🎉", "en"), (12, None, "en"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, SCHEMA)
    for name in ("_norm", "keep_id", "score", "z", "n", "h", "region", "_kept_id", "_gone", "x", "q", "shard"):
        df = df.withColumn(name, F.lit(f"clash {name}"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.load(spark, sf, "documents")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return common.load(spark, sf, "labels")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_hashes_of_words_and_windows():
    a, b = common.hash_words([b"x y z", b"y  z x"], common.NOT_SPACE, False), common.hash_words([b"q x y\tz"], common.NOT_SPACE, False)
    assert a.first.tolist() == [0, 3, 6] and a.hash[0] == b.hash[1] and a.hash[0] != a.hash[1]
    assert a.windows(3)[0] == b.windows(3)[1] and a.windows(2)[1] == a.windows(2)[3]
    assert common.hash_words([b"AB"], common.ALNUM, True).hash[0] == common.hash_words([b"ab"], common.ALNUM, True).hash[0]


def test_exact_dedup(edge, empty, docs):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(edge).collect()}
    norm = lambda t: hashlib.sha256(b" ".join(brute.SPACE.split((t or "").encode()))).hexdigest()
    assert got[2, norm("")].keep_id == 2 and got[3, norm(None)].keep_id == 2 and got[12, norm("")].group_size == 3
    assert got[1, norm("a b c d e")].group_size == 2 and got[1, norm("a b c d e")].kept and got[None, norm("x y")].kept
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_exact_copies(edge)
    assert kept.columns == edge.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "2", "None", "5", "6", "7", "8", "9", "10", "11"])
    assert exact_dedup.drop_exact_copies(docs).count() == exact_dedup.exact_groups(docs).where("kept").count()


def test_differencing_beats_greedy():
    rng = np.random.default_rng(5)
    w = rng.integers(1, 10_000, 500)
    part = sharding.difference(np.sort(w)[::-1], 24)
    sums = np.bincount(part, np.sort(w)[::-1], 24)
    greedy = np.zeros(24)
    for x in np.sort(w)[::-1]:
        greedy[greedy.argmin()] += x
    assert np.ptp(sums) <= np.ptp(greedy) and sums.sum() == w.sum()
    assert len(sharding.difference(np.array([], int), 3)) == 0 and sharding.difference(np.array([7]), 3).tolist() == [2]


def test_sharding(edge, empty, docs):
    assert sharding.shard_by_bytes(empty).count() == 0
    for df, n in ((edge, 3), (docs, 24)):
        rows = sharding.shard_by_bytes(df, n).collect()
        assert len(rows) == df.count() and {r.law for r in rows} == {"bytes"}
        by, groups = {}, {}
        of = dict(texts(df))
        for r in rows:
            by.setdefault(r.shard, []).append(r)
            if r.doc_id is not None:
                groups.setdefault(of[r.doc_id] or "", set()).add(r.shard)
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values()) and all(len(v) == 1 for v in groups.values())
    sums = [sum(r.size for r in v) for v in by.values()]
    largest = max(sum(r.size for r in rows if of[r.doc_id] == t) for t in set(of.values()))
    assert max(sums) <= max(sum(sums) / 24 * 1.02, largest)


def test_toxicity(edge, empty, docs, labels, spark):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic = {r.doc_id for r in labels.collect() if r.toxic}
    mean = lambda rows: sum(r.score for r in rows) / len(rows)
    assert mean([r for r in got if r.doc_id in toxic]) > mean([r for r in got if r.doc_id not in toxic])
    model = toxicity.fit(docs, labels)
    assert toxicity.score(edge, model).count() == len(EDGE) and toxicity.score(empty, model).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(edge, nothing) is None and {r.score for r in toxicity.score(edge, None).collect()} == {0.0}


def test_toxic_words_decide():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice(["th", "an", "er", "in", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    make = lambda bad: " ".join(rng.choice(["vile", "nasty"]) if bad and rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(200)).encode()
    y = np.arange(300) % 3 == 0
    model = toxicity.fit_sample([make(b) for b in y], y, 1 / 3)
    tools = model.compressors()
    value = lambda t: float((toxicity.features(toxicity.saved_counts(t, *tools), np.array(model.evidence)) @ model.weights)[0])
    held = [(value(make(True)) > 0, value(make(False)) < 0) for _ in range(40)]
    assert np.mean(held) > 0.9


def test_quality(edge, empty, docs, labels, spark):
    got = quality.quality(docs, labels).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert len(got) == docs.count() and np.mean([a == b for a, b in held]) > 0.85
    assert quality.quality(edge, labels).count() == len(EDGE) and quality.quality(empty, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(edge, nothing).count() == len(EDGE)


def test_isotonic():
    assert quality.pool_adjacent(np.array([1, 1, 2.0, 1]), np.array([0, 1, 0, 1.0])).tolist() == [0, 1 / 3, 1 / 3, 1]


def test_substring_dedup(edge, empty, docs):
    assert substring_dedup.dedup_substrings(empty).count() == 0
    for df in (docs, edge):
        want = brute.substring_dedup([x for x in texts(df) if x[0] is not None])
        got = [r for r in substring_dedup.dedup_substrings(df).collect() if r.doc_id is not None]
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and len(got) == len([x for x in texts(df) if x[0] is not None])
    assert want[10][1] == 80 and want[6][1] == 300_000
    assert {r.doc_id: r.kept_text for r in substring_dedup.dedup_substrings(edge, with_text=True).collect()}[10] == "start end"


def test_jaccard_join(edge, empty, docs):
    assert jaccard_join.near_duplicates(empty).count() == 0
    for df in (docs, edge):
        want = brute.near_duplicates([x for x in texts(df) if x[0] is not None])
        got = jaccard_join.near_duplicates(df).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want and len(got) == df.count()
    kept = jaccard_join.keep_one_of_each(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id IN (2, 3, 12)").count() == 3


@pytest.mark.parametrize("how", [{"capacity": 20, "pivots": 4}, {"capacity": 8, "pivots": 3, "growth": 2.0}, {"capacity": 10, "pivots": 5, "growth": 50.0}])
def test_regions_split_exactly(spark, how):
    rng, rows = random.Random(3), []
    for _ in range(3):
        family = [[f"w{rng.randrange(5000)}" for _ in range(60)]]
        for _ in range(40):
            t = list(rng.choice(family))
            for _ in range(rng.randrange(3)):
                t[rng.randrange(60)] = f"w{rng.randrange(5000)}"
            family.append(t)
        rows += [" ".join(t) for t in family]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(rows)


def test_decontamination(edge, empty, docs, spark, sf):
    bench = common.load(spark, sf, "benchmark")
    whole = {tuple(r) for r in decontamination.decontaminate(docs, bench).collect()}
    assert {tuple(r) for r in decontamination.decontaminate(docs, bench, block_bytes=2000).collect()} == whole
    clean = {r[0] for r in whole if not r[5]}
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, bench, block_bytes=4000).collect()} == clean and len(clean) < len(whole)
    items = spark.createDataFrame([(1, "P0 p1 p2 p3 p4 p5 p6 p7 p8 p9 p10"), (2, "x, y!"), (3, None), (4, ""), (None, "b c d"), (5, "not there at all")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(edge, items).collect()}
    assert got[9].n_hit == 11 and got[10].n_items == 1 and got[1].n_hit == 3 and got[1].n_items == 0 and got[None].n_hit == 2 and not got[2].contaminated
    assert got[9].items_sha256 == hashlib.sha256(b"1").hexdigest() and decontamination.decontaminate(empty, items).count() == 0
    assert decontamination.decontaminate(edge, items.limit(0)).where("contaminated").count() == 0


def test_url_filter(spark):
    urls = [
        (1, "http://a.NET/x"), (2, "https://example.net/en/1?q"), (3, "https://b.example.com/de/"), (4, "http://q.org/fr/x#t"), (5, None), (6, "no scheme"), (7, "http://net"),
        (8, "http://other.io/p"), (8, "http://other.io/p"), (9, "http://xnet/"), (10, "http://example.com/de"), (11, ""),
    ]
    got = {r.page_id: r for r in url_filter.url_verdicts(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert [got[i].rule for i in (1, 2, 3, 4, 5, 7, 9, 10)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None]
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["block", "allow", "block", "allow"] and (got[1].host, got[2].path, got[5].host, got[6].path) == ("a.net", "/en/1", "", "")
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_models_are_distributions(spark):
    urls = [("accepted", "abcab", 5), ("accepted", "abd", 2), ("accepted", "xbc9", 1), ("rejected", "abc", 1), ("rejected", "zzz/z\u00e9", 3)]
    pad = lambda t: url_filter.BEGIN * (url_filter.ORDER - 1) + t + url_filter.END
    cuts = lambda t: [pad(t)[i : i + url_filter.ORDER] for i in range(len(t) + 1)]
    n = {side: {} for side in ("accepted", "rejected")}
    for side, t, times in urls:
        for g in cuts(t):
            n[side][g] = n[side].get(g, 0) + times
    every = set().union(*n.values()) | set(cuts("abq")) | {"abcab"[:4] + c for c in "abcdxz9"}
    counts = spark.createDataFrame([(t, n["accepted"].get(t, 0), n["rejected"].get(t, 0)) for t in every], "t string, accepted long, rejected long")
    ratios = {r.t: r.ratio for r in url_filter.log_ratios(counts).collect()}

    def p(side, t):
        value = url_filter.UNSEEN
        for k in range(1, url_filter.ORDER + 1):
            grams = {}
            for g, times in n[side].items():
                grams[g[-k:]] = grams.get(g[-k:], 0) + times
            around = [times for g, times in grams.items() if g[:-1] == t[-k:-1]]
            if around:
                value = (grams.get(t[-k:], 0) + len(around) * value) / (sum(around) + len(around))
        return value

    assert set(ratios) == every and all(abs(ratios[t] - np.log(p("accepted", t) / p("rejected", t))) < 1e-9 for t in every)
    assert ratios["\x02\x02\x02ab"] > 0 > ratios["\x02\x02zzz"]


def test_url_filter_edges(spark):
    from pyspark.sql import functions as F

    long = "http://a.org/fr/" + "x" * 200_000
    urls = [(1, long), (2, "http://b.net/" + "y" * 1000), (3, "HTTP://C.io/" + "x" * 500), (3, "HTTP://C.io/" + "x" * 500), (None, None), (4, "http://d.io/yyyyyy\u65e5")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    for name in ("host", "path", "rule", "t", "k", "ratio", "_row", "_fixed", "_after", "score"):
        df = df.withColumn(name, F.lit(f"clash {name}"))
    rows = url_filter.url_verdicts(df).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == 6 and got[3].score > 0 > got[4].score and got[4].verdict == "block" and got[None].host == "" and len(got[1].path) == 200_004
    one_side = {r.page_id: r for r in url_filter.url_verdicts(df.where("page_id <> 2")).collect()}
    assert {r.score for r in one_side.values()} == {0.0} and one_side[4].verdict == "allow"


PIECES = [b" ", b"a", b"b", b"c", b"ab", b"abc", b" ab", b"bca", b"bcab"]


def test_automaton_is_greedy():
    auto, rng = token_counts.Automaton(PIECES), random.Random(2)
    for _ in range(500):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
        n, i, text = 0, 0, b" " + word
        while i < len(text):
            i += max(len(p) for p in PIECES if text.startswith(p, i))
            n += 1
        assert auto.count(text) == n
    assert auto.count(b" axb") == 1


def test_token_counts(edge, empty):
    got = {r.doc_id: r for r in token_counts.token_counts(edge, PIECES).collect()}
    assert got[1].n_words == 5 and got[2].n_tokens == 0 and got[7].n_words == 0 and got[5].n_words == 300_000
    assert token_counts.token_counts(empty, PIECES).count() == 0


def test_sentencepiece(edge, empty, docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
    model, library = sentencepiece_codec.read_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (edge, docs):
        of = dict(texts(df))
        coded = sentencepiece_codec.encode(df, model)
        for r in coded.collect():
            assert list(r.ids) == library.encode(of[r.doc_id] or "")
        assert {r.doc_id: r.text for r in sentencepiece_codec.decode(coded, model).collect()} == {d: t or "" for d, t in of.items()}
    assert sentencepiece_codec.encode_and_check(edge, model).where("NOT round_trip").count() == 0 and sentencepiece_codec.encode_and_check(empty, model).count() == 0


def test_unigram_relaxes_by_score():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁ab", "ba"]
    scores = np.array([0, -3, -3, -3, -4, -9.5, -2.5])
    kinds = np.array([2, 1, 1, 1, 1, 1, 1])
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Model(pieces, scores, kinds, False, True))
    best = {}

    def cost(t):
        if not t:
            return 0.0
        if t not in best:
            best[t] = max((scores[pieces.index(t[:k])] + cost(t[k:]) for k in range(1, len(t) + 1) if t[:k] in pieces), default=-1e9)
        return best[t]

    for t in ("ab", "aba", "bab", "abab baab", "a b ab"):
        ids = codec.encode([t])[0]
        assert abs(sum(scores[i] for i in ids) - sum(cost(u) for u in codec.unit.findall("▁" + t.replace(" ", "▁")))) < 1e-9 and codec.decode(ids) == t


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
