"""Whole queries that SQL can't express, held against plain versions."""

import math
import re
import zlib

import brute
import numpy as np
import pytest

from linkstone.llm import common, quality, queries, sharding, token_counts, toxicity

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in common.load(spark, sf, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def labels(spark, sf):
    return common.load(spark, sf, "labels").collect()


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


# --- sharding ------------------------------------------------------------------------------------------------------


def differencing(weights, parts):
    """Sums of the parts, by lists of sums that are sorted anew at every step."""
    partial = [[0] * (parts - 1) + [w] for w in weights]
    while len(partial) > 1:
        partial.sort(key=lambda s: s[0] - s[-1])
        a, b, *rest = partial
        partial = [*rest, sorted(x + y for x, y in zip(a, reversed(b), strict=True))]
    return partial[0]


def test_sharding_query(spark, sf, docs):
    rows = {r.doc_id: r for r in queries.op2_sharding(spark, sf).collect()}
    weight, shards = {}, {}
    for d, t in docs:
        raw = (t or "").encode()
        assert (rows[d].size, rows[d].text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        weight[raw] = weight.get(raw, 0) + len(raw) + 8
        shards.setdefault(raw, set()).add(rows[d].shard)
    assert all(len(s) == 1 for s in shards.values()) and len(rows) == len(docs)
    sums = [0] * 24
    for r in rows.values():
        sums[r.shard] += r.size
    assert sorted(sums) == differencing(sorted(weight.values(), reverse=True), 24)


def test_differencing_is_plain_differencing():
    rng = np.random.default_rng(11)
    for n, parts in ((1, 3), (5, 2), (40, 3), (200, 24)):
        w = np.sort(rng.integers(1, 10**9, n))[::-1]
        assert sorted(np.bincount(sharding.difference(w, parts), w, parts).astype(int).tolist()) == differencing(w.tolist(), parts)


# --- quality -------------------------------------------------------------------------------------------------------


def plain_statistics(text):
    raw = (text or "").encode()
    words = brute.words(text)
    n, size = max(1, len(words)), max(1, len(raw))
    kind = {
        "upper": set(range(65, 91)), "lower": set(range(97, 123)), "digit": set(range(48, 58)), "foreign": set(range(128, 256)), "lines": {10},
        "mark": {b for b in range(33, 127) if not chr(b).isalnum()},
    }
    share = lambda k, b: sum(x in kind[k] for x in b)
    all_ = lambda b, *ks: sum(share(k, b) for k in ks) == len(b)
    triples = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / n, *(share(k, raw) / size for k in ("upper", "lower", "digit", "mark", "foreign")),
        10 * share("lines", raw) / size, len(set(words)) / n, max(map(words.count, set(words)), default=0) / n, len(triples) / max(1, len(words) - 2),
        sum(len(w) <= 2 for w in words) / n, sum(len(w) >= 14 for w in words) / n, sum(w[-1] in kind["mark"] for w in words) / n,
        sum(share("upper", w) >= 2 and all_(w, "upper", "mark") for w in words) / n, sum(all_(w, "mark") for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    ]


def plain_quality(rows, known):
    """{doc_id: score}: least squares over all rows at once, and the max-min form of isotonic regression."""
    x = np.array([plain_statistics(t) for _, t in rows], np.float32).astype(float)
    learn = [i for i, (d, _) in enumerate(rows) if d in known and fold(d, 4) != 2]
    y = np.array([float(known[rows[i][0]] > 0) for i in learn])
    scale = x[learn].std(axis=0)
    rng, width = np.random.default_rng(7), 256
    project, phase = rng.normal(0, np.sqrt(1 / x.shape[1]), (x.shape[1], width)), rng.uniform(0, 2 * np.pi, width)
    z = np.clip((x - x[learn].mean(axis=0)) / np.where(scale > 1e-9, scale, 1), -8, 8)
    f = np.hstack([np.ones((len(x), 1)), np.sqrt(2 / width) * np.cos(z @ project + phase)])
    penalty = np.full(width + 1, 1e-3 * len(learn) / width + 1e-9)
    penalty[0] = 1e-9
    wide = np.vstack([f[learn], np.diag(np.sqrt(penalty))])
    raw = f @ np.linalg.lstsq(wide, np.append(y, np.zeros(width + 1)), rcond=None)[0]
    at = np.clip((raw[learn] + 1) / 3 * quality.BINS, 0, quality.BINS - 1).astype(int)
    bins = sorted(set(at.tolist()))
    n, good = (np.array([v[at == b].sum() for b in bins]) for v in (np.ones(len(y)), y))
    mean = lambda a, b: good[a : b + 1].sum() / n[a : b + 1].sum()
    values = [max(min(mean(a, b) for b in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]
    return dict(zip([d for d, _ in rows], np.interp(raw, (np.array(bins) + 0.5) / quality.BINS * 3 - 1, values).tolist(), strict=True))


def test_quality_query(spark, sf, docs, labels):
    got = {r.doc_id: r for r in queries.op3_quality(spark, sf).collect()}
    want = plain_quality(docs, {r.doc_id: r.quality for r in labels if r.quality is not None})
    assert set(got) == set(want) and all(abs(got[d].score - s) < 1e-5 for d, s in want.items())
    assert all(r.predicted == (r.score >= 0.7) and r.held_out == (fold(d, 4) == 2) for d, r in got.items())


def test_plain_statistics_on_odd_texts():
    texts = [None, "", " \n\t ", "AB CD! ab ab ab", "--- !!! x", "naïve Ünï 日本語 🎉\nline", "a" * 3000, "w w w w"]
    assert np.allclose(quality.statistics([(t or "").encode() for t in texts]), [plain_statistics(t) for t in texts])


# --- toxicity ------------------------------------------------------------------------------------------------------


def test_toxicity_query(spark, sf, docs):
    """The scores are those of the fitted dictionaries, window by window."""
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, sf).collect()}
    model = toxicity.fit(common.load(spark, sf, "documents"), common.load(spark, sf, "labels"))
    ordinary, toxic = model.compressors()
    for d, t in docs:
        raw, saved, i = (t or "").encode(), [], 0
        while i == 0 or i < len(raw) - toxicity.WINDOW + toxicity.STRIDE:
            w = raw[i : i + toxicity.WINDOW]
            saved.append(model.evidence[min(9, max(-3, len(ordinary.compress(w)) - len(toxic.compress(w)))) + 3])
            i += toxicity.STRIDE
        x = [1, sum(saved) / 4, 10 * sum(saved) / len(saved), max(saved), math.log(len(saved))]
        p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=True))))))
        assert abs(got[d].score - p) < 1e-9 and got[d].predicted == (got[d].score >= 0.5) and got[d].held_out == (fold(d, 5) == 0)


# --- token counts --------------------------------------------------------------------------------------------------


def test_token_counts_query(spark, sf, docs):
    """Plain longest match with the real vocabulary over whole documents, and one very long word."""
    vocabulary = token_counts.read_vocabulary(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    pieces, longest, known = set(vocabulary), max(map(len, vocabulary)), {}

    def greedy(word):
        if word not in known:
            text, n, i = b" " + word, 0, 0
            while i < len(text):
                i += next(k for k in range(min(longest, len(text) - i), 0, -1) if text[i : i + k] in pieces)
                n += 1
            known[word] = n
        return known[word]

    of = lambda t: (len((t or "").encode()), len(brute.words(t)), sum(map(greedy, brute.words(t))))
    got = {r.doc_id: (r.n_bytes, r.n_words, r.n_tokens) for r in queries.op7_token_counts(spark, sf).collect()}
    assert got == {d: of(t) for d, t in docs}
    rows = [(1, "ab日" * 20_000), (1, "ab日" * 20_000), (None, "x"), (2, None)]
    some = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_words, r.n_tokens) for r in some) == sorted((str(d), *of(t)) for d, t in rows)


# --- pipeline ------------------------------------------------------------------------------------------------------


def plain_pipeline(rows, known, items, library):
    """(doc_id, ids) of what five plain stages leave."""
    if known:
        scores = plain_quality(rows, known)
        rows = [(d, t) for d, t in rows if scores[d] >= 0.7]
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        first.setdefault(brute.SPACE.sub(b" ", (t or "").encode()), (d, t))
    rows = list(first.values())
    kept = brute.shingles.__defaults__
    brute.shingles.__defaults__ = (5,)
    try:
        component = brute.near_duplicates([r for r in rows if r[0] is not None], 80)
    finally:
        brute.shingles.__defaults__ = kept
    rows = [(d, t) for d, t in rows if d is None or component[d][1] == d]
    split = lambda t: WORD.findall(brute.lower(t).encode())
    windows = set()
    for text in items:
        w = split(text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    lengths = {len(w) for w in windows}
    dirty = lambda w: any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))
    return sorted(((d, library.encode(t or "")) for d, t in rows if not dirty(split(t))), key=str)


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=f"{queries.TOKENIZERS}/piece_bpe_32k.model")


def outcome(df):
    rows = df.collect()
    assert all(r.n_tokens == len(r.ids) for r in rows)
    return sorted(((r.doc_id, list(r.ids)) for r in rows), key=str)


def test_pipeline_query(spark, sf, docs, labels, library):
    import corpus_pipeline

    items = [r.text for r in common.load(spark, sf, "benchmark").collect()]
    out = corpus_pipeline.run(spark, sf)
    want = plain_pipeline(docs, {r.doc_id: r.quality for r in labels if r.quality is not None}, items, library)
    assert outcome(out) == want and 0 < len(want) < len(docs) and out.where("NOT round_trip").count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path, library):
    """Null, empty and long texts, repeated rows, rows without an id, clashing columns; and empty tables."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    item = " ".join(f"Item{i}" for i in range(12))
    body = [f"b{i}" for i in range(60)]
    rows = [
        (1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (4, " \t "), (5, " ".join(f"w{i % 977}" for i in range(50_000))), (6, "a  b\tc d e"), (None, "no id here"), (None, "no id here"),
        (7, " ".join(body)), (8, " ".join([*body[:59], "other"])), (9, f"start {item.lower()} end"), (10, "naïve Ünï 日本語 🎉"), (11, "a b c d"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("lang", "source", "score", "keep_id", "z", "n", "region", "rep", "ids", "n_tokens", "_row", "_gone", "_statistics", "x"):
        docs = docs.withColumn(name, F.lit(None if name == "lang" else f"clash {name}").cast("string"))
    bench = spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")

    def home(name, **tables):
        for table, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        return f"{tmp_path}/{name}"

    got = outcome(corpus_pipeline.run(spark, home("odd", documents=docs, benchmark=bench, labels=labels)))
    assert got == plain_pipeline(rows, {}, [item], library) and {d for d, _ in got} == {1, 2, 4, 5, 7, 10, 11, None}
    assert corpus_pipeline.run(spark, home("empty", documents=docs.limit(0), benchmark=bench.limit(0), labels=labels)).count() == 0
