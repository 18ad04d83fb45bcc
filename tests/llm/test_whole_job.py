import hashlib
import random

import brute
import numpy as np
import pytest

from linkstone.llm import common, jaccard_join, queries, sentencepiece_codec, substring_dedup


def near(rows, n, percent):
    """brute.near_duplicates on shingles of n words."""
    kept = brute.shingles.__defaults__
    brute.shingles.__defaults__ = (n,)
    try:
        return brute.near_duplicates(rows, percent)
    finally:
        brute.shingles.__defaults__ = kept


def families(seed):
    """Texts of 60 words, in three families of copies with a few words exchanged; also short ones."""
    rng, rows = random.Random(seed), ["a b c d", "A b  c d", "a b c", "", "a b c d e"]
    for _ in range(3):
        family = [[f"w{rng.randrange(5000)}" for _ in range(60)]]
        for _ in range(40):
            t = list(rng.choice(family))
            for _ in range(rng.randrange(3)):
                t[rng.randrange(60)] = f"w{rng.randrange(5000)}"
            family.append(t)
        rows += [" ".join(t) for t in family]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("how", [{}, {"capacity": 20, "pivots": 4}, {"capacity": 10, "pivots": 5, "growth": 50.0}])
def test_jaccard_join_at_other_lines(spark, how):
    rows = families(4)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, percent=80, **how).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near(rows, 5, 80) != brute.near_duplicates(rows)


def test_stage_of_near_duplicates(spark, sf):
    import corpus_pipeline

    words = [f"x{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30], "other", *words[31:]])), (3, " ".join(words[:30])), *((d + 10, t) for d, t in families(5))]
    want = {d for d, (_, c) in near(rows, 5, 80).items() if c == d}
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert {r.doc_id for r in left.collect()} == want and 2 not in want and want < {d for d, (_, c) in near(rows, 4, 85).items() if c == d}


def test_sentencepiece_query_returns_ids(spark, sf):
    model = sentencepiece_codec.read_model(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    docs = common.load(spark, sf, "documents")
    got = {r.doc_id: r for r in queries.op10_sentencepiece(spark, sf).collect()}
    assert {d: r.ids for d, r in got.items()} == {r.doc_id: r.ids for r in sentencepiece_codec.encode(docs, model).collect()}
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() and r.round_trip for r in got.values())


def test_exact_stage_keeps_one_of_repeated_rows(spark, sf):
    import corpus_pipeline

    rows = [(1, "a b", "en"), (1, "a b", "en"), (1, "a  b", "de"), (None, "x", None), (None, "x", None), (None, None, "en"), (4, "", "en"), (4, None, "de"), (5, "a b", "en"), (6, "c", "en"), (1, "d", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for df in (docs, docs.repartition(5), docs.orderBy("text")):
        left = corpus_pipeline.exact_deduplication(spark, df, sf)
        got = sorted(map(tuple, left.collect()), key=str)
        assert left.columns == docs.columns and got == sorted([(1, "a  b", "de"), (None, "x", None), (4, None, "de"), (6, "c", "en"), (1, "d", "en")], key=str)
    assert corpus_pipeline.exact_deduplication(spark, docs.limit(0), sf).count() == 0


def test_encoding_stage_decodes(spark, sf):
    import corpus_pipeline

    texts = [(1, "plain words, naïve Ünï 日本語 🎉"), (2, None), (3, ""), (4, " two  spaces "), (5, "a▁b")]
    got = {r.doc_id: r for r in corpus_pipeline.encoding(spark, spark.createDataFrame(texts, "doc_id long, text string"), sf).collect()}
    # the library's own mark of a space can't be told from a space
    assert [got[d].round_trip for d, _ in texts] == [True, True, True, True, False] and all(len(r.ids) == r.n_tokens for r in got.values())


def thue_morse():
    """Two different words that polynomial hashes modulo a power of two can't tell apart."""
    word, swap = "a", str.maketrans("ab", "ba")
    while len(word) < 1024:
        word += word.translate(swap)
    return word, word.translate(swap)


def test_words_that_fool_polynomial_hashes(spark):
    one, other = thue_morse()
    base = " ".join(f"x{i}" for i in range(49))
    rows = [(1, f"{base} {one}"), (2, f"{base} {other}"), (3, f"{one} p q r"), (4, f"{other} p q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(df).collect()}
    assert got == brute.substring_dedup(rows) and not got[2][1]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()} == brute.near_duplicates(rows)


def test_hash_lanes():
    rng = random.Random(8)
    words = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.choice([1, 3, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)})
    w = common.hash_words([b" ".join(words)], common.NOT_SPACE, False)
    lanes = [common.word_hashes(w.data, w.start, w.end, k) for k in (0, 1)]
    assert all(len(set(x.tolist())) == len(words) for x in lanes) and not set(lanes[0].tolist()) & set(lanes[1].tolist())
    for n in (1, 2, 3, 4, 5, 7, 10, 25, 50):
        h = w.windows(n, 1)
        assert len(h) == len(words) - n + 1 == len(set(h.tolist())) and h[5] == common.window_hashes(lanes[1][5 : 5 + n], n, 1)[0]


def test_repeated_and_textual_ids(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [("b", passage), ("a", "start " + passage), ("c", passage + " tail"), ("b", "other " + passage), ("b", None), (None, passage), ("b", passage), ("b", "x y")]
    got = sorted(tuple(r)[:3] for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string")).where("doc_id IS NOT NULL").collect())
    assert got == [("a", 81, 0), ("b", 0, 0), ("b", 2, 0), ("b", 80, 80), ("b", 80, 80), ("b", 81, 80), ("c", 81, 80)]
    rows = [(5, passage), (5, "q " * 60), (7, "q " * 55 + passage), (7, "other words"), (5, "q " * 60)]
    got = sorted(tuple(r)[:3] for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert got == [(5, 60, 0), (5, 60, 0), (5, 80, 0), (7, 2, 0), (7, 135, 135)]
    rows = [("b", "a b c d e"), ("a", "a  b c d E"), ("b", "x y z"), ("c", "x Y z"), (None, "x y z"), ("d", None)]
    got = sorted(map(tuple, jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()), key=str)
    assert got == [("a", 2, "a"), ("b", 1, "b"), ("b", 2, "a"), ("c", 1, "b"), ("d", 0, "d"), (None, 1, None)]


def test_regions_carry_the_links():
    """Every link of one large group is found by regions, not by comparing all members."""
    rng, texts = random.Random(6), []
    for _ in range(30):
        seed = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(8):
            t = list(seed)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(t).encode())
    sets = jaccard_join.sets_of(texts)
    label = list(range(len(texts)))
    for i, j in jaccard_join.forest(sets, jaccard_join.Exact(texts, 4, 85)):
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    assert {d: (len(sets[d]), x) for d, x in enumerate(label)} == brute.near_duplicates([(d, t.decode()) for d, t in enumerate(texts)])


def test_hot_keys_and_shingles_take_the_other_way(spark, monkeypatch):
    rows = [(d, "same text of the third of all rows") for d in range(40)] + families(9)[:60]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = brute.near_duplicates(rows)
    for heavy, hot in ((1, 0), (3, 2)):
        monkeypatch.setattr(common, "HEAVY", heavy)
        monkeypatch.setattr(jaccard_join, "HOT", hot)
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_long_units_and_long_texts(monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
    codec, library = sentencepiece_codec.Codec(sentencepiece_codec.read_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150_000))
    texts = [letters, "a" * 70_000, "日本語🎉" * 3000, "x\0y" * 200, " " * 500, "one " + letters[:1000] + "  two\n" + letters[:1000], "", "\n\n", "déjà vu " * 300]
    want = [library.encode(t) for t in texts]
    assert [i.tolist() for i in codec.encode(texts)] == want and [codec.decode(i) for i in codec.encode(texts)] == texts
    monkeypatch.setattr(sentencepiece_codec, "PART", 300)  # every longer text goes part by part
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 50)
    monkeypatch.setattr(sentencepiece_codec, "SLICE", 100)
    assert [i.tolist() for i in codec.encode(texts + texts)] == want + want


def test_suffix_array():
    model = sentencepiece_codec.read_model(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    codec, rng = sentencepiece_codec.Codec(model), random.Random(7)
    text = "".join(rng.choice("abab▁ theing") for _ in range(3000))
    codes = codec.code_of[[ord(c) for c in text]]
    order, _ = codec.suffixes(codes.astype(np.uint64), 4, 16)
    code = {c: int(codec.code_of[ord(c)]) for c in set(text)}
    suffix = [[code[c] for c in text[i : i + codec.longest]] for i in order]
    assert suffix == sorted(suffix)
    start, end, piece = codec.edges(codes)
    usable = {model.pieces[i]: i for i in codec.usable.tolist()}
    want = {(i, i + k, usable[text[i : i + k]]) for i in range(len(text)) for k in range(1, codec.longest + 1) if i + k <= len(text) and text[i : i + k] in usable}
    assert set(zip(start.tolist(), end.tolist(), piece.tolist())) == want and len(start) == len(want)


def test_unigram_long_unit_relaxes_alike():
    pieces, kinds = ["<unk>", "▁", "a", "b", "ab", "▁ab", "ba", "bab"], np.array([2, 1, 1, 1, 1, 1, 1, 1])
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Model(pieces, np.array([0, -3.1, -3.2, -3.3, -4.1, -9.5, -2.5, -4.4]), kinds, False, True))
    rng = random.Random(2)
    for _ in range(30):
        unit = "".join(rng.choice("abbc") for _ in range(rng.randrange(1, 120)))
        assert codec.encode_long(unit, stretch=7) == codec.encode_units([unit])[0]
