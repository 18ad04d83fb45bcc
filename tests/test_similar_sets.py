"""Pairs of similar texts against a comparison of all pairs, and the room that they take."""

import random
from pathlib import Path

from linkstone.operators import similar_sets
from linkstone.plans import er_queries
from linkstone.sources import scratch


def _texts():
    """Near copies at and around the threshold, texts of all sizes, copies, odd spaces, nulls; two langs share words."""
    rnd = random.Random(7)
    vocabulary = [f"w{int(rnd.paretovariate(0.6)) % 4000}é" for _ in range(4000)]
    rows = []
    for k in range(700):
        words = rnd.sample(vocabulary, rnd.choice([1, 2, 3, 7, 10, 17, 40, 100]))
        if k % 3 and rows and rows[-1][1]:
            words = rows[-1][1].split()
            for _ in range(rnd.randrange(len(words) // 4 + 2)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rnd.shuffle(words)
        rows.append((k, rnd.choice([" ", "\t", "\n ", "\x0b"]).join(words), rnd.choice(["en", "de"])))
    rows += [(k + 700, t + " ", c) for k, t, c in rows[:40]]
    return [*rows, (800, None, "en"), (801, "", "en"), (802, " \n", "de"), (803, "a b", None), (804, "a b", "en"), (805, "a b c", "en"), (None, "a b", "en"), (804, "b a b", "en"), (804, "c d", "en"), (807, "c d", "en")]


def test_all_pairs_whatever_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(similar_sets, "BUCKET", 300)  # many tiles and rounds
    monkeypatch.setattr(similar_sets, "BYTES_AT_ONCE", 60_000)
    rows = _texts()
    docs, alike = similar_sets.similar(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sets = {}
    for r in docs.collect():
        sets.setdefault(r["x"], set()).add(r["doc_id"])
    found = sorted({tuple(sorted((a, b))) for r in alike.collect() for a in sets[r["x"]] for b in sets[r["y"]]} | {(a, b) for s in sets.values() for a in s for b in s if a < b})
    apart = [(k, c, set(t.encode().split())) for k, t, c in rows if k is not None and t and t.strip() and c]
    wanted = sorted({tuple(sorted((a, b))) for a, c, s in apart for b, d, w in apart if c == d and a < b and 10 * len(s & w) >= 7 * len(s | w)})
    assert [p for p in found if p[0] != p[1]] == wanted and len(wanted) > 100


def test_tables_of_similar_texts_stay_below_the_input(spark, sf):
    mark = len(scratch._paths)
    er_queries._similar_texts(spark, sf)
    left = sum(f.stat().st_size for _, path in scratch._paths[mark:] for f in Path(path.removeprefix("file:")).rglob("*.parquet"))
    assert left < Path(f"{sf}/documents.parquet").stat().st_size / 4
