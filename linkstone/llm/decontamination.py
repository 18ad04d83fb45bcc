"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Each item window (10 words, or a shorter item as a whole) is a set of shingles of
up to five words.  A document can only contain the window if it contains all of
them, so the rarest in the corpus is the one necessary prefix token.  Document
positions that carry a prefix token are joined with the windows it stands for,
the token's offset bounds the window's start (it must lie inside the document
by length and position), and the words are compared exactly.

The benchmark is the query set: it is processed in blocks of at most
`block_bytes` of text, each broadcast, against all documents.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, as_bytes, blocks, hash_words, window_hashes

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 5
#: Text of the items that are broadcast together.
BLOCK = 4 << 20


@dataclass
class Index:
    """Windows of a block of items; token[i] has the windows window[first[i]:first[i + 1]] at offset[...]."""

    words: np.ndarray
    hash: np.ndarray
    text: list[bytes]
    items: list[list[str]]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def item_windows(items: list[tuple[str | None, str | None]]) -> dict[bytes, tuple[int, set[str]]]:
    """Window text -> its number of words and the ids of its items."""
    out: dict[bytes, tuple[int, set[str]]] = {}
    for item_id, text in items:
        w = hash_words([(text or "").encode()], ALNUM, lower=True)
        words = w.text_of(np.arange(len(w.start))).split(b" ") if len(w.start) else []
        n = min(WINDOW, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            _, ids = out.setdefault(b" ".join(words[i : i + n]), (n, set()))
            if item_id is not None:
                ids.add(str(item_id))
    return out


def _shingles(text: bytes, n: int) -> np.ndarray:
    return window_hashes(hash_words([text], ALNUM, lower=False).hash, min(SHINGLE, n))


def count_shingles(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each wanted shingle (by length, sorted hashes) occurs in all documents."""

    def run(batches):
        found = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}
        for b in batches:
            texts = as_bytes(b.column(0))
            for begin, end in blocks(texts):
                w = hash_words(texts[begin:end], ALNUM, lower=True)
                for k, v in wanted.items():
                    h = w.windows(k)
                    at = np.minimum(np.searchsorted(v, h), len(v) - 1)
                    np.add.at(found[k], at[v[at] == h], 1)
        for k, n in found.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some])], ["k", "at", "n"])

    got = docs.select("text").mapInArrow(run, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect()
    return {(r["k"], int(wanted[r["k"]][r["at"]])): r["n"] for r in got}


def build(docs: DataFrame, items: list[tuple[str | None, str | None]]) -> Index:
    windows = item_windows(items)
    text = sorted(windows)
    shingles = [_shingles(t, windows[t][0]) for t in text]
    lengths = [min(SHINGLE, windows[t][0]) for t in text]
    wanted = {k: np.unique(np.concatenate([s for s, n in zip(shingles, lengths, strict=True) if n == k])) for k in set(lengths)}
    often = count_shingles(docs, wanted) if wanted else {}
    entries: dict[int, list[tuple[int, int, int]]] = {k: [] for k in wanted}
    for i, (s, k) in enumerate(zip(shingles, lengths, strict=True)):
        offset = min(range(len(s)), key=lambda j: (often.get((k, int(s[j])), 0), int(s[j]), j))
        entries[k].append((int(s[offset]), i, offset))
    by_length = {}
    for k, e in entries.items():
        e.sort()
        token = np.array([x[0] for x in e], np.uint64)
        unique, first = np.unique(token, return_index=True)
        by_length[k] = unique, np.append(first, len(token)), np.array([x[1] for x in e]), np.array([x[2] for x in e])
    sizes = [windows[t][0] for t in text]
    whole = np.array([window_hashes(hash_words([t], ALNUM, lower=False).hash, n)[0] for t, n in zip(text, sizes, strict=True)], np.uint64)
    return Index(np.array(sizes, np.int64), whole, text, [sorted(windows[t][1]) for t in text], by_length)


def occurrences(w, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of each occurrence of a window in the texts of w."""
    starts, which = [], []
    for k, (token, first, window, offset) in index.by_length.items():
        h = w.windows(k)
        at = np.minimum(np.searchsorted(token, h), len(token) - 1)
        pos = np.flatnonzero(token[at] == h)
        if not len(pos):
            continue
        n = first[at[pos] + 1] - first[at[pos]]
        entry = np.repeat(first[at[pos]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, win = np.repeat(pos, n) - offset[entry], window[entry]
        size = index.words[win]
        doc = np.searchsorted(w.first, np.repeat(pos, n), side="right") - 1
        ok = (start >= w.first[doc]) & (start + size <= w.first[doc + 1])
        starts.append(start[ok])
        which.append(win[ok])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, win = np.concatenate(starts), np.concatenate(which)
    ok = np.zeros(len(start), bool)
    for size in np.unique(index.words[win]):
        own = np.flatnonzero(index.words[win] == size)
        ok[own] = w.windows(int(size))[start[own]] == index.hash[win[own]]
    start, win = start[ok], win[ok]
    raw, size = w.data.tobytes(), index.words[win]
    same = [b" ".join([raw[a:b] for a, b in zip(w.start[s : s + n], w.end[s : s + n], strict=True)]) == index.text[x] for s, n, x in zip(start.tolist(), size.tolist(), win.tolist(), strict=True)]
    keep = np.array(same, bool)
    return start[keep], win[keep]


def find(texts: list[bytes], index: Index):
    """For each text: its number of words, its hit words (positions), the ids of the items that occur."""
    for begin, end in blocks(texts):
        w = hash_words(texts[begin:end], ALNUM, lower=True)
        start, win = occurrences(w, index)
        change = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + index.words[win], -1)
        hit = np.cumsum(change[:-1]) > 0
        items: dict[int, set[str]] = {}
        for d, x in set(zip((np.searchsorted(w.first, start, side="right") - 1).tolist(), win.tolist(), strict=True)):
            items.setdefault(d, set()).update(index.items[x])
        for d in range(end - begin):
            own = hit[w.first[d] : w.first[d + 1]]
            yield len(own), np.flatnonzero(own) if d in items else np.empty(0, np.int64), items.get(d, set())


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK) -> list[list[tuple]]:
    """The items, in blocks of about block_bytes of text by a hash of their id."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = 1 + int(total // block_bytes)
    for i in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).select(F.col("item_id").cast("string").alias("item_id"), "text").collect()
        yield n, i, [(r["item_id"], r["text"]) for r in rows]


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row.

    Null and empty texts have no words; so do null items.  An item without an id
    marks words but isn't listed.  Repeated rows get the same values.  Other
    columns of either table are ignored.
    """
    spark, parts = docs.sparkSession, []
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    for n, i, items in item_blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(build(rows, items))

        def run(batches, shared=shared, first=i == 0):
            for b in batches:
                texts = as_bytes(b.column(1))
                out = [(d, hashlib.sha256(t).digest(), words, hits.astype("<i4").tobytes(), sorted(ids)) for d, t, (words, hits, ids) in zip(b.column(0).to_pylist(), texts, find(texts, shared.value), strict=True) if first or len(hits)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((b.schema.field(0).type, pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.string())))], ["doc_id", "_text", "n_words", "_hits", "_items"])

        parts.append(rows.mapInArrow(run, f"doc_id {kind}, _text binary, n_words long, _hits binary, _items array<string>"))
    if len(parts) == 1:
        merged = parts[0].withColumn("n_hit", F.octet_length("_hits").cast("long") / 4).withColumn("_all", F.col("_items"))
    else:  # a row's hits in several blocks are united; equal rows are counted and repeated
        everything = parts[0].withColumn("_copies", F.lit(1))
        for p in parts[1:]:
            everything = everything.unionByName(p.withColumn("_copies", F.lit(0)))

        def unite(pdf):
            hits = np.unique(np.concatenate([np.frombuffer(h, "<i4") for h in pdf["_hits"]]))
            items = sorted({x for v in pdf["_items"] for x in v})
            first = pdf.head(1)[["doc_id", "n_words"]].assign(n_hit=float(len(hits)), _all=[items])
            return first.loc[first.index.repeat(int(pdf["_copies"].sum()))]

        everything = everything.groupBy("doc_id", "_text", "n_words", "_hits", "_items").agg(F.sum("_copies").alias("_copies"))
        merged = everything.groupBy("doc_id", "_text").applyInPandas(unite, f"doc_id {kind}, n_words long, n_hit double, _all array<string>")
    return merged.select(
        "doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("_all").cast("long").alias("n_items"),
        F.sha2(F.array_join("_all", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """The rows of docs in which no item window occurs, with all their columns; each block of items filters what the last one left."""
    at = docs.columns.index("text")
    kept = docs
    for _, _, items in item_blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(build(docs, items))

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not len(hits) for _, hits, _ in find(as_bytes(b.column(at)), shared.value)], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS t
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.p, iw.n, iw.item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.n = iw.n),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
x AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN x USING (r)
"""
