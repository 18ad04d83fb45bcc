"""Substring dedup with fixed-block anchors.

A window is WINDOW words.  Any window of a reference document contains one of its
non-overlapping BLOCK-word blocks, as 2 * BLOCK - 1 <= WINDOW.

1. Anchors.  Hashes of all rolling BLOCK-word windows of all documents meet, by
   hash, with those of the blocks.  A probe with a block of a smaller document,
   and a block with a larger document's probe, are hits.
2. Extension.  Around its hits, a document sends 128-bit fingerprints of all
   WINDOW-word windows that contain one.  A fingerprint whose smallest document
   is another one marks a window; the union of marked windows is the maximal
   exact repeat.
3. Each document drops its marked words.

Entries travel packed, many to a row, keyed by a group of hashes; the number of
groups follows the bytes of text, so a group stays as large at any input size.
A task combines the FLUSH_BYTES of text it holds before it sends: of a hash that
many of its documents share, only the smallest and largest document travel and
the ones between are settled on the spot.  So a passage that a third of all
documents share costs a few entries a task.  No pairs of documents are formed.
A flush is torn into at most one row a group: with more than some 10,000 groups,
`flush_bytes` and `group_bytes` should grow with the memory of executors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FLUSH_BYTES, NOT_SPACE, blocks, compressed, cut, drop, flushes, hash_words, mix, runs, total_bytes

WINDOW, BLOCK = 50, 25
#: Bytes of text for each group of hashes.
GROUP_BYTES = 16 << 20
LOW = np.uint64((1 << 39) - 1)


def group_of(h: np.ndarray, groups: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)


def code_of(h: np.ndarray, groups: int) -> np.ndarray:
    """Group and low bits of a hash in one number: what an anchor is known by."""
    return (group_of(h, groups).astype(np.uint64) << np.uint64(39)) | (h & LOW)


def pack5(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack5(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _by_document(doc: np.ndarray, key: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ids, keys and counts of runs of documents."""
    at = np.union1d(runs(doc), runs(key))
    return doc[at[:-1]].astype("<i8").tobytes(), key[at[:-1]].astype("<i8").tobytes(), np.diff(at).astype("<i4").tobytes()


def _documents(pdf) -> tuple[np.ndarray, np.ndarray]:
    ids, keys, counts = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("ids", "<i8"), ("keys", "<i8"), ("counts", "<i4")))
    return np.repeat(ids, counts), np.repeat(keys, counts)


_ROW = "q int, settled boolean, ids binary, keys binary, counts binary, h binary, x binary"
_ARROW = pa.schema([("q", pa.int32()), ("settled", pa.bool_()), *[(c, pa.binary()) for c in ("ids", "keys", "counts", "h", "x")]])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


def _hashed(pairs: list[tuple]):
    """(doc ids, keys, Words, place of the first) of blocks of texts; a pair is ((doc id, key), text)."""
    texts = [p[1] for p in pairs]
    for begin, end in blocks(texts):
        ids = np.array([p[0][:2] for p in pairs[begin:end]], np.int64).reshape(-1, 2)
        yield ids[:, 0], ids[:, 1], hash_words(texts[begin:end], NOT_SPACE, lower=False), begin


def _positions(w, n: int, least: int):
    """Start, text and offset of all n-word windows of texts of at least `least` words."""
    owner = w.owner()
    length = np.diff(w.first)
    pos = np.arange(len(owner))
    offset = pos - w.first[owner] if len(owner) else pos
    ok = (offset + n <= length[owner]) & (length[owner] >= least)
    return pos[ok], owner[ok], offset[ok]


def _anchor_rows(groups: int, seed: int, pairs: list[tuple]) -> pa.RecordBatch:
    hs, docs, keys, aligned = [], [], [], []
    for ids, tks, w, _ in _hashed(pairs):
        pos, owner, offset = _positions(w, BLOCK, WINDOW)
        hs.append(w.windows(BLOCK)[pos] if len(pos) else np.empty(0, np.uint64))
        docs.append(ids[owner])
        keys.append(tks[owner])
        aligned.append(offset % BLOCK == 0)
    h, doc, key, flag = (np.concatenate(x) for x in (hs, docs, keys, aligned))
    if not len(h):
        return _rows([])
    order = np.argsort(h, kind="stable")
    h, doc, key, flag = h[order], doc[order], key[order], flag[order]
    at = runs(h)
    low, high, any_block = np.minimum.reduceat(doc, at[:-1]), np.maximum.reduceat(doc, at[:-1]), np.logical_or.reduceat(flag, at[:-1])
    which = np.repeat(np.arange(len(low)), np.diff(at))
    between = (doc > low[which]) & (doc < high[which])
    out = []
    if between.any():
        order = np.lexsort((key[between], doc[between]))
        d, k, c = doc[between][order], key[between][order], code_of(h[between][order], groups)
        out.append((seed % groups, True, *_by_document(d, k), c.tobytes(), b""))
    ends = np.flatnonzero(~between)
    h, doc, key, flag = h[ends], doc[ends], key[ends], any_block[which[ends]]
    q = group_of(h, groups)
    order = np.lexsort((h, key, doc, q))
    q, h, doc, key, flag = q[order], h[order], doc[order], key[order], flag[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
    q, h, doc, key, flag = q[new], h[new], doc[new], key[new], flag[new]
    value = ((h & LOW) << np.uint64(1)) | flag.astype(np.uint64)
    at = runs(q)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append((int(q[a]), False, *_by_document(doc[a:b], key[a:b]), pack5(value[a:b]), b""))
    return _rows(out)


def _per_document(doc: np.ndarray, key: np.ndarray, value: np.ndarray, name: str) -> pd.DataFrame:
    order = np.lexsort((key, doc))
    doc, key, value = doc[order], key[order], value[order]
    at = np.union1d(runs(doc), runs(key))
    return pd.DataFrame({"_id": doc[at[:-1]], "_key": key[at[:-1]], name: [value[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]})


def _by_bucket(doc: np.ndarray, key: np.ndarray, value: np.ndarray, buckets: int) -> pd.DataFrame:
    """One row for each bucket of documents, with all their values."""
    bucket = (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, doc, bucket))
    doc, key, value, bucket = doc[order], key[order], value[order], bucket[order]
    at = runs(bucket)
    rows = [(int(bucket[a]), *_by_document(doc[a:b], key[a:b]), value[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pd.DataFrame(rows, columns=["bucket", "ids", "keys", "counts", "x"])


_BUCKET = "bucket int, ids binary, keys binary, counts binary, x binary"


def _anchor_hits(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Hits of one group of hashes, by bucket of documents."""
    done, open_ = pdf[pdf["settled"]], pdf[~pdf["settled"]]
    found = [(*_documents(done), np.frombuffer(b"".join(done["h"]), "<u8"))]
    if len(open_):
        value, (doc, key) = unpack5(b"".join(open_["h"])), _documents(open_)
        h, flag = value >> np.uint64(1), (value & np.uint64(1)).astype(bool)
        block = np.unique(h[flag])
        if len(block):
            at = np.minimum(np.searchsorted(block, h), len(block) - 1)
            hit = np.flatnonzero(block[at] == h)
            at, d, f = at[hit], doc[hit], flag[hit]
            first, last = np.full(len(block), np.iinfo(np.int64).max), np.full(len(block), np.iinfo(np.int64).min)
            np.minimum.at(first, at[f], d[f])
            np.maximum.at(last, at, d)
            keep = (first[at] < d) | (f & (last[at] > d))
            found.append((d[keep], key[hit][keep], (np.uint64(int(open_["q"].iloc[0])) << np.uint64(39)) | block[at[keep]]))
    doc, key, code = (np.concatenate(x) for x in zip(*found, strict=True))
    return _by_bucket(doc, key, code.astype("<u8"), buckets)


def _window_rows(groups: int, seed: int, rows: list[tuple]) -> pa.RecordBatch:
    """rows: ((doc id, key, codes of the anchors), text)"""
    parts = []
    for ids, tks, w, begin in _hashed(rows):
        codes = code_of(w.windows(BLOCK), groups)
        fifty, lane = w.windows(WINDOW), w.windows(WINDOW, lane=1)
        for k, (d, t) in enumerate(zip(ids.tolist(), tks.tolist(), strict=True)):
            a, b = int(w.first[k]), int(w.first[k + 1])
            if b - a < WINDOW:
                continue
            at = np.flatnonzero(np.isin(codes[a : b - BLOCK + 1], np.frombuffer(rows[begin + k][0][2], "<u8")))
            near = np.zeros(b - a + 2, np.int64)  # windows that contain an anchor start up to WINDOW - BLOCK before it
            np.add.at(near, np.maximum(at - (WINDOW - BLOCK), 0), 1)
            np.add.at(near, at + 1, -1)
            start = np.flatnonzero(np.cumsum(near)[: b - a - WINDOW + 1] > 0)
            parts.append((fifty[a + start], lane[a + start], np.full(len(start), d, np.int64), np.full(len(start), t, np.int64), start.astype(np.uint32)))
    if not sum(len(p[0]) for p in parts):
        return _rows([])
    h, low, doc, key, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((low, h))
    h, low, doc, key, place = h[order], low[order], doc[order], key[order], place[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (low[1:] != low[:-1])))
    which = np.cumsum(new) - 1
    first = np.minimum.reduceat(doc, np.flatnonzero(new))
    repeated = doc > first[which]
    out = []
    if repeated.any():
        order = np.lexsort((key[repeated], doc[repeated]))
        out.append((seed % groups, True, *_by_document(doc[repeated][order], key[repeated][order]), b"", place[repeated][order].tobytes()))
    h, low, doc, key, place = h[~repeated], low[~repeated], doc[~repeated], key[~repeated], place[~repeated]
    q = group_of(h, groups)
    order = np.lexsort((key, doc, q))
    q, h, low, doc, key, place = q[order], h[order], low[order], doc[order], key[order], place[order]
    at = runs(q)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append((int(q[a]), False, *_by_document(doc[a:b], key[a:b]), h[a:b].tobytes() + low[a:b].tobytes(), place[a:b].tobytes()))
    return _rows(out)


def _window_marks(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Starts of the windows that a smaller document has too, by bucket of documents."""
    done, open_ = pdf[pdf["settled"]], pdf[~pdf["settled"]]
    found = [(*_documents(done), np.frombuffer(b"".join(done["x"]), "<u4"))]
    if len(open_):
        (doc, key), place = _documents(open_), np.frombuffer(b"".join(open_["x"]), "<u4")
        h, low = (np.concatenate([np.frombuffer(x, "<u8", len(x) // 16, at * (len(x) // 2)) for x in open_["h"]]) for at in (0, 1))
        order = np.lexsort((low, h))
        h, low, doc, key, place = h[order], low[order], doc[order], key[order], place[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (low[1:] != low[:-1])))
        repeated = doc > np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
        found.append((doc[repeated], key[repeated], place[repeated]))
    doc, key, place = (np.concatenate(x) for x in zip(*found, strict=True))
    return _by_bucket(doc, key, place.astype("<u4"), buckets)


def removed_words(n: int, starts: np.ndarray) -> np.ndarray:
    change = np.zeros(n + WINDOW + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts.astype(np.int64) + WINDOW, -1)
    return np.cumsum(change)[:n] > 0


def _of_documents(found: DataFrame, kind: str, name: str) -> DataFrame:
    """One row for each document, from rows for buckets of them."""
    unpack = lambda pdf: _per_document(*_documents(pdf), np.frombuffer(b"".join(pdf["x"]), kind), name)
    return found.groupBy("bucket").applyInPandas(unpack, f"_id long, _key long, {name} binary")


def _tuples(batches):
    """((columns before the last), last column) of each row."""
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        yield from zip(zip(*columns[:-1], strict=True), columns[-1], strict=True)


def marks(rows: DataFrame, packed: DataFrame, group_bytes: int = GROUP_BYTES, flush_bytes: int = FLUSH_BYTES) -> DataFrame:
    """_id, _key, starts binary: starts of the repeated windows of each row that has any. rows: _id, _key, text; packed: the same compressed."""
    groups = 16 + int(total_bytes(rows) // group_bytes)

    def anchors(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pairs = (((d, t), x.encode() if x else b"") for (d, t), x in _tuples(batches))
        for k, some in enumerate(flushes(pairs, flush_bytes)):
            yield _anchor_rows(groups, part + k, some)

    found = rows.where("_id IS NOT NULL").mapInArrow(anchors, _ROW)
    hits = cut(found.groupBy("q").applyInPandas(lambda pdf: _anchor_hits(pdf, groups), _BUCKET), "anchor-hits")
    by_doc = _of_documents(hits, "<u8", "codes")

    def extend(batches):
        import zstandard as zs
        from pyspark import TaskContext

        part, unpack = TaskContext.get().partitionId(), zs.ZstdDecompressor().decompress
        pairs = ((before, unpack(z)) for before, z in _tuples(batches))
        for k, some in enumerate(flushes(pairs, flush_bytes)):
            yield _window_rows(groups, part + k, some)

    # of fully repeated rows one is enough: equal ids aren't compared with each other
    around = packed.join(by_doc, ["_id", "_key"]).select("_id", "_key", "codes", "z").mapInArrow(extend, _ROW)
    found = cut(around.groupBy("q").applyInPandas(lambda pdf: _window_marks(pdf, groups), _BUCKET), "window-marks")
    drop(hits)
    return _of_documents(found, "<u4", "starts")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, _id, _key, text: _id is a long in the order of doc_id, _key tells texts of one doc_id apart.

    Ids that aren't integers are sorted and numbered, and joined back.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("_key"), "text")
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return rows.withColumn("_id", F.col("doc_id").cast("long")).select("doc_id", "_id", "_key", "text")
    order = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy("doc_id")
    order = cut(order.withColumn("_id", F.monotonically_increasing_id()), "numbers")
    return rows.join(order, "doc_id", "left").select("doc_id", "_id", "_key", "text")


def dedup_substrings(docs: DataFrame, with_text: bool = False, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for) of every row.

    Null and empty texts have no words.  A row is compared only with smaller
    ids, so repeated rows get equal results, and rows with one id and different
    texts don't affect each other.  doc_id may be of any type with an order.
    Rows without an id lose nothing and are no reference.  Other columns are
    ignored.  Windows are equal if two independent 64-bit hashes are.
    """
    rows = numbered(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = compressed(rows)
    marked = marks(rows.select("_id", "_key", "text"), packed.where("_id IS NOT NULL").select("_id", "_key", "z"), **how)

    def finish(batches):
        import zstandard as zs

        unpack = zs.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for z, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = unpack(z).split()
                n = len(words)
                if starts:
                    gone = removed_words(n, np.frombuffer(starts, "<u4"))
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                text = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(text).hexdigest(), text if with_text else None))
            columns = [b.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array([r[3].decode() for r in out], pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return packed.join(marked, ["_id", "_key"], "left").select("doc_id", "z", "starts").mapInArrow(
        finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, p, array_to_string(w[p:p + 49], ' ') AS t FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
early AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS q FROM win JOIN early USING (t) WHERE doc_id > m),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY q) AS s FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM d) ANTI JOIN gone USING (r, q) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
"""
