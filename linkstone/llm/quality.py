"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

One scan turns each whole text into STATISTICS (a table of a few hundredths of
the input, written to the shared folder); everything later reads that table.
Cosines of random projections approximate a Gaussian kernel; each partition
sums its normal equations, the sums are added, and the driver solves one system
of `width` + 1 unknowns.  Scores are calibrated by pool-adjacent-violators over
a fixed number of bins.  All labelled rows outside the held-out fold are used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, add_in_tree, as_bytes, blocks, byte_class, cut, drop, hash_words, held_out, window_hashes

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "mark", "foreign", "lines", "distinct_words", "commonest_word",
    "distinct_triples", "short_words", "long_words", "marks_at_end", "upper_words", "lone_marks", "same_as_last",
]
CLASSES = {
    "upper": byte_class((0x41, 0x5A)), "lower": byte_class((0x61, 0x7A)), "digit": byte_class((0x30, 0x39)),
    "mark": byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)), "foreign": byte_class((0x80, 0xFF)), "lines": byte_class((0x0A, 0x0A)),
}
BINS = 400


def _distinct(owner: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values, and count of the commonest one, by owner."""
    n, most = np.zeros(docs), np.zeros(docs)
    if len(h):
        order = np.lexsort((h, owner))
        o, v = owner[order], h[order]
        new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1]))))
        n += np.bincount(o[new], minlength=docs)
        np.maximum.at(most, o[new], np.diff(np.append(new, len(v))))
    return n, most


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for begin, end in blocks(texts):
        part = texts[begin:end]
        w = hash_words(part, NOT_SPACE, lower=False)
        docs = len(part)
        size = np.array([len(t) for t in part], float)
        border = np.concatenate(([0], np.cumsum(size + 1))).astype(int)
        total = {k: np.concatenate(([0], np.cumsum(c[w.data]))) for k, c in CLASSES.items()}
        share = {k: (c[border[1:]] - c[border[:-1]]) / np.maximum(size, 1) for k, c in total.items()}
        owner, words = w.owner(), np.diff(w.first).astype(float)
        some = np.maximum(words, 1)
        by_doc = lambda x: np.bincount(owner, x, docs) / some
        long = w.end - w.start
        marks, upper = total["mark"][w.end] - total["mark"][w.start], total["upper"][w.end] - total["upper"][w.start]
        distinct, most = _distinct(owner, w.hash, docs)
        triple = window_hashes(w.hash, 3)
        inside = owner[: len(triple)] == owner[2:] if len(triple) else np.empty(0, bool)
        triples, _ = _distinct(owner[: len(triple)][inside], triple[inside], docs)
        same = np.concatenate(([False], (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1]))) if len(owner) else np.empty(0)
        out[begin:end] = np.column_stack([
            np.log1p(size), np.log1p(words), by_doc(long), share["upper"], share["lower"], share["digit"], share["mark"], share["foreign"], share["lines"] * 10,
            distinct / some, most / some, triples / np.maximum(words - 2, 1), by_doc(long <= 2), by_doc(long >= 14),
            by_doc(CLASSES["mark"][w.data[np.maximum(w.end - 1, 0)]]), by_doc((upper >= 2) & (upper + marks == long)), by_doc(marks == long), by_doc(same),
        ])
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(x)), np.sqrt(2 / len(self.phase)) * np.cos(z @ self.project + self.phase)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.values)


def with_statistics(docs: DataFrame, kept: list[str], name: str = "x") -> DataFrame:
    """The columns `kept` of docs, and behind them the statistics of its texts as column `name`."""
    rows = docs.select(*kept, *(["text"] if "text" not in kept else []))
    at = rows.columns.index("text")

    def run(batches):
        for b in batches:
            x = statistics(as_bytes(b.column(at))).astype(np.float32)
            flat = pa.array(x.ravel(), pa.float32())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.ListArray.from_arrays(offsets, flat)], [*kept, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(kept)], T.StructField(name, T.ArrayType(T.FloatType()))]))


def pool_adjacent(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Isotonic (rising) shares of good in n, by pooling adjacent violators."""
    stack: list[list[float]] = []
    for count, g in zip(n.tolist(), good.tolist(), strict=True):
        stack.append([g, count, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            g2, c2, k2 = stack.pop()
            stack[-1] = [stack[-1][0] + g2, stack[-1][1] + c2, stack[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / c) for g, c, k in stack]) if stack else np.empty(0)


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, len(STATISTICS)))


def fit(table: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, width: int = 256, penalty: float = 1e-3, seed: int = 7) -> Model | None:
    """table: with_statistics() of the documents. None if there are no labelled rows to learn from."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).cast("double").alias("y"))
    rows = cut(table.where("doc_id IS NOT NULL").join(known.where(~held_out("doc_id", folds, fold)), "doc_id").select("x", "y"), "quality-rows")
    k = len(STATISTICS)
    moments = rows.agg(F.count(F.lit(1)), *[f(F.col("x")[i].cast("double")) for f in (F.avg, F.stddev_pop) for i in range(k)]).first()
    if not moments[0]:
        return None
    rng = np.random.default_rng(seed)
    scale = np.array(moments[1 + k :], float)
    model = Model(np.array(moments[1 : 1 + k], float), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, np.sqrt(1 / k), (k, width)), rng.uniform(0, 2 * np.pi, width), None, None, None)
    chunk = 32

    def sums(frames):
        import zstandard as zs
        from pyspark import TaskContext

        total = np.zeros((width + 1, width + 2))
        for pdf in frames:
            z = model.features(_matrix(pdf["x"]))
            total += z.T @ np.column_stack([z, pdf["y"].to_numpy()])
        pack = zs.ZstdCompressor(level=1).compress
        first = range(0, width + 1, chunk)
        yield pd.DataFrame({"part": TaskContext.get().partitionId(), "chunk": first, "value": [pack(total[i : i + chunk].tobytes()) for i in first]})

    parts = cut(rows.mapInPandas(sums, "part int, chunk int, value binary"), "sums")
    added = add_in_tree(parts, "<f8")
    drop(parts)
    total = np.concatenate([added[i].reshape(-1, width + 2) for i in sorted(added)])
    n = total[0, 0]
    model.ridge = np.linalg.solve(total[:, :-1] + penalty * n * np.diag(np.r_[0, np.full(width, 1 / width)]) + 1e-9 * np.eye(width + 1), total[:, -1])

    def binned(frames):
        for pdf in frames:
            at = np.clip((model.raw(_matrix(pdf["x"])) + 1) / 3 * BINS, 0, BINS - 1).astype(int)
            yield pdf.assign(at=at)[["at", "y"]]

    bins = sorted(rows.mapInPandas(binned, "at int, y double").groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).collect())
    at, count, good = (np.array(c, float) for c in zip(*bins, strict=True))
    model.edges = (at + 0.5) / BINS * 3 - 1
    model.values = pool_adjacent(count + 1e-9, good)
    drop(rows)
    return model


def score(table: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score from with_statistics(). Without a model every score is 0."""

    def run(frames):
        for pdf in frames:
            yield pdf.assign(score=model.score(_matrix(pdf["x"])) if model and len(pdf) else 0.0)[["doc_id", "score"]]

    return table.mapInPandas(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts have the statistics of an empty text."""
    table = cut(with_statistics(docs, ["doc_id"]), "statistics")
    return score(table, fit(table, labels)).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns; all rows if nothing could be learnt.

    One scan writes the rows beside their statistics; no row moves between
    partitions.  Null and empty texts have the statistics of an empty text;
    repeated rows share their fate.
    """
    name = "_statistics"
    while name in docs.columns:
        name += "_"
    wide = cut(with_statistics(docs, docs.columns, name), "statistics")
    model = fit(wide.select("doc_id", F.col(name).alias("x")), labels)
    good = F.lit(True)
    if model:

        @F.pandas_udf("boolean")
        def good_enough(x: pd.Series) -> pd.Series:
            return pd.Series(model.score(_matrix(x)) >= threshold)

        good = good_enough(name)
    return wide.where(good).select(*docs.columns)
