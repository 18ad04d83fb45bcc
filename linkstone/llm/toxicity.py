"""Toxicity by compression distance: two zstandard dictionaries, windows, calibrated thresholds.

Fit (on a bounded sample of labelled rows, see `sample_toxic`, `sample_ordinary`).
A dictionary is trained on windows of ordinary text.  The toxic dictionary is
trained on those stretches of toxic texts whose byte 5-grams occur in far more
toxic than ordinary texts, and stands before the ordinary one, so that both
compress ordinary prose alike and only toxic material makes a difference.  The
other third of the sample calibrates: each number of bytes saved in a window gets
its log-ratio of shares in toxic and ordinary texts, and logistic regression
with the class shares of all labelled rows turns sums of these into a score.

Score.  Every window of every text is compressed with either dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, held_out

WINDOW, STRIDE, LEVEL = 64, 48, 9
ORDINARY_BYTES, TOXIC_BYTES = 32 << 10, 4 << 10
GRAM = 5


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    evidence: list[float]

    def compressors(self):
        import zstandard as zs

        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zs.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)]


#: Bytes saved in a window are counted from LEAST to MOST.
LEAST, MOST = -3, 9


def saved_counts(text: bytes, ordinary, toxic) -> np.ndarray:
    """How many windows of a text are so many bytes shorter with the toxic dictionary."""
    saved = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)])
    return np.bincount(np.clip(saved, LEAST, MOST) - LEAST, minlength=MOST - LEAST + 1)


def features(counts: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """For each row of saved_counts: a constant, the evidence of all windows, of the mean one, of the most telling one, and the length."""
    counts = np.atleast_2d(counts)
    n, total = counts.sum(axis=1), counts @ evidence
    most = np.where(counts > 0, evidence, -np.inf).max(axis=1)
    return np.column_stack([np.ones(len(n)), total / 4, 10 * total / n, most, np.log(n)])


def grams(text: bytes) -> np.ndarray:
    a = np.frombuffer(text.lower(), np.uint8).astype(np.uint64)
    if len(a) < GRAM:
        return np.empty(0, np.uint64)
    n = len(a) - GRAM + 1
    g = np.zeros(n, np.uint64)
    for k in range(GRAM):
        g = (g << np.uint64(8)) | a[k : n + k]
    return g


def _shares(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.unique(grams(t)) for t in texts] or [np.empty(0, np.uint64)]), return_counts=True)


def marked_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Stretches of the toxic texts made of grams that mark them: over 15 times as frequent, by over 5 standard errors."""
    gt, nt = _shares(toxic)
    go, no = _shares(ordinary)
    at = np.minimum(np.searchsorted(go, gt), max(len(go) - 1, 0))
    same = np.where(go[at] == gt, no[at], 0) if len(go) else np.zeros(len(gt))
    pt, po = (nt + 0.5) / (len(toxic) + 1), (same + 0.5) / (len(ordinary) + 1)
    z = (pt - po) / np.sqrt(pt * (1 - pt) / len(toxic) + po * (1 - po) / max(1, len(ordinary)))
    marks = gt[(z > 5) & (pt > 15 * po)]
    out = []
    for t in toxic if len(marks) else ():
        g = grams(t)
        hit = np.flatnonzero(marks[np.minimum(np.searchsorted(marks, g), len(marks) - 1)] == g)
        if len(hit):
            out += [t[max(0, r[0] - 1) : r[-1] + GRAM + 1] for r in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)]
    return out


def _dictionary(samples: list[bytes], size: int, **how) -> bytes:
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples, **how).as_bytes()
    except zs.ZstdError:  # too few samples to train on: their own bytes serve as content
        return b" ".join(samples)[-size:]


def fit_sample(texts: list[bytes], toxic: np.ndarray, share: float, seed: int = 0, sample_windows: int = 40_000) -> Model | None:
    """None if the sample lacks one of the classes. sample_windows: windows of ordinary texts, drawn at random, that its dictionary is trained on."""
    rng = np.random.default_rng(seed)
    if not toxic.any() or toxic.all():
        return None
    part = rng.permutation(len(texts)) % 3 > 0
    if not toxic[part].any() or toxic[part].all() or not toxic[~part].any() or toxic[~part].all():
        part[:] = True
    bad = [texts[i] for i in np.flatnonzero(part & toxic)]
    good = [texts[i] for i in np.flatnonzero(part & ~toxic)]
    all_windows = [w for t in good for w in windows(t)]
    picked = [all_windows[i] for i in rng.permutation(len(all_windows))[:sample_windows]]
    stretches = marked_stretches(bad, good) or [w for t in bad for w in windows(t)]
    stretches = [stretches[i] for i in rng.permutation(len(stretches))]
    joined = [b" ".join(stretches[i : i + 8]) for i in range(0, len(stretches), 8)]
    model = Model(_dictionary(picked, ORDINARY_BYTES), _dictionary(joined, TOXIC_BYTES, k=16, d=6), [], [])
    ordinary, tox = model.compressors()
    held = np.flatnonzero(~part) if not part.all() else np.arange(len(texts))
    counts = np.array([saved_counts(texts[i], ordinary, tox) for i in held])
    y = toxic[held].astype(float)
    # a window's evidence: log-ratio of the shares of its bin in toxic and ordinary texts
    share_of = lambda rows: (rows.sum(axis=0) + 0.5) / (rows.sum() + 0.5 * counts.shape[1])
    model.evidence = [float(v) for v in np.log(share_of(counts[y > 0]) / share_of(counts[y == 0]))]
    x = features(counts, np.array(model.evidence))
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = [float(v) for v in w]
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample_toxic: int = 3000, sample_ordinary: int = 6000) -> Model | None:
    """Learn from at most sample_toxic + sample_ordinary labelled rows outside the held-out fold.

    The sample is chosen by a hash of doc_id; its ids (bounded) are broadcast, so
    the texts of other rows never move.  One task fits, and sends back two
    dictionaries and some twenty numbers.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id", folds, fold))
    counts = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = F.xxhash64("doc_id")
    ids = known.where("toxic > 0").orderBy(order, "doc_id").limit(sample_toxic).unionByName(known.where("toxic <= 0").orderBy(order, "doc_id").limit(sample_ordinary))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")

    def learn(pdf):
        import pickle

        pdf = pdf.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
        model = fit_sample([(t or "").encode() for t in pdf["text"]], (pdf["toxic"] > 0).to_numpy(), share)
        return pdf.head(1).assign(model=pickle.dumps(model and (model.ordinary, model.toxic, model.weights, model.evidence)))[["model"]]

    import pickle

    got = rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(learn, "model binary").collect()
    made = pickle.loads(bytes(got[0]["model"])) if got else None  # noqa: S301  our own bytes
    return made and Model(*made)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of every row. Null and empty texts have one empty window. Without a model every score is 0."""

    def run(batches):
        if model:
            ordinary, tox = model.compressors()
            w, evidence = np.array(model.weights), np.array(model.evidence)
        for b in batches:
            scores = np.zeros(b.num_rows)
            if model and b.num_rows:
                counts = np.array([saved_counts(t, ordinary, tox) for t in as_bytes(b.column(1))])
                scores = 1 / (1 + np.exp(-np.clip(features(counts, evidence) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts have one empty window.  Repeated rows get equal scores;
    of labelled rows with one doc_id the least text is learnt from, and the
    highest of their labels counts.  Texts of any length are read whole.  Other
    columns of either table are ignored.
    """
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
