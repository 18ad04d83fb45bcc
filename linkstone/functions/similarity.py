"""String similarities. Set-based ones are column expressions; those on edit sequences are Arrow-batched pandas UDFs.

The longest common subsequence uses bit vectors (one big integer a text), so a
pair costs one step a character.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    mask: dict[str, int] = {}
    for i, c in enumerate(a):
        mask[c] = mask.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & mask.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel(a: str, b: str) -> float:
    """100 * 2 * LCS / (lengths); two empty texts are alike."""
    n = len(a) + len(b)
    return 100.0 * 2 * lcs(a, b) / n if n else 100.0


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    t, p, q = " ".join(both), " ".join(only_x), " ".join(only_y)
    best = indel(f"{t} {p}".strip(), f"{t} {q}".strip())
    if t:  # the shorter text is a prefix: lengths decide
        for rest in (p, q):
            n = len(t) + len(t) + 1 + len(rest)
            best = max(best, 100.0 * 2 * len(t) / n)
    return best


def partial(a: str, b: str) -> float:
    """Best indel similarity of the shorter text with a stretch of the longer one of its length, cut off at the ends."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    best = max(indel(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))
    return max(best, max(indel(long, short[max(0, i) : i + n]) for i in range(1 - n, n))) if len(long) == n else best


def jaro_winkler(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    reach = max(reach, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


#: Records of a list; longer texts than a word of bits go pair by pair.
LIST, BITS = 1000, 63
_ONE = np.uint64(1)


def _masks(texts: list[str]) -> dict[str, np.ndarray]:
    """For each character, the bits of its places in each text."""
    out: dict[str, np.ndarray] = {}
    for k, text in enumerate(texts):
        for i, c in enumerate(text):
            if c not in out:
                out[c] = np.zeros(len(texts), np.uint64)
            out[c][k] |= np.uint64(1 << i)
    return out


def indel_of_one(a: str, masks: dict[str, np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """indel() of one text with each text of a list."""
    full = (_ONE << lengths.astype(np.uint64)) - _ONE
    s = full.copy()
    for c in a:
        if c in masks:
            u = s & masks[c]
            s = ((s + u) | (s - u)) & full
    n = lengths + len(a)
    return np.where(n > 0, 100.0 * 2 * (lengths - np.bitwise_count(s)) / np.maximum(n, 1), 100.0)


def jaro_winkler_of_one(a: str, masks: dict[str, np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """jaro_winkler() of one text with each text of a list."""
    if not a:
        return np.where(lengths == 0, 1.0, 0.0)
    reach = np.maximum(np.maximum(lengths, len(a)) // 2 - 1, 0)
    used = np.zeros(len(lengths), np.uint64)
    full = (_ONE << lengths.astype(np.uint64)) - _ONE
    took = []
    for i, c in enumerate(a):
        if c not in masks:
            continue
        window = (_ONE << np.minimum(i + reach + 1, BITS).astype(np.uint64)) - (_ONE << np.minimum(np.maximum(i - reach, 0), BITS).astype(np.uint64))
        free = masks[c] & window & full & ~used
        low = free & (~free + _ONE)
        used |= low
        took.append((c, low != 0))
    m = np.bitwise_count(used).astype(np.int64)
    rest, moved = used, np.zeros(len(lengths), np.int64)
    for c, hit in took:
        low = np.where(hit, rest & (~rest + _ONE), np.uint64(0))
        moved += hit & (masks[c] & low == 0)
        rest = rest ^ low
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / len(a) + m / np.maximum(lengths, 1) + (some - moved // 2) / some) / 3, 0.0)
    same, alike = np.zeros(len(lengths), np.int64), np.ones(len(lengths), bool)
    for i, c in enumerate(a[:4]):
        alike &= (masks[c] >> np.uint64(i)) & _ONE == 1 if c in masks else False
        same += alike
    return np.where(jaro <= 0.7, jaro, jaro + 0.1 * same * (1 - jaro))


def over_lists(kind: str):
    """Function from rows of two lists (s1, a; target, b) to the similarity of all their pairs."""
    one, single = {"indel": (indel_of_one, indel), "jaro_winkler": (jaro_winkler_of_one, jaro_winkler)}[kind]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                s1, a, target, b = (batch.column(k)[row].values for k in ("s1", "a", "target", "b"))
                texts = b.to_pylist()
                short = [t if len(t) <= BITS else "" for t in texts]
                long = [k for k, t in enumerate(texts) if len(t) > BITS]
                masks, lengths = _masks(short), np.array([len(t) for t in short], np.int64)
                values = np.empty((len(a), len(b)))
                for i, t in enumerate(a.to_pylist()):
                    values[i] = one(t, masks, lengths) if len(t) <= BITS else [single(t, x) for x in texts]
                    for k in long:
                        values[i, k] = single(t, texts[k])
                for i in range(0, len(a), 100):
                    part = values[i : i + 100]
                    yield pa.RecordBatch.from_arrays([s1.slice(i, len(part)).take(np.repeat(np.arange(len(part)), len(b))), target.take(np.tile(np.arange(len(b)), len(part))), pa.array(part.ravel())], names=["s1", "target", "similarity"])

    return run


def _over_batches(f, a, b) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([f(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype=float)

    return run(a, b)


def indel_ratio(a, b) -> Column:
    return _over_batches(indel, a, b)


def token_sort_ratio(a, b) -> Column:
    return _over_batches(token_sort, a, b)


def token_set_ratio(a, b) -> Column:
    return _over_batches(token_set, a, b)


def partial_ratio(a, b) -> Column:
    return _over_batches(partial, a, b)


def jaro_winkler_similarity(a, b) -> Column:
    return _over_batches(jaro_winkler, a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def trigrams(c: Column) -> Column:
    return F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def trigram_jaccard(a: Column, b: Column) -> Column:
    short = (F.length(a) < 3) | (F.length(b) < 3)
    return F.when((a == "") | (b == ""), 0.0).when(short, (a == b).cast("double")).otherwise(jaccard(trigrams(a), trigrams(b)))


def three_way(a: Column, b: Column) -> Column:
    """1 equal, -1 different, 0 if either is missing."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(-1.0)
