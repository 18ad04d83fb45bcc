"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch of texts (a unit ends where no piece can go on:
before a space mark that follows another character) are put one after another,
SLICE characters at a time, and indexed by a suffix array.  Every piece of the
vocabulary is looked up by binary search; its range of suffixes gives all its
occurrences, as edges.  The edges are sorted by position and relaxed from left
to right.  Units over LONG characters are indexed in stretches and relaxed
position by position, with one number kept for each.

Unigram models relax by score.  In a merge model exactly one piece can end the
encoding of each prefix: the one whose edge starts at a settled position and
whose pair with the piece settled there wouldn't have merged otherwise.  So the
edges are relaxed by that condition, and the ids are those of the merges.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_type, as_bytes, flushes

MARK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Units whose ids a worker remembers.
REMEMBERED = 1 << 17
#: Text of a batch; longer texts are encoded in parts of about PART characters.
BATCH_BYTES, PART = 2 << 20, 1 << 19
#: Characters that are indexed at once, and those of a unit that takes the other way.
SLICE, LONG = 1 << 18, 192
#: Pairs of pieces remembered for long units.
PAIRS = 1 << 19


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, raw[i : i + n]
            i += n


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    merges: bool
    prefix: bool
    byte_ids: dict[int, int] = field(default_factory=dict)
    unknown: int = 0
    name: str = ""


def read_model(path: str) -> Model:
    """Of a model file without a normalisation table and without removal of extra spaces (on the driver)."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces, scores, kinds, merges, prefix = [], [], [], False, True
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            pieces.append(f[1].decode())
            scores.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
            kinds.append(f.get(3, NORMAL))
        elif number == 2:
            merges = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            f = dict(_fields(value))
            if f.get(2) or f.get(4, 1):
                raise ValueError("models that normalise text aren't supported")
            prefix = bool(f.get(3, 1))
    kinds = np.array(kinds)
    byte_ids = {int(pieces[i][1:-1], 16): i for i in np.flatnonzero(kinds == BYTE).tolist()}
    return Model(pieces, np.array(scores), kinds, merges, prefix, byte_ids, int(np.flatnonzero(kinds == UNKNOWN)[0]), hashlib.sha256(raw).hexdigest())


class Codec:
    """A model made ready for one worker process."""

    def __init__(self, model: Model):
        self.model = model
        self.ids = {model.pieces[i]: i for i in np.flatnonzero(model.kinds == NORMAL).tolist()}
        self.size = len(model.pieces)
        inner = [p for p in self.ids if MARK in p[1:].lstrip(MARK)]
        self.unit = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if not inner else "(?s).+")
        chars = sorted({c for p in self.ids for c in p})
        self.code_of = np.ones(0x110000, np.uint16)  # 1: in no piece
        self.code_of[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        self.longest = max(map(len, self.ids))
        self.rank = np.full(self.size, -1, np.int64)  # of the merge that makes a piece; -1 for single characters
        order = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: (-model.scores[i], i))
        self.rank[order] = np.arange(len(order))
        self.usable = [i for p, i in sorted(self.ids.items())]
        if model.merges:
            self._learn_splits()
        text = [model.pieces[i] for i in self.usable]
        self.lengths = np.array([len(t) for t in text])
        self.codes = np.zeros((len(text), -(-self.longest // 8) * 8), np.uint16)
        for k, t in enumerate(text):
            self.codes[k, : len(t)] = self.code_of[[ord(c) for c in t]]
        self.alphabet = len(chars) + 2
        self.usable = np.array(self.usable)
        self.bytes = [p.replace(MARK, " ").encode() for p in model.pieces]
        for b, i in model.byte_ids.items():
            self.bytes[i] = bytes([b])
        for i in np.flatnonzero(~np.isin(model.kinds, (NORMAL, BYTE))).tolist():
            self.bytes[i] = " ⁇ ".encode() if i == model.unknown else b""
        self.known: dict[str, bytes] = {}
        self.cut_at = None if inner else re.compile(f"[^{MARK}]{MARK}")
        self.piece_length = np.array([len(t) for t in model.pieces] + [1])  # the last one: a character without a piece

    def merge(self, text: str, last: list | None = None) -> list[int]:
        """Plain merging of a short text: the best pair first, the leftmost of equals. last gets the final pair merged."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if best is None:
                return [self.ids.get(p, -1) for p in parts]
            if last is not None:
                last[:] = [self.ids.get(parts[at], -1), self.ids.get(parts[at + 1], -1)]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _learn_splits(self) -> None:
        """Drop pieces that merging never makes; learn of the others the last two parts, and which pairs merge."""
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        kept = []
        for i in self.usable:
            p, last = self.model.pieces[i], []
            if len(p) == 1 or self.merge(p, last) == [i]:
                kept.append(i)
                if len(p) > 1:
                    self.left[i], self.right[i] = last
        self.usable = kept
        pairs = [(self.ids[p[:k]] * self.size + self.ids[p[k:]], self.rank[i]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        pairs.sort()
        self.pair, self.pair_rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.pair_ranks: dict[int, int] = {}
        self.agreed: dict[int, bool] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a and b together gives just these two.

        Both merge histories are taken back across the border, latest merge
        first; the pair is spoilt if two parts that stood at the border at some
        time would have merged before the next merge that really came.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)  # rank of the next merge on either side
        right_side = np.zeros(len(a), bool)  # whether that merge was on the right: equals go to the left one first
        while len(live):
            code = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
            rank = np.where(self.pair[at] == code, self.pair_rank[at], np.iinfo(np.int64).max)
            bad = (rank < limit) | ((rank == limit) & right_side)
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            back_right = rb >= ra  # of equal ranks the left one was merged first
            go = ~bad & ((ra >= 0) | (rb >= 0))
            a, b, live, back_right, ra, rb = (x[go] for x in (a, b, live, back_right, ra, rb))
            limit, right_side = np.where(back_right, rb, ra), back_right
            a, b = np.where(back_right, a, self.right[a]), np.where(back_right, self.left[b], b)
        return ok

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible(), once for each distinct pair."""
        code, back = np.unique(a * self.size + b, return_inverse=True)
        return self.compatible(code // self.size, code % self.size)[back]

    def _agrees(self, a: int, b: int) -> bool:
        """compatible() of one pair, remembered."""
        code = a * self.size + b
        known = self.agreed.get(code)
        if known is None:
            if not self.pair_ranks:
                self.pair_ranks = dict(zip(self.pair.tolist(), self.pair_rank.tolist(), strict=True))
                self.parts = [(r, x, y) for r, x, y in zip(self.rank.tolist(), self.left.tolist(), self.right.tolist(), strict=True)]
            if len(self.agreed) >= PAIRS:
                self.agreed.clear()
            known, limit, right_side, infinite = True, float("inf"), False, float("inf")
            while True:
                rank = self.pair_ranks.get(a * self.size + b, infinite)
                if rank < limit or (rank == limit and right_side):
                    known = False
                    break
                (ra, _, after), (rb, before, _) = self.parts[a], self.parts[b]
                if ra < 0 and rb < 0:
                    break
                right_side = rb >= ra
                limit = rb if right_side else ra
                a, b = (a, before) if right_side else (after, b)
            self.agreed[code] = known
        return known

    def suffixes(self, codes: np.ndarray, per: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array of codes by prefix doubling, as deep as the longest piece; and the first `per` codes of each position as one number."""
        n = len(codes)
        wide = np.concatenate((codes, np.zeros(per, np.uint64)))
        some = np.zeros(n, np.uint64)
        for k in range(per):
            some |= wide[k : n + k] << np.uint64(bits * (per - 1 - k))
        order, depth, keys = np.argsort(some), per, some
        while depth < self.longest:
            ranked = keys[order]
            rank = np.empty(n + 1, np.int64)
            rank[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])))
            rank[n] = 0
            if rank.max() == n:
                break
            keys = rank[:n] * (n + 1) + rank[np.minimum(np.arange(n) + depth, n)]
            order, depth = np.argsort(keys), depth * 2
        return order, some

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all occurrences, by two binary searches a piece in the suffix array. codes: the text, 0 between units.

        The characters of the text are numbered anew, so that as many as possible
        fit in a 64-bit number; pieces are compared number by number.
        """
        n = len(codes)
        there = np.bincount(codes, minlength=self.alphabet) > 0
        there[:2] = True
        rank = np.cumsum(there) - 1
        bits = 8 if rank[-1] < 255 else 16
        per, top = 64 // bits, np.uint64((1 << bits) - 1)
        order, some = self.suffixes(rank[codes].astype(np.uint64), per, bits)
        can = np.flatnonzero(there[self.codes].all(axis=1))  # pieces with other characters can't occur
        pieces = rank[self.codes[can]].astype(np.uint64)
        lengths = self.lengths[can]
        low, high = np.zeros(len(can), np.int64), np.full(len(can), n)
        some = np.append(some, np.uint64(0))

        def search(c: int, which: np.ndarray, filler: np.uint64, right: bool) -> np.ndarray:
            """First suffix in low:high whose c-th number isn't below (right: is above) the piece's."""
            target = np.zeros(len(which), np.uint64)
            for k in range(per):
                at = c * per + k
                value = np.where(at < lengths[which], pieces[which, min(at, pieces.shape[1] - 1)], filler)
                target |= value << np.uint64(bits * (per - 1 - k))
            a, b = low[which].copy(), high[which].copy()
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    return a
                middle = (a[open_] + b[open_]) >> 1
                value = some[np.minimum(order[middle] + c * per, n)]
                up = value <= target[open_] if right else value < target[open_]
                a[open_[up]] = middle[up] + 1
                b[open_[~up]] = middle[~up]

        for c in range(-(-self.longest // per)):
            which = np.flatnonzero((lengths > c * per) & (low < high))
            if not len(which):
                break
            first = search(c, which, np.uint64(0), False)
            high[which] = search(c, which, top, True)
            low[which] = first
        count = np.maximum(high - low, 0)
        suffix = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start, k = order[suffix], np.repeat(np.arange(len(count)), count)
        return start, start + lengths[k], self.usable[can[k]]

    def _with_unknown(self, codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """edges(), and as edges of piece -1 the characters (text) without a piece of their own."""
        start, end, piece = self.edges(codes)
        alone = text.copy()
        alone[start[end == start + 1]] = False
        at = np.flatnonzero(alone)
        return np.concatenate((start, at)), np.concatenate((end, at + 1)), np.concatenate((piece, np.full(len(at), -1)))

    def encode_long(self, unit: str, stretch: int = 1 << 16) -> bytes:
        """Ids of one unit, whose stretches are indexed one after another."""
        n = len(unit)
        last = np.full(n + 1, -9, np.int32)
        last[0] = -2
        best = None if self.model.merges else np.full(n + 1, -np.inf)
        if best is not None:
            best[0] = 0.0
        scores, worst = self.model.scores.tolist(), float(self.model.scores.min()) - 10
        for begin in range(0, n, stretch):
            points = np.frombuffer(unit[begin : begin + stretch + self.longest].encode("utf-32-le", "surrogatepass"), "<u4")
            start, end, piece = self._with_unknown(self.code_of[points], np.ones(len(points), bool))
            own = np.flatnonzero(start < stretch)
            own = own[np.argsort(start[own], kind="stable")]
            here = last[begin : begin + len(points) + 1].tolist()
            value = None if best is None else best[begin : begin + len(points) + 1].tolist()
            for s, e, p in zip(start[own].tolist(), end[own].tolist(), piece[own].tolist(), strict=True):
                before = here[s]
                if before == -9:
                    continue
                if value is None:
                    if before < 0 or p < 0 or self._agrees(before, p):
                        here[e] = p
                else:
                    v = value[s] + (scores[p] if p >= 0 else worst)
                    if v > value[e]:
                        here[e], value[e] = p, v
            last[begin : begin + len(here)] = here
            if best is not None:
                best[begin : begin + len(here)] = value
        out, at = [], n
        while at > 0:
            i = int(last[at])
            out += [i] if i >= 0 else self._unknown(unit[at - 1])[::-1]
            at -= int(self.piece_length[i])
        return np.array(out[::-1], "<i4").tobytes()

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, as little-endian 32-bit numbers."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        size = np.array([len(u) for u in units])
        base = np.cumsum(size + 1) - size - 1
        codes = np.zeros(int((size + 1).sum()), np.uint16)
        inside = np.arange(len(points)) + np.repeat(np.arange(len(units)), size)
        codes[inside] = self.code_of[points]
        text = np.zeros(len(codes), bool)
        text[inside] = True
        start, end, piece = self._with_unknown(codes, text)
        offset = start - np.repeat(base, size + 1)[start]
        order = np.argsort(offset.astype(np.uint16) if size.max() < 1 << 16 else offset, kind="stable")  # edges by position in their unit
        start, end, piece, offset = start[order], end[order], piece[order], offset[order]
        at = np.searchsorted(offset, np.arange(int(size.max()) + 1))
        last, came = np.full(len(codes) + 1, -9, np.int64), np.full(len(codes) + 1, -1, np.int64)
        last[base] = -2  # nothing before
        best = np.full(len(codes) + 1, -np.inf)
        best[base] = 0.0
        worst = float(self.model.scores.min()) - 10
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            if self.model.merges:
                ok = last[s] > -9
                both = ok & (last[s] >= 0) & (p >= 0)
                if both.any():
                    ok[both] = self._agree(last[s[both]], p[both])
                s, e, p = s[ok], e[ok], p[ok]
                last[e], came[e] = p, s
            else:
                value = best[s] + np.where(p >= 0, self.model.scores[p], worst)
                order = np.lexsort((value, e))
                top = np.flatnonzero(np.append(e[order][1:] != e[order][:-1], True)) if len(e) else order
                s, e, p, value = (x[order][top] for x in (s, e, p, value))
                better = value > best[e]
                last[e[better]], came[e[better]], best[e[better]] = p[better], s[better], value[better]
        # back along the edges of all units at once
        at = base + size
        on_path = np.zeros(len(codes) + 1, bool)
        live = np.flatnonzero(came[at] >= 0)
        reached = np.zeros(len(units), bool)
        reached[live] = True
        at = at[live]
        while len(at):
            on_path[at] = True
            at = came[at]
            at = at[came[at] >= 0]
        plain = reached.copy()
        ends = np.flatnonzero(on_path)
        unit_of = np.searchsorted(base, ends, side="left") - 1
        plain[unit_of[last[ends] < 0]] = False
        ids = last[ends].astype("<i4")
        cut_at = np.searchsorted(unit_of, np.arange(len(units) + 1)) * 4
        raw = ids.tobytes()
        return [raw[a:b] if ok else self._walk(u, s, s + len(u), last, came) for u, s, a, b, ok in zip(units, base.tolist(), cut_at[:-1].tolist(), cut_at[1:].tolist(), plain.tolist(), strict=True)]

    def _walk(self, unit: str, begin: int, at: int, last: np.ndarray, came: np.ndarray) -> bytes:
        out = []
        while at > begin:
            if came[at] < 0:  # not reached: can't happen with consistent merges, but then merging itself decides
                out, rest = [], self.merge(unit)
                for c, i in zip(unit, rest, strict=False) if len(rest) == len(unit) else ((None, i) for i in rest):
                    out += [i] if i >= 0 else self._unknown(c)
                return np.array(out, "<i4").tobytes()
            i = int(last[at])
            out += [i] if i >= 0 else self._unknown(unit[at - 1 - begin])[::-1]
            at = int(came[at])
        return np.array(out[::-1], "<i4").tobytes()

    def _unknown(self, char: str) -> list[int]:
        found = [self.model.byte_ids.get(b) for b in char.encode()]
        return [self.model.unknown] if None in found else found

    def _parts(self, text: str):
        """A marked text, cut where units end into parts of about PART characters."""
        begin = 0
        while self.cut_at and len(text) - begin > 2 * PART and (found := self.cut_at.search(text, begin + PART)):
            yield text[begin : found.start() + 1]
            begin = found.start() + 1
        yield text[begin:]

    def _learn(self, units: set[str], batch: set[str]) -> None:
        """Make the ids of the units of a batch known; forget others beyond REMEMBERED."""
        new = units - self.known.keys()
        if len(new) + len(self.known) > REMEMBERED:
            self.known = {u: self.known[u] for u in batch if u in self.known}
        some, size = [], 0
        for u in new:
            some.append(u)
            size += len(u) + 1
            if size >= SLICE:
                self.known.update(zip(some, self.encode_units(some), strict=True))
                some, size = [], 0
        if some:
            self.known.update(zip(some, self.encode_units(some), strict=True))

    def _encode_part(self, units: list[str]) -> bytes:
        get = self.known.get
        return b"".join([self.encode_long(u) if (ids := get(u)) is None else ids for u in units])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Texts of more than a batch are encoded part by part, the others together."""
        marked = [(MARK if self.model.prefix and t else "") + t.replace(" ", MARK) for t in texts]
        together = {i: self.unit.findall(t) for i, t in enumerate(marked) if len(t) <= 2 * PART}
        batch = {u for us in together.values() for u in us if len(u) <= LONG}
        self._learn(batch, batch)
        out: list = [None] * len(texts)
        for i, us in together.items():
            out[i] = np.frombuffer(self._encode_part(us), "<i4")
        for i, t in enumerate(marked):
            if out[i] is None:
                ids = []
                for part in self._parts(t):
                    us = self.unit.findall(part)
                    short = {u for u in us if len(u) <= LONG}
                    self._learn(short, short)
                    ids.append(self._encode_part(us))
                out[i] = np.frombuffer(b"".join(ids), "<i4")
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return (raw[1:] if self.model.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


_made: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast model; it keeps the last one."""
    key = shared.value.name
    if key not in _made:
        _made.clear()
        _made[key] = Codec(shared.value)
    return _made[key]


def _batches(batches):
    """Lists of (doc_id, text) of about BATCH_BYTES; Arrow batches are taken a thousand rows at a time."""
    rows = ((d, t) for b in batches for k in range(0, b.num_rows, 1000) for d, t in zip(b.column(0).slice(k, 1000).to_pylist(), as_bytes(b.column(1).slice(k, 1000)), strict=True))
    return flushes(rows, BATCH_BYTES)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ids array<int> of every row. Null and empty texts have no ids; repeated rows get equal ids; other columns are ignored."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), arrow_type(docs, "doc_id")

    def run(batches):
        codec = _codec(shared)
        for part in _batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], kind), _lists(codec.encode([t.decode() for _, t in part]))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, model: Model) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids give an empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(np.array(i or [], np.int64)) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text string")


def encode_and_check(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip: whether decoding gives the text back.

    Null and empty texts have no ids and come back as the empty text.  Repeated
    rows get equal results.  Texts of any length are encoded whole, also without
    spaces.  Other columns are ignored.
    """
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), arrow_type(docs, "doc_id")

    def run(batches):
        codec = _codec(shared)
        for part in _batches(batches):
            texts = [t.decode() for _, t in part]
            ids = codec.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in part], kind),
                    _lists(ids),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                    pa.array([codec.decode(i) == t for i, t in zip(ids, texts, strict=True)], pa.bool_()),
                ],
                ["doc_id", "ids", "n_tokens", "ids_sha256", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, ids_sha256 string, round_trip boolean")
