"""Counts of greedy longest-match pieces by a linear automaton.

The vocabulary becomes a trie.  Each node carries a failure link (the node from
which matching goes on when no edge fits) and the number of pieces that greedy
matching emits on the way there, computed beforehand.  A word is then read
symbol by symbol: the counts are added up, and no piece is ever built.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

#: Words whose counts a worker remembers; beyond that they are counted again.
REMEMBERED = 1 << 18


def byte_level() -> dict[str, int]:
    """The usual printable stand-ins of bytes in byte-level vocabularies: character -> byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level BPE vocabulary file, as bytes (on the driver; the list is then broadcast)."""
    of = byte_level()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return sorted(bytes(of[c] for c in piece) for piece in vocab if all(c in of for c in piece))


class Automaton:
    def __init__(self, pieces: list[bytes]):
        self.next: dict[int, int] = {}
        self.fail, self.pops = [0], [0]
        final = [False]
        for p in pieces:
            u = 0
            for c in p:
                v = self.next.get(u << 8 | c)
                if v is None:
                    v = self.next[u << 8 | c] = len(final)
                    final.append(False)
                u = v
            final[u] = final[u] or bool(p)
        children: dict[int, list[tuple[int, int]]] = {}
        for k, v in self.next.items():
            children.setdefault(k >> 8, []).append((k & 255, v))
        self.fail, self.pops = [-1] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in children.get(u, ()):
                queue.append(v)
                if final[v]:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                z, n = self.fail[u], self.pops[u]
                while z >= 0 and (z << 8 | c) not in self.next:
                    n += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z << 8 | c], n
        self.fail[0] = -1

    def count(self, word: bytes) -> int:
        """Pieces of a word; a word that can't be cut greedily is one unknown piece."""
        step, fail, pops = self.next, self.fail, self.pops
        u = n = 0
        for c in word:
            while (v := step.get(u << 8 | c)) is None:
                n += pops[u]
                u = fail[u]
                if u < 0:
                    return 1
            u = v
        while u > 0:
            n += pops[u]
            u = fail[u]
        return n if u == 0 else 1


class Counts(dict):
    """Remembered counts of words."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(self) < REMEMBERED:
            self[word] = n
        return n


_made: dict[str, Counts] = {}


def token_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens of every row.

    Words are runs of anything but ASCII white space; each is matched with a
    space before it.  Null and empty texts have none.  Texts are read whole and
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = hashlib.sha256(b"\0".join(vocabulary)).hexdigest()

    def run(batches):
        if key not in _made:
            _made.clear()
            _made[key] = Counts(Automaton(shared.value))
        count = _made[key].__getitem__
        for b in batches:
            texts = as_bytes(b.column(1))
            split = (t.split() for t in texts)
            both = [(len(w), sum(map(count, w))) for w in split]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.int64())],
                ["doc_id", "n_bytes", "n_words", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_words long, n_tokens long")
