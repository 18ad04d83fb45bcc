"""Shared helpers: tables in the shared folder, and vectorised word hashing over byte buffers.

Word hashing works on a whole block of texts at once: the texts are joined into
one byte buffer, word borders come from a 256-entry byte class, and all words
are hashed eight bytes at a step.  Windows of n words are put together from the
word hashes by doubling.  No Python object is made per word.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.sources.scratch import shared_dir

#: Bytes of text that are hashed at once; each array over them takes eight times as much.
BLOCK_BYTES = 1 << 20


_tables: list[DataFrame] = []


def cut(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a short lineage that outlives executors.

    Tables that drop() or drop_since() don't remove go when the program ends.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/linkstone/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._shared_path = path
    if not _tables:
        atexit.register(drop_since, 0)
    _tables.append(back)
    return back


def tables() -> int:
    """Number of tables made so far, for drop_since()."""
    return len(_tables)


def drop_since(mark: int) -> None:
    """Remove the tables made after tables() returned mark: when what was built from them is written."""
    for table in _tables[mark:]:
        try:
            drop(table)
        except Exception:  # noqa: BLE001  at the end of the program the session may be gone
            return


def drop(df: DataFrame) -> None:
    """Remove a table made by cut() that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        df._shared_path = None


#: Keys that are joined by broadcast: so many can each have more than this fraction of all rows.
HEAVY = 10_000


def join_heavy(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int | None = None) -> DataFrame:
    """Left join of rows with a table that is unique by keys and says in `count` how many rows have a key.

    Fewer than HEAVY keys can hold over 1 / HEAVY of the rows each.  These are
    broadcast, and their rows are spread evenly instead of going to their key's
    task.  The table is read three times, so it should be one that cut() wrote.
    total: the sum of its counts, if it is known.
    """
    if total is None:
        total = table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    values = [c for c in table.columns if c not in keys]
    heavy = F.col(count) > F.lit(total / HEAVY)
    hot = table.where(heavy).select(*keys, F.struct(*values).alias("_hot"))
    cold = table.where(~heavy).select(*keys, F.struct(*values).alias("_cold"), F.lit(0).alias("_salt"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(rows.columns[0]), F.lit(4096)).cast("int") + 1).otherwise(0)
    both = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    found = both.select(*rows.columns, F.coalesce("_hot", "_cold").alias("_found"))
    return found.select(*rows.columns, *[F.col("_found")[v].alias(v) for v in values])


def add_in_tree(pieces: DataFrame, kind: str, fan: int = 256, add_up=np.add) -> dict[int, np.ndarray]:
    """chunk -> sum of the arrays of a chunk. pieces (part int, chunk int, value binary): zstandard-packed arrays of a type, one of each chunk a partition.

    At most `fan` of them meet in a task, whatever the number of partitions.
    """
    import zstandard as zs

    def add(pdf):
        unpack = zs.ZstdDecompressor().decompress
        first, *others = (np.frombuffer(unpack(v), kind) for v in pdf["value"])
        total = first.copy()
        for v in others:
            add_up(total, v, out=total)
        return pdf.head(1).assign(value=zs.ZstdCompressor(level=3).compress(total.tobytes()))[["part", "chunk", "value"]]

    left = pieces.agg(F.coalesce(F.max("part"), F.lit(-1)).alias("n")).first()["n"] + 1
    while left > 0:
        left = -(-left // fan)
        pieces = pieces.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("chunk", "part").applyInPandas(add, "part int, chunk int, value binary")
        left = 0 if left == 1 else left
    return {r["chunk"]: np.frombuffer(zs.ZstdDecompressor().decompress(bytes(r["value"])), kind) for r in pieces.collect()}


def arrow_type(df: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str, folds: int, fold: int):
    """crc32 of doc_id as text, modulo folds, equals fold (null ids count as the text '')."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes that belong to words. In UTF-8 all bytes of a non-ASCII character are 0x80 or more.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SEED = np.array([0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: Longer words are hashed by BLAKE2.
_SHORT = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    out = h >> np.uint64(33)
    out ^= h
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        out *= np.uint64(factor)
        out ^= out >> np.uint64(33)
    return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of stretches of data (which has 8 more bytes at its end).

    Eight bytes at a time go through a scramble that isn't linear; stretches over
    64 bytes take BLAKE2.  Words of up to 8 bytes and equal length never collide.
    The lanes start from the bytes themselves, so a collision in one says
    nothing about the other.
    """
    size, odd = end - start, _ODD[lane]
    chunk = np.ndarray(max(len(data) - 7, 0), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = mix((chunk[start] & _HEAD[np.minimum(size, 8)]) * odd + _SEED[lane] * (size.astype(np.uint64) + np.uint64(1)))
    longer = np.flatnonzero((size > 8) & (size <= _SHORT))
    for k in range(8, _SHORT, 8):
        longer = longer[size[longer] > k]
        if not len(longer):
            break
        h[longer] = mix((h[longer] ^ (chunk[start[longer] + k] & _HEAD[np.minimum(size[longer] - k, 8)])) * odd + np.uint64(k))
    for i in np.flatnonzero(size > _SHORT).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest()
        h[i] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return h


@dataclass
class Words:
    """Words of a block of texts. first[d]:first[d + 1] are those of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def windows(self, n: int, lane: int = 0) -> np.ndarray:
        """Hash of the n words from each position on; the caller keeps to the positions inside one text."""
        return window_hashes(word_hashes(self.data, self.start, self.end, lane) if lane else self.hash, n, lane)

    def text_of(self, words: np.ndarray) -> bytes:
        raw = self.data.tobytes()
        return b" ".join(raw[s:e] for s, e in zip(self.start[words].tolist(), self.end[words].tolist(), strict=True))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def window_hashes(h: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hashes of all runs of n of the hashes h, put together from runs of 1, 2, 4, ... by a scramble at each step."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    join = lambda a, b: mix(a * _ODD[lane] + b)
    level, size, out, length = h, 1, None, 0
    while True:
        if n & size:
            out = level if out is None else join(out[: len(out) - size], level[length : length + len(out) - size])
            length += size
        if length == n:
            return out if n > 1 else mix(out)
        level = join(level[:-size], level[size:])
        size *= 2


def hash_words(texts: list[bytes], word: np.ndarray, lower: bool) -> Words:
    data = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
    if lower:
        data = LOWER[data]
    inside = word[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    borders = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return Words(data, start, end, word_hashes(data, start, end), np.searchsorted(start, borders))


def blocks(texts: list, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes together; a longer text is a range of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield begin, i
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null counts as empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


#: Text that a task gathers before it combines and sends what it found.
FLUSH_BYTES = 8 << 20


def compressed(docs: DataFrame) -> DataFrame:
    """The columns of docs before the last one, text, and z: the texts compressed with zstandard, for when whole texts must move."""
    import pyarrow as pa

    *names, text = docs.columns
    schema = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)

    def run(batches):
        import zstandard as zs

        pack = zs.ZstdCompressor(level=3).compress
        for b in batches:
            z = pa.array([pack(t) for t in as_bytes(b.column(len(names)))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), z], [*names, "z"])

    return docs.mapInArrow(run, f"{schema}, z binary")


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def flushes(rows: Iterator, limit: int = FLUSH_BYTES) -> Iterator[list]:
    """Lists of rows of about limit bytes of text (their second value) together."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += len(r[1])
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def runs(values: np.ndarray) -> np.ndarray:
    """Borders of runs of equal values: 0, ..., len(values)."""
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)])) if len(values) else np.zeros(1, int)
