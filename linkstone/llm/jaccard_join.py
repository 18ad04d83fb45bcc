"""Exact Jaccard join of documents by pivots and regions of the Jaccard metric.

Documents are sets of distinct shingles of `shingle` words; two link when their
Jaccard distance is at most EPS = 1 - percent / 100 (100 * intersection >=
percent * union).  SHINGLE and PERCENT, 4 and 85, are those of op9_jaccard_join.

1. Equal sets are one class; from then on a class stands for its documents.
2. Groups.  Documents without a common shingle are at distance 1, and so are most
   pairs; no pivot tells them apart.  By the threshold, linked documents share
   one of the first n - ceil((1 - EPS) n) + 1 shingles in any global order; the
   order is by rarity, from a sketch of counts over all documents.  Those that
   meet at such a shingle are a group, named after its smallest fingerprint.
3. Regions.  Every group is joined by document pivots.  A member belongs to its
   nearest pivot and, by the triangle inequality, to each pivot no more than
   2 * EPS farther away, so linked members meet in the home region of either.
   The empty set is a pivot, too, at distance 1 from all: members at least
   1 - EPS away from every other pivot are its own, and those at least
   1 - 2 * EPS away are replicated to it.  Members within EPS of a pivot are
   linked to it.  Each region is joined in the same way, until it is a LEAF.
   Regions whose windows replicate them instead of splitting them (all members
   within a few EPS) are compared directly.
4. A task joins groups and regions of up to `capacity` members; larger ones are
   dealt to pivots as tables, tile by tile.  The result is a spanning forest, not
   pairs, and each of its links is checked word by word.
5. Links of all regions are contracted by alternating stars, as tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, add_in_tree, arrow_type, as_bytes, blocks, cut, drop, flushes, hash_words, join_heavy, mix, runs, total_bytes, window_hashes, word_hashes
from .substring_dedup import group_of, pack5, unpack5

SHINGLE, PERCENT = 4, 85
#: Counters of the rarity sketch: its size is fixed, whatever the corpus.
SKETCH = 1 << 21
CHUNKS = 32
GROUP_BYTES = 64 << 20
LOW = np.uint64((1 << 40) - 1)


def linked(inter: np.ndarray, a, b, percent: int = PERCENT) -> np.ndarray:
    return (100 * inter >= percent * (a + b - inter)) & (inter > 0)


def sets_of(texts: list[bytes], shingle: int = SHINGLE, second: bool = False) -> list:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle count as one. second: with the hashes of the other lane."""
    out = []
    for begin, end in blocks(texts):
        w = hash_words(texts[begin:end], NOT_SPACE, lower=True)
        n, owner = np.diff(w.first), w.owner()
        lanes = [w.hash, word_hashes(w.data, w.start, w.end, 1)][: 1 + second]
        hs = [window_hashes(x, shingle, k) for k, x in enumerate(lanes)]
        own = owner[: len(hs[0])]
        ok = np.flatnonzero(own == owner[shingle - 1 :]) if len(own) else np.empty(0, int)
        own, hs = own[ok], [h[ok] for h in hs]
        short = np.flatnonzero((n > 0) & (n < shingle)).tolist()
        if short:
            own = np.concatenate((own, short))
            hs = [np.concatenate((h, np.array([window_hashes(x[w.first[d] : w.first[d + 1]], int(n[d]), k)[0] for d in short], np.uint64))) for k, (h, x) in enumerate(zip(hs, lanes, strict=True))]
        order = np.lexsort((hs[0], own))
        own, hs = own[order], [h[order] for h in hs]
        new = np.concatenate(([True], (hs[0][1:] != hs[0][:-1]) | (own[1:] != own[:-1]))) if len(own) else np.empty(0, bool)
        own, hs = own[new], [h[new] for h in hs]
        at = np.searchsorted(own, np.arange(end - begin + 1)).tolist()
        out += [tuple(h[a:b] for h in hs) if second else hs[0][a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def words_of(text: bytes, shingle: int) -> set[bytes]:
    """The shingles themselves."""
    w = text.translate(LOWER.tobytes()).split()
    return {b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def fingerprint(s: np.ndarray) -> int:
    """Of a set of shingles, as a signed 64-bit number."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _rows_of(batches):
    """(first columns, text) of each row, where text is the last column."""
    for b in batches:
        *before, text = (b.column(i) for i in range(b.num_columns))
        yield from zip(zip(*(c.to_pylist() for c in before), strict=True), as_bytes(text), strict=True)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tk, text: rows with one doc_id are told apart by their texts' key."""
    return docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")


def survey(docs: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, tk, n, fp, tw) of every row, and the sketch of document counts of all shingles; one scan.

    fp and tw are independent 64-bit fingerprints of the set.  The sketches of
    the partitions are added in a tree.
    """
    kind, name = arrow_type(docs, "doc_id"), docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "tk", "n", "fp", "tw", "part", "chunk", "counts"]

    def run(batches):
        import zstandard as zs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        count = np.zeros(SKETCH, np.int32)
        for rows in flushes(_rows_of(batches)):
            sets = sets_of([t for _, t in rows], shingle, second=True)
            count += np.bincount((np.concatenate([s[0] for s in sets]) >> np.uint64(40)) % np.uint64(SKETCH), minlength=SKETCH).astype(np.int32)
            numbers = ([r[0][1] for r in rows], [len(s[0]) for s in sets], [fingerprint(s[0]) for s in sets], [fingerprint(s[1]) for s in sets])
            none = [pa.nulls(len(rows), pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], kind), *(pa.array(x, pa.int64()) for x in numbers), *none, pa.nulls(len(rows), pa.binary())], names)
        pack, size = zs.ZstdCompressor(level=3).compress, SKETCH // CHUNKS
        if count.any():
            pieces = pa.array([pack(count[i * size : (i + 1) * size].astype(np.int64).tobytes()) for i in range(CHUNKS)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, kind), *[pa.nulls(CHUNKS, pa.int64())] * 4, pa.array([part] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pieces], names)

    both = cut(_keyed(docs).mapInArrow(run, f"doc_id {name}, tk long, n long, fp long, tw long, part int, chunk int, counts binary"), "survey")

    sketch, size = np.zeros(SKETCH, np.int32), SKETCH // CHUNKS
    for chunk, total in add_in_tree(both.where("chunk IS NOT NULL").select("part", "chunk", F.col("counts").alias("value")), "<i8").items():
        sketch[chunk * size : (chunk + 1) * size] = np.minimum(total, np.iinfo(np.int32).max)
    return both.where("chunk IS NULL").select("doc_id", "tk", "n", "fp", "tw"), sketch


#: Documents at a slot of the sketch, above the mean of all, from which its shingles are met as tables.
HOT = 1 << 14


def first_regions(docs: DataFrame, sketch: np.ndarray, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(region, fp, n), distinct: the classes that meet at a shingle, by the smallest fingerprint there.

    Shingles of over HOT documents don't meet in one task: their rows are joined
    with the smallest fingerprint of each, which is a partial aggregate.
    """
    groups = 16 + total_bytes(docs) // GROUP_BYTES
    hot_from = HOT + int(sketch.mean())
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    names = ["q", "hot", "least", "most", "fp", "n", "counts", "h"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]

    def run(batches):
        often = shared.value
        for rows in flushes(_rows_of(batches)):
            classes = {}
            for s in sets_of([t for d, t in rows if d[0] is not None], shingle):
                if len(s):
                    classes.setdefault(fingerprint(s), s)
            hs, which, counts = [], [], []
            for k, s in enumerate(classes.values()):
                n = len(s)
                first = n - -(-percent * n // 100) + 1
                c = often[(s >> np.uint64(40)) % np.uint64(SKETCH)]
                order = np.lexsort((s, c))[:first]
                hs.append(s[order])
                counts.append(c[order])
                which.append(np.full(first, k))
            if not hs:
                continue
            h, which, hot = np.concatenate(hs), np.concatenate(which), np.concatenate(counts) > hot_from
            fps, sizes = np.array(list(classes), np.int64), np.array([len(s) for s in classes.values()], np.int32)
            q = group_of(h, groups)
            order = np.lexsort((which, np.where(hot, h, q.view(np.uint64)), hot))
            q, h, which, hot = q[order], h[order], which[order], hot[order]
            cold, out = int((~hot).sum()), []
            at = runs(q[:cold])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                r = runs(which[a:b])
                own = which[a:b][r[:-1]]
                out.append((int(q[a]), None, None, None, fps[own].tobytes(), sizes[own].tobytes(), np.diff(r).astype("<i4").tobytes(), pack5(h[a:b] & LOW)))
            at = cold + runs(h[cold:])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = which[a:b]
                out.append((None, int(h[a].view(np.int64)), int(fps[own].min()), int(fps[own].max()), fps[own].tobytes(), sizes[own].tobytes(), None, None))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    def meet(pdf):
        fp, n, counts = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("fp", "<i8"), ("n", "<i4"), ("counts", "<i4")))
        fp, n, h = np.repeat(fp, counts), np.repeat(n, counts), unpack5(b"".join(pdf["h"]))
        order = np.lexsort((n, h))
        h, fp, n = h[order], fp[order], n[order].astype(np.int64)
        # members of a shingle in order of size: no link crosses a gap in which even a subset is too small
        gap = (h[1:] != h[:-1]) | (100 * n[:-1] < percent * n[1:])
        at = np.concatenate(([0], np.flatnonzero(gap) + 1, [len(h)]))
        pivot = np.repeat(np.minimum.reduceat(fp, at[:-1]), np.diff(at))
        top = np.repeat(np.maximum.reduceat(fp, at[:-1]), np.diff(at))
        many = pivot != top
        return pd.DataFrame({"region": pivot[many], "fp": fp[many], "n": n[many]}).drop_duplicates()

    def spread(frames):
        for pdf in frames:
            size = [len(x) // 8 for x in pdf["fp"]]
            fp, n = np.frombuffer(b"".join(pdf["fp"]), "<i8"), np.frombuffer(b"".join(pdf["n"]), "<i4")
            yield pd.DataFrame({"region": np.repeat(pdf["region"].to_numpy(), size), "fp": fp, "n": n.astype(np.int64)}).drop_duplicates()

    packed = cut(_keyed(docs).mapInArrow(run, "q int, hot long, least long, most long, fp binary, n binary, counts binary, h binary"), "prefixes")
    met = packed.where("hot IS NULL").select("q", "fp", "n", "counts", "h").groupBy("q").applyInPandas(meet, "region long, fp long, n long")
    hot = packed.where("hot IS NOT NULL").select("hot", "fp", "n")
    names_of = packed.where("hot IS NOT NULL").groupBy("hot").agg(F.min("least").alias("region"), F.max("most").alias("_most")).where("region <> _most").drop("_most")
    out = cut(met.unionByName(hot.join(names_of, "hot").select("region", "fp", "n").mapInPandas(spread, "region long, fp long, n long")).distinct(), "assigned")
    drop(packed)
    return out


class Inverted:
    """Sets of one region, by shingle; shingles of a single set are left out."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        at = runs(h)
        keep = np.repeat(np.diff(at) > 1, np.diff(at))
        self.owner = owner[keep]
        at = runs(h[keep])
        self.first, self.count = at[:-1], np.diff(at)
        shingle = np.repeat(np.arange(len(self.count)), self.count)
        back = np.argsort(self.owner, kind="stable")
        self.shingles = np.split(shingle[back], np.searchsorted(self.owner[back], np.arange(1, len(sets))))

    def shared(self, i: int) -> np.ndarray:
        """Size of the intersection of set i with each set."""
        s = self.shingles[i]
        n = self.count[s]
        entry = np.repeat(self.first[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.bincount(self.owner[entry], minlength=len(self.size))


#: Members that are compared directly.
LEAF = 12


def cells(distance: np.ndarray, percent: int) -> np.ndarray:
    """Which members (rows) belong to each pivot's region; the last column is the region of the empty set."""
    eps, slack = 1 - percent / 100, 1e-9
    least = distance.min(axis=1)
    own = (distance <= least[:, None] + 2 * eps + slack) & (least < 1 - eps - slack)[:, None]
    return np.column_stack([own, least >= 1 - 2 * eps - slack])


def forest(sets: list[np.ndarray], same, skip: np.ndarray | None = None, pivots: int = 8, growth: float = 2.0, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges that connect what is linked, by regions of pivots.

    same(i, j) checks a link exactly.  skip marks members that are already connected with each other.
    """
    index = Inverted(sets)
    label, edges = np.arange(len(sets)), []
    if skip is not None and skip.any():
        label[skip] = np.flatnonzero(skip)[0]

    def meet(i: int, inter: np.ndarray, members: np.ndarray) -> None:
        near = members[linked(inter[members], index.size[members], index.size[i], percent) & (label[members] != label[i])]
        for j in near.tolist():
            if label[j] != label[i] and same(i, j):
                edges.append((i, j))
                label[label == label[j]] = label[i]

    def compare(members: np.ndarray) -> None:
        for i in members.tolist():
            if len(index.shingles[i]) and (label[members] != label[i]).any():
                meet(i, index.shared(i), members)

    todo = [np.arange(len(sets))]
    while todo:
        members = todo.pop()
        if (label[members] == label[members[0]]).all():
            continue
        if len(members) <= LEAF:
            compare(members)
            continue
        distance, least = [], np.full(len(members), 2.0)
        for _ in range(pivots):  # each pivot is the member farthest from the others
            at = int(least.argmax())
            if least[at] <= 1 - percent / 100:
                break
            i = int(members[at])
            inter = index.shared(i)
            distance.append(1 - inter[members] / (index.size[members] + index.size[i] - inter[members]))
            distance[-1][at] = 0.0
            least = np.minimum(least, distance[-1])
            meet(i, inter, members)
        regions = cells(np.column_stack(distance), percent)
        if regions.sum() > growth * len(members) or regions.sum(axis=0).max() > 0.9 * len(members):
            compare(members)
        else:
            todo += [members[own] for own in regions.T if own.sum() > 1]
    return edges


_MEMBER = "region long, rep long, n long, z binary, ball boolean"


def _texts(blobs) -> list[bytes]:
    import zstandard as zs

    unpack = zs.ZstdDecompressor().decompress
    return [unpack(z) for z in blobs]


class Exact:
    """Checks links word by word."""

    def __init__(self, texts: list[bytes], shingle: int, percent: int):
        self.texts, self.shingle, self.percent, self.known = texts, shingle, percent, {}

    def words(self, i: int) -> set[bytes]:
        if i not in self.known:
            if len(self.known) >= 64:
                self.known.clear()
            self.known[i] = words_of(self.texts[i], self.shingle)
        return self.known[i]

    def __call__(self, i: int, j: int) -> bool:
        a, b = self.words(i), self.words(j)
        inter = len(a & b)
        return bool(inter) and 100 * inter >= self.percent * (len(a) + len(b) - inter)


def solve(members: DataFrame, weight: int = 1_000_000, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): a spanning forest of the links in each region that fits in a task; a task gets regions of about weight shingles together."""
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def run(pdf):
        pdf = pdf.drop_duplicates(["region", "rep", "ball"]).sort_values(["region", "rep"], kind="stable")
        rep, ball, out = pdf["rep"].to_numpy(), pdf["ball"].to_numpy(bool), []
        at = runs(pdf["region"].to_numpy())
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            texts = _texts(pdf["z"].iloc[a:b])
            out += [(rep[a + i], rep[a + j]) for i, j in forest(sets_of(texts, shingle), Exact(texts, shingle, percent), ball[a:b], percent=percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    task = F.pmod(F.xxhash64("region"), F.lit(1 + int(total // weight)))
    return members.withColumn("_task", task).groupBy("_task").applyInPandas(run, "a long, b long")


def voronoi(members: DataFrame, sizes: DataFrame, pivots: int, turn: int, tile: int, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Members of the regions in sizes dealt to pivots, with replicas inside the windows (pivot null); and their links to pivots (region null).

    The pivots of a region are the least of `pivots` classes of a hash, which is
    a partial aggregate; tiles of a region's members meet its pivots.
    """
    regions = cut(sizes.select("region", "members", F.greatest(F.ceil(F.col("members") / tile), F.ceil(F.col("shingles") / 1_000_000)).cast("int").alias("_tiles")), "tiles")
    some = join_heavy(members.select("rep", "region", "n", "z"), regions, ["region"], "members").where("members IS NOT NULL")
    some = cut(some.withColumn("_tile", F.pmod(F.xxhash64("rep"), "_tiles").cast("int")).drop("members"), "tiled")
    rank = F.xxhash64("rep", F.lit(turn))
    chosen = some.groupBy("region", F.pmod(rank, F.lit(pivots)).alias("_k")).agg(F.min(F.struct(rank.alias("r"), "rep")).alias("_p")).select("region", F.col("_p.rep").alias("rep"))
    again = some.sparkSession.read.schema(some.schema).parquet(some._shared_path)  # a table of its own, for the planner
    centres = again.join(chosen, ["region", "rep"]).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))

    columns = {"region": "Int64", "rep": "int64", "n": "int64", "z": "object", "ball": "boolean", "pivot": "Int64", "parent": "int64"}

    def deal(key, left, right):
        if not len(left):  # a tile without members
            return pd.DataFrame(columns=list(columns)).astype(columns)
        right = right.sort_values("rep")
        texts, centre = _texts(left["z"]), _texts(right["z"])
        sets, names, exact = sets_of(texts, shingle), right["rep"].tolist(), Exact([*centre, *texts], shingle, percent)
        size, every = np.array([len(s) for s in sets]), np.concatenate(sets)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        distance = []
        for p in sets_of(centre, shingle):
            inter = np.add.reduceat(np.isin(every, p).astype(np.int64), first)
            distance.append(1 - inter / (size + len(p) - inter))
        distance = np.column_stack(distance)
        out, region = [], np.array([key[0]], np.int64).view(np.uint64)
        label = lambda k: int(mix(region * np.uint64(31) + np.uint64(turn * 1009 + k + 1)).view(np.int64)[0])
        reps, ns, blobs = left["rep"].tolist(), left["n"].tolist(), left["z"].tolist()
        # a member that is linked with a pivot is in its ball
        balls = np.array([[names[k] == reps[i] or (distance[i, k] <= 1 - percent / 100 + 1e-9 and exact(k, len(names) + i)) for k in range(len(names))] for i in range(len(reps))])
        for k, own in enumerate(cells(distance, percent).T):
            out += [(label(k), reps[i], ns[i], blobs[i], bool(k < len(names) and balls[i, k]), None, key[0]) for i in np.flatnonzero(own).tolist()]
        out += [(None, reps[i], ns[i], None, None, names[k], key[0]) for i, k in np.argwhere(balls).tolist() if names[k] != reps[i]]
        # column by column: a frame of tuples would turn numbers beside nulls into floating point, and round them
        return pd.DataFrame({name: pd.array([r[i] for r in out], dtype=kind) for i, (name, kind) in enumerate(columns.items())})

    dealt = cut(some.groupBy("region", "_tile").cogroup(centres.groupBy("region", "_tile")).applyInPandas(deal, _MEMBER + ", pivot long, parent long"), "regions")
    drop(some)
    drop(regions)
    return dealt


def tiles(members: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """Regions that don't split any more, as blocks: those outside the ball against all, tile by tile."""
    some = sizes.select("region", "members", F.greatest(F.lit(1), F.ceil(F.col("members") / tile)).cast("int").alias("_all"), F.greatest(F.lit(1), F.ceil(F.col("outside") / tile)).cast("int").alias("_out"))
    rows = join_heavy(members.select("rep", "region", "n", "z", "ball"), some, ["region"], "members").where("members IS NOT NULL").withColumn("_h", F.xxhash64("rep"))
    as_any = rows.withColumn("_i", F.pmod("_h", "_all")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_out") - 1)))
    as_out = rows.where("NOT ball").withColumn("_j", F.pmod("_h", "_out")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_all") - 1)))
    columns = [F.xxhash64("region", "_i", "_j").alias("region"), "rep", "n", "z", "ball"]
    as_any, as_out = (x.withColumns({"_i": F.col("_i").cast("long"), "_j": F.col("_j").cast("long")}).select(*columns) for x in (as_any, as_out))
    return as_any.unionByName(as_out)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids with links: the smallest id that links lead to, by alternating large and small stars.

    A hub's edges are spread by join_heavy.  The result is a table that cut() wrote.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    n = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("k")), "least")
        large = cut(join_heavy(both.where("v > u").select("v", "u"), least, ["u"], "k", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        drop(least)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")), "least")
        small = join_heavy(large.select("v", "u"), least, ["u"], "k", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(small.distinct(), "edges")
        for table in (least, large):
            drop(table)
        m = after.count()
        same = n == m and edges.join(after, ["u", "v"], "left_anti").isEmpty()
        drop(edges)
        edges, n = after, m
        if same:
            stars = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
            out = cut(stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
            drop(edges)
            return out


#: Bits of the filter through which texts pass that are wanted: its size is fixed, whatever the corpus.
SLOTS = 1 << 25


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, tk, z: compressed texts of all rows whose (doc_id, tk) is in wanted, and of the few others that share a bit with one.

    Each wanted key sets a bit; texts without one stay where they are.
    """
    slot = F.pmod(F.xxhash64("doc_id", "tk"), F.lit(SLOTS)).cast("int").alias("slot")
    size = SLOTS // 8 // CHUNKS

    def mark(batches):
        import zstandard as zs
        from pyspark import TaskContext

        bits = np.zeros(SLOTS, bool)
        for b in batches:
            bits[b.column(0).to_numpy()] = True
        if bits.any():
            packed, pack = np.packbits(bits), zs.ZstdCompressor(level=1).compress
            values = [pack(packed[i * size : (i + 1) * size].tobytes()) for i in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array(values, pa.binary())], ["part", "chunk", "value"])

    pieces = cut(wanted.select(slot).mapInArrow(mark, "part int, chunk int, value binary"), "bits")
    bitmap = np.zeros(SLOTS // 8, np.uint8)
    for chunk, value in add_in_tree(pieces, "u1", add_up=np.bitwise_or).items():
        bitmap[chunk * size : (chunk + 1) * size] = value
    drop(pieces)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def pick(batches):
        import zstandard as zs

        pack = zs.ZstdCompressor(level=3).compress
        for b in batches:
            at = b.column(2).to_numpy()
            some = b.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([pack(t) for t in as_bytes(some.column(3))], pa.binary())], ["doc_id", "tk", "z"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).select("doc_id", "tk", slot, "text").mapInArrow(pick, f"doc_id {kind}, tk long, z binary")


def links(docs: DataFrame, classes: DataFrame, sketch: np.ndarray, capacity: int = 4096, weight: int = 4_000_000, pivots: int = 16, growth: float = 2.0, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): numbers of classes whose links connect the same components as all links do.

    capacity, weight: members and shingles of a region that one task joins.
    """
    assigned = first_regions(docs, sketch, shingle, percent)
    wanted = assigned.join(classes, ["fp", "n"]).select("region", "rep", "n", "doc_id", "tk")
    wanted = cut(wanted, "wanted")
    texts = texts_of(docs, wanted).dropDuplicates(["doc_id", "tk"])
    members = cut(wanted.join(texts, ["doc_id", "tk"]).select("region", "rep", "n", "z", F.lit(False).alias("ball")), "members")
    found, used, turn = [], [assigned, wanted, members], 0
    while True:
        sizes = cut(members.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.count_if(~F.col("ball")).alias("outside")), "sizes")
        used.append(sizes)
        fits = (F.col("members") <= capacity) & (F.col("shingles") <= weight)
        live = sizes.where("members > 1 AND outside > 0")
        found.append(cut(solve(members.join(live.where(fits).select("region"), "region", "left_semi"), shingle=shingle, percent=percent), "links"))
        large = live.where(~fits)
        if large.isEmpty():
            break
        dealt = voronoi(members, large, pivots, turn, capacity // 2, shingle, percent)
        used.append(dealt)
        found.append(dealt.where("region IS NULL").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        turn += 1
        after = dealt.where("region IS NOT NULL").groupBy("parent", "region").agg(F.count(F.lit(1)).alias("n")).groupBy("parent").agg(F.sum("n").alias("after"), F.max("n").alias("most"))
        stuck = large.join(after, large["region"] == after["parent"]).where((F.col("after") > growth * F.col("members")) | (F.col("most") > 0.9 * F.col("members")))
        stuck = cut(stuck.select("region", "members", "outside"), "stuck")
        used.append(stuck)
        if not stuck.isEmpty():
            found.append(cut(solve(tiles(members, stuck, capacity // 2), shingle=shingle, percent=percent), "links"))
        members = dealt.where("region IS NOT NULL").join(stuck.select(F.col("region").alias("parent")), "parent", "left_anti").drop("parent", "pivot")
    edges = found[0]
    for e in found[1:]:
        edges = edges.unionByName(e)
    edges = cut(edges, "forest")
    for table in [*used, *found]:
        drop(table)
    return edges


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, **how) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Null and empty texts have no shingles and are linked with nothing: their
    component is their own id.  Rows without an id have no component.  Repeated
    rows are in one component; rows with one doc_id and different texts are
    documents of their own.  doc_id may be of any type with an order.  Other
    columns are ignored.  Sets are taken as equal by their size and two
    independent 64-bit fingerprints.
    """
    info, sketch = survey(docs, shingle)
    some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    first = info.where(some).groupBy("fp", "tw", "n").agg(F.min(F.struct("doc_id", "tk")).alias("_first"), F.count(F.lit(1)).alias("rows"))
    classes = cut(first.select("fp", "tw", "n", "rows", F.col("_first.doc_id").alias("doc_id"), F.col("_first.tk").alias("tk"), F.monotonically_increasing_id().alias("rep")), "classes")
    forest_of = links(docs, classes, sketch, shingle=shingle, percent=percent, **how)
    of_rep = components(forest_of)
    drop(forest_of)
    least = of_rep.join(classes.select(F.col("rep").alias("id"), "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_k"))
    least = cut(least, "least")
    named = join_heavy(of_rep, least, ["component"], "_k").select(F.col("id").alias("rep"), "_least")
    named = cut(classes.join(named, "rep", "left").select("fp", "tw", "n", "rows", F.coalesce("_least", "doc_id").alias("_component")), "named")
    for table in (of_rep, least, classes):
        drop(table)
    joined = join_heavy(info.where(some), named, ["fp", "tw", "n"], "rows").select("doc_id", F.col("n").alias("n_shingles"), F.col("_component").alias("component_id"))
    return joined.unionByName(info.where(~some).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, **how) -> DataFrame:
    """The rows of docs with the smallest id of their component (and those without an id), with all their columns."""
    gone = near_duplicates(docs, shingle, percent, **how).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
