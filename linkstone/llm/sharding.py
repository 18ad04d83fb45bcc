"""Byte-balanced shards by Karmarkar-Karp differencing over indivisible groups of equal texts.

Items.  A group heavier than total / (shards * fine) is an item of its own; all
other groups fall by hash into shards * fine bundles, each an item.  So there
are at most 2 * shards * fine items at any input size, while no group is cut.

Differencing.  Each item starts as a partial partition (weight, 0, ..., 0).  The
two partial partitions with the largest spread are combined, the heaviest part
of one with the lightest of the other, until one is left.

The item-to-shard table is bounded by the number of items and is broadcast back
to the rows; rows themselves move once, to be numbered within their shard.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bundles a shard. It bounds the differencing task and the broadcast table.
FINE = 1024
#: Blocks a shard in which slots are counted.
SLOT_BLOCKS = 256


def difference(weights: np.ndarray, parts: int) -> np.ndarray:
    """Part of each item, by Karmarkar-Karp differencing; ties are broken by item order."""
    n = len(weights)
    if n == 0:
        return np.empty(0, np.int32)
    sums = {i: np.concatenate((np.zeros(parts - 1, np.int64), [int(w)])) for i, w in enumerate(weights)}
    heap = [(-int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        # sums are kept in ascending order; the lightest part of a meets the heaviest of b
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(total, kind="stable")
        new = n + len(made)
        made.append((a, b, order.astype(np.int16), (parts - 1 - order).astype(np.int16)))
        sums[new] = total = total[order]
        heapq.heappush(heap, (-int(total[-1] - total[0]), new))
    # walk back: place[x][i] is the final part of the i-th lightest part of x
    place = {n + len(made) - 1: np.arange(parts)} if made else {0: np.arange(parts)}
    for k in range(len(made) - 1, -1, -1):
        a, b, of_a, of_b = made[k]
        mine = place.pop(n + k)
        place[a], place[b] = np.empty(parts, np.int64), np.empty(parts, np.int64)
        place[a][of_a], place[b][of_b] = mine, mine
    return np.array([place[i][parts - 1] for i in range(n)], np.int32)


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", fine: int = FINE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Null and empty texts are one group of size 8 a row.  A group of equal texts
    is never cut, so a group heavier than a shard's share fills a shard alone.
    Repeated rows each take a slot.  An empty table gives an empty result.
    Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_group"),  # a collision only joins two groups into one
    )
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_weight"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    bundles = shards * fine
    bundle = F.pmod(F.xxhash64("_group"), F.lit(bundles))
    heavy = F.col("_weight") > total / bundles
    items = (
        groups.select(heavy.alias("_heavy"), F.when(heavy, F.col("_group")).otherwise(bundle).alias("_key"), "_weight")
        .groupBy("_heavy", "_key")
        .agg(F.sum("_weight").alias("_weight"))
    )

    def place(key, pdf):
        pdf = pdf.sort_values(["_weight", "_heavy", "_key"], ascending=[False, True, True], kind="stable")
        return pdf.assign(shard=difference(pdf["_weight"].to_numpy(), shards))[["_heavy", "_key", "shard"]]

    schema = T.StructType([T.StructField("_heavy", T.BooleanType()), T.StructField("_key", T.LongType()), T.StructField("shard", T.IntegerType())])
    from .common import cut

    placed = cut(items.groupBy(F.lit(0).alias("_all")).applyInPandas(place, schema), "shards")
    of_heavy = F.broadcast(placed.where("_heavy").select(F.col("_key").alias("_group"), F.col("shard").alias("_own")))
    of_bundle = F.broadcast(placed.where("NOT _heavy").select(F.col("_key").alias("_bundle"), F.col("shard").alias("_shared")))
    dealt = (
        rows.withColumn("_bundle", bundle)
        .join(of_heavy, "_group", "left")
        .join(of_bundle, "_bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("_own", "_shared").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BLOCKS)).cast("int").alias("_block"))
    )
    counts = dealt.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("shard", "_block", F.expr("sum(_n) OVER (PARTITION BY shard ORDER BY _block) - _n").alias("_before"))
    numbered = dealt.select("*", F.expr("row_number() OVER (PARTITION BY shard, _block ORDER BY doc_id, text_crc32) - 1").alias("_in_block"))
    return numbered.join(F.broadcast(before), ["shard", "_block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_in_block")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
