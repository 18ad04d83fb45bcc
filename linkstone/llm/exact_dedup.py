"""Exact dedup by skew-safe combining, in DataFrame operations only.

1. Each partition combines its own equal texts (the partial aggregate keyed by
   digest, full text and salt, where the salt is the partition's number modulo
   `salts`).
2. The salted groups are merged, so that a group with a third of all rows meets
   in `salts` tasks and each task gets a row a partition at most.
3. The winners of the salts are combined over all rows.

The full normalised text is part of the key in every stage: equal digests alone
never make two texts equal.  The winners then go back to the rows by digest,
second digest and length, without the text; winners of groups with over 1 / 10,000
of all rows are broadcast (there can't be 10,000 of them), so no group gathers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_heavy


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are one group.  Of equal texts the row with the
    smallest id stays; repeated rows with that id all stay.  Rows without an id
    stay only where no row of the group has one.  An empty table gives an empty
    result.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_norm"))
    keyed = rows.select(
        "doc_id", "_norm", F.sha2("_norm", 256).alias("text_sha256"), F.xxhash64("_norm").alias("_second"), F.octet_length("_norm").alias("_bytes")
    )
    key = ["text_sha256", "_second", "_bytes", "_norm"]
    local = keyed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy(*key, "_salt").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = cut(salted.groupBy(*key).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).drop("_norm"), "winners")
    joined = join_heavy(keyed.drop("_norm"), winners, ["text_sha256", "_second", "_bytes"], "group_size")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of docs whose text is the first of its group, with all their columns."""
    kept = exact_groups(docs, id_col, text_col, salts).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text")).distinct()
    same = docs[id_col].eqNullSafe(kept["_kept_id"]) & (F.sha2(normalised(docs[text_col]), 256) == kept["_kept_text"])
    return docs.join(kept, same, "left_semi")


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Like drop_exact_copies, but of rows with equal ids, or of rows without one, one stays as well: the least by all its contents.

    Such rows are rare: only they are combined with all their columns, the others take the way of drop_exact_copies.
    """
    kept = exact_groups(docs, id_col, text_col, salts).where("kept").groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text")).agg(F.count(F.lit(1)).alias("_kept_rows"))
    kept = cut(kept, "kept")
    same = lambda k: docs[id_col].eqNullSafe(k["_kept_id"]) & (F.sha2(normalised(docs[text_col]), 256) == k["_kept_text"])
    once, ties = kept.where("_kept_rows = 1"), kept.where("_kept_rows > 1")
    single = docs.join(once, same(once), "left_semi")
    if ties.isEmpty():
        return single
    row = F.struct(*(docs[c] for c in docs.columns))
    tied = docs.join(ties, same(ties)).select("_kept_id", "_kept_text", row.alias("_row"))
    least = tied.groupBy("_kept_id", "_kept_text").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return single.unionByName(least.select("_row.*"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
