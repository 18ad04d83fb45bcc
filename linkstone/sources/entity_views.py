"""Entity records for the supplied tables, which have no business names: the same SQL text runs in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_A = "ka le mi no pu ra se ti vo wu xa ye zi bo cu da fe gi ho ju ko la me ni po qu ri so tu va we"
_B = "lan ren tis mor dal ben ker vin sol tam zur fal gor hin jek pas"
_W = f"concat(split_part('{_A}', ' ', CAST(k % 31 + 1 AS INT)), split_part('{_B}', ' ', CAST(floor(k / 31) % 16 + 1 AS INT)), split_part('{_A}', ' ', CAST(floor(k / 7) % 31 + 1 AS INT)))"
_STREET = f"concat(split_part('{_B}', ' ', CAST(floor(k / 5) % 16 + 1 AS INT)), split_part('{_A}', ' ', CAST(floor(k / 11) % 31 + 1 AS INT)))"
_PIN = "CAST(10000 + k * 37 % 90000 AS INT)"

#: Three sources from `part`; {part} is the table.
SYNTHETIC_SQL = f"""
WITH k AS (SELECT p_partkey AS k, p_name AS p, {_W} AS w, {_STREET} AS st, {_PIN} AS pin FROM {{part}}),
r AS (
SELECT concat('S1-', k) AS entity_id,
  concat(w, ' ', p, CASE k % 4 WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' Inc' WHEN 2 THEN ' SARL' ELSE '' END) AS business_name,
  concat(k % 900 + 1, ' ', st, ' Ave, Springfield, ', pin) AS business_address, k, 'S1' AS source, k AS entity FROM k
UNION ALL
SELECT concat('S2-', k),
  CASE WHEN k % 5 = 0 THEN concat('zq', w, 'x') WHEN k % 7 = 0 THEN concat('http://www.', w, replace(p, ' ', ''), '.com')
       WHEN k % 11 = 0 THEN concat(replace(w, 'e', 'é'), ' ', p) ELSE concat(w, ' ', p, ' Pvt. Ltd') END,
  CASE WHEN k % 9 = 0 THEN '' WHEN k % 6 = 0 THEN concat(k % 900 + 1, ' ', upper(st), ' AVENUE, SPRINGFIELD') ELSE concat(k % 900 + 1, ' ', upper(st), ' AVENUE, SPRINGFIELD, ', pin) END,
  k, 'S2', k FROM k WHERE k % 8 <> 5
UNION ALL
SELECT concat('S3-', k),
  CASE WHEN k % 5 = 1 THEN concat(p, ' ', w) ELSE concat(w, ' ', p, ' & Co.') END,
  concat('No. ', k % 900 + 1, '-B, ', st, ' Avenue, ', pin), k, 'S3', k FROM k WHERE k % 4 <> 1)
SELECT entity_id, business_name, business_address, CASE k % 3 WHEN 0 THEN 'France' WHEN 1 THEN 'India' ELSE 'US' END AS country, source, k AS seq, entity FROM r
"""


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("linkstone_part")
    return spark.sql(SYNTHETIC_SQL.format(part="linkstone_part"))


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts: the first half of the words is the name, the second the address."""
    from pyspark.sql import functions as F

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+"), F.lit(0))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", words.alias("w"))
    half = F.expr("CAST((size(w) + 1) DIV 2 AS INT)")
    source = F.concat(F.lit("S"), F.col("doc_id") % 3 + 1)
    return d.select(
        F.concat(source, F.lit("-"), "doc_id").alias("entity_id"), F.array_join(F.slice("w", F.lit(1), half), " ").alias("business_name"),
        F.array_join(F.slice("w", half + 1, F.size("w")), " ").alias("business_address"), F.col("lang").alias("country"), source.alias("source"),
        F.col("doc_id").alias("seq"), F.col("doc_id").alias("entity"),
    )


def synthetic_oracle() -> str:
    return SYNTHETIC_SQL.format(part="part")


def documents_oracle() -> str:
    return r"""
SELECT concat('S', doc_id % 3 + 1, '-', doc_id) AS entity_id, array_to_string(w[1:(len(w) + 1) // 2], ' ') AS business_name, array_to_string(w[(len(w) + 1) // 2 + 1:len(w)], ' ') AS business_address,
  lang AS country, concat('S', doc_id % 3 + 1) AS source, doc_id AS seq, doc_id AS entity
FROM (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents)"""
