"""Rules for the two output files, each as a query; the report is their union: (rule, level, n, examples)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCH_HEADER = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_HEADER = ["source1_entity_id", "candidate_entity_ids"]
_REPORT = "rule string, level string, n long, examples array<string>"


@dataclass
class Parsed:
    header: str | None
    rows: DataFrame
    bad_lines: DataFrame


def parse(spark: SparkSession, path: str) -> Parsed:
    """Rows (s1, ids, seq) of a file, its header, and lines without a tab; blank lines are ignored."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    head = lines.orderBy("seq").limit(1).collect()
    first = F.col("seq") == (head[0]["seq"] if head else -1)
    body = lines.where(~first & (F.trim("value") != ""))
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    ids = F.when(F.trim(cells[1]) == "", F.array().cast("array<string>")).otherwise(F.split(cells[1], ","))
    rows = body.where(F.col("value").contains("\t")).select(cells[0].alias("s1"), ids.alias("ids"), "seq")
    return Parsed(head[0]["value"] if head else None, rows, body.where(~F.col("value").contains("\t")).select("value"))


def _rule(df: DataFrame, what: str, rule: str, level: str = "error") -> DataFrame:
    """The number of offending values, and the five smallest."""
    values = df.select(F.col(what).cast("string").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("_c"))
    n = values.agg(F.count(F.lit(1)).alias("n"))
    few = values.orderBy("v").limit(5).agg(F.sort_array(F.collect_list("v")).alias("examples"))
    return n.withColumn("_k", F.lit(1)).join(few.withColumn("_k", F.lit(1)), "_k").select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), "n", "examples")


def header_fault(header: str | None, expected: list[str]) -> str | None:
    if header is None:
        return "empty_file"
    if "\t" not in header and "," in header:
        return "comma_header"
    return None if [h.strip().lower() for h in header.rstrip("\r\n").split("\t")] == expected else "wrong_header"


def list_rules(rows: DataFrame, required: DataFrame, valid_ids: DataFrame | None = None) -> DataFrame:
    """Rules on (s1, ids): required has the s1 ids that must occur, valid_ids the known targets."""
    each = rows.select("s1", F.explode("ids").alias("id"))
    need, seen = required.select(F.trim("s1").alias("s1")).distinct(), rows.select("s1").distinct()
    own = F.col("id").startswith("S1-")
    parts = [
        _rule(rows.groupBy("s1").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "s1", "duplicate_query"),
        _rule(rows.where(F.size("ids") != F.size(F.array_distinct("ids"))), "s1", "repeated_id"),
        _rule(each.where(own), "s1", "self_match"),
        _rule(each.where(~own & ~F.col("id").startswith("S2-") & ~F.col("id").startswith("S3-")), "id", "bad_prefix"),
        _rule(need.join(seen, "s1", "left_anti"), "s1", "missing_query"),
        _rule(seen.join(need, "s1", "left_anti"), "s1", "extra_query"),
    ]
    if valid_ids is not None:
        known = valid_ids.select(F.col("entity_id").alias("id")).distinct()
        parts.append(_rule(each.where(F.col("id").startswith("S2-") | F.col("id").startswith("S3-")).join(known, "id", "left_anti"), "id", "unknown_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts(rows: DataFrame) -> DataFrame:
    """One row: all rows, those with an empty list and those with ids."""
    empty = F.size("ids") == 0
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(empty).alias("n_empty"), F.count_if(~empty).alias("n_filled"))


def last_of_each(rows: DataFrame) -> DataFrame:
    """Of repeated queries, the last row counts."""
    return rows.groupBy("s1").agg(F.max_by("ids", "seq").alias("ids"))


def subset_rule(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    pairs = lambda rows: last_of_each(rows).select("s1", F.explode("ids").alias("id")).distinct()
    return _rule(pairs(matches).join(pairs(candidates), ["s1", "id"], "left_anti"), "s1", "match_outside_candidates", "warning")


def validate(spark: SparkSession, matching: str, candidate: str | None, required: DataFrame, valid_ids: DataFrame | None = None) -> DataFrame:
    """The report of both files; only rules with n > 0 are in it. A missing matching file is an error, a missing candidate file a warning."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()

    def exists(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    note = lambda rule, level: spark.createDataFrame([(rule, level, 1, [])], _REPORT)
    if not exists(matching):
        return note("missing_file", "error")
    m, parts = parse(spark, matching), []
    fault = header_fault(m.header, MATCH_HEADER)
    if fault:
        return note(fault, "error")
    undecodable = spark.read.text(matching).where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("path"))
    parts += [_rule(undecodable, "path", "not_utf8"), _rule(m.bad_lines, "value", "line_without_tab"), list_rules(m.rows, required, valid_ids)]
    if valid_ids is None:
        parts.append(note("ids_unchecked", "warning"))
    if candidate is None or not exists(candidate):
        parts.append(note("no_candidate_file", "warning"))
    else:
        c = parse(spark, candidate)
        fault = header_fault(c.header, CANDIDATE_HEADER)
        parts.append(note("candidate_" + fault, "error") if fault else _rule(c.bad_lines, "value", "candidate_line_without_tab").unionByName(list_rules(c.rows, required, valid_ids).withColumn("rule", F.concat(F.lit("candidate_"), "rule"))).unionByName(subset_rule(m.rows, c.rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


def passes(report: DataFrame) -> bool:
    return report.where("level = 'error' AND n > 0").isEmpty()
