"""python -m linkstone.check_lists MATCHING --candidate FILE --source S1_FILE --targets FILE ...

Prints counts and the report of the output files; ends with 0 if no error was found, else with 1.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from linkstone.operators import validation
from linkstone.sources import tsv


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = argparse.ArgumentParser(prog="linkstone.check_lists")
    args.add_argument("matching")
    args.add_argument("--candidate")
    args.add_argument("--source", required=True, help="records whose ids must occur")
    args.add_argument("--targets", nargs="*", default=[], help="records whose ids may be named; without any, ids aren't looked up")
    a = args.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    known = None
    for path in a.targets:
        ids = tsv.read_ids(spark, path)
        known = ids if known is None else known.unionByName(ids)
    required = tsv.read_ids(spark, a.source).withColumnRenamed("entity_id", "s1")
    report = validation.validate(spark, a.matching, a.candidate, required, known).collect()  # a row for each rule
    if not any(r["rule"] in ("missing_file", "empty_file") for r in report):
        n = validation.counts(validation.parse(spark, a.matching).rows).first()
        print(f"{n['n_rows']} rows, {n['n_empty']} empty, {n['n_filled']} with ids")
    for r in report:
        print(f"{r['level']}: {r['rule']}: {r['n']}" + (f" ({', '.join(r['examples'])})" if r["examples"] else ""))
    failed = any(r["level"] == "error" for r in report)
    print("FAIL" if failed else "PASS")
    return int(failed)


if __name__ == "__main__":
    raise SystemExit(main())
