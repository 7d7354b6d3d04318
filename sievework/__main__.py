"""Command line: `extract PATH --url URL` prints records as JSON lines, `query NAME FOLDER OUT` writes a query's rows."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def extract(spark: SparkSession, args: argparse.Namespace) -> int:
    from .operators.extraction import processed, record_rows
    from .sources.readers import html_files

    pages = html_files(spark, args.path, args.url).select(F.lit(0).alias("page_id"), "url", "html", F.lit(200).alias("status"))
    overlay = json.dumps(json.load(open(args.overlay))) if args.overlay else None
    hosts = pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).distinct().withColumn("overlay", F.lit(overlay)) if overlay else None
    rows = record_rows(processed(pages, hosts))
    found = 0
    for line in rows.toJSON().toLocalIterator():
        print(line)
        found += 1
    return 0 if found else 1


def query(spark: SparkSession, args: argparse.Namespace) -> int:
    from .plans import catalogue

    catalogue.QUERIES[args.name](spark, args.folder).write.mode("overwrite").parquet(args.out)
    return 0


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="sievework")
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("extract", help="records of HTML files")
    one.add_argument("path")
    one.add_argument("--url")
    one.add_argument("--overlay", help="a JSON file of selectors")
    one.set_defaults(run=extract)
    two = commands.add_parser("query", help="a registered query over a folder of tables")
    for name in ("name", "folder", "out"):
        two.add_argument(name)
    two.set_defaults(run=query)
    args = parser.parse_args(argv)
    return args.run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
