"""python -m ledgerflow.cli INPUT OUTPUT: HTML filings or page snapshots to Parquet tables and workbooks. Exit 0: done; 2: bad input or a review is needed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ledgerflow import api, sinks
from ledgerflow.paths import checked
from ledgerflow.sources import html, snapshots


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerflow", description=__doc__)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--kind", choices=("html", "pages"), default="html")
    parser.add_argument("--pages", default="auto")
    parser.add_argument("--page-policy", choices=("review", "exact", "suggested"), default="review")
    parser.add_argument("--workbooks", action="store_true")
    parser.add_argument("--allow-nonlocal-paths", action="store_true")
    given = parser.parse_args(arguments)
    try:
        source, target = (checked(p, given.allow_nonlocal_paths) for p in (given.input, given.output))
        spark = spark or SparkSession.builder.appName("ledgerflow").getOrCreate()
        result = api.extract_html(html.load(spark, source)) if given.kind == "html" else api.extract_pages(snapshots.load(spark, source), given.pages, given.page_policy)
        sinks.parquet(result.values, f"{target}/values", "statement_type")
        sinks.parquet(result.checks, f"{target}/checks")
        if given.workbooks:
            sinks.parquet(sinks.workbooks(result.values, result.checks, result.grids), f"{target}/workbooks")
    except ValueError as bad:
        print(f"error: {bad}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
