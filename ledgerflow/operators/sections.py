"""Ordered-state operators over lines: statement sections, carried contexts, runs of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.fixed_values import OPENING_CAPTIONS, SECTION_HINTS
from ledgerflow.functions.lines import TITLE_KEYS
from ledgerflow.functions.text import normalize, straight_quotes, title_label


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


_ISSUER = r"^[A-Z0-9][\w&.,'’()-]*(?:\s+(?:[A-Z0-9][\w&.,'’()-]*|&|and|of|the)){0,11}\s+(?i:and\s+(?:its\s+)?subsidiaries)\s+(?=(?i:(?:condensed\s+)?consolidated)\b)"


def heading_type(line: Column) -> Column:
    """The statement whose title this line is, standing alone: an equality, not a mention."""
    bare = F.regexp_replace(normalize(line), r"(?i)^(?:unaudited|audited)\s+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\s*\((?:unaudited|audited|continued)\)\s*\.?\s*$", ""), _ISSUER, "")
    return _lookup(TITLE_KEYS, title_label(bare))


def caption_of(line: Column) -> Column:
    return straight_quotes(F.regexp_replace(F.upper(normalize(line)), r":+$", ""))


def context_of(line: Column) -> Column:
    """The context that a line sets, else null."""
    own = caption_of(line)
    cash = F.concat(F.nullif(F.regexp_extract(own, r"^CASH FLOWS FROM (OPERATING|INVESTING|FINANCING) ACTIVITIES", 1), F.lit("")), F.lit("_ACTIVITY"))
    both = F.when(own.contains("LIABILITIES AND") & (own.contains("EQUITY") | own.contains("CAPITAL")), "LIABILITY_EQUITY")
    return F.coalesce(_lookup(SECTION_HINTS, own), cash, both)


def carried(value: Column, partition: list[str], order: list[str], start: Column | None = None) -> Column:
    """The last value that isn't null up to this row."""
    last = F.last(value, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return last if start is None else F.coalesce(last, start)


def sections(lines: DataFrame, document: str = "doc_id") -> DataFrame:
    """lines with statement_type, without blank lines and lines before any statement.

    A title (or a hint that the line carries) opens a statement until the next one. Before any title, the first caption that only one statement has opens it.
    """
    hint = F.col("statement_type_hint") if "statement_type_hint" in lines.columns else F.lit(None).cast("string")
    order = ["source_page", "line_no"]
    running = Window.partitionBy(document).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lines.filter(normalize(F.col("raw_text")) != "").withColumn("_title", F.coalesce(hint, heading_type(F.col("raw_text")))).withColumn("_opens", _lookup(OPENING_CAPTIONS, caption_of(F.col("raw_text"))))
    return seen.withColumn("statement_type", F.coalesce(F.last("_title", ignorenulls=True).over(running), F.first("_opens", ignorenulls=True).over(running))).filter("statement_type IS NOT NULL").drop("_title", "_opens")


def runs(numbers: DataFrame, partition: list[str], number: str) -> DataFrame:
    """Gaps and islands: one row for each run of consecutive numbers, first and last and their count; repeated numbers count once."""
    own = numbers.select(*partition, number).distinct()
    islands = own.withColumn("_island", F.col(number) - F.row_number().over(Window.partitionBy(*partition).orderBy(number)))
    return islands.groupBy(*partition, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_island")


def page_ranges(numbers: DataFrame, partition: list[str], number: str) -> DataFrame:
    """partition, ranges: 1-3,7."""
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    each = runs(numbers, partition, number).select(*partition, F.struct("first", text.alias("text")).alias("run"))
    return each.groupBy(*partition).agg(F.array_join(F.transform(F.array_sort(F.collect_list("run")), lambda r: r["text"]), ",").alias("ranges"))


def best_runs(candidates: DataFrame, partition: list[str], number: str, weight: str) -> DataFrame:
    """Of the runs of consecutive numbers in each partition the one with the most weight, the earliest of equals."""
    islands = candidates.withColumn("_island", F.col(number) - F.row_number().over(Window.partitionBy(*partition).orderBy(number)))
    summed = islands.groupBy(*partition, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.sum(weight).alias("weight"))
    best = F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc("weight"), "first"))
    return summed.withColumn("_best", best).filter("_best = 1").drop("_best", "_island")
