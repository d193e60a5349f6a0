"""Multisets of numeric tokens as counted rows: coverage of pages, recall of extractions, choice between candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.text import normalize, numbers_in
from ledgerflow.functions.tokens import decimal_amount, parse, with_token


def counted(rows: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """keys, token, n."""
    return rows.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def compared(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, token, expected, actual, both, missing, extra: one shuffle on keys and token for all multiset operations."""
    both = expected.withColumnRenamed("n", "expected").join(actual.withColumnRenamed("n", "actual"), [*keys, "token"], "full_outer").na.fill(0, ["expected", "actual"])
    e, a = F.col("expected"), F.col("actual")
    return both.withColumns({"both": F.least(e, a), "missing": F.greatest(e - a, F.lit(0)), "extra": F.greatest(a - e, F.lit(0))})


def recall(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: token totals, matches, recall (null without a reference), and maps of what is missing and extra. Signs and labels aren't compared."""
    gaps = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct("token", c)))))
    out = compared(expected, actual, keys).groupBy(*keys).agg(F.sum("expected").alias("reference_tokens"), F.sum("both").alias("matched_tokens"), gaps("missing").alias("missing_tokens"), gaps("extra").alias("extra_tokens"))
    return out.withColumn("recall", F.try_divide("matched_tokens", F.nullif("reference_tokens", F.lit(0))))


def table_metrics(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.countDistinct("table_id").alias("tables"), F.countDistinct("table_id", "row_index").alias("rows"))


def covered(expected: DataFrame, actual: DataFrame, keys: list[str], least: float = 0.97) -> DataFrame:
    """Keys whose tokens are covered: every year with its full multiplicity, and 97 in 100 tokens of all."""
    year = F.col("token").rlike(r"^(?:19|20)\d{2}$")
    out = compared(expected, actual, keys).groupBy(*keys).agg(F.sum("expected").alias("total"), F.sum("both").alias("matched"), F.sum(F.when(year, F.col("missing")).otherwise(0)).alias("years_missing"))
    return out.filter("total > 0").withColumn("covered", (F.col("years_missing") == 0) & (F.col("matched") >= least * F.col("total")))


def has_data(rows: Column) -> Column:
    """A grid with a row of a label and an amount beside it."""
    return F.exists(rows, lambda r: F.exists(r, lambda v: v.rlike("[A-Za-z]")) & F.exists(F.slice(r, F.lit(2), F.greatest(F.lit(0), F.size(r) - 1)), lambda v: parse(v)["status"] == "NUMERIC"))


def uncovered_pages(cells: DataFrame, lines: DataFrame, grids: DataFrame) -> DataFrame:
    """doc_id, source_page, covered: the numbers of a page's text against those of its selected grids that have data."""
    text = counted(lines, ["doc_id", "source_page"], numbers_in(F.col("raw_text")))
    own = grids.filter(has_data(F.col("rows"))).select("doc_id", "source_page", F.explode("rows").alias("row"))
    return covered(text, counted(own, ["doc_id", "source_page"], numbers_in(F.array_join("row", " "))), ["doc_id", "source_page"])


def complete_candidates(expected: DataFrame, candidates: DataFrame, current: DataFrame, keys: list[str], flavor: str = "flavor") -> DataFrame:
    """keys, old, best: where another flavor has all source-supported tokens of the current one and more, the one with most (of equals the first by name)."""
    supported = candidates.join(expected.withColumnRenamed("n", "expected"), [*keys, "token"]).withColumn("n", F.least("n", "expected")).drop("expected")
    old = supported.join(current, [*keys, flavor]).select(*keys, "token", F.col("n").alias("old_n"), F.col(flavor).alias("old"))
    totals = supported.groupBy(*keys, flavor).agg(F.sum("n").alias("total"))
    kept = supported.join(old, [*keys, "token"]).groupBy(*keys, flavor).agg(F.sum(F.least("n", "old_n")).alias("kept"))
    base = current.withColumnRenamed(flavor, "old").join(totals.select(*keys, F.col(flavor).alias("old"), F.col("total").alias("old_total")), [*keys, "old"], "left").na.fill(0, ["old_total"])
    better = totals.join(kept, [*keys, flavor], "left").na.fill(0, ["kept"]).join(base, keys).filter("kept = old_total AND total > old_total")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("total"), flavor))
    return better.withColumn("_n", first).filter("_n = 1").select(*keys, "old", F.col(flavor).alias("best"), F.col("old_total"), F.col("total").alias("best_total"))


def best_flavors(tables: DataFrame, keys: list[str], flavor: str = "flavor", score: str = "score") -> DataFrame:
    """The flavor with the highest mean score for each key; of equals the first by name."""
    means = tables.groupBy(*keys, flavor).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n_tables"))
    return means.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mean_score"), flavor))).filter("_n = 1").drop("_n")


def table_score(accuracy: Column, whitespace: Column, n_rows: Column, n_columns: Column) -> Column:
    """Accuracy, less 45 in 100 of white space, and up to 8 for size. A white space of 0 counts as 100, like a missing one."""
    blank = F.coalesce(F.nullif(whitespace, F.lit(0.0)), F.lit(100.0))
    return F.coalesce(accuracy, F.lit(0.0)) - 0.45 * blank + F.least(F.lit(8.0), F.sqrt(n_rows * n_columns) / 2)


def normalized_cells(cells: DataFrame) -> DataFrame:
    """Selected cells with their token."""
    token = F.col("_token")
    others = [c for c in cells.columns if c != "selected"]
    return with_token(cells.filter("selected"), "raw_text", "_token").select(*others, token["normalized"].alias("normalized_text"), token["value"].alias("parsed_value"), token["status"].alias("parse_status"), token["currency"].alias("currency"), token["is_percent"].alias("is_percent"), token["is_ratio"].alias("is_ratio"), token["precision"].alias("precision"))


def body_tokens(text: Column) -> Column:
    """Every sign and word of a body, for completeness: currency signs stand alone."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([$€£¥]|[^\s$€£¥]+)"), 1)


def numeric_cells(cells: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    """keys, n_numeric, n_text: the cells that are one number, and the others that aren't empty."""
    number = decimal_amount(F.col(cell)).isNotNull()
    return cells.groupBy(*keys).agg(F.count_if(number).alias("n_numeric"), F.count_if(~number & (normalize(F.col(cell)) != "")).alias("n_text"))
