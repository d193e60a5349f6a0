"""Whether what is exported covers its source: pages, bodies, rows, and statements against each other."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.text import label_key
from ledgerflow.operators.audits import equation, finite, grid_cells
from ledgerflow.operators.coverage import body_tokens, compared, counted

#: Which section of a balance sheet a line opens or closes.
SECTIONS = {"assets": r"(?:total )?assets", "liabilities": r"(?:total )?liabilities", "equity/net assets": r"(?:total )?(?:(?:(?:share|stock)holders[’']? )?equity|net assets)"}


def _section(line, pattern: str):
    return F.regexp_replace(F.trim(line), r"\s+", " ").rlike(rf"(?i)^{pattern}(?:\s*:|\s+[$€£¥(\d]|\s*$)")


def page_coverage(plan: DataFrame, grids: DataFrame) -> DataFrame:
    """Selected pages(doc_id, page, statement_type) against exported grids: PASS, FAIL, or WARN for pages of no statement."""
    own = plan.filter("selected").select("doc_id", "page", F.coalesce("statement_type", F.lit("")).alias("statement_type"))
    have = grids.select("doc_id", F.col("source_page").alias("page"), "statement_type", F.lit(True).alias("_have")).distinct()
    status = F.when(F.col("statement_type") == "", "WARN").when(F.col("_have"), "PASS").otherwise("FAIL")
    return own.join(have, ["doc_id", "page", "statement_type"], "left").select("doc_id", F.lit("Selected statement page coverage").alias("Check"), F.concat_ws(" / ", F.concat(F.lit("Page "), F.col("page").cast("string")), F.nullif("statement_type", F.lit(""))).alias("Scope"), status.alias("Status"))


def balance_completeness(lines: DataFrame, grids: DataFrame, pages: DataFrame) -> DataFrame:
    """For balance-sheet pages(doc_id, source_page): the text between its only assets line and its only reference to notes against the grid's cells.

    FAIL: no grid, a section is missing, or a token of the body is; NOT_TESTED: the body can't be bounded, or lacks a section itself.
    """
    keys = ["doc_id", "source_page"]
    start, end = F.trim("raw_text").rlike(r"(?i)^assets\s*:?$"), F.col("raw_text").rlike(r"(?i)^\s*See (?:accompanying )?Notes\b")
    page = Window.partitionBy(*keys)
    own = lines.withColumns({"_s": F.count_if(start).over(page), "_e": F.count_if(end).over(page), "_from": F.min(F.when(start, F.col("line_no"))).over(page), "_to": F.min(F.when(end, F.col("line_no"))).over(page)})
    bounded = F.coalesce((F.col("_s") == 1) & (F.col("_e") == 1) & (F.col("_from") < F.col("_to")), F.lit(False))
    own = own.withColumn("_bounded", bounded).withColumn("_body", F.col("_bounded") & F.col("line_no").between(F.col("_from"), F.col("_to") - 1))
    has = lambda side, text: [_section(text, p).alias(f"_{side}_{n}") for n, p in SECTIONS.items()]
    body = own.select(*keys, "_bounded", *has("body", F.when(F.col("_body"), F.col("raw_text"))), F.lit(1).alias("_expected"), F.explode_outer(F.when(F.col("_body"), body_tokens(F.col("raw_text")))).alias("token"))
    cells = grids.select(*keys, F.explode("rows").alias("row")).select(*keys, F.lit(True).alias("_grid"), *has("grid", F.coalesce(F.get("row", F.lit(0)), F.lit(""))), F.lit(1).alias("_actual"), F.explode_outer(body_tokens(F.array_join("row", " "))).alias("token"))
    # Pages, lines and cells are counted together, not joined: pages that are dealt stay where they are.
    every = pages.select(*keys, F.lit(True).alias("_page")).unionByName(body, allowMissingColumns=True).unionByName(cells, allowMissingColumns=True)
    flags = ["_page", "_bounded", "_grid", *[f"_{side}_{n}" for side in ("body", "grid") for n in SECTIONS]]
    most = lambda: [F.max(f"`{c}`").alias(c) for c in flags]
    number = lambda c: F.coalesce(F.sum(F.when(F.col("token").isNotNull(), F.col(c))), F.lit(0))
    tokens = every.groupBy(*keys, "token").agg(*most(), number("_expected").alias("expected"), number("_actual").alias("actual"))
    missing = F.greatest(F.col("expected") - F.col("actual"), F.lit(0))
    some = lambda c: F.when(F.count("token") > 0, c)
    out = tokens.groupBy(*keys).agg(*most(), some(F.sum(missing)).alias("missing"), some(F.slice(F.array_sort(F.collect_list(F.when(missing > 0, F.col("token")))), 1, 20)).alias("examples")).filter("_page")
    whole = lambda side: F.coalesce(reduce(and_, [F.col(f"`_{side}_{n}`") for n in SECTIONS]), F.lit(False))
    status = F.when(F.col("_grid").isNull(), "FAIL").when(~F.coalesce("_bounded", F.lit(False)) | ~whole("body"), "NOT_TESTED").when(~whole("grid") | (F.col("missing") > 0), "FAIL").otherwise("PASS")
    return out.select(*keys, F.lit("Balance sheet completeness").alias("Check"), status.alias("Status"), "missing", "examples")


def row_coverage(source: DataFrame, grids: DataFrame) -> DataFrame:
    """Amount rows of a page's text(doc_id, source_page, label, values array<double>) against the grid's data rows, as multisets of label and vector.

    WARN with the labels that are missing, PASS without, NOT_TESTED where a page's text has no such row.
    """
    keys = ["doc_id", "source_page"]
    mark = lambda label, values: F.to_json(F.struct(label_key(label).alias("l"), values.alias("v")), {"ignoreNullFields": "false"})
    want = counted(source, keys, F.array(mark(F.col("label"), F.col("values"))))
    cells = grid_cells(grids.withColumn("table_id", F.struct("table_id", "source_page"))).filter("kind = 'data'")
    rows = cells.groupBy("doc_id", F.col("table_id.source_page").alias("source_page"), "table_id", "row_index", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("period_ord", F.col("value").alias("v")))), lambda x: x["v"]).alias("values"))
    have = counted(rows, keys, F.array(mark(F.col("key"), F.col("values"))))
    found = compared(want, have, keys).groupBy(*keys).agg(F.sum("expected").alias("expected"), F.sum("missing").alias("missing"), F.array_sort(F.collect_set(F.when(F.col("missing") > 0, F.get_json_object("token", "$.l")))).alias("labels"))
    return found.select(*keys, F.lit("Source text amount-row coverage").alias("Check"), F.when(F.col("expected") == 0, "NOT_TESTED").when(F.col("missing") > 0, "WARN").otherwise("PASS").alias("Status"), "expected", "missing", "labels")


def reconciliation(cash: DataFrame, balance: DataFrame, units: DataFrame) -> DataFrame:
    """Components of a cash reconciliation grid against balance-sheet rows with the same label and date.

    A label must be unique on the balance sheet and both statements of one known unit; two dashes are a PASS, anything else that is missing is NOT_TESTED.
    """
    dash = F.trim("cell").isin("-", "–", "—", "−")
    side = lambda grids: grid_cells(grids).filter("kind = 'data'").select("doc_id", "period", "key", "value", dash.alias("dash"))
    left = side(cash).filter(~F.lower("period").contains("ended") & ~F.col("key").startswith("total cash"))
    right = side(balance).groupBy("doc_id", "period", "key").agg(F.count("*").alias("n"), finite(F.max("value")).alias("expected"), F.max("dash").alias("other_dash")).filter("n = 1")
    same = units.groupBy("doc_id").agg(F.countDistinct("unit_label", "currency").alias("n_units"), F.max(F.coalesce("unit_label", F.lit("")).isin("", "reported units")).alias("unknown"))
    both = left.join(right, ["doc_id", "period", "key"], "left").join(same, "doc_id", "left")
    fits = F.coalesce((F.col("n_units") == 1) & ~F.col("unknown"), F.lit(False))
    status = F.when(fits & F.col("dash") & F.coalesce("other_dash", F.lit(False)), "PASS").otherwise(equation(F.col("value"), F.when(fits, F.col("expected"))))
    return both.select("doc_id", F.lit("Cash reconciliation = balance-sheet component").alias("Check"), F.concat_ws(" / ", "period", "key").alias("Scope"), status.alias("Status"))
