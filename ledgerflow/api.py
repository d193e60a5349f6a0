"""The public interface: filings in, a bundle of DataFrames out, all keyed by doc_id."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators import audits, completeness, coverage, grids, layouts, statements, tables
from ledgerflow.paths import checked
from ledgerflow.plans import pages as plans
from ledgerflow.sources import html, snapshots, text


class ReviewRequired(ValueError):
    """Page plans of these documents need a review first."""

    def __init__(self, documents: list[str]) -> None:
        super().__init__(f"page selection needs a review: {', '.join(documents[:20])}")
        self.documents = documents


@dataclass(frozen=True)
class Result:
    lines: DataFrame
    rows: DataFrame
    values: DataFrame
    units: DataFrame
    companies: DataFrame
    checks: DataFrame
    cells: DataFrame | None = None
    grids: DataFrame | None = None
    plan: DataFrame | None = None
    metadata: DataFrame | None = None


def _checks(rows: DataFrame, values: DataFrame, units: DataFrame, *more: DataFrame) -> DataFrame:
    own = units.select("doc_id", "unit.unit_label", "unit.currency")
    return audits.review_report(statements.issues(rows), audits.balance_checks(values), audits.cash_checks(values), audits.cross_checks(values), audits.duplicate_checks(_labelled(rows)), audits.unit_checks(own), *more)


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.filter("row_type = 'Data'")


def from_lines(lines: DataFrame, recover: bool = True, **more) -> Result:
    rows = statements.statement_rows(lines, recover)
    units = statements.unit_notes(lines)
    values = statements.parsed_values(rows, units)
    return Result(lines, rows, values, units, statements.companies(lines), _checks(rows, values, units), **more)


def extract_text(spark: SparkSession, texts) -> Result:
    """Pasted statements: {doc_id: text} or a DataFrame(doc_id, text)."""
    return from_lines(text.pasted(spark, texts))


def extract_html(files: DataFrame) -> Result:
    """files(doc_id, content) of HTML filings."""
    tables = html.parsed(files)
    chosen = html.selected(html.classify(tables))
    names = html.metadata(tables)
    cells = html.cells(chosen)
    return from_lines(html.statement_lines(chosen, names), False, cells=coverage.normalized_cells(cells), grids=grids.trimmed(grids.assembled(cells)), metadata=names)


def extract_pages(captured: DataFrame, pages: str = "auto", policy: str = "review") -> Result:
    """captured: snapshots of PDF pages. pages: auto, or a specification like 1-3,7. policy: review raises where a plan needs one, exact and suggested go on."""
    frame = snapshots.pages(captured)
    lines = text.page_lines(frame)
    if pages == "auto":
        found = plans.automatic_plan(frame.withColumn("unreadable", (F.trim(F.coalesce("text", F.lit(""))) == "") & ((F.coalesce("n_images", F.lit(0)) > 0) | (F.coalesce("n_curves", F.lit(0)) > 10))))
        plan = found.withColumn("suggested", F.col("selected"))
    else:
        spec = text.page_counts(frame).withColumn("spec", F.lit(pages))
        plan = plans.manual_plan(lines, plans.requested_pages(spec)).withColumn("selected", F.lit(True))
    if policy == "review" and (waiting := [r["doc_id"] for r in plan.filter("review_required").select("doc_id").distinct().limit(21).collect()]):
        raise ReviewRequired(waiting)
    chosen = plans.resolve(plan, policy) if pages != "auto" else plan
    own = chosen.filter("selected").select("doc_id", F.col("page").alias("source_page"), F.nullif("statement_type", F.lit("")).alias("statement_type_hint"), "source_title")
    selected = lines.join(own, ["doc_id", "source_page"])
    opens = plans.is_boundary(F.col("raw_text"))
    from pyspark.sql import Window

    ended = F.max(opens.cast("int")).over(Window.partitionBy("doc_id", "source_page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = layouts.recovered(captured, chosen)
    own = selected.withColumn("_ended", ended).filter("_ended = 0").drop("_ended")
    repairs = layouts.income_repairs(own.withColumn("statement_type", F.col("statement_type_hint")), captured)
    own = own.join(repairs.withColumn("_repaired", F.lit(True)), ["doc_id", "source_page", "line_no"], "left").filter("_repaired IS NULL OR text IS NOT NULL").withColumn("raw_text", F.coalesce("text", "raw_text")).drop("text", "method", "_repaired")
    result = from_lines(own, plan=chosen, grids=found)
    unread = repairs.filter(F.col("method").startswith("Incomplete")).select("doc_id", F.lit("Period-count alignment").alias("Check"), F.format_string("Page %d line %d", "source_page", "line_no").alias("Scope"), F.lit("WARN").alias("Status"), F.concat_ws(" ", "method", "text").alias("Detail"))
    covered = completeness.page_coverage(chosen, found.filter("error IS NULL"))
    unclear = found.filter("error IS NOT NULL").select("doc_id", F.concat("statement_type", F.lit(" layout")).alias("Check"), F.concat(F.lit("Page "), F.col("source_page").cast("string")).alias("Scope"), F.lit("WARN").alias("Status"), F.concat("error", F.lit(" Original grids retained; source review is required.")).alias("Detail"))
    return replace(result, checks=audits.review_report(result.checks, covered, unclear, unread, _grid_checks(found.filter("error IS NULL"))))


def is_page_result(result: Result) -> bool:
    """Whether a result is that of captured pages: these alone have a page plan."""
    return result.plan is not None


class PageTables(NamedTuple):
    """cells of both ways to find tables on pages, their recall of the numbers in the text by page and method, and a check for each page and method."""

    cells: DataFrame
    metrics: DataFrame
    checks: DataFrame


def page_tables(captured: DataFrame) -> PageTables:
    """The tables of captured pages within their rules and by the white between words, for comparison: nothing else takes values from them."""
    words = snapshots.words(captured).withColumnRenamed("page", "source_page")
    ruled = tables.ruled_cells(snapshots.edges(captured), words)
    spaced = tables.spaced_cells(words)
    pages = captured.select("doc_id", F.col("number").alias("source_page"))
    cells = ruled.unionByName(spaced)
    lines = text.page_lines(snapshots.pages(captured))
    return PageTables(cells, tables.method_metrics(lines, cells, pages), tables.audit(pages, ruled, "Ruled").unionByName(tables.audit(pages, spaced, "Spaced")))


def _grid_checks(found: DataFrame) -> DataFrame:
    """Equation checks of recovered grids, by the kind of statement."""
    named = found.withColumn("period_labels", F.col("labels"))
    checks = [
        audits.corporate_balance_checks(named.filter("statement_type = 'BalanceSheet'")), audits.fund_balance_checks(named.filter("statement_type = 'BalanceSheet'")),
        audits.cash_grid_checks(named.filter("statement_type = 'CashFlowStatement'")),
        audits.equity_grid_checks(named.filter("statement_type IN ('StockholdersEquityStatement', 'PartnersCapital')").withColumn("component_labels", F.col("labels")).withColumn("period_sections", F.col("sections"))),
    ]
    tested = [c.select("doc_id", "Check", "Scope", "Status").filter("Status <> 'NOT_TESTED'") for c in checks]
    return tested[0].unionByName(tested[1]).unionByName(tested[2]).unionByName(tested[3])


def extract(spark: SparkSession, path: str, pages: str = "auto", policy: str = "review", allow_nonlocal: bool = False) -> Result:
    """Filings under a path, by suffix: HTML, or page snapshots as JSON or Parquet; anything else is an error."""
    plain = checked(path, allow_nonlocal)
    suffix = plain.rstrip("/*").rpartition(".")[2].lower()
    if suffix in ("html", "htm", "xhtml"):
        return extract_html(html.load(spark, plain))
    if suffix in ("json", "parquet"):
        return extract_pages(snapshots.load(spark, plain, suffix), pages, policy)
    raise ValueError(f"not a kind of filing that is read here: {path!r}")
