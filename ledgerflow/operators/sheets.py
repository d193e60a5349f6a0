"""What stands on a workbook's sheets, as rows: literal grids ready to write, raw candidate tables by method, and facts of finished files held against rules."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.tokens import parse

SPAN = "array<struct<r:int,c:int,rs:int,cs:int>>"
# Empty rows and columns at the upper and left edge of a sheet, and the width of such a column.
MARGIN_ROWS, MARGIN_COLUMNS, MARGIN_WIDTH = 3, 2, 1.7109375
# What a sheet of raw cells says of its table.
RAW_FACTS = (("table_score", "Score"), ("accuracy", "Accuracy"), ("whitespace", "Whitespace"))


def _blank(v: Column) -> Column:
    return F.coalesce(v, F.lit("")) == ""


def displayed(grids: DataFrame) -> DataFrame:
    """grids(rows, spans) with rows and spans as they are written. A null grid stays null.

    Rows without a text go, unless a span with one reaches over them; spans follow the rows that are left, and those that are one cell or leave the grid go.
    Cells under a span are empty but for its first. A percent sign in a cell of its own joins the number on its left, and its cell is empty.
    What stays and where spans go are columns of their own: within the expression for a cell they would be worked out again for each cell.
    """
    rows, spans, kept, moved = (F.col(c) for c in ("rows", "_spans", "_kept", "_moved"))
    n = F.size(rows)
    own = grids.withColumn("_spans", F.coalesce(F.col("spans").cast(SPAN), F.array().cast(SPAN)) if "spans" in grids.columns else F.array().cast(SPAN))
    text = lambda r, c: F.coalesce(F.get(F.get(rows, r), c), F.lit(""))
    over = lambda r: F.exists(spans, lambda s: (s["r"] <= r) & (r < s["r"] + s["rs"]) & (text(s["r"], s["c"]) != ""))
    own = own.withColumn("_kept", F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda r: F.exists(F.get(rows, r), lambda v: ~_blank(v)) | over(r))).otherwise(F.array().cast("array<int>")))
    inside = F.filter(spans, lambda s: F.array_contains(kept, s["r"]) & (s["r"] + s["rs"] <= n) & (s["c"] + s["cs"] <= F.size(F.get(rows, s["r"]))))
    place = lambda r: (F.array_position(kept, r) - 1).cast("int")
    high = lambda s: F.size(F.filter(kept, lambda r: (r >= s["r"]) & (r < s["r"] + s["rs"])))
    placed = F.transform(inside, lambda s: F.struct(place(s["r"]).alias("r"), s["c"].alias("c"), high(s).alias("rs"), s["cs"].alias("cs")))
    own = own.withColumn("_moved", F.filter(placed, lambda s: (s["rs"] != 1) | (s["cs"] != 1)))
    covered = lambda i, c: F.exists(moved, lambda s: (s["r"] <= i) & (i < s["r"] + s["rs"]) & (s["c"] <= c) & (c < s["c"] + s["cs"]) & ((s["r"] != i) | (s["c"] != c)))
    number = lambda v: parse(v)["status"] == "NUMERIC"
    sign = lambda v: F.coalesce(F.trim(v) == "%", F.lit(False))

    def cell(row: Column, v: Column, i: Column, c: Column) -> Column:
        left, right = F.get(row, c - 1), F.get(row, c + 1)
        joined = F.when(sign(v) & (c > 0) & number(left), "").when(sign(right) & number(v), F.concat(v, F.lit("%")))
        return F.when(covered(i, c), "").otherwise(F.coalesce(joined, v, F.lit("")))

    shown = F.transform(kept, lambda r: F.get(rows, r))
    shown = F.transform(shown, lambda row, i: F.transform(row, lambda v, c: cell(row, v, i, c)))
    made = own.withColumn("_rows", shown)
    return made.withColumn("rows", F.when(F.col("rows").isNotNull(), F.col("_rows"))).withColumn("spans", F.col("_moved")).drop("_spans", "_kept", "_moved", "_rows")


def raw_cells_by_method(cells: DataFrame) -> DataFrame:
    """doc_id, flavor, row, column, text: where each candidate cell of each method stands on its raw sheet.

    cells(doc_id, source_page, table_id, flavor, row_index, column_index, raw_text; selected, table_score, accuracy, whitespace where there are such). Tables
    follow each other by page and name: a line that says what the table is, its cells, and two empty rows. Texts are as they were; empty ones have no row.
    """
    key = ["doc_id", "flavor", "source_page", "table_id"]
    own = cells.withColumns({"source_page": F.coalesce("source_page", F.lit(0)), "table_id": F.coalesce("table_id", F.format_string("Page_%d", F.coalesce("source_page", F.lit(0))))})
    picked = F.max(F.coalesce(F.col("selected"), F.lit(False))) if "selected" in cells.columns else F.lit(False)
    facts = [F.concat(F.lit(f"{label}: "), F.max(name).cast("string")) for name, label in RAW_FACTS if name in cells.columns]
    tables = own.groupBy(*key).agg(F.max("row_index").alias("_high"), F.array_compact(F.array(F.concat(F.lit("Table: "), F.first("table_id")), F.concat(F.lit("Page: "), F.first("source_page").cast("string")), F.when(picked, "Selected: Yes").otherwise("Selected: No"), *facts)).alias("_facts"))
    before = Window.partitionBy("doc_id", "flavor").orderBy("source_page", "table_id").rowsBetween(Window.unboundedPreceding, -1)
    tables = tables.withColumn("_at", F.coalesce(F.sum(F.col("_high") + 4).over(before), F.lit(0)).cast("int"))
    heads = tables.select("doc_id", "flavor", F.col("_at").alias("row"), F.posexplode("_facts").alias("column", "text"))
    body = own.join(tables.select(*key, "_at"), key).select("doc_id", "flavor", (F.col("_at") + 1 + F.col("row_index")).cast("int").alias("row"), F.col("column_index").cast("int").alias("column"), F.col("raw_text").alias("text"))
    return heads.unionByName(body.filter(~_blank(F.col("text"))))


def raw_sheets(cells: DataFrame) -> DataFrame:
    """doc_id, name, rows: a sheet of raw cells for each method, as a grid to write."""
    placed = raw_cells_by_method(cells)
    at = lambda values, n: F.transform(F.sequence(F.lit(0), n), lambda i: F.try_element_at(values, i))
    rows = placed.groupBy("doc_id", "flavor", "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("_cells"), F.max("column").alias("_wide"))
    rows = rows.select("doc_id", "flavor", "row", F.transform(at(F.col("_cells"), F.col("_wide")), lambda v: F.coalesce(v, F.lit(""))).alias("_row"))
    sheets = rows.groupBy("doc_id", "flavor").agg(F.map_from_entries(F.collect_list(F.struct("row", "_row"))).alias("_rows"), F.max("row").alias("_high"))
    empty = F.array(F.lit(""))
    return sheets.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Raw "), "flavor").alias("name"), F.transform(at(F.col("_rows"), F.col("_high")), lambda r: F.coalesce(r, empty)).alias("rows"))


FACTS = "doc_id string, sheet string, fact string, row int, first int, last int, hidden boolean, size double, kind string, filled boolean, error string"
_FACTS = [c.split()[0] for c in FACTS.split(", ")]
_MAIN, _LINK = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _number(letters: str) -> int:
    return sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters)))


def sheet_facts(content: bytes) -> Iterator[dict]:
    """Facts of an XLSX file's sheets, rows and columns from 1."""
    yes = lambda e, name: e.get(name) in ("1", "true")
    size = lambda e, name: float(e.get(name)) if e.get(name) is not None else None
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        for sheet in tree("xl/workbook.xml").iter(f"{_MAIN}sheet"):
            name, target = sheet.get("name"), targets[sheet.get(_LINK)]
            root = tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            yield {"sheet": name, "fact": "sheet", "kind": sheet.get("state", "visible")}
            for e in root.iter():
                what = e.tag.removeprefix(_MAIN)
                if what == "mergeCell":
                    yield {"sheet": name, "fact": "merge", "kind": e.get("ref")}
                elif what == "pane":
                    yield {"sheet": name, "fact": "pane", "kind": e.get("state", "split")}
                elif what == "sheetFormatPr":
                    yield {"sheet": name, "fact": "default_row", "hidden": yes(e, "zeroHeight"), "size": size(e, "defaultRowHeight")}
                    yield {"sheet": name, "fact": "default_column", "hidden": False, "size": size(e, "defaultColWidth")}
                elif what == "col":
                    yield {"sheet": name, "fact": "columns", "first": int(e.get("min")), "last": int(e.get("max")), "hidden": yes(e, "hidden"), "size": size(e, "width")}
                elif what == "row":
                    yield {"sheet": name, "fact": "row", "row": int(e.get("r")), "hidden": yes(e, "hidden"), "size": size(e, "ht")}
                    for c in e:
                        filled = any(c.find(f"{_MAIN}{t}") is not None for t in ("v", "f", "is"))
                        at = _number(re.match("[A-Z]+", c.get("r"))[0])
                        yield {"sheet": name, "fact": "cell", "row": int(e.get("r")), "first": at, "last": at, "kind": c.get("t", "n"), "filled": filled}


def workbook_facts(files: DataFrame) -> DataFrame:
    """files(doc_id, content) as FACTS; a file that is no workbook has one row with its error."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for doc, content in zip(frame["doc_id"], frame["content"], strict=True):
                try:
                    found = [f | {"doc_id": doc} for f in sheet_facts(bytes(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError, ValueError) as e:
                    found = [{"doc_id": doc, "fact": "error", "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame([[f.get(c) for c in _FACTS] for f in found], columns=_FACTS, dtype=object)

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, FACTS)


class Rule(NamedTuple):
    """A problem that a sheet has if one of its facts of this kind meets the condition."""

    problem: str
    fact: str
    when: str


RULES = (
    Rule("hidden_sheet", "sheet", "kind <> 'visible'"),
    Rule("merged_cells", "merge", "true"),
    Rule("freeze_or_split_panes", "pane", "true"),
    Rule("hidden_or_zero_height_default_rows", "default_row", "hidden OR size = 0"),
    Rule("zero_width_default_columns", "default_column", "size = 0"),
    Rule("hidden_or_zero_width_column", "columns", "hidden OR size = 0"),
    Rule("hidden_or_zero_height_row", "row", "hidden OR size = 0"),
    Rule("nonempty_margin", "cell", f"filled AND (row <= {MARGIN_ROWS} OR first <= {MARGIN_COLUMNS})"),
    Rule("excel_error_cell", "cell", "kind = 'e'"),
    Rule("unreadable_workbook", "error", "true"),
)


def layout_issues(facts: DataFrame, rules: tuple[Rule, ...] = RULES, margin_columns: int = MARGIN_COLUMNS, margin_width: float = MARGIN_WIDTH) -> DataFrame:
    """doc_id, sheet, problem: each rule that a sheet breaks, once; left_margin_width_N for a margin column without the width that it must have."""
    hits = F.array_compact(F.array(*[F.when((F.col("fact") == r.fact) & F.coalesce(F.expr(r.when), F.lit(False)), r.problem) for r in rules]))
    broken = facts.select("doc_id", "sheet", F.explode(hits).alias("problem"))
    margins = facts.filter("fact = 'sheet'").select("doc_id", "sheet", F.explode(F.sequence(F.lit(1), F.lit(margin_columns))).alias("_n"))
    own = facts.filter((F.col("fact") == "columns") & (F.col("first") <= margin_columns) & (F.abs(F.col("size") - margin_width) <= 1e-6))
    wide = own.select("doc_id", "sheet", F.explode(F.sequence("first", F.least("last", F.lit(margin_columns)))).alias("_n"))
    narrow = margins.join(wide, ["doc_id", "sheet", "_n"], "left_anti").select("doc_id", "sheet", F.format_string("left_margin_width_%d", "_n").alias("problem"))
    return broken.unionByName(narrow).distinct()
