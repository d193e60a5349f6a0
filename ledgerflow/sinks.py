"""Sinks: Parquet by document, JSON, CSV and Markdown reports, and literal XLSX workbooks, written and read back with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from typing import NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.sheets import MARGIN_WIDTH, displayed, raw_sheets


def parquet(frame: DataFrame, path: str, by: str | None = None, overwrite: bool = False) -> None:
    writer = frame.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def report(frame: DataFrame, path: str, format: str = "json") -> None:
    """json (gzip) or csv."""
    frame.write.mode("errorifexists").options(**({"compression": "gzip"} if format == "json" else {"header": "true"})).format(format).save(path)


def _column(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _plain(text: str) -> str:
    return "".join(c for c in text if c in "\t\n\r" or ord(c) >= 32 and ord(c) not in (0xFFFE, 0xFFFF))


def free_name(taken: Iterable[str], name: str) -> str:
    """The name itself, or with the first number that makes it new: outputs never overwrite others."""
    used, (stem, dot, suffix) = {t.lower() for t in taken}, name.rpartition(".")
    stem, suffix = (stem, dot + suffix) if dot else (name, "")
    return next(n for k in range(1, len(used) + 2) if (n := name if k == 1 else f"{stem} ({k}){suffix}").lower() not in used)


def markdown(frame: DataFrame, most_rows: int) -> str:
    """A report's first rows as a Markdown table, and how many there are."""
    rows = frame.limit(most_rows).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", r"\|").replace("\n", " ")
    lines = ["| " + " | ".join(frame.columns) + " |", "|" + " --- |" * len(frame.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    return "\n".join([*lines, "", f"{len(rows)} of {frame.count()} rows."])


class Number(NamedTuple):
    """A number as it is shown: digits after the point, with a percent sign (never rescaled), in bold."""

    value: float
    precision: int = 0
    percent: bool = False
    total: bool = False

    @property
    def style(self) -> int:
        return 1 + min(6, max(0, self.precision)) + 7 * self.percent + 14 * self.total


def _styles() -> str:
    """Style 0: as it comes; then Number.style."""
    shown = [f'#,##0{"." + "0" * p if p else ""}{quoted}' for quoted in ("", '"%"') for p in range(7)]
    formats = "".join(f'<numFmt numFmtId="{164 + k}" formatCode={quoteattr(f)}/>' for k, f in enumerate(shown))
    xfs = '<xf numFmtId="0" fontId="0"/>' + "".join(f'<xf numFmtId="{164 + k}" fontId="{bold}" applyNumberFormat="1" applyFont="1"/>' for bold in (0, 1) for k in range(14))
    return f'<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="14">{formats}</numFmts><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="29">{xfs}</cellXfs></styleSheet>'


def workbook(sheets: dict[str, list[list]], merged: dict[str, list[tuple[int, int, int, int]]] | None = None, margins: tuple[int, int] = (0, 0)) -> bytes:
    """An XLSX file. Strings are literal, also those that look like formulas or links; None is an empty cell; numbers are numbers, a Number as it says.

    merged: by sheet, row, column, rows and columns (from 0) of cells that are one; such a span is left out where it meets one before it. margins: empty rows
    above and narrow columns left of what is written.
    """
    down, right = margins
    edge = f'<cols><col min="1" max="{right}" width="{MARGIN_WIDTH}" customWidth="1"/></cols>' if right else ""
    if not sheets or not any(rows for rows in sheets.values()):
        raise ValueError("a workbook without rows isn't written")
    names = []
    for name in sheets:
        short = "".join("_" if c in "[]:*?/\\" else c for c in name)[:31] or "Sheet"
        while short.lower() in (n.lower() for n in names):
            short = f"{short[:28]}_{len(names)}"
        names.append(short)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}<Relationship Id="rIdStyles" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", head + _styles())
        for i, (own, rows) in enumerate(sheets.items(), 1):
            body = []
            for r, row in enumerate(rows, 1 + down):
                made = []
                for c, v in enumerate(row, right):
                    at, style = f"{_column(c)}{r}", ""
                    if isinstance(v, Number):
                        v, style = v.value, f' s="{v.style}"'
                    if v is None or isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
                        continue
                    if isinstance(v, bool) or not isinstance(v, (int, float)):
                        made.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_plain(str(v)))}</t></is></c>')
                    else:
                        made.append(f'<c r="{at}"{style}><v>{v!r}</v></c>')
                body.append(f'<row r="{r}">{"".join(made)}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{edge}<sheetData>{"".join(body)}</sheetData>{_merges([(x + down, y + right, h, w) for x, y, h, w in (merged or {}).get(own, [])])}</worksheet>')
    return out.getvalue()


def _merges(spans: list[tuple[int, int, int, int]]) -> str:
    taken: set[tuple[int, int]] = set()
    refs = []
    for r, c, rs, cs in spans:
        cells = {(x, y) for x in range(r, r + rs) for y in range(c, c + cs)}
        if len(cells) > 1 and not cells & taken:
            taken |= cells
            refs.append(f'<mergeCell ref="{_column(c)}{r + 1}:{_column(c + cs - 1)}{r + rs}"/>')
    return f'<mergeCells count="{len(refs)}">{"".join(refs)}</mergeCells>' if refs else ""


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_workbook(content: bytes) -> dict[str, list[list]]:
    """The sheets of an XLSX file as rows of texts, numbers and None. Formulas give the value that is stored beside them; errors are texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        targets = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in tree("xl/_rels/workbook.xml.rels")}
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))
        shared = [text(x) for x in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        out = {}
        for sheet in tree("xl/workbook.xml").iter(f"{_MAIN}sheet"):
            rows: list[list] = []
            for cell in tree("xl/" + targets[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]).iter(f"{_MAIN}c"):
                letters, r = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                c = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1
                kind, v = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
                value = text(cell) if kind == "inlineStr" else None if v is None else shared[int(v)] if kind == "s" else float(v) if kind == "n" else v
                rows += [[] for _ in range(int(r) - len(rows))]
                rows[int(r) - 1] += [None] * (c + 1 - len(rows[int(r) - 1]))
                rows[int(r) - 1][c] = value
            out[sheet.get("name")] = rows
        return out


def workbook_cells(files: DataFrame) -> DataFrame:
    """files(doc_id, content) as doc_id, sheet, row, column (from 0), text, number for each cell that isn't empty; a file that is no workbook gives one row with its error."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in batches:
            for doc, content in zip(frame["doc_id"], frame["content"], strict=True):
                found, error = [], None
                try:
                    for name, rows in read_workbook(bytes(content)).items():
                        found += [[doc, name, r, c, v if isinstance(v, str) else None, None if isinstance(v, str) else v, None] for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame(found if error is None else [[doc, None, None, None, None, None, error]], columns=["doc_id", "sheet", "row", "column", "text", "number", "error"])

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, "doc_id string, sheet string, row int, column int, text string, number double, error string")


def workbook_rows(cells: DataFrame, margins: tuple[int, int] = (0, 0)) -> DataFrame:
    """Canonical rows of period sheets as workbooks() writes them: doc_id, statement_type, row, raw_item, standard_item, period, number, text."""
    own = cells.filter(F.col("sheet").isin(*SHEETS)).withColumns({"row": F.col("row") - margins[0], "column": F.col("column") - margins[1]})
    heads = own.filter("row = 0 AND column >= 2").select("doc_id", "sheet", "column", F.col("text").alias("period"))
    names = own.filter("row > 0 AND column < 2").groupBy("doc_id", "sheet", "row").agg(F.max(F.when(F.col("column") == 0, F.col("text"))).alias("raw_item"), F.max(F.when(F.col("column") == 1, F.col("text"))).alias("standard_item"))
    return own.filter("row > 0").join(heads, ["doc_id", "sheet", "column"]).join(names, ["doc_id", "sheet", "row"], "left").select("doc_id", F.col("sheet").alias("statement_type"), "row", "raw_item", "standard_item", "period", "number", "text")


#: Statements in the order of a workbook's sheets.
SHEETS = ("BalanceSheet", "IncomeStatement", "CashFlowStatement", "StockholdersEquityStatement", "PartnersCapital", "ScheduleOfInvestments")


def _period_sheet(part: pd.DataFrame) -> list[list]:
    """A column for each period; numbers with the row's greatest precision, percents as such, totals in bold."""
    periods, table = list(dict.fromkeys(t[2] for t in part["text"])), []
    for _, row in part.groupby("at", sort=False):
        first, digits = row["text"].iloc[0], int(row["precision"].fillna(0).max())
        total = first[1].lower().startswith("total ") or first[0].lower().startswith("total ")
        by = {t[2]: t[3] if pd.isna(n) else Number(float(n), digits, bool(p), total) for t, n, p in zip(row["text"], row["number"], row["percent"], strict=True)}
        table.append([first[0], first[1], *[by.get(p) for p in periods]])
    return [["Item", "Standard item", *periods], *table]


def _grid_sheet(grid) -> tuple[list[list], list[tuple[int, int, int, int]]]:
    """A source grid as it stands, under its columns' labels, in one block for each of its sections; and its merged cells."""
    rows = [list(r) for r in grid["rows"]]
    labels = list(grid["labels"]) if grid["labels"] is not None else []
    head = [["", *labels]] if labels else []
    if grid["sections"] is not None and len(grid["sections"]):
        blocks = [[[x["caption"] or ""], *head, *rows[x["start"] : x["end"]], []] for x in grid["sections"]]
        return [r for b in blocks for r in b], []
    spans = grid["spans"] if grid["spans"] is not None else []
    return [*head, *rows], [(x["r"] + len(head), x["c"], x["rs"], x["cs"]) for x in spans]


_GRID = "array<struct<r: int, c: int, rs: int, cs: int>>"


def workbooks(values: DataFrame, checks: DataFrame, grids: DataFrame | None = None, raw_cells: DataFrame | None = None, margins: tuple[int, int] = (0, 0)) -> DataFrame:
    """doc_id, content: one workbook for each filing, with a sheet for each statement (a column for each period), the grids of its source, and the checks, most severe first. A filing without rows has none.

    grids(doc_id, rows; table_id, statement_type, source_page, labels or period_labels or component_labels, spans, sections or period_sections where there are
    such): one sheet for each table, literal, with its merged cells (see sheets.display); tables with sections (rollforwards, several periods) in one block
    for each. raw_cells: candidate cells, one sheet for each method that found some (see sheets.raw_cells_by_method). margins: see workbook().
    """
    text = F.array(F.coalesce("raw_item", F.lit("")), F.coalesce("standard_item", F.lit("")), F.coalesce("period", F.lit("")), F.coalesce("raw_value", F.lit("")))
    rows = values.select("doc_id", F.col("statement_type").alias("sheet"), F.col("row_index").alias("at"), text.alias("text"), F.col("parsed_value").alias("number"), F.col("precision").cast("int").alias("precision"), F.col("is_percent").alias("percent"))
    none = {"number": "double", "precision": "int", "percent": "boolean"}
    review = checks.select("doc_id", F.lit("Review").alias("sheet"), F.col("severity").alias("at"), F.array("Check", "Scope", "Status", F.coalesce("Detail", F.lit(""))).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    own = rows.unionByName(review).withColumn("doc_id", F.col("doc_id").cast("string"))
    session = own.sparkSession
    if grids is None:
        tables = session.createDataFrame([], f"doc_id string, name string, rows array<array<string>>, labels array<string>, spans {_GRID}, sections array<struct<start: int, end: int, caption: string>>")
    else:
        pick = lambda kind, *names: next((F.col(n).cast(kind) for n in names if n in grids.columns), F.lit(None).cast(kind))
        page = F.concat(F.lit("p"), pick("string", "source_page", "page"))
        sections = pick("array<struct<start: int, end: int, caption: string>>", "sections", "period_sections")
        literal = grids.filter("rows IS NOT NULL").withColumn("spans", pick(_GRID, "spans"))
        sectioned = F.coalesce(F.size(sections), F.lit(0)) > 0  # sections count rows, so these stay as they are
        tables = literal.filter(sectioned).unionByName(displayed(literal.filter(~sectioned))).select(F.col("doc_id").cast("string").alias("doc_id"), F.concat_ws(" ", pick("string", "table_id"), pick("string", "statement_type"), page).alias("name"), "rows", pick("array<string>", "component_labels", "period_labels", "labels").alias("labels"), F.col("spans").cast(_GRID).alias("spans"), sections.alias("sections"))
    if raw_cells is not None:
        tables = tables.unionByName(raw_sheets(raw_cells), allowMissingColumns=True)

    def run(key: tuple, frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        sheets: dict[str, list[list]] = {n: _period_sheet(frame[frame["sheet"] == n].sort_values("at", kind="stable")) for n in SHEETS if (frame["sheet"] == n).any()}
        merged = {}
        for _, grid in found.sort_values("name", kind="stable").iterrows():
            sheets[grid["name"]], merged[grid["name"]] = _grid_sheet(grid)
        if not sheets:
            return pd.DataFrame([], columns=["doc_id", "content"])
        if (frame["sheet"] == "Review").any():
            part = frame[frame["sheet"] == "Review"].sort_values("at", kind="stable")
            sheets["Review"] = [["Status", "Check", "Scope", "Detail"], *[[t[2], t[0], t[1], t[3]] for t in part["text"]]]
        return pd.DataFrame([[key[0], workbook(sheets, merged, margins)]], columns=["doc_id", "content"])

    return own.groupBy("doc_id").cogroup(tables.groupBy("doc_id")).applyInPandas(run, "doc_id string, content binary")
