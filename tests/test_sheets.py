from __future__ import annotations

import random
import zipfile

from pyspark.sql import functions as F

from ledgerflow import sinks
from ledgerflow.operators import sheets as S

GRID = "id int, rows array<array<string>>, spans array<struct<r:int,c:int,rs:int,cs:int>>"


def by_loops(rows, spans):
    """The written grid, cell by cell."""
    text = lambda r, c: (rows[r][c] if c < len(rows[r]) else "") or ""
    kept = [r for r in range(len(rows)) if any(rows[r]) or any(a <= r < a + h and text(a, c) for a, c, h, _ in spans)]
    moved = []
    for r, c, h, w in spans:
        if r in kept and r + h <= len(rows) and c + w <= len(rows[r]):
            high = sum(r <= k < r + h for k in kept)
            if (high, w) != (1, 1):
                moved.append((kept.index(r), c, high, w))
    out = []
    for i, r in enumerate(kept):
        row = []
        for c, v in enumerate(rows[r]):
            v = v or ""
            if any(a <= i < a + h and b <= c < b + w and (a, b) != (i, c) for a, b, h, w in moved):
                v = ""
            elif v.strip() == "%" and c and S_NUMBER(text(r, c - 1)):
                v = ""
            elif text(r, c + 1).strip() == "%" and S_NUMBER(v):
                v += "%"
            row.append(v)
        out.append(row)
    return out, moved


def S_NUMBER(v):
    return v.strip().replace(".", "").isdigit()


def test_literal_grids_by_loops(spark):
    rng = random.Random(3)
    grids = []
    for k in range(120):
        n, m = rng.randint(1, 6), rng.randint(1, 5)
        rows = [[rng.choice(["", "", "Label", "12.5", "7", "%", " % ", None]) for _ in range(m)] for _ in range(n)]
        spans = [(rng.randrange(n), rng.randrange(m), rng.randint(1, 3), rng.randint(1, 3)) for _ in range(rng.randint(0, 2))]
        grids.append((k, rows, spans))
    grids += [(200, [["12", "%", "Total"]], None), (201, [], [])]
    got = {r.id: ([list(x) for x in r.rows], [tuple(s) for s in r.spans]) for r in S.displayed(spark.createDataFrame(grids, GRID)).collect()}
    assert got == {k: by_loops(rows, spans or []) for k, rows, spans in grids}
    assert got[200][0] == [["12%", "", "Total"]]
    assert S.displayed(spark.createDataFrame([(1, None, None)], GRID)).first()["rows"] is None


CELL = "doc_id string, source_page int, table_id string, flavor string, row_index int, column_index int, raw_text string, selected boolean, table_score double"


def test_raw_sheets_by_method(spark):
    cells = [("d", 2, "T1", "ruled", 0, 0, "a", True, 1.5), ("d", 2, "T1", "ruled", 1, 2, "b\nc", True, 1.5), ("d", 1, "T9", "ruled", 0, 1, "=1+1", False, None), ("d", None, None, "spaced", 0, 0, "", None, None), ("d", None, None, "spaced", 0, 3, "x", None, None)]
    sheets = {r.name: r.rows for r in S.raw_sheets(spark.createDataFrame(cells, CELL)).collect()}
    assert sheets == {
        "Raw ruled": [["Table: T9", "Page: 1", "Selected: No"], ["", "=1+1"], [""], [""], ["Table: T1", "Page: 2", "Selected: Yes", "Score: 1.5"], ["a"], ["", "", "b\nc"]],
        "Raw spaced": [["Table: Page_0", "Page: 0", "Selected: No"], ["", "", "", "x"]],
    }


def values_and_checks(spark):
    values = spark.createDataFrame([("d", "BalanceSheet", 0, "Cash", "Cash", "2026", "10", 10.0, 0, False)], "doc_id string, statement_type string, row_index int, raw_item string, standard_item string, period string, raw_value string, parsed_value double, precision int, is_percent boolean")
    checks = spark.createDataFrame([("d", 1, "c", "s", "PASS", "")], "doc_id string, severity int, Check string, Scope string, Status string, Detail string")
    return values, checks


def test_workbooks_with_raw_sheets_fused_cells_and_margins(spark):
    values, checks = values_and_checks(spark)
    grid = spark.createDataFrame([("d", "t", [["Rate", "", ""], ["", "", ""], ["Cash", "5.5", "%"]], [(0, 0, 1, 2)])], "doc_id string, table_id string, rows array<array<string>>, spans array<struct<r:int,c:int,rs:int,cs:int>>")
    cells = spark.createDataFrame([("d", 2, "T1", "ruled", 0, 0, "raw", True, 1.5)], CELL)
    files = sinks.workbooks(values, checks, grid, cells, (3, 2))
    book = sinks.read_workbook(bytes(files.first()["content"]))
    bare = {n: [r[2:] for r in rows[3:]] for n, rows in book.items()}
    assert bare["t"] == [["Rate", "", ""], ["Cash", "5.5%", ""]] and bare["Raw ruled"][1] == ["raw"]
    assert all(not any(r) for rows in book.values() for r in rows[:3])
    assert [(r.raw_item, r.period, r.number) for r in sinks.workbook_rows(sinks.workbook_cells(files), (3, 2)).collect()] == [("Cash", "2026", 10.0)]
    issues = {(r.sheet, r.problem) for r in S.layout_issues(S.workbook_facts(files)).collect()}
    assert issues == {("t", "merged_cells")}
    plain = {r.problem for r in S.layout_issues(S.workbook_facts(sinks.workbooks(values, checks))).collect()}
    assert plain == {"nonempty_margin", "left_margin_width_1", "left_margin_width_2"}


def edited(content, part, old, new):
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as a, zipfile.ZipFile(out, "w") as b:
        for name in a.namelist():
            text = a.read(name).decode()
            b.writestr(name, text.replace(old, new) if name.endswith(part) else text)
    return out.getvalue()


def test_each_layout_rule_by_a_file_that_breaks_it(spark):
    clean = sinks.workbook({"Sheet": [["Label", 5.0]]}, margins=(3, 2))
    sheet = "sheet1.xml"
    broken = {
        "none": clean,
        "hidden_sheet": edited(clean, "workbook.xml", 'sheetId="1"', 'sheetId="1" state="veryHidden"'),
        "merged_cells": sinks.workbook({"Sheet": [["Label", 5.0]]}, {"Sheet": [(0, 0, 1, 2)]}, (3, 2)),
        "freeze_or_split_panes": edited(clean, sheet, "<cols>", '<sheetViews><sheetView><pane ySplit="1" state="frozen"/></sheetView></sheetViews><cols>'),
        "hidden_or_zero_height_default_rows": edited(clean, sheet, "<cols>", '<sheetFormatPr zeroHeight="1" defaultRowHeight="15"/><cols>'),
        "zero_width_default_columns": edited(clean, sheet, "<cols>", '<sheetFormatPr defaultColWidth="0"/><cols>'),
        "hidden_or_zero_width_column": edited(clean, sheet, "</cols>", '<col min="5" max="6" width="0"/></cols>'),
        "hidden_or_zero_height_row": edited(clean, sheet, '<row r="4">', '<row r="4" hidden="1">'),
        "nonempty_margin": sinks.workbook({"Sheet": [["Label", 5.0]]}, margins=(2, 2)),
        "excel_error_cell": edited(clean, sheet, '<c r="D4">', '<c r="D4" t="e">'),
        "left_margin_width_2": edited(clean, sheet, 'max="2"', 'max="1"'),
        "unreadable_workbook": b"no workbook",
    }
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in broken.items()], "doc_id string, content binary")
    got = {}
    for r in S.layout_issues(S.workbook_facts(files)).collect():
        got.setdefault(r.doc_id, set()).add(r.problem)
    assert got == {k: {k} for k in broken if k != "none"}
    assert {r.problem for r in S.RULES} | {"left_margin_width_2"} == set(broken) - {"none"}
    rows = spark.createDataFrame([("d", "s", "row", 1, None, None, None, None, None, None, None)], S.FACTS)
    assert S.layout_issues(rows).filter(F.col("problem") == "hidden_or_zero_height_row").count() == 0
