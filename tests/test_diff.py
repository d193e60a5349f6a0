from __future__ import annotations

import io
import zipfile

import pytest

from ledgerflow import cli, sinks
from ledgerflow.operators import diff as D
from ledgerflow.paths import checked


def test_snapshots(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5), (3, "z", 1)], "k int, v string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 6), (4, "w", 1)], "k int, v string, n int")
    events = D.snapshot_diff(a, b, ["k"], ["v", "n"])
    assert sorted((r["k"], r["code"], tuple(r["changed"])) for r in events.collect()) == [(2, "CHANGED", ("n",)), (3, "REMOVED", ()), (4, "ADDED", ())]
    assert D.snapshot_diff(a, a, ["k"], ["v", "n"]).count() == 0
    ids = {r["k"]: r["issue_id"] for r in events.collect()}
    made = spark.createDataFrame([(ids[2], "ACCEPTED"), (ids[3], "ACCEPTED"), (ids[3], "REJECTED"), ("gone", "ACCEPTED")], "issue_id string, decision string")
    assert {r["k"]: r["state"] for r in D.with_decisions(events, made).collect()} == {2: "ACCEPTED", 3: "CONFLICT", 4: "OPEN"}
    assert [r["issue_id"] for r in D.stale_decisions(events, made).collect()] == ["gone"]


def test_pairs_and_matches(spark):
    rows = lambda *x: spark.createDataFrame([("d", label, v, i) for i, (label, v) in enumerate(x)], "doc string, label string, v int, row int")
    a, b = rows(("cash", 1), ("cash", 1), ("debt", 2), ("gone", 3)), rows(("cash", 1), ("cash", 9), ("debt", 2), ("new", 4))
    got = sorted((r["label"], r["expected"], r["actual"], r["exact"]) for r in D.matched_rows(a, b, ["doc"], "label", "v", ["row"]).collect() if r["expected"] is not None and r["actual"] is not None)
    assert got == [("cash", 1, 1, True), ("cash", 1, 9, False), ("debt", 2, 2, True)]
    assert D.matched_rows(a, b, ["doc"], "label", "v", ["row"]).count() == 5
    assert D.paired(a, b, ["doc", "label"], ["row"]).count() == 5


def test_attempts_and_inputs(spark):
    attempts = spark.createDataFrame([("a", 1, "r"), ("a", 2, None), ("b", 1, "r")], "run_id string, attempt int, receipt string")
    assert [r["run_id"] for r in D.latest_attempts(attempts).collect()] == ["b"]
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "input string")
    assert [r["input"] for r in D.uncovered_inputs(frame("a", "b", "c"), frame("a"), frame("b")).collect()] == ["c"]


def test_workbooks():
    made = sinks.workbook({"A/B": [["=1+1", 5, None, float("nan"), "<&>\x01"]], "A?B": [[1.5]]})
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        book = z.read("xl/workbook.xml").decode()
    assert "<f>" not in sheet and "=1+1" in sheet and "&lt;&amp;&gt;" in sheet and "\x01" not in sheet
    assert 'name="A_B"' in book and book.count("<sheet ") == 2
    with pytest.raises(ValueError):
        sinks.workbook({"empty": []})


def test_paths():
    assert checked(" /data/x ") == "/data/x" and checked("file://localhost/x") == "file:///x"
    for bad in ("", "\\\\server\\share", "//server/share", "C:\\con", "file://host/x", "a\0b"):
        with pytest.raises(ValueError):
            checked(bad)
    assert checked("//server/share", allow_nonlocal=True)


def test_command_line(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.html").write_text("<h2>Statements of Cash Flows</h2><table><tr><td>Years Ended December 31,</td><td>2026</td><td>2025</td></tr><tr><td>Net income</td><td>3</td><td>2</td></tr><tr><td>Dividends paid</td><td>3</td><td>2</td></tr></table>")
    (source / "b.txt").write_text("x")
    assert cli.main([str(source), str(tmp_path / "out"), "--workbooks"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "values")).count() == 4
    assert spark.read.parquet(str(tmp_path / "out" / "workbooks")).count() == 1
    assert cli.main(["\\\\server\\x", str(tmp_path / "out2")], spark) == 2


def test_streaming(spark, tmp_path):
    from ledgerflow.streaming.ingest import watch_html

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.html").write_text("<h2>Statements of Cash Flows</h2><table><tr><td>Years Ended December 31,</td><td>2026</td><td>2025</td></tr><tr><td>Net income</td><td>3</td><td>2</td></tr><tr><td>Dividends paid</td><td>3</td><td>2</td></tr></table>")
    stream = watch_html(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"))
    stream.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "values")).count() == 4


def test_workbooks_read_back(spark):
    values = spark.createDataFrame(
        [("d", "BalanceSheet", 1, "Cash", "Cash", p, v, n, k, False) for p, v, n, k in (("2026", "5.25", 5.25, 2), ("2025", "4", 4.0, 0))] + [("d", "BalanceSheet", 2, "Total assets", "Total Assets", "2026", "=9", 9.0, 0, False), ("d", "BalanceSheet", 3, "Rate", "Rate", "2026", "7%", 7.0, 0, True), ("d", "BalanceSheet", 4, "Other", "Other", "2025", "—", None, None, False)],
        "doc_id string, statement_type string, row_index int, raw_item string, standard_item string, period string, raw_value string, parsed_value double, precision int, is_percent boolean",
    )
    checks = spark.createDataFrame([("d", 2, "c", "s", "WARN", None), ("e", 1, "c", "s", "FAIL", "no rows")], "doc_id string, severity int, Check string, Scope string, Status string, Detail string")
    grids = spark.createDataFrame([("d", "StockholdersEquityStatement", "T2", [["Opening", "1"], ["Closing", "2"]], ["Common"], None, [(0, 2, "Year 2026")]), ("d", "BalanceSheet", "T1", [["Head", "", ""], ["a", "b", "c"]], None, [(0, 0, 1, 3), (0, 1, 1, 2)], None)], f"doc_id string, statement_type string, table_id string, rows array<array<string>>, labels array<string>, spans {sinks._GRID}, sections array<struct<start: int, end: int, caption: string>>")
    made = sinks.workbooks(values, checks, grids)
    book = made.collect()
    assert [r["doc_id"] for r in book] == ["d"]
    sheets = sinks.read_workbook(bytes(book[0]["content"]))
    assert list(sheets) == ["BalanceSheet", "T1 BalanceSheet", "T2 StockholdersEquityStatement", "Review"]
    assert sheets["BalanceSheet"] == [["Item", "Standard item", "2026", "2025"], ["Cash", "Cash", 5.25, 4.0], ["Total assets", "Total Assets", 9.0], ["Rate", "Rate", 7.0], ["Other", "Other", None, "—"]]
    assert sheets["T2 StockholdersEquityStatement"][:4] == [["Year 2026"], ["", "Common"], ["Opening", "1"], ["Closing", "2"]]
    with zipfile.ZipFile(io.BytesIO(bytes(book[0]["content"]))) as z:
        assert z.read("xl/worksheets/sheet2.xml").decode().count("<mergeCell ") == 1
        assert f's="{sinks.Number(1, 2).style}"' in z.read("xl/worksheets/sheet1.xml").decode() and f's="{sinks.Number(1, 0, False, True).style}"' in z.read("xl/worksheets/sheet1.xml").decode()
    files = made.unionByName(spark.createDataFrame([("bad", bytearray(b"x")), ("none", None)], "doc_id string, content binary"))
    cells = sinks.workbook_cells(files)
    assert {r["doc_id"] for r in cells.filter("error IS NOT NULL").collect()} == {"bad", "none"}
    got = sorted((r["raw_item"], r["period"], r["number"], r["text"]) for r in sinks.workbook_rows(cells).collect())
    assert got == sorted([("Cash", "2026", 5.25, None), ("Cash", "2025", 4.0, None), ("Total assets", "2026", 9.0, None), ("Rate", "2026", 7.0, None), ("Other", "2025", None, "—")])
    assert sinks.free_name(["A.xlsx", "a (2).xlsx"], "a.xlsx") == "a (3).xlsx" and sinks.free_name([], "a") == "a"
    assert sinks.markdown(checks.filter("doc_id = 'e'"), 5).splitlines()[2:] == ["| e | 1 | c | s | FAIL | no rows |", "", "1 of 1 rows."]
