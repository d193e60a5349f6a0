from __future__ import annotations

import random

import pytest

from ledgerflow import api
from ledgerflow.operators import completeness as K
from ledgerflow.operators import geometry
from ledgerflow.operators import layouts as Y
from ledgerflow.sources import snapshots


def word(text, x0, top, width=None):
    return {"text": text, "x0": float(x0), "x1": float(x0 + (width or 4 * len(text))), "top": float(top), "bottom": float(top + 8)}


def balance_page(change=None):
    """A label column and two dated ones; dollar signs stand in narrow cells."""
    heads = [word("June", 200, 80), word("30,", 218, 80), word("2026", 232, 80), word("June", 300, 80), word("30,", 318, 80), word("2025", 332, 80)]
    body = [("Assets", None, None), ("Cash", "10", "9"), ("Total assets", "10", "9"), ("Liabilities and equity", None, None), ("Stock, par value", "10", "9")]
    body = change(body) if change else body
    words, rows, extracted, text = list(heads), [], [], ["Balance Sheets", "June 30, 2026 June 30, 2025"]
    for i, (label, *amounts) in enumerate(body):
        top = 100 + 12 * i
        line, at = label.split(), 0
        for w in line:
            words.append(word(w, at, top))
            at += 4 * len(w) + 4
        cells, values = [[0, top - 1, 180, top + 10]], [label]
        for k, amount in enumerate(amounts):
            left = 200 + 100 * k
            cells += [[left, top - 1, left + 8, top + 10], [left + 8, top - 1, left + 80, top + 10]]
            if amount:
                words += [word("$", left, top, 4), word(amount, left + 40, top)]
            values += ["$", amount] if amount else ["", ""]
        rows.append(cells)
        extracted.append(values)
        text.append(" ".join([label, *(f"$ {a}" for a in amounts if a)]))
    rows.insert(0, [[0, 95, 180, 99], [200, 95, 280, 99], [300, 95, 380, 99]])
    extracted.insert(0, ["", "", ""])
    text.append("See accompanying notes")
    return {"width": 400.0, "text": "\n".join(text), "words": words, "edges": [], "tables": [{"bbox": [0, 95, 380, 200], "rows": rows, "extracted": extracted}]}


def capture(pages):
    """(kind, page) as rows of a snapshot table, and a plan that selects them."""
    plain = lambda x: [plain(v) for v in x] if isinstance(x, list) else None if x is None else float(x)
    rows = [("d", n, p["width"], 500.0, p["text"], 0, 0, p["words"], [{"bbox": plain(t["bbox"]), "cells": [], "rows": plain(t["rows"]), "extracted": t["extracted"]} for t in p["tables"]], None, p.get("edges") or None) for n, (_, p) in enumerate(pages, 1)]
    return rows, [("d", n, kind, True) for n, (kind, _) in enumerate(pages, 1)]


PLAN = "doc_id string, page int, statement_type string, selected boolean"


def grids_of(spark, pages):
    rows, plan = capture(pages)
    found = Y.recovered(spark.createDataFrame(rows, snapshots.PAGE), spark.createDataFrame(plan, PLAN)).collect()
    return [r for _, r in sorted((r["source_page"], r) for r in found)]


def in_one_cell(page, edges=()):
    """Each row of amounts as one cell across all dates."""
    table = page["tables"][0]
    for i, (values, cells) in enumerate(zip(table["extracted"], table["rows"], strict=True)):
        if i and any(v for v in values[1:]):
            table["rows"][i], table["extracted"][i] = [[0, cells[0][1], 380, cells[0][3]]], [" ".join(v for v in values if v)]
    return page | {"edges": [{"x0": x, "x1": x + 80.0, "top": 95.0, "bottom": 95.5} for x in edges]}


def test_balance_geometry(spark):
    def with_words(page, *more):
        return page | {"words": [*page["words"], *more]}

    changed = {"one amount": lambda b: [b[0], ("Cash", "10", None), *b[2:]], "two numbers": lambda b: [b[0], ("Cash", "10 5", "9"), *b[2:]]}
    noted = balance_page()
    noted["tables"][0]["rows"].insert(1, [[0, 88, 180, 94], [200, 88, 280, 94], [300, 88, 380, 94]])
    noted["tables"][0]["extracted"].insert(1, ["", "(unaudited)", ""])
    hidden, unnoted, undated, loose, stray = (balance_page() for _ in range(5))
    hidden["text"] = hidden["text"].replace("See accompanying", "Hidden 5 6\nSee accompanying")
    unnoted["text"] = unnoted["text"].replace("See accompanying notes", "")
    undated["words"] = undated["words"][6:]
    loose["tables"][0]["extracted"][2][2] = "11"
    stray["tables"][0]["rows"][2][1] = [150, 111, 208, 122]
    cases = {
        "whole": balance_page(), "noted": with_words(noted, word("(unaudited)", 210, 89, 40)), "ruled": in_one_cell(balance_page(), (200.0, 300.0)), "no rules": in_one_cell(balance_page()), "rules that overlap": in_one_cell(balance_page(), (200.0, 260.0)),
        "a word between": with_words(in_one_cell(balance_page(), (200.0, 300.0)), word("77", 278, 112)), "hidden row": hidden, "no notes": unnoted, "no dates": undated, "other text": loose, "a cell across": stray,
        **{k: balance_page(c) for k, c in changed.items()}, "no table": balance_page() | {"tables": []}, "two tables": balance_page() | {"tables": balance_page()["tables"] * 2},
    }
    got = dict(zip(cases, grids_of(spark, [("BalanceSheet", p) for p in cases.values()]), strict=True))
    for name in ("whole", "noted", "ruled"):
        r = got[name]
        assert r["error"] is None and r["labels"] == ["June 30, 2026", "June 30, 2025"] and r["source_note"] == "See accompanying notes"
        assert r["rows"] == [["Assets", "", ""], ["Cash", "$ 10", "$ 9"], ["Total assets", "$ 10", "$ 9"], ["Liabilities and equity", "", ""], ["Stock, par value", "$ 10", "$ 9"]]
        assert r["row_kinds"] == ["section", "data", "data", "section", "data"] and r["table_id"].endswith("BALANCE_GEOMETRY_01")
    assert got["whole"]["notes"] == ["", ""] and got["noted"]["notes"] == ["(unaudited)", ""]
    why = {k: r["error"] for k, r in got.items() if r["error"]}
    say = geometry.BALANCE_UNCLEAR
    assert why == {"no rules": say["columns"], "rules that overlap": say["columns"], "a word between": say["cells"], "hidden row": say["body"], "no notes": say["bounds"], "no dates": say["dates"], "other text": say["cells"], "a cell across": say["cells"], "one amount": say["rows"], "two numbers": say["rows"], "no table": say["table"], "two tables": say["table"]}
    assert all(r["rows"] is None for r in got.values() if r["error"])


def test_amounts_that_end_like_their_line(spark):
    page = balance_page(lambda b: [b[0], ("Cash", "10", "93"), ("Total assets", "14", "4"), *b[3:]])
    found = grids_of(spark, [("BalanceSheet", page)])[0]
    assert found["error"] is None and found["rows"][1:3] == [["Cash", "$ 10", "$ 93"], ["Total assets", "$ 14", "$ 4"]]


def equity_page():
    heads = [word("Common", 205, 60), word("Stock", 233, 60, 60), word("Shares", 205, 72), word("Amount", 255, 72), word("Total", 305, 72)]
    body = [("Balance at January 1, 2026", "5", "50", "55"), ("Issuance of stock", "1", "10", "11"), ("Issuance of stock", "1", "10", "11"), ("Total changes for the year ended December 31, 2026", "2", "20", "22"), ("Balance at December 31, 2026", "7", "70", "77")]
    words, text = list(heads), ["Statements of Equity"]
    for i, (label, *amounts) in enumerate(body):
        top = 100 + 12 * i
        step = 190 / max(1, len(label.split()))
        words += [word(w, k * step, top, step - 3) for k, w in enumerate(label.split())]
        words += [word(a, 205 + 50 * k, top) for k, a in enumerate(amounts)]
        text.append(" ".join([label, *amounts]))
    row = [[0, 95, 200, 110], [200, 95, 250, 110], [250, 95, 300, 110], [300, 95, 350, 110]]
    return {"width": 400.0, "text": "\n".join(text), "words": words, "tables": [{"bbox": [0, 95, 350, 110], "rows": [row], "extracted": [[""] * 4]}]}


def test_equity_geometry(spark):
    heads = equity_page()["words"][:5]
    hidden, headless, twins, uneven = (equity_page() for _ in range(4))
    hidden["text"] = hidden["text"].replace("Balance at December", "Extra row 1 2 3\nBalance at December")
    headless["words"] = [w for w in headless["words"] if w["text"] != "Total" or w["top"] > 80]
    twins["words"] = [w | {"text": "Amount"} if w["text"] == "Shares" else w for w in twins["words"]]
    uneven["tables"] = [*uneven["tables"], {"bbox": [0, 120, 350, 130], "rows": [[[0, 120, 200, 130], [200, 120, 255, 130], [255, 120, 300, 130], [300, 120, 350, 130]]], "extracted": [[""] * 4]}]
    parts = equity_page()
    down = [w | {"top": w["top"] + 100, "bottom": w["bottom"] + 100} for w in parts["words"]]
    numbered = lambda year, top: [word("Twelve", 0, top, 8), *[word(t, 10 + 24 * i, top, 20) for i, t in enumerate(["months", "ended", "June", "30,", year])]]
    parts["words"] = [*numbered("2026", 88), *parts["words"], *numbered("2025", 155), *down]
    parts["text"] = "\n".join([parts["text"], "Twelve months ended June 30, 2025", *parts["text"].split("\n")[1:]])
    other = parts | {"words": [w | {"text": "Units"} if w["text"] == "Shares" and w["top"] > 150 else w for w in parts["words"]]}
    cases = {"whole": equity_page(), "parts": parts, "hidden row": hidden, "no head": headless, "equal heads": twins, "other columns": uneven, "other heads below": other, "no table": equity_page() | {"tables": []}, "no rows": equity_page() | {"words": heads}}
    got = dict(zip(cases, grids_of(spark, [("StockholdersEquityStatement", p) for p in cases.values()]), strict=True))
    r = got["whole"]
    assert r["error"] is None and r["rows"][:2] == [["", "Common Stock", "", ""], ["", "Shares", "Amount", "Total"]] and r["row_kinds"] == ["parent_header", "header", *["data"] * 5]
    assert r["labels"] == ["Shares", "Amount", "Total"] and [tuple(x) for x in r["sections"]] == [(2, 7, "year ended December 31, 2026")]
    assert [x for x in r["rows"] if x[0] == "Issuance of stock"] == [["Issuance of stock", "1", "10", "11"]] * 2
    assert got["parts"]["error"] is None and [tuple(x) for x in got["parts"]["sections"]] == [(2, 7, "Twelve months ended June 30, 2026"), (7, 12, "Twelve months ended June 30, 2025")]
    say = geometry.EQUITY_UNCLEAR
    assert {k: r["error"] for k, r in got.items() if r["error"]} == {"hidden row": say["text"], "no head": say["heads"], "equal heads": say["heads"], "other columns": say["disagree"], "other heads below": say["heads"], "no table": say["columns"], "no rows": say["data"]}


def test_columns_of_rules_by_brute_force(spark):
    rng = random.Random(6)
    edges, want = [], {}
    for page in range(12):
        places = sorted(rng.sample(range(0, 400, 25), 6))
        for _ in range(4):
            for a, b in zip(places, places[1:], strict=False):
                if rng.random() < 0.7:
                    edges.append(("d", page, a + rng.uniform(-0.9, 0.9), b + rng.uniform(-0.9, 0.9)))
        edges.append(("d", page, float(places[0]), float(places[-1])))
        edges.append(("d", page, 3.0, 9.0))
    for page in range(12):
        own = [(x0, x1) for _, p, x0, x1 in edges if p == page and x1 - x0 >= 15]
        ends, islands = sorted(x for e in own for x in e), []
        for x in ends:
            if not islands or x - islands[-1][-1] > 2:
                islands.append([])
            islands[-1].append(x)
        at = lambda x: next(i for i, c in enumerate(islands) if x in c)  # noqa: B023, E731
        mean = lambda i: round(sum(islands[i]) / len(islands[i]), 6)  # noqa: B023, E731
        want[page] = sorted({(mean(at(a)), mean(at(b))) for a, b in own if at(b) == at(a) + 1})
    got = {r.page: [(round(c["lo"], 6), round(c["hi"], 6)) for c in r.columns] for r in geometry.columns_of_rules(spark.createDataFrame(edges, "doc_id string, page int, x0 double, x1 double")).collect()}
    assert got == want


def test_raw_component_grids_without_checks(spark):
    page = equity_page()
    edges = spark.createDataFrame([("d", 1, float(a), float(b)) for a, b in ((0, 200), (200, 250), (250.5, 299.5), (300, 350))], "doc_id string, page int, x0 double, x1 double")
    words = spark.createDataFrame([("d", 1, w["text"], w["x0"], w["x1"], w["top"], w["bottom"]) for w in page["words"]], "doc_id string, page int, text string, x0 double, x1 double, top double, bottom double")
    rows = geometry.raw_component_grids(geometry.lines_of_words(words), edges).first()["rows"]
    assert rows[0] == ["", "Common", "Stock", ""] and rows[1] == ["", "Shares", "Amount", "Total"] and rows[2] == ["Balance at January 1, 2026", "5", "50", "55"] and len(rows) == 7


def test_recovery_over_pages(spark):
    rows, plan = capture([("BalanceSheet", balance_page()), ("StockholdersEquityStatement", equity_page()), ("BalanceSheet", {**balance_page(), "tables": []})])
    captured, plan = spark.createDataFrame(rows, snapshots.PAGE), spark.createDataFrame([*plan, ("d", 4, "BalanceSheet", True)], PLAN)
    got = {r["source_page"]: r for r in Y.recovered(captured, plan).collect()}
    assert got[1]["error"] is None and got[2]["labels"] == ["Shares", "Amount", "Total"] and got[3]["error"]
    found = Y.recovered(captured, plan)
    checks = {(r["Check"], r["Scope"]): r["Status"] for r in api._grid_checks(found.filter("error IS NULL")).collect()}
    assert checks["Equity beginning + change = ending", "year ended December 31, 2026 / Total"] == "PASS"
    coverage = {r["Scope"]: r["Status"] for r in K.page_coverage(plan, found.filter("error IS NULL")).collect()}
    assert coverage == {"Page 1 / BalanceSheet": "PASS", "Page 2 / StockholdersEquityStatement": "PASS", "Page 3 / BalanceSheet": "FAIL", "Page 4 / BalanceSheet": "FAIL"}


def test_cash_blocks():
    text = "Statements of Cash Flows\nYears Ended December 31, 2026 2025\nOperating activities:\nNet income 100 90\nChanges in\ninterest payable 5 (6)\nInterest payable 5 (6)\nAs of\nDecember 31, 2026 December 31, 2025\nCash 5 6\nSee accompanying notes\nNot this 1 2"
    blocks = Y.cash_blocks(list(enumerate(text.split("\n"), 1)))
    assert [b["labels"] for b in blocks] == [["2026", "2025"], ["December 31, 2026", "December 31, 2025"]]
    assert [r[0] for r in blocks[0]["rows"]] == ["Operating activities:", "Net income", "Changes in interest payable", "Interest payable"]
    for bad in ("Net income 1 2", "2026 2025\nNet income 1 2 3", "2026 2026\nNet income 1 2"):
        with pytest.raises(Y.Unclear):
            Y.cash_blocks(list(enumerate(bad.split("\n"), 1)))


def test_income_columns():
    four = ["Three Months Ended June 30, 2026", "Three Months Ended June 30, 2025", "Six Months Ended June 30, 2026", "Six Months Ended June 30, 2025"]
    assert Y.income_periods(["Three Months Ended June 30, Six Months Ended June 30,", "2026 2025 2026 2025"]) == (four, "")
    assert Y.income_periods(["For the Three Months", "Ended June 30,", "For the Six Months", "Ended June 30,", "2026 2025 2026 2025"]) == (four, "")
    labels, warning = Y.income_periods(["Three Months Ended June 30, Six Months Ended June 30,", "2026 2025 2024"])
    assert labels == ["2026", "2025", "2024"] and warning
    words = [word("Three", 100, 10), word("Months", 124, 10), word("Six", 200, 10), word("Months", 216, 10), *(word(y, x, 30) for y, x in (("2026", 100), ("2025", 200), ("2024", 300)))]
    labels, warning = Y.income_periods(["Three Months Ended June 30, Six Months Ended June 30,", "2026 2025 2024"], Y.spans_fit(words))
    assert labels == ["Three Months Ended June 30, 2026", "Six Months Ended June 30, 2025", "Six Months Ended June 30, 2024"] and not warning


def test_amounts_in_one_cell():
    assert Y.expanded_amounts(["Balance at June 30, 2025 123 (456)"]) == ["Balance at June 30, 2025", "123", "(456)"]
    assert Y.expanded_amounts(["June 32 2025 123"]) == ["June", "32", "2025", "123"]
    assert Y.expanded_amounts(["Assets $   7234 $60"]) == ["Assets", "$7234", "$60"]
    assert Y.expanded_amounts(["Assets", "$", None, "5", "x $"]) == ["Assets", "$5", "x $"]


def test_completeness(spark):
    lines = ["Assets", "Total assets 10", "Liabilities", "Total liabilities 4", "Equity", "Total equity 6", "See accompanying notes"]
    text = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(lines)], "doc_id string, source_page int, line_no int, raw_text string")
    page = spark.createDataFrame([("d", 1)], "doc_id string, source_page int")
    grid = lambda rows: spark.createDataFrame([("d", 1, rows)], "doc_id string, source_page int, rows array<array<string>>")
    whole = [["Assets", ""], ["Total assets", "10"], ["Liabilities", ""], ["Total liabilities", "4"], ["Equity", ""], ["Total equity", "6"]]
    status = lambda t, g: [r["Status"] for r in K.balance_completeness(t, g, page).collect()]
    assert status(text, grid(whole)) == ["PASS"]
    assert status(text, grid(whole[:3] + whole[4:])) == ["FAIL"]
    assert status(text, grid(whole).limit(0)) == ["FAIL"]
    assert status(text.filter("line_no > 0"), grid(whole)) == ["NOT_TESTED"]


def test_row_coverage_and_reconciliation(spark):
    grid = lambda rows, label="June 30, 2026": spark.createDataFrame([("d", "t", 1, rows, ["data"] * len(rows), [label])], "doc_id string, table_id string, source_page int, rows array<array<string>>, row_kinds array<string>, period_labels array<string>")
    source = spark.createDataFrame([("d", 1, "Cash (1)", [5.0]), ("d", 1, "Cash", [5.0])], "doc_id string, source_page int, label string, values array<double>")
    assert [r["Status"] for r in K.row_coverage(source, grid([["Cash", "5"], ["Cash", "5"]])).collect()] == ["PASS"]
    got = K.row_coverage(source, grid([["Cash", "5"]])).first()
    assert (got["Status"], got["missing"], got["labels"]) == ("WARN", 1, ["cash"])
    units = spark.createDataFrame([("d", "millions", "USD"), ("d", "millions", "USD")], "doc_id string, unit_label string, currency string")
    cash, balance = grid([["Bank", "5"], ["Held", "—"], ["Other", "1"], ["Total cash", "6"]]), grid([["Bank", "5"], ["Held", "-"], ["Loans", "2"]])
    assert {r["Scope"].split(" / ")[1]: r["Status"] for r in K.reconciliation(cash, balance, units).collect()} == {"bank": "PASS", "held": "PASS", "other": "NOT_TESTED"}
    mixed = units.unionByName(spark.createDataFrame([("d", "thousands", "USD")], units.schema))
    assert {r["Status"] for r in K.reconciliation(cash, balance, mixed).collect()} == {"NOT_TESTED"}


def income_words(rows):
    """rows of (top, [(text, x0)])."""
    return [word(t, x, top) for top, line in rows for t, x in line]


def test_income_rows():
    lines = [(1, "Years Ended December 31,"), (2, "2026 2025 2024"), (3, "Revenue 10 5"), (4, "—"), (5, "Costs $ 4$ 3$ 2"), (6, "Other 1 2"), (7, "Net 6 7 8")]
    words = income_words([(10, [("Years", 0), ("Ended", 24), ("December", 48), ("31,", 84)]), (20, [("2026", 100), ("2025", 150), ("2024", 200)]), (30, [("Revenue", 0), ("10", 104), ("5", 206)]), (33, [("—", 154)]), (60, [("Other", 0), ("1", 104), ("2", 152)])])
    got = {no: (text, how) for no, text, how in Y.repaired_rows(lines, words, 300.0, ["2026", "2025", "2024"])}
    assert got[3] == ("Revenue 10 — 5", "offset_dash_row_geometry") and got[4] == (None, "offset_dash_row_geometry")
    assert got[5] == ("Costs $ 4 $ 3 $ 2", "adjacent_currency_separator")
    assert got[6][0] == "Other 1 2" and got[6][1].startswith("Incomplete") and set(got) == {3, 4, 5, 6}


def test_income_repairs_over_pages(spark):
    lines = [(1, "2026 2025 2024"), (2, "Revenue 10 5"), (3, "—")]
    words = income_words([(20, [("2026", 100), ("2025", 150), ("2024", 200)]), (30, [("Revenue", 0), ("10", 104), ("5", 206)]), (33, [("—", 154)])])
    frame = spark.createDataFrame([("d", 1, n, t, "IncomeStatement") for n, t in lines] + [("d", 2, 1, "x", "BalanceSheet")], "doc_id string, source_page int, line_no int, raw_text string, statement_type string")
    captured = spark.createDataFrame([("d", 1, 300.0, 400.0, "", 0, 0, words, None, None, None)], snapshots.PAGE)
    assert sorted((r["line_no"], r["text"]) for r in Y.income_repairs(frame, captured).collect()) == [(2, "Revenue 10 — 5"), (3, None)]
