from __future__ import annotations

import pytest

from ledgerflow import api
from ledgerflow.plans import pages as P
from ledgerflow.sources import snapshots, text

INCOME = "Statements of Operations\nYears Ended December 31, 2026 2025\nRevenue 10 9\nNet income 5 4"
BALANCE = "Balance Sheets\nDecember 31, 2026 2025\nTotal assets 10 9\nTotal liabilities 4 4"
CASH = "Statements of Cash Flows\nNet income 5 4\nCash at end of period 3 2"
SCHEDULE = "Schedule of Investments\n" + "\n".join(f"Company {i} {i}0.5% {i}00 {i}10" for i in range(1, 9))
MORE = "\n".join(f"Company {i} {i}0.5% {i}00 {i}10" for i in range(1, 9))
NOTES = "Notes to Financial Statements\nNote 1. Organization\nWe are a company."


def plan_of(spark, texts, guides=None, unreadable=()):
    rows = [("d", i, t, i in unreadable) for i, t in enumerate(texts, 1)]
    found = P.automatic_plan(spark.createDataFrame(rows, "doc_id string, page int, text string, unreadable boolean"), guides).orderBy("page").collect()
    return [r["page"] for r in found if r["selected"]], found[0]["review_required"], {r["page"]: r["role"] for r in found}


def test_long_schedule_inside_statements(spark):
    selected, review, _ = plan_of(spark, [BALANCE, INCOME, SCHEDULE, *[MORE] * 30, "Statements of Stockholders' Equity\nBalance at January 1 5 6\nShares issued 1 2", CASH, NOTES])
    assert selected == list(range(1, 36)) and not review


def test_gaps_and_mentions(spark):
    selected, review, roles = plan_of(spark, ["Balance Sheets", "", "Total assets 10 9\nTotal liabilities 4 4", "4", "Total equity 5 5\nCash 1 1"])
    assert selected == [1, 3, 5] and not review and roles[4] == "blank"
    selected, *_ = plan_of(spark, ["Table of Contents\nbalance sheets 3", "The balance sheets show that we grew.", BALANCE, INCOME, CASH])
    assert selected == [3, 4, 5]


def test_ties_and_unreadable_pages_need_a_review(spark):
    far = ["narrative text"] * 6
    assert plan_of(spark, [BALANCE, *far, BALANCE])[:2] == ([1], True)
    selected, review, roles = plan_of(spark, [BALANCE, "", "Total equity 5 5\nCash 1 1"], unreadable={2})
    assert review and roles[2] == "unknown" and selected == [1, 2, 3]


def test_guides(spark):
    guides = spark.createDataFrame([("d", "IncomeStatement", x) for x in ("sales109", "costs43")], "doc_id string, statement_type string, mark string")
    assert plan_of(spark, ["No title\nSales 10 9\nCosts 4 3"], guides)[0] == [1]
    assert plan_of(spark, ["No title\nSales 10 9\nCosts 4 3"])[0] == []


def test_page_specifications(spark):
    frame = spark.createDataFrame([("a", "1-3, 7,x,9-8,40", 10), ("b", "all", 2), ("c", None, 5)], "d string, spec string, page_count int")
    got = sorted((r["d"], r["page"]) for r in P.requested_pages(frame).collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("a", 7), ("b", 1), ("b", 2)]
    assert P.strict_pages("2, 1-3", 5) == [1, 2, 3]
    for bad in ("3-1", "9", "x", ""):
        with pytest.raises(ValueError):
            P.strict_pages(bad, 5)


def test_manual_plan(spark):
    pages = spark.createDataFrame([("d", 1, INCOME, 0, 0), ("d", 2, "Other rows 1 2", 0, 0), ("d", 4, "4", 0, 0), ("d", 5, "", 1, 0), ("d", 6, NOTES, 0, 0)], "doc_id string, page int, text string, n_images int, n_curves int")
    lines = text.page_lines(pages)
    assert {r["source_page"]: r["page_status"] for r in lines.collect()} == {1: "TEXT_EXTRACTED", 2: "TEXT_EXTRACTED", 4: "TEXT_EXTRACTED", 5: "OCR_REQUIRED", 6: "TEXT_EXTRACTED"}
    plan = {r["page"]: r for r in P.manual_plan(lines, pages.select("doc_id", "page")).collect()}
    assert [(plan[p]["role"], plan[p]["statement_type"]) for p in (1, 2, 4, 5, 6)] == [("data", "IncomeStatement"), ("unknown", "IncomeStatement"), ("blank", ""), ("unknown", ""), ("supporting", "")]
    assert not plan[4]["suggested"] and plan[5]["suggested"] and not plan[1]["review_required"]
    with pytest.raises(ValueError):
        P.resolve(lines, "other")


def test_pages_end_to_end(spark):
    rows = [("d", i, 1.0, 1.0, t, 0, 0, None, None, None, None) for i, t in enumerate(["cover", BALANCE, INCOME, CASH, NOTES], 1)]
    captured = spark.createDataFrame(rows, snapshots.PAGE)
    result = api.extract_pages(captured)
    assert {r["source_page"] for r in result.values.collect()} == {2, 3}  # the cash flow page has no period
    assert {r["page"] for r in result.plan.filter("selected").collect()} == {2, 3, 4}
    tied = spark.createDataFrame([(*r[:4], t, *r[5:]) for r, t in zip([(*rows[0][:1], i, *rows[0][2:]) for i in range(1, 9)], [BALANCE, *["x"] * 6, BALANCE], strict=True)], snapshots.PAGE)
    with pytest.raises(api.ReviewRequired):
        api.extract_pages(tied)
    assert api.extract_pages(tied, policy="suggested").values.count() > 0


def test_companions(spark):
    pdf = spark.createDataFrame([("p", "f", "acme", f"Row {i} {i}00") for i in range(10)], "doc_id string, folder string, stem string, line string")
    html = spark.createDataFrame([("same", "f", "ACME", "BalanceSheet", f"row {i} {i}00") for i in range(3)] + [("other", "f", "x", k, f"Row {i} {i}00") for i in range(9) for k in ("BalanceSheet", "IncomeStatement")] + [("few", "f", "y", "BalanceSheet", "Row 1 100"), ("away", "g", "acme", "BalanceSheet", "Row 1 100")], "html_id string, folder string, stem string, statement_type string, line string")
    got = {r["html_id"]: (r["accepted"], r["rank"]) for r in P.companions(pdf, html).collect()}
    assert got == {"same": (True, 1), "other": (True, 2), "few": (False, 3)}
