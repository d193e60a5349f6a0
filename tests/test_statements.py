from __future__ import annotations

from ledgerflow import api
from ledgerflow.functions import lines as L

CASH = """Example Company
Statements of Cash Flows
Years Ended December 31, 2026 2025
Operating Activities
Net income 100 90
Net increase in cash and cash equivalents 20 10
Cash and cash equivalents at beginning of period 30 20
Cash and cash equivalents at end of period 50 30"""
BALANCE = """Balance Sheets
(In millions)
December 31, 2026 December 31, 2025
Current assets:
Cash and cash equivalents $ 60 $ 50
Accounts receivable,
net 5 (4)
65 46
Goodwill 10 —
Total assets 75 46
Total liabilities 40 N/A
Total equity 35 20"""


def values_of(result):
    return {(r["standard_item"], r["period"]): (r["parsed_value"], r["parse_status"]) for r in result.values.collect()}


def checks_of(result):
    return {(r["Check"], r["Scope"]): r["Status"] for r in result.checks.collect()}


def test_cash_flow(spark):
    result = api.extract_text(spark, {"d": CASH})
    got = values_of(result)
    assert {p for _, p in got} == {"2026", "2025"}
    assert got["Cash and Cash Equivalents at End of Period", "2026"] == (50, "NUMERIC")
    checks = checks_of(result)
    assert checks["Beginning cash + change = ending cash", "2026"] == checks["Beginning cash + change = ending cash", "2025"] == "PASS"
    assert result.companies.first()["company"] == "Example Company"


def test_balance_sheet_with_wrapped_and_unlabelled_rows(spark):
    result = api.extract_text(spark, {"d": BALANCE})
    got = values_of(result)
    assert got["Accounts Receivable, Net", "December 31, 2025"] == (-4, "NUMERIC")
    assert got["Goodwill", "December 31, 2025"] == (None, "DASH") and got["Total Liabilities", "December 31, 2025"] == (None, "NA")
    inferred = result.rows.filter("mapping_relationship = 'inferred'").collect()
    assert [(r["standard_item"], r["raw_item"], r["values"]) for r in inferred] == [("Total Current Assets", "", ["65", "46"])]
    assert {r["context"] for r in result.rows.filter("standard_item = 'Goodwill'").collect()} == {"ASSET"}
    checks = checks_of(result)
    assert checks["Assets = liabilities + equity", "December 31, 2026"] == "PASS"
    assert checks["Balance sheet equation", "December 31, 2025"] == "NOT_TESTED"
    assert {r["unit"]["scale_factor"] for r in result.units.collect()} == {1_000_000}


def test_no_period_no_statement(spark):
    result = api.extract_text(spark, {"d": "Statements of Operations\nRevenue 5 6"})
    assert result.values.count() == 0
    assert checks_of(result)["Statement period detection", "IncomeStatement"] == "FAIL"


def test_equity_needs_a_grid(spark):
    result = api.extract_text(spark, {"d": "Statements of Stockholders' Equity\n2026 2025\nBalance 1 2"})
    assert checks_of(result)["Equity column layout", "StockholdersEquityStatement"] == "NOT_TESTED"


def test_a_bad_filing_leaves_others_alone(spark):
    result = api.extract_text(spark, {"a": CASH, "b": "", "c": "nothing of interest", "e": BALANCE})
    assert {r["doc_id"] for r in result.values.select("doc_id").distinct().collect()} == {"a", "e"}


def test_headings_and_sections():
    assert L.heading_type("CONSOLIDATED BALANCE SHEETS (Unaudited)") == "BalanceSheet"
    assert L.heading_type("Acme Inc. and Subsidiaries Consolidated Statements of Cash Flows") == "CashFlowStatement"
    assert L.heading_type("see the balance sheets for more") is None
    assert L.mentioned_type("see the balance sheets for more") == "BalanceSheet"


def test_period_labels():
    interim = ["Three Months Ended June 30, Six Months Ended June 30,", "2025 2024 2025 2024"]
    assert L.period_labels(interim) == ["Three Months Ended June 30, 2025", "Three Months Ended June 30, 2024", "Six Months Ended June 30, 2025", "Six Months Ended June 30, 2024"]
    assert L.period_labels(["As of June 30, 2025 and June 30, 2024"]) == ["June 30, 2025", "June 30, 2024"]
    assert L.period_labels(["nothing", "here"]) == []
    assert L.class_columns(["Class A-B Class A-I Total"]) == ["Class A-B", "Class A-I", "Total"]
    assert L.schedule_columns(["Principal Amount Cost Fair Value cost"]) == ["Principal Amount", "Cost", "Fair Value"]


def test_row_splits():
    assert L.split_row("Net income 100 (90)", 2) == ("Net income", ["100", "(90)"])
    assert L.split_row("Shares authorized as of December 31, 2025", 2) is None
    assert L.split_row("Total ($5)", 1) is None  # a line of text takes $ (5) only; a cell takes both
    assert L.split_values_first("100 90 Net income", 2) == ("Net income", ["100", "90"])
    assert L.amounts_left_in("Net income 5") and not L.amounts_left_in("Debt (Note 5)") and not L.amounts_left_in("Change since 2024")


def test_units_of_lines():
    from ledgerflow.operators.statements import Row, condensed

    texts = ["Balance Sheets", "Current assets:", "Cash 5 4", "5 4", "7 6", "Liabilities and", "shareholders' equity:", "Loans due", "within a year 3 2", "some text", "ASSETS", "Goodwill", "1 2", "8 9"]
    got = [(r.text, r.line, r.inferred) for r in condensed([Row(t, 1, k) for k, t in enumerate(texts)], 2, "BalanceSheet")]
    assert got == [
        ("Balance Sheets", 0, False), ("Current assets:", 1, False), ("Cash 5 4", 1, False), ("Total current assets 5 4", 3, True), ("Total assets 7 6", 4, True),
        ("Liabilities and shareholders' equity:", 5, False), ("Loans due within a year 3 2", 5, False), ("some text", 9, False), ("ASSETS", 10, False), ("Goodwill 1 2", 11, False),
    ]
    many = [Row(t, 1, k) for k, t in enumerate(["Current assets:", "Cash 1 1", "1 1"] * 150)]
    assert sum(r.text == "Total current assets 1 1" for r in condensed(many, 2, "BalanceSheet")) == 150
