from __future__ import annotations

import pytest

from ledgerflow.operators import audits as A

VALUES = "doc_id string, statement_type string, period string, standard_item string, context string, mapping_relationship string, parsed_value double"


def frame(spark, rows, kind="BalanceSheet"):
    return spark.createDataFrame([("d", kind, "2026", item, context, relation, value) for item, context, relation, value in rows], VALUES)


GOOD = [("Total Assets", "ASSET", "exact_concept", 100.0), ("Total Liabilities", "LIABILITY", "exact_concept", 60.0), ("Total Equity", "EQUITY", "exact_concept", 40.0)]


@pytest.mark.parametrize(
    ("rows", "status"),
    [
        (GOOD, "PASS"),
        (GOOD[1:], "NOT_TESTED"),
        (GOOD[:2], "NOT_TESTED"),
        ([*GOOD, GOOD[0]], "NOT_TESTED"),
        ([("Total Assets", "ASSET", "related", 100.0), *GOOD[1:]], "NOT_TESTED"),
        ([("Total Assets", "ASSET", "inferred", 100.0), *GOOD[1:]], "NOT_TESTED"),
        ([("Total Assets", "ASSET", "exact_concept", float("nan")), *GOOD[1:]], "NOT_TESTED"),
        ([("Total Assets", "ASSET", "exact_concept", float("inf")), *GOOD[1:]], "NOT_TESTED"),
        ([("Total Assets", "ASSET", "exact_concept", None), *GOOD[1:]], "NOT_TESTED"),
        ([("Total Assets", "ASSET", "exact_concept", 103.0), *GOOD[1:]], "FAIL"),
        ([*GOOD, ("Total Liabilities and Equity", "X", "exact_concept", 90.0)], "FAIL"),
    ],
)
def test_balance_equation(spark, rows, status):
    got = [r["Status"] for r in A.balance_checks(frame(spark, rows)).collect() if "subtotal" not in r["Check"]]
    assert got == [status]


def test_subtotals(spark):
    parts = [("Cash", "CURRENT_ASSET", "related", 60.0), ("Inventories", "CURRENT_ASSET", "related", 5.0)]
    total = ("Total Current Assets", "ASSET", "exact_concept", 65.0)
    status = lambda rows: {r["Check"]: r["Status"] for r in A.balance_checks(frame(spark, rows)).collect()}["Current asset subtotal"]
    assert status([*GOOD, *parts, total]) == "PASS"
    assert status([*GOOD, parts[0], total]) == "NOT_TESTED"
    assert status([*GOOD, *parts]) == "NOT_TESTED"
    assert status([*GOOD, *parts, parts[0], total]) == "FAIL"


def grid(spark, rows, kinds, periods=("2026",), sources=None):
    return spark.createDataFrame([("d", "t", [list(r) for r in rows], list(kinds), list(periods), sources or [f"s{i}" for i in range(len(rows))])], "doc_id string, table_id string, rows array<array<string>>, row_kinds array<string>, period_labels array<string>, row_sources array<string>")


CORPORATE = [
    ("Current assets:", "section", ""), ("Cash", "data", "60"), ("Receivables", "data", "40"), ("Total current assets", "data", "100"),
    ("Non-current assets:", "section", ""), ("Plant", "data", "200"), ("Total non-current assets", "data", "200"), ("Total assets", "data", "300"),
    ("Current liabilities:", "section", ""), ("Payables", "data", "50"), ("Total current liabilities", "data", "50"),
    ("Non-current liabilities:", "section", ""), ("Debt", "data", "100"), ("Total non-current liabilities", "data", "100"), ("Total liabilities", "data", "150"),
    ("Stockholders' equity:", "section", ""), ("Stock", "data", "160"), ("Deficit", "data", "(10)"), ("Total stockholders' equity", "data", "150"),
    ("Total liabilities and stockholders' equity", "data", "300"),
]


def corporate(spark, rows):
    made = A.corporate_balance_checks(grid(spark, [(a, c) for a, _, c in rows], [k for _, k, _ in rows])).collect()
    return {r["Check"].removeprefix("Balance sheet: "): r["Status"] for r in made}


def test_nine_checks(spark):
    assert set(corporate(spark, CORPORATE).values()) == {"PASS"} and len(corporate(spark, CORPORATE)) == 9
    changed = [(a, k, "63" if a == "Cash" else c) for a, k, c in CORPORATE]
    got = corporate(spark, changed)
    assert got.pop("current assets") == "FAIL" and set(got.values()) == {"PASS"}


@pytest.mark.parametrize("fault", ["blank", "dash", "no heading", "two headings", "nested total", "two totals"])
def test_faults_are_never_a_pass(spark, fault):
    rows = list(CORPORATE)
    if fault in ("blank", "dash"):
        rows[1] = ("Cash", "data", "" if fault == "blank" else "—")
    elif fault == "no heading":
        del rows[0]
    elif fault == "two headings":
        rows.insert(1, rows[0])
    elif fault == "nested total":
        rows.insert(2, ("Total cash", "data", "0"))
    else:
        rows.append(("Total current assets", "data", "100"))
    assert corporate(spark, rows)["current assets"] == "NOT_TESTED"


def test_cash_and_fund_grids(spark):
    rows = [("Cash, beginning of year", "50"), ("Net increase in cash", "45"), ("Effect of exchange rates", "—"), ("Cash, end of year", "95")]
    check = A.cash_grid_checks(grid(spark, rows, ["data"] * 4, ["Year Ended December 31, 2026"])).collect()
    assert [(r["Check"], r["Status"]) for r in check] == [("Cash beginning + change + FX = ending", "PASS")]
    parts = [("Bank", "10"), ("Restricted", "-"), ("Total cash", "10")]
    assert [r["Status"] for r in A.cash_grid_checks(grid(spark, parts, ["data"] * 3, ["December 31, 2026"])).collect()] == ["PASS"]
    blank = [("Bank", "10"), ("Restricted", ""), ("Total cash", "10")]
    assert [r["Status"] for r in A.cash_grid_checks(grid(spark, blank, ["data"] * 3, ["December 31, 2026"])).collect()] == ["NOT_TESTED"]
    fund = [("Total assets", "10"), ("Total liabilities", "4"), ("Total net assets", "6"), ("Total liabilities and net assets", "10")]
    assert {r["Status"] for r in A.fund_balance_checks(grid(spark, fund, ["data"] * 4)).collect()} == {"PASS"}


def test_grid_integrity(spark):
    ok = lambda *a, **b: A.grid_integrity(grid(spark, *a, **b)).first()["Status"]
    rows = [("Cash", "1"), ("Debt", "(2)"), ("Other", "—")]
    assert ok(rows, ["data"] * 3) == "PASS"
    assert ok(rows, ["data"] * 3, periods=["2026", "2026"]) == "FAIL"
    assert ok(rows, ["data"] * 2) == "FAIL"
    assert ok([("Cash", "1 2")], ["data"]) == "FAIL"
    assert ok([("Cash", "")], ["data"]) == "FAIL"
    assert ok(rows, ["data"] * 3, sources=["s", "s", "t"]) == "FAIL"
    assert ok(rows, ["section"] * 3) == "FAIL"


def test_units_and_report(spark):
    own = spark.createDataFrame([("a", "millions", "USD"), ("a", "millions", "USD"), ("b", "millions", "USD"), ("b", "thousands", "USD"), ("c", "reported units", "")], "doc_id string, unit_label string, currency string")
    assert {r["doc_id"]: r["Status"] for r in A.unit_checks(own).collect()} == {"a": "PASS", "b": "WARN", "c": "NOT_TESTED"}
    report = A.review_report(A.unit_checks(own), A.unit_checks(own))
    assert report.count() == 3 and report.orderBy("severity").first()["Status"] == "WARN"
