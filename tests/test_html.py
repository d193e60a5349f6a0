from __future__ import annotations

from ledgerflow import api
from ledgerflow.sources import html



def grid(rows, header=""):
    """A table of these rows, whose first cells are labels; header: rows of markup before them."""
    return f"<table>{header}" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>"


def fact(name, value, tag="span"):
    return f'<{tag} name="dei:{name}">{value}</{tag}>'


FILING = "".join([
    "<html><body>",
    '<section hidden>', fact("EntityRegistrantName", "Shadow Kettles Ltd", "ix:nonNumeric"), grid([("Total assets", 77, 66), ("Total liabilities", 55, 44)]), "</section>",
    "<div>", fact("EntityRegistrantName", "Copper Kettle Works", "ix:nonNumeric"), fact("DocumentType", "10-K"), fact("DocumentPeriodEndDate", "September 30, 2019"), fact("DocumentFiscalPeriodFocus", "FY"), "</div>",
    "<h3>Balance Sheets</h3>", grid([("", "September 30, 2019", "September 30, 2018"), ("Inventories", 61, 58), ("Total assets", 912, 870), ("Total liabilities", 402, 395), ("Total equity", 510, 475)]),
    "<h3>Statements of Income</h3><p>(In thousands)</p>", grid([("Revenue", 1840, 1765), ("Kettle sheet metal", 1210, 1190), ("Net income", 84, 71)], '<tr><th rowspan="2"></th><th colspan="2">Years Ended September 30,</th></tr><tr><td>2019</td><td>2018</td></tr>'),
    "<h3>Statements of Cash Flows</h3><table><tr><td>Years Ended September 30,<td>2019<td>2018<tr><td>Net income<td>84<td>71<tr><td>Cash and cash equivalents at end of period<td>133<td>119</table>",
    "<h3>Notes to Financial Statements</h3>", grid([("Total assets, kettles", 600, 590), ("Total liabilities", 31, 30)]), "<table><tr><td>", grid([("inner",)]), "</td></tr></table>",
    "</body></html>",
])


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", None if c is None else bytearray(c.encode())) for i, c in enumerate(contents)], "doc_id string, content binary")


def test_filing(spark):
    result = api.extract_html(files(spark, FILING, "<table><tr><td rowspan=many>4</td></tr></table>", None, "no markup at all"))
    meta = {r["doc_id"]: list(r)[1:] for r in result.metadata.collect()}
    assert meta["f0"] == ["Copper Kettle Works", "10-K", "2019", "Annual"]
    got = {(r["statement_type"], r["standard_item"], r["period"]): r["parsed_value"] for r in result.values.collect()}
    want = {("IncomeStatement", "Revenue", "2019"): 1840, ("CashFlowStatement", "Cash and Cash Equivalents at End of Period", "2018"): 119, ("BalanceSheet", "Total Assets", "September 30, 2019"): 912, ("BalanceSheet", "Total Liabilities", "September 30, 2018"): 395}
    assert {k: got.get(k) for k in want} == want and len({kind for kind, *_ in got}) == 3
    assert 77 not in got.values() and 600 not in got.values()  # neither hidden tables nor those of the notes
    grids = {r["table_id"]: r for r in result.grids.collect()}
    assert sorted(grids) == ["HTML_0001", "HTML_0002", "HTML_0003"]
    income = next(r for r in grids.values() if r["rows"][2][0] == "Revenue")
    assert income["rows"][1] == ["", "2019", "2018"] and sorted((x["r"], x["c"], x["rs"], x["cs"]) for x in income["spans"]) == [(0, 0, 2, 1), (0, 1, 1, 2)]
    assert result.checks.filter("Check = 'IS net income = CF net income' AND Status = 'PASS'").count() == 2


def test_fund_tables_by_content(spark):
    fund = """<table><tr><td>Valuation Techniques fair value investment cost</td></tr><tr><td>A</td><td>1</td><td>2</td></tr><tr><td>B</td><td>1</td><td>2</td></tr></table>
    <table><tr><td>Investment</td><td>Cost</td><td>Fair Value</td><td>% of net assets</td></tr><tr><td>Alpha</td><td>1</td><td>2</td><td>46.7</td><td>%</td></tr><tr><td>Beta</td><td>-</td><td>3</td><td>4</td></tr></table>"""
    chosen = html.selected(html.classify(html.parsed(files(spark, fund)))).collect()
    assert [(r["table_index"], r["statement_type"]) for r in chosen] == [(2, "ScheduleOfInvestments")]
    assert chosen[0]["lines"][1] == "Alpha 1 2 46.7%"


def test_longest_run_wins(spark):
    table = lambda n: "<table>" + "<tr><td>Total assets and total liabilities</td><td>1</td><td>2</td></tr>" * n + "</table>"
    pages = table(2) + "<table><tr><td>x</td></tr></table>" + table(2) + table(3) + "<table><tr><td>x</td></tr></table>" + table(5)
    got = html.selected(html.classify(html.parsed(files(spark, pages)))).collect()
    assert sorted(r["table_index"] for r in got) == [3, 4]
