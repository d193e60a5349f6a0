"""Grids that words, rules and cells of pages make, and what is checked of them, over pages and grids that are laid out from the driver's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.functions.names import form_type
from ledgerflow.operators import audits, completeness, geometry, grids, layouts
from ledgerflow.plans import pages as plans
from ledgerflow.queries import ORACLE_SQL, QUERIES, query, read
from ledgerflow.sources import html, text
from ledgerflow.staging import dealt

__all__ = ["ORACLE_SQL", "QUERIES"]

_ORDERS_SQL = """
WITH o AS (
  SELECT o_custkey AS c, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders
), t AS (
  SELECT c, count(*) AS n, CAST(sum(p) AS BIGINT) AS p, CAST(sum(k % 7 + 1) AS BIGINT) AS s FROM o GROUP BY c
)
"""


def _show(value: Column) -> Column:
    return value.cast("string")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c, items array<struct<k, p>>: each customer's orders by key, with whole prices."""
    item = F.struct(F.col("o_orderkey").cast("long").alias("k"), F.floor("o_totalprice").cast("long").alias("p"))
    return dealt(read(spark, sf_dir, "orders"), "o_custkey").groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _word(text: Column | str, x0: float, x1: float, top: Column | float) -> Column:
    at = F.lit(top) if isinstance(top, float) else top
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), at.alias("top"), (at + 8.0).alias("bottom"))


def _box(x0: float, top: Column, x1: float, bottom: Column) -> Column:
    return F.array(F.lit(x0), top, F.lit(x1), bottom)


def _grid_rows(found: DataFrame) -> DataFrame:
    """One row for each row of a grid, or one with the page's error."""
    row = F.posexplode_outer(F.arrays_zip(F.col("rows").alias("cells"), F.col("row_kinds").alias("kind"))).alias("row_index", "r")
    return found.select("doc_id", F.array_join("labels", "|").alias("labels"), "error", row).select("doc_id", "labels", "row_index", F.col("r.kind").alias("kind"), F.array_join("r.cells", "|").alias("cells"), "error")


@query(
    _ORDERS_SQL
    + """
, rows AS (
  SELECT c, 0 AS row_index, 'section' AS kind, 'Assets||' AS cells FROM t
  UNION ALL SELECT c, i, 'data', 'Order ' || k || '|' || k || '|' || p FROM o
  UNION ALL SELECT c, n + 1, 'data', 'Total assets|' || n || '|' || p FROM t
)
SELECT CAST(c AS VARCHAR) AS doc_id, 'June 30, 2026|June 30, 2025' AS labels, CAST(row_index AS INTEGER) AS row_index, kind, cells, CAST(NULL AS VARCHAR) AS error FROM rows WHERE c % 6 IN (0, 5)
UNION ALL SELECT CAST(c AS VARCHAR), NULL, NULL, NULL, NULL, CASE c % 6 WHEN 1 THEN 'The balance sheet''s body has no unique beginning and end.' WHEN 2 THEN 'A column has no single date, or two have the same.'
  WHEN 3 THEN 'A cell crosses columns or disagrees with its words.' ELSE 'Recovered rows aren''t the whole body.' END FROM t WHERE c % 6 NOT IN (0, 5)
"""
)
def balance_page_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balance sheet's page for each customer with a row for each order. Of six, one has cells, one rows of one cell under ruled heads, and four a fault."""
    c = F.col("c")
    none = F.lit(None).cast("string")
    row = lambda *v: F.struct(*[x.alias(n) for n, x in zip(("first", "second", "a", "b"), v, strict=True)])
    total = F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + x["p"])
    body = F.concat(F.array(row(F.lit("Assets"), none, none, none)), F.transform("items", lambda x: row(F.lit("Order"), _show(x["k"]), _show(x["k"]), _show(x["p"]))), F.array(row(F.lit("Total"), F.lit("assets"), _show(F.size("items")), _show(total))))
    own = _customers(spark, sf_dir).withColumn("body", body)
    top = lambda i: i * 12.0 + 100.0
    label = lambda r: F.concat_ws(" ", r["first"], r["second"])
    line = lambda r: F.concat_ws(" ", r["first"], r["second"], r["a"], r["b"])
    if_any = lambda text, x0, x1, i: F.when(text.isNotNull(), _word(text, x0, x1, top(i)))
    heads = [_word(text, 200.0 + 100 * k + x, 212.0 + 100 * k + x, 80.0) for k, year in enumerate(("2026", "2025")) for text, x in (("June", 0), ("30,", 16), (year, 32))]
    words = F.flatten(F.transform("body", lambda r, i: F.array_compact(F.array(if_any(r["first"], 0.0, 24.0, i), if_any(r["second"], 28.0, 90.0, i), if_any(r["a"], 235.0, 275.0, i), if_any(r["b"], 335.0, 375.0, i)))))
    words = F.concat(F.when(c % 6 == 2, F.filter(F.array(*heads), lambda w: F.lit(False))).otherwise(F.array(*heads)), words)

    across = lambda r: (c % 6 == 5) & r["a"].isNotNull()
    box = lambda x0, x1, i: _box(x0, top(i) - 1, x1, top(i) + 10)
    boxes = F.transform("body", lambda r, i: F.when(across(r), F.array(box(0.0, 380.0, i))).otherwise(F.array(box(0.0, 180.0, i), box(200.0, 280.0, i), box(300.0, 380.0, i))))
    said = lambda r: F.when((c % 6 == 3) & (r["first"] == "Total"), F.concat(r["a"], F.lit("9"))).otherwise(F.coalesce(r["a"], F.lit("")))
    values = F.transform("body", lambda r: F.when(across(r), F.array(line(r))).otherwise(F.array(label(r), said(r), F.coalesce(r["b"], F.lit("")))))
    first = F.array(F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in ((0, 95, 180, 99), (200, 95, 280, 99), (300, 95, 380, 99))]))
    table = F.struct(F.array(F.lit(0.0), F.lit(95.0), F.lit(380.0), top(F.size("body"))).alias("bbox"), F.concat(first, boxes).alias("rows"), F.concat(F.array(F.array(*[F.lit("")] * 3)), values).alias("extracted"))
    edge = lambda x: F.struct(F.lit(x).alias("x0"), F.lit(x + 80).alias("x1"), F.lit(95.0).alias("top"), F.lit(95.5).alias("bottom"))
    shown = F.concat(F.array(F.lit("Balance Sheets"), F.lit("June 30, 2026 June 30, 2025")), F.transform("body", line), F.array_compact(F.array(F.when(c % 6 == 4, "Hidden 5 6"), F.when(c % 6 != 1, "See accompanying notes"))))
    pages = own.select(_show(c).alias("doc_id"), F.lit(1).alias("page"), F.lit("BalanceSheet").alias("statement_type"), F.lit(400.0).alias("width"), F.array_join(shown, "\n").alias("text"), words.alias("words"), F.when(c % 6 == 5, F.array(edge(200.0), edge(300.0))).alias("edges"), F.array(table).alias("tables"))
    return _grid_rows(geometry.balance_grids(pages))


@query(
    _ORDERS_SQL
    + """
, rows AS (
  SELECT c, 0 AS row_index, 'parent_header' AS kind, '|Common Stock||' AS cells FROM t
  UNION ALL SELECT c, 1, 'header', '|Shares|Amount|Total' FROM t
  UNION ALL SELECT c, 2, 'data', 'Balance at January 1, 2026|10|100|110' FROM t
  UNION ALL SELECT c, i + 2, 'data', 'Issuance of stock|' || (k % 7 + 1) || '|' || p || '|' || (p + k % 7 + 1) FROM o
  UNION ALL SELECT c, n + 3, 'data', 'Total changes for the year ended December 31, 2026|' || s || '|' || p || '|' || (p + s) FROM t
  UNION ALL SELECT c, n + 4, 'data', 'Balance at December 31, 2026|' || (s + 10) || '|' || (p + 100) || '|' || (p + s + 110) FROM t
)
SELECT CAST(c AS VARCHAR) AS doc_id, 'Shares|Amount|Total' AS labels, CAST(row_index AS INTEGER) AS row_index, kind, cells, CAST(NULL AS VARCHAR) AS error, CAST(2 AS INTEGER) AS section_start, CAST(n + 5 AS INTEGER) AS section_end, 'year ended December 31, 2026' AS caption FROM rows JOIN t USING (c) WHERE c % 4 < 2
UNION ALL SELECT CAST(c AS VARCHAR), NULL, NULL, NULL, NULL, CASE c % 4 WHEN 2 THEN 'Heads are missing, equal, overlap or cross columns.' ELSE 'Rows aren''t those of the text, in order.' END, NULL, NULL, NULL FROM t WHERE c % 4 >= 2
"""
)
def equity_page_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollforward's page for each customer, orders as movements of equal labels. A quarter lacks a head, another has a row in its text alone."""
    c = F.col("c")
    row = lambda label, a, b: F.struct((F.lit(label)).alias("label"), _show(a).alias("a"), _show(b).alias("b"), _show(a + b).alias("t"))
    shares = lambda x: x["k"] % 7 + 1
    zero = F.lit(0).cast("long")
    sums = {"s": F.aggregate("items", zero, lambda acc, x: acc + shares(x)), "p": F.aggregate("items", zero, lambda acc, x: acc + x["p"])}
    own = _customers(spark, sf_dir).withColumns(sums)
    ten, hundred = F.lit(10).cast("long"), F.lit(100).cast("long")
    body = F.concat(
        F.array(row("Balance at January 1, 2026", ten, hundred)), F.transform("items", lambda x: row("Issuance of stock", shares(x), x["p"])),
        F.array(row("Total changes for the year ended December 31, 2026", F.col("s"), F.col("p")), row("Balance at December 31, 2026", F.col("s") + 10, F.col("p") + 100)),
    )
    own = own.withColumn("body", body)
    top = lambda i: i * 12.0 + 100.0
    words = F.flatten(F.transform("body", lambda r, i: F.array(_word(r["label"], 0.0, 180.0, top(i)), _word(r["a"], 205.0, 240.0, top(i)), _word(r["b"], 255.0, 290.0, top(i)), _word(r["t"], 305.0, 340.0, top(i)))))
    heads = F.array_compact(F.array(_word("Common", 205.0, 229.0, 60.0), _word("Stock", 233.0, 293.0, 60.0), _word("Shares", 205.0, 229.0, 72.0), _word("Amount", 255.0, 279.0, 72.0), F.when(c % 4 != 2, _word("Total", 305.0, 325.0, 72.0))))
    shown = F.concat(F.array(F.lit("Statements of Equity")), F.transform("body", lambda r: F.concat_ws(" ", r["label"], r["a"], r["b"], r["t"])), F.array_compact(F.array(F.when(c % 4 == 3, "Extra row 1 2 3"))))
    wide = F.array(F.array(*[F.array(*[F.lit(float(v)) for v in (x0, 95, x1, 110)]) for x0, x1 in ((0, 200), (200, 250), (250, 300), (300, 350))]))
    table = F.struct(F.array(F.lit(0.0), F.lit(95.0), F.lit(350.0), F.lit(110.0)).alias("bbox"), wide.alias("rows"), F.array(F.array(*[F.lit("")] * 4)).alias("extracted"))
    pages = own.select(_show(c).alias("doc_id"), F.lit(1).alias("page"), F.lit("StockholdersEquityStatement").alias("statement_type"), F.lit(400.0).alias("width"), F.array_join(shown, "\n").alias("text"), F.concat(heads, words).alias("words"), F.array(table).alias("tables"))
    found = geometry.equity_grids(pages)
    part = F.get("sections", F.lit(0))
    return _grid_rows(found).join(found.select("doc_id", part["start"].alias("section_start"), part["end"].alias("section_end"), part["caption"].alias("caption")), "doc_id")


_RULES_SQL = """
WITH l AS (
  SELECT l_orderkey AS k, l_linenumber AS i, l_linenumber % 3 * 0.5 AS j, max(l_linestatus) = 'O' AS third, max(l_returnflag) = 'R' AS long, max(l_partkey) AS part FROM lineitem GROUP BY ALL
), rules AS (
  SELECT k, j AS x0, 100 - j AS x1 FROM l UNION ALL SELECT k, 100 + j, 200 - j FROM l UNION ALL SELECT k, 200 + j, 300 - j FROM l WHERE third UNION ALL SELECT k, j, 200 - j FROM l WHERE long
), places AS (
  SELECT k, round(x / 100) AS at, avg(x) AS x FROM (SELECT k, x0 AS x FROM rules UNION ALL SELECT k, x1 FROM rules) GROUP BY ALL
)
"""


def _ruled_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Wide rules and words of a page for each order: two or three rules for each line, a little off, some across two columns, and short ones."""
    line = dealt(read(spark, sf_dir, "lineitem").withColumn("doc_id", _show(F.col("l_orderkey"))), "doc_id").groupBy("doc_id", "l_linenumber").agg((F.max("l_linestatus") == "O").alias("third"), (F.max("l_returnflag") == "R").alias("long"), _show(F.max("l_partkey")).alias("part"))
    line = line.select("doc_id", F.lit(1).alias("page"), F.col("l_linenumber").alias("i"), (F.col("l_linenumber") % 3 * 0.5).alias("j"), "third", "long", "part")
    j, top = F.col("j"), F.col("i") * 20.0
    rule = lambda x0, x1: F.struct((j + x0).alias("x0"), (F.lit(float(x1)) - j).alias("x1"))
    rules = F.array_compact(F.array(rule(0, 100), rule(100, 200), F.when(F.col("third"), rule(200, 300)), F.when(F.col("long"), rule(0, 200)), rule(150, 160)))
    words = F.array(_word(F.concat(F.lit("#"), _show(F.col("i"))), 10.0, 40.0, top), _word(_show(F.col("part")), 110.0, 140.0, top), _word("end", 230.0, 260.0, top))
    each = lambda found: line.select("doc_id", "page", F.explode(found).alias("e")).select("doc_id", "page", "e.*")
    return each(rules), each(words)


@query(
    _RULES_SQL
    + """
SELECT CAST(a.k AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY a.k ORDER BY a.at) - 1 AS INTEGER) AS column_index, round(a.x, 6) AS lo, round(b.x, 6) AS hi FROM places a JOIN places b ON a.k = b.k AND b.at = a.at + 1
"""
)
def rule_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that wide rules alone establish: ends that are near make one place, a rule across two columns makes none."""
    rules, _ = _ruled_lines(spark, sf_dir)
    return geometry.columns_of_rules(rules).select("doc_id", F.posexplode("columns").alias("column_index", "x")).select("doc_id", "column_index", F.round("x.lo", 6).alias("lo"), F.round("x.hi", 6).alias("hi"))


@query(
    _RULES_SQL
    + """
SELECT CAST(k AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS INTEGER) AS row_index, '#' || i || '|' || part || CASE WHEN bool_or(third) OVER (PARTITION BY k) THEN '|' ELSE ' ' END || 'end' AS cells FROM l
"""
)
def rule_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of words cut at those columns; where there is no third column its words are the second one's."""
    rules, words = _ruled_lines(spark, sf_dir)
    found = geometry.raw_component_grids(grids.lines_of_words(words), rules)
    return found.select("doc_id", F.posexplode("rows").alias("row_index", "r")).select("doc_id", "row_index", F.array_join("r", "|").alias("cells"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 9 AS f FROM customer)
SELECT CAST(k AS VARCHAR) AS doc_id, CASE WHEN f = 0 THEN 'PASS' ELSE 'FAIL' END AS "Status", CASE f WHEN 0 THEN '' WHEN 1 THEN 'Missing or duplicate date/component headings.'
  WHEN 2 THEN 'Row content, row classification and source provenance have different counts.' WHEN 3 THEN 'A row has no source position.' WHEN 4 THEN 'A row does not match its date/component columns.'
  WHEN 5 THEN 'A row has a blank, invalid or combined amount.' WHEN 6 THEN 'A row contains a replacement character.' WHEN 7 THEN 'No financial rows are available.' ELSE 'The same source position is used by multiple financial rows.' END AS failures FROM c
""")
def grid_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each customer; of nine one is whole, and each other has one of the faults."""
    f, v = F.col("c_custkey") % 9, F.floor(F.abs("c_acctbal")).cast("long")
    cash = F.array(F.when(f == 6, "Ca�h").otherwise("Cash"), F.when(f == 5, F.concat(_show(v), F.lit(" 7"))).otherwise(_show(v)), F.lit("—"))
    debt = F.when(f == 4, F.array(F.lit("Debt"), F.lit("(2)"))).otherwise(F.array(F.lit("Debt"), F.lit("(2)"), F.lit("n/a")))
    kinds = F.when(f == 2, F.array(F.lit("section"), F.lit("data"), F.lit("data"), F.lit("section"))).when(f == 7, F.array(*[F.lit("section")] * 3)).otherwise(F.array(F.lit("section"), F.lit("data"), F.lit("data")))
    sources = F.array(F.lit("p1:1"), F.when(f == 3, "").otherwise("p1:2"), F.when(f == 8, "p1:2").otherwise("p1:3"))
    made = read(spark, sf_dir, "customer").select(_show(F.col("c_custkey")).alias("doc_id"), F.lit("t").alias("table_id"), F.array(F.array(F.lit("Assets"), F.lit(""), F.lit("")), cash, debt).alias("rows"), kinds.alias("row_kinds"), sources.alias("row_sources"), F.array(F.lit("2026"), F.when(f == 1, "2026").otherwise("2025")).alias("period_labels"))
    return audits.grid_integrity(made).select("doc_id", "Status", F.array_join("failures", " ").alias("failures"))


@query("""
WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_custkey % 6 AS f FROM customer)
SELECT doc_id, 'December 31, 2026 / cash' AS "Scope", CASE f WHEN 1 THEN 'FAIL' WHEN 2 THEN 'NOT_TESTED' WHEN 3 THEN 'NOT_TESTED' WHEN 4 THEN 'NOT_TESTED' ELSE 'PASS' END AS "Status" FROM c
UNION ALL SELECT doc_id, 'December 31, 2026 / restricted cash', CASE WHEN f = 3 THEN 'NOT_TESTED' WHEN f = 5 THEN 'NOT_TESTED' ELSE 'PASS' END FROM c
""")
def cash_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of cash against the balance sheet for each customer: equal, off by 5, twice there, of other units, absent, or a dash on one side."""
    k, v = F.col("c_custkey"), F.floor(F.abs("c_acctbal")).cast("long")
    f = k % 6
    own = read(spark, sf_dir, "customer")
    row = lambda label, cell: F.array(F.lit(label), cell)
    cash = F.array(row("Cash", _show(v)), row("Restricted cash", F.lit("—")), row("Total cash and restricted cash", _show(v)))
    balance = F.array_compact(F.array(F.when(f != 4, row("Cash", _show(v + F.when(f == 1, 5).otherwise(0)))), F.when(f == 2, row("Cash", _show(v))), row("Restricted cash", F.when(f == 5, "7").otherwise("—"))))
    grid = lambda name, rows: own.select(_show(k).alias("doc_id"), F.lit(name).alias("table_id"), rows.alias("rows"), F.transform(rows, lambda r: F.lit("data")).alias("row_kinds"), F.array(F.lit("December 31, 2026")).alias("period_labels"))
    unit = lambda label: F.struct(F.lit(label).alias("unit_label"), F.lit("USD").alias("currency"))
    units = own.select(_show(k).alias("doc_id"), F.explode(F.array(unit("millions"), F.when(f == 3, unit("thousands")).otherwise(unit("millions")))).alias("u")).select("doc_id", "u.*")
    return completeness.reconciliation(grid("c", cash), grid("b", balance), units).select("doc_id", "Scope", "Status")


@query("""
WITH o AS (
  SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS st, CAST(floor(o_totalprice) AS BIGINT) AS p, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS row_index FROM orders
), n AS (
  SELECT *, count(*) FILTER (st <> 'F' AND p >= 100 AND p NOT BETWEEN 1900 AND 2099) OVER (PARTITION BY c) AS anchors FROM o
)
SELECT CAST(c AS VARCHAR) AS doc_id, row_index, CAST(1 AS INTEGER) AS column_index, '(' || p || ')' AS joined FROM n WHERE st = 'F' AND anchors >= 2 AND k % 5 <> 0
""")
def split_parentheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each customer, whose losses have the closing parenthesis in the next cell; not where a rate's sign follows or amounts are few."""
    key = F.col("o_orderkey")
    price = _show(F.floor("o_totalprice").cast("long"))
    loss = F.col("o_orderstatus") == "F"
    row = F.array(F.concat(F.lit("Order "), _show(key)), F.when(loss, F.concat(F.lit("("), price)).otherwise(price), F.when(loss, ")").otherwise(""), F.when(key % 5 == 0, "%").otherwise(_show(key)))
    own = dealt(read(spark, sf_dir, "orders").withColumn("doc_id", _show(F.col("o_custkey"))), "doc_id")
    made = own.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), row.alias("row")))), lambda x: x["row"]).alias("rows"))
    return grids.split_parentheses(made, ["doc_id"])


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Order|$' || p || '|$' || o_orderkey WHEN 1 THEN 'Order|$|no|' || p ELSE '$' || o_orderkey || '|' || p END AS cells
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)
""")
def dollar_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currency signs in cells of their own join the number after them, over empty cells; a text between keeps them apart."""
    k, price = _show(F.col("o_orderkey")), _show(F.floor("o_totalprice").cast("long"))
    n = F.col("o_orderkey") % 3
    row = F.when(n == 0, F.array(F.lit("Order"), F.lit("$"), F.lit(""), price, F.concat(F.lit("$ "), k))).when(n == 1, F.array(F.lit("Order"), F.lit("$"), F.lit("no"), price)).otherwise(F.array(F.lit("$"), k, price))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(grids.joined_dollars(row), "|").alias("cells"))


@query("""
WITH l AS (
  SELECT l_orderkey AS k, l_linenumber AS i, max(l_partkey) AS part, max(l_suppkey) AS supp, max(l_returnflag) = 'R' AS wide FROM lineitem GROUP BY ALL
), t AS (
  SELECT k, max(i) AS high, min(CASE WHEN (k + i) % 11 = 0 THEN i END) AS notes FROM l GROUP BY k
), r AS (SELECT k, high, notes, unnest(range(0, high + 1)) AS row_index FROM t)
SELECT CAST(r.k AS VARCHAR) AS doc_id, CAST(r.row_index AS INTEGER) AS row_index, CASE WHEN l.i IS NULL THEN '||' WHEN wide THEN 'Part ' || part || '||' ELSE 'Part ' || part || '||' || supp END AS cells,
  CAST(CASE WHEN wide THEN 3 ELSE 1 END AS INTEGER) AS width
FROM r LEFT JOIN l ON l.k = r.k AND l.i = r.row_index WHERE notes IS NULL OR r.row_index < notes
""")
def assembled_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order from its cells, a full rectangle up to the row that opens the notes; rows and cells that aren't there are empty."""
    items = dealt(read(spark, sf_dir, "lineitem").withColumn("doc_id", _show(F.col("l_orderkey"))), "doc_id")
    line = items.groupBy("doc_id", "l_orderkey", "l_linenumber").agg(_show(F.max("l_partkey")).alias("part"), _show(F.max("l_suppkey")).alias("supp"), (F.max("l_returnflag") == "R").alias("wide"))
    opens = (F.col("l_orderkey") + F.col("l_linenumber")) % 11 == 0
    cell = lambda column, text, span: F.struct(F.lit(column).alias("column_index"), text.alias("raw_text"), F.lit(1).alias("rowspan"), span.alias("colspan"))
    label = F.when(opens, "Notes to Financial Statements").otherwise(F.concat(F.lit("Part "), F.col("part")))
    own = F.array_compact(F.array(cell(0, label, F.when(F.col("wide"), 3).otherwise(1)), F.when(~F.col("wide"), cell(2, F.when(~opens, F.col("supp")), F.lit(1))), cell(2, F.lit(None).cast("string"), F.lit(1))))
    cells = line.select("doc_id", F.lit("t").alias("table_id"), F.lit(1).alias("source_page"), F.col("l_linenumber").alias("row_index"), F.posexplode(own).alias("n", "x"))
    last = F.row_number().over(Window.partitionBy("doc_id", "row_index", "x.column_index").orderBy("n"))
    cells = cells.withColumn("selected", last == 1).select("doc_id", "table_id", "source_page", "row_index", "selected", "x.*")
    found = grids.trimmed(grids.assembled(cells)).select("doc_id", "spans", F.posexplode("rows").alias("row_index", "row"))
    width = F.coalesce(F.get(F.transform(F.filter("spans", lambda s: s["r"] == F.col("row_index")), lambda s: s["cs"]), F.lit(0)), F.lit(1)).cast("int")
    return found.select("doc_id", "row_index", F.array_join("row", "|").alias("cells"), width.alias("width"))


@query("""
WITH p AS (
  SELECT o_custkey AS c, o_orderkey % 6 AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS k FROM orders
), q AS (
  SELECT c, f, n + n // 9 AS page, k FROM p
), r AS (
  SELECT *, page - row_number() OVER (PARTITION BY c ORDER BY page) AS island, CASE f WHEN 0 THEN 'data' WHEN 1 THEN 'title' WHEN 2 THEN 'supporting' WHEN 3 THEN 'blank' ELSE 'unknown' END AS role, count(*) OVER (PARTITION BY c) AS pages FROM q
), m AS (
  SELECT *, CASE f WHEN 0 THEN 'BalanceSheet' WHEN 1 THEN 'IncomeStatement' WHEN 2 THEN '' END AS mark FROM r
)
SELECT CAST(c AS VARCHAR) AS doc_id, CAST(page AS BIGINT) AS page, role, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY c, island ORDER BY page ROWS UNBOUNDED PRECEDING), '') AS statement_type, role <> 'blank' AS suggested, pages > 50 AS review_required FROM m
""")
def manual_page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that were asked for, an order each and every ninth left out: statements with amounts, titles, notes, page numbers, other text, and pictures."""
    f = F.col("o_orderkey") % 6
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    own = read(spark, sf_dir, "orders").select(_show(F.col("o_custkey")).alias("doc_id"), (n + F.floor(n / 9)).cast("long").alias("page"), f.alias("f"))
    f = F.col("f")
    shown = F.when(f == 0, F.array(F.lit("Consolidated Balance Sheets"), F.lit("Cash 10 9"), F.lit("Total assets 10 9"))).when(f == 1, F.array(F.lit("Consolidated Statements of Operations"))).when(f == 2, F.array(F.lit("Notes to Consolidated Financial Statements"), F.lit("Cash is cash.")))
    shown = shown.when(f == 3, F.array(F.lit(""), _show(F.col("page")))).when(f == 4, F.array(F.lit("Some text"), F.lit("and more"))).otherwise(F.array(F.lit("")))
    lines = own.select("doc_id", F.col("page").alias("source_page"), F.when(f == 5, "OCR_REQUIRED").otherwise("TEXT").alias("page_status"), F.posexplode(shown).alias("line_no", "raw_text"))
    return plans.manual_plan(lines, own.select("doc_id", "page")).select("doc_id", "page", "role", "statement_type", "suggested", "review_required")


@query("""
WITH o AS (SELECT o_custkey AS c, o_custkey % 25 AS folder, o_orderkey AS k, o_orderstatus AS st FROM orders),
h AS (
  SELECT 'a' || c AS html_id, c, folder, c % 2 = 0 AS same, k, CASE WHEN st = 'F' THEN 'BalanceSheet' ELSE 'IncomeStatement' END AS kind FROM o WHERE k % 3 <> 0
  UNION ALL SELECT 'b' || c, c, folder, false, k, 'BalanceSheet' FROM o
  UNION ALL SELECT 'b' || c, c, folder, false, k, 'IncomeStatement' FROM o WHERE st = 'F'
), g AS (
  SELECT c, html_id, bool_or(same) AS same_stem, count(DISTINCT k) AS overlap, count(DISTINCT kind) AS types FROM h GROUP BY ALL
), j AS (SELECT *, CASE WHEN same_stem THEN overlap >= 3 ELSE overlap >= 8 AND types >= 2 END AS accepted FROM g)
SELECT CAST(c AS VARCHAR) AS doc_id, html_id, overlap, types, accepted, CAST(row_number() OVER (PARTITION BY c ORDER BY accepted DESC, same_stem DESC, overlap DESC, html_id) AS INTEGER) AS rank FROM j
""")
def companion_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A captured filing for each customer, and two tagged ones that have some of its rows or all of them, one with its name where the customer is even."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "BalanceSheet").otherwise("IncomeStatement")
    line = lambda shown: F.concat(F.lit(shown), _show(k), F.lit("  "), _show(k * 3))
    own = read(spark, sf_dir, "orders").select(_show(c).alias("doc_id"), _show(c % 25).alias("folder"), F.concat(F.lit("name"), _show(c)).alias("stem"), F.when(c % 2 == 0, F.concat(F.lit("NAME"), _show(c))).otherwise("other").alias("other"), k.alias("k"), kind.alias("kind"), line("Order ").alias("line"), line("ORDER ").alias("shown"))
    html = lambda letter, rows, stem, kind: rows.select(F.concat(F.lit(letter), "doc_id").alias("html_id"), "folder", stem.alias("stem"), kind.alias("statement_type"), F.col("shown").alias("line"))
    tagged = html("a", own.filter("k % 3 <> 0"), F.col("other"), F.col("kind")).unionByName(html("b", own, F.lit("b"), F.lit("BalanceSheet"))).unionByName(html("b", own.filter("kind = 'BalanceSheet'"), F.lit("b"), F.lit("IncomeStatement")))
    return plans.companions(own, tagged).select("doc_id", "html_id", "overlap", "types", "accepted", "rank")


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '10K' WHEN 1 THEN '10K-A' WHEN 2 THEN '10Q' WHEN 3 THEN '10Q-A' WHEN 4 THEN '10K-A' ELSE '' END AS form FROM orders
""")
def form_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that a cover names: amended ones first, whatever else it names; none inside longer words."""
    n, k = F.col("o_orderkey") % 6, _show(F.col("o_orderkey"))
    named = F.when(n == 0, "form 10-k of order ").when(n == 1, "Form 10-K/A, amending Form 10-K, of order ").when(n == 2, "10Q for ").when(n == 3, "FORM 10-Q/A ").when(n == 4, "10-Q and 10K/A ").otherwise("Form 10-KSB or X10-Q ")
    return read(spark, sf_dir, "orders").select("o_orderkey", form_type(F.concat(named, k)).alias("form"))


@query("""
WITH o AS (
  SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 10 AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CASE WHEN o_orderkey % 7 = 0 THEN '__supporting__' WHEN o_orderkey % 4 = 0 THEN 'IncomeStatement' END AS kind FROM orders
), t AS (
  SELECT *, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY c ORDER BY n ROWS UNBOUNDED PRECEDING), '') AS near FROM o
)
SELECT CAST(c AS VARCHAR) AS doc_id, CAST(n AS INTEGER) AS table_index, CAST(CASE f WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 8 THEN 1 ELSE 2 END AS INTEGER) AS data_lines,
  CASE WHEN f IN (0, 1) THEN 'BalanceSheet' WHEN f = 2 THEN 'CashFlowStatement' WHEN f IN (3, 6) THEN 'PartnersCapital' WHEN f = 7 THEN 'ScheduleOfInvestments' ELSE 'IncomeStatement' END AS statement_type,
  CASE f WHEN 0 THEN 'Consolidated Balance Sheets' WHEN 1 THEN 'Consolidated Statements of Assets and Liabilities' WHEN 2 THEN 'Consolidated Statements of Cash Flows' WHEN 3 THEN 'Statements of Changes in Net Assets' WHEN 4 THEN 'Consolidated Statement of Operations'
    WHEN 5 THEN 'income statement' WHEN 6 THEN 'statement of changes in partners'' capital' WHEN 7 THEN 'Schedule of Investments' ELSE 'Statements of Operations' END AS heading
FROM t WHERE near <> '__supporting__' AND f <> 9 AND (f <> 8 OR near <> '')
""")
def html_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing for each customer with a table for each order: one for each of the nine rules, and notes. Headings above some carry over to the next ones."""
    k = F.col("o_orderkey")
    shown = {
        0: ["Consolidated Balance Sheets", "Cash 10 9", "Debt 5 4"], 1: ["Total assets 10 9", "Total liabilities 5 4"], 2: ["Net cash used in operating activities 1 2", "Net cash from financing activities 3 4"],
        3: ["Net assets at beginning 1 2", "Capital unit transactions 3 4", "Contributions for units issued 5 6"], 4: ["Investment income 1 2", "Expenses 3 4", "Net investment income 5 6"], 5: ["Revenue 1 2", "Net income 3 4"],
        6: ["Partners' capital 1 2", "Distributions 3 4"], 7: ["Investments at cost and fair value, percentage of net assets", "Loan A 10 9", "Loan B 8 7"], 8: ["Other 1 2"], 9: ["Notes to Consolidated Financial Statements", "Cash 1 2", "Debt 3 4"],
    }
    lines = F.coalesce(*[F.when(k % 10 == f, F.array(*map(F.lit, own))) for f, own in shown.items()])
    near = F.when(k % 7 == 0, "__supporting__").when(k % 4 == 0, "IncomeStatement").otherwise("")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    tables = read(spark, sf_dir, "orders").select(_show(F.col("o_custkey")).alias("doc_id"), n.alias("table_index"), near.alias("nearby_type"), F.when(near == "IncomeStatement", "Statements of Operations").when(near != "", "Notes").otherwise("").alias("nearby_heading"), lines.alias("lines"))
    return html.classify(tables).select("doc_id", "table_index", "data_lines", "statement_type", "heading")


@query(
    _ORDERS_SQL
    + """
, rows AS (
  SELECT c, 0 AS row_index, 'section' AS kind, 'Operating activities:||' AS cells FROM t
  UNION ALL SELECT c, i, 'data', CASE WHEN k % 3 = 0 THEN 'Changes in goods payable|' ELSE 'Sale of goods|' END || k || '|' || CASE WHEN k % 2 = 0 THEN '(' || p || ')' ELSE p || '' END FROM o
)
SELECT CAST(c AS VARCHAR) AS doc_id, '2026|2025' AS labels, CAST(row_index AS INTEGER) AS row_index, kind, cells, CAST(NULL AS VARCHAR) AS error FROM rows WHERE c % 5 <> 4
UNION ALL SELECT CAST(c AS VARCHAR), NULL, NULL, NULL, NULL, 'A line has more or fewer amounts than columns.' FROM t WHERE c % 5 = 4
"""
)
def cash_flow_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cash-flow statement's page for each customer, orders as its rows, some with labels over two lines; a fifth has a row of three amounts for two years."""
    c = F.col("c")
    amounts = lambda x: F.concat_ws(" ", _show(x["k"]), F.when(x["k"] % 2 == 0, F.concat(F.lit("("), _show(x["p"]), F.lit(")"))).otherwise(_show(x["p"])))
    rows = F.transform("items", lambda x: F.concat(F.when(x["k"] % 3 == 0, "Changes in\ngoods payable ").otherwise("Sale of goods "), amounts(x)))
    shown = F.concat(F.array(F.lit("Statements of Cash Flows"), F.lit("Years Ended December 31, 2026 2025"), F.lit("Operating activities:")), rows, F.array_compact(F.array(F.when(c % 5 == 4, "Purchase of goods 1 2 3"), F.lit("See accompanying notes"))))
    pages = _customers(spark, sf_dir).select(_show(c).alias("doc_id"), F.lit(1).alias("page"), F.lit("CashFlowStatement").alias("statement_type"), F.array_join(shown, "\n").alias("text"))
    return _grid_rows(layouts.cash_flow_grids(pages))


@query("""
WITH l AS (
  SELECT l_orderkey, l_linenumber, max(l_partkey) AS part, max(l_suppkey) AS supp, max(l_returnflag) = 'R' AS wide FROM lineitem GROUP BY ALL
)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_linenumber AS INTEGER) AS line, CAST(0 AS INTEGER) AS phrase, CASE WHEN wide THEN 'Part ' || part ELSE 'Part ' || part || ' of ' || supp END AS text, 0.0::DOUBLE AS x0, CASE WHEN wide THEN 50.0 ELSE 100.0 END::DOUBLE AS x1 FROM l
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS INTEGER), 1, 'of ' || supp, 60.0, 110.0 FROM l WHERE wide
""")
def word_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a line for each part of an order; where more than four points stand between two of them, a new phrase begins."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(_show(F.max("l_partkey")).alias("part"), _show(F.max("l_suppkey")).alias("supp"), F.when(F.max("l_returnflag") == "R", 10.0).otherwise(0.0).alias("off"))
    word = lambda shown, x0, x1, off: F.struct(shown.alias("text"), (off + x0).alias("x0"), (off + x1).alias("x1"))
    none, off = F.lit(0.0), F.col("off")
    words = F.array(word(F.col("supp"), 64.0, 100.0, off), word(F.lit("Part"), 0.0, 20.0, none), word(F.lit("of"), 50.0, 60.0, off), word(F.col("part"), 24.0, 50.0, none))
    own = line.select(_show(F.col("l_orderkey")).alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("int").alias("line"), F.explode(words).alias("w")).select("doc_id", "page", "line", "w.*")
    return grids.phrases(own).select("doc_id", "line", "phrase", "text", "x0", "x1")


@query("""
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT CAST(c AS VARCHAR) AS doc_id, CAST(n AS INTEGER) AS row_index, CASE k % 4 WHEN 0 THEN k || '|5.0% cash/ 2.0% PIK|05/2027' WHEN 1 THEN k || '|5.0%|PIK 05/2027' WHEN 2 THEN k || '|5.0% cash/ 2.0%|05/2027' ELSE k || '|5.0% cash/ 2.0%|PIK 13/2027' END AS cells FROM o
UNION ALL SELECT DISTINCT CAST(c AS VARCHAR), 0, 'Name|Interest|Maturity' FROM o
""")
def schedule_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule for each customer: a PIK sign goes from a maturity to the cash rate on its left, but not to plain rates or from what is no month."""
    k = F.col("o_orderkey")
    rate = F.when(k % 4 == 1, "5.0%").otherwise("5.0% cash/ 2.0%")
    ends = F.when(k % 4 == 2, "05/2027").when(k % 4 == 3, "PIK 13/2027").otherwise("PIK 05/2027")
    rows = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.array(_show(k), rate, ends).alias("row")))), lambda x: x["row"])
    own = read(spark, sf_dir, "orders").groupBy(_show(F.col("o_custkey")).alias("doc_id")).agg(F.concat(F.array(F.array(F.lit("Name"), F.lit("Interest"), F.lit("Maturity"))), rows).alias("rows"))
    return own.select("doc_id", F.posexplode(grids.schedule_display(F.col("rows"))).alias("row_index", "row")).select("doc_id", "row_index", F.array_join("row", "|").alias("cells"))


@query("""
WITH o AS (SELECT o_custkey AS c, o_orderkey % 5 AS f, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
l AS (
  SELECT c, n, 1 AS line_no, CASE f WHEN 0 THEN 'Order ' || k WHEN 4 THEN '  ' ELSE '' END AS raw_text, CASE f WHEN 0 THEN 'TEXT_EXTRACTED' WHEN 1 THEN 'OCR_REQUIRED' WHEN 2 THEN 'OCR_REQUIRED' ELSE 'BLANK' END AS page_status FROM o
  UNION ALL SELECT c, n, 2, k || '', 'TEXT_EXTRACTED' FROM o WHERE f = 0
)
SELECT CAST(c AS VARCHAR) AS doc_id, CAST(n AS INTEGER) AS source_page, CAST(line_no AS INTEGER) AS line_no, raw_text, page_status = 'TEXT_EXTRACTED' AS machine_readable, page_status, CAST(max(n) OVER (PARTITION BY c) AS INTEGER) AS page_count FROM l
""")
def page_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order: lines of text; pictures or more than ten curves without text, to be read from an image; ten curves or blanks alone."""
    k = F.col("o_orderkey")
    f = k % 5
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    shown = F.when(f == 0, F.concat(F.lit("Order "), _show(k), F.lit("\r\n"), _show(k), F.lit("\n"))).when(f == 4, "  ").when(f != 3, "")
    pages = read(spark, sf_dir, "orders").select(_show(F.col("o_custkey")).alias("doc_id"), n.alias("page"), shown.alias("text"), (f == 1).cast("int").alias("n_images"), F.when(f == 2, 11).otherwise(10).alias("n_curves"))
    return text.page_lines(pages).join(text.page_counts(pages), "doc_id").select("doc_id", "source_page", "line_no", "raw_text", "machine_readable", "page_status", "page_count")


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(o_custkey AS VARCHAR) || '-t' AS "Scope", 'Table organization' AS "Check", 'WARN' AS "Status" FROM orders GROUP BY o_custkey HAVING bool_or(o_orderkey % 9 = 0)
UNION ALL SELECT CAST(o_custkey AS VARCHAR), CAST(o_custkey AS VARCHAR) || '-t', 'Source character decoding', 'WARN' FROM orders GROUP BY o_custkey HAVING bool_or(o_orderkey % 11 = 0)
""")
def grid_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each customer; some cells hold two numbers, some a character that couldn't be decoded."""
    k = F.col("o_orderkey")
    row = F.array(F.when(k % 11 == 0, "Ord\ufffdr").otherwise("Order"), F.when(k % 9 == 0, F.concat(_show(k), F.lit(" 7"))).otherwise(_show(k)))
    doc = _show(F.col("o_custkey"))
    own = read(spark, sf_dir, "orders").groupBy(doc.alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("row")))), lambda x: x["row"]).alias("rows"))
    return grids.warnings(own.withColumn("table_id", F.concat("doc_id", F.lit("-t")))).select("doc_id", "Scope", "Check", "Status")
