"""Tables and lines of captured pages, over pages that are laid out from the driver's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.operators import tables
from ledgerflow.queries import ORACLE_SQL, QUERIES, query, read
from ledgerflow.staging import dealt

__all__ = ["ORACLE_SQL", "QUERIES"]

_LINES_SQL = """
WITH lines AS (
  SELECT l_orderkey, l_linenumber, max(l_partkey) AS part, CAST(max(l_quantity) AS BIGINT) AS quantity, max(l_linestatus) = 'O' AS joined FROM lineitem GROUP BY l_orderkey, l_linenumber
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS row_index, bool_or(NOT joined) OVER (PARTITION BY l_orderkey) AS parted, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lines
)
"""


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source_page, edges, words: a page for each order with a row for each line number. The last two columns are one cell where the line is open."""
    items = read(spark, sf_dir, "lineitem")
    own = dealt(items.select(F.col("l_orderkey").cast("string").alias("doc_id"), "l_linenumber", "l_partkey", "l_quantity", "l_linestatus"), "doc_id")
    line = own.groupBy("doc_id", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_quantity").cast("long").alias("quantity"), (F.max("l_linestatus") == "O").alias("joined"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_linenumber"))
    line = line.select("doc_id", F.lit(1).alias("source_page"), (nth * 20.0).alias("y"), *line.columns[1:])
    y = F.col("y")

    def box(x0: float, x1: float, top: Column, bottom: Column, when: Column | None = None) -> Column:
        made = F.struct(F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), top.alias("top"), bottom.alias("bottom"))
        return made if when is None else F.when(when, made)

    edges = F.array(*[box(0.0, 300.0, y + a, y + a) for a in (0, 20)], *[box(x, x, y, y + 20) for x in (0.0, 100.0, 300.0)], box(200.0, 200.0, y, y + 20, ~F.col("joined")))
    word = lambda text, x: F.struct(text.alias("text"), F.lit(x).alias("x0"), F.lit(x + 30).alias("x1"), (y + 6).alias("top"), (y + 14).alias("bottom"))
    words = F.array(word(F.concat(F.lit("#"), F.col("l_linenumber").cast("string")), 10.0), word(F.col("quantity").cast("string"), 110.0), word(F.col("part").cast("string"), 210.0))
    whole = lambda found, name: F.flatten(F.collect_list(F.array_compact(found))).alias(name)
    return line.groupBy("doc_id", "source_page").agg(whole(edges, "edges"), whole(words, "words"))


@query(
    _LINES_SQL
    + """
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, row_index, CAST(0 AS INTEGER) AS column_index, CAST(1 AS INTEGER) AS colspan, '#' || l_linenumber AS raw_text FROM placed
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), row_index, 1, CASE WHEN joined AND parted THEN 2 ELSE 1 END, CASE WHEN joined THEN quantity || ' ' || part ELSE quantity || '' END FROM placed
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), row_index, 2, 1, part || '' FROM placed WHERE NOT joined
"""
)
def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that rules bound, with what stands in them. tests/test_tables.py has random rectangles and rules off their places."""
    return tables.named(_order_pages(spark, sf_dir), tables.ruled(), "ruled").select("doc_id", "row_index", "column_index", "colspan", "raw_text")


@query(
    _LINES_SQL
    + """
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, flavor, CAST(CASE WHEN flavor = 'ruled' OR max(n) > 1 THEN 1 ELSE 0 END AS BIGINT) AS "tables", CAST(CASE WHEN flavor = 'ruled' OR max(n) > 1 THEN max(n) ELSE 0 END AS BIGINT) AS "rows",
  CAST(3 * max(n) AS BIGINT) AS reference_tokens, CAST(CASE WHEN flavor = 'ruled' OR max(n) > 1 THEN 3 * max(n) ELSE 0 END AS BIGINT) AS matched_tokens, CASE WHEN flavor = 'ruled' OR max(n) > 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall
FROM placed, (VALUES ('ruled'), ('spaced')) f(flavor) GROUP BY l_orderkey, flavor
"""
)
def table_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways to find tables on the same pages, and how many of their texts' numbers each has; one line alone is no block."""
    pages = _order_pages(spark, sf_dir)
    cells = lambda found: F.transform(found, lambda c: F.struct(c["table_index"].alias("table"), c["row_index"].alias("row_index"), c["raw_text"].alias("raw_text")))
    found = pages.select(*tables.PAGE, F.transform("words", lambda w: w["text"]).alias("texts"), tables.ruled().alias("ruled"), tables.spaced().alias("spaced"))
    metrics = tables.page_metrics(found.select(*tables.PAGE, "texts", *[cells(m).alias(m) for m in ("ruled", "spaced")]))
    return metrics.select("doc_id", "flavor", "tables", "rows", "reference_tokens", "matched_tokens", "recall")


@query("""
WITH placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS row_index, count(*) OVER (PARTITION BY o_custkey) AS n, CAST(bool_or(o_orderstatus <> 'O') OVER (PARTITION BY o_custkey) AS INTEGER) AS middle FROM orders
)
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, row_index, CAST(0 AS INTEGER) AS column_index, 'Order ' || o_orderkey AS raw_text, CAST(10 AS DOUBLE) AS x0, CAST(70 AS DOUBLE) AS x1 FROM placed WHERE n > 1
UNION ALL SELECT CAST(o_custkey AS VARCHAR), row_index, 1, o_orderstatus, 90 + o_orderkey % 3, 110 + o_orderkey % 3 FROM placed WHERE n > 1 AND o_orderstatus <> 'O'
UNION ALL SELECT CAST(o_custkey AS VARCHAR), row_index, 1 + middle, CAST(floor(o_totalprice) AS BIGINT) || '', 130, 180 FROM placed WHERE n > 1
""")
def spaced_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer with a line for each order: columns by the white between words, where a customer may have no middle one."""
    orders = read(spark, sf_dir, "orders")
    own = dealt(orders.select(F.col("o_custkey").cast("string").alias("doc_id"), "o_orderkey", "o_orderstatus", "o_totalprice"), "doc_id")
    y = F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey")) * 12.0
    own = own.withColumns({"y": y, "shift": (F.col("o_orderkey") % 3).cast("double")})
    word = lambda text, x0, x1: F.struct(text.alias("text"), x0.alias("x0"), x1.alias("x1"), F.col("y").alias("top"), (F.col("y") + 8).alias("bottom"))
    status = F.when(F.col("o_orderstatus") != "O", word(F.col("o_orderstatus"), F.col("shift") + 90, F.col("shift") + 110))
    words = F.array(word(F.lit("Order"), F.lit(10.0), F.lit(40.0)), word(F.col("o_orderkey").cast("string"), F.lit(43.0), F.lit(70.0)), status, word(F.floor("o_totalprice").cast("string"), F.lit(130.0), F.lit(180.0)))
    page = own.select("doc_id", F.lit(1).alias("source_page"), F.explode(F.array_compact(words)).alias("w")).select("doc_id", "source_page", "w.*")
    return tables.spaced_cells(page).select("doc_id", "row_index", "column_index", "raw_text", "x0", "x1")
