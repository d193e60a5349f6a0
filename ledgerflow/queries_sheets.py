"""What stands on sheets, and rules for their layout, over the driver's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.operators import sheets
from ledgerflow.queries import ORACLE_SQL, QUERIES, query, read
from ledgerflow.staging import dealt

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("""
WITH r AS (
  SELECT o_custkey, o_orderkey, o_orderkey % 4 AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 4 <> 3
)
SELECT o_custkey AS doc_id, CAST(n - 1 AS INTEGER) AS row_index, CASE WHEN k = 2 THEN o_orderkey || '|||' WHEN k = 1 THEN o_orderkey || '|' || (o_orderkey % 50) || '||' ELSE o_orderkey || '|' || (o_orderkey % 50) || '%||' END AS cells,
  CASE WHEN k = 2 THEN 3 ELSE 1 END AS width FROM r
""")
def literal_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each customer: rates with a percent sign beside them, captions over three columns with text under the span, and empty rows."""
    key = F.col("o_orderkey")
    k, show = key % 4, key.cast("string")
    rate = (key % 50).cast("string")
    row = F.when(k == 0, F.array(show, rate, F.lit("%"), F.lit(""))).when(k == 1, F.array(show, rate, F.lit(""), F.lit(""))).when(k == 2, F.array(show, F.lit("under"), F.lit("it"), F.lit(""))).otherwise(F.array(*[F.lit("")] * 4))
    own = dealt(read(spark, sf_dir, "orders"), "o_custkey").withColumn("n", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int"))
    span = F.when(k == 2, F.struct(F.col("n").alias("r"), F.lit(0).alias("c"), F.lit(1).alias("rs"), F.lit(3).alias("cs")))
    grids = own.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("row")))), lambda x: x["row"]).alias("rows"), F.collect_list(span).alias("spans"))
    shown = sheets.displayed(grids).select("doc_id", "spans", F.posexplode("rows").alias("row_index", "row"))
    width = F.coalesce(F.get(F.transform(F.filter("spans", lambda s: s["r"] == F.col("row_index")), lambda s: s["cs"]), F.lit(0)), F.lit(1))
    return shown.select("doc_id", "row_index", F.array_join("row", "|").alias("cells"), width.alias("width"))


@query("""
WITH c AS (
  SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, max(l_partkey) AS part FROM lineitem GROUP BY ALL
), t AS (
  SELECT l_suppkey, l_returnflag, l_orderkey, max(l_linenumber) AS high FROM c GROUP BY ALL
), placed AS (
  SELECT *, coalesce(sum(high + 4) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM t
)
SELECT l_suppkey AS doc_id, l_returnflag AS flavor, CAST(top AS INTEGER) AS "row", CAST(i AS INTEGER) AS "column", CASE i WHEN 0 THEN 'Table: t' || l_orderkey WHEN 1 THEN 'Page: ' || l_orderkey WHEN 2 THEN 'Selected: No' END AS text FROM placed, (VALUES (0), (1), (2)) v(i)
UNION ALL SELECT c.l_suppkey, c.l_returnflag, CAST(top + 1 + l_linenumber AS INTEGER), 1, part || '' FROM c JOIN placed p ON c.l_suppkey = p.l_suppkey AND c.l_returnflag = p.l_returnflag AND c.l_orderkey = p.l_orderkey
""")
def raw_method_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each candidate cell stands on the raw sheet of its method: a supplier is a filing, a return flag a method, an order a page with one table."""
    cells = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber").agg(F.max("l_partkey").cast("string").alias("raw_text"))
    named = cells.select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("flavor"), F.col("l_orderkey").alias("source_page"), F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("table_id"), F.col("l_linenumber").alias("row_index"), F.lit(1).alias("column_index"), "raw_text")
    return sheets.raw_cells_by_method(named)


@query("""
WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_custkey % 11 AS k FROM customer)
SELECT doc_id, 'S' AS sheet, CASE k WHEN 0 THEN 'hidden_sheet' WHEN 1 THEN 'merged_cells' WHEN 2 THEN 'freeze_or_split_panes' WHEN 3 THEN 'hidden_or_zero_height_default_rows' WHEN 4 THEN 'zero_width_default_columns'
  WHEN 5 THEN 'hidden_or_zero_width_column' WHEN 6 THEN 'hidden_or_zero_height_row' WHEN 7 THEN 'nonempty_margin' WHEN 8 THEN 'excel_error_cell' ELSE 'left_margin_width_2' END AS problem FROM s WHERE k < 10
""")
def layout_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a sheet for each customer, every one but an eleventh of which breaks one rule. tests/test_sheets.py reads the facts from files."""
    own = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit("S").alias("sheet"), (F.col("c_custkey") % 11).alias("k"))
    k = F.col("k")
    kinds = {c.split()[0]: c.split()[1] for c in sheets.FACTS.split(", ")[2:]}

    def fact(name: str, **values) -> F.Column:
        given = {"fact": name, **values}
        return F.struct(*[(given[c] if isinstance(given.get(c), F.Column) else F.lit(given.get(c))).cast(kind).alias(c) for c, kind in kinds.items()])

    last = F.when(k == 9, 1).otherwise(2)
    always = [
        fact("sheet", kind=F.when(k == 0, "hidden").otherwise("visible")), fact("columns", first=1, last=last, hidden=False, size=sheets.MARGIN_WIDTH), fact("columns", first=4, last=5, hidden=k == 5, size=9.0),
        fact("default_row", hidden=k == 3, size=15.0), fact("default_column", hidden=False, size=F.when(k == 4, 0.0).otherwise(9.0)), fact("row", row=4, hidden=False, size=F.when(k == 6, 0.0)),
        fact("cell", row=F.when(k == 7, 3).otherwise(4), first=3, last=3, kind=F.when(k == 8, "e").otherwise("n"), filled=True), fact("cell", row=1, first=1, last=1, kind="n", filled=False),
    ]
    some = [F.when(k == 1, fact("merge", kind="C4:D4")), F.when(k == 2, fact("pane", kind="frozen"))]
    facts = own.select("doc_id", "sheet", F.explode(F.array_compact(F.array(*always, *some))).alias("f")).select("doc_id", "sheet", "f.*")
    return sheets.layout_issues(facts)
