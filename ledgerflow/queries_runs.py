"""Alignments, digest trees, receipts, evidence and run comparisons over the driver's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators import alignment, run_diff, trees
from ledgerflow.queries import ORACLE_SQL, QUERIES, query, read

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("""
SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderpriority) - 1 AS INTEGER) AS pos, o_orderpriority AS label FROM orders WHERE o_orderstatus = 'F'
""")
def row_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts between the order priorities of two statuses, applied to the first side: what comes out is the second. tests/test_alignment.py tells how short they are."""
    side = lambda s: read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("row"), F.col("o_orderpriority").alias("label"))
    script = alignment.aligned(side("O"), side("F"), ["doc"])
    return alignment.applied(side("O"), side("F"), script, ["doc"])


@query("""
WITH o AS (
  SELECT o_custkey AS doc, row_number() OVER w - 1 AS b, o_orderkey % 7 <> 0 AS stays, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS same, CAST(o_orderkey % 7 <> 0 AS INTEGER) + CAST(o_orderkey % 5 = 0 AS INTEGER) AS come FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
), placed AS (
  SELECT *, coalesce(sum(come) OVER (PARTITION BY doc ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM o
), equal AS (
  SELECT doc, b, a, row_number() OVER (PARTITION BY doc ORDER BY b) AS n FROM placed WHERE same
), runs AS (
  SELECT doc, min(b) AS b, max(b) + 1 AS b1, min(a) AS a, max(a) + 1 AS a1 FROM equal GROUP BY doc, b - n, a - n
  UNION ALL SELECT doc, count(*), count(*), sum(come), sum(come) FROM o GROUP BY doc
), steps AS (
  SELECT *, coalesce(lag(b1) OVER w, 0) AS pb, coalesce(lag(a1) OVER w, 0) AS pa FROM runs WINDOW w AS (PARTITION BY doc ORDER BY b, a, b1)
)
SELECT doc, 'equal' AS op, CAST(b AS INTEGER) AS before_from, CAST(b1 AS INTEGER) AS before_to, CAST(a AS INTEGER) AS after_from, CAST(a1 AS INTEGER) AS after_to FROM steps WHERE b1 > b
UNION ALL SELECT doc, CASE WHEN b > pb AND a > pa THEN 'replace' WHEN b > pb THEN 'delete' ELSE 'insert' END, CAST(pb AS INTEGER), CAST(b AS INTEGER), CAST(pa AS INTEGER), CAST(a AS INTEGER) FROM steps WHERE b > pb OR a > pa
""")
def edit_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders before and after: every seventh is gone, every eleventh has another label, and after every fifth stands a new row."""
    own = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", F.col("o_orderkey").cast("string").alias("label"))
    key = F.col("o_orderkey")
    before = own.select("doc", (key * 2).alias("row"), "label")
    kept = F.when(key % 7 != 0, F.struct((key * 2).alias("row"), F.when(key % 11 == 0, F.concat("label", F.lit("*"))).otherwise(F.col("label")).alias("label")))
    new = F.when(key % 5 == 0, F.struct((key * 2 + 1).alias("row"), F.concat(F.lit("+"), "label").alias("label")))
    after = own.select("doc", F.explode(F.array_compact(F.array(kept, new))).alias("x")).select("doc", "x.*")
    return alignment.aligned(before, after, ["doc"])


def _order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each order, in folders by year and month of its customer's run."""
    own = read(spark, sf_dir, "orders")
    path = F.concat(F.date_format("o_orderdate", "yyyy/MM/"), F.col("o_orderkey").cast("string"))
    return own.select(F.col("o_custkey").alias("run_id"), path.alias("path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"), (F.col("o_orderkey") % 20).alias("k"))


@query("""
WITH f AS (SELECT o_custkey AS run_id, strftime(o_orderdate, '%Y/%m/') || o_orderkey AS path, o_orderkey, o_orderkey % 20 AS k FROM orders)
SELECT run_id, path, CASE k WHEN 0 THEN 'REMOVED' ELSE 'CHANGED' END AS code, CAST(NULL AS VARCHAR) AS moved_from FROM f WHERE k IN (0, 1)
UNION ALL SELECT run_id, 'moved/' || path, 'MOVED', path FROM f WHERE k = 2
UNION ALL SELECT run_id, path || '.new', 'ADDED', NULL FROM f WHERE k = 3
""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of every customer's files: one in twenty is gone, changed, moved, or has a new one beside it."""
    before = _order_files(spark, sf_dir)
    k, path = F.col("k"), F.col("path")
    digest = F.when(k == 1, F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256"))
    kept = F.when(k != 0, F.struct(F.when(k == 2, F.concat(F.lit("moved/"), path)).otherwise(path).alias("path"), digest.alias("sha256")))
    new = F.when(k == 3, F.struct(F.concat(path, F.lit(".new")).alias("path"), F.sha2(path, 256).alias("sha256")))
    after = before.select("run_id", F.explode(F.array_compact(F.array(kept, new))).alias("x")).select("run_id", "x.*")
    sides = [trees.tree(x, ["run_id"]) for x in (before, after)]
    return trees.changed_files(*sides, ["run_id"])


@query("""
SELECT o_custkey AS run_id, count(*) AS n_files, CASE o_custkey % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'ALTERED' ELSE 'UNFINISHED' END AS state FROM orders GROUP BY o_custkey
""")
def verified_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of every customer's files: the root of a second tree over the same files, one of other files, or none."""
    files = _order_files(spark, sf_dir)
    again = trees.roots(trees.tree(files.withColumn("sha256", F.when(F.col("run_id") % 3 == 1, F.lit("other")).otherwise(F.col("sha256"))), ["run_id"]), ["run_id"])
    receipts = again.select("run_id", F.when(F.col("run_id") % 3 != 2, F.col("root")).alias("receipt"))
    nodes = trees.tree(files, ["run_id"])
    return trees.verified_receipts(receipts, nodes, ["run_id"]).join(trees.roots(nodes, ["run_id"]), "run_id").select("run_id", "n_files", "state")


@query("""
WITH f AS (SELECT o_custkey AS run_id, CASE WHEN o_orderkey % 20 = 4 THEN '../' ELSE '' END || strftime(o_orderdate, '%Y/%m/') || o_orderkey AS path, o_orderkey % 20 AS k FROM orders)
SELECT run_id, path, CASE k WHEN 0 THEN 'LOST' WHEN 1 THEN 'ALTERED' WHEN 2 THEN 'UNREGISTERED' ELSE 'OUTSIDE' END AS problem FROM f WHERE k IN (0, 1, 2, 4)
UNION ALL SELECT DISTINCT run_id, 'source.pdf', 'REQUIRED' FROM f WHERE k <> 2
""")
def evidence_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's files against a manifest: some aren't there, changed, not registered or outside, and none has its source."""
    k = F.col("k")
    named = _order_files(spark, sf_dir).withColumn("path", F.when(k == 4, F.concat(F.lit("../"), "path")).otherwise(F.col("path")))
    manifest = named.filter(k != 2).withColumn("sha256", F.when(k == 1, F.lit("0")).otherwise(F.upper("sha256")))
    return trees.evidence(named.filter(k != 0), manifest, ("source.pdf",), ["run_id"])


@query("""
WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS run_id, c_custkey % 9 AS k FROM customer),
o AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, o_orderkey % 13 = 0 AS gone, o_orderkey % 17 = 0 AS other, row_number() OVER w AS n, lag(o_orderkey % 13 = 0) OVER w AS before FROM orders WHERE o_custkey % 9 IN (0, 4, 8) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT run_id, CASE k WHEN 1 THEN 'known_failure' WHEN 2 THEN 'failed' WHEN 3 THEN 'recovered' WHEN 5 THEN 'invalid' WHEN 6 THEN 'removed' WHEN 7 THEN 'added' ELSE 'compared' END AS verdict, code, CAST(n AS BIGINT) AS n FROM c JOIN (
  SELECT run_id, CASE k WHEN 2 THEN 'NEW_OR_CHANGED_RUN_FAILURE' WHEN 3 THEN 'RECOVERED_RUN_REQUIRES_SOURCE_REVIEW' WHEN 4 THEN 'SELECTED_PAGES_CHANGED' WHEN 5 THEN 'RUN_IDENTITY_CHANGED' WHEN 6 THEN 'RUN_REMOVED' WHEN 7 THEN 'RUN_ADDED' ELSE 'PERIOD_UNIT_OR_SOURCE_CONTEXT_CHANGED' END AS code, 1 AS n FROM c WHERE k BETWEEN 2 AND 8
  UNION ALL SELECT run_id, 'ROW_VALUES_OR_FIELDS_CHANGED', count(*) FROM o WHERE other AND NOT gone GROUP BY run_id
  UNION ALL SELECT run_id, 'ROWS_REMOVED_ADDED_OR_REORDERED', count(*) FROM o WHERE gone AND NOT coalesce(before, false) GROUP BY run_id
) e USING (run_id)
UNION ALL SELECT run_id, 'known_failure', NULL, 0 FROM c WHERE k = 1
UNION ALL SELECT run_id, 'compared', NULL, 0 FROM c WHERE k = 0 AND run_id NOT IN (SELECT run_id FROM o WHERE gone OR other)
""")
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of a run for each customer, one for every transition; a customer's orders are the rows of its only statement."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("run_id"), (F.col("c_custkey") % 9).alias("k"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), "o_orderkey")
    k, key = F.col("k"), F.col("o_orderkey")

    def side(new: bool) -> run_diff.Runs:
        failed = k.isin(1, 2) if new else k.isin(1, 3)
        entity = F.when((k == 5) & F.lit(new), "another").otherwise("same")
        pages = F.when((k == 4) & F.lit(new), F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))
        own = customers.filter(k != (6 if new else 7))
        identity = [entity.alias(c) if c == "entity" else F.lit("x").alias(c) for c in run_diff.IDENTITY]
        error = F.when(failed, "unreadable")
        runs = own.select("run_id", *identity, F.when(failed, "failed").otherwise("completed").alias("status"), error.alias("error_type"), error.alias("error"), F.lit("auto").alias("pages"), pages.alias("selected_pages"))
        unit = F.when((k == 8) & F.lit(new), "millions").otherwise("thousands")
        context = [unit.alias(c) if c == "unit_label" else F.lit(None).cast("string").alias(c) for c in run_diff.CONTEXT if c != "source_pages"]
        statements = own.select("run_id", F.lit("BalanceSheet").alias("kind"), F.lit("Balance").alias("sheet"), *context)
        tables = statements.select("run_id", "kind", F.explode(F.array(F.lit(7), F.lit(5))).alias("source_page"))
        value = F.concat(key.cast("string"), F.lit("*" if new else ""))
        cells = F.array(F.when(key % 17 == 0, value).otherwise(key.cast("string")))
        rows = orders.filter(key % 13 != 0) if new else orders
        rows = rows.select("run_id", F.lit("BalanceSheet").alias("kind"), key.cast("int").alias("row"), key.cast("string").alias("key"), F.concat(F.lit("Order "), key.cast("string")).alias("label"), cells.alias("cells"), F.lit(True).alias("critical"))
        return run_diff.Runs(runs, run_diff.statement_contexts(statements, tables), rows)

    verdicts, events = run_diff.compared(side(False), side(True))
    counts = events.groupBy("run_id", "code").agg(F.count("*").alias("n"))
    return verdicts.join(counts, "run_id", "left").select("run_id", "verdict", "code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
