"""Each operator over the driver's tables, and the same as SQL. The tables hold no filings, so records are derived from their rows; every query reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.functions import names, text, tokens, units
from ledgerflow.operators import audits, completeness, coverage, diff, grids, mapping, sections, statements
from ledgerflow.plans import pages as plans
from ledgerflow.sources import html
from ledgerflow.sources import text as text_source
from ledgerflow.staging import dealt

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scalar functions


@query("""
WITH r AS (
  SELECT l_linenumber % 7 AS k, CAST(l_quantity AS BIGINT) AS v FROM lineitem
), t AS (
  SELECT CASE k WHEN 1 THEN 'NUMERIC' WHEN 2 THEN 'NUMERIC' WHEN 3 THEN 'DASH' WHEN 4 THEN 'NA' WHEN 5 THEN 'NUMERIC' WHEN 6 THEN 'BLANK' ELSE 'NUMERIC' END AS status,
    CASE k WHEN 1 THEN '$' WHEN 0 THEN '$' ELSE '' END AS currency, k = 2 AS is_percent, k = 5 AS is_ratio, CASE WHEN k = 1 THEN 2 WHEN k IN (0, 2, 5) THEN 0 END AS "precision",
    CASE k WHEN 1 THEN -(v * 100 + 25) WHEN 2 THEN v WHEN 5 THEN v * 100 WHEN 0 THEN v * 100000 END AS cents FROM r
)
SELECT status, currency, is_percent, is_ratio, "precision", count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM t GROUP BY ALL
""")
def token_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_quantity").cast("long").cast("string")
    k = F.col("l_linenumber") % 7
    raw = F.when(k == 1, F.concat(F.lit("($"), v, F.lit(".25)"))).when(k == 2, F.concat(v, F.lit("%"))).when(k == 3, "—").when(k == 4, "N/A").when(k == 5, F.concat(v, F.lit(" x"))).when(k == 6, " ").otherwise(F.concat(F.lit("$ "), v, F.lit(",000")))
    t = tokens.with_token(read(spark, sf_dir, "lineitem").select(raw.alias("raw")), "raw", "t").select("t.*")
    return t.groupBy("status", "currency", "is_percent", "is_ratio", "precision").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("""
WITH n AS (
  SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN '(In millions, except number of shares, which are reflected in thousands)' WHEN 1 THEN '$000' WHEN 2 THEN '(in billions of USD)'
    WHEN 3 THEN '(In millions or billions)' WHEN 4 THEN '(€ in thousands)' ELSE n_name END AS note FROM nation
)
SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'millions' WHEN 1 THEN 'thousands' WHEN 2 THEN 'billions' WHEN 4 THEN 'thousands' ELSE 'reported units' END AS unit_label,
  CAST(CASE n_nationkey % 6 WHEN 0 THEN 1000000 WHEN 1 THEN 1000 WHEN 2 THEN 1000000000 WHEN 4 THEN 1000 ELSE 1 END AS BIGINT) AS scale_factor,
  CASE WHEN contains(note, '$') OR contains(lower(note), 'usd') THEN 'USD' WHEN contains(note, '€') THEN 'EUR' ELSE '' END AS currency,
  CASE n_nationkey % 6 WHEN 0 THEN 'thousands' END AS share_unit_label FROM n
""")
def unit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 6
    note = F.when(k == 0, "(In millions, except number of shares, which are reflected in thousands)").when(k == 1, "$000").when(k == 2, "(in billions of USD)").when(k == 3, "(In millions or billions)").when(k == 4, "(€ in thousands)").otherwise(F.col("n_name"))
    return read(spark, sf_dir, "nation").select("n_nationkey", units.classify(note).alias("u")).select("n_nationkey", "u.unit_label", "u.scale_factor", "u.currency", "u.share_unit_label")


@query(r"""
SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normalized, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM documents
""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = text.normalize(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", plain.alias("normalized"), F.length(plain).cast("long").alias("n"))


@query(r"SELECT page_id, regexp_replace(translate(lower(url), '—,', '-'), '[^a-z0-9-]', '', 'g') AS mark FROM pages")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.fingerprint(F.col("url")).alias("mark"))


@query(r"""
SELECT p_partkey, lower(trim(regexp_replace(p_name || ' ' || p_brand, '\s+', ' ', 'g'))) AS key, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 1000 || '' ELSE '' END AS note FROM part
""")
def label_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" ("), (F.col("p_partkey") % 1000).cast("string"), F.lit(")"))).otherwise("")
    label = F.concat("p_name", F.lit("  "), "p_brand", note)
    return read(spark, sf_dir, "part").select("p_partkey", text.label_key(label).alias("key"), text.split_note(label)["note"].alias("note"))


@query("""
SELECT c_custkey, 'FY' || right(CAST(2000 + c_custkey % 30 AS VARCHAR), 2) || CASE WHEN c_custkey % 2 = 1 AND c_custkey % 5 IN (1, 2, 3, 4) THEN '_Q' || (c_custkey % 5) ELSE '' END || CASE WHEN c_custkey % 2 = 1 THEN '_10Q_' ELSE '_10K_' END || replace(c_name, '#', '_') || '.xlsx' AS name FROM customer
""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", names.output_name(F.col("c_name"), (c % 30 + 2000).cast("string"), F.concat(F.lit("q"), (c % 5).cast("string")), F.when(c % 2 == 1, "10-Q").otherwise("10-K")).alias("name"))


@query("""
SELECT l_returnflag, length(rtrim(split_part(CAST(CAST(l_discount AS DECIMAL(10,6)) AS VARCHAR), '.', 2), '0')) AS digits, count(*) AS n FROM lineitem GROUP BY ALL
""")
def display_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", tokens.display_precision(F.col("l_discount")).cast("long").alias("digits")).agg(F.count("*").alias("n"))


# Scans and ordered state


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no, md5(line) AS line_md5 FROM l
""".replace("\\\\n", "\\n"))
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_source.pasted(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("raw_text").alias("line_md5"))


@query("""
WITH p AS (SELECT DISTINCT o_custkey, CAST(o_orderkey % 60 AS INTEGER) AS page FROM orders),
i AS (SELECT *, page - row_number() OVER (PARTITION BY o_custkey ORDER BY page) AS island FROM p),
r AS (SELECT o_custkey, min(page) AS a, max(page) AS b FROM i GROUP BY o_custkey, island)
SELECT o_custkey, string_agg(CASE WHEN a = b THEN a || '' ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY o_custkey
""")
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 60).cast("int").alias("page"))
    return sections.page_ranges(pages, ["o_custkey"], "page")


@query("""
WITH s AS (SELECT o_custkey, CAST(o_orderkey % 500 AS BIGINT) AS a, CAST(o_orderkey % 500 + o_orderkey % 37 AS BIGINT) AS b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT o_custkey, min(a) AS "first", max(b) AS "last", max(b) - min(a) + 1 AS n_pages FROM i GROUP BY o_custkey, island
""")
def requested_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return plans.merged_ranges(read(spark, sf_dir, "orders").select("o_custkey", (k % 500).alias("first"), (k % 500 + k % 37).alias("last")), ["o_custkey"])


@query("""
WITH s AS (SELECT c_custkey, CAST(c_custkey % 20 AS INTEGER) AS a, CAST(c_custkey % 20 + c_custkey % 4 AS INTEGER) AS b FROM customer)
SELECT c_custkey, CAST(unnest(generate_series(greatest(a, 1), least(b, 18))) AS INTEGER) AS page FROM s
""")
def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    spec = F.concat((k % 20).cast("string"), F.lit("-"), (k % 20 + k % 4).cast("string"), F.lit(", x, 9-3"))
    return plans.requested_pages(read(spark, sf_dir, "customer").select("c_custkey", spec.alias("spec"), F.lit(18).alias("page_count"))).select("c_custkey", "page")


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations
""")
def sections_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", sections.carried(F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], ["turn"]).alias("section"))


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events
""")
def nearest_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", sections.carried(F.when(F.col("event_type") == "error", F.col("event_id")), ["user_id"], ["ts", "event_id"]).alias("heading"))


@query("""
WITH c AS (SELECT o_custkey % 50 AS doc, o_orderpriority AS kind, CAST(o_orderkey AS BIGINT) AS idx, CAST(o_orderkey % 9 AS BIGINT) AS w FROM orders),
i AS (SELECT *, idx - row_number() OVER (PARTITION BY doc, kind ORDER BY idx) AS island FROM c),
s AS (SELECT doc, kind, min(idx) AS "first", max(idx) AS "last", CAST(sum(w) AS BIGINT) AS weight FROM i GROUP BY doc, kind, island)
SELECT doc, kind, "first", "last", weight FROM (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY weight DESC, "first") AS n FROM s) WHERE n = 1
""")
def html_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return sections.best_runs(read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("doc"), F.col("o_orderpriority").alias("kind"), k.alias("idx"), (k % 9).alias("w")), ["doc", "kind"], "idx", "w")


@query("""
SELECT o_custkey AS doc_id, CAST(o_orderkey AS BIGINT) AS page, o_orderstatus <> 'P' AS suggested, count(*) OVER (PARTITION BY o_custkey) > 20 AS review_required,
  count(*) OVER (PARTITION BY o_custkey) <= 20 AS selected FROM orders
""")
def page_plan_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), (F.col("o_orderstatus") != "P").alias("suggested"), (F.count("*").over(Window.partitionBy("o_custkey")) > 20).alias("review_required"))
    return plans.resolve(plan, "review")


# Statements: nations as filings, years as periods


_STATEMENT = """
WITH f AS (
  SELECT c_nationkey AS doc, CAST(extract(year FROM o_orderdate) AS VARCHAR) AS period, o_orderstatus AS st, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
)
"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("doc"), F.year("o_orderdate").cast("string").alias("period"), F.col("o_orderstatus").alias("st")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("v"))


def _values(facts: DataFrame, kind: str, items: dict[str, tuple[str, str]]) -> DataFrame:
    """Long values: items maps a status to (standard item, context)."""
    pairs = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(i).alias("standard_item"), F.lit(c).alias("context")) for s, (i, c) in items.items()])
    own = facts.withColumn("x", F.explode(F.filter(pairs, lambda p: p["s"] == F.col("st"))))
    return own.select(F.col("doc").cast("string").alias("doc_id"), F.lit(kind).alias("statement_type"), "period", "x.standard_item", "x.context", F.lit("exact_concept").alias("mapping_relationship"), F.col("v").cast("double").alias("parsed_value"))


#: The years of the orders.
_YEARS = tuple(str(y) for y in range(1992, 2002))


@query(_STATEMENT + f"""SELECT doc, st, {", ".join(f"CAST(sum(v) FILTER (period = '{y}') AS BIGINT) AS y{y}" for y in _YEARS)}, CAST(sum(v) FILTER (period NOT IN {_YEARS}) AS BIGINT) AS other FROM f GROUP BY doc, st""")
def statement_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _facts(spark, sf_dir).withColumn("period", F.when(F.col("period").isin(*_YEARS), F.concat(F.lit("y"), "period")).otherwise("other"))
    return named.groupBy("doc", "st").pivot("period", [*(f"y{y}" for y in _YEARS), "other"]).agg(F.sum("v"))


@query(_STATEMENT + "SELECT CAST(doc AS VARCHAR) AS doc_id, st, period, v FROM f")
def statement_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select(F.col("doc").cast("string").alias("doc_id"), "st", "period", "v")


_BALANCE_ITEMS = {"O": ("Total Liabilities", "LIABILITY"), "F": ("Total Equity", "EQUITY")}


def _balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liabilities and equity from two statuses; assets are their sum, less three in odd nations, and missing where the third status is."""
    facts = _facts(spark, sf_dir)
    parts = _values(facts, "BalanceSheet", _BALANCE_ITEMS)
    both = facts.groupBy("doc", "period").agg(F.sum(F.when(F.col("st") != "P", F.col("v"))).alias("v"), F.max(F.col("st") == "P").alias("has"))
    total = both.filter("has").select("doc", "period", F.lit("A").alias("st"), (F.col("v") - F.when(F.col("doc") % 2 == 1, F.col("v") / 100).otherwise(0)).alias("v"))
    return parts.unionByName(_values(total, "BalanceSheet", {"A": ("Total Assets", "ASSET")}))


_BALANCE_SQL = _STATEMENT + """
, b AS (SELECT doc, period, sum(v) FILTER (st = 'O') AS l, sum(v) FILTER (st = 'F') AS e, coalesce(bool_or(st = 'P'), false) AS has, sum(v) FILTER (st <> 'P') AS t FROM f GROUP BY doc, period),
a AS (SELECT *, CASE WHEN has AND t IS NOT NULL THEN t - CASE WHEN doc % 2 = 1 THEN CAST(t AS DOUBLE) / 100 ELSE 0 END END AS assets FROM b),
c AS (SELECT *, assets - (l + e) AS d, greatest(1.0, abs(assets) * 1e-6, abs(l + e) * 1e-6) AS tol FROM a WHERE has OR l IS NOT NULL OR e IS NOT NULL)
"""


@query(_BALANCE_SQL + """
SELECT CAST(doc AS VARCHAR) AS doc_id, period AS "Scope", CASE WHEN d IS NULL THEN 'NOT_TESTED' WHEN abs(d) <= tol THEN 'PASS' ELSE 'FAIL' END AS "Status", CAST(round(d) AS BIGINT) AS difference FROM c
""")
def balance_equation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = audits.balance_checks(_balance(spark, sf_dir)).filter(F.col("Check").rlike("^Assets =|equation$"))
    return checks.select("doc_id", "Scope", "Status", F.round("difference").cast("long").alias("difference"))


_CASH_ITEMS = {"O": ("Cash and Cash Equivalents at Beginning of Period", "X"), "F": ("Net Increase (Decrease) in Cash and Cash Equivalents", "X")}


def _cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    both = facts.filter("st <> 'P'").groupBy("doc", "period").agg(F.sum("v").alias("v"), F.count("*").alias("n")).filter("n = 2")
    end = both.select("doc", "period", F.lit("E").alias("st"), (F.col("v") + F.when(F.col("doc") % 3 == 0, 1).when(F.col("doc") % 3 == 1, 0).otherwise(F.col("v"))).alias("v"))
    return _values(facts, "CashFlowStatement", _CASH_ITEMS).unionByName(_values(end, "CashFlowStatement", {"E": ("Cash and Cash Equivalents at End of Period", "X")}))


@query(_STATEMENT + """
, b AS (SELECT doc, period, sum(v) FILTER (st = 'O') AS o, sum(v) FILTER (st = 'F') AS c FROM f GROUP BY doc, period HAVING bool_or(st <> 'P')),
e AS (SELECT *, o + c + CASE doc % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE o + c END AS z FROM b)
SELECT CAST(doc AS VARCHAR) AS doc_id, period AS "Scope", CASE WHEN o + c - z IS NULL THEN 'NOT_TESTED' WHEN abs(o + c - z) <= greatest(1.0, 1e-6 * greatest(o, c, z)) THEN 'PASS' ELSE 'FAIL' END AS "Status" FROM e
""")
def cash_rollforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.cash_checks(_cash(spark, sf_dir)).select("doc_id", "Scope", "Status")


@query(_STATEMENT + """
, p AS (SELECT doc, period, max(v) FILTER (st = 'O') AS o, max(v) FILTER (st = 'F') AS f, count(*) FILTER (st IN ('O', 'F')) AS n FROM f GROUP BY doc, period)
SELECT CAST(doc AS VARCHAR) AS doc_id, period AS "Scope", CASE WHEN o IS NULL OR f IS NULL THEN 'NOT_TESTED' WHEN abs(o - f) <= greatest(1.0, 1e-6 * greatest(o, f)) THEN 'PASS' ELSE 'FAIL' END AS "Status" FROM p WHERE o IS NOT NULL AND f IS NOT NULL
""")
def cross_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    a = _values(facts, "BalanceSheet", {"O": ("Cash and Cash Equivalents", "ASSET")})
    b = _values(facts, "CashFlowStatement", {"F": ("Cash and Cash Equivalents at End of Period", "X")})
    return audits.cross_checks(a.unionByName(b)).select("doc_id", "Scope", "Status")


@query("""
WITH c AS (SELECT o_custkey, o_orderkey % 4 AS g, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderstatus AS s FROM orders),
s AS (SELECT o_custkey, count(*) FILTER (s <> 'P') AS n, sum(v) FILTER (s <> 'P') AS parts, count(*) FILTER (s = 'P') AS k, max(v) FILTER (s = 'P') AS one FROM c GROUP BY o_custkey)
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CASE WHEN k <> 1 OR n < 2 THEN 'NOT_TESTED' WHEN abs(one - parts) <= greatest(1.0, 1e-6 * one, 1e-6 * parts) THEN 'PASS' ELSE 'FAIL' END AS "Status" FROM s WHERE k = 1
""")
def subtotal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "orders").withColumn("v", F.floor("o_totalprice").cast("double")).withColumn("total", F.col("o_orderstatus") == "P")
    base = own.select(F.col("o_custkey").cast("string").alias("doc_id"), F.lit("BalanceSheet").alias("statement_type"), F.lit("2026").alias("period"), F.when(F.col("total"), "Total Current Assets").otherwise("Inventories").alias("standard_item"), F.when(F.col("total"), "ASSET").otherwise("CURRENT_ASSET").alias("context"), F.lit("exact_concept").alias("mapping_relationship"), F.col("v").alias("parsed_value"), "total")
    assets = base.filter("total").withColumn("standard_item", F.lit("Total Assets"))
    return audits.balance_checks(base.unionByName(assets).drop("total")).filter("Check = 'Current asset subtotal'").select("doc_id", "Status")


@query("""
WITH p AS (SELECT p_size AS doc_id, p_type AS st, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, st AS "Scope", p_brand AS item, n FROM p
""")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_type").alias("statement_type"), F.col("p_brand").alias("standard_item"), F.lit("exact_concept").alias("mapping_relationship"), F.lit("exact_alias").alias("mapping_rule"))
    return audits.duplicate_checks(rows).select("doc_id", "Scope", F.regexp_extract("Detail", "'(.*)' has", 1).alias("item"), "n")


@query("""
WITH u AS (SELECT c_nationkey, CASE WHEN c_nationkey % 4 = 0 THEN 'reported units' WHEN c_nationkey % 4 = 1 THEN 'millions' WHEN c_custkey % 2 = 0 THEN 'millions' ELSE 'thousands' END AS label,
  CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE 'USD' END AS currency FROM customer),
k AS (SELECT c_nationkey, count(DISTINCT label || currency) FILTER (label <> 'reported units' OR currency <> '') AS known, bool_or(label = 'reported units') AS unknown FROM u GROUP BY 1)
SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, CASE WHEN known = 0 OR (known = 1 AND unknown) THEN 'NOT_TESTED' WHEN known = 1 THEN 'PASS' ELSE 'WARN' END AS "Status" FROM k
""")
def unit_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.col("c_nationkey") % 4, F.col("c_custkey") % 2
    own = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), F.when(n == 0, "reported units").when((n == 1) | (c == 0), "millions").otherwise("thousands").alias("unit_label"), F.when(n == 0, "").otherwise("USD").alias("currency"))
    return audits.unit_checks(own).select("doc_id", "Status")


@query(_BALANCE_SQL + """
, r AS (SELECT CASE WHEN d IS NULL THEN 'NOT_TESTED' WHEN abs(d) <= tol THEN 'PASS' ELSE 'FAIL' END AS s, doc FROM c)
SELECT CAST(doc AS VARCHAR) AS doc_id, count(*) FILTER (s = 'PASS') AS pass, count(*) FILTER (s = 'FAIL') AS fail, count(*) FILTER (s = 'NOT_TESTED') AS not_tested FROM r GROUP BY doc
""")
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = audits.balance_checks(_balance(spark, sf_dir)).filter(F.col("Check").rlike("^Assets =|equation$"))
    return audits.status_counts(audits.review_report(checks, checks)).select("doc_id", "pass", "fail", "not_tested")


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid for each customer: section row, its orders as rows, and a total row whose amount is one too large for odd customers."""
    amount = F.floor("o_totalprice").cast("long")
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", amount.alias("v")))).alias("x"), F.sum(amount).alias("t"))
    cells = F.transform("x", lambda r: F.array(F.concat(F.lit("Order "), r["o_orderkey"].cast("string"), F.lit(" item")), r["v"].cast("string")))
    total = F.array(F.lit("Total current assets"), (F.col("t") + F.col("o_custkey") % 2 * 2).cast("string"))
    rows = F.concat(F.array(F.array(F.lit("Current assets:"), F.lit(""))), cells, F.array(total))
    return orders.select(F.col("o_custkey").cast("string").alias("doc_id"), F.lit("t").alias("table_id"), rows.alias("rows"), F.concat(F.array(F.lit("section")), F.transform("x", lambda r: F.lit("data")), F.array(F.lit("data"))).alias("row_kinds"), F.array(F.lit("2026")).alias("period_labels"))


@query("""
WITH s AS (SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS t FROM orders GROUP BY 1)
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, t + o_custkey % 2 * 2 AS actual, t AS expected, CASE WHEN o_custkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS "Status" FROM s
""")
def grid_section_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = audits.corporate_balance_checks(_grids(spark, sf_dir)).filter("Check = 'Balance sheet: current assets'")
    return checks.select("doc_id", F.col("actual").cast("long").alias("actual"), F.col("expected").cast("long").alias("expected"), "Status")


@query("""
WITH s AS (SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS BIGINT) AS m FROM customer GROUP BY 1)
SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, 'Equity beginning + change = ending' AS "Check", CASE WHEN c_nationkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS "Status" FROM s
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'Equity movement subtotal', 'PASS' FROM s
""")
def equity_rollforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening 1,000, one movement for each customer of the nation and a dash, and a closing that is off by 5 in odd nations."""
    amount = F.floor("c_acctbal").cast("long")
    x = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", amount.alias("v")))).alias("x"), F.sum(amount).alias("t"))
    show = lambda v: F.when(v < 0, F.concat(F.lit("("), (-v).cast("string"), F.lit(")"))).otherwise(v.cast("string"))
    moves = F.transform("x", lambda r: F.array(F.concat(F.lit("Move "), r["c_custkey"].cast("string")), show(r["v"])))
    rows = F.concat(F.array(F.array(F.lit("Balance at January 1, 2026"), F.lit("1,000"))), moves, F.array(F.array(F.lit("Other"), F.lit("—")), F.array(F.lit("Total changes"), show(F.col("t"))), F.array(F.lit("Balance at December 31, 2026"), show(F.col("t") + 1000 + F.col("c_nationkey") % 2 * 5))))
    grid = x.select(F.col("c_nationkey").cast("string").alias("doc_id"), F.lit("t").alias("table_id"), rows.alias("rows"), F.transform(rows, lambda r: F.lit("data")).alias("row_kinds"), F.array(F.lit("Common")).alias("component_labels"), F.array(F.struct(F.lit(0).alias("start"), F.size(rows).alias("end"), F.lit("2026").alias("caption"))).alias("period_sections"))
    return audits.equity_grid_checks(grid).select("doc_id", "Check", "Status")


# Concept mapping


_LABELS_SQL = """
WITH l AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'Total assets' WHEN 1 THEN 'Goodwill' WHEN 2 THEN 'inventories' ELSE 'deferred revenue' END || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN ' ' || p_name ELSE p_type END AS raw FROM part),
k AS (SELECT raw, trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9%/()''& -]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM l),
r(ord, alias, item) AS (VALUES (1, 'inventories', 'Inventories'), (2, 'goodwill', 'Goodwill'), (3, 'total assets', 'Total Assets'), (4, 'deferred revenue', 'Deferred Revenue')),
m AS (SELECT raw, item, ord, CASE WHEN key = alias THEN 1.0 WHEN len(list_filter(string_split(alias, ' '), lambda w: NOT list_contains(string_split(key, ' '), w))) = 0 THEN 0.9 WHEN contains(key, alias) THEN 0.86 END AS score FROM k, r)
SELECT raw, arg_max(item, score) AS standard_item, CAST(max(score) AS DOUBLE) AS confidence FROM m WHERE score IS NOT NULL GROUP BY raw
""".replace("\\\\", "\\")


@query(_LABELS_SQL)
def concept_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, subset and substring matches of labels made of an alias and words of parts."""
    k = F.col("p_partkey")
    base = F.when(k % 4 == 0, "Total assets").when(k % 4 == 1, "Goodwill").when(k % 4 == 2, "inventories").otherwise("deferred revenue")
    raw = F.concat(base, F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(" "), "p_name")).otherwise(F.col("p_type")))
    rows = read(spark, sf_dir, "part").select(raw.alias("raw")).distinct().select(F.lit("BalanceSheet").alias("statement_type"), "raw", F.lit("").alias("context"))
    return mapping.map_concepts(rows, "raw").select("raw", "standard_item", "confidence")


@query("""
SELECT p_partkey, left(label, k) || 'q' || substring(label, k + 2, 40) AS raw_item, 'Property, Plant and Equipment, Net' AS standard_item, CAST(CASE WHEN k = 20 THEN 1 WHEN k BETWEEN 9 AND 13 THEN 0.9 ELSE 0.79 END AS DOUBLE) AS confidence,
  CASE WHEN k = 20 THEN 'exact_alias' WHEN k BETWEEN 9 AND 13 THEN 'token_subset_context' ELSE 'fuzzy' END AS rule
FROM (SELECT p_partkey, p_partkey % 30 AS k, 'property plant and equipment net' AS label FROM part)
""")
def concept_map_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with one letter wrong: fuzzy, unless that letter is in `plant`, which another alias lacks, or is right. tests/test_mapping.py holds other ratios against the single-label mapper."""
    k = F.col("p_partkey").cast("int")
    label = F.lit("property plant and equipment net")
    raw = F.concat(F.substring(label, F.lit(1), k % 30), F.lit("q"), F.substring(label, k % 30 + 2, F.lit(40)))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.lit("BalanceSheet").alias("statement_type"), raw.alias("raw_item"), F.lit("").alias("context"))
    return mapping.map_concepts(rows).select("p_partkey", "raw_item", "standard_item", "confidence", "rule")


# Multisets


_TOKENS_SQL = r"""
WITH e AS (SELECT l_orderkey % 200 AS doc, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS token, count(*) AS n FROM lineitem GROUP BY ALL),
a AS (SELECT l_orderkey % 200 AS doc, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS token, count(*) AS n FROM lineitem WHERE l_linenumber > 1 OR l_orderkey % 200 % 3 = 0 GROUP BY ALL),
j AS (SELECT coalesce(e.doc, a.doc) AS doc, coalesce(e.token, a.token) AS token, coalesce(e.n, 0) AS en, coalesce(a.n, 0) AS an FROM e FULL JOIN a ON e.doc = a.doc AND e.token = a.token)
"""


def _token_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("doc"), "l_linenumber", F.concat(F.lit("Item "), F.col("l_quantity").cast("long").cast("string")).alias("line"))
    found = rows.filter((F.col("l_linenumber") > 1) | (F.col("doc") % 3 == 0))
    return coverage.counted(rows, ["doc"], text.numbers_in(F.col("line"))), coverage.counted(found, ["doc"], text.numbers_in(F.col("line")))


@query(_TOKENS_SQL + "SELECT doc, CAST(sum(en) AS BIGINT) AS reference_tokens, CAST(sum(least(en, an)) AS BIGINT) AS matched_tokens, round(sum(least(en, an)) / sum(en), 9) AS recall FROM j GROUP BY doc")
def token_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.recall(*_token_sides(spark, sf_dir), ["doc"])
    return out.select("doc", "reference_tokens", "matched_tokens", F.round("recall", 9).alias("recall"))


@query(_TOKENS_SQL + "SELECT doc, sum(least(en, an)) >= 0.97 * sum(en) AS covered FROM j GROUP BY doc HAVING sum(en) > 0")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.covered(*_token_sides(spark, sf_dir), ["doc"]).select("doc", "covered")


@query(_TOKENS_SQL + "SELECT doc, token, en - an AS missing FROM j WHERE en > an")
def missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.compared(*_token_sides(spark, sf_dir), ["doc"]).filter("missing > 0").select("doc", "token", "missing")


@query(r"""
WITH c AS (SELECT o_custkey % 100 AS doc, o_orderpriority AS flavor, CAST(o_orderkey % 5 AS VARCHAR) AS token, count(*) AS n FROM orders GROUP BY ALL),
e AS (SELECT doc, token, CAST(4 AS BIGINT) AS lim FROM c GROUP BY doc, token),
s AS (SELECT c.doc, flavor, token, least(n, lim) AS n FROM c JOIN e USING (doc, token)),
o AS (SELECT doc, token, n AS old_n FROM s WHERE flavor = '5-LOW'),
t AS (SELECT doc, flavor, sum(n) AS total FROM s GROUP BY ALL),
k AS (SELECT s.doc, s.flavor, sum(least(n, old_n)) AS kept FROM s JOIN o ON s.doc = o.doc AND s.token = o.token GROUP BY ALL),
d AS (SELECT DISTINCT doc FROM c WHERE flavor = '5-LOW'),
b AS (SELECT t.doc, t.flavor, total, coalesce(kept, 0) AS kept, coalesce((SELECT sum(old_n) FROM o WHERE o.doc = t.doc), 0) AS old_total FROM t LEFT JOIN k ON t.doc = k.doc AND t.flavor = k.flavor JOIN d ON t.doc = d.doc)
SELECT doc, flavor AS best, CAST(old_total AS BIGINT) AS old_total, CAST(total AS BIGINT) AS best_total FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY total DESC, flavor) AS r FROM b WHERE kept = old_total AND total > old_total) WHERE r = 1
""")
def candidate_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("doc"), F.col("o_orderpriority").alias("flavor"), F.array((F.col("o_orderkey") % 5).cast("string")).alias("t"))
    found = coverage.counted(rows, ["doc", "flavor"], F.col("t"))
    expected = found.select("doc", "token").distinct().withColumn("n", F.lit(4).cast("long"))
    current = rows.filter("flavor = '5-LOW'").select("doc", "flavor").distinct()
    return coverage.complete_candidates(expected, found, current, ["doc"]).select("doc", "best", "old_total", "best_total")


@query("""
WITH m AS (SELECT user_id, event_type, sum(CAST(round(value * 100) AS BIGINT)) / CAST(count(*) AS DOUBLE) AS s, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type AS flavor, round(s, 6) AS mean_score, n AS n_tables FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type) AS r FROM m) WHERE r = 1
""")
def best_flavor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("flavor"), F.round(F.col("value") * 100).cast("long").alias("score"))
    return coverage.best_flavors(scored, ["user_id"]).withColumn("mean_score", F.round("mean_score", 6)).select("user_id", "flavor", "mean_score", "n_tables")


@query("""
SELECT l_returnflag, count(DISTINCT l_orderkey) AS tables, count(DISTINCT l_orderkey * 10 + l_linenumber) AS "rows" FROM lineitem GROUP BY 1
""")
def metrics_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.table_metrics(read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_index")), ["l_returnflag"])


# Joins on intervals and snapshots


@query("""
WITH a AS (SELECT o_custkey, o_orderkey AS id, CAST(o_orderkey % 97 AS DOUBLE) AS lo, CAST(o_orderkey % 97 + 2 + o_orderkey % 3 AS DOUBLE) AS hi FROM orders WHERE o_orderstatus = 'O'),
b AS (SELECT o_custkey, o_orderkey AS id, CAST(o_orderkey % 89 AS DOUBLE) AS lo, CAST(o_orderkey % 89 + 2 + o_orderkey % 4 AS DOUBLE) AS hi FROM orders WHERE o_orderstatus = 'F')
SELECT a.o_custkey, a.id AS id_a, b.id AS id_b FROM a JOIN b ON a.o_custkey = b.o_custkey AND abs((a.lo + a.hi) - (b.lo + b.hi)) / 2 <= 2
  AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.6 * least(a.hi - a.lo, b.hi - b.lo)
""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    side = lambda status, n, m: read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).select("o_custkey", k.alias("id"), (k % n).cast("double").alias("lo"), (k % n + 2 + k % m).cast("double").alias("hi"))
    return grids.overlapping(side("O", 97, 3), side("F", 89, 4), ["o_custkey"]).select("o_custkey", "id_a", "id_b")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, CAST(floor((l_quantity + 0.5) / 10) AS INTEGER) AS column_index, count(*) AS n FROM lineitem GROUP BY ALL
""")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a page with six columns, and its quantities are the words on it."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 1).alias("x1"))
    ten = F.col("column_index") * 10.0
    bounds = items.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("column_index")).select("*", ten.alias("lo"), (ten + 10).alias("hi"))
    return grids.columns_of_words(items, bounds).groupBy("l_orderkey", "l_linenumber", "l_quantity", "column_index").agg(F.count("*").alias("n"))


_SNAPSHOT_SQL = """
WITH b AS (SELECT c_custkey, c_mktsegment AS seg, c_nationkey AS nat FROM customer WHERE c_custkey % 11 <> 0),
a AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nat FROM customer WHERE c_custkey % 13 <> 0),
e AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'ADDED' WHEN a.c_custkey IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS code,
  CASE WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.seg IS DISTINCT FROM b.seg THEN 'seg' END, CASE WHEN a.nat IS DISTINCT FROM b.nat THEN 'nat' END) END AS changed
  FROM b FULL JOIN a ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.seg IS DISTINCT FROM b.seg OR a.nat IS DISTINCT FROM b.nat)
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    before = c.filter("c_custkey % 11 <> 0").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    after = c.filter("c_custkey % 13 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("seg"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("nat"))
    return diff.snapshot_diff(before, after, ["c_custkey"], ["seg", "nat"])


@query(_SNAPSHOT_SQL + "SELECT * FROM e")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("c_custkey", "code", F.array_join("changed", ",").alias("changed"))


@query(_SNAPSHOT_SQL + "SELECT c_custkey, code, CASE WHEN c_custkey % 3 = 0 THEN 'ACCEPTED' WHEN c_custkey % 3 = 1 THEN 'OPEN' ELSE 'CONFLICT' END AS state FROM e")
def decision_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    k = F.col("c_custkey") % 3
    made = events.select("issue_id", F.explode(F.when(k == 0, F.array(F.lit("ACCEPTED"))).when(k == 2, F.array(F.lit("ACCEPTED"), F.lit("REJECTED"))).otherwise(F.array().cast("array<string>"))).alias("decision"))
    return diff.with_decisions(events, made).select("c_custkey", "code", "state")


@query("""
WITH a AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey, CAST(l_quantity AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey) AS nth FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey, CAST(l_quantity AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey) AS nth FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.q, b.q) AS q, coalesce(a.nth, b.nth) AS nth, a.l_orderkey AS left_order, b.l_orderkey AS right_order
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.q = b.q AND a.nth = b.nth
""")
def occurrence_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda flag: read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).select("l_suppkey", F.col("l_quantity").cast("long").alias("q"), "l_orderkey", "l_linenumber", "l_partkey")
    out = diff.paired(side("A"), side("R"), ["l_suppkey", "q"], ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.select("l_suppkey", "q", F.col("nth").cast("long").alias("nth"), F.col("left_l_orderkey").alias("left_order"), F.col("right_l_orderkey").alias("right_order"))


@query("""
WITH x AS (SELECT o_custkey AS doc, o_orderpriority AS label, o_orderkey % 3 AS v, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT doc, label, v, coalesce(sum(n) FILTER (s = 'O'), 0) AS e, coalesce(sum(n) FILTER (s = 'F'), 0) AS a FROM x GROUP BY doc, label, v),
r AS (SELECT doc, label, sum(least(e, a)) AS exact, sum(e - least(e, a)) AS le, sum(a - least(e, a)) AS la FROM p GROUP BY doc, label)
SELECT doc, label, CAST(exact AS BIGINT) AS exact, CAST(least(le, la) AS BIGINT) AS same_label, CAST(le - least(le, la) AS BIGINT) AS missing, CAST(la - least(le, la) AS BIGINT) AS extra FROM r WHERE exact + le + la > 0
""")
def greedy_row_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda s: read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("label"), (F.col("o_orderkey") % 3).alias("v"), F.col("o_orderkey").alias("row"))
    out = diff.matched_rows(side("O"), side("F"), ["doc"], "label", "v", ["row"])
    e, a = F.col("e_row").isNotNull(), F.col("a_row").isNotNull()
    return out.groupBy("doc", "label").agg(F.count_if(F.col("exact")).alias("exact"), F.count_if(~F.col("exact") & e & a).alias("same_label"), F.count_if(e & ~a).alias("missing"), F.count_if(a & ~e).alias("extra"))


@query("""
SELECT n_nationkey AS path, CASE WHEN n_nationkey % 4 = 0 THEN 'CHANGED' WHEN n_nationkey % 4 = 1 THEN 'MISSING' WHEN n_nationkey % 4 = 2 THEN 'EXTRA' ELSE 'OK' END AS state FROM nation
""")
def verified_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("path"), F.col("n_name").cast("binary").alias("content"))
    manifest = n.filter("path % 4 <> 2").select("path", F.when(F.col("path") % 4 == 0, F.lit("0")).otherwise(F.sha2("content", 256)).alias("sha256"))
    return diff.verified_files(n.filter("path % 4 <> 1"), manifest)


# HTML


@query("""
SELECT page_id AS doc_id, CAST(len(regexp_extract_all(coalesce(html, ''), '(?i)<table[ >]')) AS BIGINT) AS "tables", CAST(len(regexp_extract_all(coalesce(html, ''), '(?i)<ix:')) AS INTEGER) AS facts, CAST(NULL AS VARCHAR) AS error FROM pages
""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the HTML reader: leaf tables and facts. tests/test_html.py has filings with nested tables and facts."""
    tables = html.parsed(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").cast("binary").alias("content")))
    return tables.groupBy("doc_id").agg(F.count_if(F.col("table_index") > 0).alias("tables"), F.max(F.size("facts")).alias("facts"), F.max("error").alias("error"))


@query("""
WITH f AS (
  SELECT c_nationkey AS nation, year(o_orderdate) AS y, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), v AS (
  SELECT f.nation || '-' || f.y AS doc, CAST(f.y AS VARCHAR) AS y, CAST(f.y - 1 AS VARCHAR) AS before, f.a, coalesce(g.a, 0) AS b FROM f LEFT JOIN f g ON g.nation = f.nation AND g.y = f.y - 1
), r AS (
  SELECT doc, y, before, unnest([
    {'i': 4, 'raw': 'Net income', 'item': 'Net Income (Loss)', 'at_end': a, 'at_start': b},
    {'i': 5, 'raw': 'Net increase in cash and cash equivalents', 'item': 'Net Increase (Decrease) in Cash and Cash Equivalents', 'at_end': a, 'at_start': b},
    {'i': 6, 'raw': 'Cash and cash equivalents at beginning of period', 'item': 'Cash and Cash Equivalents at Beginning of Period', 'at_end': b, 'at_start': a},
    {'i': 7, 'raw': 'Cash and cash equivalents at end of period', 'item': 'Cash and Cash Equivalents at End of Period', 'at_end': a + b, 'at_start': a + b}]) AS r FROM v
)
SELECT doc AS doc_id, 'CashFlowStatement' AS statement_type, CAST(r.i AS INTEGER) AS row_index, r.raw AS raw_item, r.item AS standard_item, 'exact_alias' AS mapping_rule, y AS period, CAST(r.at_end AS DOUBLE) AS parsed_value, 'NUMERIC' AS parse_status FROM r
UNION ALL SELECT doc, 'CashFlowStatement', CAST(r.i AS INTEGER), r.raw, r.item, 'exact_alias', before, CAST(r.at_start AS DOUBLE), 'NUMERIC' FROM r
""")
def statement_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing for each nation and year, beside the year before, as text, through sections, condenser, row split, tokens and mapping. tests/test_statements.py has the fixtures' results."""
    own = _facts(spark, sf_dir).groupBy("doc", F.col("period").cast("int").alias("y")).agg(F.sum("v").alias("v"))
    before = own.select("doc", (F.col("y") + 1).alias("y"), F.col("v").alias("w"))
    line = lambda label, a, b: F.concat_ws(" ", F.lit(label), F.format_number(a, 0), F.format_number(b, 0))
    a, b, year = F.col("v"), F.coalesce("w", F.lit(0)), lambda n: (F.col("y") - n).cast("string")
    heads = F.concat_ws("\n", F.concat(F.lit("Nation "), F.col("doc").cast("string")), F.lit("Statements of Cash Flows"), F.concat_ws(" ", F.lit("Years Ended December 31,"), year(0), year(1)), F.lit("Operating Activities"))
    body = F.concat_ws("\n", heads, line("Net income", a, b), line("Net increase in cash and cash equivalents", a, b), line("Cash and cash equivalents at beginning of period", b, a), line("Cash and cash equivalents at end of period", a + b, a + b))
    doc = F.concat_ws("-", F.col("doc").cast("string"), year(0))
    lines = text_source.pasted(spark, own.join(before, ["doc", "y"], "left").select(doc.alias("doc_id"), body.alias("text")))
    return statements.parsed_values(statements.statement_rows(lines), statements.unit_notes(lines)).select("doc_id", "statement_type", "row_index", "raw_item", "standard_item", "mapping_rule", "period", "parsed_value", "parse_status")


# Pages, layouts and completeness


@query("""
WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS page, CASE o_orderkey % 4 WHEN 0 THEN '' ELSE o_orderpriority END AS kind, o_orderstatus <> 'P' AS selected FROM orders)
SELECT doc_id, 'Page ' || page || CASE WHEN kind = '' THEN '' ELSE ' / ' || kind END AS "Scope", CASE WHEN kind = '' THEN 'WARN' WHEN page % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS "Status" FROM p WHERE selected
""")
def selected_page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    plan = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("page"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("statement_type"), (F.col("o_orderstatus") != "P").alias("selected"))
    have = plan.filter("page % 3 <> 0").withColumnRenamed("page", "source_page")
    return completeness.page_coverage(plan, have).select("doc_id", "Scope", "Status")


@query("""
WITH t AS (SELECT c_custkey AS doc_id, c_custkey % 5 AS k FROM customer)
SELECT doc_id, CASE k WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'NOT_TESTED' WHEN 3 THEN 'FAIL' ELSE 'FAIL' END AS "Status" FROM t
""")
def balance_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body of seven lines for each customer: whole, with a token lost, without its end, without a grid, and with a section lost."""
    c = dealt(read(spark, sf_dir, "customer"), "c_custkey", each=10_000).select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 5).alias("k"), F.lit(1).alias("source_page"), F.col("c_name").alias("name"))
    lines = F.array(F.lit("Assets"), F.concat(F.lit("Cash "), "name"), F.lit("Total assets 10"), F.lit("Total liabilities 4"), F.lit("Total equity 6"), F.when(F.col("k") == 2, "The end").otherwise("See accompanying notes"))
    text_lines = c.select("doc_id", "source_page", F.posexplode(lines).alias("line_no", "raw_text"))
    rows = F.array(F.array(F.lit("Assets"), F.lit("")), F.array(F.lit("Cash"), F.when(F.col("k") == 1, "").otherwise(F.col("name"))), F.array(F.lit("Total assets"), F.lit("10")), F.array(F.lit("Total liabilities"), F.lit("4")), F.array(F.when(F.col("k") == 4, "Rest").otherwise("Total equity"), F.lit("6")))
    exported = c.filter("k <> 3").select("doc_id", "source_page", rows.alias("rows"))
    return completeness.balance_completeness(text_lines, exported, c).select("doc_id", "Status")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 7 AS k, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, count(*) AS expected, count(*) FILTER (k = 0) AS missing, CASE WHEN count(*) FILTER (k = 0) > 0 THEN 'WARN' ELSE 'PASS' END AS "Status" FROM r GROUP BY o_custkey
""")
def text_row_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as text rows against a grid where every seventh order has another amount."""
    own = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.lit(1).alias("source_page"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" x")).alias("label"), F.floor("o_totalprice").cast("long").alias("v"), (F.col("o_orderkey") % 7).alias("k"))
    source = own.select("doc_id", "source_page", "label", F.array(F.col("v").cast("double")).alias("values"))
    row = F.struct("label", F.when(F.col("k") == 0, F.col("v") + 1).otherwise(F.col("v")).cast("string").alias("v"))
    grid = own.groupBy("doc_id", "source_page").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: F.array(r["label"], r["v"])).alias("rows")).select("doc_id", "source_page", F.lit("t").alias("table_id"), "rows", F.transform("rows", lambda r: F.lit("data")).alias("row_kinds"), F.array(F.lit("2026")).alias("period_labels"))
    return completeness.row_coverage(source, grid).select("doc_id", "expected", "missing", "Status")


@query("""
WITH e AS (SELECT user_id, event_id % 3 AS page, event_id, CAST(floor(event_id / 31) AS DOUBLE) * 10 AS top FROM events)
SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(page AS INTEGER) AS page, CAST(dense_rank() OVER (PARTITION BY user_id, page ORDER BY top) - 1 AS INTEGER) AS line, event_id || '' AS text FROM e
""")
def words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    words = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), (k % 3).cast("int").alias("page"), k.cast("string").alias("text"), (k % 31).cast("double").alias("x0"), (k % 31 + 1).cast("double").alias("x1"), (F.floor(k / 31) * 10).cast("double").alias("top"), (F.floor(k / 31) * 10 + 8).cast("double").alias("bottom"))
    return grids.lines_of_words(words).select("doc_id", "page", "line", "text")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(page AS INTEGER) AS page, CASE WHEN c_custkey % 3 = 1 AND page = 3 THEN 'blank' ELSE role END AS role,
  CASE WHEN c_custkey % 3 = 1 AND page = 3 THEN 'CashFlowStatement' ELSE kind END AS statement_type, kind <> '' AND NOT (c_custkey % 3 = 1 AND page = 3) AS selected, false AS review_required
FROM customer CROSS JOIN (VALUES (1, 'excluded', ''), (2, 'data', 'BalanceSheet'), (3, 'data', 'IncomeStatement'), (4, 'data', 'CashFlowStatement'), (5, 'supporting', '')) p(page, role, kind)
""")
def automatic_page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing of five pages for each customer, every third with an empty page among its statements. tests/test_pages.py has further cases with their results."""
    n = dealt(read(spark, sf_dir, "customer").withColumn("doc_id", F.col("c_custkey").cast("string")), "doc_id", each=10_000).select("doc_id", F.col("c_name").alias("n_name"), (F.col("c_custkey") % 3 == 1).alias("gap"))
    texts = F.array(F.col("n_name"), F.concat(F.lit("Balance Sheets\nTotal assets 10 9\nTotal liabilities 4 "), F.col("doc_id")), F.when(F.col("gap"), "").otherwise("Statements of Operations\nRevenue 10 9\nNet income 5 4"), F.lit("Statements of Cash Flows\nNet income 5 4\nCash at end 3 2"), F.lit("Notes to Financial Statements\nNote 1. Organization"))
    pages = n.select("doc_id", F.posexplode(texts).alias("_p", "text")).select("doc_id", (F.col("_p") + 1).alias("page"), "text")
    return plans.automatic_plan(pages).select("doc_id", "page", "role", "statement_type", "selected", "review_required")


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(7 AS INTEGER) AS n_rows, CAST(2 AS INTEGER) AS n_tables, CAST(NULL AS VARCHAR) AS conflict FROM supplier
""")
def schedule_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates for each supplier that repeat three of five rows at one place. tests/test_grids.py has cases with their results."""
    r = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.col("s_name").alias("r_name"), F.lit(1).alias("source_page"), F.lit("stream").alias("flavor"), F.explode(F.array(F.lit(0), F.lit(1))).alias("source_order"))
    rows = F.transform(F.sequence(F.col("source_order") * 2, F.col("source_order") * 2 + 4), lambda i: F.array(F.concat("r_name", i.cast("string")), i.cast("string")))
    bounds = F.transform(F.sequence(F.col("source_order") * 2, F.col("source_order") * 2 + 4), lambda i: F.array((F.lit(500) - i * 12).cast("double"), (F.lit(490) - i * 12).cast("double")))
    columns = F.array(F.array(F.lit(0.0), F.lit(50.0)), F.array(F.lit(50.0), F.lit(90.0)))
    return grids.merged_schedules(r.select("doc_id", "source_page", "flavor", F.concat(F.lit("t"), F.col("source_order").cast("string")).alias("table_id"), "source_order", rows.alias("rows"), bounds.alias("row_bounds"), columns.alias("column_bounds"))).select("doc_id", F.size("rows").alias("n_rows"), F.size("table_ids").alias("n_tables"), "conflict")


# Runs


@query("""
SELECT o_custkey AS run_id, max(o_orderkey) AS attempt FROM orders GROUP BY o_custkey HAVING max(o_orderkey) % 3 <> 0
""")
def latest_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is an attempt of its customer's run; every third has no receipt and masks those before it."""
    k = F.col("o_orderkey")
    return diff.latest_attempts(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), k.alias("attempt"), F.when(k % 3 != 0, "receipt").alias("receipt"))).select("run_id", "attempt")


@query("""
SELECT o_orderkey AS input FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND o_orderstatus <> 'P'
""")
def uncovered_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that neither a returned line (job) nor a status P (exception) covers."""
    orders, key = read(spark, sf_dir, "orders"), F.col("o_orderkey").alias("input")
    return diff.uncovered_inputs(orders.select(key), read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("input")), orders.filter("o_orderstatus = 'P'").select(key))


@query("""
SELECT user_id AS run_id, CAST(coalesce(max(CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END END), 0) AS INTEGER) AS exit_code FROM events GROUP BY user_id
""")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return diff.exit_code(read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.when(e % 3 == 0, "ACCEPTED").otherwise("OPEN").alias("state"), F.when(e % 7 == 0, 3).otherwise(2).alias("severity")))


@query("""
SELECT c_custkey AS run_id, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 2 END, c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
ORDER BY place LIMIT 100
""")
def selected_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of 100 runs (the batch is the feature): two segments, the highest balances first."""
    runs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("scope"), F.col("c_acctbal").alias("elapsed"))
    batch = diff.selected_runs(runs, ["BUILDING", "MACHINERY"], 100)
    place = F.row_number().over(Window.orderBy(F.when(F.col("scope") == "BUILDING", 1).otherwise(2), F.desc("elapsed"), "run_id"))  # a batch is small
    return batch.select("run_id", place.cast("long").alias("place"))


# More audits


@query("""
SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') = 0 THEN CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) END AS total FROM orders GROUP BY o_custkey
""")
def null_strict_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("o_orderpriority") != "1-URGENT", F.floor("o_totalprice").cast("long"))
    return read(spark, sf_dir, "orders").withColumn("v", v).groupBy("o_custkey").agg(audits.strict_sum(F.col("v")).alias("total"))


@query("""
WITH c AS (SELECT c_custkey AS k, CAST(floor(abs(c_acctbal)) AS BIGINT) + 10 AS v FROM customer)
SELECT CAST(k AS VARCHAR) AS doc_id, 'Assets = liabilities + net assets' AS "Check", CASE k % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'NOT_TESTED' END AS "Status" FROM c
UNION ALL SELECT CAST(k AS VARCHAR), 'Assets = reported liabilities and net assets', 'PASS' FROM c
""")
def fund_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fund for each customer: net assets fit, are off by 5, or stand there twice."""
    k, v = F.col("c_custkey"), F.floor(F.abs("c_acctbal")).cast("long") + 10
    show = lambda c: c.cast("string")
    net = F.array(F.lit("Total net assets"), show(v - 4 + F.when(k % 3 == 1, 5).otherwise(0)))
    rows = F.array(F.array(F.lit("Total assets"), show(v)), F.array(F.lit("Total liabilities"), F.lit("4")), net, F.when(k % 3 == 2, net).otherwise(F.array(F.lit("Other"), F.lit("1"))), F.array(F.lit("Total liabilities and net assets"), show(v)))
    grid = read(spark, sf_dir, "customer").select(show(k).alias("doc_id"), F.lit("t").alias("table_id"), rows.alias("rows"), F.transform(rows, lambda r: F.lit("data")).alias("row_kinds"), F.array(F.lit("2026")).alias("period_labels"))
    return audits.fund_balance_checks(grid).select("doc_id", "Check", "Status")


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'Cash beginning + change + FX = ending' AS "Check", CASE WHEN s_suppkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS "Status" FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'Cash reconciliation components', 'PASS' FROM supplier
""")
def cash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's cash and its parts at a date for each supplier; every second ending is off by 5."""
    k, v = F.col("s_suppkey"), F.floor(F.abs("s_acctbal")).cast("long")
    show = lambda c: c.cast("string")
    year = F.array(F.array(F.lit("Cash at beginning of year"), F.lit("100")), F.array(F.lit("Net increase in cash"), show(v)), F.array(F.lit("Effect of exchange rates on cash"), F.lit("—")), F.array(F.lit("Cash at end of year"), show(v + 100 + k % 2 * 5)))
    date = F.array(F.array(F.lit("Cash and cash equivalents"), show(v)), F.array(F.lit("Restricted cash"), F.lit("7")), F.array(F.lit("Total cash and restricted cash"), show(v + 7)))
    grid = lambda name, rows, period: read(spark, sf_dir, "supplier").select(show(k).alias("doc_id"), F.lit(name).alias("table_id"), rows.alias("rows"), F.transform(rows, lambda r: F.lit("data")).alias("row_kinds"), F.array(F.lit(period)).alias("period_labels"))
    return audits.cash_grid_checks(grid("a", year, "Year Ended December 31, 2026").unionByName(grid("b", date, "December 31, 2026"))).select("doc_id", "Check", "Status")


@query("""
SELECT l_orderkey, count(*) FILTER (l_linenumber % 4 <> 3) AS n_numeric, count(*) FILTER (l_linenumber % 4 = 3) AS n_text,
  CAST(sum(CASE l_linenumber % 4 WHEN 0 THEN -l_extendedprice WHEN 1 THEN l_extendedprice WHEN 2 THEN l_extendedprice END) * 100 AS BIGINT) AS cents FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18, 2)) AS l_extendedprice FROM lineitem) GROUP BY l_orderkey
""")
def decimal_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as cells in four renderings: exact amounts, and the cells that are one number."""
    price, k = F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_linenumber") % 4
    cell = F.when(k == 0, F.concat(F.lit("$ ("), price, F.lit(")"))).when(k == 1, F.concat(F.lit("$"), price)).when(k == 2, price).otherwise(F.concat(F.lit("about "), price))
    cells = read(spark, sf_dir, "lineitem").select("l_orderkey", cell.alias("cell"))
    sums = cells.groupBy("l_orderkey").agg((F.sum(tokens.decimal_amount(F.col("cell"))) * 100).cast("long").alias("cents"))
    return coverage.numeric_cells(cells, ["l_orderkey"]).join(sums, "l_orderkey")
