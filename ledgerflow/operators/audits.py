"""Equation checks over long values and over source grids. No check passes on missing, repeated or non-finite inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.text import label_key
from ledgerflow.functions.tokens import SINGLE, with_token

EXACT = "exact_concept"


def tolerance(*values: Column) -> Column:
    """For values from text: one unit, or a millionth of the largest."""
    return F.greatest(F.lit(1.0), *[F.abs(v) * 1e-6 for v in values])


def verdict(difference: Column, allowed: Column) -> Column:
    return F.when(difference.isNull(), "NOT_TESTED").when(F.abs(difference) <= allowed, "PASS").otherwise("FAIL")


def finite(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def unique_value(condition: Column, value: Column) -> Column:
    """Aggregate: the value of the one row that meets the condition; null for none or several."""
    return finite(F.when(F.count_if(condition) == 1, F.max(F.when(condition, value))))


def strict_sum(value: Column) -> Column:
    """Aggregate: null if any value is null or there is none, unlike SUM."""
    return F.when((F.count("*") > 0) & (F.count("*") == F.count(value)), F.sum(value))


def item(name: str) -> Column:
    return (F.lower(F.trim("standard_item")) == name.lower()) & (F.col("mapping_relationship") == EXACT)


def _check(name, difference: Column, allowed: Column, detail: Column | str) -> Column:
    named = F.lit(name) if isinstance(name, str) else name
    return F.struct(named.alias("Check"), F.col("period").alias("Scope"), verdict(difference, allowed).alias("Status"), (F.lit(detail) if isinstance(detail, str) else detail).alias("Detail"), difference.alias("difference"))


def _said(difference: Column, allowed: Column, otherwise: str) -> Column:
    return F.when(difference.isNull(), otherwise).otherwise(F.concat(F.lit("Difference="), F.round(difference, 6).cast("string"), F.lit("; tolerance="), allowed.cast("string"), F.lit(".")))


def balance_checks(values: DataFrame) -> DataFrame:
    """Of balance sheets, for each document and period: the equation, by the reported total or the two parts, and two subtotals."""
    v, where = F.col("parsed_value"), F.col("context")
    parts = {}
    for side, total in (("ca", "Total Current Assets"), ("cl", "Total Current Liabilities")):
        inside = (where == ("CURRENT_ASSET" if side == "ca" else "CURRENT_LIABILITY")) & (F.col("standard_item") != total) & v.isNotNull() & ~F.isnan(v)
        parts |= {f"{side}_n": F.count_if(inside), f"{side}_sum": F.sum(F.when(inside, v)), f"{side}_total": unique_value(item(total), v)}
    found = values.filter("statement_type = 'BalanceSheet'").groupBy("doc_id", "period").agg(
        unique_value(item("Total Assets"), v).alias("assets"), unique_value(item("Total Liabilities and Equity"), v).alias("both"), unique_value(item("Total Liabilities"), v).alias("liabilities"), unique_value(item("Total Equity"), v).alias("equity"), *[c.alias(n) for n, c in parts.items()]
    )
    c = F.col
    direct, summed = c("assets") - c("both"), c("assets") - (c("liabilities") + c("equity"))
    difference = F.when(c("both").isNotNull(), direct).otherwise(summed)
    allowed = F.when(c("both").isNotNull(), tolerance(c("assets"), c("both"))).otherwise(tolerance(c("assets"), c("liabilities") + c("equity")))
    name = F.when(difference.isNull(), "Balance sheet equation").when(c("both").isNotNull(), "Assets = reported liabilities + equity").otherwise("Assets = liabilities + equity")
    missing = F.when(c("assets").isNull(), "Total Assets not extracted.").otherwise("Need Total Liabilities and Equity, or both Total Liabilities and Total Equity.")
    checks = [F.struct(name.alias("Check"), c("period").alias("Scope"), verdict(difference, allowed).alias("Status"), F.when(difference.isNull(), missing).otherwise(_said(difference, allowed, "")).alias("Detail"), difference.alias("difference"))]
    for side, label in (("ca", "Current asset subtotal"), ("cl", "Current liability subtotal")):
        gap = F.when(c(f"{side}_n") >= 2, c(f"{side}_total") - c(f"{side}_sum"))
        allow = tolerance(c(f"{side}_total"), c(f"{side}_sum"))
        checks.append(F.when(c("assets").isNotNull(), _check(label, gap, allow, _said(gap, allow, "The total or at least two components are missing."))))
    return found.select("doc_id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")


def cash_checks(values: DataFrame) -> DataFrame:
    """Beginning cash and change make ending cash."""
    v = F.col("parsed_value")
    names = {"begin": "Cash and Cash Equivalents at Beginning of Period", "change": "Net Increase (Decrease) in Cash and Cash Equivalents", "end": "Cash and Cash Equivalents at End of Period"}
    found = values.filter("statement_type = 'CashFlowStatement'").groupBy("doc_id", "period").agg(*[unique_value(item(n), v).alias(k) for k, n in names.items()])
    gap, allowed = F.col("begin") + F.col("change") - F.col("end"), tolerance(F.col("begin"), F.col("change"), F.col("end"))
    name = F.when(gap.isNull(), "Cash rollforward").otherwise("Beginning cash + change = ending cash")
    return found.select("doc_id", _check(name, gap, allowed, _said(gap, allowed, "Beginning cash, net change, and ending cash are all required.")).alias("x")).select("doc_id", "x.*")


def cross_checks(values: DataFrame) -> DataFrame:
    """Balance-sheet cash against ending cash, and net income of both statements, where full period labels agree. One aggregate instead of a self-join."""
    v, kind = F.col("parsed_value"), F.col("statement_type")
    keyed = values.withColumn("period", F.lower(F.trim("period")))
    pairs = {
        "CF ending cash = BS cash": (("BalanceSheet", "Cash and Cash Equivalents"), ("CashFlowStatement", "Cash and Cash Equivalents at End of Period")),
        "IS net income = CF net income": (("IncomeStatement", "Net Income (Loss)"), ("CashFlowStatement", "Net Income (Loss)")),
    }
    aggregates = []
    for i, sides in enumerate(pairs.values()):
        for j, (statement, name) in enumerate(sides):
            aggregates += [unique_value((kind == statement) & item(name), v).alias(f"v{i}{j}"), F.max(kind == statement).alias(f"has{i}{j}")]
    found = keyed.groupBy("doc_id", "period").agg(*aggregates)
    checks = []
    for i, name in enumerate(pairs):
        a, b = F.col(f"v{i}0"), F.col(f"v{i}1")
        checks.append(F.when(F.col(f"has{i}0") & F.col(f"has{i}1"), _check(name, a - b, tolerance(a, b), _said(a - b, tolerance(a, b), "A required line is missing in one statement."))))
    return found.select("doc_id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")


def duplicate_checks(rows: DataFrame) -> DataFrame:
    """Concepts that several rows of one statement map to exactly."""
    mapped = rows.filter((F.col("mapping_relationship") == EXACT) & ~F.col("mapping_rule").isin("unmapped", "section") & (F.trim("standard_item") != ""))
    counted = mapped.groupBy("doc_id", "statement_type", "standard_item").agg(F.count("*").alias("n")).filter("n > 1")
    return counted.select("doc_id", F.lit("Duplicate mapped concept").alias("Check"), F.col("statement_type").alias("Scope"), F.lit("WARN").alias("Status"), F.concat(F.lit("'"), "standard_item", F.lit("' has "), F.col("n").cast("string"), F.lit(" exact mappings.")).alias("Detail"), "n")


def unit_checks(units: DataFrame) -> DataFrame:
    """One scale and currency for all statements of a document: PASS; several: WARN; unknown ones: NOT_TESTED."""
    one = F.struct(F.coalesce("unit_label", F.lit("reported units")).alias("label"), F.coalesce("currency", F.lit("")).alias("currency"))
    per = units.groupBy("doc_id").agg(F.collect_set(one).alias("all"), F.max((F.coalesce("unit_label", F.lit("")).isin("", "reported units")).cast("int")).alias("unknown"))
    known = F.size(F.filter("all", lambda x: (x["label"] != "reported units") | (x["currency"] != "")))
    status = F.when((known == 0) | ((known == 1) & (F.col("unknown") == 1)), "NOT_TESTED").when(known == 1, "PASS").otherwise("WARN")
    return per.select("doc_id", F.lit("Statement unit consistency").alias("Check"), F.lit("All statements").alias("Scope"), status.alias("Status"), F.array_join(F.array_sort(F.transform("all", lambda x: F.concat_ws(" ", x["label"], x["currency"]))), "; ").alias("Detail"))


# Source grids: rows ARRAY<ARRAY<STRING>>, row_kinds, column labels; one row for each cell once exploded.


def grid_cells(grids: DataFrame, labels: str = "period_labels", movement: bool = False) -> DataFrame:
    """doc_id, table_id, row_index, kind, key, period_ord, period, cell, value (of one finite number), moved (where a dash counts 0) for each amount cell."""
    rows = grids.select("doc_id", "table_id", F.col(labels).alias("_labels"), F.posexplode(F.arrays_zip(F.col("rows"), F.col("row_kinds"))).alias("row_index", "_r"))
    each = rows.select("doc_id", "table_id", "row_index", F.col("_r.row_kinds").alias("kind"), label_key(F.get("_r.rows", F.lit(0))).alias("key"), F.posexplode("_labels").alias("period_ord", "period"), F.col("_r.rows").alias("_cells"))
    cut = each.select("doc_id", "table_id", "row_index", "kind", "key", "period_ord", "period", F.get(F.col("_cells"), F.col("period_ord") + 1).alias("cell"))
    single = F.col("cell").rlike(SINGLE) & ~F.isnan("_token.value") & (F.abs("_token.value") < float("inf"))
    value = F.when(F.lit(movement) & (F.col("_token.status") == "DASH"), 0.0).otherwise(F.when(single, F.col("_token.value")))
    return with_token(cut, "cell", "_token").withColumn("value", value).withColumn("moved", F.when(F.col("_token.status") == "DASH", 0.0).otherwise(F.col("value"))).drop("_token")


def equation(actual: Column, expected: Column) -> Column:
    """Status of printed amounts, which are rounded to one unit whatever their size."""
    return verdict(actual - expected, F.lit(1.0))


_EQUITY = r"(?:(?:share|stock)holders[’']? )?equity"


def section_sums(cells: DataFrame, sections: list[tuple[str, str, str]]) -> DataFrame:
    """name, heading and total label of each section: the sum between its heading row and its total row, in each column.

    Both rows must be unique, at least one row stand between them, and every row there be data, no total, and numeric; else the sum is null. Rows that are
    not so part a column into stretches; each has one sum, and a section is the stretch between its heading and its total, whatever the number of sections.
    """
    by = ["doc_id", "table_id", "period_ord", "period"]
    parts = (F.col("kind") != "data") | F.col("key").startswith("total ") | F.col("value").isNull()
    marked = cells.select(*by, "row_index", "kind", "key", "value", F.coalesce(parts, F.lit(True)).alias("_parts"))
    column = Window.partitionBy(*by).orderBy("row_index")
    stretch = F.count_if("_parts").over(column.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stretches = marked.withColumn("_n", stretch).groupBy(*by, "_n").agg(*[F.max(F.when(F.col("_parts"), F.col(c))).alias(c) for c in ("kind", "key", "value")], F.sum(F.when(~F.col("_parts"), F.col("value"))).alias("_sum"))
    ends = lambda c: F.lead(c).over(Window.partitionBy(*by).orderBy("_n"))
    stretches = stretches.withColumns({"_until_kind": ends("kind"), "_until": ends("key")})
    is_total = lambda kind, key, total: F.coalesce((F.col(kind) == "data") & F.col(key).rlike(f"^(?:{total})$"), F.lit(False))
    facts, made = [], []
    for i, (name, heading, total) in enumerate(sections):
        starts = F.coalesce((F.col("kind") == "section") & F.col("key").rlike(f"^(?:{heading}):?$"), F.lit(False))
        facts += [F.count_if(starts).alias(f"_s{i}"), F.count_if(is_total("kind", "key", total)).alias(f"_t{i}"), F.max(F.when(is_total("kind", "key", total), F.col("value"))).alias(f"_a{i}"), F.max(F.when(starts & is_total("_until_kind", "_until", total), F.col("_sum"))).alias(f"_e{i}")]
        actual = F.when(F.col(f"_t{i}") == 1, finite(F.col(f"_a{i}")))
        made.append(F.struct(F.lit(name).alias("name"), actual.alias("actual"), F.when((F.col(f"_s{i}") == 1) & (F.col(f"_t{i}") == 1), F.col(f"_e{i}")).alias("expected")))
    return stretches.groupBy(*by).agg(*facts).select(*by, F.explode(F.array(*made)).alias("x")).select(*by, "x.*")


def corporate_balance_checks(grids: DataFrame) -> DataFrame:
    """Nine checks for each date: four sections, two totals, equity and two equations."""
    cells = grid_cells(grids)
    by = ["doc_id", "table_id", "period_ord", "period"]
    names = ("current assets", "non-current assets", "current liabilities", "non-current liabilities")
    sums = section_sums(cells, [*((f"Balance sheet: {n}", n, f"total {n}") for n in names), ("Balance sheet: total equity", _EQUITY, f"total {_EQUITY}")])
    data = F.col("kind") == "data"
    get = lambda pattern: unique_value(data & F.col("key").rlike(f"^(?:{pattern})$"), F.col("value"))
    v = cells.groupBy(*by).agg(*[get(f"total {n}").alias(n) for n in (*names, "assets", "liabilities")], get(f"total {_EQUITY}|total net assets").alias("equity"), get(rf"total liabilities and (?:{_EQUITY}|(?:total )?net assets)").alias("reported"))
    c = F.col
    pairs = [
        ("Balance sheet: total assets", c("assets"), c("`current assets`") + c("`non-current assets`")),
        ("Balance sheet: total liabilities", c("liabilities"), c("`current liabilities`") + c("`non-current liabilities`")),
        ("Balance sheet: liabilities plus equity", c("reported"), c("liabilities") + c("equity")),
        ("Balance sheet: assets equal liabilities plus equity", c("reported"), c("assets")),
    ]
    rest = v.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), a.alias("actual"), e.alias("expected")) for n, a, e in pairs])).alias("x")).select(*by, "x.*")
    return sums.unionByName(rest).select("doc_id", "table_id", F.col("name").alias("Check"), F.col("period").alias("Scope"), equation(F.col("actual"), F.col("expected")).alias("Status"), "actual", "expected")


def fund_balance_checks(grids: DataFrame) -> DataFrame:
    cells = grid_cells(grids).filter("kind = 'data'")
    get = lambda pattern: unique_value(F.col("key").rlike(f"^(?:{pattern})$"), F.col("value"))
    v = cells.groupBy("doc_id", "table_id", "period_ord", "period").agg(get("total assets").alias("a"), get("total liabilities").alias("l"), get("total net assets").alias("n"), get("total liabilities and (?:total )?net assets").alias("r"))
    pairs = F.array(F.struct(F.lit("Assets = liabilities + net assets").alias("Check"), F.col("a").alias("actual"), (F.col("l") + F.col("n")).alias("expected")), F.struct(F.lit("Assets = reported liabilities and net assets").alias("Check"), F.col("a").alias("actual"), F.col("r").alias("expected")))
    return v.select("doc_id", "table_id", F.col("period").alias("Scope"), F.explode(pairs).alias("x")).select("doc_id", "table_id", "x.Check", "Scope", equation(F.col("x.actual"), F.col("x.expected")).alias("Status"), "x.actual", "x.expected")


def cash_grid_checks(grids: DataFrame) -> DataFrame:
    """Durations: beginning, change and exchange-rate effect make the end. Dates: the components make total cash."""
    data = grid_cells(grids).filter("kind = 'data'")
    has = lambda pattern: F.col("key").rlike(pattern)
    fx = has("^effect of (?:foreign currency )?exchange rates")
    is_total = F.col("key").startswith("total cash")
    v = data.groupBy("doc_id", "period").agg(
        unique_value(has(r"^cash.*beginning of (?:period|year)$"), F.col("value")).alias("begin"), unique_value(has(r"^cash.*end of (?:period|year)$"), F.col("value")).alias("end"),
        unique_value(has(r"^net (?:change|increase(?: \(decrease\))?|decrease) in cash"), F.col("value")).alias("change"), F.when(F.count_if(fx) == 0, 0.0).otherwise(unique_value(fx, F.col("moved"))).alias("fx"),
        unique_value(is_total, F.col("value")).alias("total"), F.count_if(is_total).alias("n_total"), F.when((F.count_if(~is_total) > 0) & (F.count_if(~is_total & F.col("moved").isNull()) == 0), F.sum(F.when(~is_total, F.col("moved")))).alias("parts"),
    )
    duration = F.lower("period").contains("ended")
    out = v.filter(duration | (F.col("n_total") == 1)).select("doc_id", F.when(duration, "Cash beginning + change + FX = ending").otherwise("Cash reconciliation components").alias("Check"), F.col("period").alias("Scope"), F.when(duration, F.col("end")).otherwise(F.col("total")).alias("actual"), F.when(duration, F.col("begin") + F.col("change") + F.col("fx")).otherwise(F.col("parts")).alias("expected"))
    return out.withColumn("Status", equation(F.col("actual"), F.col("expected")))


def equity_grid_checks(grids: DataFrame) -> DataFrame:
    """grids with component_labels and period_sections(start, end, caption): opening and change make the closing, movements make the change."""
    cells = grid_cells(grids, "component_labels")
    spans = grids.select("doc_id", "table_id", F.explode("period_sections").alias("s")).select("doc_id", "table_id", "s.start", "s.end", "s.caption")
    inside = cells.join(spans, ["doc_id", "table_id"]).filter("row_index >= start AND row_index < end")
    at = lambda row, value="value": F.max(F.when(F.col("row_index") == row, F.col(value)))
    is_move = (F.col("row_index") > F.col("start")) & (F.col("row_index") < F.col("end") - 2) & (F.col("kind") == "data")
    v = inside.groupBy("doc_id", "table_id", "caption", "start", "end", "period_ord", F.col("period").alias("component")).agg(
        at(F.col("start")).alias("opening"), at(F.col("end") - 2).alias("change"), at(F.col("end") - 1).alias("closing"), F.when((F.count_if(is_move) > 0) & (F.count_if(is_move & F.col("moved").isNull()) == 0), F.sum(F.when(is_move, F.col("moved")))).alias("moves"),
        at(F.col("start"), "key").alias("k0"), at(F.col("end") - 2, "key").alias("k1"), at(F.col("end") - 1, "key").alias("k2"),
    )
    shaped = F.coalesce(F.col("k0").rlike(r"^balance (?:at|as of)\b") & F.col("k2").rlike(r"^balance (?:at|as of)\b") & F.col("k1").startswith("total ") & (F.col("start") < F.col("end") - 2), F.lit(False))
    pairs = F.array(F.struct(F.lit("Equity beginning + change = ending").alias("Check"), F.col("closing").alias("actual"), (F.col("opening") + F.col("change")).alias("expected")), F.struct(F.lit("Equity movement subtotal").alias("Check"), F.col("change").alias("actual"), F.col("moves").alias("expected")))
    each = v.withColumn("shaped", shaped).select("doc_id", "table_id", "shaped", F.concat_ws(" / ", "caption", "component").alias("Scope"), F.explode(pairs).alias("x"))
    return each.select("doc_id", "table_id", "x.Check", "Scope", F.when(~F.col("shaped"), "FAIL").otherwise(equation(F.col("x.actual"), F.col("x.expected"))).alias("Status"), "x.actual", "x.expected")


def grid_integrity(grids: DataFrame, labels: str = "period_labels") -> DataFrame:
    """doc_id, table_id, Status, failures: headings distinct, counts equal, every data row as wide as its headings, amounts valid, no source row used twice."""
    head = F.coalesce(F.col(labels), F.array().cast("array<string>"))
    zipped = F.arrays_zip("rows", "row_kinds", "row_sources")
    data = F.filter(zipped, lambda r: r["row_kinds"] == "data")
    bad_cell = lambda v: (~F.lower(F.trim(F.coalesce(v, F.lit("")))).isin("-", "–", "—", "−", "n/a", "na", "n.a.", "n.a", "not applicable", "nm", "n.m.", "n.m", "not meaningful")) & ~F.coalesce(v.rlike(SINGLE) | v.rlike(r"^\s*[$€£¥]\s*[-–—−]\s*$"), F.lit(False))
    source = F.transform(F.filter(data, lambda r: F.coalesce(r["row_sources"], F.lit("")) != ""), lambda r: r["row_sources"])
    failures = F.array_compact(
        F.array(
            F.when((F.size(head) == 0) | F.exists(head, lambda h: F.trim(F.coalesce(h, F.lit(""))) == "") | (F.size(F.array_distinct(head)) != F.size(head)), "Missing or duplicate date/component headings."),
            F.when((F.size("rows") != F.size("row_kinds")) | (F.size("rows") != F.size("row_sources")), "Row content, row classification and source provenance have different counts."),
            F.when(F.exists(data, lambda r: F.coalesce(r["row_sources"], F.lit("")) == ""), "A row has no source position."),
            F.when(F.exists(data, lambda r: (F.size(r["rows"]) != F.size(head) + 1) | (F.coalesce(F.get(r["rows"], F.lit(0)), F.lit("")) == "")), "A row does not match its date/component columns."),
            F.when(F.exists(data, lambda r: F.exists(F.slice(r["rows"], F.lit(2), F.greatest(F.lit(0), F.size(r["rows"]) - 1)), bad_cell)), "A row has a blank, invalid or combined amount."),
            F.when(F.exists("rows", lambda r: F.exists(r, lambda v: F.coalesce(v.contains("�"), F.lit(False)))), "A row contains a replacement character."),
            F.when(F.size(data) == 0, "No financial rows are available."),
            F.when(F.size(F.array_distinct(source)) != F.size(source), "The same source position is used by multiple financial rows."),
        )
    )
    return grids.select("doc_id", "table_id", failures.alias("failures")).withColumn("Status", F.when(F.size("failures") > 0, "FAIL").otherwise("PASS"))


def review_report(*checks: DataFrame) -> DataFrame:
    """All checks in one table: distinct rows, most severe first."""
    columns = ["doc_id", "Check", "Scope", "Status", "Detail"]
    merged = None
    for one in checks:
        own = one.select(*[F.col(c) if c in one.columns else F.lit("").alias(c) for c in columns])
        merged = own if merged is None else merged.unionByName(own)
    rank = F.when(F.col("Status").isin("FAIL", "ERROR"), 0).when(F.col("Status") == "WARN", 1).when(F.col("Status") == "NOT_TESTED", 2).when(F.col("Status") == "PASS", 3).otherwise(4)
    return merged.distinct().withColumn("severity", rank)


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("doc_id").agg(*[F.count_if(F.col("Status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL", "NOT_TESTED")])
