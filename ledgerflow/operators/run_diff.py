"""Two states of the same runs compared from the outside in: identity, state, pages, statements with their contexts, rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators.alignment import aligned
from ledgerflow.operators.diff import content_hash

#: What makes a run the same run.
IDENTITY = ("scope", "job_id", "filing_id", "input_sha256", "entity", "filing_type", "reporting_period")
#: What a statement's numbers depend on besides its rows.
CONTEXT = ("period_labels", "unit_label", "scale_factor", "currency", "unit_exceptions", "raw_unit_note", "source_pages")
COMPLETED, FAILED = "completed", ("failed", "process_failed", "timeout")
#: Levels from the outside in.
LEVELS = ("run", "identity", "state", "pages", "statement", "row")
EVENT = "run_id string, level string, code string, location string, before string, after string, severity string"


class Runs(NamedTuple):
    """runs(run_id, IDENTITY, status, error_type, error, pages, selected_pages), statements(run_id, kind, sheet, CONTEXT),
    rows(run_id, kind, row, key, label, cells array<string>, critical)."""

    runs: DataFrame
    statements: DataFrame
    rows: DataFrame


def state_of(status: Column) -> Column:
    return F.when(status == COMPLETED, COMPLETED).when(status.isin(*FAILED), "failed").when(status.isNull(), "missing").otherwise("unfinished")


def _event(level: str, code: Column | str, location: Column, before: Column, after: Column, severity: Column | str = "block") -> Column:
    text = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.struct(F.lit(level).alias("level"), text(code).alias("code"), location.alias("location"), before.alias("before"), after.alias("after"), text(severity).alias("severity"))


def _json(prefix: str, names: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*[F.col(f"{prefix}.{n}").alias(n) for n in names]), {"ignoreNullFields": "false"})


def statement_contexts(statements: DataFrame, tables: DataFrame) -> DataFrame:
    """statements(run_id, kind, ...) with source_pages: the distinct pages of its source tables(run_id, kind, source_page), in order; none is an empty list."""
    pages = tables.groupBy("run_id", "kind").agg(F.array_sort(F.collect_set("source_page")).alias("source_pages"))
    joined = statements.drop("source_pages").join(pages, ["run_id", "kind"], "left")
    return joined.withColumn("source_pages", F.coalesce("source_pages", F.array().cast(pages.schema["source_pages"].dataType)))


def run_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """run_id, verdict and events of each run of either side.

    | before | after | verdict | event |
    | --- | --- | --- | --- |
    | none / any | any / none | added / removed | RUN_ADDED, RUN_REMOVED |
    | other identity | | invalid | RUN_IDENTITY_CHANGED |
    | unfinished | any, or the reverse | invalid | RUN_UNFINISHED |
    | failed | the same failure | known_failure | none |
    | any | another failure | failed | NEW_OR_CHANGED_RUN_FAILURE |
    | failed | completed | recovered | RECOVERED_RUN_REQUIRES_SOURCE_REVIEW |
    | completed | completed | compared | none |

    Pages are compared for runs that are in both with one identity: REQUESTED_PAGES_CHANGED, and SELECTED_PAGES_CHANGED where both are completed.
    """
    side = lambda frame, name: frame.select("run_id", F.struct(*[c for c in frame.columns if c != "run_id"]).alias(name))
    both = side(before, "b").join(side(after, "a"), "run_id", "full_outer")
    old, new = state_of(F.col("b.status")), state_of(F.col("a.status"))
    same = lambda names: F.struct(*[F.col(f"b.{n}") for n in names]).eqNullSafe(F.struct(*[F.col(f"a.{n}") for n in names]))
    failure = ("status", "error_type", "error")
    whole = F.col("b").isNotNull() & F.col("a").isNotNull()
    verdict = (
        F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~same(IDENTITY), "invalid").when((old == "unfinished") | (new == "unfinished") | (old == "missing") | (new == "missing"), "invalid")
        .when((old == "failed") & (new == "failed") & same(failure), "known_failure").when(new == "failed", "failed").when(old == "failed", "recovered").otherwise("compared")
    )
    identical = whole & same(IDENTITY)
    text = lambda c: F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})
    request, pages, none = F.lit("request"), F.lit("pages"), F.lit(None).cast("string")
    events = F.array(
        F.when(verdict == "added", _event("run", "RUN_ADDED", F.lit("run"), none, F.col("a.status"))),
        F.when(verdict == "removed", _event("run", "RUN_REMOVED", F.lit("run"), F.col("b.status"), none)),
        F.when(whole & ~same(IDENTITY), _event("identity", "RUN_IDENTITY_CHANGED", F.lit("identity"), _json("b", IDENTITY), _json("a", IDENTITY), "error")),
        F.when(identical & (verdict == "invalid"), _event("state", "RUN_UNFINISHED", F.lit("execution"), F.col("b.status"), F.col("a.status"), "error")),
        F.when(verdict == "failed", _event("state", "NEW_OR_CHANGED_RUN_FAILURE", F.lit("execution"), _json("b", failure), _json("a", failure))),
        F.when(verdict == "recovered", _event("state", "RECOVERED_RUN_REQUIRES_SOURCE_REVIEW", F.lit("execution"), F.col("b.status"), F.col("a.status"))),
        F.when(identical & (verdict != "invalid") & ~same(("pages",)), _event("pages", "REQUESTED_PAGES_CHANGED", request, text("b.pages"), text("a.pages"))),
        F.when((verdict == "compared") & ~same(("selected_pages",)), _event("pages", "SELECTED_PAGES_CHANGED", pages, text("b.selected_pages"), text("a.selected_pages"))),
    )
    return both.select("run_id", verdict.alias("verdict"), F.array_compact(events).alias("events"))


def _statement_events(before: DataFrame, after: DataFrame) -> DataFrame:
    side = lambda frame, name: frame.select("run_id", "kind", F.struct("sheet", *CONTEXT).alias(name))
    both = side(before, "b").join(side(after, "a"), ["run_id", "kind"], "full_outer")
    whole, kind = F.col("b").isNotNull() & F.col("a").isNotNull(), F.col("kind")
    contexts = [F.struct(*[F.col(f"{s}.{c}") for c in CONTEXT]) for s in ("b", "a")]
    there = lambda s: F.when(F.col(s).isNotNull(), "true").otherwise("false")
    events = F.array(
        F.when(~whole, _event("statement", "STATEMENT_SET_CHANGED", kind, there("b"), there("a"))),
        F.when(whole & ~contexts[0].eqNullSafe(contexts[1]), _event("statement", "PERIOD_UNIT_OR_SOURCE_CONTEXT_CHANGED", kind, _json("b", CONTEXT), _json("a", CONTEXT))),
        F.when(whole & ~F.col("b.sheet").eqNullSafe(F.col("a.sheet")), _event("statement", "SHEET_TITLE_CHANGED", kind, F.col("b.sheet"), F.col("a.sheet"), "warning")),
    )
    return both.select("run_id", F.explode(F.array_compact(events)).alias("e")).select("run_id", "e.*")


def _row_events(before: DataFrame, after: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of the shared statements(run_id, kind) that differ, aligned by their keys: never by their values. One side of a statement may have no rows."""
    place = F.row_number().over(Window.partitionBy("run_id", "kind").orderBy("row")) - 1
    number = lambda frame: frame.withColumns({"pos": place, "_row": F.struct("label", "cells")})
    b, a = number(before), number(after)
    of = lambda frame, name: frame.groupBy("run_id", "kind").agg(F.bit_xor(F.xxhash64("pos", "key", "label", "cells", "critical")).alias(f"{name}h"), F.bit_xor(F.xxhash64(F.lit(1), "pos", "key", "label", "cells", "critical")).alias(f"{name}g"), F.count("*").alias(f"{name}n"))
    both = of(b, "b").join(of(a, "a"), ["run_id", "kind"], "full_outer").join(shared, ["run_id", "kind"], "left_semi")
    differ = both.filter("NOT (bh <=> ah AND bg <=> ag AND bn <=> an)").select("run_id", "kind")
    b, a = (frame.join(differ, ["run_id", "kind"], "left_semi") for frame in (b, a))
    script = aligned(b, a, ["run_id", "kind"], "row", "key")
    at = ["run_id", "kind"]
    equal = script.filter("op = 'equal'").select(*at, F.explode(F.expr("sequence(before_from, before_to - 1)")).alias("pos"), F.expr("after_from - before_from").alias("_by")).withColumn("_to", F.col("pos") + F.col("_by"))
    pairs = b.join(equal, [*at, "pos"]).select(*at, "_to", "row", F.col("_row").alias("_b"), F.col("critical").alias("_cb")).join(a.select(*at, F.col("pos").alias("_to"), F.col("_row").alias("_a"), F.col("critical").alias("_ca")), [*at, "_to"])
    weight = lambda critical: F.when(critical, "block").otherwise("warning")
    json = lambda c: F.to_json(F.col(c))
    values = pairs.filter(~F.col("_b.cells").eqNullSafe(F.col("_a.cells"))).select("run_id", _event("row", "ROW_VALUES_OR_FIELDS_CHANGED", F.concat("kind", F.lit(":row:"), F.col("row").cast("string")), json("_b"), json("_a"), weight(F.col("_cb") | F.col("_ca"))).alias("e"))
    steps = script.filter("op <> 'equal'").withColumn("step", F.struct("before_from", "before_to", "after_from", "after_to"))

    def rows_of(frame: DataFrame, start: str, end: str, name: str) -> DataFrame:
        places = steps.filter(F.col(end) > F.col(start)).select(*at, "step", F.explode(F.expr(f"sequence({start}, {end} - 1)")).alias("pos"))
        return places.join(frame, [*at, "pos"]).groupBy(*at, "step").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_row"))), lambda x: x["_row"])).alias(name), F.max("critical").alias(f"{name}_critical"))

    sides = steps.select(*at, "step").join(rows_of(b, "before_from", "before_to", "_b"), [*at, "step"], "left").join(rows_of(a, "after_from", "after_to", "_a"), [*at, "step"], "left")
    where = F.concat_ws(":", "kind", F.lit("rows"), F.col("step.before_from").cast("string"), F.col("step.before_to").cast("string"))
    critical = F.coalesce("_b_critical", F.lit(False)) | F.coalesce("_a_critical", F.lit(False))
    moved = sides.select("run_id", _event("row", "ROWS_REMOVED_ADDED_OR_REORDERED", where, F.coalesce("_b", F.lit("[]")), F.coalesce("_a", F.lit("[]")), weight(critical)).alias("e"))
    return values.unionByName(moved).select("run_id", "e.*")


def compared(before: Runs, after: Runs) -> tuple[DataFrame, DataFrame]:
    """Verdicts (run_id, verdict: see run_transitions) and events (run_id, level, code, location, before, after, severity, issue_id).

    Statements and rows are compared for runs that are completed on both sides; statements whose rows are equal, by two hashes of them, aren't aligned.
    """
    runs = run_transitions(before.runs, after.runs)
    completed = runs.filter("verdict = 'compared'").select("run_id")
    own = lambda frame: frame.join(completed, "run_id", "left_semi")
    outer = runs.select("run_id", F.explode("events").alias("e")).select("run_id", "e.*")
    old, new = own(before.statements), own(after.statements)
    shared = old.select("run_id", "kind").join(new.select("run_id", "kind"), ["run_id", "kind"], "left_semi").distinct()
    events = outer.unionByName(_statement_events(old, new)).unionByName(_row_events(own(before.rows), own(after.rows), shared))
    return runs.select("run_id", "verdict"), events.withColumn("issue_id", content_hash(*map(F.col, ("run_id", "code", "location", "before", "after"))))


def first_level(events: DataFrame) -> DataFrame:
    """Of each run the events of the outermost level that has any: what is further in may follow from these."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return events.withColumn("_r", rank).withColumn("_m", F.min("_r").over(Window.partitionBy("run_id"))).filter("_r = _m").drop("_r", "_m")
