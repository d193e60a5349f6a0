"""Two snapshots of extracted rows side by side: set differences, ordinal pairs, alignments, and decisions laid over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, code (ADDED, REMOVED, CHANGED), changed (names of values that differ), before and after as JSON, issue_id.

    One full outer join on the keys; equal content, which is nearly all of it, is told by a hash and goes no further. Nulls equal nulls.
    """
    pack = lambda frame, name: frame.select(*keys, F.struct(*values).alias(name), F.xxhash64(*values).alias(f"{name}_hash"))
    joined = pack(before, "before").join(pack(after, "after"), keys, "full_outer")
    differs = lambda c: F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), c)
    code = F.when(F.col("before_hash").isNull(), "ADDED").when(F.col("after_hash").isNull(), "REMOVED").when(F.col("before_hash") != F.col("after_hash"), "CHANGED")
    events = joined.withColumn("code", code).filter("code IS NOT NULL")
    events = events.select(*keys, "code", F.when(F.col("code") == "CHANGED", F.array_compact(F.array(*[differs(c) for c in values]))).otherwise(F.array().cast("array<string>")).alias("changed"), F.to_json("before").alias("before"), F.to_json("after").alias("after"))
    return events.withColumn("issue_id", content_hash(*[F.col(k) for k in keys], F.col("code"), F.col("before"), F.col("after")))


def severity(code: Column, critical: Column) -> Column:
    return F.when(code.isin("REMOVED", "CHANGED") & critical, 3).when(code == "REMOVED", 2).when(code == "CHANGED", 2).otherwise(1)


def with_decisions(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """events with state: what a decision(issue_id, decision) says, CONFLICT where decisions of one issue differ, OPEN without one."""
    per = decisions.groupBy("issue_id").agg(F.min("decision").alias("_lo"), F.max("decision").alias("_hi"))
    return events.join(per, "issue_id", "left").withColumn("state", F.when(F.col("_lo").isNull(), "OPEN").when(F.col("_lo") != F.col("_hi"), "CONFLICT").otherwise(F.col("_lo"))).drop("_lo", "_hi")


def stale_decisions(events: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(events.select("issue_id"), "issue_id", "left_anti")


def exit_code(events: DataFrame, accepted: tuple[str, ...] = ("ACCEPTED",)) -> DataFrame:
    """run_id, exit_code: 0 without open events, 1 with minor ones, 2 with critical ones."""
    open_ = ~F.col("state").isin(*accepted)
    return events.groupBy("run_id").agg(F.coalesce(F.max(F.when(open_, F.when(F.col("severity") >= 3, 2).otherwise(1))), F.lit(0)).alias("exit_code"))


def occurrence(keys: list[str], order: list[str]) -> Column:
    """Which occurrence of its key a row is, from 1: equal labels are paired by place, never by value."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def paired(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both sides by key and occurrence; a side that has fewer is null."""
    a = left.withColumn("nth", occurrence(keys, order))
    b = right.withColumn("nth", occurrence(keys, order))
    rest = [c for c in left.columns if c not in keys]
    a = a.select(*keys, "nth", *[F.col(c).alias(f"left_{c}") for c in rest])
    b = b.select(*keys, "nth", *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in keys])
    return a.join(b, [*keys, "nth"], "full_outer")


def matched_rows(expected: DataFrame, actual: DataFrame, keys: list[str], label: str, values: str, order: list[str]) -> DataFrame:
    """expected and actual rows one to one: first those equal in label and values, by occurrence; then, of what is left, those with the same label, by occurrence.

    exact tells which; unmatched rows have null on the other side.
    """
    sign = [*keys, label, values]
    a = expected.withColumn("_n", occurrence(sign, order)).select(*sign, "_n", *[F.col(c).alias(f"e_{c}") for c in order])
    b = actual.withColumn("_n", occurrence(sign, order)).select(*sign, "_n", *[F.col(c).alias(f"a_{c}") for c in order])
    both = a.join(b, [*sign, "_n"], "full_outer")
    first = [c for c in order][0]
    exact = both.filter(F.col(f"e_{first}").isNotNull() & F.col(f"a_{first}").isNotNull()).select(*keys, label, F.col(values).alias("expected"), F.col(values).alias("actual"), *[f"e_{c}" for c in order], *[f"a_{c}" for c in order], F.lit(True).alias("exact"))
    left = both.filter(F.col(f"a_{first}").isNull()).withColumn("_m", occurrence([*keys, label], [f"e_{c}" for c in order])).select(*keys, label, "_m", F.col(values).alias("expected"), *[f"e_{c}" for c in order])
    right = both.filter(F.col(f"e_{first}").isNull()).withColumn("_m", occurrence([*keys, label], [f"a_{c}" for c in order])).select(*keys, label, "_m", F.col(values).alias("actual"), *[f"a_{c}" for c in order])
    rest = left.join(right, [*keys, label, "_m"], "full_outer").select(*keys, label, "expected", "actual", *[f"e_{c}" for c in order], *[f"a_{c}" for c in order], F.lit(False).alias("exact"))
    return exact.unionByName(rest)


def verified_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, state: OK, CHANGED, MISSING or EXTRA of files(path, content) against manifest(path, sha256)."""
    own = files.select("path", F.sha2("content", 256).alias("found"))
    both = own.join(manifest.select("path", F.lower("sha256").alias("expected")), "path", "full_outer")
    return both.select("path", F.when(F.col("found").isNull(), "MISSING").when(F.col("expected").isNull(), "EXTRA").when(F.col("found") == F.col("expected"), "OK").otherwise("CHANGED").alias("state"))


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """Of each run the last attempt, if it has a receipt: a newer one without masks older ones."""
    last = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("attempt")))
    return attempts.withColumn("_n", last).filter("_n = 1").filter("receipt IS NOT NULL").drop("_n")


def uncovered_inputs(inputs: DataFrame, jobs: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Inputs that neither a job nor an exception covers."""
    return inputs.join(jobs.select("input"), "input", "left_anti").join(exceptions.select("input"), "input", "left_anti")


def selected_runs(entries: DataFrame, scopes: list[str], limit: int | None = None) -> DataFrame:
    """entries(run_id, scope, elapsed) of these scopes in the order to run them: by scope as listed, the longest first, then by name. limit: a batch of so many."""
    rank = F.array_position(F.array(*map(F.lit, scopes)), F.col("scope"))
    chosen = entries.filter(F.col("scope").isin(*scopes)).orderBy(rank, F.desc_nulls_last("elapsed"), "run_id")
    return chosen if limit is None else chosen.limit(limit)
