from __future__ import annotations

import hashlib
import json
import random

from ledgerflow.operators import run_diff as R
from ledgerflow.operators import trees as T
from ledgerflow.sources import runs as sources

FILE = "run_id string, path string, sha256 string"


def by_folders(files):
    """Whole trees by recursion: {(run, path): whether it is a folder}, and equality of folders by their content alone."""
    out = {}
    for run, path, digest in files:
        parts = path.split("/")
        for i in range(len(parts)):
            out.setdefault((run, "/".join(parts[:i])), set()).add(("/".join(parts[i:]), digest))
    return {k: frozenset(v) for k, v in out.items()}


def some_files(rng, runs=4):
    return [(f"r{k}", "/".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) + f"/f{i}", str(rng.randint(0, 5))) for k in range(runs) for i in range(25)]


def test_digests_are_equal_where_folders_are(spark):
    rng = random.Random(4)
    files = [(r, p.lstrip("/"), d) for r, p, d in some_files(rng)]
    files += [("same1", *f[1:]) for f in files if f[0] == "r0"] + [("same2", *f[1:]) for f in reversed(files) if f[0] == "r0"]
    want = by_folders(files)
    nodes = T.tree(spark.createDataFrame(files, FILE), ["run_id"]).collect()
    folders = {(n.run_id, n.path): n for n in nodes if n.folder}
    assert set(folders) == set(want) and all(folders[k].n_files == len(v) for k, v in want.items())
    by_content, by_digest = {}, {}
    for k, v in want.items():
        by_content.setdefault(v, set()).add(folders[k].digest)
        by_digest.setdefault(folders[k].digest, set()).add(v)
    assert all(len(x) == 1 for x in [*by_content.values(), *by_digest.values()])


def test_changed_files_and_what_was_looked_at(spark):
    before = [("r", f"{d}/{e}/f{i}", f"{d}{e}{i}") for d in "abcd" for e in "xy" for i in range(3)] + [("gone", "f", "1"), ("kept", "a/b/c", "2")]
    after = [f for f in before if f[0] != "gone" and f[1] not in ("a/x/f0", "a/x/f1", "b/y/f2")] + [("r", "a/x/f0", "other"), ("r", "new/place", "bb"), ("r", "d/x/moved", "ay0"), ("r", "b/y/f2_renamed", "by2"), ("more", "f", "1")]
    after = [f for f in after if f[1] != "a/y/f0"]
    trees = [T.tree(spark.createDataFrame(x, FILE), ["run_id"]) for x in (before, after)]
    got = sorted((r.run_id, r.path, r.code, r.moved_from) for r in T.changed_files(*trees, ["run_id"]).collect())
    want = [("gone", "f", "REMOVED", None), ("more", "f", "ADDED", None), ("r", "a/x/f0", "CHANGED", None), ("r", "a/x/f1", "REMOVED", None), ("r", "b/y/f2_renamed", "MOVED", "b/y/f2"), ("r", "d/x/moved", "MOVED", "a/y/f0"), ("r", "new/place", "ADDED", None)]
    assert got == want
    looked = {(r.run_id, r.path) for r in T.differences(*trees, ["run_id"]).collect()}
    assert ("kept", "") not in looked and not any(p.startswith("c") for _, p in looked)
    assert T.changed_files(trees[0], trees[0], ["run_id"]).count() == 0


def test_receipts(spark):
    files = [("a", 1, "x/1", "d1"), ("a", 2, "x/1", "d2"), ("b", 1, "y", "d3"), ("c", 1, "y", "d3"), ("d", 1, "z", "d4"), ("d", 2, "z", "d5")]
    keys = ["run_id", "attempt"]
    nodes = T.tree(spark.createDataFrame(files, "run_id string, attempt int, path string, sha256 string"), keys)
    root = {(r.run_id, r.attempt): r.root for r in T.roots(nodes, keys).collect()}
    receipts = [("a", 1, root["a", 1]), ("a", 2, root["a", 2]), ("b", 1, "0" * 64), ("c", 1, None), ("lost", 1, "f" * 64), ("d", 1, root["d", 1])]
    frame = spark.createDataFrame(receipts, "run_id string, attempt int, receipt string")
    states = {(r.run_id, r.attempt): r.state for r in T.verified_receipts(frame, nodes, keys).collect()}
    assert states == {("a", 1): "VERIFIED", ("a", 2): "VERIFIED", ("b", 1): "ALTERED", ("c", 1): "UNFINISHED", ("lost", 1): "LOST", ("d", 1): "VERIFIED", ("d", 2): "UNFINISHED"}
    assert [(r.run_id, r.attempt) for r in T.finished_attempts(frame, nodes).collect()] == [("a", 2)]
    assert root["b", 1] == root["c", 1]


def test_runs_and_evidence_from_folders(spark, tmp_path):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    files = {"r1/result.json": json.dumps({"status": "completed", "scope": "full", "selected_pages": [2, 3], "job": {"job_id": "j", "entity": "e"}}), "r1/out/book.xlsx": "book", "r2/result.json": "{broken", "r2/source.pdf": "pdf", "top.txt": "no run"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    loaded = sources.load(spark, str(tmp_path))
    digests = sources.digests(loaded)
    assert {(r.run_id, r.path): r.sha256 for r in digests.collect()} == {tuple(k.split("/", 1)): sha(v) for k, v in files.items() if "/" in k}
    records = {r.run_id: (r.status, r.selected_pages, r.job and r.job.entity) for r in sources.records(loaded).collect()}
    assert records == {"r1": ("completed", [2, 3], "e"), "r2": ("unreadable", None, None)}
    manifest = [("r1", "result.json", sha(files["r1/result.json"]).upper()), ("r1", "out/book.xlsx", sha("other")), ("r1", "lost.txt", sha("x")), ("r1", "../r2/source.pdf", sha("pdf")), ("r2", "source.pdf", sha("pdf"))]
    listed = spark.createDataFrame(manifest, FILE)
    problems = {(r.run_id, r.path, r.problem) for r in T.evidence(digests, listed, ("source.pdf",), ["run_id"]).collect()}
    assert problems == {("r1", "out/book.xlsx", "ALTERED"), ("r1", "lost.txt", "LOST"), ("r1", "../r2/source.pdf", "OUTSIDE"), ("r1", "source.pdf", "REQUIRED"), ("r2", "result.json", "UNREGISTERED")}
    references = spark.createDataFrame([("r1", sha("pdf")), ("r2", sha("pdf")), ("r2b", None)], "run_id string, source_sha256 string")
    assert [r.run_id for r in T.other_sources(references, listed, ["run_id"]).collect()] == ["r1"]
    for path, ok in {"a/b": True, "/a": False, "a/../b": False, "C:\\x": False, "a\\..\\b": False, "": False, "a//b": False, "..a": True}.items():
        assert spark.createDataFrame([(path,)], "p string").select(sources.inside(sources.F.col("p"))).first()[0] is ok


RUN = "run_id string, scope string, job_id string, filing_id string, input_sha256 string, entity string, filing_type string, reporting_period string, status string, error_type string, error string, pages string, selected_pages array<int>"
STATEMENT = "run_id string, kind string, sheet string, period_labels array<string>, unit_label string, scale_factor long, currency string, unit_exceptions array<string>, raw_unit_note string"
ROW = "run_id string, kind string, row int, key string, label string, cells array<string>, critical boolean"


def run(name, status="completed", error=None, pages="auto", selected=(1, 2), entity="e"):
    return (name, "full", "j", "f", "s", entity, "10-K", "2026", status, error and "E", error, pages, list(selected))


def sides(spark, runs, statements=(), rows=(), tables=()):
    frame = spark.createDataFrame([(r, k, sheet, ["2026"], unit, 1000, "USD", None, None) for r, k, sheet, unit in statements], STATEMENT)
    pages = spark.createDataFrame(list(tables), "run_id string, kind string, source_page int")
    return R.Runs(spark.createDataFrame(runs, RUN), R.statement_contexts(frame, pages), spark.createDataFrame(list(rows), ROW))


def test_every_transition(spark):
    before = [run("same"), run("known", "failed", "x"), run("other", "failed", "x"), run("kind", "failed", "x"), run("broken"), run("fixed", "timeout"), run("gone"), run("identity"), run("open", "running"), run("opened"), run("request", pages="1-3"), run("pages"), run("failedpages", "failed", "x", pages="1")]
    after = [run("same"), run("known", "failed", "x"), run("other", "failed", "y"), run("kind", "timeout", "x"), run("broken", "process_failed", "z"), run("fixed"), run("new"), run("identity", entity="another"), run("open"), run("opened", "running"), run("request", pages="1-4"), run("pages", selected=(1, 3)), run("failedpages", "failed", "x", pages="2")]
    verdicts, events = R.compared(sides(spark, before), sides(spark, after))
    assert {r.run_id: r.verdict for r in verdicts.collect()} == {"same": "compared", "known": "known_failure", "other": "failed", "kind": "failed", "broken": "failed", "fixed": "recovered", "gone": "removed", "new": "added", "identity": "invalid", "open": "invalid", "opened": "invalid", "request": "compared", "pages": "compared", "failedpages": "known_failure"}
    assert {(r.run_id, r.level, r.code, r.severity) for r in events.collect()} == {
        ("other", "state", "NEW_OR_CHANGED_RUN_FAILURE", "block"), ("kind", "state", "NEW_OR_CHANGED_RUN_FAILURE", "block"), ("broken", "state", "NEW_OR_CHANGED_RUN_FAILURE", "block"), ("fixed", "state", "RECOVERED_RUN_REQUIRES_SOURCE_REVIEW", "block"),
        ("gone", "run", "RUN_REMOVED", "block"), ("new", "run", "RUN_ADDED", "block"), ("identity", "identity", "RUN_IDENTITY_CHANGED", "error"), ("open", "state", "RUN_UNFINISHED", "error"), ("opened", "state", "RUN_UNFINISHED", "error"),
        ("request", "pages", "REQUESTED_PAGES_CHANGED", "block"), ("pages", "pages", "SELECTED_PAGES_CHANGED", "block"), ("failedpages", "pages", "REQUESTED_PAGES_CHANGED", "block"),
    }


def test_statements_and_rows(spark):
    runs = [run("r"), run("equal"), run("both")]
    row = lambda r, i, label, *cells, critical=True, kind="BalanceSheet": (r, kind, i, label.lower(), label, list(cells), critical)
    rows = [row("r", 3, "Assets", critical=False), row("r", 4, "Cash", "1"), row("r", 5, "Debt", "2"), row("r", 6, "Total", "3"), row("equal", 1, "Cash", "1"), row("both", 1, "Cash", "1")]
    changed = [row("r", 9, "Heading", critical=False), row("r", 10, "Cash", "1"), row("r", 12, "Total", "4"), row("r", 13, "Note", "5"), row("equal", 7, "Cash", "1"), row("both", 1, "Cash", "2")]
    b = [("r", "BalanceSheet", "Sheet", "thousands"), ("r", "IncomeStatement", "Income", "thousands"), ("equal", "BalanceSheet", "Sheet", "thousands"), ("both", "BalanceSheet", "Sheet", "thousands")]
    a = [("r", "BalanceSheet", "Other title", "thousands"), ("r", "CashFlowStatement", "Cash", "thousands"), ("equal", "BalanceSheet", "Sheet", "thousands"), ("both", "BalanceSheet", "Sheet", "millions")]
    tables = [("equal", "BalanceSheet", 5), ("equal", "BalanceSheet", 4), ("equal", "BalanceSheet", 5), ("r", "BalanceSheet", 2)]
    _, events = R.compared(sides(spark, runs, b, rows, tables), sides(spark, runs, a, changed, [*tables[:2], ("r", "BalanceSheet", 3)]))
    got = {(e.run_id, e.code, e.location, e.severity): (e.before, e.after) for e in events.collect()}
    assert set(got) == {
        ("r", "SHEET_TITLE_CHANGED", "BalanceSheet", "warning"), ("r", "PERIOD_UNIT_OR_SOURCE_CONTEXT_CHANGED", "BalanceSheet", "block"), ("r", "STATEMENT_SET_CHANGED", "IncomeStatement", "block"), ("r", "STATEMENT_SET_CHANGED", "CashFlowStatement", "block"),
        ("r", "ROWS_REMOVED_ADDED_OR_REORDERED", "BalanceSheet:rows:0:1", "warning"), ("r", "ROWS_REMOVED_ADDED_OR_REORDERED", "BalanceSheet:rows:2:3", "block"), ("r", "ROW_VALUES_OR_FIELDS_CHANGED", "BalanceSheet:row:6", "block"), ("r", "ROWS_REMOVED_ADDED_OR_REORDERED", "BalanceSheet:rows:4:4", "block"),
        ("both", "PERIOD_UNIT_OR_SOURCE_CONTEXT_CHANGED", "BalanceSheet", "block"), ("both", "ROW_VALUES_OR_FIELDS_CHANGED", "BalanceSheet:row:1", "block"),
    }
    old, new = got["r", "ROWS_REMOVED_ADDED_OR_REORDERED", "BalanceSheet:rows:2:3", "block"]
    assert json.loads(old) == [{"label": "Debt", "cells": ["2"]}] and json.loads(new) == []
    old, new = got["r", "PERIOD_UNIT_OR_SOURCE_CONTEXT_CHANGED", "BalanceSheet", "block"]
    assert (json.loads(old)["source_pages"], json.loads(new)["source_pages"]) == ([2], [3])
    assert {e.run_id: e.level for e in R.first_level(events).collect()} == {"r": "statement", "both": "statement"}
    assert events.select("issue_id").distinct().count() == len(got)


def test_statements_that_lose_or_gain_every_row(spark):
    row = lambda r, i, label, kind="BalanceSheet": (r, kind, i, label.lower(), label, ["1"], True)
    runs = [run("emptied"), run("filled"), run("none"), run("parted")]
    own = [(r, "BalanceSheet", "Sheet", "thousands") for r in ("emptied", "filled", "none")]
    before = sides(spark, runs, [*own, ("parted", "BalanceSheet", "Sheet", "thousands")], [row("emptied", 1, "Cash"), row("emptied", 2, "Debt"), row("parted", 1, "Cash")])
    after = sides(spark, runs, [*own, ("parted", "IncomeStatement", "Sheet", "thousands")], [row("filled", 1, "Cash"), row("parted", 1, "Sales", "IncomeStatement")])
    got = {(e.run_id, e.code, e.location): (e.before, e.after) for e in R.compared(before, after)[1].collect()}
    labels = lambda text: [r["label"] for r in json.loads(text)]
    assert {k: tuple(map(labels, v)) for k, v in got.items() if k[0] != "parted"} == {
        ("emptied", "ROWS_REMOVED_ADDED_OR_REORDERED", "BalanceSheet:rows:0:2"): (["Cash", "Debt"], []),
        ("filled", "ROWS_REMOVED_ADDED_OR_REORDERED", "BalanceSheet:rows:0:0"): ([], ["Cash"]),
    }
    assert {k[1] for k in got if k[0] == "parted"} == {"STATEMENT_SET_CHANGED"}
