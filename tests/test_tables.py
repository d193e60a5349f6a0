from __future__ import annotations

import random

import pytest

from ledgerflow import api
from ledgerflow.operators import tables as T
from ledgerflow.sources import snapshots

EDGE, WORD = "doc_id string, source_page int, x0 double, x1 double, top double, bottom double", "doc_id string, source_page int, text string, x0 double, x1 double, top double, bottom double"


def grid_of(rng, page):
    """A random rectangle cut in two again and again: its cells are known before any rule is drawn."""
    xs, ys = [0, *sorted(rng.sample(range(1, 12), rng.randint(1, 5))), 12], [0, *sorted(rng.sample(range(1, 16), rng.randint(1, 6))), 16]
    at = lambda i: 20.0 + i * 37.0
    whole, cells = [(0, len(xs) - 1, 0, len(ys) - 1)], []
    while whole:
        a, b, c, d = whole.pop()
        ways = [("x", k) for k in range(a + 1, b)] + [("y", k) for k in range(c + 1, d)]
        if not ways or (len(ways) < 4 and rng.random() < 0.25):
            cells.append((at(xs[a]), at(xs[b]), at(ys[c]), at(ys[d])))
            continue
        way, k = rng.choice(ways)
        whole += [(a, k, c, d), (k, b, c, d)] if way == "x" else [(a, b, c, k), (a, b, k, d)]
    return [("d", page, *c) for c in cells]


def edges_of(rng, cells):
    """The cells' sides, each a little off its place, as flat boxes, in pieces, or as the whole box."""
    off = lambda: rng.uniform(-0.4, 0.4)
    edges = []
    for d, p, x0, x1, top, bottom in cells:
        if rng.random() < 0.3:
            edges.append((d, p, x0 + off(), x1 + off(), top + off(), bottom + off()))
            continue
        for y in (top, bottom):
            m = rng.uniform(x0 + 10, x1 - 10)
            shift = off()
            edges += [(d, p, x0 + off(), m + 1, y + shift, y + shift + 0.5), (d, p, m - 1, x1 + off(), y + shift, y + shift + 0.5)]
        for x in (x0, x1):
            shift = off()
            edges.append((d, p, x + shift, x + shift + 0.5, top + off(), bottom + off()))
    rng.shuffle(edges)
    return edges


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_of_random_rectangles(spark, seed):
    rng = random.Random(seed)
    want = [c for page in range(25) for c in grid_of(rng, page)]
    edges = spark.createDataFrame(edges_of(rng, want), EDGE)
    got = [tuple(r) for r in T.bounded_cells(T.corners(T.rules(edges))).select("doc_id", "source_page", "x0", "x1", "top", "bottom").collect()]
    near = lambda rows: sorted((d, p, *(round((x - 20) / 37) for x in sides)) for d, p, *sides in rows)
    assert near(got) == near(want)
    assert all(abs(x - 20 - 37 * round((x - 20) / 37)) < 1 for r in got for x in r[2:])


def test_rules_are_snapped_and_joined(spark):
    rows = [("d", 1, 0.0, 50.0, 10.0, 10.5), ("d", 1, 52.0, 100.0, 11.0, 11.5), ("d", 1, 60.0, 90.0, 13.0, 13.2), ("d", 1, 130.0, 160.0, 10.0, 10.0), ("d", 1, 0.0, 1.0, 0.0, 2.0), ("d", 2, None, 5.0, 1.0, 1.0), ("d", 2, float("nan"), 5.0, 1.0, 1.0), ("d", 2, 0.0, 0.5, 5.0, 90.0)]
    got = sorted((r.source_page, r.level, round(r.lo, 3), round(r.hi, 3)) for r in T.rules(spark.createDataFrame(rows, EDGE)).collect())
    assert got == [(1, True, 0.0, 100.0), (1, True, 130.0, 160.0), (2, False, 5.0, 90.0)]


def test_a_stub_and_a_gap_make_no_cell(spark):
    box = [("d", 1, 0.0, 100.0, 0.0, 0.0), ("d", 1, 0.0, 100.0, 50.0, 50.0), ("d", 1, 0.0, 0.0, 0.0, 50.0), ("d", 1, 100.0, 100.0, 0.0, 50.0)]
    found = lambda rows: sorted(tuple(r)[2:] for r in T.bounded_cells(T.corners(T.rules(spark.createDataFrame(rows, EDGE)))).collect())
    whole = [(0.0, 100.0, 0.0, 50.0)]
    assert found(box) == whole
    assert found([*box, ("d", 1, 60.0, 60.0, 30.0, 50.0)]) == whole  # comes up from below and ends inside
    assert found([*box, ("d", 1, 60.0, 60.0, 0.0, 50.0)]) == [(0.0, 60.0, 0.0, 50.0), (60.0, 100.0, 0.0, 50.0)]
    assert found(box[:3]) == []


def test_ruled_texts_with_spans(spark):
    """Two tables on a page, the first with a head over two columns; words in two lines of one cell."""
    e = lambda *x: ("d", 7, *map(float, x))
    edges = [e(0, 200, 0, 0), e(0, 200, 20, 20), e(0, 200, 60, 60), e(0, 0, 0, 60), e(200, 200, 0, 60), e(100, 100, 20, 60)]
    edges += [e(300, 400, 100, 100), e(300, 400, 120, 120), e(300, 300, 100, 120), e(400, 400, 100, 120), e(350, 350, 100, 120)]
    edges += [e(300, 400, 300, 320)]  # a lone box is no table
    w = lambda text, x, y: ("d", 7, text, float(x), float(x + 10), float(y), float(y + 8))
    words = [w("2026", 95, 6), w("Total", 10, 25), w("assets", 25, 25), w("(note", 10, 40), w("2)", 30, 41), w("1,234", 150, 30), w("left", 310, 105), w("outside", 500, 500)]
    cells = T.ruled_cells(spark.createDataFrame(edges, EDGE), spark.createDataFrame(words, WORD)).collect()
    got = {(c.table_id, c.row_index, c.column_index, c.rowspan, c.colspan): c.raw_text for c in cells}
    one, two = "P0007_RULED_01", "P0007_RULED_02"
    assert got == {(one, 0, 0, 1, 2): "2026", (one, 1, 0, 1, 1): "Total assets\n(note 2)", (one, 1, 1, 1, 1): "1,234", (two, 0, 0, 1, 1): "left", (two, 0, 1, 1, 1): ""}
    pages = spark.createDataFrame([("d", 7), ("d", 8)], "doc_id string, source_page int")
    checks = {r.source_page: (r.Status, r.Detail) for r in T.audit(pages, T.ruled_cells(spark.createDataFrame(edges, EDGE), spark.createDataFrame(words, WORD)), "Ruled").collect()}
    assert checks == {7: ("PASS", "Detected 2 table(s)."), 8: ("NO_TABLE_FOUND", "No table structure detected.")}


def test_tables_of_captured_pages(spark):
    box = lambda x0, x1, top, bottom: {"x0": float(x0), "x1": float(x1), "top": float(top), "bottom": float(bottom)}
    edges = [box(0, 200, y, y) for y in (0, 20, 40)] + [box(x, x, 0, 40) for x in (0, 100, 200)]
    words = [{"text": t} | box(x, x + 20, y, y + 8) for t, x, y in (("Cash", 10, 6), ("5", 110, 6), ("Debt", 10, 26), ("7", 110, 26))]
    rows = [("d", 1, 300.0, 100.0, "Cash 5\nDebt 7", 0, 0, words, None, None, edges), ("d", 2, 300.0, 100.0, "", 0, 0, None, None, None, None)]
    found = api.page_tables(spark.createDataFrame(rows, snapshots.PAGE))
    texts = {(c.flavor, c.row_index, c.column_index): c.raw_text for c in found.cells.collect()}
    assert texts == {(f, r, c): t for f in ("ruled", "spaced") for (r, c), t in {(0, 0): "Cash", (0, 1): "5", (1, 0): "Debt", (1, 1): "7"}.items()}
    assert {(m.source_page, m.flavor): m.recall for m in found.metrics.collect()} == {(1, "ruled"): 1.0, (1, "spaced"): 1.0, (2, "ruled"): None, (2, "spaced"): None}
    assert {(c.source_page, c.Check, c.Status) for c in found.checks.collect()} == {(p, f"{f} table extraction", s) for f in ("Ruled", "Spaced") for p, s in ((1, "PASS"), (2, "NO_TABLE_FOUND"))}
    lines = spark.createDataFrame([], "doc_id string")
    result = api.Result(lines, lines, lines, lines, lines, lines)
    assert not api.is_page_result(result) and api.is_page_result(api.replace(result, plan=lines))


def test_rivers_by_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for page in range(12):
        for line in range(rng.randint(2, 9)):
            x = 0.0
            for k in range(rng.randint(2, 6)):
                x += rng.choice([1, 3, 8, 25]) if k else rng.randint(0, 30)
                wide = rng.randint(3, 30)
                rows.append(("d", page, f"w{line}_{k}", x, x + wide, line * 12.0 + rng.uniform(0, 2), line * 12.0 + 8))
                x += wide
    words = spark.createDataFrame(rows, WORD)
    own = T.blocks(words)
    got = {}
    for r in T.rivers(own, share=0.2).collect():
        got.setdefault((r.source_page, r.table_index), []).append((r.lo, r.hi))
    by_block = {}
    for r in own.collect():
        by_block.setdefault((r.source_page, r.table_index), []).append(r)
    want = {}
    for key, ws in by_block.items():
        n = len({w.line for w in ws})
        marks = sorted({x for w in ws for x in (w.x0, w.x1)})
        low = [len({w.line for w in ws if w.x0 <= a and w.x1 >= b}) <= 0.2 * n for a, b in zip(marks, marks[1:], strict=False)]
        runs, start = [], None
        for i, v in enumerate([*low, False]):
            if v and start is None:
                start = i
            if not v and start is not None:
                runs.append((marks[start], marks[i]))
                start = None
        if runs := [r for r in runs if r[1] - r[0] >= 4]:
            want[key] = runs
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 5


def test_spaced_tables_and_recall_by_method(spark):
    w = lambda text, x, y, wide=20: ("d", 1, text, float(x), float(x + wide), float(y), float(y + 8))
    words = [w("Statement", 10, 0), w("of", 31, 0, 8), w("cash", 40, 0), w("Net", 10, 20), w("income", 32, 20), w("1,200", 100, 20), w("900", 160, 20), w("Capital", 10, 32), w("(35)", 102, 32), w("(40)", 162, 32), w("Page", 10, 60), w("7", 31, 60)]
    cells = T.spaced_cells(spark.createDataFrame(words, WORD))
    got = {(c.table_id, c.row_index, c.column_index): (c.raw_text, c.x0, c.x1) for c in cells.collect()}
    one = "P0001_SPACED_01"
    assert got == {(one, 0, 0): ("Net income", 10, 52), (one, 0, 1): ("1,200", 100, 120), (one, 0, 2): ("900", 160, 180), (one, 1, 0): ("Capital", 10, 30), (one, 1, 1): ("(35)", 102, 122), (one, 1, 2): ("(40)", 162, 182)}
    lines = spark.createDataFrame([("d", 1, "Net income 1,200 900"), ("d", 1, "Capital (35) (40)"), ("d", 1, "Page 7"), ("d", 2, "no number")], "doc_id string, source_page int, raw_text string")
    metrics = {(r.source_page, r.flavor): (r.tables, r.rows, r.reference_tokens, r.matched_tokens, r.recall) for r in T.method_metrics(lines, cells, lines).collect()}
    assert metrics == {(1, "spaced"): (1, 2, 5, 4, 0.8), (1, "ruled"): (0, 0, 5, 0, 0.0), (2, "spaced"): (0, 0, 0, 0, None), (2, "ruled"): (0, 0, 0, 0, None)}


def test_pages_of_nothing(spark):
    edges, words = spark.createDataFrame([], EDGE), spark.createDataFrame([], WORD)
    assert T.ruled_cells(edges, words).count() == 0 and T.spaced_cells(words).count() == 0


def test_pages_are_dealt_once_and_not_joined(spark):
    edges, words = spark.createDataFrame([("d", 1, 0.0, 9.0, 0.0, 0.0)], EDGE), spark.createDataFrame([("d", 1, "w", 0.0, 9.0, 0.0, 8.0)], WORD)
    plan = lambda found: found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    ruled, spaced = plan(T.ruled_cells(edges, words)), plan(T.spaced_cells(words))
    assert "Join" not in ruled + spaced
    assert ruled.count("Exchange hashpartitioning") <= 4 and spaced.count("Exchange hashpartitioning") <= 4
