"""Pages as flat arrays: what a batch of pages gives is what each page gives, whatever stands beside it, and queries over pages sort their rows once."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from __spark_entry__ import queries
from ledgerflow.operators import geometry, grids
from ledgerflow.operators import page_arrays as A
from ledgerflow.operators import tables as T

WORD = "doc_id string, source_page int, text string, x0 double, x1 double, top double, bottom double"


@pytest.mark.parametrize("name", ["ruled_tables", "table_methods"])
def test_pages_are_sorted_once(spark, name):
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1


def test_lines_are_those_of_words(spark):
    rng = random.Random(3)
    rows = [(f"d{p % 3}", p, f"w{i}", 0.0, 1.0, rng.choice([None, rng.randint(0, 60) * 0.7]), 9.0) for p in range(20) for i in range(rng.randint(0, 40))]
    words = spark.createDataFrame(rows, WORD)
    want = {(r.page, r.text): r.line for r in grids.lines_of_words(words.withColumnRenamed("source_page", "page")).collect()}
    pages = T.pages_of(words=words).toArrow()
    column, page = pages.column("words").combine_chunks(), pages.column("source_page").to_pylist()
    own = A.lines(A.rows_of(column), T.LINE)
    texts = [w["text"] for w in column.flatten().to_pylist()]
    assert {(page[p], texts[t]): n for p, t, n in zip(own["page"], own["text"], own["line"], strict=True)} == want


def test_words_are_in_the_cells_that_hold_them(monkeypatch):
    rng = np.random.default_rng(4)
    n, m = 60, 300
    x0, top = rng.integers(0, 8, n) * 10.0, rng.integers(0, 8, n) * 10.0
    cells = {"page": np.sort(rng.integers(0, 5, n)), "x0": x0, "x1": x0 + rng.integers(1, 4, n) * 10, "top": top, "bottom": top + rng.integers(1, 4, n) * 10}
    x, y = rng.integers(0, 100, m) * 1.0, rng.integers(0, 100, m) * 1.0
    words = {"page": np.sort(rng.integers(0, 5, m)), "text": np.arange(m), "x0": x - 2, "x1": x + 2, "top": y - 4, "bottom": y + 4, "line": (y // 9).astype(int)}
    texts = pa.array([None if i % 17 == 0 else f"t{i}" for i in range(m)])

    def brute(c):
        held = [i for i in range(m) if words["page"][i] == cells["page"][c] and cells["x0"][c] <= x[i] < cells["x1"][c] and cells["top"][c] <= y[i] < cells["bottom"][c]]
        lines = sorted({words["line"][i] for i in held})
        own = lambda line: sorted((x[i], texts[i].as_py() or "", i) for i in held if words["line"][i] == line)
        return "\n".join(" ".join(texts[i].as_py() for *_, i in own(line) if i % 17) for line in lines)

    want = [brute(c) for c in range(n)]
    assert A.texts_of(cells, words, texts).to_pylist() == want
    monkeypatch.setattr(A, "PAIRS", 7)
    assert A.texts_of(cells, words, texts).to_pylist() == want


def test_a_long_chain_of_cells_is_one_table():
    n = 1000
    order = np.random.default_rng(5).permutation(n)
    lo = order * 10.0
    cells = {"page": np.zeros(n, np.int64), "x0": lo, "x1": lo + 10, "top": lo, "bottom": lo + 10}
    own = A.placed_cells(cells, 2)
    assert own["table_index"].tolist() == [1] * n and own["row_index"].tolist() == own["column_index"].tolist() == list(range(n))


def test_numbers_that_are_missing_or_too_many(spark):
    lines = spark.createDataFrame([("d", 1, "a 1 2 2"), ("d", 2, "none"), ("d", 3, "9")], "doc_id string, source_page int, raw_text string")
    cells = spark.createDataFrame([("d", 1, "ruled", "t", 0, "2 5"), ("d", 1, "ruled", "u", 0, None), ("d", 1, "other", "v", 0, "7"), ("d", 8, "ruled", "t", 0, "4")], "doc_id string, source_page int, flavor string, table_id string, row_index int, raw_text string")
    got = {(r.source_page, r.flavor): (r.missing_tokens, r.extra_tokens, r.matched_tokens, r.recall, r.tables, r.rows) for r in T.method_metrics(lines, cells, lines).collect()}
    assert got == {
        (1, "ruled"): ({"1": 1, "2": 1}, {"5": 1}, 1, pytest.approx(1 / 3), 2, 2), (1, "spaced"): ({"1": 1, "2": 2}, {}, 0, 0.0, 0, 0),
        (2, "ruled"): (None, None, 0, None, 0, 0), (2, "spaced"): (None, None, 0, None, 0, 0),
        (3, "ruled"): ({"9": 1}, {}, 0, 0.0, 0, 0), (3, "spaced"): ({"9": 1}, {}, 0, 0.0, 0, 0),
    }


def test_a_balance_page_stays_one_row(spark):
    plan = queries()["balance_page_grids"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ExistingRDD" not in plan and plan.count("Exchange") == 1


def test_a_word_that_is_printed_twice_has_no_single_column(spark):
    at = lambda text, x0, top: (text, float(x0), x0 + 20.0, float(top), top + 8.0)
    heads = [at("June", 200, 80), at("30,", 221, 80), at("2026", 242, 80)]
    body = [at("Assets", 0, 100), at("Cash", 0, 112), at("10", 230, 112), at("Debt", 0, 124), at("7", 230, 124)]
    boxes = [[[0.0, 95.0, 180.0, 99.0], [200.0, 95.0, 280.0, 99.0]], *[[[0.0, y - 1.0, 180.0, y + 10.0], [200.0, y - 1.0, 280.0, y + 10.0]] for y in (100, 112, 124)]]
    said = lambda cash: [["", ""], ["Assets", ""], ["Cash", cash], ["Debt", "7"]]
    text = "Balance Sheets\nAssets\nCash 10\nDebt 7\nSee notes"
    page = lambda doc, words, cash: (doc, 1, "BalanceSheet", 300.0, text, words, None, [([0.0, 95.0, 280.0, 140.0], boxes, said(cash))])
    schema = "doc_id string, page int, statement_type string, width double, text string, words array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>, edges array<struct<x0:double,x1:double,top:double,bottom:double>>, tables array<struct<bbox:array<double>,rows:array<array<array<double>>>,extracted:array<array<string>>>>"
    pages = spark.createDataFrame([page("once", heads + body, "10"), page("twice", [*heads, *body, body[2]], "10 10"), page("said", [*heads, *body, body[2]], "10"), page("none", None, "10")], schema)
    got = {r.doc_id: (r.rows, r.error) for r in geometry.balance_grids(pages).collect()}
    assert got["once"] == ([["Assets", ""], ["Cash", "10"], ["Debt", "7"]], None)
    assert {k: e for k, (_, e) in got.items() if e} == {"twice": geometry.BALANCE_UNCLEAR["crossing"], "said": geometry.BALANCE_UNCLEAR["cells"], "none": geometry.BALANCE_UNCLEAR["dates"]}
