from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerflow.operators import alignment as A

ROWS = "k int, row int, label string"


def longest(x, y):
    """The length of a longest common subsequence, by the whole table."""
    best = [0] * (len(y) + 1)
    for a in x:
        before = best[:]
        for j, b in enumerate(y, 1):
            best[j] = before[j - 1] + 1 if a == b else max(best[j - 1], before[j])
    return best[-1]


@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
@settings(max_examples=1500, deadline=None)
def test_common_runs_are_longest(x, y):
    runs = A.common_runs(x, y)
    assert all(x[b : b + n] == y[a : a + n] and n > 0 for b, a, n in runs)
    assert all(b1 + n1 <= b2 and a1 + n1 <= a2 for (b1, a1, n1), (b2, a2, _) in zip(runs, runs[1:], strict=False))
    assert sum(n for *_, n in runs) == longest(x, y)


def test_common_runs_of_long_sequences_take_time_of_their_differences():
    x = [i % 1000 for i in range(200_000)]
    y = x[:50_000] + [-1] * 30 + x[50_010:]
    assert sum(n for *_, n in A.common_runs(x, y)) == 199_990


@given(st.permutations(range(9)), st.lists(st.integers(1, 5), min_size=9, max_size=9))
@settings(max_examples=300, deadline=None)
def test_the_heaviest_chain_by_all_subsets(places, sizes):
    runs = [(i, p, n) for i, (p, n) in enumerate(zip(places, sizes, strict=True))]
    chain = A.heaviest_chain(runs)
    assert all(runs[i][1] < runs[j][1] for i, j in zip(chain, chain[1:], strict=False))
    best = [0] * 9
    for i in range(9):
        best[i] = runs[i][2] + max((best[j] for j in range(i) if runs[j][1] < runs[i][1]), default=0)
    assert sum(runs[i][2] for i in chain) == max(best)


def check_script(x, y, script, least=None):
    """It goes through both sides without a hole, equal parts are equal, and it is as short as may be asked."""
    at_b = at_a = equal = 0
    for op, b0, b1, a0, a1 in sorted(script, key=lambda s: (s[1], s[3], s[2], s[4])):
        assert (b0, a0) == (at_b, at_a)
        assert {"equal": b1 > b0 and x[b0:b1] == y[a0:a1], "replace": b1 > b0 and a1 > a0, "delete": b1 > b0 and a1 == a0, "insert": b1 == b0 and a1 > a0}[op]
        equal += (b1 - b0) * (op == "equal")
        at_b, at_a = b1, a1
    assert (at_b, at_a) == (len(x), len(y))
    assert least is None or equal == least
    return equal


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_scripts(spark, rounds):
    rng = random.Random(rounds)
    pairs = {}
    for k in range(40):
        x = [rng.choice("abcdefgh") + str(rng.randint(0, 9)) * (k % 3) for _ in range(rng.randint(0, 30))]
        y = [v for v in x if rng.random() < 0.85] if k % 4 else [rng.choice("abcd") for _ in range(12)]
        for _ in range(rng.randint(0, 4)):
            y.insert(rng.randint(0, len(y)), rng.choice(["new", "a", "b1"]))
        pairs[k] = (x, y)
    pairs |= {100: (["a"] * 9, ["a"] * 5), 101: ([], ["a", "b"]), 102: (["a", "b"], []), 103: (["x", "y"], ["x", "y"]), 104: (["a", None, "b"], ["a", "b", None])}
    frame = lambda side: spark.createDataFrame([(k, i, v) for k, p in pairs.items() for i, v in enumerate(p[side])], ROWS)
    scripts = {}
    for r in A.aligned(frame(0), frame(1), ["k"], rounds=rounds).collect():
        scripts.setdefault(r["k"], []).append((r["op"], r["before_from"], r["before_to"], r["after_from"], r["after_to"]))
    plain = lambda side: [v or "" for v in side]
    for k, (x, y) in pairs.items():
        x, y = plain(x), plain(y)
        check_script(x, y, scripts.get(k, []), longest(x, y) if rounds == 0 else None)
    made = {}
    for r in A.applied(frame(0), frame(1), A.aligned(frame(0), frame(1), ["k"], rounds=rounds), ["k"]).collect():
        made.setdefault(r["k"], {})[r["pos"]] = r["label"]
    assert {k: [v[i] for i in range(len(v))] for k, v in made.items()} == {k: plain(p[1]) for k, p in pairs.items() if p[1]}


def test_labels_that_stand_once_have_the_fewest_edits(spark):
    rng = random.Random(8)
    pairs = {}
    for k in range(20):
        x = [f"r{i}" for i in range(40)]
        y = [v for v in x if rng.random() < 0.8]
        for _ in range(3):  # moved rows: only some can stay
            y.insert(rng.randint(0, len(y)), y.pop(rng.randrange(len(y))))
        pairs[k] = (x, y + [f"n{i}" for i in range(k % 3)])
    frame = lambda side: spark.createDataFrame([(k, i, v) for k, p in pairs.items() for i, v in enumerate(p[side])], ROWS)
    equal = {}
    for r in A.aligned(frame(0), frame(1), ["k"]).collect():
        equal[r["k"]] = equal.get(r["k"], 0) + (r["before_to"] - r["before_from"]) * (r["op"] == "equal")
    assert equal == {k: longest(x, y) for k, (x, y) in pairs.items()}


def test_null_keys_and_no_rows(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    got = A.aligned(frame((None, 1, "a"), (None, 2, "b")), frame((None, 5, "a")), ["k"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "equal", 0, 1, 0, 1), (None, "delete", 1, 2, 1, 1)], key=str)
    assert A.aligned(frame().limit(0), frame().limit(0), ["k"]).count() == 0
