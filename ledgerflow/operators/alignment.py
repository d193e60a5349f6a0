"""Sequences of rows aligned: what both begin and end with, rows that stand once on either side, and between these the fewest edits."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.staging import cut

#: How often anchors are looked for: within what lies between anchors, further rows stand only once.
ROUNDS = 2
_RUN = "array<struct<b:int,a:int,n:int>>"


def common_runs(before: Sequence, after: Sequence) -> list[tuple[int, int, int]]:
    """A longest common subsequence as runs (place before, place after, length), by the middle of the shortest edit path, in memory of the sequences' size and
    time of their size by their differences."""
    found, boxes = [], [(0, len(before), 0, len(after))]
    while boxes:
        b0, b1, a0, a1 = boxes.pop()
        n = 0
        while b0 + n < b1 and a0 + n < a1 and before[b0 + n] == after[a0 + n]:
            n += 1
        if n:
            found.append((b0, a0, n))
            b0, a0 = b0 + n, a0 + n
        n = 0
        while b0 < b1 - n and a0 < a1 - n and before[b1 - n - 1] == after[a1 - n - 1]:
            n += 1
        if n:
            b1, a1 = b1 - n, a1 - n
            found.append((b1, a1, n))
        if b0 < b1 and a0 < a1:
            x0, y0, x1, y1 = _middle(before, after, b0, b1, a0, a1)
            if x1 > x0:
                found.append((b0 + x0, a0 + y0, x1 - x0))
            boxes += [(b0, b0 + x0, a0, a0 + y0), (b0 + x1, b1, a0 + y1, a1)]
    return sorted(found)


def _middle(before: Sequence, after: Sequence, b0: int, b1: int, a0: int, a1: int) -> tuple[int, int, int, int]:
    """The stretch of equal rows (perhaps none) at which paths from both ends of the box meet: its begin and end, counted from the box's begin.

    ahead[k] and back[k] are how far paths of d edits get on diagonal k, from the begin and from the end."""
    n, m = b1 - b0, a1 - a0
    delta, ahead, back = n - m, {1: 0}, {1: 0}

    def farthest(reached: dict, k: int, d: int) -> int:
        return reached[k + 1] if k == -d or (k != d and reached[k - 1] < reached[k + 1]) else reached[k - 1] + 1

    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = begin = farthest(ahead, k, d)
            while x < n and x - k < m and before[b0 + x] == after[a0 + x - k]:
                x += 1
            ahead[k] = x
            if delta & 1 and abs(delta - k) < d and x + back[delta - k] >= n:
                return begin, begin - k, x, x - k
        for k in range(-d, d + 1, 2):
            x = begin = farthest(back, k, d)
            while x < n and x - k < m and before[b1 - 1 - x] == after[a1 - 1 - x + k]:
                x += 1
            back[k] = x
            if not delta & 1 and abs(delta - k) <= d and x + ahead[delta - k] >= n:
                return n - x, m - x + k, n - begin, m - begin + k
    raise AssertionError("paths from both ends meet")


def heaviest_chain(runs: Sequence[tuple[int, int, int]]) -> list[int]:
    """Of runs (b, a, n) in ascending order of b: the places of those that ascend in a too and have the most rows together."""
    order = sorted(r[1] for r in runs)
    best: list[tuple[int, int]] = [(0, -1)] * (len(runs) + 1)  # by place of a, a tree of maxima
    total, came_from = [0] * len(runs), [-1] * len(runs)
    for i, (_, a, n) in enumerate(runs):
        at = place = bisect_left(order, a)
        top = (0, -1)
        while at:
            top = max(top, best[at], key=lambda x: x[0])
            at -= at & -at
        total[i], came_from[i] = top[0] + n, top[1]
        at = place + 1
        while at <= len(runs):
            if best[at][0] < total[i]:
                best[at] = (total[i], i)
            at += at & -at
    i, chain = max(range(len(runs)), key=total.__getitem__, default=-1), []
    while i >= 0:
        chain.append(i)
        i = came_from[i]
    return chain[::-1]


def _numbered(rows: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    own = rows.select(F.struct(*keys).alias("k"), F.col(order).alias("_order"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("text"))
    place = lambda *by: (F.row_number().over(Window.partitionBy("k").orderBy(*by)) - 1).cast("int")
    return own.select("k", "text", place("_order", "text").alias("pos"), place(F.desc("_order"), F.desc("text")).alias("end"))


def _same_ends(left: DataFrame, right: DataFrame) -> DataFrame:
    """k, nl, nr (rows on either side), prefix and suffix (rows that both begin and end with; a row is never in both)."""
    sizes = left.groupBy("k").agg(F.count("*").alias("nl")).join(right.groupBy("k").agg(F.count("*").alias("nr")), "k", "full_outer").na.fill(0, ["nl", "nr"])

    def first_other(at: str) -> DataFrame:
        both = left.select("k", at, F.col("text").alias("b")).join(right.select("k", at, F.col("text").alias("a")), ["k", at], "full_outer")
        return both.filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy("k").agg(F.min(at).alias(f"_{at}"))

    least = F.least("nl", "nr")
    ends = sizes.join(first_other("pos"), "k", "left").join(first_other("end"), "k", "left").withColumn("prefix", F.coalesce("_pos", least))
    return ends.select("k", *[F.col(c).cast("int") for c in ("nl", "nr", "prefix")], F.least(F.coalesce("_end", least), least - F.col("prefix")).cast("int").alias("suffix"))


def _anchors(left: DataFrame, right: DataFrame) -> DataFrame:
    """k, b, a, n: runs of rows whose text stands once on either side, without those that would cross others."""
    once = lambda rows, name: rows.groupBy("k", "text").agg(F.count("*").alias("_n"), F.min("pos").alias(name)).filter("_n = 1").drop("_n")
    pairs = once(left, "b").join(once(right, "a"), ["k", "text"])
    runs = _runs(pairs.select("k", "b", "a", F.lit(1).alias("n")))
    order = Window.partitionBy("k").orderBy("b")
    back = F.coalesce(F.lag("a").over(order) > F.col("a"), F.lit(False))
    marked = runs.withColumn("_back", back).withColumn("_crossed", F.max("_back").over(Window.partitionBy("k")))

    def chain(found: pd.Series) -> pd.Series:
        out = []
        for runs in found:
            own = [(r["b"], r["a"], r["n"]) for r in runs]
            out.append([own[i] for i in heaviest_chain(own)])
        return pd.Series(out)

    lists = marked.filter("_crossed").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("b", "a", "n"))).alias("_runs"))
    kept = lists.select("k", F.explode(F.pandas_udf(chain, _RUN)("_runs")).alias("r")).select("k", "r.*")
    return marked.filter("NOT _crossed").select("k", "b", "a", "n").unionByName(kept)


def _runs(runs: DataFrame) -> DataFrame:
    """Runs that follow each other on both sides as one."""
    order = Window.partitionBy("k").orderBy("b")
    goes_on = (F.lag(F.col("b") + F.col("n")).over(order) == F.col("b")) & (F.lag(F.col("a") + F.col("n")).over(order) == F.col("a"))
    marked = runs.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    return marked.groupBy("k", "_run").agg(F.min("b").alias("b"), F.min("a").alias("a"), F.sum("n").cast("int").alias("n")).drop("_run")


def _between(rows: DataFrame, runs: DataFrame, side: str) -> DataFrame:
    """Rows outside the runs; their key is joined by the number of runs before them."""
    marks = runs.select("k", F.lit(None).cast("string").alias("text"), F.col(side).alias("pos"), (F.col(side) + F.col("n")).alias("_to"))
    both = rows.select("k", "text", "pos", F.lit(None).cast("int").alias("_to")).unionByName(marks)
    so_far = Window.partitionBy("k").orderBy("pos", F.col("_to").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumns({"_gap": F.count("_to").over(so_far), "_end": F.last("_to", ignorenulls=True).over(so_far)})
    return placed.filter(F.col("_to").isNull() & F.coalesce(F.col("pos") >= F.col("_end"), F.lit(True))).select(F.struct("k", "_gap").alias("k"), "text", "pos")


def _shared(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose text the other side has too between the same anchors: no other row can be equal to one there."""
    return rows.join(other.select("k", "text").distinct(), ["k", "text"], "left_semi")


def _edited(left: DataFrame, right: DataFrame) -> DataFrame:
    """k, b, a, n: common runs between anchors. State: the rows between two anchors that both sides have."""
    rows = lambda own, name: own.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias(name))
    pairs = rows(_shared(left, right), "l").join(rows(_shared(right, left), "r"), "k")
    part = lambda name, field: F.transform(name, lambda x: x[field])

    def common(l_at: pd.Series, l_text: pd.Series, r_at: pd.Series, r_text: pd.Series) -> pd.Series:
        out = []
        for at, texts, other_at, others in zip(l_at, l_text, r_at, r_text, strict=True):
            found = common_runs(list(texts), list(others))
            out.append([(int(at[b + i]), int(other_at[a + i]), 1) for b, a, n in found for i in range(n)])
        return pd.Series(out)

    made = F.pandas_udf(common, _RUN)(part("l", "pos"), part("l", "text"), part("r", "pos"), part("r", "text"))
    return pairs.select("k", F.explode(made).alias("r")).select("k", "r.*")


def equal_runs(left: DataFrame, right: DataFrame, ends: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """k, b, a, n: the stretches of both sides that are equal and stay."""
    run = lambda b, a, n: F.struct(b.cast("int").alias("b"), a.cast("int").alias("a"), n.cast("int").alias("n"))
    zero, suffix = F.lit(0), F.col("suffix")
    whole = F.array(run(zero, zero, F.col("prefix")), run(F.col("nl") - suffix, F.col("nr") - suffix, suffix))
    found = [ends.select("k", F.explode(whole).alias("r")).select("k", "r.*").filter("n > 0")]
    middle = lambda rows: cut(rows.join(ends, "k").filter((F.col("pos") >= F.col("prefix")) & (F.col("end") >= suffix)).select("k", "text", "pos"))
    l, r = middle(left), middle(right)  # noqa: E741
    for depth in range(rounds):
        runs = cut(_anchors(l, r))
        found.append(runs.select(F.col("k" + ".k" * depth).alias("k"), "b", "a", "n"))
        l, r = cut(_between(l, runs, "b")), cut(_between(r, runs, "a"))  # noqa: E741
    found.append(_edited(l, r).select(F.col("k" + ".k" * rounds).alias("k"), "b", "a", "n"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return _runs(every)


def _step(op: Column, b0: Column, b1: Column, a0: Column, a1: Column) -> Column:
    return F.struct(op.alias("op"), b0.alias("before_from"), b1.alias("before_to"), a0.alias("after_from"), a1.alias("after_to"))


def aligned(before: DataFrame, after: DataFrame, keys: list[str], order: str = "row", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """keys, op (equal, replace, delete, insert), before_from, before_to, after_from, after_to: the edit script of two label sequences by key.

    What both begin and end with is told by joins on the place, so equal sequences end there. Then rows whose label stands once on either side are anchors,
    those of the heaviest chain without crossings; between anchors the same is done again, `rounds` times in all; and what is left between anchors gets the
    script of fewest edits. Where labels stand once, the script is one of fewest edits as a whole. Null labels are empty ones; null keys are a key; of rows
    with equal order the label decides.

    Sequences are never gathered: joins and windows over keys and places; the places of a key's anchors where they cross, and the rows between two anchors
    that both sides have, are in one task.
    """
    left, right = _numbered(before, keys, order, label), _numbered(after, keys, order, label)
    ends = cut(_same_ends(left, right))
    runs = equal_runs(left, right, ends, rounds).unionByName(ends.select("k", F.col("nl").alias("b"), F.col("nr").alias("a"), F.lit(0).alias("n")))
    order_ = Window.partitionBy("k").orderBy("b", "a", F.desc("n"))
    done = runs.withColumns({"_b": F.coalesce(F.lag(F.col("b") + F.col("n")).over(order_), F.lit(0)), "_a": F.coalesce(F.lag(F.col("a") + F.col("n")).over(order_), F.lit(0))})
    gone, come = F.col("b") > F.col("_b"), F.col("a") > F.col("_a")
    op = F.when(gone & come, "replace").when(gone, "delete").when(come, "insert")
    b, a, n = F.col("b"), F.col("a"), F.col("n")
    steps = F.array(F.when(op.isNotNull(), _step(op, F.col("_b"), b, F.col("_a"), a)), F.when(n > 0, _step(F.lit("equal"), b, b + n, a, a + n)))
    return done.select("k.*", F.explode(F.array_compact(steps)).alias("s")).select(*keys, "s.*")


def applied(before: DataFrame, after: DataFrame, script: DataFrame, keys: list[str], order: str = "row", label: str = "label") -> DataFrame:
    """keys, pos, label: what the script makes of `before`, taking from `after` only what it replaces or inserts."""
    struct = lambda rows: rows.select(F.struct(*keys).alias("k"), *[c for c in rows.columns if c not in keys])
    steps = struct(script)
    kept = steps.filter("op = 'equal'").select("k", F.explode(F.expr("sequence(before_from, before_to - 1)")).alias("pos"), F.expr("after_from - before_from").alias("_by"))
    new = steps.filter("op IN ('replace', 'insert')").select("k", F.explode(F.expr("sequence(after_from, after_to - 1)")).alias("pos"))
    numbered = lambda rows: _numbered(rows, keys, order, label).select("k", "pos", "text")
    from_before = numbered(before).join(kept, ["k", "pos"]).select("k", (F.col("pos") + F.col("_by")).alias("pos"), "text")
    made = from_before.unionByName(numbered(after).join(new, ["k", "pos"]).select("k", "pos", "text"))
    return made.select("k.*", "pos", F.col("text").alias(label))
