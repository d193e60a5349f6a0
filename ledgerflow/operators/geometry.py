"""Statement grids from the geometry of pages: columns are intervals, words go to them by interval joins, and the result is held against the page's text.

A page whose layout its source doesn't prove has one row with the first thing that is unclear; other pages are as they would be without it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions import lines as L
from ledgerflow.functions.fixed_values import CURRENCIES, DASHES, NOT_AVAILABLE, NOT_MEANINGFUL, PAGE_PATTERNS
from ledgerflow.functions.text import DATE
from ledgerflow.functions.tokens import SINGLE
from ledgerflow.operators.grids import lines_of_words
from ledgerflow.operators.tables import lined
from ledgerflow.staging import cut

# Points that results depend on. Width of a column at least, share of the page that its label column takes at least, and how far above a table
# the heads of a balance sheet and of an equity statement begin; how far rules and cells may be off.
WIDE, LABEL_SHARE, HEAD, EQUITY_HEAD, OFF, EDGES_OFF = 15.0, 0.25, 35.0, 60.0, 1.0, 2.0
# Lines that end a body, captions of periods, first labels of rollforwards.
NOTES = r"(?i)^See (?:accompanying )?Notes\b"
EQUITY_END = r"(?i)^(?:see (?:accompanying )?notes|the accompanying notes)"
PERIOD = r"(?i)^(?:\d+|three|six|nine|twelve)\s+(?:months?|years?)\s+ended\s+.+\b(?:19|20)\d{2}:?$"
BALANCE, TOTAL = r"(?i)^Balance (?:at|as of)\b", r"(?i)^Total .*? for the (.+)$"

K = ["doc_id", "page"]
GRIDS = "doc_id string, table_id string, source_page int, statement_type string, flavor string, rows array<array<string>>, row_kinds array<string>, labels array<string>, notes array<string>, source_note string, sections array<struct<start:int,end:int,caption:string>>, error string"
_RESULT = ["rows", "row_kinds", "labels", "notes", "source_note", "sections", "error"]

BALANCE_UNCLEAR = {
    "table": "There is no single complete body.",
    "columns": "Rows of one cell need distinct dated columns that don't overlap.",
    "dates": "A column has no single date, or two have the same.",
    "cells": "A cell crosses columns or disagrees with its words.",
    "crossing": "A word crosses columns.",
    "rows": "A row lacks a label or an amount, or has more than one in a column.",
    "bounds": "The balance sheet's body has no unique beginning and end.",
    "body": "Recovered rows aren't the whole body.",
}
EQUITY_UNCLEAR = {
    "columns": "There are no component columns.",
    "disagree": "Tables disagree about columns.",
    "data": "There are no data rows, or too few.",
    "heads": "Heads are missing, equal, overlap or cross columns.",
    "rows": "A row has no label or ambiguous amounts.",
    "text": "Rows aren't those of the text, in order.",
}


def is_amount(text: Column) -> Column:
    """One number, or one of the signs for none."""
    plain = F.trim(text)
    bare = F.trim(F.ltrim(F.regexp_replace(plain, f"^[{re.escape(CURRENCIES)}]+", "")))
    return plain.rlike(SINGLE) | F.lower(plain).isin(*DASHES, *NOT_AVAILABLE, *NOT_MEANINGFUL) | bare.isin(*DASHES)


def _joined(words: Column) -> Column:
    """The texts of words(line, x0, text), in reading order."""
    return F.array_join(F.transform(F.array_sort(words), lambda w: w["text"]), " ")


def _words() -> Column:
    """A group's words, for _joined()."""
    return F.collect_list(F.struct("line", "x0", "text"))


def _cells(pages: DataFrame) -> DataFrame:
    """The cells of candidate tables: t, r, c, x0, x1, y0, y1 (null where there is no box), value; and left, right, top of the table."""
    tables = pages.select(*K, "width", F.posexplode("tables").alias("t", "tab"))
    box = F.col("tab.bbox")
    rows = tables.select(*K, "width", "t", box[0].alias("left"), box[2].alias("right"), box[1].alias("top"), F.posexplode(F.arrays_zip(F.col("tab.rows").alias("boxes"), F.col("tab.extracted").alias("values"))).alias("r", "row"))
    cells = rows.select(*K, "width", "t", "left", "right", "top", "r", F.posexplode(F.arrays_zip(F.col("row.boxes").alias("box"), F.col("row.values").alias("value"))).alias("c", "cell"))
    sides = [F.col("cell.box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return cells.select(*K, "width", "t", "left", "right", "top", "r", "c", *sides, F.coalesce("cell.value", F.lit("")).alias("value"))


def _wide_rows(cells: DataFrame) -> DataFrame:
    """Each table row's wide cells as columns array<struct<lo, hi>>, where the first is wide enough for labels."""
    wide = cells.filter(F.col("x1") - F.col("x0") >= WIDE).groupBy(*K, "t", "r", "width", "left", "right", "top").agg(F.array_sort(F.collect_list(F.struct("c", F.col("x0").alias("lo"), F.col("x1").alias("hi")))).alias("_cells"))
    columns = F.transform("_cells", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))
    return wide.withColumn("columns", columns).drop("_cells").filter(F.get("columns", F.lit(0))["hi"] - F.get("columns", F.lit(0))["lo"] >= LABEL_SHARE * F.col("width"))


def columns_of_rules(edges: DataFrame, off: float = EDGES_OFF, wide: float = WIDE) -> DataFrame:
    """doc_id, page, columns array<struct<lo, hi>>: columns that wide level rules(doc_id, page, x0, x1) alone establish.

    The rules' ends are islands over their sorted places, with a new one where the next end is more than `off` away; a column is what stands between the mean
    places of two neighbouring islands, if some rule begins at the left one and ends at the right one.
    """
    rules = edges.filter(F.col("x1") - F.col("x0") >= wide).select(*K, F.monotonically_increasing_id().alias("rule"), "x0", "x1")
    ends = rules.select(*K, "rule", F.explode(F.array(F.struct(F.lit("lo").alias("side"), F.col("x0").alias("x")), F.struct(F.lit("hi").alias("side"), F.col("x1").alias("x")))).alias("e")).select(*K, "rule", "e.*")
    order = Window.partitionBy(*K).orderBy("x", "rule", "side")
    islands = ends.withColumn("_new", F.coalesce((F.col("x") - F.lag("x").over(order) > off).cast("int"), F.lit(0))).withColumn("island", F.sum("_new").over(order))
    placed = islands.withColumn("at", F.avg("x").over(Window.partitionBy(*K, "island")))
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    sides = placed.groupBy(*K, "rule").agg(of("lo", "island").alias("lo"), of("hi", "island").alias("hi"), F.struct(of("lo", "at").alias("lo"), of("hi", "at").alias("hi")).alias("span"))
    return sides.filter("hi = lo + 1").groupBy(*K).agg(F.array_sort(F.collect_set("span")).alias("columns"))


def _tokens(text: Column) -> Column:
    return F.sort_array(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""))


def _first_of(problems: dict[str, str], flags: dict[str, Column]) -> Column:
    """The text of the first problem that is there, in the order of the table."""
    return F.get(F.array_compact(F.array(*[F.when(F.coalesce(flags[k], F.lit(True)), text) for k, text in problems.items()])), F.lit(0))


def _result(found: DataFrame, flavor: str) -> DataFrame:
    """One row for each page: what was found, or why it is unclear."""
    clear = lambda c: F.when(F.col("error").isNull(), F.col(c))
    name = F.format_string(f"P%04d_{flavor.upper()}", "page")
    columns = [clear(c).alias(c) if c != "error" else F.col(c) for c in _RESULT]
    table = F.when(F.col("error").isNull(), F.concat(name, F.lit("_01"))).otherwise(name)
    return found.select("doc_id", table.alias("table_id"), F.col("page").alias("source_page"), "statement_type", F.lit(flavor).alias("flavor"), *columns)


def _once(pages: DataFrame, **columns: Column) -> DataFrame:
    """pages with columns that are worked out once for each page: a plain projection is put into the lambda functions that use it, and worked out for each
    element."""
    return pages.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _places(values: Column, test: Callable[[Column], Column]) -> Column:
    """The places, from 0, of the values that pass."""
    return F.filter(F.transform(values, lambda v, i: F.when(test(v), i)), lambda i: i.isNotNull())


def _text(words: Column) -> Column:
    """The texts of words that stand in reading order."""
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def _candidates(tables: str) -> Column:
    """Candidate tables as array<struct<left, right, top, lines>>; a line is its cells as array<struct<x0, y0, x1, y1, value>>, null where there is no box."""
    cell = lambda c: F.struct(*[c["box"][i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.coalesce(c["value"], F.lit("")).alias("value"))
    cells = lambda row: F.transform(F.arrays_zip(row["boxes"].alias("box"), row["values"].alias("value")), cell)
    none = "array<struct<x0:double,y0:double,x1:double,y1:double,value:string>>"
    lines = lambda t: F.transform(F.arrays_zip(t["rows"].alias("boxes"), t["extracted"].alias("values")), lambda row: F.coalesce(cells(row), F.array().cast(none)))
    return F.transform(tables, lambda t: F.struct(t["bbox"][0].alias("left"), t["bbox"][2].alias("right"), t["bbox"][1].alias("top"), F.coalesce(lines(t), F.array().cast(f"array<{none}>")).alias("lines")))


def balance_grids(pages: DataFrame) -> DataFrame:
    """Balance sheets of pages(doc_id, page, statement_type, width, text, words, edges, tables), as GRIDS.

    The body is the one table whose first row has a wide label cell and others. Its columns are these cells; where rows are one cell across all dates, they
    are the rules under the dated heads instead. A row of the table is all words in its height: with an amount beyond the labels it is a data row, whose words
    go to the value column that holds them whole; without one it is a section, or notes on the columns where it says no more than (un)audited. Each column has
    one date above it. Each cell's words must be its text, and all rows together the body of the page's text. A page stays one row from beginning to end:
    nothing is shuffled, joined or kept on disk. State: one page.
    """
    text, x0, x1 = (lambda w: w["text"]), (lambda w: w["x0"]), (lambda w: w["x1"])
    word = lambda w: F.struct(w["line"].alias("line"), x0(w).alias("x0"), text(w).alias("text"), x1(w).alias("x1"), w["top"].alias("top"), ((x0(w) + x1(w)) / 2).alias("cx"), ((w["top"] + w["bottom"]) / 2).alias("cy"), is_amount(text(w)).alias("amount"), F.lower(text(w)).isin("(unaudited)", "(audited)").alias("audited"))
    first_cells = lambda t: F.transform(F.filter(F.get(t["lines"], F.lit(0)), lambda c: c["x1"] - c["x0"] >= WIDE), lambda c: F.struct(c["x0"].alias("lo"), c["x1"].alias("hi")))
    own = pages.select(*K, "statement_type", F.col("width").alias("page_width"), F.col("text").alias("page_text"), "edges", "tables", lined(F.col("words")).alias("_lined"))
    own = _once(own, words=F.sort_array(F.transform("_lined", word)), _tables=F.transform(_candidates("tables"), lambda t: F.struct(t.alias("t"), first_cells(t).alias("columns"))))
    wide = lambda t: (F.size(t["columns"]) >= 2) & (F.get(t["columns"], F.lit(0))["hi"] - F.get(t["columns"], F.lit(0))["lo"] >= LABEL_SHARE * F.col("page_width"))
    own = _once(own, _fits=F.filter("_tables", wide))
    own = _once(own, n_tables=F.size("_fits"), _one=F.when(F.size("_fits") == 1, F.get("_fits", F.lit(0))))
    left, right, table_top, columns, lines = F.col("_one.t.left"), F.col("_one.t.right"), F.col("_one.t.top"), F.col("_one.columns"), F.col("_one.t.lines")
    whole = lambda c: F.coalesce((c["x1"] - c["x0"] >= right - left - 1) & c["value"].rlike(r"\d"), F.lit(False))
    own = _once(own, across=F.coalesce(F.exists(F.flatten(lines), whole), F.lit(False)), above=F.filter("words", lambda w: (w["top"] >= table_top - HEAD) & (w["top"] < table_top)))

    # Value columns: the wide cells of the first row, or rules under dated heads.
    under = F.filter("edges", lambda e: (F.abs(e["top"] - table_top) <= OFF) & (F.abs(e["bottom"] - e["top"]) <= OFF) & (e["x1"] - e["x0"] >= WIDE))
    spans = F.array_sort(F.array_distinct(F.transform(under, lambda e: F.struct(F.round(e["x0"], 3).alias("lo"), F.round(e["x1"], 3).alias("hi")))))
    held = lambda s: F.filter("above", lambda w: (x0(w) >= s["lo"]) & (x1(w) <= s["hi"]))
    ruled = F.filter(spans, lambda s: (F.size(held(s)) > 0) & (F.regexp_replace(_text(held(s)), DATE, "") == ""))
    values = F.when(F.col("across"), ruled).otherwise(F.slice(columns, F.lit(2), F.size(columns)))
    own = _once(own, values=F.coalesce(values, F.array().cast("array<struct<lo:double,hi:double>>")))
    apart = ~F.exists(F.sequence(F.lit(1), F.size("values") - 1), lambda i: F.get("values", i - 1)["hi"] > F.get("values", i)["lo"])
    label_end, n = F.get("values", F.lit(0))["lo"], F.size("values")
    fine = F.when(F.col("across"), (n >= 2) & apart & (label_end - left >= LABEL_SHARE * F.col("page_width"))).otherwise(True)
    dates = F.transform("values", lambda v: F.regexp_extract_all(_text(F.filter("above", lambda w: w["cx"].between(v["lo"], v["hi"]))), F.lit(f"({DATE})"), 1))
    own = _once(own, fine=F.coalesce(fine, F.lit(False)) & F.col("_one").isNotNull(), dates=dates)

    # Rows: the words in each line's height, and its cells' own texts with the columns that they are in.
    side = lambda cells, c: F.transform(F.filter(cells, lambda x: x["y0"].isNotNull()), lambda x: x[c])
    owners = lambda c: F.when(F.col("across"), F.array(F.lit(0))).otherwise(_places(columns, lambda x: (c["x0"] >= x["lo"] - OFF) & (c["x1"] <= x["hi"] + OFF)))
    said = lambda cells: F.transform(F.filter(cells, lambda c: F.trim(c["value"]) != ""), lambda c: F.struct(_tokens(c["value"]).alias("tokens"), c["x0"].isNull().alias("loose"), owners(c).alias("owners")))
    line = lambda cells: F.struct(F.array_min(side(cells, "y0")).alias("top"), F.array_max(side(cells, "y1")).alias("bottom"), said(cells).alias("said"))
    own = _once(own, _lines=F.transform(F.when(F.col("fine"), lines), line))
    yes = lambda test: F.coalesce(test, F.lit(False))
    beyond = lambda w: yes(x1(w) > label_end)
    holds = lambda w: _places(F.col("values"), lambda v: (x0(w) >= v["lo"] - OFF) & (x1(w) <= v["hi"] + OFF))
    part = lambda w: F.when(F.col("across"), F.lit(0)).otherwise(F.get(_places(columns, lambda v: w["cx"].between(v["lo"] - OFF, v["hi"] + OFF)), F.lit(0)))
    full = lambda w: F.struct(*[w[c].alias(c) for c in ("line", "x0", "text", "x1", "top", "cy")], beyond(w).alias("beyond"), (beyond(w) & yes(w["amount"])).alias("amount"), (beyond(w) & w["audited"]).alias("audited"), holds(w).alias("holds"), part(w).alias("part"), _tokens(text(w)).alias("tokens"))
    own = _once(own, _words=F.transform("words", full))
    inside = lambda x: F.filter("_words", lambda w: (w["cy"] >= x["top"]) & (w["cy"] < x["bottom"]))
    own = _once(own, _held=F.transform("_lines", lambda x: F.struct(inside(x).alias("words"), x["said"].alias("said"))))
    amounts = lambda x: F.exists(x["words"], lambda w: w["amount"])
    status = lambda x: F.exists(x["words"], lambda w: yes(w["audited"])) & F.forall(x["words"], lambda w: F.coalesce(w["audited"], F.lit(True)))
    own = _once(own, _kinds=F.transform("_held", lambda x: F.struct(x["words"].alias("words"), x["said"].alias("said"), amounts(x).alias("amounts"), status(x).alias("status"))))

    def placed(w: Column, x: Column) -> Column:
        """A word's value column (from 1; 0 for labels, null for none), and whether it isn't held by just one. A word that is there twice is held twice."""
        valued = (x["amounts"] | x["status"]) & w["beyond"]
        same = lambda o: (x0(o) == x0(w)) & (x1(o) == x1(w)) & (o["line"] == w["line"]) & (o["top"] == w["top"]) & text(o).eqNullSafe(text(w))
        lost = valued & ((F.size(w["holds"]) != 1) | (F.size(F.filter(x["words"], same)) != 1))
        return F.struct(text(w).alias("text"), F.when(valued, F.get(w["holds"], F.lit(0)) + 1).otherwise(0).alias("column"), lost.alias("lost"), w["part"].alias("part"), w["tokens"].alias("tokens"))

    own = _once(own, _placed=F.transform("_kinds", lambda x: F.struct(F.transform(x["words"], lambda w: placed(w, x)).alias("words"), x["said"].alias("said"), F.when(x["amounts"], "data").when(x["status"], "note").otherwise("section").alias("kind"))))
    all_tokens = lambda found: F.when(F.size(found) > 0, F.sort_array(F.flatten(found)))
    expected = lambda x, p: all_tokens(F.transform(F.filter(x["said"], lambda c: F.get(c["owners"], F.lit(0)) == p), lambda c: c["tokens"]))
    actual = lambda x, p: all_tokens(F.transform(F.filter(x["words"], lambda w: w["part"] == p), lambda w: F.coalesce(w["tokens"], F.array().cast("array<string>"))))
    parts = F.when(F.col("across"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(columns) - 1))
    differs = lambda x: F.exists(parts, lambda p: ~expected(x, p).eqNullSafe(actual(x, p))) | F.exists(x["words"], lambda w: w["part"].isNull()) | F.exists(x["said"], lambda c: c["loose"] | (F.size(c["owners"]) != 1))
    cells = lambda x: F.transform(F.sequence(F.lit(0), n), lambda k: _text(F.filter(x["words"], lambda w: w["column"] == k)))
    row = lambda x: F.struct(cells(x).alias("cells"), x["kind"].alias("kind"), (F.size(x["words"]) > 0).alias("found"), (F.size(x["said"]) > 0).alias("said"), F.exists(x["words"], lambda w: w["lost"]).alias("lost"), differs(x).alias("differs"))
    own = _once(own, _every=F.transform("_placed", row))
    own = _once(own, _rows=F.filter("_every", lambda x: x["found"] & (x["kind"] != "note")), _notes=F.filter("_every", lambda x: x["found"] & (x["kind"] == "note")))
    whole_row = lambda v: (F.get(v, F.lit(0)) != "") & F.forall(F.slice(v, F.lit(2), n), lambda x: (x != "") & is_amount(x))
    bad = F.exists("_rows", lambda x: (x["kind"] == "data") & ~whole_row(x["cells"]))

    lines_of = F.transform(F.split(F.coalesce("page_text", F.lit("")), "\n"), lambda x: F.trim(x))  # F.trim alone would take an index as what to trim
    own = _once(own, _text=lines_of)
    own = _once(own, _starts=_places(F.col("_text"), lambda x: F.lower(F.regexp_replace(x, ":+$", "")) == "assets"), _ends=_places(F.col("_text"), lambda x: x.rlike(NOTES)))
    start, end = F.get("_starts", F.lit(0)), F.get("_ends", F.lit(0))
    bounded = (F.size("_starts") == 1) & (F.size("_ends") == 1) & (start < end)
    source_tokens = F.when(bounded, _tokens(F.array_join(F.slice("_text", start + 1, end - start), " ")))
    own_rows = F.transform("_rows", lambda x: x["cells"])
    labels = F.transform("dates", lambda d: F.get(d, F.lit(0)))
    one_date = F.forall("dates", lambda d: F.size(d) == 1)
    notes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.filter(F.transform("_notes", lambda x: F.get(x["cells"], k)), lambda v: v != ""), " "))
    data = F.size(F.filter("_rows", lambda x: x["kind"] == "data"))
    twice = F.exists(F.sequence(F.lit(1), n), lambda k: F.size(F.filter("_notes", lambda x: F.get(x["cells"], k) != "")) > 1)
    flags = {
        "table": F.col("n_tables") != 1, "columns": ~F.col("fine"), "dates": ~one_date | (F.size(F.array_distinct(labels)) != F.size(labels)),
        "cells": F.exists("_every", lambda x: x["differs"]) | ~F.exists("_every", lambda x: x["found"] | x["said"]), "crossing": F.exists("_every", lambda x: x["lost"]) | ~F.exists("_every", lambda x: x["found"]),
        "rows": bad | twice, "bounds": ~bounded, "body": (_tokens(F.array_join(F.flatten(own_rows), " ")) != source_tokens) | (data < 2),
    }
    found = own.select(
        *K, "statement_type", own_rows.alias("rows"), F.transform("_rows", lambda x: x["kind"]).alias("row_kinds"), labels.alias("labels"), F.when(F.col("fine"), notes).alias("notes"),
        F.when(bounded, F.get("_text", end)).alias("source_note"), F.array().cast("array<struct<start:int,end:int,caption:string>>").alias("sections"), _first_of(BALANCE_UNCLEAR, flags).alias("error"),
    )
    return _result(found, "balance_geometry")


def _column_of(x: Column, edges: str = "edges") -> Column:
    """How many of the columns' right ends, but for the last one's, aren't right of x."""
    return F.size(F.filter(edges, lambda e: e <= x))


def component_columns(pages: DataFrame) -> DataFrame:
    """doc_id, page, columns, edges (right ends of all but the last), disagree: the wide cells of the page's most detailed rows, three at least."""
    wide = _wide_rows(_cells(pages)).filter(F.size("columns") >= 3)
    most = wide.withColumn("_n", F.max(F.size("columns")).over(Window.partitionBy(*K))).filter(F.size("columns") == F.col("_n"))
    first = most.groupBy(*K).agg(F.min(F.struct("top", "t", "r", "columns"))["columns"].alias("columns"))
    ends = most.select(*K, F.posexplode("columns").alias("k", "x")).groupBy(*K, "k").agg((F.max("x.hi") - F.min("x.hi")).alias("_off")).groupBy(*K).agg((F.max("_off") > EDGES_OFF).alias("disagree"))
    ends_of = lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: x["hi"])
    return first.join(ends, K).withColumn("edges", ends_of(F.col("columns")))


def component_rows(words: DataFrame, columns: DataFrame) -> DataFrame:
    """Lines of words cut at columns(doc_id, page, edges): doc_id, page, line, top, text, cells (a text for each column, by the words' centres). Words
    meet their page's edges in a window: pages that are dealt stay where they are."""
    both = words.unionByName(columns.select(*K, "edges"), allowMissingColumns=True)
    own = both.withColumn("edges", F.max("edges").over(Window.partitionBy(*K))).filter("edges IS NOT NULL AND line IS NOT NULL").withColumn("_k", _column_of((F.col("x0") + F.col("x1")) / 2))
    parts = own.groupBy(*K, "line", "edges", "_k").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("_words"), F.min("top").alias("top"))
    rows = parts.groupBy(*K, "line", "edges").agg(F.map_from_entries(F.collect_list(F.struct("_k", F.array_join(F.transform("_words", lambda w: w["text"]), " ")))).alias("by"), F.min("top").alias("top"), F.array_sort(F.flatten(F.collect_list("_words"))).alias("_all"))
    cells = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda k: F.coalesce(F.try_element_at(F.col("by"), k), F.lit("")))
    return rows.select(*K, "line", "top", F.array_join(F.transform("_all", lambda w: w["text"]), " ").alias("text"), cells.alias("cells"))


def raw_component_grids(words: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, page, rows: the lines of each page cut at the columns that its wide rules alone establish (see columns_of_rules), nothing checked or left out."""
    columns = columns_of_rules(edges).filter(F.size("columns") >= 2)
    columns = columns.withColumn("edges", F.transform(F.slice("columns", F.lit(1), F.size("columns") - 1), lambda x: x["hi"]))
    rows = component_rows(words, columns)
    return rows.groupBy(*K).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "cells"))), lambda x: x["cells"]).alias("rows"))


def _heads(words: DataFrame, lines: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, page, part, leaf (a head for each column), over (heads that span several, as struct<first, last, text>), fine: of the head lines of each part.

    Phrases of neighbouring words are heads; what spans columns stands over them, but not in a part's lowest line. Furniture and what begins among the labels
    is no head. Heads with what stands over them must differ, and no column has two over it."""
    own = words.join(lines.select(*K, "line", "part", "lowest"), [*K, "line"])
    order = Window.partitionBy(*K, "line").orderBy("x0", "x1")
    phrase = own.withColumn("_new", F.coalesce((F.col("x0") - F.lag("x1").over(order) > 4).cast("int"), F.lit(0))).withColumn("_p", F.sum("_new").over(order))
    phrase = phrase.groupBy(*K, "part", "line", "lowest", "_p").agg(_joined(_words()).alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    furniture = F.col("text").rlike(r"(?i)^\(?unaudited\)?$") | F.col("text").rlike(r"(?i)in (?:thousands|millions|billions)")
    phrase = phrase.join(columns.select(*K, "edges"), K).filter(~furniture & (F.col("x0") >= F.get("edges", F.lit(0)) - 2))
    phrase = phrase.withColumns({"first": _column_of(F.col("x0") + 1), "last": _column_of(F.col("x1") - 1)})
    single = phrase.filter("first = last").groupBy(*K, "part", "first").agg(_joined(_words()).alias("text")).groupBy(*K, "part").agg(F.map_from_entries(F.collect_list(F.struct("first", "text"))).alias("_leaf"))
    spans = phrase.filter("first < last").groupBy(*K, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "x0", "first", "last", "text"))), lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), p["text"].alias("text"))).alias("over"), F.max("lowest").alias("low"))
    both = single.join(spans, [*K, "part"], "full_outer").join(columns.select(*K, "edges"), K).withColumn("over", F.coalesce("over", F.array().cast("array<struct<first:int,last:int,text:string>>")))
    each = F.sequence(F.lit(0), F.size("edges"))
    both = both.withColumn("leaf", F.transform(each, lambda k: F.coalesce(F.try_element_at(F.col("_leaf"), k), F.lit(""))))
    above = lambda k: F.filter("over", lambda p: (p["first"] <= k) & (k <= p["last"]))
    paths = F.transform(F.sequence(F.lit(1), F.size("edges")), lambda k: F.lower(F.concat_ws(" ", F.array_join(F.transform(above(k), lambda p: p["text"]), " "), F.get("leaf", k))))
    fine = ~F.coalesce("low", F.lit(False)) & F.forall(F.slice("leaf", F.lit(2), F.size("edges")), lambda v: v != "") & (F.size(F.array_distinct(paths)) == F.size(paths)) & ~F.exists(each, lambda k: F.size(above(k)) > 1)
    return both.select(*K, "part", "leaf", "over", F.coalesce(fine, F.lit(False)).alias("fine"))


def _source_rows(pages: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, page, source: label and values of the rows that the page's text shows by itself, read with the most values that fit. State: one page's text."""
    ends = re.compile(f"{EQUITY_END}|{PAGE_PATTERNS['boundary'].removeprefix('(?i)')}")

    def run(texts: pd.Series, n_columns: pd.Series) -> pd.Series:
        out = []
        for text, n in zip(texts, n_columns, strict=True):
            rows = []
            for line in (text or "").splitlines():
                if ends.search(line):
                    break
                own = next((m for k in range(int(n), 1, -1) if (m := L.split_row(L.clean(line), k))), None)
                if own and re.search("[A-Za-z]", own[0]):
                    rows.append([own[0], *own[1]])
            out.append(rows)
        return pd.Series(out)

    return pages.select(*K, "text").join(columns.select(*K, "edges"), K).select(*K, F.pandas_udf(run, "array<array<string>>")("text", F.size("edges")).alias("source"))


def equity_grids(pages: DataFrame) -> DataFrame:
    """Rollforwards by component of pages(doc_id, page, statement_type, width, text, words, tables), as GRIDS.

    Columns are the wide cells of the most detailed rows; every word goes to the column of its centre. From the first line with a label and nothing but
    amounts on, lines are rows; those above it are heads. A line that names a period begins a part, whose own heads, if it has any, must be the first ones.
    Data rows must be the rows of the page's text, in order. Parts are the sections; without captions, pairs of balances around a total of a period are.
    """
    pages = cut(pages)
    words = cut(lines_of_words(pages.select(*K, F.explode("words").alias("w")).select(*K, "w.*")))
    columns = cut(component_columns(pages))
    lines = component_rows(words, columns)
    order = Window.partitionBy(*K).orderBy("line")
    ended = F.max(F.col("text").rlike(EQUITY_END) | F.col("text").rlike(PAGE_PATTERNS["boundary"])).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = lines.withColumn("_ended", ended).filter("NOT _ended").drop("_ended")
    values = F.slice("cells", F.lit(2), F.size("cells"))
    amounts = F.forall(values, lambda v: (v == "") | is_amount(v))
    some = F.exists(values, lambda v: v != "")
    lines = lines.withColumns({"label": F.get("cells", F.lit(0)), "some": some, "amounts": amounts, "caption": F.col("text").rlike(PERIOD)}).withColumn("data", (F.col("label") != "") & F.col("some") & F.col("amounts") & ~F.col("caption"))
    whole = Window.partitionBy(*K)
    first = F.min(F.when(F.col("data"), F.col("line"))).over(whole)
    lines = lines.withColumn("first", first).filter("first IS NOT NULL").withColumn("first_top", F.max(F.when(F.col("line") == F.col("first"), F.col("top"))).over(whole))
    part = F.sum(F.when(F.col("caption") & (F.col("line") > F.col("first")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = lines.withColumn("part", part)
    in_part = Window.partitionBy(*K, "part")
    begun = F.min(F.when(F.col("data"), F.col("line"))).over(in_part)
    lines = lines.withColumn("begun", begun)
    title = F.max(F.when(F.col("caption") & (F.col("line") < F.coalesce("begun", "line")), F.struct("line", F.regexp_replace("text", ":+$", "").alias("text")))).over(in_part)["text"]
    lines = lines.withColumn("title", F.coalesce(title, F.max(F.when(F.col("caption") & (F.col("part") > 0), F.regexp_replace("text", ":+$", ""))).over(in_part)))
    lines = cut(lines)
    near = (F.col("part") > 0) | (F.col("top") >= F.col("first_top") - EQUITY_HEAD)
    head = lines.filter((F.col("line") < F.col("begun")) & ~F.col("caption") & near).withColumn("lowest", F.col("line") == F.max("line").over(in_part))
    heads = cut(_heads(words, head, columns))
    main = heads.filter("part = 0").select(*K, "leaf", "over", "fine")
    again = heads.filter("part > 0").join(main.select(*K, F.col("leaf").alias("_leaf"), F.col("over").alias("_over")), K).groupBy(*K).agg(F.max((F.col("leaf") != F.col("_leaf")) | (F.col("over") != F.col("_over"))).alias("other_heads"))

    rows = lines.filter((F.col("line") >= F.col("begun")) & ~F.col("caption") & ((F.col("label") != "") | F.col("some")))
    unlabelled = (F.col("label") == "") & F.col("some")
    rows = rows.withColumn("bad", unlabelled | ~F.col("amounts")).withColumn("kind", F.when(F.col("some"), "data").otherwise("section"))
    body = rows.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("line", "cells", "kind", "part", "title"))).alias("_rows"), F.max("bad").alias("bad"))
    empty_part = lines.groupBy(*K).agg(F.max(F.col("begun").isNull()).alias("empty_part"), F.max("caption").alias("captions"))

    every = pages.select(*K).join(columns.select(*K, "disagree", "edges"), K, "left").join(body, K, "left").join(empty_part, K, "left").join(main, K, "left").join(again, K, "left").join(_source_rows(pages, columns), K, "left")
    over_row = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda k: F.coalesce(F.get(F.transform(F.filter("over", lambda p: p["first"] == k), lambda p: p["text"]), F.lit(0)), F.lit("")))
    top_rows = F.when(F.size("over") > 0, F.array(over_row, F.col("leaf"))).otherwise(F.array(F.col("leaf")))
    top_kinds = F.when(F.size("over") > 0, F.array(F.lit("parent_header"), F.lit("header"))).otherwise(F.array(F.lit("header")))
    every = every.withColumn("rows", F.concat(top_rows, F.transform("_rows", lambda x: x["cells"]))).withColumn("row_kinds", F.concat(top_kinds, F.transform("_rows", lambda x: x["kind"])))
    key = lambda label: F.lower(F.trim(F.regexp_replace(F.regexp_replace(label, r"\(\d+\)", ""), r"\s+", " ")))
    vector = lambda row: F.concat(F.array(key(F.get(row, F.lit(0)))), F.transform(F.filter(F.slice(row, F.lit(2), F.size(row)), lambda v: v != ""), lambda v: F.regexp_replace(v, r"\s", "")))
    own = F.transform(F.filter("_rows", lambda x: x["kind"] == "data"), lambda x: vector(x["cells"]))
    differs = F.transform("source", vector) != own
    flags = {
        "columns": F.col("edges").isNull(), "disagree": F.col("disagree"), "data": (F.size(own) < 2) | F.col("empty_part"),
        "heads": ~F.col("fine") | F.coalesce("other_heads", F.lit(False)), "rows": F.col("bad"), "text": differs,
    }
    n_heads = F.size("row_kinds") - F.size("_rows")
    section = "array<struct<start:int,end:int,caption:string>>"
    parts = F.array_distinct(F.transform("_rows", lambda x: x["part"]))
    places = lambda p: F.filter(F.transform("_rows", lambda x, i: F.when(x["part"] == p, i)), lambda i: i.isNotNull())
    by_caption = F.transform(parts, lambda p: F.struct((n_heads + F.array_min(places(p))).alias("start"), (n_heads + F.array_max(places(p)) + 1).alias("end"), F.coalesce(F.get(F.col("_rows"), F.array_min(places(p)))["title"], F.lit("")).alias("caption")))
    balances = F.filter(F.transform("_rows", lambda x, i: F.when((x["kind"] == "data") & F.get(x["cells"], F.lit(0)).rlike(BALANCE), i)), lambda i: i.isNotNull())
    total = lambda i: F.regexp_extract(F.get(F.get(F.col("_rows"), F.get(balances, 2 * i + 1) - 1)["cells"], F.lit(0)), TOTAL, 1)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(balances) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct((n_heads + F.get(balances, 2 * i)).alias("start"), (n_heads + F.get(balances, 2 * i + 1) + 1).alias("end"), total(i).alias("caption")))
    by_balance = F.when((F.size(balances) > 0) & (F.size(balances) % 2 == 0), F.filter(pairs, lambda s: s["caption"] != "")).otherwise(F.array().cast(section))
    chosen = F.when(F.col("captions"), by_caption.cast(section)).otherwise(by_balance.cast(section))
    covered = lambda s: F.array_distinct(F.flatten(F.transform(s, lambda x: F.sequence(x["start"], x["end"] - 1))))
    first_data = F.array_position("row_kinds", "data").cast("int") - 1
    complete = F.array_sort(covered(F.col("chosen"))) == F.sequence(first_data, F.size("rows") - 1)
    every = every.withColumn("chosen", chosen)
    found = every.select(*K, "rows", "row_kinds", F.slice("leaf", F.lit(2), F.size("edges")).alias("labels"), F.array().cast("array<string>").alias("notes"), F.lit("").alias("source_note"), F.when(complete, F.col("chosen")).otherwise(F.array().cast(section)).alias("sections"), _first_of(EQUITY_UNCLEAR, flags).alias("error"))
    return _result(pages.select(*K, "statement_type").join(found, K, "left"), "equity_geometry")
