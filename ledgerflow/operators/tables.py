"""Tables of captured pages, found in two ways: in the cells that rules bound, and in the white rivers between words. Each cell has its box."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.text import numbers_in
from ledgerflow.operators import page_arrays as A

PAGE = ("doc_id", "source_page")
#: Points: thickness of a rule at most, length at least; how far apart rules can be and count as one; how far a rule may end before another one and meet it.
THICK, SHORTEST, SNAP, REACH = 2.0, 3.0, 3.0, 3.0
#: Points of white between words that part two phrases; width of a river at least; lines of a block at least; height at which a word opens the next line.
GAP, RIVER, LINES, LINE = 4.0, 4.0, 2, 3.0

_page = list(PAGE)
_TYPES = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
_EDGE, _WORD = ("x0", "x1", "top", "bottom"), ("text", "x0", "x1", "top", "bottom")
_RULE, _CORNER = "level boolean, at double, lo double, hi double", "x double, y double, row double, column double, left boolean, right boolean, up boolean, down boolean"
_BOX, _PLACE = "x0 double, x1 double, top double, bottom double", "table_index int, row_index int, column_index int, rowspan int, colspan int"
_LINED, _RIVERS = f"line int, text string, {_BOX}", "table_index int, x double, lo double, hi double"


def _over_pages(fields: str, step: Callable[[pa.DataType, pa.Array, pa.Array], pa.Array]) -> Callable[[str, str], Column]:
    """step as an expression over two columns that hold a page's rows as lists, with a list of `fields` as its result."""
    type = pa.list_(pa.struct([(name, _TYPES[of]) for name, of in (f.split() for f in fields.split(", "))]))

    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        return step(type, first, second)

    return F.arrow_udf(run, f"array<struct<{fields.replace(', ', ',').replace(' ', ':')}>>")


def _plain(step: Callable[[A.Rows], A.Rows]) -> Callable[[pa.DataType, pa.Array, pa.Array], pa.Array]:
    return lambda type, rows, _: A.pages_of(step(A.rows_of(rows)), len(rows), type)


def _with_texts(step: Callable[[A.Rows], A.Rows]) -> Callable[[pa.DataType, pa.Array, pa.Array], pa.Array]:
    def run(type: pa.DataType, words: pa.Array, _: pa.Array) -> pa.Array:
        own = step(A.rows_of(words))
        return A.pages_of(own, len(words), type, text=pc.struct_field(words.flatten(), "text").take(pa.array(own["text"])))

    return run


def lined(words: Column) -> Column:
    """A page's list of words(text, x0, x1, top, bottom) with the numbers of their lines; words without a height have none and go."""
    own = F.transform(words, lambda w: F.struct(w["text"].cast("string").alias("text"), *[w[c].cast("double").alias(c) for c in _EDGE]))
    return _over_pages(_LINED, _with_texts(lambda rows: A.lines(rows, LINE)))(own, own)


def pages_of(**parts: DataFrame) -> DataFrame:
    """One row for each page with its rows of each part as a list: `edges` and `words` have numbers and texts, other parts what they have. Pages that are dealt
    stay where they are."""
    key = [F.col("doc_id").cast("string").alias("doc_id"), F.col("source_page").cast("int").alias("source_page")]
    of = {"edges": _EDGE, "words": _WORD}
    field = lambda name, c: F.col(c).cast("double" if name in of and c != "text" else "string" if name in of else parts[name].schema[c].dataType).alias(c)
    rows = [df.select(*key, F.struct(*[field(name, c) for c in of.get(name, [c for c in df.columns if c not in PAGE])]).alias(name)) for name, df in parts.items()]
    both = rows[0]
    for other in rows[1:]:
        both = both.unionByName(other, allowMissingColumns=True)
    return both.groupBy(*PAGE).agg(*[F.collect_list(name).alias(name) for name in parts])


def _each(pages: DataFrame, rows: Column) -> DataFrame:
    """A row for each of a list that Python makes. A plain explode would have Spark ask for lists with a row first, and make each list twice."""
    return pages.select(*PAGE, rows.alias("_rows")).select(*PAGE, F.explode_outer("_rows").alias("_r")).filter("_r IS NOT NULL").select(*PAGE, "_r.*")


def _by_page(rows: DataFrame, fields: str, step: Callable[[A.Rows], A.Rows], name: str = "rows") -> DataFrame:
    return _each(pages_of(**{name: rows}), _over_pages(fields, _plain(step))(name, name))


def rules(edges: DataFrame, thick: float = THICK, shortest: float = SHORTEST, snap: float = SNAP) -> DataFrame:
    """doc_id, source_page, level (whether it goes across), at, lo, hi: the rules of each page.

    A flat edge(doc_id, source_page, x0, x1, top, bottom) is a rule at its middle; a box of more than `thick` in both ways is its four sides. Rules of one
    direction that are at most `snap` apart, one by one, go to the mean of their places, and those that then touch or overlap on one line become one.
    Edges with a null or NaN are no rules; sides shorter than `shortest` neither.
    """
    return _by_page(edges, _RULE, lambda own: A.rules(own, thick, shortest, snap), "edges")


def corners(rules: DataFrame, reach: float = REACH) -> DataFrame:
    """Where a level rule and an upright one meet: x, y, the rules (by `row` and `column`, where each begins), and whether they go on to the left, right, up
    and down of it. A level rule is tried with the upright ones whose places are along it."""
    return _by_page(rules, _CORNER, lambda own: A.corners(own, reach))


def bounded_cells(corners: DataFrame) -> DataFrame:
    """x0, x1, top, bottom of each cell: a rectangle with rules along all four sides and none that begins at its upper or left side and goes into it.

    From a corner that goes right and down, the cell ends at the next corner along the upper rule that goes down, and at the next along the left rule that
    goes right; it is one if the rules through these meet in a corner as well. Corners are sorted along their rules: no pairs of them are tried.
    """
    return _by_page(corners, _BOX, A.bounded_cells)


def placed_cells(cells: DataFrame, least: int = 2) -> DataFrame:
    """cells with table_index (from 1, from top to bottom and left to right), row_index, column_index, rowspan and colspan.

    Cells that share a corner are of one table; tables of fewer than `least` cells aren't any. Rows and columns are the distinct upper and left sides of a
    table's cells. State: the cells of one page.
    """
    return _by_page(cells, f"{_PLACE}, {_BOX}", lambda own: A.placed_cells(own, least))


def ruled(edges: str = "edges", words: str = "words") -> Column:
    """The cells that rules bound, with their texts, as a list for each page of pages_of()."""

    def step(type: pa.DataType, edges: pa.Array, words: pa.Array) -> pa.Array:
        cells = A.placed_cells(A.bounded_cells(A.corners(A.rules(A.rows_of(edges), THICK, SHORTEST, SNAP), REACH)), 2)
        texts = A.texts_of(cells, A.lines(A.rows_of(words), LINE), pc.struct_field(words.flatten(), "text"))
        return A.pages_of(cells, len(edges), type, raw_text=texts)

    return _over_pages(f"{_PLACE}, {_BOX}, raw_text string", step)(edges, words)


def spaced(words: str = "words", gap: float = GAP, river: float = RIVER, share: float = 0.0, least: int = LINES) -> Column:
    """The cells of lines that stand in columns, with their texts, as a list for each page of pages_of()."""

    def step(type: pa.DataType, words: pa.Array, _: pa.Array) -> pa.Array:
        own = A.blocks(A.lines(A.rows_of(words), LINE), gap, least)
        cells, texts = A.spaced_cells(own, A.rivers(own, river, share), pc.struct_field(words.flatten(), "text"))
        return A.pages_of(cells, len(words), type, raw_text=texts)

    return _over_pages(f"{_PLACE}, {_BOX}, raw_text string", step)(words, words)


def ruled_cells(edges: DataFrame, words: DataFrame) -> DataFrame:
    """The ruled tables of pages with their texts: doc_id, source_page, table_id, flavor, order, row_index, column_index, rowspan, colspan, raw_text, x0, x1,
    top, bottom.

    edges(doc_id, source_page, x0, x1, top, bottom), words(doc_id, source_page, text, x0, x1, top, bottom). A word is in the cell that holds its middle;
    cells without words have an empty text. Pages without words or edges have no row. Both are grouped by page once; rules(), corners(), bounded_cells() and
    placed_cells() are then steps over the lists of many pages.
    """
    return named(pages_of(edges=edges, words=words), ruled(), "ruled")


def named(pages: DataFrame, cells: Column, flavor: str) -> DataFrame:
    """A row for each cell of a list, with its table's name."""
    name = F.format_string(f"P%04d_{flavor.upper()}_%02d", "source_page", "table_index")
    columns = ["row_index", "column_index", "rowspan", "colspan", "raw_text", "x0", "x1", "top", "bottom"]
    return _each(pages, cells).select(*PAGE, name.alias("table_id"), F.lit(flavor).alias("flavor"), F.col("table_index").alias("order"), *columns)


def blocks(words: DataFrame, gap: float = GAP, least: int = LINES) -> DataFrame:
    """Words of lines that stand in columns: with table_index (from 1) and row_index. A line counts that has white of more than `gap` between two of its
    words; such lines that follow each other on a page are a block, if there are `least` of them or more."""
    step = _with_texts(lambda own: A.blocks(A.lines(own, LINE), gap, least))
    return _each(pages_of(words=words), _over_pages(f"{_LINED}, table_index int, row_index int", step)("words", "words"))


def rivers(words: DataFrame, least: float = RIVER, share: float = 0.0) -> DataFrame:
    """doc_id, source_page, table_index, x (the middle), lo, hi of each river of a block: stretches at least so wide where at most `share` of its lines have a
    word. A sweep over the words' sides: as words of a line don't overlap, the words that are open at a place are the lines with a word there."""
    return _by_page(words.drop("text"), _RIVERS, lambda own: A.rivers(own, least, share))


def spaced_cells(words: DataFrame, gap: float = GAP, river: float = RIVER, share: float = 0.0, least: int = LINES) -> DataFrame:
    """Tables without rules: blocks of lines, whose columns are what rivers part. Columns as ruled_cells(); a cell without words has no row, and a cell's box
    is that of its words.

    A word's column is the number of rivers whose middle is left of its own: rivers and words are merged by place, and a running count goes over both.
    """
    return named(pages_of(words=words), spaced("words", gap, river, share, least), "spaced")


def audit(pages: DataFrame, cells: DataFrame, flavor: str) -> DataFrame:
    """doc_id, source_page, Check, Scope, Status, Detail: for each of the pages how many tables were found."""
    found = cells.groupBy(*PAGE).agg(F.count_distinct("table_id").alias("n"))
    own = pages.select(*PAGE).distinct().join(found, _page, "left").na.fill(0, ["n"])
    status = F.when(F.col("n") > 0, "PASS").otherwise("NO_TABLE_FOUND")
    detail = F.when(F.col("n") > 0, F.format_string("Detected %d table(s).", "n")).otherwise(F.lit("No table structure detected."))
    return own.select(*PAGE, F.lit(f"{flavor} table extraction").alias("Check"), F.format_string("Page %d", "source_page").alias("Scope"), status.alias("Status"), detail.alias("Detail"))


def method_metrics(lines: DataFrame, cells: DataFrame, pages: DataFrame, methods: tuple[str, ...] = ("ruled", "spaced")) -> DataFrame:
    """For each page and method (a cell's flavor; found there or not) tables, rows, and the recall of the numbers in the page's text.

    lines(doc_id, source_page, raw_text). Signs, labels and columns aren't compared; recall is null where the text has no number. Pages, lines and cells are
    grouped together, not joined: pages that are dealt stay where they are.
    """
    own = cells.select(*PAGE, "flavor", F.col("table_id").alias("table"), "row_index", "raw_text")
    every = pages_of(lines=lines.select(*PAGE, "raw_text"), cells=own, wanted=pages.select(*PAGE, F.lit(True).alias("wanted")))
    of = lambda m: F.filter("cells", lambda c: c["flavor"] == m).alias(m)
    return page_metrics(every.filter("size(wanted) > 0").select(*PAGE, F.transform("lines", lambda x: x["raw_text"]).alias("texts"), *map(of, methods)), methods)


def _counts(source: str, found: str) -> Column:
    """How many numbers are in the source and in both, and which are missing or too many, with how often; by page."""

    def run(source: pa.Array, found: pa.Array) -> pa.Array:
        return A.counts(source, found)

    gaps = "array<struct<token:string,n:bigint>>"
    return F.arrow_udf(run, f"struct<reference_tokens:bigint,matched_tokens:bigint,missing_tokens:{gaps},extra_tokens:{gaps}>")(source, found)


def page_metrics(pages: DataFrame, methods: tuple[str, ...] = ("ruled", "spaced")) -> DataFrame:
    """method_metrics() of pages(doc_id, source_page, texts, and for each method a list of cells with table, row_index and raw_text). A page stays one row."""
    numbers = lambda texts: F.flatten(F.transform(texts, numbers_in))
    distinct = lambda m, key: F.size(F.array_distinct(F.transform(m, key))).cast("long")
    row = lambda c: F.concat_ws(" ", c["row_index"].cast("string"), c["table"].cast("string"))
    sizes = [F.struct(distinct(m, lambda c: c["table"]).alias("tables"), distinct(m, row).alias("rows")).alias(f"{m}_sizes") for m in methods]
    tokens = pages.select(*PAGE, numbers("texts").alias("source"), *sizes, *[numbers(F.transform(m, lambda c: c["raw_text"])).alias(m) for m in methods])
    own = tokens.select(*PAGE, *[f"{m}_sizes" for m in methods], *[(F.size("source") + F.size(m) > 0).alias(f"{m}_any") for m in methods], *[_counts("source", m).alias(m) for m in methods])
    own = own.select("*", F.explode(F.array(*map(F.lit, methods))).alias("flavor"))
    of = lambda suffix, field: F.coalesce(*[F.when(F.col("flavor") == m, F.col(m + suffix)[field]) for m in methods]).alias(field)
    some = F.coalesce(*[F.when(F.col("flavor") == m, F.col(f"{m}_any")) for m in methods])
    gaps = lambda field: F.when(some, F.map_from_entries(of("", field))).alias(field)
    recall = F.try_divide(of("", "matched_tokens"), F.nullif(of("", "reference_tokens"), F.lit(0))).alias("recall")
    return own.select(*PAGE, "flavor", of("", "reference_tokens"), of("", "matched_tokens"), gaps("missing_tokens"), gaps("extra_tokens"), recall, of("_sizes", "tables"), of("_sizes", "rows"))
