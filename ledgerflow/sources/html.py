"""HTML filings: one parse of each file in a Python worker gives its tables, captions and facts; classification and selection are DataFrame operations."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.functions import lines as L
from ledgerflow.functions.text import normalize
from ledgerflow.functions.tokens import parse
from ledgerflow.operators.sections import best_runs, heading_type
from ledgerflow.functions.fixed_values import PAGE_PATTERNS

SUFFIXES = (".html", ".htm", ".xhtml")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DROPPED = frozenset(("script", "style", "noscript", "template", "svg"))
_BLOCKS = frozenset(("p", "div", "h1", "h2", "h3", "h4", "h5", "h6"))
_HIDDEN_CLASSES = {"hidden", "hide", "d-none"}
MOST_ROWS, MOST_COLUMNS, MOST_BACK, MOST_CAPTION = 10_000, 1000, 30, 220


@dataclass
class Node:
    name: str
    attributes: dict[str, str]
    parent: Node | None = None
    children: list = field(default_factory=list)
    order: int = 0
    hidden: bool = False

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    parts.append(x.strip())
            elif x is self or not (x.hidden or x.name in _DROPPED):
                stack.extend(reversed(x.children))
        return L.clean(" ".join(parts))


class Tree(HTMLParser):
    """Elements in document order; whether one is hidden passes to what it holds."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})
        self.nodes: list[Node] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag in ("td", "th"):
            self.close_until(("td", "th"), ("tr", "table"))
        elif tag == "tr":
            self.close_until(("tr",), ("table",))
        elif tag in _BLOCKS and tag != "div":
            self.close_until(("p",), ("td", "th", "div", "table"))
        style = re.sub(r"\s+", "", own.get("style", "").lower())
        hidden = tag in ("ix:hidden", "xbrli:context", "xbrli:unit") or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or bool(_HIDDEN_CLASSES & set(own.get("class", "").lower().split()))
        node = Node(tag, own, self.at, [], len(self.nodes), hidden or self.at.hidden)
        self.at.children.append(node)
        self.nodes.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def close_until(self, names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        node = self.at
        while node.parent is not None and node.name not in stops:
            if node.name in names:
                self.at = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.name == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _inside(node: Node, name: str) -> Node | None:
    node = node.parent
    while node is not None and node.name != name:
        node = node.parent
    return node


def _span(value: str | None, most: int) -> int:
    try:
        return max(1, min(most, int(value or 1)))
    except ValueError:
        raise ValueError(f"not a table span: {value!r}") from None


def grid(table: Node, rows: list[Node]) -> tuple[list[list[str]], list[tuple[int, int, int, int]]]:
    """Cells where spans put them, padded to one width; spans of more than one cell."""
    taken: set[tuple[int, int]] = set()
    out, spans = [], []
    for r, row in enumerate(rows):
        values, c = [], 0
        for cell in (x for x in row.children if isinstance(x, Node) and x.name in ("td", "th") and not x.hidden):
            while (r, c) in taken:
                values.append("")
                c += 1
            high, wide = _span(cell.attributes.get("rowspan"), MOST_ROWS), _span(cell.attributes.get("colspan"), MOST_COLUMNS)
            values += [cell.text(), *[""] * (wide - 1)]
            if high > 1 or wide > 1:
                spans.append((r, c, high, wide))
                taken.update((i, j) for i in range(r, min(r + high, len(rows))) for j in range(c, c + wide))
            c += wide
        out.append(values)
    width = max(map(len, out), default=0)
    return [v + [""] * (width - len(v)) for v in out], spans


def line_of(values: list[str]) -> str:
    text = L.clean(" ".join(v for v in values if v))
    return re.sub(r"(?<=\d)\s+[xX]\b", "x", re.sub(r"(?<=\d)\s+%", "%", text))


def _back(found: list[Node], orders: list[int], at: int) -> list[Node]:
    """The last MOST_BACK of the elements before a place, nearest first."""
    to = bisect_left(orders, at)
    return found[max(0, to - MOST_BACK) : to][::-1]


def read(content: bytes | str) -> dict:
    """tables: rows, spans, lines, nearby heading and captions of each table that holds no other; facts: name, text, hidden in document order."""
    tree = Tree()
    tree.feed(content.decode("utf-8", "replace") if isinstance(content, bytes) else content)
    tree.close()
    facts = [(n.attributes["name"], n.text() or L.clean(n.attributes.get("content")), n.hidden, n.order) for n in tree.nodes if n.attributes.get("name")]
    shown = [n for n in tree.nodes if not n.hidden and n.name not in _DROPPED]
    holders = {id(t) for n in shown if n.name == "table" and (t := _inside(n, "table"))}
    with_table = set()
    for n in shown:
        if n.name == "table":
            up = n.parent
            while up is not None and id(up) not in with_table:
                with_table.add(id(up))
                up = up.parent
    rows: dict[int, list[Node]] = {}
    for n in shown:
        if n.name == "tr" and (t := _inside(n, "table")):
            rows.setdefault(id(t), []).append(n)
    blocks = [n for n in shown if n.name in _BLOCKS]
    near = [n for n in shown if n.name in ("table", "p", "div", "h1", "h2", "h3")]
    block_orders, near_orders = [n.order for n in blocks], [n.order for n in near]
    tables = []
    for t in (n for n in shown if n.name == "table" and id(n) not in holders):
        cells, spans = grid(t, rows.get(id(t), []))
        kind = heading = ""
        for n in _back(blocks, block_orders, t.order):
            text = "" if id(n) in with_table else n.text()
            if text and len(text) <= MOST_CAPTION:
                if re.search(PAGE_PATTERNS["boundary"], text):
                    kind, heading = "__supporting__", text
                    break
                if own := L.heading_type(text):
                    kind, heading = own, text
                    break
        captions = []
        for n in _back(near, near_orders, t.order):
            if n.name == "table":
                break
            text = "" if id(n) in with_table else n.text()
            if L.heading_type(text):
                break
            if text and len(text) <= MOST_CAPTION and text not in captions and re.search(r"(?i)unaudited|in (?:thousands|millions|billions)|except.*share|(?:19|20)\d{2}", text):
                captions.append(text)
        tables.append((len(tables) + 1, cells, spans, list(map(line_of, cells)), kind, heading, captions[::-1]))
    return {"tables": tables, "facts": facts}


TABLES = "doc_id string, table_index int, rows array<array<string>>, spans array<struct<r:int,c:int,rs:int,cs:int>>, lines array<string>, nearby_type string, nearby_heading string, captions array<string>, facts array<struct<name:string,text:string,hidden:boolean,ord:int>>, error string"


def parsed(files: DataFrame) -> DataFrame:
    """files(doc_id, content): one row for each leaf table, and one with table_index 0 for a file's facts (or its error: a bad file fails no other)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for doc, content in zip(frame["doc_id"], frame["content"], strict=True):
                try:
                    found = read(content if content is not None else b"")
                    out.append([doc, 0, None, None, None, None, None, None, found["facts"], None])
                    out += [[doc, *t, None, None] for t in found["tables"]]
                except ValueError as bad:
                    out.append([doc, 0, None, None, None, None, None, None, [], str(bad)])
            yield pd.DataFrame(out, columns=["doc_id", "table_index", "rows", "spans", "lines", "nearby_type", "nearby_heading", "captions", "facts", "error"])

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, TABLES)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path that Spark reads, by suffix."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter(F.lower("path").rlike(r"\.x?html?$")).select(F.col("path").alias("doc_id"), "path", "content")


def metadata(tables: DataFrame) -> DataFrame:
    """client_name, document_type, year, period of each filing from its facts: visible ones before hidden ones, the first in the document."""
    facts = tables.filter("table_index = 0").select("doc_id", F.explode_outer("facts").alias("f")).select("doc_id", F.lower("f.name").alias("name"), normalize(F.col("f.text")).alias("text"), "f.hidden", "f.ord")
    first = lambda suffix: F.min_by("text", F.when(F.col("name").endswith(suffix) & (F.col("text") != ""), F.struct("hidden", "ord")))
    found = facts.groupBy("doc_id").agg(*[first(s).alias(n) for n, s in (("client_name", "entityregistrantname"), ("document_type", "documenttype"), ("focus", "documentfiscalyearfocus"), ("ended", "documentperiodenddate"), ("part", "documentfiscalperiodfocus"))])
    part = F.upper("part")
    return found.select("doc_id", "client_name", "document_type", F.coalesce("focus", F.nullif(F.regexp_extract("ended", r"(?<!\d)((?:19|20|21)\d{2})(?!\d)", 1), F.lit(""))).alias("year"), F.when(part == "FY", "Annual").when(part.isin("Q1", "Q2", "Q3", "Q4"), part).alias("period"))


_AMOUNT = r"(?:[$€£¥]?\s*\(?\d[\d,]*(?:\.\d+)?\)?%?)"


def classify(tables: DataFrame) -> DataFrame:
    """tables with statement_type and heading, of those that are statements: nine rules in order of precedence.

    The nearest heading above carries over tables without one of their own, until a supporting section.
    """
    order = Window.partitionBy("doc_id").orderBy("table_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.last(F.when(F.col("nearby_type") != "", F.struct("nearby_type", "nearby_heading")), ignorenulls=True).over(order)
    t = tables.filter("table_index > 0").withColumn("_near", near)
    kind, low = F.coalesce("_near.nearby_type", F.lit("")), F.lower(F.array_join("lines", " "))
    head = F.lower(F.coalesce(F.get("lines", F.lit(0)), F.lit("")))
    amounts = F.size(F.filter("lines", lambda x: x.rlike("[A-Za-z]") & (F.size(F.regexp_extract_all(x, F.lit(f"({_AMOUNT})"), 1)) >= 2)))
    own = F.get(F.filter(F.transform(F.slice("lines", 1, 25), lambda x: F.struct(heading_type(x).alias("kind"), x.alias("title"))), lambda x: x["kind"].isNotNull() & (F.length(x["title"]) <= MOST_CAPTION)), F.lit(0))
    has = lambda *w: F.lit(True) if not w else low.contains(w[0]) & has(*w[1:])
    schedule = ~head.contains("valuation techniques") & ~head.contains("unobservable inputs") & (head.contains("fair value") | (head.contains("cost") & head.contains("value"))) & head.rlike("investment|portfolio|security|cash equivalents") & head.rlike("percentage of net assets|% of net assets|cost")
    supporting = (kind == "__supporting__") | F.exists(F.slice("lines", 1, 3), lambda x: normalize(x).rlike(PAGE_PATTERNS["boundary"]))
    cascade = (
        F.when(own.isNotNull(), F.struct(own["kind"].alias("kind"), own["title"].alias("title")))
        .when(has("total assets", "total liabilities"), F.struct(F.lit("BalanceSheet").alias("kind"), F.lit("Consolidated Statements of Assets and Liabilities").alias("title")))
        .when(has("operating activities", "financing activities") & (has("net cash used") | has("net cash provided")), F.struct(F.lit("CashFlowStatement").alias("kind"), F.lit("Consolidated Statements of Cash Flows").alias("title")))
        .when(has("net assets at", "capital unit transactions") & (has("contributions for units issued") | has("net assets resulting from operations")), F.struct(F.lit("PartnersCapital").alias("kind"), F.lit("Statements of Changes in Net Assets").alias("title")))
        .when(has("investment income", "expenses") & (has("net investment income") | has("net investment loss")), F.struct(F.lit("IncomeStatement").alias("kind"), F.lit("Consolidated Statement of Operations").alias("title")))
        .when((has("revenue") | has("net sales")) & (has("net income") | has("net earnings")), F.struct(F.lit("IncomeStatement").alias("kind"), F.lit("income statement").alias("title")))
        .when(has("partners' capital") & (has("contributions") | has("distributions")), F.struct(F.lit("PartnersCapital").alias("kind"), F.lit("statement of changes in partners' capital").alias("title")))
        .when(schedule, F.struct(F.lit("ScheduleOfInvestments").alias("kind"), F.lit("Schedule of Investments").alias("title")))
        .when(kind != "", F.struct(kind.alias("kind"), F.coalesce("_near.nearby_heading", F.lit("")).alias("title")))
    )
    enough = amounts >= F.when(kind != "", 1).otherwise(2)
    return t.withColumn("data_lines", amounts).withColumn("_c", F.when(~supporting & enough, cascade)).filter("_c IS NOT NULL").withColumn("statement_type", F.col("_c.kind")).withColumn("heading", F.col("_c.title")).drop("_c", "_near")


def selected(candidates: DataFrame) -> DataFrame:
    """Of each statement the run of neighbouring tables with the most data lines, the earliest of equals."""
    best = best_runs(candidates, ["doc_id", "statement_type"], "table_index", "data_lines").select("doc_id", "statement_type", "first", "last")
    return candidates.join(best, ["doc_id", "statement_type"]).filter("table_index BETWEEN first AND last").drop("first", "last")


def _title(lines: Column, kind: Column, heading: Column, near: Column, near_kind: Column) -> Column:
    own = F.get(F.filter(F.slice(lines, 1, 25), lambda x: heading_type(x) == kind), F.lit(0))
    return F.coalesce(own, F.when(near_kind == kind, near), F.lit(""))


def statement_lines(tables: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Selected tables as lines for the statement parser: company, title, captions, then rows; rows without a value are sections."""
    t = tables.withColumn("title", _title(F.col("lines"), F.col("statement_type"), F.col("heading"), F.col("nearby_heading"), F.col("nearby_type")))
    value = lambda v: parse(v)["status"].isin("NUMERIC", "DASH", "NA", "NM")
    none = F.lit(None).cast("string")
    rows = F.transform(F.arrays_zip("lines", "rows"), lambda x: F.struct(x["lines"].alias("raw_text"), F.when(F.exists(F.slice(x["rows"], F.lit(2), F.greatest(F.lit(0), F.size(x["rows"]) - 1)), value), none).otherwise("section").alias("row_type_hint")))
    lead = F.when((F.col("title") != "") & ~F.array_contains("lines", F.col("title")), F.array(F.struct(F.col("title").alias("raw_text"), none.alias("row_type_hint")))).otherwise(F.array().cast("array<struct<raw_text:string,row_type_hint:string>>"))
    captions = F.transform(F.coalesce("captions", F.array().cast("array<string>")), lambda c: F.struct(c.alias("raw_text"), F.lit("section").alias("row_type_hint")))
    each = t.select("doc_id", "table_index", F.col("statement_type").alias("statement_type_hint"), F.col("title").alias("source_title"), F.posexplode(F.concat(lead, captions, rows)).alias("_n", "x")).select("doc_id", "table_index", "_n", "x.raw_text", "x.row_type_hint", "statement_type_hint", "source_title")
    if names is not None:
        company = names.filter("client_name IS NOT NULL").select("doc_id", F.lit(0).alias("table_index"), F.lit(0).alias("_n"), F.col("client_name").alias("raw_text"), none.alias("row_type_hint"), none.alias("statement_type_hint"), none.alias("source_title"))
        each = company.unionByName(each)
    line = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_index", "_n"))
    return each.filter(normalize(F.col("raw_text")) != "").select("doc_id", F.lit(None).cast("int").alias("source_page"), line.alias("line_no"), "raw_text", normalize(F.col("raw_text")).alias("normalized_text"), F.lit(True).alias("machine_readable"), F.lit("HTML_EXTRACTED").alias("page_status"), "row_type_hint", "statement_type_hint", "source_title")


def cells(tables: DataFrame) -> DataFrame:
    """Raw cells of selected tables with their spans and token."""
    rows = tables.select("doc_id", "table_index", F.format_string("HTML_%04d", "table_index").alias("table_id"), "statement_type", "heading", "captions", "spans", F.posexplode("rows").alias("row_index", "_row"))
    each = rows.select("*", F.posexplode("_row").alias("column_index", "raw_text")).drop("_row")
    span = F.get(F.filter("spans", lambda s: (s["r"] == F.col("row_index")) & (s["c"] == F.col("column_index"))), F.lit(0))
    return each.select("doc_id", F.lit(None).cast("int").alias("source_page"), "table_id", F.lit("html").alias("flavor"), F.lit(True).alias("selected"), F.col("table_index").alias("order"), "row_index", "column_index", "raw_text", F.coalesce(span["rs"], F.lit(1)).alias("rowspan"), F.coalesce(span["cs"], F.lit(1)).alias("colspan"), F.col("statement_type").alias("statement_type_hint"), F.col("heading").alias("source_title"), F.col("captions").alias("source_context"))
