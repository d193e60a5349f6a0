"""Benchmark decontamination by spaced seeds: hashes that ignore some word positions, joined with those of the test items and verified around each hit."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.shared import slices, spread, staged, texts_of
from ledgerflow.llm.words import forget, hashes, mixed, windows

#: 1: the word counts; 0: any word. Seven words in a span of eleven: a changed word leaves most seeds around it.
MASKS = ("11101001011", "11010110011", "11100110101")
SPAN = len(MASKS[0])
#: An overlap needs so many equal words, or all words of an item with fewer. Items with fewer than LEAST_ITEM words are too common to tell anything.
LEAST_EQUAL, LEAST_ITEM = 13, 8
#: A word that differs costs as much as so many equal ones bring: overlaps are equal in three words of four at least.
DIFFERENCE = 3
#: Words of a test set that is sent to all tasks; a larger one is joined by its seeds.
SENT_WORDS = 2_000_000
#: And its bytes: a text without blanks is one word.
SENT_BYTES = 32 << 20
#: Bits for each seed in the filter that documents' seeds pass before that join, and bits at most.
FILTER_BITS, MOST_BITS = 16, 1 << 28
#: Words that are compared at once.
AT_ONCE = 1 << 22
_ASCII = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_MARKS = regex.compile(r"[[\p{P}\p{S}]--\p{ASCII}]+", regex.V1)


def plain_words(text: str) -> list[bytes]:
    """Lower-case words without punctuation and symbols."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_ASCII).split()


def seeds_of(words: np.ndarray, mask: list[int]) -> np.ndarray:
    """One hash for each place; the mask is part of it."""
    h = windows(words, mask)
    return mixed(h + np.uint64(sum(1 << k for k in mask)), 9) if len(h) else h


def masks_for(words: int) -> list[list[int]]:
    """The masks that an item of so many words is found by: an item that is shorter than a mask by all its words."""
    return [[k for k, c in enumerate(m) if c == "1"] for m in MASKS] if words >= SPAN else [list(range(words))]


def best_stretch(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a matrix of equal words, where the stretch of highest score starts and ends: the first such end, and the last start."""
    total = np.zeros((equal.shape[0], equal.shape[1] + 1), np.int32)
    np.cumsum(np.where(equal, 1, -DIFFERENCE), axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(total, axis=1)
    end = np.argmax(total - low, axis=1)
    at = np.arange(total.shape[1])
    start = np.where((total == low[np.arange(len(end)), end][:, None]) & (at <= end[:, None]), at, -1).max(axis=1)
    return start, end


def stretches(equal: np.ndarray, need: int) -> list[tuple[int, int, int]]:
    """(start, end, equal words) of a row's stretches: the best one, then those beside it, each with the number of equal words that it needs."""
    found, open_ = [], [(0, len(equal))]
    while open_:
        a, b = open_.pop()
        if equal[a:b].sum() < need:
            continue
        start, end = (int(x[0]) + a for x in best_stretch(equal[None, a:b]))
        if (n := int(equal[start:end].sum())) >= need:
            found.append((start, end, n))
        open_ += [(a, start), (end, b)]
    return found


class TestItems:
    """Word hashes of test items and their seeds."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], least_item: int = LEAST_ITEM) -> None:
        kept = [(i, hashes.of(w)) for i, t in items if len(w := plain_words(t or "")) >= max(1, least_item)]
        self.names = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        self.masks = list({tuple(m): m for w in self.words for m in masks_for(len(w))}.values())
        self.own: list[list[tuple[int, np.ndarray, np.ndarray]]] = []  # by item: mask, its sorted seeds, their places
        for w in self.words:
            mine = []
            for mask in masks_for(len(w)):
                h = seeds_of(w, mask)
                order = np.argsort(h, kind="stable")
                mine.append((self.masks.index(mask), h[order], order))
            self.own.append(mine)
        self.seeds = []  # by mask: distinct seeds, where each one's items begin, items, a bitmap of leading bits
        bits = max(12, sum(map(len, self.words)).bit_length() + 4)
        for k in range(len(self.masks)):
            pairs = [(np.unique(h), i) for i, mine in enumerate(self.own) for m, h, _ in mine if m == k]
            h, item = np.concatenate([x for x, _ in pairs]), np.concatenate([np.full(len(x), i) for x, i in pairs])
            order = np.argsort(h, kind="stable")
            distinct, first = np.unique(h[order], return_index=True)
            maybe = np.zeros(1 << bits, bool)
            maybe[(distinct >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.seeds.append((distinct, np.append(first, len(h)), item[order], maybe, np.uint64(64 - bits)))

    def hits(self, words: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
        """By mask: places in the text and their seeds; the items that have any of these."""
        found, met = [], set()
        for mask, (distinct, first, item, maybe, shift) in zip(self.masks, self.seeds, strict=True):
            h = seeds_of(words, mask)
            places = np.flatnonzero(maybe[(h >> shift).astype(np.int64)])
            at = np.minimum(np.searchsorted(distinct, h[places]), len(distinct) - 1)
            same = distinct[at] == h[places]
            places, at = places[same], np.unique(at[same])
            found.append((places, h[places]))
            for k in at:
                met.update(item[first[k] : first[k + 1]].tolist())
        return found, sorted(met)

    def shifts(self, item: int, hits: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """The places in the text where the item would begin by any of its seeds, in order."""
        m = len(self.words[item])
        marked, some = None, []
        for mask, seeds, at in self.own[item]:
            places, h = hits[mask]
            a, b = np.searchsorted(seeds, h, side="left"), np.searchsorted(seeds, h, side="right")
            places, a, count = places[b > a], a[b > a], (b - a)[b > a]
            ends = np.cumsum(count)
            if len(ends) and ends[-1] > AT_ONCE and marked is None:
                marked = np.zeros(n + m, bool)
            start = 0
            while start < len(places):  # a seed that stands often on both sides: some places at once
                done = ends[start - 1] if start else 0
                to = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
                k = count[start:to]
                nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                begins = np.repeat(places[start:to], k) - at[np.repeat(a[start:to], k) + nth]
                if marked is None:
                    some.append(begins)
                else:
                    marked[begins + m] = True
                start = to
        if marked is not None:
            for begins in some:
                marked[begins + m] = True
            return np.flatnonzero(marked) - m
        return np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)

    def overlaps(self, words: np.ndarray) -> list[tuple]:
        """(item, place in the text, place in the item, words, equal words) of the overlaps with each item.

        Along each shift, the stretch with the highest score (see DIFFERENCE) counts, then the best ones beside it. Where overlaps of one item share words
        of the text, the one with more equal words stays; of these the one that comes first in the text, then in the item.
        """
        out, (hits, met) = [], self.hits(words)
        n = len(words)
        for i in met:
            own = self.words[i]
            m, need = len(own), min(LEAST_EQUAL, len(own))
            shifts, found = self.shifts(i, hits, n), []
            for at in range(0, len(shifts), max(1, AT_ONCE // m)):
                some = shifts[at : at + max(1, AT_ONCE // m)]
                place = some[:, None] + np.arange(m)
                equal = (words[np.clip(place, 0, n - 1)] == own) & (place >= 0) & (place < n)
                rows = np.flatnonzero(equal.sum(axis=1) >= need)
                if not len(rows):
                    continue
                some, equal = some[rows], equal[rows]
                start, end = best_stretch(equal)
                sums = np.concatenate([np.zeros((len(rows), 1), np.int32), np.cumsum(equal, axis=1, dtype=np.int32)], axis=1)
                every = np.arange(len(rows))
                inside, before, after = sums[every, end] - sums[every, start], sums[every, start], sums[:, -1] - sums[every, end]
                simple = (before < need) & (after < need)
                whole = simple & (inside >= need)
                found.append(np.stack([inside, some + start, start, end - start], axis=1)[whole])
                for k in np.flatnonzero(~simple):
                    found.append(np.asarray([(c, some[k] + a, a, b - a) for a, b, c in stretches(equal[k], need)], np.int64).reshape(-1, 4))
            out += [(self.names[i], *r) for r in apart(np.concatenate(found))] if found else []
        return out


def apart(found: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(place in the text, place in the item, words, equal words) of the rows (equal words, place, item place, words) that stay: see overlaps()."""
    starts: list[int] = []
    kept: dict[int, tuple] = {}
    for n, start, own, size in found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))].tolist():
        k = bisect.bisect_left(starts, start)
        if (k < len(starts) and starts[k] < start + size) or (k and starts[k - 1] + kept[starts[k - 1]][2] > start):
            continue
        starts.insert(k, start)
        kept[start] = (start, own, size, n)
    return [kept[s] for s in starts]


HITS = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"
_NAMES = [x.split()[0] for x in HITS.split(", ")]


def _items(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return benchmark.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def _sent(items: DataFrame, most_words: int, least_item: int) -> TestItems | None:
    """The test set for all tasks, or None where it has more words, or more than SENT_BYTES."""
    words, size = (n or 0 for n in items.agg(F.sum(F.size(F.split("text", r"\s+"))), F.sum(F.octet_length("text") + 16)).first())
    return TestItems(sorted((tuple(r) for r in items.collect()), key=str), least_item) if words <= most_words and size <= SENT_BYTES else None


def skipped_items(benchmark: DataFrame, least_item: int = LEAST_ITEM, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """id, n_words of the items that are too short to be looked for: with least_item = 1, those without a word alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(plain_words(t)) for t in texts_of(batch, "text")], pa.int64())], names=["id", "n_words"])

    return _items(benchmark, id_column, text_column).mapInArrow(run, "id long, n_words long").filter(F.col("n_words") < max(1, least_item))


def _seed_rows(rows: DataFrame, kinds: list[list[int]] | None, least_item: int, passing: np.ndarray | None = None) -> DataFrame:
    """row, seed for each distinct seed of a text: by the masks of these kinds; for items (None) by those of their own length. passing: a bitmap of seeds that may matter."""
    sent = rows.sparkSession.sparkContext.broadcast(passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = []
            for text in texts_of(batch, "text"):
                words = hashes.of(plain_words(text))
                masks = kinds or (masks_for(len(words)) if len(words) >= max(1, least_item) else [])
                seeds = np.unique(np.concatenate([seeds_of(words, m) for m in masks])) if masks else np.zeros(0, np.uint64)
                if sent.value is not None:
                    low = seeds & np.uint64(8 * len(sent.value) - 1)
                    seeds = seeds[(sent.value[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                found.append(seeds.view(np.int64))
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row)), pa.array(np.concatenate(found))], names=["row", "seed"])

    return rows.select("row", "text").mapInArrow(run, "row struct<id: bigint, text_hash: bigint>, seed long")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A bitmap of the seeds' lowest bits, FILTER_BITS for each seed, MOST_BITS at most: parts come from the tasks as bytes and are joined by OR."""
    n = seeds.count()
    bits = min(MOST_BITS, 1 << max(12, (max(1, n) * FILTER_BITS - 1).bit_length()))
    words = seeds.select(F.expr(f"(seed & {bits - 1}L) div 64").alias("at"), F.expr("shiftleft(1L, int(seed & 63))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    table = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(table.column("at"), np.int64)] = np.asarray(table.column("bits"), np.int64)
    return out.view(np.uint8)


def _row_of(id_: F.Column, text: F.Column) -> F.Column:
    return F.struct(id_.cast("long").alias("id"), F.xxhash64(text).alias("text_hash"))


def joined_leaks(docs: DataFrame, items: DataFrame, least_item: int = LEAST_ITEM) -> DataFrame:
    """leaks() of docs(id, text) for a test set of any size: seeds of both sides are joined, then each candidate pair is verified on both texts.

    Documents' seeds pass a bitmap of the items' seeds first, so that few are shuffled; seeds that most documents have are dealt over salts. Pairs are
    distinct before texts are joined to them; rows that are repeated are candidates once and reported each.
    """
    own = staged(items.withColumn("row", _row_of(F.col("id"), F.col("text"))).select("row", "id", "text"), "items")
    seeds = staged(_seed_rows(own.dropDuplicates(["row"]), None, least_item), "item-seeds")
    lengths = _lengths(own, least_item)
    kinds = list({tuple(m): m for n in lengths for m in masks_for(n)}.values()) or masks_for(SPAN)
    texts = docs.withColumn("row", _row_of(F.col("id"), F.col("text")))
    met = staged(_seed_rows(texts, kinds, least_item, _bitmap(seeds.select("seed").distinct())), "seeds").withColumn("by", F.xxhash64("row"))
    pairs = spread(met, seeds.withColumnRenamed("row", "item"), "seed", "by").select("row", "item").distinct()
    pairs = staged(pairs.withColumn("by", F.xxhash64("row")), "pairs")
    named = spread(pairs, own.select(F.col("row").alias("item"), F.struct(F.col("id").alias("item_id"), F.col("text").alias("item_text")).alias("own")), "item", "by").select("row", "own.*")
    both = texts.select("row", "id", "text").join(named, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for d, t, i, u in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "item_id", "item_text")), strict=True):
                rows += [(d, *x) for x in TestItems([(i, u)], least_item).overlaps(hashes.of(plain_words(t or "")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=_NAMES)

    return both.mapInArrow(run, HITS)


def _lengths(items: DataFrame, least_item: int) -> list[int]:
    """The numbers of words, up to SPAN, that items have: a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([min(SPAN, len(plain_words(t))) for t in texts_of(batch, "text")], pa.int32())], names=["n"])

    return sorted(r[0] for r in items.select("text").mapInArrow(run, "n int").distinct().collect() if r[0] >= max(1, least_item))


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_item: int = LEAST_ITEM, sent_words: int = SENT_WORDS, item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """For each overlap of a document and a test item: where, over how many words, and how many of these are equal. See TestItems.overlaps.

    A test set of up to sent_words words is sent to all tasks, and documents are read once and never shuffled; a larger one is joined by its seeds (see
    joined_leaks), with the same result. Items of fewer than least_item words are left out (see skipped_items); those of fewer than LEAST_EQUAL must be there
    whole, and those shorter than a mask are looked for by all their words: with least_item = 1, every item that has a word is.

    Null and empty texts and items overlap with nothing; repeated rows and items, and null ids, are reported like others; an empty table on either side gives
    no rows; other columns aren't read. A text of one word over and over costs its length times that of the items that it meets, in bounded memory.
    """
    own, items = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")), _items(benchmark, item_column, item_text_column)
    block = _sent(items, sent_words, least_item)
    if block is None:
        return joined_leaks(own, items, least_item)
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(d, *x) for d, t in zip(batch.column("id").to_pylist(), texts_of(batch, "text"), strict=True) for x in sent.value.overlaps(hashes.of(plain_words(t)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=_NAMES)

    return own.mapInArrow(run, HITS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_item: int = LEAST_ITEM, sent_words: int = SENT_WORDS) -> DataFrame:
    """The rows of docs that overlap with no test item (see leaks), with all their columns; without a join where the test set is sent to all tasks.

    Null and empty texts stay; of repeated rows all stay or none; a row with a null id, or with the id of another row, is judged by its own text.
    """
    items = _items(benchmark, "item_id", "text")
    block = _sent(items, sent_words, least_item)
    if block is None:
        own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), _row_of(F.col(id_column), F.col(text_column)).alias("__row"))
        texts = docs.select(F.xxhash64(text_column).alias("id"), F.col(text_column).alias("text")).dropDuplicates(["id"])
        gone = joined_leaks(texts, items, least_item).select(F.col("doc_id").alias("text_hash")).distinct()
        return own.join(gone, F.col("__row.text_hash") == F.col("text_hash"), "left_anti").select("__doc.*")
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, text_column):
            yield batch.filter(pa.array([not sent.value.overlaps(hashes.of(plain_words(t))) for t in texts_of(batch, text_column)], pa.bool_()))
        forget()

    return docs.mapInArrow(run, docs.schema)


def op10_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
