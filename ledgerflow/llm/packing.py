"""Packing token pieces into sequences of a fixed capacity: linear grouping, a few-size configuration program, then best fit.

What is solved is the histogram of lengths, which has no more rows than the capacity however many documents there are. Its solution is a list of runs
(`Run`), and each piece finds its sequence and its place there from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.shared import slices, staged, texts_of
from ledgerflow.llm.token_ids import encoder
from ledgerflow.llm.words import hashes


class Run(NamedTuple):
    """The pieces of one length with ranks from `rank` on, `count` of them: `each` go to each bin from `bin` on, the first of a bin at `fill`."""

    length: int
    rank: int
    count: int
    bin: int
    each: int
    fill: int


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, near: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Bin configurations and how often each is used: the linear program of cutting stock, by column generation, to within the share `near` of its least number of bins."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    used = demand / np.diag(columns)
    deepest = int(capacity // sizes.min())
    least = 0.0
    while True:
        price = np.linalg.solve(columns.T, np.ones(m))
        worth = np.flatnonzero(price > 1e-12)
        value, picked = np.zeros(capacity + 1), []
        for _ in range(deepest):  # the best content of one item more, for each room
            gain = np.zeros((len(worth) + 1, capacity + 1))
            gain[-1] = value
            for row, i in enumerate(worth):
                gain[row, sizes[i] :] = value[: capacity + 1 - sizes[i]] + price[i]
            best = gain.argmax(axis=0)
            better = gain[best, np.arange(capacity + 1)]
            best[better <= value + 1e-12] = len(worth)
            if (best == len(worth)).all():
                break
            picked.append(best)
            value = np.maximum(value, better)
        least = max(least, float(demand @ price) / max(1.0, value[capacity]))
        if value[capacity] <= 1 + 1e-9 or used.sum() <= least * (1 + near):
            return [(columns[:, j].astype(int), float(used[j])) for j in range(m)]
        column, room = np.zeros(m), capacity
        for best in reversed(picked):
            if best[room] < len(worth):
                column[worth[best[room]]] += 1
                room -= sizes[worth[best[room]]]
        step = np.linalg.solve(columns, column)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(np.argmin(ratio))
        used = np.maximum(used - ratio[leaves] * step, 0)
        used[leaves] = ratio[leaves]
        columns[:, leaves] = column


class _Bins:
    """Bins by the room that they have left; all bins of a range have the same content."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.n, self.runs = capacity, 0, []
        self.by_room: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.by_room:
                self.by_room[room] = []
                bisect.insort(self.rooms, room)
            self.by_room[room].append((first, n))

    def best_fit(self, length: int, rank: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                n = -(-count // (self.capacity // length))
                self.put(self.capacity, self.n, n)
                self.n += n
                continue
            room = self.rooms[at]
            first, n = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room], self.rooms[at]
            each = min(room // length, count)
            full = min(n, count // each)
            self.runs.append(Run(length, rank, full * each, first, each, self.capacity - room))
            self.put(room - each * length, first, full)
            self.put(room, first + full, n - full)
            rank, count = rank + full * each, count - full * each


def _grouped(counts: dict[int, int], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and demands of groups of equal cardinality, in descending order of length: a group's size is its longest. Groups of one size are one."""
    lengths = np.asarray(sorted(counts, reverse=True))
    total = np.cumsum([counts[int(x)] for x in lengths])
    bounds = np.linspace(0, total[-1], min(groups, int(total[-1])) + 1).round().astype(int)
    sizes, demand = lengths[np.searchsorted(total, bounds[:-1], side="right")], np.diff(bounds)
    kept = np.unique(sizes)[::-1]
    return kept, np.asarray([demand[sizes == x].sum() for x in kept], float)


def _solve(counts: dict[int, int], capacity: int, groups: int, small: int, share: float = 0.5) -> tuple[list[Run], int]:
    bins, taken, left = _Bins(capacity), dict.fromkeys(counts, 0), {k: n for k, n in counts.items() if k > small}
    stock = sorted(left)  # lengths of large pieces that are left
    while stock:
        sizes, demand = _grouped(left, groups)
        last, opened = demand.sum() < 20 * len(sizes), bins.n
        for column, often in sorted(((c, int((n if last else n * share) + 1e-6)) for c, n in configurations(sizes, demand, capacity)), key=lambda x: tuple(x[0]), reverse=True):
            slots = [int(sizes[i]) for i in np.flatnonzero(column) for _ in range(column[i])]
            parts = [(bins.n, often, 0)] if stock else []
            bins.n += often if stock else 0
            for at in range(len(slots)):
                after, later = [], sum(slots[at + 1 :])
                for first, n, fill in parts:
                    while n:
                        k = bisect.bisect_right(stock, capacity - fill - later) - 1  # the longest piece that leaves room for the configuration's other ones
                        if k < 0:
                            after.append((first, n, fill))
                            break
                        length = stock[k]
                        use = min(n, left[length])
                        bins.runs.append(Run(length, taken[length], use, first, 1, fill))
                        after.append((first, use, fill + length))
                        taken[length] += use
                        left[length] -= use
                        if not left[length]:
                            del stock[k], left[length]
                        first, n = first + use, n - use
                parts = after
            for first, n, fill in parts:
                if fill:
                    bins.put(capacity - fill, first, n)
                else:  # no piece was left for these, which are the last
                    bins.n = min(bins.n, first)
        if last or bins.n == opened:
            break
    for length in sorted(counts, reverse=True):
        if counts[length] > taken[length]:
            bins.best_fit(length, taken[length], counts[length] - taken[length])
    return bins.runs, bins.n


#: Shares of the capacity from which on a length is large, and numbers of groups for each: the fewer large pieces a sequence can hold, the more groups pay.
SCHEMES = ((1 / 3, 64), (1 / 8, 16), (1 / 4, 32), (1 / 8, 32), (1 / 4, 64), (1 / 2, 64))


def solve(counts: dict[int, int], capacity: int, schemes: tuple[tuple[float, int], ...] = SCHEMES) -> tuple[list[Run], int]:
    """Runs for all pieces and the number of bins.

    Lengths over a share of the capacity are large: in descending order they are cut in groups of equal cardinality, each rounded up to its longest; the
    configuration program for these few sizes is solved and a share of it is laid out; real pieces take the places of rounded ones, the longest that still
    leaves room for the configuration's other ones; the large pieces that are left are grouped anew, until few are. They and all small pieces go by best
    fit, longest first. The scheme runs for each share and number of groups given, until one needs no more bins than the sum of lengths does; the one
    with the fewest bins counts. With a share of 1/2 every configuration is one piece, so with the last scheme the result is never worse than best fit for
    all, longest first.
    """
    least, best = -(-sum(length * n for length, n in counts.items()) // capacity), None
    for share, groups in schemes:
        found = _solve(counts, capacity, groups, int(capacity * share))
        best = found if best is None or found[1] < best[1] else best
        if best[1] <= least:
            break
    return best


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every text's ids and the end id; what is longer than the capacity is cut. nth: its rank among the pieces of its length in its partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes.clear()
        encode, part, end, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.asarray([end_id], "<u4").tobytes(), {}
        for batch in slices(batches, text_column):
            rows = []
            for name, ids in zip(batch.column(id_column).to_pylist(), encode(texts_of(batch, text_column)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    rows.append((name, piece, at // 4, length, zlib.crc32(own), part, nth))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)
        pa.default_memory_pool().release_unused()

    return docs.select(id_column, text_column).mapInArrow(cut, PIECES)


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each piece with its sequence and its place there: see solve().

    The pieces, without their ids, are written once to the shared folder. Ranks within a length are partition counts and their running sums, so that a
    length that most pieces have is no task of its own. To the driver come at most `capacity` counts; the runs that go to the executors are bounded by
    the capacity and the number of groups, not by the number of documents.

    Null and empty texts are the end id alone; repeated and null ids are packed as often as they come; a very long text is cut into pieces of its own; an empty table gives no rows; other columns aren't read.
    """
    cut = staged(pieces(docs, capacity, tokenizer, end_id, id_column, text_column), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = solve(histogram, capacity)
    table = np.asarray(sorted(runs), np.int64).reshape(-1, 6)
    table = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        keys = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return cut.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "part", "nth").mapInArrow(place, PLACED)


def op4_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
