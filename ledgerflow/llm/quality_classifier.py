"""A generalised additive model with pairwise interactions: boosted shallow trees fill lookup tables by feature and by pair of features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.shared import slices, staged, texts_of
from ledgerflow.llm.words import count_of, forget, hashes, repeated_words, windows

#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 20_000
UPPER, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@~^"
FEATURES = ("log_words", "word_bytes", "marks", "bars", "exclamations", "upper", "digits", "stops", "commas", "distinct", "top_word", "distinct_pairs", "repeats", "lines", "repeated_lines")


def measure(text: str) -> list[float]:
    """FEATURES of a whole text; without words all are 0."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    ids = hashes.of(words)
    _, times = np.unique(ids, return_counts=True)
    pairs = windows(ids, range(2))
    lines = [x for x in data.split(b"\n") if x.strip()]
    size = sum(map(len, words))
    return [np.log1p(n), size / n, count_of(data, MARKS) / n, count_of(data, b"|") / n, count_of(data, b"!") / n, count_of(data, UPPER) / size, count_of(data, DIGITS) / size, count_of(data, b".") / n, count_of(data, b",") / n, len(times) / n, times.max() / n, len(np.unique(pairs)) / max(1, len(pairs)), repeated_words(ids) / n, len(lines) / n, 1 - len(set(lines)) / len(lines)]


@dataclass
class Additive:
    """Bin edges and one table of log-odds for each feature; coarse edges and a table for each pair."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    base: float
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.base)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            odds += table[np.searchsorted(edges, x[:, i], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            odds += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, shrink: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins in two."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + shrink) + (all_g - left_g) ** 2 / (all_h - left_h + shrink) - all_g**2 / (all_h + shrink)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, shrink: float, leaves: int = 3) -> np.ndarray:
    """A tree of a few leaves over the bins of one feature: each bin's value."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_best_cut(g[a:b], h[a:b], shrink), a, b) for a, b in parts if b - a > 1), default=(0.0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        parts.remove(best[2:])
        parts += [(best[2], best[2] + best[1]), (best[2] + best[1], best[3])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + shrink)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, shrink: float) -> tuple[float, np.ndarray]:
    """The best cut along one axis, then the best cut of each half along the other: gain and each cell's value."""
    best, out = 0.0, np.zeros_like(g)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for at in range(1, len(gg)):
            gain, value = 0.0, np.zeros_like(gg)
            for rows in (slice(0, at), slice(at, None)):
                a, b = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
                more, cut = _best_cut(a, b, shrink)
                gain += more + a.sum() ** 2 / (b.sum() + shrink)
                for columns in (slice(0, cut), slice(cut, None)):
                    value[rows, columns] = a[columns].sum() / (b[columns].sum() + shrink)
            gain -= g.sum() ** 2 / (h.sum() + shrink)
            if gain > best:
                best, out = gain, value if axis == 0 else value.T
    return best, out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 6, rounds: int = 150, pair_rounds: int = 30, n_pairs: int = 6, rate: float = 0.15, shrink: float = 1.0) -> Additive:
    """Cyclic boosting: each round grows one shallow tree for each feature in turn; then the pairs whose trees gain most on what is left get tables too."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive([_cuts(v, bins) if len(v) else np.zeros(0) for v in x.T], [], float(np.log(share / (1 - share))), [_cuts(v, pair_bins) if len(v) else np.zeros(0) for v in x.T])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(e, v, side="right") for e, v in zip(model.edges, x.T, strict=True)]
    odds = np.full(len(y), model.base)
    chance = lambda: 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    for _ in range(rounds):
        for i, own in enumerate(at):
            p = chance()
            step = rate * _tree(np.bincount(own, y - p, len(model.tables[i])), np.bincount(own, p * (1 - p), len(model.tables[i])), shrink)
            model.tables[i] += step
            odds += step[own]
    rough = [np.searchsorted(e, v, side="right") for e, v in zip(model.coarse, x.T, strict=True)]
    width = [len(e) + 1 for e in model.coarse]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, cell = chance(), rough[i] * width[j] + rough[j]
        return tuple(np.bincount(cell, w, width[i] * width[j]).reshape(width[i], width[j]) for w in (y - p, p * (1 - p)))

    gains = sorted(((_pair_tree(*sums(i, j), shrink)[0], i, j) for i in range(len(at)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:n_pairs]]
    model.pair_tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            step = rate * _pair_tree(*sums(i, j), shrink)[1]
            model.pair_tables[k] += step
            odds += step[rough[i], rough[j]]
    return model


_NUMBERS = ", ".join(f"{f} double" for f in FEATURES)


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """FEATURES of each document's whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = np.asarray([measure(t) for t in texts_of(batch, "text")], float)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=["id", *FEATURES])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id long, {_NUMBERS}")


def held_out(id_column: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id, y of at most sample_rows labelled documents that aren't held out: those with the smallest hashes of their ids. Labels that differ for one id: the higher.

    A hash bound that about a quarter more than sample_rows stay under comes first, so that tasks together hand on no more than that, however many there are.
    It is doubled while fewer stay under it, so that the rows don't depend on the bound.
    """
    learn = labels.filter(~held_out("doc_id") & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("double").alias("y")).filter("id IS NOT NULL")
    learn = learn.withColumn("order", F.xxhash64("id"))
    under = lambda share: learn.filter(F.col("order") <= min(2**63 - 1, int(share * 2**64) - 2**63))
    share = min(1.0, 1.25 * sample_rows / max(1, learn.count()))
    while share < 1 and under(share).count() < sample_rows:
        share = min(1.0, 2 * share)
    near = under(share)
    return near.orderBy("order", "id").limit(sample_rows).select("id", "y")


def train(measured: DataFrame, learn: DataFrame) -> Additive:
    """A model from the features of sample()'s documents, which is small enough to be broadcast. Of rows that share an id, the one with the least features counts."""
    own = measured.join(F.broadcast(learn), "id").groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct(*FEATURES)).alias("x"))
    rows = own.orderBy("id").select("y", *[f"x.{f}" for f in FEATURES]).toPandas().to_numpy(float).reshape(-1, len(FEATURES) + 1)
    return fit(rows[:, 1:], (rows[:, 0] > 0.5).astype(float))


def score(measured: DataFrame, model: Additive) -> DataFrame:
    """id, score, predicted. The model is a few thousand numbers, whatever the input."""
    sent = measured.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.score(np.stack([np.asarray(batch.column(f), float) for f in FEATURES], axis=1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    return measured.mapInArrow(run, "id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score, predicted for each document.

    Features are computed once and written to the shared folder (15 numbers a document); the labelled sample and the scores both read that. Null and empty
    texts are scored with all features 0; null ids are scored and never learnt from; repeated rows are scored each; without labels every score is 0.5 and every
    prediction 1; an empty table gives no rows; other columns aren't read.
    """
    measured = staged(features(docs, id_column, text_column), "features")
    return score(measured, train(measured, sample(labels, sample_rows)))


def op8_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, in one pass without a join: features are measured again and scored where the text is.

    For training, only the labelled rows' features are needed: documents meet the list of labelled ids, which is the hashed side, and the rest of a
    document goes no further.

    Rejected are scores under 0.5. Null and empty texts are scored with all features 0; null ids are judged and never learnt from; repeated rows are judged
    alike; without labels all rows stay; an empty table gives no rows; all columns stay, whatever their names.
    """
    learn = staged(sample(labels, sample_rows), "sample")
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    known = own.join(F.broadcast(learn.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")  # at most sample_rows ids
    sent = docs.sparkSession.sparkContext.broadcast(train(staged(features(known), "features"), learn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, text_column):
            s = sent.value.score(np.asarray([measure(t) for t in texts_of(batch, text_column)], float))
            yield batch.filter(pa.array(s >= 0.5))
        forget()

    return docs.mapInArrow(run, docs.schema)
