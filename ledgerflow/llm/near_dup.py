"""Near-duplicate documents: DartMinHash signatures of weighted word shingles, a banded join, exact verification, and classes as connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.shared import HEAVY_LEAST, heavy_keys, slices, spread, staged, texts_of
from ledgerflow.llm.words import forget, hashes, mixed, multiplier, windows

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: 25 bands of 5 coordinates: a pair of similarity 0.8 shares a band in 99.995 of 100 cases.
COORDINATES, BANDS, ROWS = 128, 25, 5
#: Pairs whose sketches agree in fewer coordinates than this aren't verified: 4 standard deviations below the similarity asked for.
LEAST_AGREE = math.ceil(COORDINATES * (SIMILARITY - 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)))
#: Members of a bucket that one task compares with as many others, and bytes of their sets.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Not read any more: buckets of every size are compared in the same way, see crossing(). Tests still set it.
SPLIT_BLOCKS = 24
#: What a shingle that stands n times in a text weighs.
WEIGHTS = {"count": lambda n: n, "log": lambda n: 1 + np.log(n), "set": np.ones_like}


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def weighted_shingles(words: list[bytes], weights: str = "count", size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The text's shingles as sorted hashes, and their weights. A text of fewer words is one shingle; one without words has none."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    shingles, times = np.unique(windows(hashes.of(words), range(min(size, len(words)))), return_counts=True)
    return shingles, WEIGHTS[weights](times.astype(float))


def regions(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit regions that each element's weight covers, by name, and how high each is covered: 1, and what is left in the last one of an element."""
    n = np.ceil(weights).astype(int)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mixed(np.repeat(elements, n) + nth.astype(np.uint64) * multiplier(99), 1), np.minimum(1.0, np.repeat(weights, n) - nth)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def darts(elements: np.ndarray, weights: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The signature of a weighted set: for each coordinate the earliest dart's 64-bit name.

    Darts are thrown at each unit region of an element, weight by time, as a Poisson process that the region's hash drives: gaps between darts are
    exponential, a dart has a height between 0 and 1 and a coordinate. Darts above the height to which the weight covers the region are lost. About
    coordinates * (ln coordinates + 2) darts of the whole set come before the time limit, so long sets keep few darts of their elements, most of which get one
    number drawn and no more; if a coordinate stays empty, the limit doubles. Two sets share a dart where they share weight: coordinates agree with the
    probability of their weighted Jaccard similarity.
    """
    cells, heights = regions(elements, weights)
    total = float(heights.sum())
    if not total:
        return np.zeros(0, np.uint64)
    partial = bool((heights < 1).any())
    limit = coordinates * (math.log(coordinates) + 2) / total
    first = -np.log(_uniform(mixed(cells, 2)))
    while True:
        own = np.flatnonzero(first < limit)
        m = math.ceil(limit + 8 * math.sqrt(limit)) + (2 if limit < 1e-2 else 4)
        while True:  # until each region's last dart falls behind the limit
            steps = np.arange(1, m + 1, dtype=np.uint64) * multiplier(100)
            named = mixed(cells[own, None] + steps[None, :], 3)
            times = first[own, None] + np.cumsum(np.concatenate([np.zeros((len(own), 1)), -np.log(_uniform(mixed(named, 4)))], axis=1), axis=1)[:, :m]
            if (times[:, -1] >= limit).all():
                break
            m *= 2
        hit = times < limit
        if partial:
            hit &= _uniform(mixed(named, 5)) < heights[own, None]
        times, named = times[hit], named[hit]
        order = np.argsort(-times, kind="stable")
        out, filled = np.zeros(coordinates, np.uint64), np.zeros(coordinates, bool)
        at = (mixed(named[order], 6) % np.uint64(coordinates)).astype(int)
        out[at], filled[at] = named[order], True
        if filled.all():
            return out
        limit *= 2


def band_keys(signature: np.ndarray) -> np.ndarray:
    if not len(signature):
        return np.zeros(0, np.int64)
    rows = signature[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * multiplier(101)
    for i in range(ROWS):
        key = mixed(key + rows[:, i] * multiplier(i), 7)
    return key.view(np.int64)


def signatures(docs: DataFrame, id_column: str, text_column: str, weights: str = "count") -> DataFrame:
    """id, text_hash, node (128-bit hash of the words: equal texts are one node), keys of bands, sketch (16 bits of each coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, "text"):
            nodes, keys, sketches = [], [], []
            for t in texts_of(batch, "text"):
                words = words_of(t)
                signature = darts(*weighted_shingles(words, weights))
                nodes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                keys.append(band_keys(signature))
                sketches.append(signature.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["id", "text_hash", "node", "keys", "sketch"])
        forget()

    return _narrow(docs, id_column, text_column).mapInArrow(run, "id long, text_hash long, node binary, keys array<long>, sketch binary")


def _narrow(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))


def packed_set(elements: np.ndarray, weights: np.ndarray) -> bytes:
    return elements.astype("<u8").tobytes() + weights.astype("<f4").tobytes()


def unpacked_set(data: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<f4", n, 8 * n)


def cell_sets(docs: DataFrame, nodes: DataFrame, counts: DataFrame, id_column: str, text_column: str, weights: str = "count") -> DataFrame:
    """node, cells (the weighted set) for these nodes, each from the text of one document (node, row): only texts that meet another in a bucket are read into sets. The nodes are the hashed side; counts: rows by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([packed_set(*weighted_shingles(words_of(t), weights)) for t in texts_of(batch, "text")], pa.binary())], names=["node", "cells"])
        forget()

    texts = _narrow(docs, id_column, text_column).select(F.struct("id", "text_hash").alias("row"), "text", F.monotonically_increasing_id().alias("at"))
    return spread(texts, nodes, "row", "at", counts=counts, hashed=True).select("node", "text").mapInArrow(run, "node binary, cells binary")


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], least: float = 0.0) -> float:
    """The weighted Jaccard similarity of two sets with sorted elements; 0 if their total weights rule out the least one asked for."""
    (a, u), (b, v) = (x, y) if len(x[0]) <= len(y[0]) else (y, x)
    one, other = float(u.sum(dtype=float)), float(v.sum(dtype=float))
    if not len(a) or min(one, other) < least * max(one, other) - 1e-9:
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = b[at] == a
    both = float(np.minimum(u[shared], v[at[shared]]).sum(dtype=float))
    return both / (one + other - both)


def verified(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Of the pairs (a, b) those with this weighted Jaccard similarity at least, computed from the whole sets. A b that most pairs have is dealt over salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray([similarity(*(unpacked_set(c.as_buffer()) for c in pair), least) for pair in zip(batch.column("cells_a"), batch.column("cells_b"), strict=True)], float)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "similarity"]).filter(pa.array(found >= least - 1e-9))
        forget()

    left = pairs.join(sets.withColumnRenamed("node", "a").withColumnRenamed("cells", "cells_a"), "a")
    return spread(left, sets.withColumnRenamed("node", "b").withColumnRenamed("cells", "cells_b"), "b", "a").select("a", "b", "cells_a", "cells_b").mapInArrow(run, "a binary, b binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of an edge; label: the least node of its component.

    Each round, a node takes the least label among its neighbours (a minimum with partial aggregates, so a node with very many is none too large); from
    the third round on it also takes the label of its label, so that long chains end in few rounds. A node with very many edges is dealt over salts, which
    are fixed once. Labels are written to the shared folder each round; the driver sees one number, of the labels that changed.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both, "edges")
    degrees = both.groupBy("a").agg(F.count("*").alias("n"))
    heavy = F.broadcast(heavy_keys(degrees, both.count()).select(F.col("a").alias("node"), F.ceil(F.col("n") / HEAVY_LEAST).cast("int").alias("salts")))
    both = staged(both.join(heavy.withColumnRenamed("node", "a"), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts"), "salted")
    labels = staged(degrees.select(F.col("a").alias("node"), F.col("a").alias("label")), "labels")
    turn = 0
    while True:
        turn += 1
        dealt = labels.join(heavy, "node", "left").select(F.col("node").alias("a"), "label", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        near = both.join(dealt, ["a", "salt"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        if turn > 2:
            new = spread(staged(new, "lower"), labels.select(F.col("node").alias("low"), F.col("label").alias("next")), "low", "node").select("node", F.least("low", "next").alias("low"), "was")
        new = staged(new.select("node", F.col("low").alias("label"), (F.col("low") < F.col("was")).alias("changed")), "labels")
        labels = new.drop("changed")
        if not new.filter("changed").limit(1).count():
            return labels


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that stand together with equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        if held and tuple(held[0].column(k)[0].as_py() for k in keys) != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for i in range(1, len(values)):
            if values[i] != values[i - 1]:
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, start = [], i
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def opened(members: DataFrame) -> DataFrame:
    """members (bucket, node, label, main, size) of the buckets whose members are of two components or more, with `blocks`, the number of blocks that such a bucket fills."""
    open_ = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("lo < hi")
    return spread(members, open_.select("bucket", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "bucket", "node")


def crossing(members: DataFrame, contents: DataFrame, labels: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b, similarity, the labels la and lb) of similarity 0.8 or more that join different components within a bucket.

    members: bucket, node, leader, size (bytes of its set). Pairs with a bucket's leader were verified before, so a bucket counts if its other members are of
    two components or more. Members outside the leader's component meet all other members, in blocks of at most BLOCK members (about BLOCK_BYTES), so a task
    holds two blocks. Within two blocks, pairs whose sketches agree in LEAST_AGREE coordinates are compared on whole sets, the most alike first, unless
    links found there have joined their components already: those links are all that leaves the task.

    A bucket of n members in blocks sends each member out once for each block, whatever its size: no pair is left out because a bucket is large. The work of
    a bucket whose members stay apart is quadratic, in tasks of two blocks.
    """
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = labelled.filter("node = leader").select("bucket", F.col("label").alias("main"))
    inside = staged(opened(spread(labelled.filter("node != leader").select("bucket", "node", "label", "size"), main, "bucket", "node")), "inside")
    blocked = inside.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rest = blocked.filter("label != main").withColumn("other", every).select("bucket", "node", "label", F.col("block").alias("i"), F.col("other").alias("j"), F.lit(True).alias("first"))
    all_ = blocked.withColumn("other", every).select("bucket", "node", "label", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(False).alias("first"))
    dealt = rest.unionByName(all_).join(contents.select("node", "sketch").join(sets, "node"), "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["bucket", "i", "j"]):
            first = np.asarray(group.column("first"))
            node, label = (group.column(c).to_pylist() for c in ("node", "label"))
            sketch = np.stack([np.frombuffer(v.as_buffer(), "<u2") for v in group.column("sketch")])
            cells = lambda k, own=group.column("cells"): unpacked_set(own[int(k)].as_buffer())
            x, y = np.flatnonzero(first), np.flatnonzero(~first)
            joined = {v: v for v in label}

            def root(v: bytes, joined=joined) -> bytes:
                while joined[v] != v:
                    joined[v] = joined[joined[v]]
                    v = joined[v]
                return v

            found = []
            for a in x if len(y) else ():
                agree = (sketch[y] == sketch[a]).sum(axis=1)
                order = np.argsort(-agree, kind="stable")
                for k in y[order[: int((agree >= LEAST_AGREE).sum())]]:
                    p, q = root(label[a]), root(label[k])
                    if p != q and (s := similarity(cells(a), cells(k), least)) >= least - 1e-9:
                        joined[max(p, q)] = min(p, q)
                        found.append((*sorted((node[a], node[k])), s, label[a], label[k]))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary()))], names=["a", "b", "similarity", "la", "lb"])
        forget()

    return dealt.mapInArrow(run, "a binary, b binary, similarity double, la binary, lb binary")


class Classes(NamedTuple):
    """rows: id, text_hash, label, class_id, n_links, similarity for each document; links: a, b, similarity of the texts (nodes) found alike; row_counts: row (id, text_hash), n."""

    rows: DataFrame
    links: DataFrame
    row_counts: DataFrame


def classified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", weights: str = "count") -> Classes:
    """See near_duplicates()."""
    signed = staged(signatures(docs, id_column, text_column, weights).select(F.struct("id", "text_hash").alias("row"), "node", "keys", "sketch"), "signatures")
    row_counts = staged(signed.groupBy("row").agg(F.count("*").alias("n")), "rows")
    contents = staged(signed.groupBy("node").agg(F.min("row.id").alias("id"), F.min("row").alias("row"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch")), "contents")
    bands = contents.select("node", F.explode("keys").alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = staged(spread(bands, sizes, "bucket", "node", counts=sizes, total=BANDS * contents.count()), "buckets")
    scores = shared.groupBy("node").agg(F.sum("n").alias("score"))
    named = scores.select("node").join(contents.select("node", "row"), "node")
    sets = staged(cell_sets(docs, named, row_counts, id_column, text_column, weights).dropDuplicates(["node"]), "sets")
    scored = staged(shared.join(scores, "node").join(sets.select("node", F.octet_length("cells").alias("size")), "node").withColumn("salts", F.ceil(F.col("n") / HEAVY_LEAST).cast("int")).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")), "scored")
    leaders = scored.groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("leader"), F.max("salts").alias("salts")).select("bucket", "leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    members = staged(scored.join(leaders, ["bucket", "salt"]).select("bucket", "node", "leader", "size"), "led")
    links = staged(verified(members.filter("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), sets), "links")
    labels = components(links.select("a", "b"))
    more = staged(crossing(members, contents, labels, sets), "links")
    if more.limit(1).count():  # components of components: few, as most copies have found their class
        above = components(more.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = contents.select("node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        labels = staged(spread(labels, above, "label", "node", "left").select("node", F.coalesce("above", "label").alias("label")), "labels")
        links = links.unionByName(more.select("a", "b", "similarity")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()
    linked = links.select(F.explode(F.array("a", "b")).alias("node"), "similarity").groupBy("node").agg(F.count("*").alias("n_links"), F.max("similarity").alias("similarity"))
    classes = contents.select("node", "id").join(labels, "node", "left").join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classes.groupBy("label").agg(F.min("id").alias("class_id"))
    by_node = spread(classes.drop("id"), least, "label", "node").select("node", "label", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "similarity")
    rows = spread(signed.select("row", "node"), by_node, "node", "row").select("row.*", "label", "class_id", "n_links", "similarity")
    return Classes(rows, links, row_counts)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", weights: str = "count") -> DataFrame:
    """id, class_id (the least id of its class), n_links and similarity for each document: a class is a connected component of equal texts and pairs of similarity 0.8 or more.

    A shingle of five words weighs as often as it stands in the text (`weights`: or 1 + the logarithm of that, or 1), in the signature and in the
    verification. Equal texts (lower case, white space aside) are one node from the start. Nodes that share a band are a bucket. First each member is
    compared with its bucket's leader, the member that shares most buckets with most nodes: copies of one text find that text. Then members that are still
    apart are compared with the rest of their bucket in blocks (see crossing). Every link is verified on whole sets. n_links: verified links of the
    document's text with other texts, enough to join the class and not all there are; similarity: that of the best of them, null without any.

    Texts without a word (null and empty ones too) are equal to each other; texts of fewer than five words are one shingle; null ids take part as rows and
    come last as a class's least id; repeated rows are copies; rows that share an id but not a text are documents of their own; leaders of equal score: the
    larger hash; an empty table gives no rows; other columns aren't read. A very long text is read whole, in a batch of its own.

    Two steps are probable and not exact: a pair of similarity 0.8 shares a band in 99.995 of 100 cases; and within blocks, pairs whose sketches agree in fewer
    than LEAST_AGREE coordinates (four standard deviations below) aren't compared.
    """
    return classified(docs, id_column, text_column, weights).rows.drop("text_hash", "label")


def first_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of docs for each class of near_duplicates(), with all its columns: the one of the least id (null ids last), then of the least text hash; of identical rows, one.

    Rows are told apart by id and text hash, so a text of its own stays whatever other rows have its id. Rows meet the list of those that leave, which is the
    hashed side (at most one narrow row for each row of a partition); a row that is repeated very often is dealt over salts. An empty table gives no rows.
    """
    found = classified(docs, id_column, text_column)
    rows = found.rows.select(F.struct("id", "text_hash").alias("row"), "label").groupBy("row").agg(F.any_value("label").alias("label"), F.count("*").alias("n"))
    least = rows.groupBy("label").agg(F.min(F.struct(F.col("row.id").isNull(), "row"))["row"].alias("stays"))
    marks = spread(rows, least, "label", "row").select("row", "n", (F.col("row") != F.col("stays")).alias("leaves"))
    marks = staged(marks.filter("leaves OR n > 1").select(F.col("row").alias("__row"), F.col("n").alias("__n"), "leaves"), "marks")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.struct(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("text_hash")).alias("__row"), F.monotonically_increasing_id().alias("__at"))
    stay = spread(own, marks, "__row", "__at", "left", counts=found.row_counts.select(F.col("row").alias("__row"), "n"), hashed=True).filter("leaves IS NULL OR NOT leaves")
    single = stay.filter("__n IS NULL").select("__doc.*")
    if not marks.filter("NOT leaves").limit(1).count():
        return single
    return single.unionByName(stay.filter("__n > 1").groupBy("__row").agg(F.first("__doc").alias("__doc")).select("__doc.*"))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
