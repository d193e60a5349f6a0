"""Token counts of documents in flat token files that have no index: a vectorised search for end-of-document ids, stitched across blocks by running sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.shared import drop_at_end, new_folder, slices, staged, texts_of
from ledgerflow.llm.token_ids import encoder


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path that stand for a Hadoop-style URI, local or remote."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


MANIFEST = "file string, first int, doc_ids array<long>"


def write_flat_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 49_407, width: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One flat file of little-endian ids of `width` bytes for each input partition, an end id after each document; the manifest that is returned names
    each file's documents in order. A task writes beside and renames at its end, so that a repeated task replaces its file as a whole; a task that fails
    takes its unfinished file away.

    Special tokens' own texts are encoded letter by letter: as ids they would be ends that no document has. Null and empty texts are the end id alone; an
    empty table gives no rows (and empty files). Rows with null or repeated ids are documents like others; other columns aren't read; a very
    long text is encoded in a batch of its own.
    """
    top = {2: 1 << 16, 4: 1 << 32}[width]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        name, encode, end, first = f"ids-{TaskContext.get().partitionId():06d}.bin", encoder(tokenizer, literal=True), np.asarray([end_id], "<u4"), 0
        store.create_dir(root, recursive=True)
        beside = f"{root}/_{uuid.uuid4().hex}"
        try:
            with store.open_output_stream(beside) as out:
                for batch in slices(batches, text_column):
                    for ids in encode(texts_of(batch, text_column)):
                        ids = np.concatenate([np.frombuffer(ids, "<u4"), end])
                        if ids.max() >= top:
                            raise ValueError(f"an id needs more than {width} bytes")
                        out.write(ids.astype(f"<u{width}").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int32()), pa.array([batch.column(id_column).to_pylist()], pa.list_(pa.int64()))], names=["file", "first", "doc_ids"])
                    first += batch.num_rows
        except BaseException:  # a generator that is closed early, too
            store.delete_file(beside)
            raise
        store.move(beside, f"{root}/{name}")

    return staged(docs.select(id_column, text_column).mapInArrow(write, MANIFEST), "manifest")


#: Ids of a chunk of blocks, in which running sums begin anew.
CHUNK_IDS = 1 << 30
BLOCKS = "path string, offset long, n_ids long, ends array<int>"


def scan_blocks(spark: SparkSession, folder: str, end_id: int, width: int = 2, block_ids: int = 1 << 20) -> DataFrame:
    """For each block of each file: its number of ids and the places of end ids in it. File lengths come from a listing that reads no content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length").filter("length > 0")
    cut = files.select("path", (F.col("length") / width).cast("long").alias("ids"), F.explode(F.sequence(F.lit(0), F.expr(f"(length div {width} - 1) div {block_ids}"))).alias("block"))
    cut = cut.select("path", (F.col("block") * block_ids).alias("offset"), F.least(F.lit(block_ids), F.col("ids") - F.col("block") * block_ids).alias("n_ids")).repartition(F.col("path"), F.col("offset"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, n in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "n_ids")), strict=True):
                store, at = open_store(path)
                with store.open_input_file(at) as file:
                    ids = np.frombuffer(file.read_at(n * width, offset * width), f"<u{width}")
                ends = np.flatnonzero(ids == end_id).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([offset]), pa.array([n]), pa.array([ends], pa.list_(pa.int32()))], names=["path", "offset", "n_ids", "ends"])

    return cut.mapInArrow(scan, BLOCKS)


def document_counts(blocks: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """For each document of the files: file, nth (from 0), start (ids of the file before it), n_tokens (with the end id), ended.

    A block's first document starts after the last end id in any block before, a running maximum; its number is the running sum of end ids. Both are scans in
    two levels: over the chunks (of chunk_ids ids) of a file and over the blocks of a chunk, on two numbers for each block, so a file of any size is no task
    of its own. Ids after a file's last end id are one more document, with ended = false.
    """
    blocks = staged(blocks.select("path", "offset", "n_ids", F.transform("ends", lambda e: e + F.col("offset")).alias("ends")), "blocks")
    last_of = F.expr("CASE WHEN size(ends) > 0 THEN ends[size(ends) - 1] END")
    facts = blocks.select("path", "offset", F.expr(f"offset div {chunk_ids}").alias("chunk"), (F.col("offset") + F.col("n_ids")).alias("to"), last_of.alias("last"), F.size("ends").cast("long").alias("n"))
    before = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    chunks = facts.groupBy("path", "chunk").agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.max("to").alias("to"))
    by_chunk = before("path").orderBy("chunk")
    chunks = chunks.select("path", "chunk", F.max("last").over(by_chunk).alias("last_before"), F.coalesce(F.sum("n").over(by_chunk), F.lit(0)).alias("n_before"), F.max("to").over(Window.partitionBy("path")).alias("n_all"))
    by_block = before("path", "chunk").orderBy("offset")
    within = facts.select("path", "offset", "chunk", F.max("last").over(by_block).alias("last_within"), F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("n_within"))
    opened = within.join(chunks, ["path", "chunk"]).select("path", "offset", (F.coalesce("last_within", "last_before", F.lit(-1)) + 1).alias("open"), (F.col("n_before") + F.col("n_within")).alias("first"), "n_all")
    stitched = blocks.join(opened, ["path", "offset"])
    rest = stitched.filter("offset + n_ids = n_all").withColumn("from", F.expr("CASE WHEN size(ends) > 0 THEN ends[size(ends) - 1] + 1 ELSE open END")).filter("from < n_all")
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    starts = F.expr("slice(concat(array(open), transform(ends, e -> e + 1)), 1, size(ends))")
    inner = stitched.select(file, "first", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end")))).select("file", (F.col("first") + F.col("pos")).cast("long").alias("nth"), F.col("col.start").alias("start"), (F.col("col.end") - F.col("col.start") + 1).alias("n_tokens"), F.lit(True).alias("ended"))
    return inner.unionByName(rest.select(file, (F.col("first") + F.size("ends")).cast("long").alias("nth"), F.col("from").alias("start"), (F.col("n_all") - F.col("from")).alias("n_tokens"), F.lit(False).alias("ended")))


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flat files of 16-bit ids, counted by a scan of those files; the manifest gives the scan's documents their ids back."""
    folder = new_folder(spark, "flat-ids")
    manifest = write_flat_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    drop_at_end(spark, folder)
    counted = document_counts(scan_blocks(spark, folder, 49_407))
    named = manifest.select("file", F.posexplode("doc_ids").alias("pos", "doc_id"), "first").select("file", (F.col("first") + F.col("pos")).cast("long").alias("nth"), "doc_id")
    return counted.join(named, ["file", "nth"], "left").select("doc_id", "file", "nth", "start", "n_tokens", "ended")
