"""Token ids of whole texts, and files of them: bit-plane shuffled, compressed segments with a chunk index."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.shared import drop_at_end, new_folder, partitions, slices, texts_of
from ledgerflow.llm.words import remembered

#: Parts of texts that an encoder remembers lately, and as many from before that it falls back to.
MOST_PARTS = 400_000
#: A text is cut after letters that plain punctuation, a blank or the end follows, and before blanks that follow another character; no word of a tokenizer
#: reaches over such a place, and what stands before it has no say in how the rest is split.
_PARTS = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+(?=[ \n.,;:!?*&%#$|]|\Z)|[ \n]*[^ \n]+|[ \n]+").findall
#: Other white space than blanks and line ends, whose place in words differs between tokenizers.
_OTHER_SPACE = r"[^\S \n]"
#: What an added token begins with, before letters that a tokenizer might fold.
_MARK = re.compile(r"[^\w\s]*")
#: A number stands between parts that go through the library together: letters and plain punctuation never join with it.
_BETWEEN, _TOGETHER = " 0", 400
_PLAIN = re.compile(r"[ \n]*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff!-/:-@\[-`{-~]+").fullmatch


def tokenizer_file(name: str) -> str:
    """A path as it is; else the public tokenizers' file of that name, found on the machine that runs this."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as the tokenizers library gives them for whole texts, as bytes (little-endian unsigned 32-bit integers).

    Texts are made of the same words again and again: each part of a text goes through the library once and is remembered. Texts with other white space
    than blanks and line ends go through it whole, and so do texts that may hold an added token's own text (`<|endoftext|>`): the library gives that token's
    id for it. literal: it gives the ids of the letters instead, so that no text can hold a special id.
    """

    def __init__(self, name: str, most_parts: int = MOST_PARTS, literal: bool = False) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.tokenizer.encode_special_tokens = literal
        marks = {_MARK.match(t.content)[0] or t.content for t in self.tokenizer.get_added_tokens_decoder().values()} - {""}
        self.may_be_whole = re.compile("|".join([_OTHER_SPACE, *map(re.escape, sorted(marks))]), re.IGNORECASE).search
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.most_parts = most_parts
        between = self.whole([_BETWEEN])[0]
        self.between = int.from_bytes(between, "little") if len(between) == 4 else None

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        """For words of letters and plain punctuation: one call for many."""
        if self.between is None:
            return self.whole(words)
        ids = self.whole([_BETWEEN.join(words) + _BETWEEN])[0]
        ends = np.flatnonzero(np.frombuffer(ids, "<u4") == self.between).tolist()
        if len(ends) != len(words):
            return self.whole(words)
        return [ids[4 * a + 4 : 4 * b] for a, b in zip([-1, *ends], ends, strict=False)]

    def learn(self, parts: set[str]) -> None:
        plain = [p for p in parts if _PLAIN(p)]
        other = list(parts.difference(plain))
        for listed, encode in ((plain, self.together), (other, self.whole)):
            for i in range(0, len(listed), _TOGETHER):
                some = listed[i : i + _TOGETHER]
                self.known.update(zip(some, encode(some), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [None if self.may_be_whole(t) else _PARTS(t) for t in texts]
        wanted = set().union(*(x for x in split if x is not None))
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > self.most_parts:
            self.earlier, self.known, new = self.known, {}, wanted
        if self.earlier:
            again = new.intersection(self.earlier)
            self.known.update(zip(again, map(self.earlier.__getitem__, again), strict=True))
            new = new.difference(again)
        self.learn(new)
        find = self.known.__getitem__
        return [b"".join(map(find, x)) if x is not None else self.whole([t])[0] for t, x in zip(texts, split, strict=True)]


_encoders: dict[tuple[str, bool], Encoder] = {}
remembered.append(_encoders)


def encoder(name: str, literal: bool = False) -> Encoder:
    """One per worker: workers serve many tasks."""
    if (name, literal) not in _encoders:
        _encoders[name, literal] = Encoder(name, literal=literal)
    return _encoders[name, literal]


# A segment: whole documents' ids, cut in blocks of a fixed number of ids. A block: its planes, plane by plane, each compressed for itself.


def split_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of ids, lowest first, without empty ones at the end."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    used = 4 - int(np.argmax(octets.any(axis=0)[::-1])) if octets.any() else 0
    if planes == "byte":
        return [octets[:, i].tobytes() for i in range(used)]
    return [row.tobytes() for i in range(used) for row in np.packbits(np.unpackbits(octets[:, i : i + 1], axis=1, bitorder="little").T, axis=1)]


def join_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    for i in range(len(parts) if planes == "byte" else len(parts) // 8):
        if planes == "byte":
            octets[:, i] = np.frombuffer(parts[i], np.uint8)
        else:
            bits = np.frombuffer(b"".join(parts[8 * i : 8 * i + 8]), np.uint8).reshape(8, -1)
            octets[:, i] = np.packbits(np.unpackbits(bits, axis=1)[:, :n], axis=0, bitorder="little")[0]
    return octets.reshape(-1).view("<u4")


def pack_segment(ids: np.ndarray, block_ids: int, planes: str, level: int) -> tuple[bytes, list[int], list[int]]:
    """Payload; per block its number of planes; per plane its compressed bytes."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
    parts, counts = [], []
    for at in range(0, len(ids), block_ids):
        block = [compress(p) for p in split_planes(ids[at : at + block_ids], planes)]
        counts.append(len(block))
        parts += block
    return b"".join(parts), counts, [len(p) for p in parts]


def unpack_segment(payload: bytes, n_ids: int, block_ids: int, planes: str, counts: list[int], sizes: list[int]) -> np.ndarray:
    import zstandard

    undo, out, plane, at = zstandard.ZstdDecompressor().decompress, [], 0, 0
    for block, count in enumerate(counts):
        parts = []
        for size in sizes[plane : plane + count]:
            parts.append(undo(payload[at : at + size]))
            at += size
        plane += count
        out.append(join_planes(parts, min(block_ids, n_ids - block * block_ids), planes))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


SEGMENTS = "shard int, segment int, first long, n_ids long, block_ids int, planes string, doc_ids array<long>, doc_sizes array<long>, block_planes array<int>, plane_bytes array<int>, payload binary"
_SEGMENTS_ARROW = pa.schema(
    [("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("block_ids", pa.int32()), ("planes", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("block_planes", pa.list_(pa.int32())), ("plane_bytes", pa.list_(pa.int32())), ("payload", pa.binary())]
)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, planes: str = "byte", block_ids: int = 65_536, segment_ids: int = 1 << 19, level: int = 3, shards: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every text, append end_id, and write the ids in ascending id order.

    A shard is a range of document ids; its file holds segments of whole documents (about segment_ids ids; a longer document has one of its own), so that
    readers need no other row. A segment's ids are cut in blocks of block_ids, a block is transposed into bit (or byte) planes, each plane is compressed with
    zstandard, and planes without a set bit at the top are left out. The chunk index stands beside the payload in columns of its own: first id, document
    ids and sizes, planes of each block, bytes of each plane. The files are Parquet with the payload uncompressed, written by Spark's committer: a lost
    executor's task is written again as a whole, and any file system that Spark writes to will do.

    Null texts count as empty (the end id alone); documents with a null id come first; equal ids stay beside each other in any order, and a range may end
    among them, so that an id that most rows have is no task of its own, unless their texts are equal too; an empty table gives files without rows; other
    columns aren't read; a very long text is a segment of its own.
    """
    n = shards or partitions(docs.sparkSession)
    ordered = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).repartitionByRange(n, F.col("id"), F.xxhash64("text")).sortWithinPartitions("id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, end = encoder(tokenizer), TaskContext.get().partitionId(), np.asarray([end_id], "<u4").tobytes()
        held, names, sizes, first, segment, waiting = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal first, segment, waiting
            ids = np.frombuffer(b"".join(held), "<u4")
            payload, counts, lengths = pack_segment(ids, block_ids, planes, level)
            row = [shard, segment, first, len(ids), block_ids, planes, list(names), list(sizes), counts, lengths, payload]
            first, segment = first + len(ids), segment + 1
            held.clear()
            names.clear()
            sizes.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SEGMENTS_ARROW, strict=True)], schema=_SEGMENTS_ARROW)

        for batch in slices(batches, "text"):
            for name, ids in zip(batch.column("id").to_pylist(), encode(texts_of(batch, "text")), strict=True):
                if held and waiting + len(ids) // 4 >= segment_ids:
                    yield flush()
                held.append(ids + end)
                names.append(name)
                sizes.append(len(ids) // 4 + 1)
                waiting += sizes[-1]
        if held:
            yield flush()

    ordered.mapInArrow(write, SEGMENTS).write.option("compression", "none").parquet(folder)


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, segment int"
_DOCUMENTS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("segment", pa.int32())])


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """The files' segments, with `base`: the ids in shards before. One row for each shard is broadcast, whose number the writer was given."""
    rows = spark.read.schema(SEGMENTS).parquet(folder)
    totals = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(bases), "shard")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: for each document its first id's place in the whole, its number of ids, and their CRC."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                ids = unpack_segment(row["payload"], row["n_ids"], row["block_ids"], row["planes"], row["block_planes"], row["plane_bytes"])
                ends = np.cumsum(np.asarray(row["doc_sizes"], np.int64))
                starts = ends - row["doc_sizes"]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                k = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"] + row["base"]), pa.array(row["doc_sizes"], pa.int64()), pa.array(crcs, pa.int64()), pa.array([row["shard"]] * k, pa.int32()), pa.array([row["segment"]] * k, pa.int32())], schema=_DOCUMENTS_ARROW)

    return segments(spark, folder).mapInArrow(read, DOCUMENTS)


def op2_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    drop_at_end(spark, folder)
    return read_documents(spark, folder)
