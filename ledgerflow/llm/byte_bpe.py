"""Byte-level BPE from a rank file: texts to ids with places in characters, and ids back to bytes and texts."""

from __future__ import annotations

import base64
import codecs
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from ledgerflow.llm.shared import slices, texts_of
from ledgerflow.llm.token_ids import MOST_PARTS, _OTHER_SPACE, Encoder, tokenizer_file

RANKS = "byte_bpe_50k.tiktoken"
#: What an id that the rank file doesn't have, or a null one, is decoded to.
UNKNOWN = "�".encode()
#: Ids that are decoded together.
IDS_TOGETHER = 1 << 20


def byte_letters() -> dict[int, str]:
    """A printable letter for each byte, as byte-level vocabularies write tokens: bytes that Latin-1 prints stand for themselves, the others follow from 256 on."""
    printed = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}


def read_ranks(name: str) -> dict[bytes, int]:
    """The file's tokens with their ranks, one `base64 rank` a line; name: see tokenizer_file()."""
    with open(tokenizer_file(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def tokenizer_of(ranks: dict[bytes, int]):
    """A tokenizer of the tokenizers library that gives the ids of a rank encoder.

    A rank encoder joins the two neighbours whose bytes together have the lowest rank, however a token came about; so every way to cut a token into two others
    is a merge here, in the order of the whole token's rank. A word that is a token as it stands is that token. Words are the matches of the library's own
    byte-level pattern, which is public_tokenizers.PATTERN.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = byte_letters()
    names = {token: "".join(map(letters.__getitem__, token)) for token in ranks}
    cuts = ((token[:i], token[i:]) for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)))
    merges = [(names[a], names[b]) for a, b in cuts if a in names and b in names]
    made = Tokenizer(models.BPE(vocab={names[t]: rank for t, rank in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return made


class RankEncoder(Encoder):
    """Encoder over a rank file; no text is special."""

    def __init__(self, ranks: dict[bytes, int], most_parts: int = MOST_PARTS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = tokenizer_of(ranks)
        self.may_be_whole = re.compile(_OTHER_SPACE).search
        self.known, self.earlier, self.most_parts = {}, {}, most_parts
        between = self.whole([" 0"])[0]
        self.between = int.from_bytes(between, "little") if len(between) == 4 else None


class ByteTable:
    """The bytes of ids: the byte table reversed."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.n = max(ranks.values(), default=-1) + 1
        self.tokens = [UNKNOWN] * (self.n + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, self.n + 1)
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def known(self, ids: np.ndarray) -> np.ndarray:
        """The ids as places of the table; what it hasn't got is the last place."""
        return np.where((ids >= 0) & (ids < self.n), ids, self.n)

    def bytes_of(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all these places of the table, and where each begins and the last ends."""
        sizes = self.sizes[known]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.starts[known] - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def pieces(self, ids: np.ndarray) -> list[str]:
        """For each id the text that it completes. A character whose bytes are split over ids comes with the last of these; what is no UTF-8 is U+FFFD."""
        decode = codecs.getincrementaldecoder("utf-8")("replace").decode
        found = [decode(self.tokens[i]) for i in self.known(ids)]
        if rest := decode(b"", True):
            found[-1] += rest
        return found


_made: dict[tuple[str, type], object] = {}


def once(name: str, kind: type):
    """One for each worker and rank file: workers serve many tasks."""
    if (name, kind) not in _made:
        _made[name, kind] = kind(read_ranks(name))
    return _made[name, kind]


def places(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of these sizes in bytes, the first character of each and the one after its last. A token that has only some bytes of a character counts
    that character as its own, so that two tokens can share one."""
    octets = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(sizes)
    if len(octets) == len(text):
        return ends - sizes, ends
    character = np.cumsum((octets & 0xC0) != 0x80) - 1  # of each byte
    return character[ends - sizes], character[ends - 1] + 1


def _lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


Batches = Iterator[pa.RecordBatch]


def _encoded(batches: Batches, ranks: str, offsets: bool) -> Batches:
    """From (id, text): id, ids and, if wanted, starts and ends."""
    encoder, table = once(ranks, RankEncoder), once(ranks, ByteTable)
    for batch in slices(batches, "text"):
        texts = texts_of(batch, "text")
        ids = [np.frombuffer(x, "<u4") for x in encoder(texts)]
        sizes = [len(x) for x in ids]
        columns = {"id": batch.column("id"), "ids": _lists(np.concatenate(ids), sizes)}
        if offsets:
            found = [places(t, table.sizes[x]) for t, x in zip(texts, ids, strict=True)]
            columns |= {c: _lists(np.concatenate([f[i] for f in found]), sizes) for i, c in enumerate(("starts", "ends"))}
        yield pa.RecordBatch.from_pydict(columns)


def _in_turn(batches: Batches, column: str) -> Batches:
    """The batches again, cut so that their lists have about IDS_TOGETHER values together."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column(column)), 0)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + IDS_TOGETHER, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _decoded(batches: Batches, ranks: str, pieces: bool, ids_column: str) -> Batches:
    """All columns, decoded and, if wanted, pieces."""
    table = once(ranks, ByteTable)
    for batch in _in_turn(batches, ids_column):
        lists = batch.column(ids_column)
        counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
        ids = np.asarray(pa.compute.fill_null(lists.flatten(), -1))
        data, ends = table.bytes_of(table.known(ids))
        ends = ends[np.concatenate([[0], np.cumsum(counts)])]
        kind, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        columns["decoded"] = pa.Array.from_buffers(kind, batch.num_rows, [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(data)])
        if pieces:
            stops = np.cumsum(counts)
            columns["pieces"] = pa.array([table.pieces(ids[b - n : b]) for b, n in zip(stops, counts, strict=True)], pa.list_(pa.string()))
        yield pa.RecordBatch.from_pydict(columns)


def _own(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), f"id {docs.schema[id_column].dataType.simpleString()}, ids array<int>"


def encode(docs: DataFrame, ranks: str = RANKS, offsets: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of every whole text its id column and `ids`, as a rank encoder without special tokens gives them; offsets: also `starts` and `ends`, the places of
    each id in the text's characters (code points), see places().

    Null and empty texts have no ids. Rows are encoded one by one, so repeated rows, ties and null ids are like others; an empty table gives no rows; other
    columns, whatever their names, aren't read. Batches are cut by bytes of text; a very long text is one batch of its own, and words that a worker has met
    are remembered up to a bound.
    """
    own, schema = _own(docs, id_column, text_column)
    schema += ", starts array<int>, ends array<int>" if offsets else ""
    return own.mapInArrow(lambda batches: _encoded(batches, ranks, offsets), schema).withColumnRenamed("id", id_column)


def decode(tokens: DataFrame, ranks: str = RANKS, pieces: bool = False, ids_column: str = "ids") -> DataFrame:
    """tokens with `decoded`, the bytes of each row's ids; pieces: also `pieces`, the text that each id completes, so that a character which two ids share
    comes once, with the later one, and the pieces of a row make up its text.

    A null list has no bytes; null ids and ids that the rank file hasn't got are U+FFFD. Columns called `decoded` or `pieces` are replaced; other columns pass.
    """
    kept = [c for c in tokens.columns if c not in ("decoded", "pieces")]
    schema = StructType([tokens.schema[c] for c in kept]).add("decoded", BinaryType())
    if pieces:
        schema = schema.add("pieces", ArrayType(StringType()))
    return tokens.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(lambda batches: _decoded(batches, ranks, pieces, ids_column), schema)


def round_trip(docs: DataFrame, ranks: str = RANKS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass over the batches: one worker where two would stand behind each other."""
    own, schema = _own(docs, id_column, text_column)
    run = lambda batches: _decoded(_encoded(batches, ranks, False), ranks, False, "ids")
    return own.mapInArrow(run, f"{schema}, decoded binary").withColumnRenamed("id", id_column)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again: counts and digests of both directions."""
    tokens = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spaced = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spaced.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
