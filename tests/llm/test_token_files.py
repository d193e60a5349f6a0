from __future__ import annotations

import bisect
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerflow.llm import packing, token_counts, token_ids
from ledgerflow.llm.shared import new_folder


def plain(name: str, literal: bool = False):
    """The library as it is, on whole texts."""
    library = Tokenizer.from_file(token_ids.tokenizer_file(name))
    library.encode_special_tokens = literal
    return lambda texts: [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


LETTERS = "ab é\n '’sS.,!\u0301ſΣσ12\t -_中\r0<|>"
PARTS = st.lists(st.one_of(st.text(LETTERS, max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " <|endoftext|> ", "<|endof", "the end", " of text"])), max_size=6).map("".join)


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_give_the_ids_of_whole_texts(name, literal):
    encode, whole = token_ids.Encoder(name, most_parts=500, literal=literal), plain(name, literal)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(PARTS, max_size=5))
    def check(texts):
        assert encode(texts) == whole(texts)

    check()
    odd = [t for _, t in ODD if t] + ["a 0 b 0", "0", " 0 0", "<|endoftext|> x", "hello <|endoftext|> x"]
    assert encode(odd) == whole(odd)
    assert (len(encode(["<|endoftext|>"])[0]) == 4) != literal


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 100, 1001])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 70_000, n).astype("<u4")
    payload, counts, sizes = token_ids.pack_segment(ids, 100, planes, 3)
    assert (token_ids.unpack_segment(payload, n, 100, planes, counts, sizes) == ids).all()


def expected_ids(rows, name, end, literal=False):
    whole = plain(name, literal)([t or "" for _, t in rows])
    return [(d, np.frombuffer(w + np.asarray([end], "<u4").tobytes(), "<u4")) for (d, _), w in zip(rows, whole, strict=True)]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_hold_every_document_in_order(spark, planes):
    rows = [r for r in ODD if r[0] is not None][:7] + [(90, "a <|endoftext|> b"), (91, "<|startoftext|>")] + [(100 + i, f"doc {i} " * i) for i in range(60)] + [(8, "long " * 9000)]
    folder = new_folder(spark, "test")
    token_ids.write_token_files(table(spark, rows), folder, planes=planes, segment_ids=200, block_ids=64, shards=4)
    got = sorted(map(tuple, token_ids.read_documents(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    at, want = 0, []
    for d, ids in sorted(expected_ids(rows, "byte_bpe_50k.json", 2), key=lambda x: x[0]):
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_token_files_of_odd_and_empty_tables(spark):
    for rows in (ODD, []):
        folder = new_folder(spark, "test")
        token_ids.write_token_files(table(spark, rows).selectExpr("*", "text AS shard", "doc_id AS payload"), folder)
        assert token_ids.read_documents(spark, folder).count() == len(rows)


def test_separator_scan_matches_the_documents(spark):
    rows = ODD + [(90, "a <|endoftext|> b"), (91, "<|endoftext|>")] + [(100 + i, f"doc {i} " * i) for i in range(80)]
    folder = new_folder(spark, "test")
    manifest = token_counts.write_flat_files(table(spark, rows), folder)
    counts = token_counts.document_counts(token_counts.scan_blocks(spark, folder, 49_407, block_ids=37), chunk_ids=111).toPandas()
    names = {(r["file"], r["first"] + i): d for r in manifest.collect() for i, d in enumerate(r["doc_ids"])}
    got = sorted((names[f, n] if names[f, n] is not None else -1, k) for f, n, k in zip(counts["file"], counts["nth"], counts["n_tokens"], strict=True))
    assert got == sorted((-1 if d is None else d, len(ids)) for d, ids in expected_ids(rows, "word_bpe_49k.json", 49_407, literal=True))
    assert counts["ended"].all()
    for _, own in counts.sort_values("nth").groupby("file"):
        assert own["start"].tolist() == [0, *own["n_tokens"].cumsum().tolist()[:-1]]


def test_separator_scan_of_an_unended_file_and_of_none(spark):
    ids = np.asarray([5, 9, 9, 1, 2, 3, 9, 4], "<u2")
    folder = new_folder(spark, "test")
    store, root = token_counts.open_store(folder)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/a.bin") as out:
        out.write(ids.tobytes())
    for size, chunk in ((1, 1), (1, 3), (2, 2), (2, 4), (3, 6), (100, 100)):  # blocks alone and together in a chunk, chunks without an end
        got = sorted(map(tuple, token_counts.document_counts(token_counts.scan_blocks(spark, folder, 9, block_ids=size), chunk).select("nth", "start", "n_tokens", "ended").collect()))
        assert got == [(0, 0, 2, True), (1, 2, 1, True), (2, 3, 4, True), (3, 7, 1, False)]
    none = new_folder(spark, "test")
    token_counts.write_flat_files(table(spark, []), none)
    assert token_counts.document_counts(token_counts.scan_blocks(spark, none, 9)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_runs_are_a_packing(counts):
    runs, n = packing.solve(counts, 64, schemes=((1 / 8, 4), (1 / 4, 8), (1 / 2, 8)))
    content: dict[int, list] = {}
    ranks: dict[int, list] = {}
    for r in runs:
        for i in range(r.count):
            content.setdefault(r.bin + i // r.each, []).append((r.fill + i % r.each * r.length, r.length))
            ranks.setdefault(r.length, []).append(r.rank + i)
    assert sorted(content) == list(range(n))
    for own in content.values():
        own.sort()
        assert [o for o, _ in own] == [sum(x for _, x in own[:i]) for i in range(len(own))]
        assert sum(x for _, x in own) <= 64
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
    assert -(-sum(k * v for k, v in counts.items()) // 64) <= n <= best_fit_decreasing(counts, 64)


def best_fit_decreasing(counts, capacity):
    """Bins of best fit, one piece after the other, longest first."""
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect.bisect_left(rooms, length)
            left = (rooms.pop(at) if at < len(rooms) else capacity) - length
            bisect.insort(rooms, left)
    return len(rooms)


LENGTHS = {
    "uniform": lambda r: r.integers(1, 4097, 200_000),
    "two heaps": lambda r: np.concatenate([r.normal(1400, 100, 150_000), r.normal(2700, 100, 50_000)]),
    "lognormal": lambda r: np.exp(r.normal(5.5, 1.2, 200_000)),
    "one length": lambda r: np.full(200_000, 1300),
    "about a third": lambda r: r.integers(1250, 1450, 200_000),
    "about a quarter": lambda r: r.integers(900, 1300, 200_000),
}


@pytest.mark.parametrize("kind", LENGTHS)
def test_no_more_sequences_than_best_fit(kind):
    lengths = LENGTHS[kind](np.random.default_rng(0)).clip(1, 4096).astype(int)
    counts = dict(Counter(lengths.tolist()))
    began = time.process_time()
    _, n = packing.solve(counts, 4096)
    assert time.process_time() - began < 20
    area = -(-int(lengths.sum()) // 4096)
    assert area <= n <= best_fit_decreasing(counts, 4096)
    assert n <= {"uniform": 1.005 * area, "lognormal": area, "about a third": 66_667, "about a quarter": 56_600}.get(kind, n)


def test_few_pieces_are_packed_as_well_as_can_be():
    """Against all ways to pack them."""

    def fewest(lengths, rooms=()):
        if not lengths:
            return len(rooms)
        ways = [fewest(lengths[1:], (*rooms[:i], r - lengths[0], *rooms[i + 1 :])) for i, r in enumerate(rooms) if r >= lengths[0] and r not in rooms[:i]]
        return min([*ways, fewest(lengths[1:], (*rooms, 20 - lengths[0]))])

    rng = np.random.default_rng(1)
    more = 0
    for _ in range(60):
        lengths = sorted(rng.integers(1, 21, 7).tolist(), reverse=True)
        more += packing.solve(dict(Counter(lengths)), 20)[1] - fewest(tuple(lengths))
    assert more <= 1


def test_packing_places_every_piece(spark):
    rows = ODD + [(100 + i, f"word{i} " * (7 * i % 90)) for i in range(200)]
    got = packing.pack(table(spark, rows).withColumnRenamed("n_chars", "length"), capacity=128).toPandas()
    whole = sorted((-1 if d is None else d, len(i), zlib.crc32(i[:128].tobytes())) for d, i in expected_ids(rows, "word_bpe_49k.json", 1))
    assert len(got) == sum(-(-n // 128) for _, n, _ in whole)
    first = got[got["piece"] == 0]
    assert sorted(first["ids_crc32"]) == sorted(c for *_, c in whole)
    assert (got["start"] == 128 * got["piece"]).all()
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
        assert own["length"].sum() <= 128
    assert got["sequence_id"].nunique() <= 1.02 * -(-got["length"].sum() // 128) + 1
    assert packing.pack(table(spark, [])).count() == 0
