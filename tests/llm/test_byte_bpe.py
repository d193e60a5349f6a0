from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import ODD, table, written

from ledgerflow.llm import byte_bpe

RANKS = byte_bpe.read_ranks(byte_bpe.RANKS)
ENCODER = byte_bpe.RankEncoder(RANKS, most_parts=500)
TABLE = byte_bpe.ByteTable(RANKS)


@pytest.fixture(scope="module")
def plain():
    """The rank file's own library."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_the_byte_letters_are_printable_and_differ():
    letters = byte_bpe.byte_letters()
    assert len(set(letters.values())) == 256 and all(len(x) == 1 and x.isprintable() for x in letters.values())
    assert letters[ord("a")] == "a" and letters[0x20] == "Ġ" and letters[0x0A] == "Ċ"


ODD_LETTERS = "ab 's.\n\t0aé中文あ\U0001f600‍  ١ि̀﻿\x00<|endoftext|>"


@given(st.one_of(st.text(alphabet=ODD_LETTERS, max_size=40), st.text(max_size=40), st.lists(st.sampled_from(sorted(RANKS)), max_size=10).map(lambda x: b"".join(x).decode("utf-8", "replace"))))
@settings(max_examples=1500, deadline=None)
def test_ids_are_those_of_the_rank_files_library(plain, text):
    ids = np.frombuffer(ENCODER([text])[0], "<u4")
    assert ids.tolist() == plain.encode_ordinary(text)
    assert TABLE.bytes_of(TABLE.known(ids))[0].tobytes().decode() == text
    pieces = TABLE.pieces(ids) if len(ids) else []
    assert "".join(pieces) == text and len(pieces) == len(ids)
    starts, ends = byte_bpe.places(text, TABLE.sizes[ids]) if len(ids) else ((), ())
    at = np.cumsum([0, *(len(c.encode()) for c in text)])
    done = 0
    for i, a, b in zip(ids, starts, ends, strict=True):
        size = len(TABLE.tokens[i])
        touched = [k for k in range(len(text)) if at[k] < done + size and at[k + 1] > done]
        assert (a, b) == (touched[0], touched[-1] + 1)
        done += size


def test_long_words_are_joined_like_the_library_joins_them(plain):
    rng = random.Random(3)
    for letters in ("a", "ab", "aab ", "=-", "é", "中文"):
        for _ in range(200):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
            assert np.frombuffer(ENCODER([text])[0], "<u4").tolist() == plain.encode_ordinary(text)


def test_query_by_the_rank_files_library(spark, sf, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op13_byte_bpe(spark, sf).collect()}
    ids = {k: plain.encode_ordinary(t) for k, t in texts.items()}
    assert got == {k: (len(ids[k]), sha(" ".join(map(str, ids[k])).encode()), sha(t.encode())) for k, t in texts.items()}


def test_odd_and_empty_tables(spark, tmp_path, plain):
    rows = [*ODD, (9, "<|endoftext|>  x\xa0y"), (10, "naïve 😀 text, " * 200_000)]
    clash = table(spark, rows).selectExpr("*", "1 AS ids", "'x' AS id", "2 AS decoded", "3 AS starts")
    got = byte_bpe.op13_byte_bpe(spark, written(spark, tmp_path, documents=clash)).collect()
    want = []
    for doc_id, text in rows:
        ids = plain.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    key = lambda frame: sorted(map(str, frame.select("doc_id", "ids", "decoded").collect()))
    assert key(byte_bpe.round_trip(clash)) == key(byte_bpe.decode(byte_bpe.encode(clash)))
    none = byte_bpe.encode(table(spark, []), offsets=True)
    assert none.columns == ["doc_id", "ids", "starts", "ends"] and byte_bpe.decode(none).count() == 0


def test_offsets_and_pieces_as_dataframes(spark):
    docs = table(spark, [(1, "naïve 😀😀 中文字"), (2, None), (3, "plain words"), (3, "plain words")])
    rows = byte_bpe.decode(byte_bpe.encode(docs, offsets=True), pieces=True).collect()
    assert len(rows) == 4
    for r in rows:
        text = {1: "naïve 😀😀 中文字", 2: "", 3: "plain words"}[r.doc_id]
        assert bytes(r.decoded).decode() == text == "".join(r.pieces)
        assert len(r.ids) == len(r.starts) == len(r.ends) == len(r.pieces)
        assert all(a < b <= len(text) for a, b in zip(r.starts, r.ends, strict=True))
    whole = next(r for r in rows if r.doc_id == 1)
    assert len({(a, b) for a, b in zip(whole.starts, whole.ends, strict=True)}) < len(whole.ids)  # ids that share a character


def test_ids_that_the_file_has_not_got(spark):
    rows = spark.createDataFrame([([1, None, 10**6, -5],), (None,), ([],)], "ids array<int>")
    got = sorted(bytes(r.decoded) for r in byte_bpe.decode(rows, pieces=True).collect())
    assert got == [b"", b"", next(t for t, k in RANKS.items() if k == 1) + 3 * byte_bpe.UNKNOWN]


def test_lists_are_decoded_in_turn(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "IDS_TOGETHER", 3)
    batch = next(iter(byte_bpe.encode(table(spark, [(i, "some words here and there") for i in range(7)])).coalesce(1).toArrow().to_batches()))
    parts = list(byte_bpe._in_turn(iter([batch]), "ids"))
    assert sum(p.num_rows for p in parts) == 7 and len(parts) == 7
