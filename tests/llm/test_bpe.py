"""The transducer against the public library over every text, and exact round trips."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from storyloom.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PATTERN = regex.compile(P.PATTERN)


@pytest.fixture(scope="module")
def machine():
    return bpe.Transducer(RANKS)


def test_query_equals_the_library(spark):
    root = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got = queries.op7_bpe(spark, root).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    one = bpe.transducer(PATH)
    ids = bpe.encode(text.encode("utf-8", "replace"), PATTERN, one)
    assert ids == LIBRARY.encode_ordinary(text.encode("utf-8", "replace").decode())


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 50255), st.integers(0, 50255))
def test_stable_pairs_by_the_definition(a, b):
    one = bpe.transducer(PATH)
    left, right = one.bytes_of[a], one.bytes_of[b]
    assert one.stable(a, b) == (bpe.merge(left + right, RANKS) == [left, right])


def test_long_pieces_and_small_store(machine, monkeypatch):
    texts = ["a" * 5000, "ab" * 3000, " " * 4000, "=" * 3000, "the" * 2000, "日本語" * 900, "<|endoftext|>"]
    monkeypatch.setattr(bpe, "STATES", 4)
    for text in texts:
        machine._empty()
        machine.pieces.clear()
        machine.older.clear()
        assert bpe.encode(text.encode(), PATTERN, machine) == LIBRARY.encode_ordinary(text)


def test_tokens_leave_before_the_piece_ends(machine):
    machine._empty()
    members, out = machine.sets[0], []
    for b in b"qzqzqzqzqzqzqzqz":
        members, new = machine.move(members, b)
        out.extend(new)
    assert len(out) >= 3


@given(st.text(max_size=40), st.integers(1, 5))
def test_utf8_stream(text, size):
    raw = text.encode("utf-8", "replace")
    stream = bpe.Utf8Stream()
    parts = [stream.feed(raw[i:i + size]) for i in range(0, len(raw), size)] + [stream.close()]
    assert "".join(parts).encode() == raw


def test_cut_characters_wait():
    stream = bpe.Utf8Stream()
    assert [stream.feed(bytes([b])) for b in "é€😀".encode()] == ["", "é", "", "", "€", "", "", "", "😀"]
    assert stream.feed(b"\xe2\x82") == "" and stream.close() == "�"


def test_odd_rows(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, None, 1), (2, "", 1), (None, "x y", 1), (3, "x y", 1), (3, "x y", 1)],
                                 "doc_id long, text string, n_tokens int")
    got = bpe.round_trip(docs, ["doc_id"], PATH, P.PATTERN, with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, tuple(r.ids)) for r in got) == [
        (0, 2, (87, 331)), (2, 0, ()), (3, 2, (87, 331)), (3, 2, (87, 331)), (big, 0, ())]
    assert bpe.round_trip(docs.where("false"), ["doc_id"], PATH, P.PATTERN).count() == 0
