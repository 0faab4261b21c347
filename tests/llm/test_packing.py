"""Pieces against the tokenizers library, packing against its rules and exhaustive search."""

import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from storyloom.llm import packing, queries


def check(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def first_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, b in enumerate(bins) if b + n <= size), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    return len(bins)


def test_query_on_tables(spark):
    root = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want = []
    for d in spark.read.parquet(f"{root}/documents.parquet").collect():
        ids = library.encode(d.text, add_special_tokens=False).ids + [0]
        for i, (s, n) in enumerate(packing.cuts(len(ids), 2048)):
            want.append((d.doc_id, i, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())))
    rows = queries.op6_packing(spark, root).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    used = check(rows, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1


def test_cuts():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)]
    assert packing.cuts(4, 4) == [(0, 4)] and packing.cuts(3, 4) == [(0, 3)] and packing.cuts(0, 4) == []


def test_fullest_is_the_fullest():
    rng = np.random.default_rng(4)
    for _ in range(200):
        size, k = int(rng.integers(1, 30)), int(rng.integers(1, 5))
        lengths = sorted(rng.choice(np.arange(1, 20), k, replace=False).tolist(), reverse=True)
        counts = rng.integers(1, 4, k).tolist()
        sums = [sum(a * b for a, b in zip(lengths, c)) for c in product(*[range(n + 1) for n in counts])]
        got = packing.fullest(lengths, counts, size)
        assert sum(n * c for n, c in got) == max(s for s in sums if s <= size)
        assert all(c <= counts[lengths.index(n)] for n, c in got)


@pytest.mark.parametrize("seed", range(3))
def test_pack_odd_rows(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = [1] * 300 + rng.integers(1, 65, 400).tolist() + [64] * 5
    made = spark.createDataFrame([(i % 7, n, "x") for i, n in enumerate(lengths)], "doc_id long, length long, offset_ string")
    rows = packing.pack(made, 64).collect()
    assert len(rows) == len(lengths) and sorted(r.length for r in rows) == sorted(lengths)
    assert check(rows, 64) <= first_fit(lengths, 64)
    assert packing.pack(made.where("false"), 64).count() == 0


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], "doc_id long, text string")
    made = packing.pieces(docs, "doc_id", P.path("byte_bpe_50k.json"), P.PATTERN, 2048)
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in made.collect()) == [(0, 0, 0, 2), (1, 0, 0, 1), (2, 0, 0, 1), (2, 0, 0, 1)]
    assert check(packing.pack(made, 2048).collect(), 2048) == 1


def test_added_tokens_are_cut_out(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y", "<|endoftext|", "<|<|endoftext|>|>", "it's<|endoftext|>'s é",
             "<|ENDOFTEXT|>", "plain  \n text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(docs, "doc_id", P.path("byte_bpe_50k.json"), P.PATTERN, 2048).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
