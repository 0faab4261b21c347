"""Repeated bytes against brute force: every string of the length, counted by itself."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from storyloom.llm import queries, suffix_dedup as sd


def brute(texts, length):
    """(removed bytes, spans, hash of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i:i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (8, 15, 30, 4)]
    texts = [" ".join([word() for _ in range(rng.integers(0, 40))] + [passage[rng.integers(4)]] * int(rng.integers(0, 2))
                      + [word() for _ in range(rng.integers(0, 40))]) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5][3:], "a" * 90, "b" + "a" * 70, "ab" * 60, None, "", "x" * 23, "é" * 40, texts[7] + texts[7]]
    return texts


@pytest.mark.parametrize("length,gram,hot", [(24, 8, 8192), (29, 8, 8192), (40, 16, 8192), (40, 16, 3)])
def test_against_brute_force(spark, monkeypatch, length, gram, hot):
    monkeypatch.setattr(sd, "SLICE", 200)
    texts = corpus(length + hot)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: tuple(r)[1:] for r in sd.remove_repeats(docs, ["doc_id"], length=length, gram=gram, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


@pytest.mark.parametrize("shard", [1, 3, 7, 100])
def test_merged_shards_know_all_repeats(shard):
    rng = np.random.default_rng(shard)
    segments = [bytes(rng.integers(97, 99, rng.integers(24, 60), dtype=np.uint8)) for _ in range(40)] + [b"a" * 60, b"a" * 50, b"ab" * 30]
    counts = np.array([len(s) - 23 for s in segments])
    weights = np.where(np.arange(len(segments)) % 9 == 0, 2, 1)
    got = sd.repeated_starts(segments, np.zeros(len(segments), int), counts, weights, 24, shard)
    seen = Counter()
    for s, w in zip(segments, weights):
        for i in range(len(s) - 23):
            # only places on the same grid are compared: equal anchors stand at equal places
            seen[i % 8, s[i:i + 24]] += w
    assert [f.tolist() for f in got] == [[seen[i % 8, s[i:i + 24]] > 1 for i in range(len(s) - 23)] for s in segments]


def test_query_on_tables(spark):
    root = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{root}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op1_suffix_dedup(spark, root).collect()}
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows], 400)
    assert sum(g[1] for g in got.values()) > 0


def test_text_is_cut_at_characters(spark):
    docs = spark.createDataFrame([(1, "xé" + "é" * 20 + "q"), (2, "y" + "é" * 20 + "ér"), (None, "é" * 5)], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in sd.remove_repeats(docs, ["doc_id"], length=24, gram=8, with_text=True).collect()}
    assert got == {1: "xq", 2: "yr", None: "é" * 5}
    assert sd.remove_repeats(docs.where("false"), ["doc_id"]).count() == 0


def test_texts_share_an_anchor_and_no_string(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    shared = word(300)
    texts = [word(200) + shared + word(200) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sd.remove_repeats(docs, ["doc_id"]).collect()
    assert len(got) == 40 and not any(r.n_removed or r.n_spans for r in got)
