"""The model against its definition over dictionaries, and probabilities that sum to one."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from storyloom.llm import kneser_ney as kn, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [m.translate(kn.LOWER) for m in WORD.findall((text or "").encode())] + [None]


def plain(training):
    """P(w | v) by the formulas, from plain counts."""
    pairs, words = Counter(), Counter()
    for t in training:
        seq = tokens(t)
        words.update(seq)
        pairs.update(zip(["begin", *seq], seq))
    before, after = Counter(w for _, w in pairs), {}
    for (v, _), n in pairs.items():
        after.setdefault(v, Counter())[min(n, 3)] += 1
    total = Counter()
    for (v, _), n in pairs.items():
        total[v] += n

    def discounts(values):
        n = Counter(values)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] and n[k + 1] else 0.5 for k in (1, 2, 3)]
    upper, lower = discounts(pairs.values()), discounts(before.values())
    less = lambda n, d: max(n - d[min(n, 3) - 1], 0) if n else 0
    spread = sum(lower[min(n, 3) - 1] for n in before.values()) / max(sum(before.values()), 1)

    def p(w, v):
        base = less(before[w], lower) / sum(before.values()) + spread / (len(words) + 1) if before else 1 / (len(words) + 1)
        if not total[v]:
            return base
        return (less(pairs[v, w], upper) + sum(upper[k - 1] * c for k, c in after[v].items()) * base) / total[v]
    return p, words


@pytest.mark.parametrize("flush", [50, 10**9])
def test_against_the_definition(spark, monkeypatch, flush):
    monkeypatch.setattr(kn, "TOKENS", flush)
    rng = np.random.default_rng(8)
    words = ["A", "b", "c", "d", "e", "é", "ff", "#", "the"]
    weights = np.arange(1, 10) / 45
    train = [" ".join(rng.choice(words, rng.integers(0, 60), p=weights)) for _ in range(80)] + [None, "", "the " * 600]
    model = kn.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(3))
    p, count = plain(train)
    assert model.tokens == sum(count.values()) and model.words == len(count)
    tests = [*train[:20], "zz a zz", None, "", "unknown", "é é # the"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(tests)], "doc_id long, text string, score int")
    for r in kn.score(docs, model, ["doc_id"]).collect():
        seq = tokens(tests[r.doc_id])
        assert r.n_tokens == len(seq) and r.n_known == sum(count[w] > 0 for w in seq)
        assert math.isclose(r.score, sum(math.log10(p(w, v)) for v, w in zip(["begin", *seq], seq)), abs_tol=1e-8)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (model.tokens + 0.1 * (len(count) + 1))) for w in seq), abs_tol=1e-8)
    for v in ("begin", b"a", b"the", b"nowhere"):
        assert math.isclose(sum(p(w, v) for w in count) + p(b"nowhere", v), 1.0, abs_tol=1e-9)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in kn.score(docs, kn.train(docs.where("false")), ["doc_id"]).collect()}
    assert got[1].score == 0.0 and got[1].base_score == 0.0 and got[None].n_tokens == 1 and got[1].train_tokens == 0


def test_held_out_beats_the_base(spark):
    root = "/root/testdata/sf0.01"
    got = queries.op8_kneser_ney(spark, root).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    assert len(got) == len(texts)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.n_tokens == len(tokens(texts[r.doc_id])) for r in got)


@pytest.mark.parametrize("least", [1, 50, 1 << 20])
def test_blobs_are_summed_as_they_come_beyond_32_bits(monkeypatch, least):
    monkeypatch.setattr(kn, "LEAST", least)
    rng = np.random.default_rng(least)
    want, rows = {}, []
    for _ in range(40):
        w = np.unique(rng.integers(0, 30, 12)).astype(np.uint64)
        n = np.full(len(w), 1 << 31, np.uint64)
        for x in w.tolist():
            want[x] = want.get(x, 0) + (1 << 31)
        rows.append(("word", 3, w.tobytes(), n.tobytes(), b""))
    frame = pd.DataFrame(rows, columns=["kind", "slice", "c0", "c1", "c2"])
    ((at, held),) = kn._slices_of(iter([frame[:13], frame[13:]]))
    assert at == 3 and dict(zip(held["word"][0].tolist(), held["word"][1].tolist())) == want and max(want.values()) > 1 << 32
