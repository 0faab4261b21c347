"""Periodic runs against the definition: every stretch of every period, smallest periods only."""

import hashlib
import zlib

import numpy as np
import pytest

from storyloom.llm import periodic, queries


def brute(words):
    """(start, length, period) of all runs, by start and period."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    smallest = lambda s, n, q: not any(all(words[k] == words[k + p] for k in range(s, s + n - p)) for p in range(1, q))
    return sorted((r for r in found if smallest(*r)), key=lambda r: (r[0], r[2]))


def described(doc_id, text):
    """The columns of the contract, straight from its words."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_all_runs(seed):
    rng = np.random.default_rng(seed)
    for _ in range(300):
        n = int(rng.integers(0, 90))
        words = rng.integers(0, 1 + seed, n)
        if n > 8 and rng.random() < 0.6:
            a, p = int(rng.integers(0, n)), int(rng.integers(1, max(2, n // 4)))
            words[a:] = np.resize(words[a:a + p], n - a)
        start, length, period = periodic.find_runs(words)
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == brute(words.tolist())


def test_wavelet_tree_counts_and_selects():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = periodic.Wavelet(values)
        low = rng.integers(0, n, 50)
        high = low + 1 + rng.integers(0, n, 50) % (n - low)
        value = rng.integers(0, n, 50)
        assert tree.below(low, high, value).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, value)]
        rank = value % (high - low)
        assert tree.ranked(low, high, rank).tolist() == [int(np.sort(values[a:b])[r]) for a, b, r in zip(low, high, rank)]


def test_texts_beside_each_other_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(periodic, "WORDS", 50)
    texts = ["a " * 3, "a " * 3, None, "", " \n", "ab ab ab ab ab ab x", "x y " * 20, "x y " * 20, "q w e r t " * 9 + "q w",
             "é ü é ü é ü é ü", "one two three", "a\tb\x0bc a b c a b c a b c"]
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)] + [(3, "z " * 9, None, 2), (3, "z " * 9, None, 2), (None, "k l " * 8, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, runs int")
    got = sorted((str(r) for r in periodic.runs(docs, ["doc_id"], key="doc_id", made_periodic=True).collect()))
    named = periodic.runs(docs, ["doc_id"]).columns
    want = [dict(zip(named, (i, *described(i, t)))) for i, t, *_ in rows]
    assert got == sorted("Row(" + ", ".join(f"{k}={v!r}" for k, v in w.items()) + ")" for w in want)
    assert periodic.runs(docs.where("false"), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        periodic.runs(docs, ["start"])


def test_runs_themselves_and_a_very_long_text(spark):
    rng = np.random.default_rng(1)
    head = " ".join(f"w{i}" for i in rng.integers(0, 50, 200_000))
    part = " ".join(f"p{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, head + " " + " ".join([part] * 5) + " end")], "doc_id long, text string")
    row = periodic.runs(docs, ["doc_id"], with_runs=True).first()
    assert (200_000, 100_000, 20_000) in [tuple(r) for r in row.runs]
    assert (row.start, row.length, row.period, row.exponent_milli) == (200_000, 100_000, 20_000, 5000) and row.n_runs == len(row.runs)


def test_query_on_tables(spark):
    root = "/root/testdata/sf0.001"
    rows = [r for r in spark.read.parquet(f"{root}/documents.parquet").collect() if len((r.text or "").split()) < 1500]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic(spark, root).collect()}
    assert all(got[r.doc_id] == described(r.doc_id, r.text) for r in rows)
    assert sum(got[r.doc_id][0] > 0 for r in rows) > 5
