"""Counts against a plain reading of the rules; outliers against estimates made row by row."""

import re

import numpy as np
from collections import Counter

from storyloom.llm import outliers, queries
from storyloom.llm.stats import COUNTS, counts, repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


def test_counts_by_the_rules():
    for text in ("", " \n\x0b", "a b c a b c", "a a a a", "a a a", "x\nx\n\n x\nx", "é ö ü z # <b>", "\x1c a\x85b",
                 "one two three\none two three\nfour"):
        got = dict(zip(COUNTS, counts(text.encode())))
        assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain(text)[:5]
    rng = np.random.default_rng(1)
    for _ in range(30):
        ids = rng.integers(0, 6, rng.integers(0, 40))
        words = ids.tolist()
        windows = Counter(zip(words, words[1:], words[2:]))
        want = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
        assert set(np.nonzero(repeated(ids))[0]) == want


def test_query_on_tables(spark):
    root = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op10_outliers(spark, root).collect()}
    texts = spark.read.parquet(f"{root}/documents.parquet").collect()
    assert len(rows) == len(texts)
    for d in texts:
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(d.text)
        assert not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{root}/labels.parquet").collect()
    good = [rows[x.doc_id].kept for x in labels if x.quality == 1 and not rows[x.doc_id].base_failed]
    bad = [rows[x.doc_id].kept for x in labels if x.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_planted_outliers_by_group(spark):
    rng = np.random.default_rng(3)
    text = lambda n, extra="": " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) + extra for _ in range(n))
    rows = [(i, text(120), "xx", "s") for i in range(400)] + [(1000 + i, text(120, "##"), "xx", "s") for i in range(60)]
    rows += [(2000 + i, text(90, "##"), "yy", None) for i in range(300)] + [(3000, text(90, "##"), None, "t"), (3001, None, None, None),
                                                                           (3002, "", "xx", "s"), (0, rows[0][1], "xx", "s")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_words int")
    counted = outliers.counted(docs, ["doc_id"])
    got = outliers.judge(counted, outliers.fit(counted)).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r._kept for r in got}
    assert all(kept[i] for i in range(400)) and not any(kept[1000 + i] for i in range(60))
    assert all(kept[2000 + i] for i in range(300)) and not kept[3001] and not kept[3002]
    none = outliers.counted(docs.where("doc_id < 0"), ["doc_id"])
    assert outliers.judge(none, outliers.fit(none)).count() == 0
