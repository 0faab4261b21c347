"""Every stage on its own input against a plain version of what it promises."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from storyloom.llm import simhash
from storyloom.llm.common import LOWER, stored

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    out = {"documents": docs}
    for name, stage in cp.STAGES:
        docs = out[name] = stored(stage(spark, docs, ROOT), name)
    return {k: v.collect() for k, v in out.items()} | {"columns": out["passages"].columns}


def shingles(text):
    words = text.encode().translate(LOWER).split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_rows_only_go_and_columns_stay(spark, tables):
    assert tables["columns"] == spark.read.parquet(f"{ROOT}/documents.parquet").columns
    for before, after in itertools.pairwise(["documents", "language", "quality", "near_copies"]):
        assert not Counter(tables[after]) - Counter(tables[before])
    assert {r.doc_id for r in tables["passages"]} <= {r.doc_id for r in tables["near_copies"]}


def test_language_keeps_all_texts_with_letters(tables):
    assert Counter(tables["language"]) == Counter(r for r in tables["documents"] if r.text and any(c.isalpha() for c in r.text))


def test_language_judges_by_what_was_learned(spark):
    words = "the cat and the dog were there with them and so it went on for a while until they left the old house by the sea".split()
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words, k=60)), "en") for i in range(60)]
    rows += [(100, " ".join("".join(rng.choices("qxzjvkwcbfgp", k=9)) for _ in range(60)), None), (101, "12 !?", None), (102, "the dog and the sea", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in cp.with_language(spark, docs, ROOT).collect()}
    assert kept == {*range(60), 102}
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in cp.with_language(spark, nothing, ROOT).collect()} == {*range(60), 100, 102}


def test_quality_drops_what_labels_call_bad(spark, tables):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    kept = {r.doc_id for r in tables["quality"]}
    long_ = [r.doc_id for r in tables["language"] if len(r.text.split()) >= 50]
    good = [d in kept for d in long_ if quality.get(d) == 1]
    bad = [d in kept for d in long_ if quality.get(d) == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_near_copies_by_shingles(tables):
    sets = {r.doc_id: shingles(r.text) for r in tables["quality"]}
    kept = {r.doc_id for r in tables["near_copies"]}
    near, found = Counter(), 0
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    common = Counter(p for ds in where.values() for p in itertools.combinations(sorted(ds), 2))
    for (a, b), n in common.items():
        share = n / len(sets[a] | sets[b])
        near[a], near[b] = max(near[a], share), max(near[b], share)
        found += share >= 0.8
        assert share < 0.8 or not (a in kept and b in kept)
    assert found > 10
    assert all(near[d] >= 0.8 for d in sets if d not in kept)


def test_no_passage_stands_twice(tables):
    seen = Counter()
    for r in tables["passages"]:
        raw = r.text.encode()
        seen.update({raw[i:i + cp.PASSAGE] for i in range(len(raw) - cp.PASSAGE + 1)})
        assert r.n_chars == len(r.text)
    assert max(seen.values()) == 1
    before = {r.doc_id: r.text for r in tables["near_copies"]}
    assert sum(r.text == before[r.doc_id] for r in tables["passages"]) > len(before) / 2


def test_packing_is_gapless_and_whole(tables):
    by = {}
    for r in tables["packing"]:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= cp.SEQUENCE
    assert {r.doc_id for r in tables["packing"]} == {r.doc_id for r in tables["passages"]}


def test_one_of_each_with_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text), (1, text.replace("w7 ", "x7 ")), (2, text.upper()), (2, text.upper()), (None, text), (5, "alone and short"),
            (6, None), (7, ""), (8, " \n"), (None, "nameless")]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, root int")
    got = Counter((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect())
    assert got == Counter([(1, rows[1][1]), (5, "alone and short"), (6, None), (None, "nameless")])
    assert simhash.one_of_each(docs.where("false")).count() == 0


def test_further_columns_may_bear_any_name(spark):
    names = ["score", "spans", "lang_pred", "_t", "k1", "k2", "n_bytes", "kept_text", "letters", "evidence", "node", "root", "_key", "_lang", "levels",
             "keys", "fp", "x0", "_kept", "_row", "anchor"]
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = base.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in cp.STAGES:
        out = stored(stage(spark, docs, ROOT), name)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.select(*out.columns[5:-7]).distinct().count() <= 1
            docs = out
    assert docs.count() > 0


def test_stages_on_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "ab " * 40000, None, "s", 9)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.where("false")):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, ROOT)
            out.collect()
            assert name == "packing" or out.columns == docs.columns
