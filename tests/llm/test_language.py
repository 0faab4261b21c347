"""Held-out accuracy on the tables, spans of mixed texts, Viterbi against trying every labelling."""

from collections import Counter
from itertools import product

import numpy as np

from storyloom.llm import language, queries


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got = queries.op5_language(spark, root).collect()
    assert len(got) == len(lang) and any(r.held_out for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 5, 1, 5])
    scores = rng.normal(size=(lengths.sum(), 3)) * 2
    got, at = language.viterbi(scores, lengths, 1.5), 0
    value = lambda labels, s: sum(s[i, k] for i, k in enumerate(labels)) - 1.5 * sum(a != b for a, b in zip(labels, labels[1:]))
    for n in lengths:
        mine = scores[at:at + n]
        best = max((value(x, mine) for x in product(range(3), repeat=int(n))), default=0)
        assert abs(value(got[at:at + n], mine) - best) < 1e-9
        at += n


def test_spans_scripts_and_odd_rows(spark):
    rows = [("the cat and the dog were there with them " * 20, "en"), ("der hund und die katze sind nicht hier " * 20, "de"),
            ("собака и кошка были там вместе " * 20, "ru")]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    mixed = "the dog and the cat were there with them and the dog der hund und die katze sind nicht hier und der hund"
    docs = spark.createDataFrame(
        [(1, mixed, "x"), (2, None, "x"), (3, "12 !? ²", "x"), (4, "", None), (5, "кошка и собака", "x"), (5, "кошка и собака", "x"),
         (None, "the " * 30000, "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language.label(docs, model, ["doc_id"]).collect()}
    assert [(s.lang, s.first) for s in got[1].spans] == [("en", 0), ("de", 12)]
    assert [got[i].lang_pred for i in (2, 3, 4, 5, None)] == ["und", "und", "und", "ru", "en"] and got[2].score == 0
    assert language.label(docs, model, ["doc_id"]).count() == 7
    empty = language.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language.label(docs, empty, ["doc_id"]).collect()} == {"und"}
    assert language.label(docs.where("false"), model, ["doc_id"]).count() == 0


def test_two_hundred_languages(spark):
    rng = np.random.default_rng(6)
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnop"), 5)) + f"{chr(97 + k % 26)}{chr(97 + k // 26)}q"
    speech = {f"l{k:03d}": [word(k) for _ in range(6)] for k in range(200)}
    rows = [(" ".join(rng.choice(w, 80)), name) for name, w in speech.items()]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(name, " ".join(w)) for name, w in speech.items()], "want string, text string")
    got = language.label(docs, model, ["want"]).collect()
    assert len(got) == 200 and all(r.lang_pred == r.want and r.evidence > 0 for r in got)


def test_counts_and_word_scores_equal_the_definition(spark):
    """Laplace-smoothed log probabilities of all 2- to 5-byte stretches of the words with their edges."""
    rows = [("ab abc", "x"), ("ab", "x"), ("bé b", "y"), (None, "y"), ("zz", None)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))

    def grams(word):
        raw = b" " + word.encode() + b" "
        return [raw[i:i + n] for n in language.GRAMS for i in range(len(raw) - n + 1)]
    counts = {k: Counter(language._grams([w])[0][j] for t, lang in rows if lang == k and t for w in t.split() for j in range(len(grams(w))))
              for k in ("x", "y")}
    for word in ("ab", "abc", "bé", "new"):
        bins = language._grams([word])[0].tolist()
        assert len(bins) == len(grams(word))
        got, n = model.scores([word])
        want = [sum(np.log((counts[k][b] + 0.5) / (counts[k].total() + 0.5 * language.BINS)) for b in bins) for k in ("x", "y")]
        assert n[0] == len(bins) and np.allclose(got[0], want)
