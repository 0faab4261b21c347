"""Held-out accuracy, and rules as columns against rules read from the trees."""

import numpy as np

from pyspark.sql import functions as F

from storyloom.llm import queries, stats
from storyloom.llm import rule_ensemble as re_


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    rows = queries.op2_rules(spark, root).collect()
    assert len(rows) == spark.read.parquet(f"{root}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95


def test_paths_of_a_description():
    text = """RandomForestClassificationModel: uid=x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 <= -2.0E-4)
      Predict: 0.0
     Else (feature 1 > -2.0E-4)
      Predict: 1.0
    Else (feature 0 > 1.5)
     If (feature 0 <= 3.0)
      Predict: 1.0
     Else (feature 0 > 3.0)
      Predict: 0.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 1.5)
     Predict: 0.0
    Else (feature 0 > 1.5)
     Predict: 1.0
"""
    got = {r.bounds for r in re_.paths(text, ["a", "b"])}
    assert got == {(("a", None, 1.5),), (("a", None, 1.5), ("b", None, -2e-4)), (("a", None, 1.5), ("b", -2e-4, None)),
                   (("a", 1.5, None),), (("a", 1.5, 3.0),), (("a", 3.0, None),)}


def test_score_is_the_sum_of_rules(spark):
    model = re_.RuleModel(-1.0, ((re_.Rule((("a", 0.0, 2.0),)), 2.0), (re_.Rule((("a", None, 1.0), ("b", 5.0, None))), -3.5)))
    rows = spark.createDataFrame([(0.0, 6.0), (1.0, 6.0), (2.0, 6.0), (3.0, 0.0)], "a double, b double")
    got = [r[0] for r in rows.select(model.score()).collect()]
    want = [1 / (1 + np.exp(-x)) for x in (-4.5, -2.5, 1.0, -1.0)]
    assert np.allclose(got, want)


def test_labels_that_teach_nothing(spark):
    names = list(re_.statistics())
    none = spark.createDataFrame([], "label int, " + ", ".join(f"{n} double" for n in names))
    assert re_.train(none) == re_.RuleModel(0.0)
    one = spark.createDataFrame([(1, *[1.0] * len(names)), (None, *[2.0] * len(names))], none.schema)
    assert re_.train(one).intercept > 4


def test_odd_rows(spark):
    """Null as empty, repeated rows alike, a very long text whole, columns of the statistics' own names, an empty table."""
    rng = np.random.default_rng(2)
    good = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(n))
    texts = [good(80) for _ in range(40)] + ["# $ % ! " * 30 for _ in range(40)] + [None, "", " \n", good(300_000), good(60)]
    rows = [(i, t, 5.0, "x") for i, t in enumerate(texts)] + [(84, texts[84], 5.0, "x"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _s_n_words double, label string")
    counted = stats.text_counts(docs, ["doc_id"])
    stated = counted.select("doc_id", *[c.alias(n) for n, c in re_.statistics().items()])
    model = re_.train(stated.where("doc_id < 80").withColumn("label", (F.col("doc_id") < 40).cast("int")))
    got = stated.select("doc_id", model.score().alias("score")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert score[80] == score[81] == score[None] and [r.score for r in got if r.doc_id == 84] == [score[84]] * 2
    assert all(score[i] > 0.5 for i in [*range(40), 84]) and all(score[i] < 0.5 for i in range(40, 80))
    assert stats.text_counts(docs.where("false"), ["doc_id"]).count() == 0
