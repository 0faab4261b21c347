"""Hard negatives against every product, boxes and windows included."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import queries, rtree
from tests.compare import compare, connect


def brute(rows, anchors, k=5, low=80, high=100):
    """The contract's answer from all products of all rows."""
    use = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, label, v in rows
           if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for at, (i, label, v) in enumerate(use):
        if i is None or not anchors(i):
            continue
        scored = [(product(v, w), j, m) for n, (j, m, w) in enumerate(use) if n != at]
        best = sorted(((s, j) for s, j, m in scored if m == label), key=order)[:k]
        for ps, pid in best:
            negative = sorted(((s, j) for s, j, m in scored if m != label and low * ps <= 100 * s <= high * ps), key=order)[:k]
            out += [(i, pid, rank + 1, j, ps, s) for rank, (s, j) in enumerate(negative)]
    return out


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("n,dims,leaf", [(1, 3, 4), (70, 2, 4), (500, 8, 16), (333, 5, 7)])
def test_boxes_hold_products_and_search_is_exact(n, dims, leaf):
    rng = np.random.default_rng(n)
    vectors, labels = rng.integers(-9, 9, (n, dims)).astype(np.int32), rng.integers(0, 3, n)
    order = rtree.tiled(vectors, labels, leaf)
    assert sorted(order) == list(range(n))
    vectors, labels = vectors[order], labels[order]
    ids = [[int(i)] for i in order]
    tree = rtree.Tree(vectors, labels, ids, leaf, 3)
    asked = rng.integers(-9, 9, (20, dims)).astype(float)
    least, greatest = tree.bounds(asked)
    products = vectors @ asked.T.astype(int)
    assert (least[:, -1] <= products.min(axis=0)).all() and (greatest[:, -1] >= products.max(axis=0)).all()
    full = 0
    for i, q in enumerate(asked):
        for same in (True, False):
            windows = [(-50, 40), (0, 10), (rtree.NONE, -rtree.NONE - 1)]
            found, opened = tree.search(q, least[i], greatest[i], 1, same, windows, [rtree.NONE] * 3, 4)
            for (low, high), have in zip(windows, found):
                want = sorted((-int(s), False, x[0]) for s, x, m in zip(products[:, i], ids, labels) if (m == 1) == same and low <= s <= high)
                assert have == want[:4]
            full += opened == -(-n // leaf)
    assert n < 100 or full < 40


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = lambda *x: [float(a) for a in x]
    rows = [(i, int(rng.integers(0, 3)), v(*rng.normal(0, 0.02, 4))) for i in range(80)]
    rows += [(100 + i, 1, v(0.5, 0.5, 0.1, 0)) for i in range(12)] + [(100 + i, 2, v(0.5, 0.4, 0.2, 0)) for i in range(12)]  # ties
    rows += [(5, 1, v(0.5, 0.5, 0.1, 0))] * 2 + [(None, 2, v(0.5, 0.4, 0.2, 0)), (None, 1, v(0.5, 0.5, 0.1, 0))]  # repeated rows, null ids
    rows += [(200, None, v(1, 1, 1, 1)), (201, 1, None), (202, 1, [1.0, None, 1.0, 1.0]), (203, 2, v(math.nan, 1, 1, 1)),
             (204, 2, v(math.inf, 0, 0, 0)), (205, 1, v(0.25)), (210, 1, []), (215, 7, v(1, 1, 1, 1))]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, q int, score string")
    near = [(i, m, w and [x if x is None else float(np.float32(x)) for x in [*w, 0, 0, 0, 0][:4]] if w is not None else None) for i, m, w in rows]
    near = [(i, m, [0.0] * 4 if w == [] else w) for i, m, w in near]
    have = got(rtree.hard_negatives(frame, F.col("vec_id") % 5 == 0))
    want = sorted(brute(near, lambda i: i % 5 == 0), key=str)
    assert have == want and len(want) > 100
    assert got(rtree.hard_negatives(frame.where("false"), F.col("vec_id") % 5 == 0)) == []
    assert got(rtree.hard_negatives(frame, F.col("vec_id") < 0)) == []


def test_many_parts_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(rtree, "TASK", 20)
    centre = rng.normal(0, 1, (6, 6))
    rows = [(i, i % 4, (centre[i % 6] + rng.normal(0, 0.2, 6)).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    have = got(rtree.hard_negatives(frame, F.col("vec_id") % 60 == 0))
    assert have == sorted(brute(rows, lambda i: i % 60 == 0), key=str)


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [float(60000 + i), -65536.0 + i, 1e30 * (i % 3 == 0), 3.0]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    held = [(i, m, [max(-65536.0, min(65536.0, x)) for x in w]) for i, m, w in rows]
    assert got(rtree.hard_negatives(frame, F.col("vec_id") % 10 == 0)) == sorted(brute(held, lambda i: i % 10 == 0), key=str)


def test_query_equals_its_sql(spark):
    root = "/root/testdata/sf0.01"
    problem, n = compare(spark, connect(root), "op11_negatives", queries.op11_negatives, queries.SQL["op11_negatives"], root)
    assert problem is None and n > 0
