"""Edited copies are found, strangers are not; buckets against brute force."""

import numpy as np

from storyloom.llm import media, queries


def test_query_on_tables(spark):
    root = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{root}/pages.parquet").collect()}
    rows = {r.media_id: r for r in queries.op3_media(spark, root).collect()}
    assert {m // 2 for m in rows} == set(pages) and {m for m in rows if m % 2 == 0} == {2 * p for p in pages}
    edits = [m for m in rows if m % 2]
    assert len(edits) > 20 and np.mean([rows[m].class_id == rows[m - 1].class_id for m in edits]) >= 0.9
    for m, r in rows.items():  # nothing else is linked but equal pages
        assert pages[r.class_id // 2] == pages[m // 2]
        assert r.n_links <= 1


def test_odd_pictures(spark):
    page = media.draw(b"x")
    rows = [(1, None), (2, b""), (3, b"P5 3 3 255\n" + bytes(9)), (4, b"GIF89a"), (5, media.write_pgm(np.full((96, 96), 9))),
            (6, media.write_pgm(page)), (7, media.write_pgm(page)), (None, media.write_pgm(page)), (9, media.write_pgm(page[8:88, 8:88] * 0.8)),
            (10, media.write_pgm(page.repeat(4, 0).repeat(4, 1)))]
    pictures = spark.createDataFrame([(k, bytearray(p) if p is not None else None, 0) for k, p in rows], "media_id long, picture binary, n_links int")
    got = {r.media_id: r for r in media.copies(pictures).collect()}
    assert len(got) == len(rows)
    assert [got[i].n_corners for i in (1, 2, 3, 4, 5)] == [0] * 5
    assert got[4].class_id == 4 and got[1].class_id == 1 and got[2].class_id == 1  # null and empty are equal
    assert {got[i].class_id for i in (6, 7, 9, None)} == {6} and got[9].n_links == 1
    assert media.copies(pictures.where("false")).count() == 0


def test_large_bucket_in_parts(spark):
    kinds = [b"same" * 3 + k for k in (b"abcd", b"\x00" * 4, b"\xff" * 4)]
    corner = lambda i, bits: np.array([(i, 0, 0, 0, np.frombuffer(bits, np.uint8))], media._CORNER).tobytes()
    found = spark.createDataFrame([(i, bytearray(corner(i, kinds[i % 3]))) for i in range(90)] + [(90, bytearray())], "node long, corners binary")
    label = list(range(90))
    for r in media.matches(found, block=16, radius=8).collect():
        low, high = sorted((label[r.a], label[r.b]))
        label = [low if x == high else x for x in label]
    assert label == [i % 3 for i in range(90)]


def test_levels_and_radius(spark):
    """Three levels are described, and corners that differ in 15 bits outside one table's key match."""
    which, _, _, level, _, _ = media.describe(np.stack([media.draw(b"p%d" % i) for i in range(40)]))
    assert set(level) == {0, 1, 2} and max(np.bincount(which)) == 20
    rng, rows = np.random.default_rng(3), []
    for i in range(30):
        bits = rng.integers(0, 2, media.BITS)
        far = bits.copy()
        far[24 * np.arange(1, 6) + i % 8] ^= 1  # beyond the first table's three bytes
        far[rng.choice(np.setdiff1d(np.arange(24, 128), 24 * np.arange(1, 6) + i % 8), 10, replace=False)] ^= 1
        rows += [(2 * i + k, bytearray(np.array([(i, 0, 0, 0, np.packbits(b))], media._CORNER).tobytes())) for k, b in enumerate((bits, far))]
    got = {(r.a, r.b) for r in media.matches(spark.createDataFrame(rows, "node long, corners binary")).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(30)}


def test_every_two_corners_of_a_bucket(spark, monkeypatch):
    """A chain in which the first corner is near the second only, repeated corners within a picture, and pieces of output."""
    monkeypatch.setattr(media, "MATCHES", 7)
    step = lambda n: np.packbits([0] * 100 + [1] * n + [0] * (28 - n))
    kinds = [(0, 0), (0, 0), (1, 8), (1, 8), (2, 16), (3, 24), (4, 8)]  # node, bits set
    blob = {n: b"".join(np.array([(i, 0, 0, 0, step(k))], media._CORNER).tobytes() for i, (m, k) in enumerate(kinds) if m == n) for n in range(5)}
    rows = spark.createDataFrame([(n, bytearray(b)) for n, b in blob.items()], "node long, corners binary")
    got = {(r.a, int(4 * r.xa), r.b, int(4 * r.xb)) for r in media.matches(rows, radius=8).collect()}
    want = {(m, i, n, j) for i, (m, x) in enumerate(kinds) for j, (n, y) in enumerate(kinds) if m < n and abs(x - y) <= 8}
    assert got == want
    assert {(r.a, r.b) for r in media.agreed(media.matches(rows, radius=8), votes=2).collect()} >= {(0, 1)}


def test_matches_are_moved_once(spark):
    """By pair, before they are laid into bins; and a pair that every table brings together is given once."""
    corner = np.array([(4, 8, 0, 0, np.arange(16, dtype=np.uint8))], media._CORNER).tobytes()
    found = media.matches(spark.createDataFrame([(n, bytearray(corner)) for n in (1, 2)] * 3, "node long, corners binary").repartition(3))
    assert [(r.a, r.xa, r.b, r.yb) for r in found.distinct().collect()] == [(1, 1.0, 2, 2.0)] and found.count() == 1
    plan = media.agreed(found, votes=1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(a") == 1 and plan.index("Generate") < plan.index("Window") < plan.index("Exchange hashpartitioning(a")
