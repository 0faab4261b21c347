"""SimHash against brute force: every fingerprint by its definition, every pair compared."""

import numpy as np
import pytest
import xxhash

from storyloom.llm import queries, simhash
from storyloom.llm.common import LOWER, components


def plain_fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and (prints[i] ^ prints[j]).bit_count() <= 2:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
                    changed = True
    out = []
    for i, (key, _) in enumerate(rows):
        named = [k for (k, _), x in zip(rows, label) if x == label[i] and k is not None]
        out.append((key, f"{prints[i]:016x}", min(named, default=None)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, 400))) for i in range(40)]
    rows += [(100 + i, t.replace("w1 ", "W1\n ", 1) if i % 2 else t + " end") for i, (_, t) in enumerate(rows)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one two"), (204, "One  TWO"), (204, "One  TWO"), (None, "a b c d")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, fp string")
    got = [tuple(r) for r in simhash.near_duplicates(docs).selectExpr("doc_id", "lower(hex(fp))", "component_id").collect()]
    assert sorted(got, key=str) == plain_components(rows)


@pytest.mark.parametrize("bits,radius", [(64, 2), (64, 0), (256, 40)])
def test_vertical_comparison(bits, radius):
    rng = np.random.default_rng(bits + radius)
    fps = rng.integers(0, 256, (150, bits // 8), dtype=np.uint8)
    fps[75:] = fps[:75]
    for i in range(75, 150):
        for b in rng.integers(0, bits, i % (radius + 3)):
            fps[i, b // 8] ^= 1 << (b % 8)
    a, b = simhash.close(fps, radius)
    wide = np.unpackbits(fps, axis=1).astype(int)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if abs(wide[i] - wide[j]).sum() <= radius}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_large_bucket_is_cut_without_loss(spark):
    fps = [(i, (i % 40).to_bytes(8, "big")) for i in range(300)]
    nodes = spark.createDataFrame([(i, bytearray(f), [b"same"]) for i, f in fps], "n long, fp binary, keys array<binary>")
    roots = {r.node: r.root for r in components(simhash.link(nodes, "n", 1, block=32)).collect()}
    assert len(roots) == 300 and set(roots.values()) == {0}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_query_on_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op9_simhash(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=str) == plain_components(rows)


def test_near_copies_at_the_limit(spark):
    """Pairs at and just above 0.8 are linked, pairs just below are not; repeated lines do not count."""
    def share(a, b):
        a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
        return len(a & b) / len(a | b)
    rng, rows, want = np.random.default_rng(17), [], set()
    for i in range(200):
        words = [f"{i}w{x}" for x in rng.integers(0, 10**6, 240)]
        other = list(words)
        for at in rng.choice(np.arange(10, 230, 8), 5, replace=False):
            other[at] += "x"
        other += [f"{i}z{x}" for x in range(i % 6)]  # from 0.808 to 0.79
        other += words[-9:] * (20 if i % 40 == 0 else 0)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        want |= {2 * i + 1} if share(rows[-2][1], rows[-1][1]) >= 0.8 else set()
    assert 60 < len(want) < 140
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {2 * i for i in range(200)} | {2 * i + 1 for i in range(200)} - want == {r.doc_id for r in simhash.one_of_each(docs).collect()}
