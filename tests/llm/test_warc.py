"""Round trips, revisits, and files with planted damage."""

import base64
import gzip
import hashlib

import pytest

from storyloom.llm import queries, warc


def test_query_on_tables(spark):
    root = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{root}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html, p.page_id)
    want = []
    for p in pages:
        raw = (p.html or "").encode()
        again = first[p.html] != p.page_id
        want.append((p.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response",
                     first[p.html] if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op4_warc(spark, root).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_odd_rows(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"),
         (None, "u", "lone"), (5, "u", "é" * 200000), (1, "u", "same")], "page_id long, url string, html string")
    got = warc.read(warc.write(pages)).collect()
    assert all(r.gap is None for r in got) and len(got) == 9
    kinds = sorted((r.key, r.type, r.refers_to or "", r.payload_bytes) for r in got)
    assert kinds == [("", "response", "", 4), ("", "revisit", "1", 4), ("1", "response", "", 4), ("1", "response", "", 4),
                     ("2", "revisit", "1", 4), ("2", "revisit", "1", 4), ("3", "response", "", 0), ("4", "revisit", "3", 0),
                     ("5", "response", "", 400000)]
    assert {r.uri for r in got if r.key == "1"} == {"http://a/%0D%0AX:%20y", "u"}
    assert warc.read(warc.write(pages.where("false"))).count() == 0
    small = warc.read(warc.write(pages, least=5)).collect()
    assert {r.type for r in small} == {"response"}


def parts(packed):
    made = [warc.record(i, f"http://x/{i}", f"payload {i} ".encode() * 50) for i in range(5)]
    return [gzip.compress(m, mtime=0) for m in made] if packed else made


def read(raw):
    found = list(warc.salvage(raw))
    assert sum({f.offset: f.length for f in found}.values()) == len(raw)
    keys = [int(f.headers["warc-record-id"][10:-1]) for f in found if f.reason is None]
    return keys, [(f.offset, f.length) for f in found if f.reason is not None]


@pytest.mark.parametrize("packed", [True, False])
def test_planted_damage(packed):
    made = parts(packed)
    whole = b"".join(made)
    at = [sum(map(len, made[:i])) for i in range(6)]
    assert read(whole) == ([0, 1, 2, 3, 4], [])
    # a flipped byte in the middle, lost bytes, rubbish between, a cut end, a broken head
    flipped = bytearray(whole)
    flipped[at[2] - 30] ^= 0xFF
    assert read(bytes(flipped)) == ([0, 2, 3, 4], [(at[1], len(made[1]))])
    lost = whole[:at[1] + 40] + whole[at[1] + 90:]
    assert read(lost) == ([0, 2, 3, 4], [(at[1], len(made[1]) - 50)])
    rubbish = whole[:at[3]] + b"\x1f\x8b\x08 no member \x00" * 3 + whole[at[3]:]
    keys, gaps = read(rubbish)
    assert keys == [0, 1, 2, 3, 4] and sum(n for _, n in gaps) == 45 and gaps[0][0] == at[3]
    assert read(whole[:-10]) == ([0, 1, 2, 3], [(at[4], len(made[4]) - 10)])
    head = b"\x00" * 20 + whole[20:]
    assert read(head) == ([1, 2, 3, 4], [(0, at[1])])
    assert read(b"") == ([], []) and read(b"nothing here")[1] == [(0, 12)]


def test_damage_inside_a_sound_member():
    made = parts(False)
    bad = made[1].replace(b"payload 1", b"payload X", 1)
    raw = gzip.compress(made[0] + bad + made[2])
    found = list(warc.salvage(raw))
    assert [f.reason is None for f in found] == [True, False, True] and "digest" in found[1].reason
    assert [f.reason for f in warc.salvage(made[0] + bad + made[2])].count(None) == 2


def test_sql_twin(spark):
    from tests.compare import compare, connect
    root = "/root/testdata/sf0.001"
    problem, _ = compare(spark, connect(root), "op4_warc", queries.op4_warc, queries.SQL["op4_warc"], root)
    assert problem is None, problem
