"""Versions, merging, deletion, blocking and plans on a few rows."""

import datetime as dt

import pytest

from pyspark.sql import functions as F
from storyloom.functions.values import authors_of, epoch_date
from storyloom.operators import admin, merge, versions
from storyloom.plans import sync

NOW = "2026-06-01 00:00:00"


def chapters(make, *rows):
    return make.rows("chapters", [{"work_id": w, "number": n, "html": h, "text": h} for w, n, h in rows])


@pytest.mark.parametrize("before, after, want", [
    ("<p>a</p>", "<p>a</p>", "none"), ("<p>a</p> <p>b</p>", "<p>a</p><!-- x --><p>b</p>", "none"),
    ("<p>a  b</p>", "<p>a\n b</p>", "none"), ("<p>a</p>", "<p>b</p>", "content"),
    ('<i name="authenticity_token" value="1">', '<i name="authenticity_token" value="2">', "none"),
    ("a<!-<!-- x -->- y -->b", "ab", "none"),
])
def test_only_real_changes_count(make, before, after, want):
    got = versions.diff(chapters(make, ("1", 1, before)), chapters(make, ("1", 1, after))).collect()
    assert [r.change for r in got] == [want]


def test_new_and_removed_chapters(make):
    held = chapters(make, ("1", 1, "a"), ("1", 2, "b"), ("2", 1, "z"))
    got = {(r.work_id, r.number): r.change for r in versions.diff(held, chapters(make, ("1", 1, "a"), ("1", 3, "c"))).collect()}
    assert got == {("1", 1): "none", ("1", 2): "removed", ("1", 3): "new"}


def test_archive_keeps_what_goes(make):
    lib = make(works=[{"work_id": "1", "skin_css": ".a{}"}, {"work_id": "2", "skin_css": ".b{}"}],
               chapters=[{"work_id": "1", "number": 1, "html": "old"}, {"work_id": "1", "number": 2, "html": "gone"}])
    new = make(works=[{"work_id": "1", "skin_css": None}, {"work_id": "2", "skin_css": " .b{} "}],
               chapters=[{"work_id": "1", "number": 1, "html": "new"}])
    kept = versions.archive(lib, new, NOW)
    assert {(r.number, r.html, r.reason, r.content_hash is None) for r in kept.chapter_versions.collect()} == {
        (1, "old", "content", False), (2, "gone", "removed", True)}
    assert [r.skin_css for r in kept.skin_versions.collect()] == [".a{}"]
    assert versions.skin_diff(lib.works, new.works, exact=True).where("change = 'layout'").count() == 2


@pytest.fixture(scope="module")
def two(make):
    device = make(
        works=[{"work_id": "1", "title": "Old", "kudos_given": True, "visits": 5, "visits_synced_at": "2026-01-02"},
               {"work_id": "2", "title": "Mine"}, {"work_id": "7", "title": "t", "authors": ["bad"], "hidden": True}],
        tags=[("1", "fandom", "A")],
        chapters=[{"work_id": "1", "number": 1, "html": "one", "text": "one"}, {"work_id": "1", "number": 2, "html": "two"},
                  {"work_id": "1", "number": 3, "html": "a b"}],
        reading=[{"work_id": "1", "chapter": 4}], visits=[("a", "1", "2026-01-01")],
        deleted=[("9", "Gone", "2026-01-01")], blocked=[("bad", "2026-01-01")])
    incoming = make(
        works=[{"work_id": "1", "title": "New", "visits": 9, "visits_synced_at": "2026-01-01"}, {"work_id": "3", "title": "Theirs", "authors": ["bad"]},
               {"work_id": "9", "title": "Gone"}],
        tags=[("1", "fandom", "B"), ("3", "fandom", "C")],
        chapters=[{"work_id": "1", "number": 1, "html": "ONE"}, {"work_id": "1", "number": 3, "html": "a\nb"},
                  {"work_id": "3", "number": 1, "html": "x"}, {"work_id": "9", "number": 1, "html": "y"}],
        reading=[{"work_id": "1", "chapter": 1}, {"work_id": "3", "chapter": 2, "completed_before": True}],
        visits=[("a", "1", "2026-01-01"), ("b", "3", "2026-01-01"), ("c", "404", "2026-01-01")])
    return device, incoming


def test_merge(two):
    merged = merge.libraries(*two, NOW)
    works = {r.work_id: r for r in merged.works.collect()}
    assert set(works) == {"1", "2", "3", "7"}
    assert (works["1"].title, works["1"].kudos_given, works["1"].visits) == ("New", True, 5)
    assert (works["3"].has_text, works["3"].hidden, works["2"].has_text) == (True, True, False)
    assert {(r.number, r.reason) for r in merged.chapter_versions.collect()} == {(1, "content"), (2, "removed")}
    assert {(r.work_id, r.name) for r in merged.tags.collect()} == {("1", "B"), ("3", "C")}
    assert {(r.work_id, r.chapter) for r in merged.reading.collect()} == {("1", 4), ("3", 2)}
    assert sorted(r.id for r in merged.visits.collect()) == ["a", "b"]
    assert merge.libraries(*two, NOW, respect_tombstones=False).works.where("work_id = '9'").count() == 1


def test_merging_again_changes_nothing(two):
    once = merge.libraries(*two, NOW)
    twice = merge.libraries(once, two[1], "2026-07-01 00:00:00")
    for name in once.tables():
        rows = lambda lib: sorted(map(str, getattr(lib, name).collect()))  # noqa: E731, B023
        assert rows(once) == rows(twice), name


def test_delete_leaves_a_stone(make, spark):
    owned = {"tags": [("1", "fandom", "x"), ("2", "fandom", "x")], "images": [("1", "u"), ("2", "u")],
             **{t: [{"work_id": w} for w in "12"] for t in ("chapters", "chapter_versions", "skin_versions", "reading")},
             "visits": [("a", "1", None), ("b", "2", None)]}
    lib = make(works=[{"work_id": "1", "title": "Alpha"}, {"work_id": "2", "title": "Bravo"}], **owned)
    after = admin.delete(lib, spark.createDataFrame([("1",)], "work_id string"), NOW)
    for name in admin.OWNED:
        assert {r.work_id for r in getattr(after, name).collect()} == {"2"}, name
    assert [(r.work_id, r.title) for r in after.deleted.collect()] == [("1", "Alpha")]
    assert admin.allow_again(after, after.deleted).deleted.count() == 0


RAW = ['["ann"]', '["ann","bee"]', '["ann","bee","cee"]', "[]", "", None, "ann", "not json at all", '["Anna"]', '["Annabel"]',
       '["ann", "ann"]', '["O\'Brien"]', '["a \\"quoted\\" name"]', "[1, 2]", '{"not":"a list"}']


@pytest.mark.parametrize("names, want", [
    ([], []), (["ann"], [0, 10]), (["bee"], []), (["ann", "bee"], [0, 1, 10]), (["Anna"], [8]), (["O'Brien"], [11]), (["1"], []),
])
def test_hidden_means_every_author(spark, make, names, want):
    raw = spark.createDataFrame([(str(i), r) for i, r in enumerate(RAW)], "work_id string, raw string")
    works = raw.select("work_id", authors_of(F.col("raw")).alias("authors"))
    blocked = make.rows("blocked", [(n, None) for n in names])
    assert sorted(int(r.work_id) for r in admin.hidden(works, blocked).where("hidden").collect()) == want


def test_blocking_and_its_undoing(make):
    lib = make(works=[{"work_id": "1", "authors": ["a"], "words": 10}, {"work_id": "2", "authors": ["a", "b"], "words": 20}, {"work_id": "3", "authors": []}])
    shut = lambda x: {r.work_id for r in x.works.where("hidden").collect()}
    one = admin.block_author(lib, "a", NOW)
    both = admin.block_author(one, "b", NOW)
    assert (shut(one), shut(both), shut(admin.unblock_author(both, "b"))) == ({"1"}, {"1", "2"}, {"1"})
    assert tuple(admin.block_impact(lib.works, one.blocked).first()) == (1, 10)


# --- plans --------------------------------------------------------------------

LISTED = {"absent": 1735689600, "older": 1735689600, "newer": 1767225600, "same": 1735689600, "undated": None,
          "skinless": 1735689600, "skinned": 1735689600, "onlyPublished": 1735689600}
HELD = {"older": {"downloaded_at": "2026-06-01"}, "newer": {"downloaded_at": "2025-06-01"}, "same": {"downloaded_at": "2025-01-01"},
        "undated": {}, "skinless": {"downloaded_at": "2026-06-01", "needs_skin": True},
        "skinned": {"downloaded_at": "2026-06-01", "needs_skin": True, "skin_css": "p{}"}, "onlyPublished": {"published": "2024-01-01"}}


@pytest.fixture(scope="module")
def plan_inputs(spark):
    day = lambda v: v and dt.date.fromisoformat(v)
    listed = spark.createDataFrame(list(LISTED.items()), "work_id string, updated_at long")
    held = spark.createDataFrame(
        [(k, day(v.get("downloaded_at")), None, None, day(v.get("published")), v.get("needs_skin"), v.get("skin_css")) for k, v in HELD.items()],
        "work_id string, downloaded_at date, updated date, completed date, published date, needs_skin boolean, skin_css string")
    return listed, held


def test_plan(plan_inputs):
    plan = sync.sync(*plan_inputs)
    assert {r.work_id: (r.action, r.reason) for r in plan.collect()} == {
        "absent": ("fetch", "not held"), "newer": ("refetch", "AO3 2026-01-01 > held 2025-06-01"),
        "onlyPublished": ("refetch", "AO3 2025-01-01 > held 2024-01-01"), "skinless": ("skin", "custom markup with no skin stored"),
        **{w: ("skip", "held and current") for w in ("older", "same", "undated", "skinned")}}
    assert tuple(sync.counts(plan).first()) == (8, 1, 2, 1, 4, 4)
    assert tuple(sync.counts(sync.sync(*plan_inputs, want_skins=False)).first()) == (8, 1, 2, 0, 5, 3)


def test_epochs_and_costs(spark):
    rows = [(None,), (0.0,), (1735689600.0,), (1e20,), (1787732527.0,)]
    got = spark.createDataFrame(rows, "e double").select(epoch_date(F.col("e")).cast("string")).collect()
    assert [r[0] for r in got] == [None, "1970-01-01", "2025-01-01", None, "2026-08-26"]
    cost = sync.cost(F.col("n"))
    said = spark.createDataFrame([(0,), (1,), (20,), (124,), (8030,)], "n long").select(cost["hours"], cost["human"]).collect()
    assert [tuple(r) for r in said] == [(0.0, "0 min"), (0.0, "0 min"), (0.2, "10 min"), (1.0, "60 min"), (64.7, "64.7 hours")]


def test_listings_meet(spark):
    b = spark.createDataFrame([("a", "A", 100), ("both", "B", 300)], "work_id string, title string, updated_at long")
    h = spark.createDataFrame([("both", "H", 200, 4), ("b", "C", 0, 1)], "work_id string, title string, updated_at long, visits long")
    got = {r.work_id: (r.title, r.visits, r.updated_at, r.in_bookmarks, r.in_history) for r in sync.merge_listings(b, h).collect()}
    assert got == {"a": ("A", None, 100, True, False), "both": ("B", 4, 300, True, True), "b": ("C", 1, None, False, True)}


def test_an_entry_listed_twice_is_applied_once_each(make):
    """A listing that names a held work twice gives a row for each entry, as its SQL does, and not for each pair of them."""
    from registry.planning import bookmarks, history
    lib = make(works=[{"work_id": w, "title": "x", "chapter_count": 3, "updated_at": 5} for w in ("161", "1000161", "1000164")])
    got = sync.apply_listings(lib, bookmarks(lib), history(lib)).works.select("work_id", "in_bookmarks", "rec", "in_history", "visits").collect()
    assert sorted(map(tuple, got)) == [
        ("1000161", True, False, False, None), ("1000161", True, True, False, None), ("1000164", True, False, True, 1000164 % 11),
        ("161", False, False, False, None), ("2000161", False, False, False, None)]


def test_frontier_includes_the_first_familiar_page(spark):
    pages = spark.createDataFrame([(1, 4, "n1"), (1, 4, "k1"), (2, 4, "k2"), (3, 4, "n2"), (4, 4, "n3")], "page int, total_pages int, work_id string")
    known = spark.createDataFrame([("k1",), ("k2",)], "work_id string")
    got = sync.bookmark_frontier(pages, known, known.where("work_id = 'k1'"))
    assert {r.work_id: (r.needed, r.complete) for r in got.collect()} == {"n1": (True, False), "k1": (False, False), "k2": (True, False)}
    assert {r.complete for r in sync.bookmark_frontier(pages, known.where("false"), known).collect()} == {True}


# --- tables bucketed by work ----------------------------------------------------


@pytest.fixture()
def saved(make, tmp_path, spark):
    import uuid
    from storyloom.sources import buckets
    prefix = f"t_{uuid.uuid4().hex}"
    lib = make(works=[{"work_id": str(i), "title": f"t{i}"} for i in range(30)],
               chapters=[{"id": 10 * i + n, "work_id": str(i), "number": n, "html": f"<p>{i} {n}</p>", "text": f"{i} {n}"} for i in range(30) for n in (1, 2)],
               tags=[(str(i), "fandom", "F") for i in range(30)])
    buckets.save(lib, prefix, str(tmp_path), 16)
    return prefix, tmp_path


def _files(root, table):
    return {str(p.relative_to(root)) for p in (root / table).rglob("part-*.parquet")}


def test_a_change_rewrites_its_buckets_alone(saved, spark, make):
    from storyloom.sources import buckets
    prefix, root = saved
    before = _files(root, "chapters")
    arriving = make(works=[{"work_id": "7", "title": "new"}, {"work_id": "99", "title": "more"}],
                    chapters=[{"id": 71, "work_id": "7", "number": 1, "html": "<p>changed</p>"}, {"id": 991, "work_id": "99", "number": 1, "html": "x"}])
    parts = buckets.change(spark, prefix, arriving.works, lambda lib: merge.libraries(lib, arriving, "2024-01-01"))
    after = _files(root, "chapters")
    assert 1 <= len(parts) <= 2
    assert before & after == {f for f in before if not any(f"part={p}/" in f for p in parts)}
    lib = buckets.load(spark, prefix)
    got = {(r.work_id, r.number): r.html for r in lib.chapters.collect()}
    want = {(str(i), n): f"<p>{i} {n}</p>" for i in range(30) for n in (1, 2)} | {("7", 1): "<p>changed</p>", ("99", 1): "x"}
    want.pop(("7", 2))
    assert got == want and lib.works.count() == 31
    assert {(r.number, r.reason) for r in lib.chapter_versions.collect()} == {(1, "content"), (2, "removed")}
    with pytest.raises(ValueError):
        buckets.change(spark, prefix, arriving.works.where("work_id = '7'"), lambda lib: lib.with_(chapters=arriving.chapters.withColumn("work_id", F.lit("1"))))


def test_emptied_buckets(saved, spark):
    from storyloom.sources import buckets
    prefix, root = saved
    gone = spark.createDataFrame([(str(i),) for i in range(30) if i != 3], "work_id string")
    buckets.change(spark, prefix, gone, lambda lib: admin.delete(lib, gone, "2024-01-01"))
    lib = buckets.load(spark, prefix)
    assert [r.work_id for r in lib.works.collect()] == ["3"] and lib.chapters.count() == 2 and lib.deleted.count() == 29
    buckets.change(spark, prefix, gone, lambda lib: admin.allow_again(lib, gone))
    assert buckets.load(spark, prefix).deleted.count() == 0
    assert buckets.change(spark, prefix, gone.where("false"), lambda lib: lib) == []


def test_held_text_stays_where_it_lies(saved, spark, make):
    """No exchange above the held table's markup: merges, versions and deletions move keys."""
    from storyloom.sources import buckets
    prefix, _ = saved
    held = buckets.load(spark, prefix)
    arriving = make(works=[{"work_id": "7"}], chapters=[{"id": 71, "work_id": "7", "number": 1, "html": "<p>changed</p>"}])
    changes = versions.diff(held.chapters, arriving.chapters)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (admin.delete(held, arriving.works, "2024-01-01").chapters, versions.superseded(held.chapters, changes, "2024-01-01"),
                   merge.replace_for(held.chapters, arriving.chapters, arriving.works)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            lines = plan.splitlines()
            for at, line in enumerate(lines):
                if "Exchange" not in line:
                    continue
                depth = len(line) - len(line.lstrip(" :+-"))
                below = []
                for further in lines[at + 1:]:
                    if len(further) - len(further.lstrip(" :+-")) <= depth:
                        break
                    below.append(further)
                scans = [x for x in below if "FileScan parquet" in x and f"{prefix}_chapters" in x]
                outs = [x for x in below if "Project" in x]
                assert not scans or not any("html#" in o.split("AS")[0] for o in outs[:1]), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _shuffled(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_what_lies_by_work_is_written_as_it_lies(saved, spark, monkeypatch):
    """Rows set aside are not dealt out again: a deletion from bucketed tables and its replacing shuffle no rows of them."""
    from storyloom.sources import buckets
    prefix, _ = saved
    seen, kept = [], buckets._replace
    monkeypatch.setattr(buckets, "_replace", lambda spark, rows, table, parts: (seen.append((table, _shuffled(rows))), kept(spark, rows, table, parts))[1])
    gone = spark.createDataFrame([("3",)], "work_id string")
    buckets.change(spark, prefix, gone, lambda lib: admin.delete(lib, gone, "2024-01-01"))
    assert len(seen) > 5 and {n for _, n in seen} == {0}, seen
    assert buckets.load(spark, prefix).chapters.count() == 58


def test_tags_dealt_out_are_the_same_rows(spark):
    from storyloom.sources import star
    root = "/root/testdata/sf0.001"
    dealt = star.tags_dealt(spark, root, 5)
    rows = lambda df: sorted((r.work_id, r.kind, r.name) for r in df.collect())
    assert rows(dealt) == rows(star.tags(spark, root))
    # one shuffle, which the writing by work takes over
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        from storyloom.sources import buckets
        assert _shuffled(buckets._dealt(dealt, 5)) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_works_dealt_out_are_the_same_rows(spark):
    from storyloom.sources import buckets, star
    root = "/root/testdata/sf0.001"
    dealt = star.works_dealt(spark, root)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(dealt) == rows(star.library(spark, root).works)
    with buckets._by_buckets(spark, 5):
        plan = buckets._dealt(dealt, 5)._jdf.queryExecution().executedPlan().toString()
    # the lines' own shuffle by work is the one the writing takes over: the wide rows are not dealt out again
    assert "REPARTITION_BY_NUM" not in plan
    assert spark.conf.get("spark.sql.shuffle.partitions") != "5"
