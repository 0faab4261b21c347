import datetime as dt
import random

import pytest

from pyspark.sql import functions as F
from storyloom.operators import catalog, reading
from storyloom.operators.ordered import next_at_or_after, previous, time_slice

EVENTS = "work_id string, at timestamp, seq long, kind string, chapter int, offset double"
T0 = dt.datetime(2026, 1, 1)


def replay(events, totals, start=None):
    """The writes of each event, one after another."""
    state = {w: dict(s) for w, s in (start or {}).items()}
    for work, at, _, kind, chapter, offset in sorted(events, key=lambda e: (e[1], e[2])):
        total = totals[work]
        s = state.get(work)
        if kind == "unfinished":
            if s is not None:
                s.update(read=max(0, (s["chapter"] or 1) - 1), upd=at)
            continue
        new = s is None
        s = state.setdefault(work, {"chapter": None, "offset": None, "read": None, "done": False, "upd": None, "opn": None})
        if kind == "opened":
            s["opn"] = at
        elif kind == "progress":
            s.update(chapter=chapter, offset=offset, read=max(s["read"] or 0, chapter - 1), upd=at, opn=at)
        elif kind == "finished":
            s.update(read=total, upd=at)
            if new:
                s["opn"] = at
        elif kind == "restart":
            s.update(done=s["done"] or (s["read"] or 0) >= total, chapter=1, offset=0.0, read=0, upd=at, opn=at)
    return state


def as_state(df):
    return {r.work_id: {"chapter": r.chapter, "offset": r.offset, "read": r.chapters_read, "done": r.completed_before,
                        "upd": r.updated_at, "opn": r.opened_at} for r in df.collect()}


def made_up(seed, n, works, span_hours):
    rng = random.Random(seed)
    kinds = ["progress"] * 5 + ["opened", "finished", "unfinished", "unfinished", "restart"]
    return [(rng.choice(works), T0 + dt.timedelta(minutes=rng.randint(0, span_hours * 60)), i, rng.choice(kinds),
             rng.randint(1, 6), round(rng.random(), 3)) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_replay(spark, make, seed):
    works = [str(i) for i in range(12)]
    totals = {w: int(w) % 5 + 1 for w in works}
    # one work has a third of all events, and slices are short enough to be crossed often
    events = made_up(seed, 260, works + ["0"] * 6, 100)
    lib = make(works=[{"work_id": w, "chapter_count": totals[w]} for w in works])
    want = {w: {**s, "read": s["read"] or 0} for w, s in replay(events, totals).items()}
    for seconds in (1800, 86400):
        got = as_state(reading.fold(spark.createDataFrame(events, EVENTS), lib, slice_seconds=seconds))
        assert got == want


def test_fold_goes_on_from_a_state(spark, make):
    works = [str(i) for i in range(8)]
    totals = {w: int(w) % 4 + 1 for w in works}
    lib = make(works=[{"work_id": w, "chapter_count": totals[w]} for w in works])
    events = sorted(made_up(9, 200, works, 80), key=lambda e: (e[1], e[2]))
    cut = len(events) // 2
    while events[cut][1] == events[cut - 1][1]:
        cut += 1
    first = reading.fold(spark.createDataFrame(events[:cut], EVENTS), lib, slice_seconds=3600)
    second = reading.fold(spark.createDataFrame(events[cut:], EVENTS), lib, start=first, slice_seconds=3600)
    whole = as_state(reading.fold(spark.createDataFrame(events, EVENTS), lib, slice_seconds=3600))
    assert as_state(second) == whole


def test_unknown_works_are_not_made(spark, make):
    lib = make(works=[{"work_id": "1"}])
    events = [("9", T0, 1, "progress", 2, 0.5), ("1", T0, 2, "unfinished", None, None)]
    assert reading.fold(spark.createDataFrame(events, EVENTS), lib).count() == 0


def test_visits_count_once(spark, make):
    lib = make(works=[{"work_id": i, "title": "t", "visits": v} for i, v in (("1", 3), ("2", 4), ("3", None))])
    seen = make.rows("visits", [("a", "1", "2026-01-01"), ("b", "1", "2026-01-02"), ("b", "1", "2026-01-03"),
                                ("orphan", "9", "2026-01-01")])
    kept = reading.record_visits(seen, lib.works)
    assert sorted(r.id for r in kept.collect()) == ["a", "b"]
    again = reading.record_visits(seen, lib.works, kept)
    assert again.count() == 2
    counted = lib.with_(visits=kept)
    assert {r.work_id: r.ff_visits for r in reading.visits_total(counted).collect()} == {"1": 2, "2": 0, "3": 0}
    assert [r.work_id for r in catalog.works(counted, sort="visits").collect()] == ["1", "2", "3"]


def test_history_replaces_and_never_adds(spark, make):
    lib = make(works=[{"work_id": "1", "visits": 3}, {"work_id": "2", "visits": 4}])
    snapshot = spark.createDataFrame(
        [("1", 9, "2026-01-02", T0), ("1", 7, "2026-01-01", T0 - dt.timedelta(days=1)), ("2", None, None, T0), ("2", -1, None, T0), ("8", 5, None, T0)],
        "work_id string, visits long, last_visited string, synced_at timestamp")
    once = reading.apply_history(lib.works, snapshot)
    twice = reading.apply_history(once, snapshot)
    for df in (once, twice):
        assert {r.work_id: (r.visits, r.in_history) for r in df.collect()} == {"1": (9, True), "2": (4, False)}


def test_bookmarks_leave_only_by_a_complete_list(spark, make):
    lib = make(works=[{"work_id": "1", "in_bookmarks": True}, {"work_id": "2", "in_bookmarks": True}, {"work_id": "3"}])
    listed = spark.createDataFrame([("1",), ("3",)], "work_id string")
    change = lambda whole: {r.work_id: r.change for r in reading.reconcile_bookmarks(lib.works, listed, whole).collect()}
    assert change(True) == {"1": "kept", "2": "dropped", "3": "added"}
    assert change(False) == {"1": "kept", "2": "kept", "3": "added"}


def test_a_later_mark_keeps_the_place(spark, make):
    held = make.rows("reading", [{"work_id": "1", "chapter": 2, "offset": 0.3}, {"work_id": "2", "chapter": 4, "chapters_read": 3}])
    positions = spark.createDataFrame([("1", 0, [0.0, 0.0, 0.7], [1, 1])], "work_id string, chapter_count int, offsets array<double>, marks array<int>")
    later = spark.createDataFrame([("1",), ("2",), ("3",)], "work_id string")
    got = {r.work_id: (r.chapter, r.offset, r.chapters_read, r.chapter_count, r.marked_later)
           for r in reading.import_backup(held, positions, later, "backup").collect()}
    assert got == {"1": (3, 0.7, 2, 3, True), "2": (4, None, 3, None, True), "3": (None, None, None, None, True)}


def test_status(make):
    lib = make(works=[{"work_id": "1", "chapter_count": 4}, {"work_id": "2", "chapter_count": 3}, {"work_id": "3", "chapter_count": 8}],
               reading=[{"work_id": "1", "chapter": 2, "chapters_read": 2}, {"work_id": "2", "chapter": 3, "chapters_read": 3},
                        {"work_id": "3", "chapters_read": 1, "completed_before": True}])
    got = {r.work_id: (r.done, r.at, r.percent, r.rereading) for r in reading.status(lib).collect()}
    assert got == {"1": (False, 3, 50, False), "2": (True, 3, 100, False), "3": (False, 2, 13, True)}


def test_previous_equals_lag(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < .5 else rng.choice("ab"), t) for t in rng.sample(range(100000), 300)]
    df = spark.createDataFrame(rows, "session string, elapsedMs long")
    got = {(r.session, r.elapsedMs): r.before for r in previous(
        df, ["session"], ["elapsedMs"], "elapsedMs", F.floor(F.col("elapsedMs") / 500), "before").collect()}
    for session in ("hot", "a", "b"):
        line = sorted(t for s, t in rows if s == session)
        assert [got[session, t] for t in line] == [None, *line[:-1]]


def test_next_at_or_after_equals_a_search(spark):
    rng = random.Random(5)
    at = lambda: T0 + dt.timedelta(hours=rng.randint(0, 300))
    left = [("hot" if rng.random() < .5 else "b", at(), i) for i in range(80)]
    right = [(k, at(), f"skin{i}") for i, k in enumerate(["hot"] * 6 + ["b"] * 3 + ["c"])]
    got = {r.n: r.skin for r in next_at_or_after(
        spark.createDataFrame(left, "work_id string, archived_at timestamp, n int"),
        spark.createDataFrame(right, "work_id string, archived_at timestamp, skin string"),
        "work_id", "archived_at", F.col("skin"), "skin", seconds=7200).collect()}
    for key, stamp, n in left:
        later = sorted((t, s) for k, t, s in right if k == key and t >= stamp)
        assert got[n] == (later[0][1] if later else None)


def test_time_slices_cover_before_the_epoch(spark):
    got = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23),), (dt.datetime(1970, 1, 1, 1),)], "t timestamp").select(
        time_slice(F.col("t"), 86400)).collect()
    assert [r[0] for r in got] == [-1, 0]
