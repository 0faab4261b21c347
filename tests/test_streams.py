"""Streams over several files give what one batch over all of them gives."""

import datetime as dt

from tests.test_reading import EVENTS, T0, as_state, made_up

from storyloom.operators import ledger, reading
from storyloom.streaming import jobs


def files_of(spark, path, parts, schema):
    """One file a batch, in this order."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:02d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_reading_state_over_batches(spark, make, tmp_path):
    """Files hold events out of order, within each and from one to the next."""
    works = [str(i) for i in range(6)]
    lib = make(works=[{"work_id": w, "chapter_count": int(w) % 4 + 1} for w in works])
    events = made_up(21, 120, works + ["0"] * 4 + ["unknown"], 60)
    stream = files_of(spark, str(tmp_path / "in"), [events[:40], events[40:80], events[80:]], EVENTS)
    got = as_state(jobs.reading_state(stream, lib, str(tmp_path / "out"), "61 hours"))
    assert got == as_state(reading.fold(spark.createDataFrame(events, EVENTS), lib))


def test_settled_events_leave_the_state(spark, make, tmp_path):
    """Within the lateness order does not matter, and what came before it is applied for good."""
    lib = make(works=[{"work_id": "1", "chapter_count": 9}])
    at = lambda h: T0 + dt.timedelta(hours=h)
    events = [[("1", at(0), 1, "progress", 3, 0.5), ("1", at(10), 2, "progress", 7, 0.1)], [("1", at(9), 3, "restart", None, None)],
              [("1", at(30), 4, "opened", None, None)], [("1", at(31), 5, "unfinished", None, None)]]
    stream = files_of(spark, str(tmp_path / "in"), events, EVENTS)
    got = as_state(jobs.reading_state(stream, lib, str(tmp_path / "out"), "2 hours"))
    assert got == as_state(reading.fold(spark.createDataFrame([e for part in events for e in part], EVENTS), lib))


def test_gaps_reach_across_batches(spark, tmp_path):
    ticks = [("s", 10_000), ("s", 5_000), ("t", 0), ("s", 40_000), ("t", 15_000), ("s", 25_000), ("t", 90_000), ("u", 400_000)]
    schema = "session string, elapsedMs long"
    stream = files_of(spark, str(tmp_path / "in"), [ticks[:3], ticks[3:6], ticks[6:]], schema)
    got = {(r.session, r.gap_ms) for r in jobs.tick_gap_alerts(stream, str(tmp_path / "out"), late="5 minutes").collect()}
    want = {(r.session, r.gap_ms) for r in ledger.tick_gaps(spark.createDataFrame(ticks, schema)).collect()}
    assert got == want == {("t", 75_000)}


def test_a_late_tick_withdraws_a_gap(spark, tmp_path):
    """A gap is told at once; a tick within it takes it back, wholly or in part, and the end of the input keeps its gaps."""
    m = 60_000
    batches = [[("s", 0), ("s", 10 * m), ("t", 0)], [("s", 5 * m), ("t", 20 * m)], [("t", 1 * m), ("s", 40 * m)], [("t", 41 * m)]]
    schema = "session string, elapsedMs long"
    stream = files_of(spark, str(tmp_path / "in"), batches, schema)
    got = {(r.session, r.elapsedMs, r.gap_ms) for r in jobs.tick_gap_alerts(stream, str(tmp_path / "out"), 6 * m, "1 hour").collect()}
    every = spark.createDataFrame([t for part in batches for t in part], schema)
    assert got == {(r.session, r.elapsedMs, r.gap_ms) for r in ledger.tick_gaps(every, 6 * m).collect()}
    assert got == {("s", 40 * m, 30 * m), ("t", 20 * m, 19 * m), ("t", 41 * m, 21 * m)}
    told = spark.read.parquet(str(tmp_path / "out/rows")).where("session = 's'").orderBy("batch", "elapsedMs").collect()
    assert [(r.elapsedMs, r.gap_ms) for r in told] == [(10 * m, 10 * m), (10 * m, None), (40 * m, 30 * m)]
    assert spark.read.parquet(str(tmp_path / "out/rows")).where(f"session = 't' AND elapsedMs = {20 * m}").count() == 2


def test_open_requests_are_pending(spark, tmp_path):
    at = lambda n: T0 + dt.timedelta(minutes=n)
    starts = files_of(spark, str(tmp_path / "s"), [[("a", 1, at(0)), ("a", 2, at(1))], [("b", 1, at(200)), ("b", 2, at(201))]], "session string, request int, at timestamp")
    ends = files_of(spark, str(tmp_path / "e"), [[("a", 1, at(2), "ok", 5)], [("b", 2, at(202), "ok", 7)]],
                    "session string, request int, at timestamp, outcome string, bytes int")
    got = {(r.session, r.request, r.outcome, r.pending) for r in jobs.requests_now(starts, ends, str(tmp_path / "out")).collect()}
    assert got == {("a", 1, "ok", False), ("a", 2, None, True), ("b", 1, None, True), ("b", 2, "ok", False)}


def test_visits_seen_twice_and_late(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    schema = "id string, work_id string, started_at timestamp"
    first = [("a", "1", at(0)), ("b", "1", at(30)), ("b", "1", at(30))]
    second = [("a", "1", at(0)), ("c", "2", at(20))]  # out of order, within the hour
    stream = files_of(spark, str(tmp_path / "in"), [first, second], schema)
    out = jobs.upsert_to(jobs.visit_counts(stream), str(tmp_path / "out"), ["work_id"])
    assert {r.work_id: r.visits for r in out.collect()} == {"1": 2, "2": 1}
