"""The same questions asked of events as they arrive."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from storyloom.model import Library
from storyloom.operators import catalog, ledger, reading
from storyloom.plans import sync
from storyloom.sources import pages as page_source

#: How late an event may be and still count.
LATE = "1 hour"


# --- transformations ----------------------------------------------------------

def visit_counts(events: DataFrame, late: str = LATE) -> DataFrame:
    """Visits per work, an id seen twice within the lateness counted once.

    ``events`` has (id, work_id, started_at).
    """
    once = events.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy("work_id").agg(F.count(F.lit(1)).alias("visits"))


def visits_by_window(events: DataFrame, width: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Visits per work and window, tumbling or sliding."""
    return (
        events.withWatermark("started_at", late)
        .groupBy(F.window("started_at", width, slide or width), "work_id")
        .agg(F.count(F.lit(1)).alias("visits"))
        .select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), "work_id", "visits"))


def reading_sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Runs of a reader's events no further apart than ``gap``.

    ``events`` has (reader, at).
    """
    return (
        events.withWatermark("at", late)
        .groupBy(F.session_window("at", gap), "reader").agg(F.count(F.lit(1)).alias("events"))
        .select("reader", F.col("session_window.start").alias("from"), F.col("session_window.end").alias("to"), "events"))


def request_pairs(starts: DataFrame, ends: DataFrame, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Each request's start with its end; pending when none came in time.

    Both have (session, request, at); ends also (outcome, bytes).
    """
    s = starts.withWatermark("at", late).select(
        F.col("session"), F.col("request"), F.col("at").alias("started_at"))
    e = ends.withWatermark("at", late).select(
        F.col("session").alias("end_session"), F.col("request").alias("end_request"),
        F.col("at").alias("ended_at"), "outcome", "bytes")
    same = (F.col("session") == F.col("end_session")) & (F.col("request") == F.col("end_request"))
    timely = (F.col("ended_at") >= F.col("started_at")) & (
        F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {within}"))
    return s.join(e, same & timely, "left_outer").select(
        "session", "request", "started_at", "ended_at", "outcome", "bytes",
        F.col("ended_at").isNull().alias("pending"))


def job_progress(events: DataFrame) -> DataFrame:
    """The latest counters each job reported.

    ``events`` has (job, at, seq, state, done, total).
    """
    return events.groupBy("job").agg(
        F.max_by(F.struct("state", "done", "total"), F.struct("at", "seq")).alias("now")).select("job", "now.*")


# --- running ------------------------------------------------------------------

def append_to(stream: DataFrame, path: str) -> DataFrame:
    """Run over what is there, adding final rows to a table, and read it."""
    (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
     .trigger(availableNow=True).start(f"{path}/rows").awaitTermination())
    return _table(stream.sparkSession, f"{path}/rows", stream.schema)


def upsert_to(stream: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Run over what is there, keeping each batch's changed rows; the last wins.

    A batch goes to a folder of its number, so running it again replaces it.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    (stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    schema = StructType([*stream.schema.fields]).add("batch", "long")
    rest = [c for c in stream.columns if c not in key]
    return _table(stream.sparkSession, f"{path}/rows", schema).groupBy(*key).agg(
        F.max_by(F.struct(*rest), "batch").alias("last")).select(*key, "last.*")


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table that a run may or may not have written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# --- state of one work, of one session ----------------------------------------

_MICROS = 1_000_000
_HELD = "made boolean, chapter int, offset double, read int, done boolean, upd long, opn long, waiting string"
_READ = ("work_id string, chapter int, offset double, chapters_read int, completed_before boolean, "
                           "updated_at timestamp, opened_at timestamp")


def _written(held: dict, event: list, total: int) -> dict:
    """What one event writes: (at, seq, kind, chapter, offset) upon the state before it."""
    at, _, kind, chapter, offset = event
    now = dict(held)
    if kind == "unfinished":
        return {**now, "read": max(0, (now["chapter"] or 1) - 1), "upd": at} if now["made"] else now
    if kind == "opened":
        now["opn"] = at
    elif kind == "progress":
        now.update(chapter=chapter, offset=offset, read=max(now["read"] or 0, chapter - 1), upd=at, opn=at)
    elif kind == "finished":
        now.update(read=total, upd=at, opn=now["opn"] if now["made"] else at)
    elif kind == "restart":
        now.update(done=now["done"] or (now["read"] or 0) >= total, chapter=1, offset=0.0, read=0, upd=at, opn=at)
    return {**now, "made": True}


def _split(waiting: list[list], mark_ms: int) -> tuple[list[list], list[list]]:
    """Entries no older one can precede any more, in order; and those still open to company."""
    waiting = sorted(waiting, key=lambda e: e[:2])
    settled = [e for e in waiting if e[0] <= mark_ms * 1000]
    return settled, waiting[len(settled):]


def _micros(at: pd.Series) -> list[int]:
    return at.astype("datetime64[us]").astype("int64").tolist()


def _follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Apply settled events for good and show the state with the waiting ones applied too."""
    names = [c.split()[0] for c in _HELD.split(", ")]
    held = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names) | {"made": False, "done": False, "waiting": "[0]"}
    total, *waiting = json.loads(held["waiting"])
    for rows in parts:
        if rows.empty:  # called by its timer
            continue
        total = int(rows["total"].iloc[0])
        chapters = [max(1, 1 if pd.isna(c) else int(c)) for c in rows["chapter"]]
        offsets = [None if pd.isna(o) else float(o) for o in rows["offset"]]
        waiting += [list(e) for e in zip(_micros(rows["at"]), rows["seq"].tolist(), rows["kind"], chapters, offsets)]
    settled, waiting = _split(waiting, state.getCurrentWatermarkMs())
    for event in settled:
        held = _written(held, event, total)
    shown = held
    for event in waiting:
        shown = _written(shown, event, total)
    state.update(tuple({**held, "waiting": json.dumps([total, *waiting])}[n] for n in names))
    if waiting:
        state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
    if shown["made"] and not state.hasTimedOut:
        yield pd.DataFrame({
            "work_id": [key[0]], "chapter": pd.array([shown["chapter"]], "Int32"), "offset": [shown["offset"]],
            "chapters_read": [shown["read"] or 0], "completed_before": [shown["done"]],
            "updated_at": pd.to_datetime([shown["upd"]], unit="us"), "opened_at": pd.to_datetime([shown["opn"]], unit="us")})


def reading_state(events: DataFrame, lib: Library, path: str, late: str = LATE) -> DataFrame:
    """Reading state kept current, of works the library knows; equal to the fold over all events at once.

    Events may come in any order and up to ``late`` behind the newest: they wait
    in the work's state until none before them can follow, and what is shown has
    them in their order at all times.
    """
    length = catalog.rows(lib).select("work_id", catalog.chapters_total().cast("int").alias("total"))
    stream = events.where(F.col("kind").isin(*reading.KINDS)).withWatermark("at", late).join(length, "work_id")
    states = stream.select("work_id", "at", "seq", "kind", "chapter", "offset", "total").groupBy("work_id").applyInPandasWithState(
        _follow, _READ, _HELD, "update", GroupStateTimeout.EventTimeTimeout)
    return upsert_to(states, path, ["work_id"])


_LINE = "last long, waiting string, shown string"
_GAP = "session string, elapsedMs long, gap_ms long"
#: A watermark begins at zero, and what is no later than it is dropped; elapsed time begins there too, so it is moved a day on.
_MOVED_MS = 86_400_000


def _gaps(gap_ms: int) -> Callable:
    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Gaps before ticks as far as is known, told when they change; null where a later arrival closed one.

        Kept are the last tick nothing can precede any more, those still open to
        company, and the gaps told before these.
        """
        last, waiting, shown = state.get if state.exists else (None, "[]", "[]")
        waiting, shown = json.loads(waiting), dict(json.loads(shown))
        for rows in parts:
            waiting += [[(m + _MOVED_MS) * 1000, m] for m in rows["elapsedMs"].tolist()]
        settled, waiting = _split(waiting, state.getCurrentWatermarkMs())
        now, before = {}, last
        for _, at in [*settled, *waiting]:
            if before is not None and at - before > gap_ms:
                now[at] = at - before
            before = at
        told = [(key[0], at, now.get(at)) for at in sorted({*now, *shown}) if now.get(at) != shown.get(at)]
        last = settled[-1][1] if settled else last
        open_ = {at for _, at in waiting}
        state.update((last, json.dumps(waiting), json.dumps([[at, gap] for at, gap in now.items() if at in open_])))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        if told:
            yield pd.DataFrame({"session": [t[0] for t in told], "elapsedMs": [t[1] for t in told],
                                "gap_ms": pd.array([t[2] for t in told], "Int64")})
    return follow


def tick_gap_alerts(ticks: DataFrame, path: str, gap_ms: int = ledger.TICK_GAP_MS, late: str = LATE) -> DataFrame:
    """Gaps between a session's ticks as they stand: told at once, and withdrawn when a tick up to ``late`` closes one."""
    stream = ticks.select("session", "elapsedMs", F.timestamp_millis(F.col("elapsedMs") + _MOVED_MS).alias("at")).withWatermark("at", late)
    found = stream.groupBy("session").applyInPandasWithState(_gaps(gap_ms), _GAP, _LINE, "update", GroupStateTimeout.EventTimeTimeout)
    return upsert_to(found, path, ["session", "elapsedMs"]).where(F.col("gap_ms").isNotNull())


def requests_now(starts: DataFrame, ends: DataFrame, path: str, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Every request that started, as it stands: those the join still waits for are pending too, until their end comes."""
    pairs = append_to(request_pairs(starts, ends, within, late), f"{path}/pairs")
    begun = append_to(starts.select("session", "request", F.col("at").alias("started_at")), f"{path}/starts")
    open_ = begun.join(pairs, ["session", "request", "started_at"], "left_anti").withColumns({
        "ended_at": F.lit(None).cast("timestamp"), "outcome": F.lit(None).cast(pairs.schema["outcome"].dataType),
        "bytes": F.lit(None).cast(pairs.schema["bytes"].dataType), "pending": F.lit(True)})
    return pairs.unionByName(open_)


PLANNED = StructType().add("work_id", "string").add("action", "string").add("reason", "string")


def listing_plans(arriving: DataFrame, held: DataFrame, path: str) -> DataFrame:
    """A sync plan for every batch of listing pages: (work_id, action, reason)."""
    def run(batch: DataFrame, number: int) -> None:
        listed = page_source.listings(batch).groupBy("work_id").agg(F.max("updated_at").alias("updated_at"))
        sync.sync(listed, held).write.mode("overwrite").parquet(f"{path}/plans/batch={number}")

    (arriving.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return _table(arriving.sparkSession, f"{path}/plans", StructType([*PLANNED.fields]).add("batch", "long"))
