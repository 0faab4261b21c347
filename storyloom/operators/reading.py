"""Reading state: what events say, folded into one row per work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.model import Library, READING, VISITS, evolve
from storyloom.operators import catalog
from storyloom.operators.ordered import BEFORE, time_slice

#: The kinds of event :func:`fold` understands.
KINDS = ("progress", "opened", "finished", "unfinished", "restart")
DAY = 86400


def state_columns(lib: Library) -> DataFrame:
    """Total chapters, and what each work's marks say about having read it."""
    return catalog.rows(lib).select(
        "work_id", catalog.chapters_total().alias("total"), catalog.started().alias("started"),
        catalog.finished().alias("finished"), catalog.completed().alias("completed"),
        catalog.local_last_read().alias("local_last_read"), catalog.last_read().alias("last_read"),
        catalog.total_visits().alias("total_visits"))


def status(lib: Library) -> DataFrame:
    """Where a reader stands in each work and where to go on."""
    total = F.greatest(F.lit(1), F.coalesce(
        F.nullif(F.col("chapter_count"), F.lit(0)), F.col("held_chapters"), F.lit(1)).cast("int"))
    read = F.greatest(F.lit(0), F.coalesce("chapters_read", F.lit(0)))
    chapter = F.greatest(F.lit(1), F.coalesce("at_chapter", F.lit(1)))
    at = catalog.rows(lib).withColumns({"total": total, "read": read, "place": chapter})
    at = at.withColumn("done", F.col("read") >= F.col("total"))
    go_on = F.when((F.col("read") >= F.col("place")) & ~F.col("done"), F.col("read") + 1).otherwise(F.col("place"))
    return at.select(
        "work_id", "total", "read", catalog.started().alias("started"), "done",
        F.least("total", go_on).alias("at"),
        (F.coalesce("completed_before", F.lit(False)) & ~F.col("done")).alias("rereading"),
        F.least(F.lit(100), F.floor(F.col("read") * 100 / F.col("total") + 0.5).cast("int")).alias("percent"))


# --- visits -------------------------------------------------------------------

def record_visits(events: DataFrame, works: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per visit id, the earliest kept, and only for works that exist."""
    if existing is not None:
        events = events.join(existing.select("id"), "id", "left_anti")
    first = events.groupBy("id").agg(
        F.min_by(F.struct("work_id", "started_at"), F.struct("started_at", "work_id")).alias("kept"))
    new = first.select("id", "kept.work_id", "kept.started_at").join(works.select("work_id"), "work_id", "left_semi")
    new = evolve(new, VISITS)
    return new if existing is None else evolve(existing, VISITS).unionByName(new)


def visits_total(lib: Library) -> DataFrame:
    return catalog.rows(lib).select(
        "work_id", catalog.local_visits().alias("ff_visits"), catalog.total_visits().alias("total"))


def apply_history(works: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Counts the archive reports replace held ones, newest snapshot per work.

    Rows without a usable count say nothing; unknown works are not added.
    """
    newest = snapshot.where(F.col("visits") >= 0).groupBy("work_id").agg(
        F.max_by(F.struct("visits", "last_visited", "synced_at"), F.struct("synced_at", "visits")).alias("seen"))
    hit = F.col("seen").isNotNull()
    joined = works.join(newest, "work_id", "left")
    return joined.withColumns({
        "in_history": hit | F.coalesce("in_history", F.lit(False)),
        "visits": F.when(hit, F.col("seen.visits")).otherwise(F.col("visits")).cast("bigint"),
        "last_visited": F.when(hit, F.col("seen.last_visited")).otherwise(F.col("last_visited")),
        "visits_synced_at": F.when(hit, F.col("seen.synced_at")).otherwise(F.col("visits_synced_at")),
    }).drop("seen")


def reconcile_bookmarks(works: DataFrame, listed: DataFrame, complete: bool) -> DataFrame:
    """Membership from a list; only a complete list can take a work off it.

    ``change`` says what happened to each work: kept, added, dropped or none.
    """
    joined = works.join(
        listed.select("work_id").distinct().withColumn("listed", F.lit(True)), "work_id", "left")
    was, now = F.coalesce("in_bookmarks", F.lit(False)), F.coalesce("listed", F.lit(False))
    after = now if complete else was | now
    return joined.withColumns({
        "change": F.when(was & after, "kept").when(after, "added").when(was, "dropped").otherwise("none"),
        "in_bookmarks": after,
    }).drop("listed")


def mark_works(works: DataFrame, marks: DataFrame) -> DataFrame:
    """Latest mark per (work, field) sets that flag: (work_id, field, on, at)."""
    fields = ("in_bookmarks", "rec", "kudos_given")
    latest = marks.where(F.col("field").isin(*fields)).groupBy("work_id").agg(*[
        F.max_by(F.when(F.col("field") == f, F.col("on")),
                 F.when(F.col("field") == f, F.struct("at", "on"))).alias(f"new_{f}") for f in fields])
    joined = works.join(latest, "work_id", "left")
    return joined.withColumns({f: F.coalesce(f"new_{f}", f) for f in fields}).drop(
        *[f"new_{f}" for f in fields])


# --- the fold -----------------------------------------------------------------

def fold(events: DataFrame, lib: Library, start: DataFrame | None = None, slice_seconds: int = DAY) -> DataFrame:
    """State after the events, for works the library knows.

    ``events`` has (work_id, at, seq, kind, chapter, offset); ``start`` is an
    earlier reading table to go on from.  Chapters read only grow, except where
    a finish, its taking back, or a restart sets them anew.  Between two such
    settings the value is the greater of what was set and the furthest chapter
    left behind, so every slice shrinks to one summary row, and only those are
    put in order per work.  A finish stands for "all of them" and is resolved
    against the work's length at the very end, on one row per work.
    """
    line = _line(events, start, slice_seconds)
    key = ["work_id", "slice"]
    ordered = Window.partitionBy(*key).orderBy("at", "seq")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    back = kind == "unfinished"
    sets = kind.isin("finished", "unfinished", "restart", "start")
    place = F.when(kind == "restart", F.lit(1)).when(kind.isin("progress", "start"), F.col("chapter"))
    line = line.withColumns({"sets": sets, "place": place})
    line = line.withColumns({
        "epoch": F.sum(F.col("sets").cast("int")).over(so_far),
        "here": F.last("place", ignorenulls=True).over(so_far),
    })
    taken_back = F.greatest(F.lit(0), F.col("here") - 1)
    line = line.withColumns({
        "full": kind == "finished",
        "value": F.when(kind == "progress", F.greatest(F.lit(0), F.col("chapter") - 1))
        .when(kind == "start", F.coalesce("read", F.lit(0)))
        .when(back, F.coalesce(taken_back, F.lit(0))).when(sets, F.lit(0)),
        # taken back before this slice said where the reader was
        "open_back": back & F.col("here").isNull(),
    })

    epochs = line.groupBy(*key, "epoch").agg(
        F.bool_or("full").alias("full"), F.max("value").alias("value"),
        F.bool_or("open_back").alias("open_back"),
        F.bool_or((kind == "restart") & F.col("sets")).alias("restarts"),
        *_marks())
    inside = Window.partitionBy(*key).orderBy("epoch")
    before = lambda c: F.lag(c).over(inside)
    # the epoch ended by a restart, when it began in this slice too
    ended = F.col("restarts") & (F.lag("epoch").over(inside) > 0)
    epochs = epochs.withColumns({
        "end_full": F.when(ended, before("full")),
        "end_value": F.when(ended, before("value")),
        "end_back": F.when(ended, before("open_back")),
    })
    first_set = F.col("epoch") == 1
    pre = F.col("epoch") == 0
    last = F.struct("full", "value", "open_back")
    slices = epochs.groupBy(*key).agg(
        F.max(F.when(pre, F.col("value"))).alias("pre_value"),
        F.bool_or(first_set & F.col("restarts")).alias("first_restarts"),
        (F.max("epoch") > 0).alias("sets"),
        F.max_by(last, "epoch").alias("tail"),
        F.bool_or("end_full").alias("end_full"), F.max("end_value").alias("end_value"),
        F.bool_or("end_back").alias("end_back"), *_marks(again=True))
    return _carry(slices, lib)


def _line(events: DataFrame, start: DataFrame | None, slice_seconds: int) -> DataFrame:
    columns = ["work_id", "at", "seq", "kind", "chapter", "offset"]
    line = events.select(*columns).where(F.col("kind").isin(*KINDS)).withColumns({
        "chapter": F.greatest(F.lit(1), F.coalesce("chapter", F.lit(1))).cast("int"),
        "read": F.lit(None).cast("int"), "was_done": F.lit(None).cast("boolean"),
        "opened_at": F.col("at"), "updated_at": F.col("at")})
    line = line.withColumn("slice", time_slice(F.col("at"), slice_seconds))
    if start is None:
        return line
    floor = F.lit("0001-01-01").cast("timestamp")
    held = start.select(
        "work_id", floor.alias("at"), F.lit(-1).cast("bigint").alias("seq"), F.lit("start").alias("kind"),
        "chapter", "offset", F.col("chapters_read").alias("read"),
        F.col("completed_before").alias("was_done"), "opened_at", "updated_at",
        F.lit(-(1 << 62)).alias("slice"))
    return line.unionByName(held)


def _marks(again: bool = False) -> list[Column]:
    """Aggregates that need no carrying: latest stamps and the latest place."""
    if again:
        latest = lambda c: F.max(c).alias(c)
        return [latest(c) for c in ("opened", "wrote", "took_back", "was_done")] + [
            F.min("made").alias("made"), F.max("last_place").alias("last_place")]
    kind, stamp = F.col("kind"), F.struct("at", "seq")
    when = lambda kinds, value: F.when(kind.isin(*kinds), value)
    return [
        F.max(when(("progress", "opened", "restart", "start"), F.col("opened_at"))).alias("opened"),
        F.max(when(("progress", "finished", "restart", "start"), F.col("updated_at"))).alias("wrote"),
        F.max(when(("unfinished",), stamp)).alias("took_back"),
        F.min(F.when(kind != "unfinished", F.struct(
            "at", "seq", "kind"))).alias("made"),
        F.max(when(("progress", "restart", "start"), F.struct(
            "at", "seq", F.when(kind == "restart", F.lit(1)).otherwise(F.col("chapter")).alias("chapter"),
            F.when(kind == "restart", F.lit(0.0)).otherwise(F.col("offset")).alias("offset")))).alias("last_place"),
        F.bool_or(F.coalesce("was_done", F.lit(False))).alias("was_done"),
    ]


def _carry(slices: DataFrame, lib: Library) -> DataFrame:
    line = Window.partitionBy("work_id").orderBy("slice")
    known = F.last("last_place", ignorenulls=True).over(line.rowsBetween(*BEFORE)).getField("chapter")
    back = F.greatest(F.lit(0), F.coalesce("known", F.lit(1)) - 1)
    settle = lambda value, open_back: F.greatest(value, F.when(open_back, back))
    slices = slices.withColumn("known", known).withColumns({
        "end_value": settle(F.col("end_value"), F.col("end_back")),
        "tail_value": settle(F.col("tail.value"), F.col("tail.open_back")),
        "run": F.sum(F.col("sets").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)),
    })
    # within a run of slices only its first one sets anything
    run = Window.partitionBy("work_id", "run").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumns({
        "after_value": F.max("tail_value").over(run),
        "after_full": F.max(F.col("sets") & F.col("tail.full")).over(run),
    }).withColumns({
        "in_value": F.lag("after_value").over(line), "in_full": F.lag("after_full").over(line)})
    first = F.col("first_restarts")
    slices = slices.withColumns({
        "done_value": F.greatest("end_value", F.when(first, F.greatest("in_value", "pre_value"))),
        "done_full": F.coalesce("end_full", F.lit(False)) | (first & F.coalesce("in_full", F.lit(False)))})
    works = slices.groupBy("work_id").agg(
        F.max_by(F.struct("after_value", "after_full"), "slice").alias("now"),
        F.max("done_value").alias("done_value"), F.bool_or("done_full").alias("done_full"),
        *_marks(again=True))
    length = catalog.rows(lib).select("work_id", catalog.chapters_total().cast("int").alias("total"))
    made_by_finish = F.col("made.kind") == "finished"
    taken = F.when(F.struct(F.col("took_back.at"), F.col("took_back.seq"))
                   > F.struct(F.col("made.at"), F.col("made.seq")), F.col("took_back.at"))
    return works.join(length, "work_id").where(F.col("made").isNotNull()).select(
        "work_id",
        F.col("last_place.chapter").alias("chapter"), F.col("last_place.offset").alias("offset"),
        F.when(F.col("now.after_full"), F.greatest("total", "now.after_value"))
        .otherwise(F.coalesce("now.after_value", F.lit(0))).cast("int").alias("chapters_read"),
        (F.col("was_done") | F.col("done_full")
         | F.coalesce(F.col("done_value") >= F.col("total"), F.lit(False))).alias("completed_before"),
        F.greatest("wrote", taken).alias("updated_at"),
        F.greatest("opened", F.when(made_by_finish, F.col("made.at"))).alias("opened_at"))


def merge_fold(lib: Library, folded: DataFrame) -> DataFrame:
    """The reading table with folded works brought up to date."""
    rest = lib.reading.join(folded, "work_id", "left_anti")
    kept = lib.reading.select("work_id", "marked_later", "imported_from", "chapter_count")
    return evolve(rest, READING).unionByName(evolve(folded.join(kept, "work_id", "left"), READING))


# --- a backup of another reader -----------------------------------------------

def from_backup(positions: DataFrame) -> DataFrame:
    """Per-chapter offsets and marks into a place: the furthest chapter touched.

    ``positions`` has (work_id, chapter_count, offsets array, marks array).
    """
    longest = F.greatest(F.size("offsets"), F.size("marks"))
    touched = F.filter(
        F.sequence(F.lit(1), F.greatest(longest, F.lit(1))),
        lambda i: (F.abs(F.coalesce(F.get("offsets", i - 1), F.lit(0.0))) > 1e-9)
        | (F.coalesce(F.get("marks", i - 1), F.lit(0)) != 0))
    furthest = F.coalesce(F.array_max(touched), F.lit(1))
    return positions.withColumn("at", furthest).select(
        "work_id", F.col("at").cast("int").alias("chapter"),
        F.coalesce(F.get("offsets", F.col("at") - 1), F.lit(0.0)).alias("offset"),
        F.size(F.filter("marks", lambda m: m > 0)).alias("chapters_read"),
        F.coalesce(F.nullif(F.col("chapter_count"), F.lit(0)), F.greatest(longest, F.lit(1))).cast("int").alias("chapter_count"))


def import_backup(reading: DataFrame, positions: DataFrame, later: DataFrame, label: str) -> DataFrame:
    """Places replace places; a later mark only ever sets its own flag."""
    new = from_backup(positions).select("work_id", F.struct("chapter", "offset", "chapters_read", "chapter_count").alias("new"))
    wanted = later.select("work_id").distinct().withColumn("wanted", F.lit(True))
    joined = evolve(reading, READING).join(new, "work_id", "full").join(wanted, "work_id", "full")
    taken = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    fresh = F.col("new").isNotNull() | F.col("wanted").isNotNull()
    return joined.select(
        "work_id", taken("chapter"), taken("offset"), taken("chapters_read"),
        F.coalesce("completed_before", F.lit(False)).alias("completed_before"), taken("chapter_count"),
        F.coalesce(F.col("wanted"), F.col("marked_later"), F.lit(False)).alias("marked_later"),
        F.coalesce("imported_from", F.when(fresh, F.lit(label))).alias("imported_from"),
        "updated_at", "opened_at")
