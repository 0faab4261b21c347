"""Dates, author lists and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds a calendar date can stand for; beyond it an epoch is not a date.
LAST_SECOND = 253402300799  # 9999-12-31T23:59:59Z


def epoch_date(epoch: Column) -> Column:
    """The day an epoch falls on; a number that is no date gives NULL.

    Casting alone would saturate at the end of the timestamp range.
    """
    ok = epoch.isNotNull() & ~F.isnan(epoch.cast("double")) & (
        F.abs(epoch.cast("double")) <= LAST_SECOND)
    return F.when(ok, F.timestamp_seconds(epoch.cast("bigint")).cast("date"))


def blurb_date(epoch: Column, shown: Column) -> Column:
    """A listing's day of change: its epoch, else the date it shows people."""
    day = F.trim(F.coalesce(shown, F.lit("")))
    parts = "^(\\d{1,2})\\s+([A-Za-z]{3})[A-Za-z]*\\s+(\\d{4})$"
    spelled = F.concat_ws(
        " ", F.regexp_extract(day, parts, 1),
        F.initcap(F.regexp_extract(day, parts, 2)), F.regexp_extract(day, parts, 3))
    return F.coalesce(
        F.when(epoch > 0, epoch_date(epoch)),
        F.when(day.rlike(parts), F.try_to_timestamp(spelled, F.lit("d MMM yyyy")).cast("date")))


def visited_at(text: Column) -> Column:
    """A visit written as an ISO date or time, or as ``24 Sep 2026``."""
    said = F.trim(text)
    spelled = F.when(said.rlike("^\\d{1,2} [A-Za-z]{3} \\d{4}$"), F.initcap(said))
    return F.coalesce(
        F.when(said.rlike("^\\d{4}-"), said).try_cast("timestamp"),
        F.try_to_timestamp(spelled, F.lit("d MMM yyyy")))


def authors_of(raw: Column) -> Column:
    """Names out of a JSON array; anything else is nobody."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def held_as_of(downloaded: Column, updated: Column, completed: Column, published: Column) -> Column:
    """How current a stored copy is: when it was taken beats what it says."""
    return F.coalesce(downloaded, updated, completed, published)


def visit_label(local: Column, archive: Column) -> Column:
    total = F.coalesce(local, F.lit(0)) + F.coalesce(archive, F.lit(0))
    known = archive.isNotNull() | (F.coalesce(local, F.lit(0)) > 0)
    return F.when(known, F.concat(
        total.cast("string"), F.when(total == 1, " visit").otherwise(" visits"))
    ).otherwise(F.lit(""))


def visit_breakdown(local: Column, archive: Column, there: str = "AO3", here: str = "this library") -> Column:
    seen = F.coalesce(local, F.lit(0))
    known = archive.isNotNull() | (seen > 0)
    return F.when(known, F.concat(
        F.coalesce(F.concat(archive.cast("string"), F.lit(f" on {there}")), F.lit(f"{there} not synced")),
        F.lit(" · "), seen.cast("string"), F.lit(f" in {here}"))
    ).otherwise(F.lit(""))


def complete_by_count(chapters: Column, planned: Column) -> Column:
    return F.coalesce(chapters >= planned, F.lit(False))


def stats_line(text: Column) -> dict[str, Column]:
    """Columns of a line such as ``Published: … Words: 1,234 Chapters: 3/?``."""
    def day(label: str) -> Column:
        found = F.regexp_extract(text, f"(?i){label}:\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})", 1)
        return F.when(found != "", found)

    def number(pattern: str, group: int) -> Column:
        found = F.regexp_replace(F.regexp_extract(text, pattern, group), ",", "")
        return F.when(found.rlike("^\\d+$"), found.try_cast("bigint"))

    chapters = "(?i)Chapters:\\s*(\\d+)\\s*/\\s*(\\d+|\\?)"
    done, planned = number(chapters, 1), number(chapters, 2)
    completed = day("Completed")
    return {
        "published": day("Published"),
        "completed": completed,
        "updated": F.coalesce(day("Updated"), completed),
        "words": number("(?i)Words:\\s*([\\d,]+)", 1),
        "chapters": done,
        "chapters_planned": planned,
        "complete": F.when(done.isNotNull(),
                           completed.isNotNull() | F.coalesce(done == planned, F.lit(False))),
    }
