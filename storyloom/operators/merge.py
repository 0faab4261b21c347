"""Folding one library into another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.model import KEYS, Library, WORKS, evolve
from storyloom.operators import admin, versions

# What the incoming copy of a work is the authority on.  Kudos
# given and the visit snapshot are the device's own and have other rules.
FROM_INCOMING = (
    "title", "authors", "summary", "rating", "language", "published", "updated",
    "downloaded_at", "complete", "words", "chapter_count", "chapters_planned",
    "updated_at", "skin_css", "skin_hash", "end_notes_html", "source", "source_file",
    "fetched_at", "in_bookmarks", "rec", "in_history", "bookmarked_at", "kudos",
    "bookmark_count", "hits",
)
SNAPSHOT = ("visits", "last_visited", "visits_synced_at")


def add_missing(held: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: held rows win, incoming ones fill the gaps once each.

    Of several incoming rows of one key the first by all their values is taken,
    so a run gives what the run before gave.
    """
    rest = [c for c in incoming.columns if c not in key]
    fresh = incoming.join(held.select(*key).distinct(), list(key), "left_anti")
    if rest:
        fresh = fresh.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*").select(*incoming.columns)
    else:
        fresh = fresh.distinct()
    return held.unionByName(fresh, allowMissingColumns=True)


def replace_for(held: DataFrame, incoming: DataFrame, works: DataFrame) -> DataFrame:
    """Rows of the arriving works replace all held rows of those works."""
    return held.join(works.select("work_id"), "work_id", "left_anti").unionByName(incoming)


def works(device: DataFrame, incoming: DataFrame) -> DataFrame:
    """Every work of either side, each column by its own rule."""
    d = device.select("work_id", F.struct(*[c for c in device.columns if c != "work_id"]).alias("d"))
    i = incoming.select("work_id", F.struct(*[c for c in incoming.columns if c != "work_id"]).alias("i"))
    here, there = F.col("d").isNotNull(), F.col("i").isNotNull()
    newer = _takes_snapshot(here)

    def column(name: str) -> Column:
        if name == "work_id":
            return F.col(name)
        if name in FROM_INCOMING:
            return F.when(there, F.col(f"i.{name}")).otherwise(F.col(f"d.{name}")).alias(name)
        if name in SNAPSHOT:
            return F.when(there & newer, F.col(f"i.{name}")).otherwise(F.col(f"d.{name}")).alias(name)
        default = F.lit(False) if name in ("kudos_given", "has_text", "hidden") else F.lit(None)
        return F.coalesce(F.col(f"d.{name}"), default).alias(name)

    return evolve(d.join(i, "work_id", "full").select(*map(column, WORKS.fieldNames())), WORKS)


def _takes_snapshot(here: Column) -> Column:
    """A later stamp wins; unstamped counts win only by being larger."""
    mine, theirs = F.col("d.visits_synced_at"), F.col("i.visits_synced_at")
    later = theirs.isNotNull() & (mine.isNull() | (theirs > mine))
    larger = mine.isNull() & theirs.isNull() & (F.col("i.visits") > F.col("d.visits"))
    return F.col("i.visits").isNotNull() & (
        ~here | F.col("d.visits").isNull() | later | F.coalesce(larger, F.lit(False)))


def libraries(device: Library, incoming: Library, at: Column | str, respect_tombstones: bool = True) -> Library:
    """The device's library with the incoming one folded in.

    What the archive knows comes from the incoming side; reading places, kudos
    and deletions stay the device's.  Running it again changes nothing.
    """
    if respect_tombstones:
        incoming = incoming.with_(**{
            name: admin.gate_deleted(getattr(incoming, name), device.deleted) for name in admin.OWNED})
    changes = versions.diff(
        device.chapters, incoming.chapters, tx.normalise_lightly, works=incoming.works)
    # markup missing on either side compares as unknown, so as no change
    aside = versions.superseded(device.chapters, changes, at, with_hash=False)
    chapters = replace_for(device.chapters, incoming.chapters, incoming.works)
    merged = admin.repair_has_text(works(device.works, incoming.works), chapters)
    return device.with_(
        works=admin.hidden(merged, device.blocked),
        chapters=chapters,
        tags=replace_for(device.tags, incoming.tags, incoming.works).dropDuplicates(list(KEYS["tags"])),
        chapter_versions=add_missing(
            device.chapter_versions.unionByName(aside), incoming.chapter_versions, KEYS["chapter_versions"]),
        skin_versions=add_missing(device.skin_versions, incoming.skin_versions, KEYS["skin_versions"]),
        visits=add_missing(
            device.visits, incoming.visits.join(merged.select("work_id"), "work_id", "left_semi"), KEYS["visits"]),
        images=add_missing(device.images, incoming.images, KEYS["images"]),
        reading=add_missing(device.reading, incoming.reading, KEYS["reading"]),
    )
