"""Deleting, blocking and putting a library's derived columns right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.model import BLOCKED, DELETED, Library, evolve

#: Tables that hold a work's own rows; its index and tombstone are apart.
OWNED = ("chapters", "tags", "images", "chapter_versions", "skin_versions", "visits", "reading", "works")
# Hashes of pictures that say an image is withheld or removed.
PLACEHOLDER_IMAGES = (
    "faa24ec881e6040655c187a681d6dc496eb8aa41e1bd0652a180b3a40b457187",
    "9b5936f4006146e4e1e9025b474c02863c0b5614132ad40db4b925a10e8bfbb9",
)


# --- deletion -----------------------------------------------------------------

def delete(lib: Library, ids: DataFrame, at: Column | str) -> Library:
    """Take works out of every table they own and remember that they went."""
    gone = ids.select("work_id").distinct()
    titles = lib.works.select("work_id", "title")
    stones = gone.join(titles, "work_id", "left").select(
        "work_id", "title", F.lit(at).cast("timestamp").alias("at"))
    kept = {name: getattr(lib, name).join(gone, "work_id", "left_anti") for name in OWNED}
    older = lib.deleted.join(gone, "work_id", "left_anti")
    return lib.with_(**kept, deleted=older.unionByName(evolve(stones, DELETED)))


def allow_again(lib: Library, ids: DataFrame) -> Library:
    return lib.with_(deleted=lib.deleted.join(ids.select("work_id"), "work_id", "left_anti"))


def gate_deleted(arriving: DataFrame, deleted: DataFrame) -> DataFrame:
    """Works taken out on purpose do not come back by being listed."""
    return arriving.join(deleted.select("work_id"), "work_id", "left_anti")


# --- blocking -----------------------------------------------------------------

def solely_by(works: DataFrame, names: DataFrame) -> DataFrame:
    """Identifiers of works all of whose authors are among ``names``.

    No list of names is ever gathered; a work nobody is named on is not here.
    """
    each = works.select("work_id", F.explode("authors").alias("name"))
    marked = names.select("name").distinct().withColumn("among", F.lit(True))
    return (
        each.join(marked, "name", "left").groupBy("work_id")
        .agg(F.every(F.coalesce("among", F.lit(False))).alias("all"))
        .where("all").select("work_id"))


def hidden(works: DataFrame, blocked: DataFrame) -> DataFrame:
    """The hidden flag restated: every author of the work is blocked."""
    out = solely_by(works, blocked).withColumn("_out", F.lit(True))
    return works.join(out, "work_id", "left").withColumn(
        "hidden", F.coalesce("_out", F.lit(False))).drop("_out")


def _restate(lib: Library, name: str, blocked: DataFrame) -> Library:
    """Only works the one name is on can change."""
    theirs = lib.works.where(F.array_contains("authors", name))
    out = solely_by(theirs, blocked).withColumn("_out", F.lit(True))
    works = lib.works.join(out, "work_id", "left").withColumn(
        "hidden", F.when(F.array_contains("authors", name), F.coalesce("_out", F.lit(False)))
        .otherwise(F.col("hidden"))).drop("_out")
    return lib.with_(works=works, blocked=blocked)


def block_author(lib: Library, name: str, at: Column | str) -> Library:
    row = lib.blocked.sparkSession.range(1).select(
        F.lit(name).alias("name"), F.lit(at).cast("timestamp").alias("at"))
    blocked = lib.blocked.where(F.col("name") != name).unionByName(evolve(row, BLOCKED))
    return _restate(lib, name, blocked)


def unblock_author(lib: Library, name: str) -> Library:
    return _restate(lib, name, lib.blocked.where(F.col("name") != name))


def block_impact(works: DataFrame, names: DataFrame) -> DataFrame:
    """How many works blocking would take, and how long they are together."""
    return works.join(solely_by(works, names), "work_id", "left_semi").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))


# --- repairs ------------------------------------------------------------------

def repair_has_text(works: DataFrame, chapters: DataFrame) -> DataFrame:
    """Text is here when chapters are, whatever the flag said."""
    held = chapters.select("work_id").distinct().withColumn("_held", F.lit(True))
    return works.join(held, "work_id", "left").withColumn(
        "has_text", F.coalesce("_held", F.lit(False))).drop("_held")


def repair_complete(works: DataFrame) -> DataFrame:
    """As many chapters as planned is finished; nothing is unfinished by this."""
    reached = F.coalesce(F.col("chapter_count") >= F.col("chapters_planned"), F.lit(False))
    return works.withColumn("complete", F.when(reached, F.lit(True)).otherwise(F.col("complete")))


def drop_bad_images(images: DataFrame) -> DataFrame:
    """Ledger rows whose picture is really one."""
    return images.where(
        (F.length("sha256") == 64) & (F.length("bytes") > 0)
        & ~F.col("sha256").isin(*PLACEHOLDER_IMAGES))


def distinct_pictures(images: DataFrame) -> DataFrame:
    """Each picture once, by what it contains; the first stored row names it.

    The row is chosen by keys alone, and its bytes are fetched for what was chosen; a
    work and an address name one row.
    """
    keyed = images.where(F.col("sha256").isNotNull())
    first = keyed.groupBy("sha256").agg(
        F.min(F.struct("fetched_at", "work_id", "url")).alias("first"), F.count(F.lit(1)).alias("uses")).alias("first")
    each = keyed.alias("each")
    met = each.join(first, (F.col("each.sha256") == F.col("first.sha256")) & reduce(Column.__and__, [
        F.col(f"each.{c}").eqNullSafe(F.col(f"first.first.{c}")) for c in ("fetched_at", "work_id", "url")]))
    return met.select("each.sha256", "each.mime", "each.bytes", "each.url", "first.uses")
