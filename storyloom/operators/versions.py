"""Telling real changes from noise, and keeping what they replace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.model import CHAPTER_VERSIONS, Library, SKIN_VERSIONS, evolve
from storyloom.operators.ordered import next_at_or_after

Normaliser = Callable[[Column], Column]
KEY = ["work_id", "number"]


def _hashes(chapters: DataFrame, normaliser: Normaliser, name: str) -> DataFrame:
    """Text shrinks to its hash before any shuffle."""
    return chapters.select(
        *KEY, F.sha2(normaliser(F.col("html")), 256).alias(name), F.lit(True).alias(f"has_{name}"))


def diff(held: DataFrame, incoming: DataFrame, normaliser: Normaliser = tx.normalise,
         works: DataFrame | None = None) -> DataFrame:
    """Per chapter of the incoming works: new, content, removed or none.

    ``works`` names the works that arrived, when some may have no chapters.
    """
    arrived = (incoming if works is None else works).select("work_id").distinct()
    before = _hashes(held.join(arrived, "work_id", "left_semi"), normaliser, "before")
    after = _hashes(incoming, normaliser, "after")
    change = (
        F.when(F.col("has_before").isNull(), "new").when(F.col("has_after").isNull(), "removed")
        .when(F.col("before") != F.col("after"), "content").otherwise("none"))
    return before.join(after, KEY, "full").select(
        *KEY, change.alias("change"), F.col("before").alias("previous_hash"), F.col("after").alias("hash"))


def skin_diff(held: DataFrame, incoming: DataFrame, exact: bool = False) -> DataFrame:
    """Whether each incoming work's layout changed, gained or lost included."""
    css = lambda c: F.coalesce(c, F.lit(""))
    seen = (lambda c: css(c)) if exact else (lambda c: tx.normalise(c))
    both = held.select("work_id", F.col("skin_css").alias("old")).join(
        incoming.select("work_id", F.col("skin_css").alias("new")), "work_id", "right")
    moved = (css(F.col("old")) != css(F.col("new"))) & (
        F.sha2(seen(F.col("old")), 256) != F.sha2(seen(F.col("new")), 256))
    return both.select(
        "work_id", F.when(moved, "layout").otherwise("none").alias("change"),
        F.when(moved, F.sha2(seen(F.col("old")), 256)).alias("previous_hash"),
        F.col("old").alias("previous_css"))


def superseded(held: DataFrame, changes: DataFrame, at: Column | str, with_hash: bool = True) -> DataFrame:
    """Full rows of the chapters a change replaces or removes.

    Only keys and hashes were compared; the text is fetched for what changed.
    """
    gone = changes.where(F.col("change").isin("content", "removed")).groupBy("work_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "number", F.struct(F.col("change").alias("reason"), F.when(F.col("change") == "content", F.col("previous_hash")).alias("hash"))))).alias("gone"))
    # by work alone: a table that lies bucketed by work stays where it is
    kept = held.join(gone, "work_id").withColumn("_why", F.element_at("gone", F.col("number"))).where(F.col("_why").isNotNull()).select(
        *KEY, "title", "html", "text", "words",
        (F.col("_why.hash") if with_hash else F.lit(None).cast("string")).alias("content_hash"),
        F.col("_why.reason").alias("reason"), F.lit(at).cast("timestamp").alias("archived_at"))
    return evolve(kept, CHAPTER_VERSIONS)


def archive(lib: Library, incoming: Library, at: Column | str, exact_skins: bool = False) -> Library:
    """The library with everything an update would replace put aside first."""
    changes = diff(lib.chapters, incoming.chapters, works=incoming.works)
    skins = skin_diff(lib.works, incoming.works, exact_skins).where(
        (F.col("change") == "layout") & (F.coalesce("previous_css", F.lit("")) != ""))
    old_skins = evolve(skins.select(
        "work_id", F.col("previous_css").alias("skin_css"), F.col("previous_hash").alias("skin_hash"),
        F.lit(at).cast("timestamp").alias("archived_at")), SKIN_VERSIONS)
    return lib.with_(
        chapter_versions=lib.chapter_versions.unionByName(superseded(lib.chapters, changes, at)),
        skin_versions=lib.skin_versions.unionByName(old_skins))


def history(lib: Library, ids: DataFrame) -> DataFrame:
    """Archived copies, newest first, without their text."""
    return (
        lib.chapter_versions.join(ids.select("work_id"), "work_id", "left_semi")
        .select("work_id", "number", "title", "words", "reason", "archived_at")
        .orderBy("work_id", F.col("archived_at").desc(), "number"))


def skin_asof(lib: Library) -> DataFrame:
    """The skin in force when each archived chapter was put aside.

    That is the first skin archived at or after it, else the current one.
    """
    copies = lib.chapter_versions.select("work_id", "number", "archived_at")
    found = next_at_or_after(
        copies.withColumn("skin_css", F.lit(None).cast("string")).drop("skin_css"),
        lib.skin_versions.where(F.col("archived_at").isNotNull()), "work_id", "archived_at",
        F.col("skin_hash"), "skin_css")
    current = lib.works.select("work_id", F.col("skin_css").alias("now_css"))
    return found.join(current, "work_id", "left").select(
        "work_id", "number", "archived_at", F.coalesce("skin_css", "now_css").alias("skin_css"))


def keep_books_as_versions(lib: Library, books: Library, at: Column | str) -> tuple[Library, Library]:
    """Split arriving books by whether an archive copy is already held.

    A copy from the archive is never overwritten by a book: such a book is kept
    as a version.  The second library is what may be stored.
    """
    ours = lib.works.where(F.col("source") == "ao3").select("work_id")
    aside = books.chapters.join(ours, "work_id", "left_semi").select(
        *KEY, "title", "html", "text", "words", F.lit(None).cast("string").alias("content_hash"),
        F.lit("epub").alias("reason"), F.lit(at).cast("timestamp").alias("archived_at"))
    kept = lib.with_(chapter_versions=lib.chapter_versions.unionByName(evolve(aside, CHAPTER_VERSIONS)))
    free = lambda df: df.join(ours, "work_id", "left_anti")
    return kept, books.with_(works=free(books.works), chapters=free(books.chapters), tags=free(books.tags))
