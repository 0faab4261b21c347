"""The front page: short ordered shelves and how many works each stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.model import Library
from storyloom.operators import catalog

SHORT_WORDS = 5000


def _shelf(key: str, seed: int) -> dict[str, Column]:
    """Membership and order: ``most`` descending, then ``text`` ascending."""
    done = F.coalesce("complete", F.lit(False))
    match key:
        case "reading":
            return {"on": catalog.state("reading"), "most": F.unix_micros(catalog.local_last_read()),
                    "down": F.col("work_id")}
        case "added":
            added = F.coalesce(F.col("fetched_at"), F.col("downloaded_at").cast("timestamp"))
            return {"on": F.lit(True), "most": F.unix_micros(added)}
        case "updated":
            return {"on": F.col("updated").isNotNull(), "most": F.unix_date("updated")}
        case "long":
            return {"on": done & catalog.state("unread"), "most": F.col("words")}
        case "short":
            return {"on": done & (F.col("words") < SHORT_WORDS) & catalog.state("unread"),
                    "text": catalog.shuffled(seed)}
        case "later":
            return {"on": catalog.state("later"), "text": F.col("title")}
        case "visits":
            return {"on": catalog.total_visits() > 0, "most": catalog.total_visits(),
                    "text": F.col("title")}
    raise ValueError(f"no shelf called {key}")


SHELVES = ("reading", "added", "updated", "long", "short", "later", "visits")


def all(lib: Library, k: int = 12, seed: int = 0, keys: tuple[str, ...] = SHELVES) -> DataFrame:
    """Up to ``k`` works of each shelf with the shelf's whole size.

    Each work is laid out once per shelf it is on, so one scan serves every
    shelf, and the rank limit runs before anything is shuffled.
    """
    made = {key: _shelf(key, seed) for key in keys}
    entries = F.array(*[
        F.struct(F.lit(shelf).alias("shelf"), F.coalesce(v["on"], F.lit(False)).alias("on"),
                 v.get("most", F.lit(None)).cast("bigint").alias("most"),
                 v.get("text", F.lit(None)).cast("string").alias("text"),
                 v.get("down", F.lit(None)).cast("string").alias("down"))
        for shelf, v in made.items()])
    laid = (
        catalog.visible(catalog.rows(lib))
        .select("work_id", "title", "words", F.inline(entries))
        .where(F.col("on")))
    order = Window.partitionBy("shelf").orderBy(
        F.col("most").desc_nulls_last(), F.collate("text", "UTF8_LCASE").asc_nulls_first(),
        F.col("down").desc_nulls_last(), F.col("work_id"))
    top = laid.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    totals = laid.groupBy("shelf").agg(F.count(F.lit(1)).alias("total"))
    return top.join(totals, "shelf").select("shelf", "place", "work_id", "title", "words", "total")


def surprise(lib: Library, seed: int = 0) -> DataFrame:
    """One unread work."""
    return (catalog.visible(catalog.rows(lib)).where(catalog.state("unread"))
            .orderBy(catalog.shuffled(seed), "work_id").limit(1).select("work_id"))


def return_to_story(lib: Library) -> DataFrame:
    """The work opened last among those whose text is here, hidden ones aside."""
    held = lib.chapters.where(F.length(F.coalesce("html", F.lit(""))) > 0).select("work_id")
    opened = lib.reading.where(F.col("opened_at").isNotNull()).select(
        "work_id", "opened_at", F.col("updated_at").alias("read_at"))
    return (
        lib.works.where(~F.coalesce("hidden", F.lit(False))).select("work_id", "title")
        .join(opened, "work_id").join(held, "work_id", "left_semi")
        .orderBy(F.col("opened_at").desc(), F.col("read_at").desc_nulls_last(), "work_id").limit(1))
