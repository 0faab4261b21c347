"""From what listings say and what is held to what needs doing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.functions.values import blurb_date, epoch_date, held_as_of
from storyloom.model import Library, TAGS, WORKS, evolve
from storyloom.operators import admin, catalog

ACTIONS = ("fetch", "refetch", "skin", "skip")
STAGES = ("phantom", "bookmarks", "refetch", "skins", "history")
# Works to a listing page, pauses between requests.
PER_PAGE = 20
PAGE_GAP_MS = 28_000
FETCH_GAP_MS = 29_000
#: Arrays of a listing entry and the tag kind each holds.
TAG_FIELDS = (
    ("fandoms", "fandom"), ("relationships", "relationship"), ("characters", "character"),
    ("freeform", "freeform"), ("warnings", "warning"), ("categories", "category"),
)


# --- listings -----------------------------------------------------------------

def merge_listings(bookmarks: DataFrame, history: DataFrame) -> DataFrame:
    """Both lists as one, each work once, the bookmark's fields first.

    Columns only one list has are kept; the newer epoch stays, and none is NULL.
    """
    own = [c for c in bookmarks.columns if c not in ("work_id", "updated_at")]
    more = [c for c in history.columns if c not in ("work_id", "updated_at", *own)]
    b = bookmarks.select("work_id", F.struct(*[c for c in bookmarks.columns if c != "work_id"]).alias("b"))
    h = history.select("work_id", F.struct(*[c for c in history.columns if c != "work_id"]).alias("h"))
    marked, seen = F.col("b").isNotNull(), F.col("h").isNotNull()

    def shared(name: str) -> Column:
        theirs = F.col(f"h.{name}") if name in history.columns else F.lit(None)
        return F.when(marked, F.col(f"b.{name}")).otherwise(theirs).alias(name)

    newest = F.greatest(F.coalesce("b.updated_at", F.lit(0)), F.coalesce("h.updated_at", F.lit(0)))
    return b.join(h, "work_id", "full").select(
        "work_id", *map(shared, own), *[F.col(f"h.{c}").alias(c) for c in more],
        F.nullif(newest, F.lit(0)).alias("updated_at"),
        marked.alias("in_bookmarks"), seen.alias("in_history"))


def sync(listed: DataFrame, held: DataFrame, want_skins: bool = True, label: str = "AO3") -> DataFrame:
    """One action and reason for each listed work.

    ``held`` has (work_id, downloaded_at, updated, completed, published,
    needs_skin, skin_css).  No date on either side is no evidence of change.
    """
    ours = held.select(
        "work_id", F.lit(True).alias("have"),
        held_as_of(*map(F.col, ("downloaded_at", "updated", "completed", "published"))).alias("held_on"),
        (F.coalesce("needs_skin", F.lit(False)) & (F.coalesce("skin_css", F.lit("")) == "")).alias("bare"))
    both = listed.select("work_id", epoch_date(F.col("updated_at")).alias("listed_on")).join(ours, "work_id", "left")
    newer = F.coalesce(F.col("listed_on") > F.col("held_on"), F.lit(False))
    action = F.when(F.col("have").isNull(), "fetch").when(newer, "refetch")
    if want_skins:
        action = action.when(F.col("bare"), "skin")
    both = both.withColumn("action", action.otherwise("skip"))
    reason = (
        F.when(F.col("action") == "fetch", "not held")
        .when(F.col("action") == "refetch", F.concat(
            F.lit(f"{label} "), F.col("listed_on").cast("string"), F.lit(" > held "), F.col("held_on").cast("string")))
        .when(F.col("action") == "skin", "custom markup with no skin stored")
        .otherwise("held and current"))
    return both.select("work_id", "action", reason.alias("reason"))


def counts(plan: DataFrame) -> DataFrame:
    """How many of each action, in one row."""
    n = {a: F.count_if(F.col("action") == a) for a in ACTIONS}
    return plan.agg(
        F.count(F.lit(1)).alias("listed"), *[c.alias(a) for a, c in n.items()],
        (n["fetch"] + n["refetch"] + n["skin"]).alias("requests"))


def cost(requests: Column, gap_ms: int = FETCH_GAP_MS) -> dict[str, Column]:
    """Hours a number of requests takes, as a number and as said."""
    ms = requests * gap_ms
    hours = ms / 3_600_000
    said = F.when(hours < 1, F.concat(F.floor(ms / 60_000 + 0.5).cast("string"), F.lit(" min"))).otherwise(
        F.concat(F.format_string("%.1f", hours), F.lit(" hours")))
    return {"requests": requests, "hours": F.round(hours, 1), "human": said}


def listing_cost(total_pages: Column) -> dict[str, Column]:
    pages = F.greatest(F.lit(1), F.coalesce(total_pages, F.lit(1)))
    return {"pages": pages, "works": pages * PER_PAGE,
            "minutes": F.ceil(pages * PAGE_GAP_MS / 60_000).cast("bigint")}


def bookmark_frontier(pages: DataFrame, bookmarked: DataFrame, held: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Entries of a newest-first list up to the first page with nothing new.

    ``pages`` has (page, total_pages, work_id).  That page still counts; a caller
    may look at its first ``max_pages`` alone.  The
    walk is complete only when it came to the last page; familiar entries say
    nothing of pages further down.
    """
    known = bookmarked.select("work_id").distinct().withColumn("known", F.lit(True))
    here = held.select("work_id").distinct().withColumn("held", F.lit(True))
    last = F.lit(max_pages) if max_pages is not None else pages.agg(F.max("page").alias("page")).scalar()
    entries = (pages if max_pages is None else pages.where(F.col("page") <= max_pages)).join(known, "work_id", "left").join(here, "work_id", "left")
    per_page = entries.groupBy("page").agg(
        F.count_if(F.col("known").isNull()).alias("new"), F.max("total_pages").alias("total"))
    stop = per_page.agg(
        F.min(F.when(F.col("new") == 0, F.col("page"))).alias("stop"),
        F.max("total").alias("total"))
    ends = F.coalesce(stop.select("stop").scalar(), last)
    whole = stop.select("total").scalar()
    return entries.where(F.col("page") <= ends).select(
        "work_id", "page", F.col("held").isNull().alias("needed"),
        (F.col("known").isNull()).alias("new"), (ends >= whole).alias("complete"))


def needs_fetching(listed: DataFrame, lib: Library) -> DataFrame:
    """Listed works worth asking for: wanted, and unknown, textless or older.

    ``listed`` has (work_id, authors, updated_at, datetime).
    """
    wanted = admin.gate_deleted(listed, lib.deleted)
    wanted = wanted.join(admin.solely_by(wanted, lib.blocked), "work_id", "left_anti")
    ours = lib.works.select("work_id", F.lit(True).alias("known"), "has_text", F.col("updated").alias("held_on"))
    on = blurb_date(F.col("updated_at"), F.col("datetime"))
    stale = F.coalesce(on > F.col("held_on"), F.lit(False))
    return wanted.join(ours, "work_id", "left").where(
        F.col("known").isNull() | ~F.coalesce("has_text", F.lit(False)) | stale).select("work_id")


def phantom_chapters(listed: DataFrame, works: DataFrame) -> DataFrame:
    """Works holding more chapters than the archive says there are."""
    said = listed.select("work_id", F.col("chapters").alias("listed_chapters"))
    return works.select("work_id", "chapter_count").join(said, "work_id").where(
        F.col("chapter_count") > F.col("listed_chapters"))


def backlog(listed: DataFrame, held: DataFrame, works: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Works to ask for, each in the first stage that names it.

    ``listed`` also has ``in_bookmarks`` and ``chapters``.
    """
    plan = sync(listed, held).join(listed.select("work_id", "in_bookmarks"), "work_id")
    marked = F.coalesce("in_bookmarks", F.lit(False))
    stage = (
        F.when((F.col("action") == "fetch") & marked, 2).when(F.col("action") == "refetch", 3)
        .when(F.col("action") == "skin", 4).when(F.col("action") == "fetch", 5))
    rows = plan.select("work_id", stage.alias("rank")).where(F.col("rank").isNotNull()).unionByName(
        phantom_chapters(listed, works).select("work_id", F.lit(1).alias("rank")))
    first = rows.groupBy("work_id").agg(F.min("rank").alias("rank"))
    if done is not None:
        first = first.join(done.select("work_id"), "work_id", "left_anti")
    return first.withColumn("stage", F.element_at(F.array(*map(F.lit, STAGES)), F.col("rank")))


def without_text(lib: Library) -> DataFrame:
    """Visible works with no chapters, in the order they are asked for."""
    return catalog.visible(catalog.rows(lib)).where(F.col("held_chapters").isNull()).select(
        "work_id", F.coalesce("updated", "published").alias("changed"))


def _newest(works: DataFrame, limit: int | None) -> DataFrame:
    ordered = works.orderBy(F.col("changed").desc_nulls_last(), F.col("work_id").desc())
    return ordered if limit is None else ordered.limit(limit)


def stub_backlog(lib: Library, limit: int | None = None) -> DataFrame:
    """The whole backlog, newest first, or as many as a caller asks for."""
    return _newest(without_text(lib), limit)


def auto_batch(lib: Library, considered: DataFrame, items: DataFrame, limit: int | None = None) -> DataFrame:
    """The next works to queue: not tried before and not on their way.

    ``items`` has (work_id, job_state, state) of every job's items.
    """
    pending = items.where(
        ~F.col("job_state").isin("done", "cancelled")
        & F.col("state").isin("waiting", "downloading", "retrying"))
    return _newest(without_text(lib).join(considered.select("work_id"), "work_id", "left_anti").join(
        pending.select("work_id"), "work_id", "left_anti"), limit)


def verify_saved(items: DataFrame, chapters: DataFrame) -> DataFrame:
    """Items called downloaded whose work still has no chapters."""
    return items.where(F.col("state") == "downloaded").select("work_id").distinct().join(
        chapters.select("work_id"), "work_id", "left_anti")


# --- listings into the library ------------------------------------------------

def _stub(listed: DataFrame, *more: str) -> DataFrame:
    """A works row from what a listing says, without text; further columns of the listing may come along."""
    return evolve(listed.select(
        "work_id", "title", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"),
        "summary", "rating", "language", F.coalesce("complete", F.lit(False)).alias("complete"),
        "words", F.col("chapters").alias("chapter_count"), "chapters_planned", "kudos",
        "bookmark_count", "hits", "updated_at", F.lit("listing").alias("source"), *more), WORKS)


def _stub_tags(listed: DataFrame) -> DataFrame:
    def named(field: str, kind: str) -> Column:
        return F.transform(F.coalesce(field, F.array().cast("array<string>")),
                           lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    each = F.flatten(F.array(*[named(field, kind) for field, kind in TAG_FIELDS]))
    return evolve(listed.select("work_id", F.inline(each)).distinct(), TAGS)


def apply_listings(lib: Library, bookmarks: DataFrame, history: DataFrame, flag_new: bool = False) -> Library:
    """Write what the listings know onto the works, known or not.

    Flags are restated from the listings.  Works only described are added with
    their tags; as the flags of bookmarks are set before that, they show on
    such works from the next run on unless ``flag_new``.  Counts a listing is
    silent on stay.
    """
    columns = ("title", "authors", "summary", "rating", "language", "complete", "words", "chapters",
               "chapters_planned", "kudos", "bookmark_count", "hits", "updated_at",
               *[f for f, _ in TAG_FIELDS])
    # a bookmark and a visit of a work are one row, so that entries listed twice meet each of the other list once
    said = merge_listings(
        bookmarks.select("work_id", *columns, "bookmarked_at", F.coalesce("bookmark_rec", F.lit(False)).alias("rec"), F.col("updated_at").alias("mine")),
        history.select("work_id", *columns, "last_visited", "visits"))
    # the stub and the counts take the bookmark's row whole, epoch included
    said = said.withColumn("updated_at", F.when(F.col("in_bookmarks"), F.col("mine")).otherwise(F.col("updated_at"))).withColumn("l", F.struct(
        "in_bookmarks", "rec", "bookmarked_at", "in_history", "last_visited", "visits", "kudos", "bookmark_count", "hits"))
    fresh = said.join(lib.works.select("work_id"), "work_id", "left_anti")
    known = lib.works.join(said.select("work_id", "l"), "work_id", "left").withColumn("_old", F.lit(True))
    works = known.unionByName(_stub(fresh, "l").withColumn("_old", F.lit(flag_new)))
    marked = F.coalesce("l.in_bookmarks", F.lit(False)) & F.col("_old")
    visited = F.coalesce("l.in_history", F.lit(False))
    works = works.withColumns({
        "in_bookmarks": marked, "rec": marked & F.coalesce("l.rec", F.lit(False)),
        "bookmarked_at": F.when(marked, F.col("l.bookmarked_at")).otherwise(F.col("bookmarked_at")),
        "in_history": visited,
        "last_visited": F.when(visited, F.col("l.last_visited")).otherwise(F.col("last_visited")),
        "visits": F.when(visited, F.col("l.visits")).otherwise(F.col("visits")),
        "downloaded_at": F.coalesce("downloaded_at", F.col("fetched_at").cast("date")),
        **{c: F.coalesce(f"l.{c}", c) for c in ("kudos", "bookmark_count", "hits")},
    }).drop("_old", "l")
    held = lib.chapters.select("work_id").distinct().withColumn("_held", F.lit(True))
    works = works.join(held, "work_id", "left").withColumn(
        "has_text", F.coalesce("has_text", F.lit(False)) | F.coalesce("_held", F.lit(False))).drop("_held")
    return lib.with_(works=evolve(works, WORKS), tags=lib.tags.unionByName(_stub_tags(fresh)))


REFRESHED = ("title", "authors", "summary", "rating", "language", "complete", "words", "chapter_count",
             "chapters_planned", "kudos", "bookmark_count", "hits", "source", "has_text")


def save_stubs(lib: Library, listed: DataFrame) -> Library:
    """Insert unknown works; refresh only entries that described no story."""
    arriving = admin.gate_deleted(listed, lib.deleted)
    stubs = _stub(arriving)
    empty = catalog.rows(lib).where(catalog.placeholder()).select("work_id")
    renew = stubs.join(empty, "work_id", "left_semi")
    new = stubs.join(lib.works.select("work_id"), "work_id", "left_anti")
    update = renew.select("work_id", F.struct(*REFRESHED).alias("n"))
    works = lib.works.join(update, "work_id", "left")
    works = works.withColumns({
        c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)) for c in REFRESHED}).drop("n")
    touched = renew.select("work_id").unionByName(new.select("work_id"))
    tags = lib.tags.join(renew.select("work_id"), "work_id", "left_anti").unionByName(
        _stub_tags(arriving.join(touched, "work_id", "left_semi")))
    return lib.with_(works=evolve(works, WORKS).unionByName(new), tags=tags.dropDuplicates())


# --- pictures -----------------------------------------------------------------

def next_images(chapters: DataFrame, images: DataFrame, now: Column | str) -> DataFrame:
    """Addresses still to fetch: not stored, and not failed within a day."""
    wanted = chapters.select("work_id", "number", F.explode(tx.image_urls(F.col("html"))).alias("url"))
    stored = (F.col("status") == "stored") & (F.length("sha256") == 64) & (F.length("bytes") > 0)
    cooling = (F.col("status") == "failed") & (F.col("fetched_at") > F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 DAY"))
    return wanted.join(images.where(stored | cooling).select("work_id", "url"), ["work_id", "url"], "left_anti")


def missing_images(chapters: DataFrame, images: DataFrame) -> DataFrame:
    """Each address once, on the first work naming it, unless stored there."""
    wanted = (
        chapters.select("work_id", "number", F.explode(tx.image_urls(F.col("html"))).alias("url"))
        .groupBy("url").agg(F.min("work_id").alias("work_id")))
    return wanted.join(
        images.where(F.col("status") == "stored").select("work_id", "url"), ["work_id", "url"], "left_anti")


# --- which copy ---------------------------------------------------------------

def choose_copy(copies: DataFrame) -> DataFrame:
    """One usable copy per work: the archive's, a mirror's, else the newest capture.

    ``copies`` has (work_id, source, captured, found_id, title, chapters
    array<struct<number,html>>, posted).  A usable copy is of that work, has a
    title and every posted chapter, in order and none of them empty.
    """
    ordered = F.forall(
        F.transform("chapters", lambda c, i: (c["number"] == i + 1) & (F.trim(F.coalesce(c["html"], F.lit(""))) != "")),
        lambda ok: F.coalesce(ok, F.lit(False)))
    whole = (F.size("chapters") > 0) & (F.coalesce("title", F.lit("")) != "")
    direct = (F.col("source") == "ao3") & (
        F.coalesce("posted", F.lit(0)).isin(0) | (F.col("posted") == F.size("chapters")))
    relayed = (F.col("source") != "ao3") & (F.col("found_id") == F.col("work_id")) & (
        F.coalesce("posted", F.lit(0)) == F.size("chapters")) & ordered
    rank = F.when(F.col("source") == "ao3", 0).when(F.col("source") == "mirror", 1).when(F.col("source") == "wayback", 2)
    usable = copies.where(whole & (direct | relayed)).withColumn("rank", rank).where(F.col("rank").isNotNull())
    first = F.struct("rank", (-F.unix_micros("captured")).alias("age"))
    return usable.groupBy("work_id").agg(
        F.min_by(F.struct("source", "captured", "title"), first).alias("chosen")).select("work_id", "chosen.*")
