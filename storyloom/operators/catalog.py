"""Filtering, sorting and paging works joined to what was read of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import image_urls
from storyloom.functions.values import visited_at
from storyloom.model import Library
from storyloom.spec import FilterSpec

# Fixed value: what a listing says of a work that is not yet revealed.
UNREVEALED = "this is part of an ongoing challenge and will be revealed soon"
#: Works of a page that are few enough to be sent to every task.
SHORT = 5000
TAG_KINDS = ("fandom", "relationship", "character", "freeform", "warning", "category")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def rows(lib: Library) -> DataFrame:
    """Each work with its reading place, held chapters and visits.

    All three joins are on ``work_id``, so works are shuffled once; a side
    whose columns a query never touches is dropped by the optimiser.
    """
    place = lib.reading.select(
        "work_id", F.col("chapter").alias("at_chapter"), "offset", "chapters_read",
        "marked_later", "completed_before", "opened_at", F.col("updated_at").alias("read_updated_at"))
    held = lib.chapters.groupBy("work_id").agg(F.count(F.lit(1)).alias("held_chapters"))
    visits = lib.visits.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("local_visits"), F.max("started_at").alias("visit_last"))
    return (
        lib.works.join(place, "work_id", "left")
        .join(held, "work_id", "left").join(visits, "work_id", "left")
    )


# --- what the joined row says -------------------------------------------------

def chapters_total() -> Column:
    return F.coalesce(F.nullif(F.col("chapter_count"), F.lit(0)), F.col("held_chapters"), F.lit(1))


def started() -> Column:
    return (F.col("opened_at").isNotNull() | (_zero("offset") > 0)
            | (_zero("chapters_read") > 0) | (_zero("at_chapter") > 1))


def finished() -> Column:
    return _zero("chapters_read") >= chapters_total()


def completed() -> Column:
    return finished() | _flag("completed_before")


def local_last_read() -> Column:
    """``greatest`` skips NULLs, so whichever mark exists counts."""
    opened = F.coalesce(F.col("opened_at"), F.when(started(), F.col("read_updated_at")))
    return F.greatest(opened, F.col("visit_last"))


def last_read() -> Column:
    opened = F.coalesce(F.col("opened_at"), F.when(started(), F.col("read_updated_at")))
    return F.greatest(opened, F.col("visit_last"), visited_at(F.col("last_visited")))


def local_visits() -> Column:
    return _zero("local_visits")


def total_visits() -> Column:
    return _zero("visits") + local_visits()


def placeholder() -> Column:
    """A listing entry that describes no story, with no chapters behind it."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    title = F.lower(blank("title"))
    no_words = _zero("words") == 0
    nobody = (F.size("authors") <= 0) | (
        (F.size("authors") == 1)
        & F.lower(F.trim(F.element_at("authors", 1))).isin("", "anonymous"))
    return F.col("held_chapters").isNull() & (
        F.lower(F.coalesce("summary", F.lit(""))).contains(UNREVEALED)
        | ((title == "mystery work") & no_words)
        | (title.isin("", "(untitled)") & (blank("summary") == "") & no_words
           & (F.col("authors").isNull() | nobody)))


# Each condition is built only when a filter names it.
_STATES: dict[str, Callable[[], Column]] = {
    "all": lambda: F.lit(True),
    "reading": lambda: started() & ~finished(),
    "unread": lambda: ~started(),
    "finished": lambda: completed(),
    "later": lambda: _flag("marked_later"),
    "rec": lambda: _flag("rec"),
    "held": lambda: _flag("has_text"),
    "known": lambda: ~_flag("has_text"),
    "bookmarked": lambda: _flag("in_bookmarks"),
    "history": lambda: _flag("in_history"),
    "visited": lambda: (
        started() | _flag("completed_before") | _flag("in_history") | (_zero("visits") > 0)
        | F.col("last_visited").isNotNull() | (local_visits() > 0)),
}
STATES = tuple(_STATES)


def state(name: str) -> Column:
    """The condition a state stands for; an unknown state is every work."""
    return _STATES.get(name, _STATES["all"])()


# --- filters ------------------------------------------------------------------

def visible(df: DataFrame, show_unrevealed: bool = False) -> DataFrame:
    df = df.where(~_flag("hidden"))
    return df if show_unrevealed else df.where(~placeholder())


def tag_gate(tags: DataFrame, spec: FilterSpec) -> DataFrame | None:
    """Works by which tag conditions they meet, in one aggregate.

    A fixed number of flags per work, combined map-side, so neither a work
    with very many tags nor a tag on very many works gathers anywhere.  One
    distinct name is told from several by comparing the least and greatest.
    """
    kinds = [k for k, on in (("relationship", spec.otp), ("fandom", spec.crossover is not None)) if on]
    names = list(dict.fromkeys((*spec.include, *spec.exclude)))
    if not kinds and not names:
        return None
    wanted = F.col("name").isin(names) if names else F.lit(False)
    if kinds:
        wanted = wanted | F.col("kind").isin(kinds)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("name"))
    flags = [F.bool_or(F.col("name") == n).alias(f"has_{i}") for i, n in enumerate(names)]
    bounds = [f(of(kind)).alias(f"{side}_{kind}") for kind in kinds
              for side, f in (("low", F.min), ("high", F.max))]
    return tags.where(wanted).groupBy("work_id").agg(*flags, *bounds)


def _tag_condition(spec: FilterSpec) -> Column:
    names = list(dict.fromkeys((*spec.include, *spec.exclude)))
    has = {n: F.coalesce(F.col(f"has_{i}"), F.lit(False)) for i, n in enumerate(names)}
    keep = F.lit(True)
    for name in spec.include:
        keep = keep & has[name]
    for name in spec.exclude:
        keep = keep & ~has[name]
    if spec.otp:
        keep = keep & (F.col("low_relationship") == F.col("high_relationship"))
    if spec.crossover is True:
        keep = keep & (F.col("low_fandom") < F.col("high_fandom"))
    if spec.crossover is False:
        keep = keep & F.coalesce(F.col("low_fandom") == F.col("high_fandom"), F.lit(True))
    return keep


def column_conditions(spec: FilterSpec) -> list[Column]:
    """What a filter asks of a joined row's own columns."""
    out = [] if spec.state == "all" else [state(spec.state)]
    if spec.availability in ("held", "known"):
        out.append(state(spec.availability))
    if spec.collection in ("later", "bookmarked", "history", "visited", "rec"):
        out.append(state(spec.collection))
    if spec.author:
        if spec.author_ignore_case:
            mine = F.transform("authors", F.lower)
            out.append(F.arrays_overlap(mine, F.array(*[F.lit(a.lower()) for a in spec.author])))
        else:
            out.append(F.arrays_overlap("authors", F.array(*[F.lit(a) for a in spec.author])))
    if spec.rating:
        out.append(F.col("rating").isin(*spec.rating))
    if spec.language:
        out.append(F.col("language") == spec.language)
    if spec.complete is not None:
        out.append(F.col("complete") == spec.complete)
    changed = F.coalesce("updated", "published")
    for value, side in (
        (spec.words_min, lambda v: F.col("words") >= v),
        (spec.words_max, lambda v: F.col("words") <= v),
        (spec.chapters_min, lambda v: F.col("chapter_count") >= v),
        (spec.chapters_max, lambda v: F.col("chapter_count") <= v),
        (spec.updated_after, lambda v: changed >= F.lit(v[:10]).cast("date")),
        (spec.updated_before, lambda v: changed <= F.lit(v[:10]).cast("date")),
    ):
        if value is not None:
            out.append(side(value))
    return out


def matching(lib: Library, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """The joined rows a filter leaves."""
    df = visible(rows(lib), spec.show_unrevealed)
    for condition in column_conditions(spec):
        df = df.where(condition)
    gate = tag_gate(lib.tags, spec)
    if gate is not None:
        df = df.join(gate, "work_id", "left").where(_tag_condition(spec)).drop(
            *[c for c in gate.columns if c != "work_id"])
    if spec.bookmarked_by:
        theirs = lib.bookmarked_by.where(F.col("person") == spec.bookmarked_by).select("work_id")
        df = df.join(theirs, "work_id", "left_semi")
    for scope in (spec.ids, spec.job_ids):
        if scope is not None:
            df = df.join(scope.select(F.col("work_id").cast("string")), "work_id", "left_semi")
    return df


def job_members(ids: DataFrame) -> DataFrame:
    """A job's works, keeping only identifiers of a known form."""
    return ids.where(F.col("work_id").rlike("^([0-9]+|epub-[a-z0-9]+)$")).select("work_id").distinct()


def count(lib: Library, spec: FilterSpec = FilterSpec()) -> DataFrame:
    return matching(lib, spec).agg(F.count(F.lit(1)).alias("n"))


# --- sorting and paging -------------------------------------------------------

@dataclass(frozen=True)
class Key:
    """One value a sort goes by; nulls come first going up and last going down."""
    value: Column
    down: bool = False

    def order(self) -> Column:
        return self.value.desc_nulls_last() if self.down else self.value.asc_nulls_first()

    def beyond(self, mark: Column, unset: bool) -> Column:
        """Whether a row's value comes strictly after a mark, whose being null is known."""
        if unset:
            return F.lit(False) if self.down else self.value.isNotNull()
        return (self.value < mark) | self.value.isNull() if self.down else self.value > mark


def _folded(value: Column | str) -> Column:
    return F.collate(F.col(value) if isinstance(value, str) else value, "UTF8_LCASE")


def keys_of(sort: str, seed: int = 0) -> list[Key]:
    """What a sort goes by; ``work_id`` always comes last so that pages are stable."""
    keys: dict[str, Callable[[], list[Key]]] = {
        "visits": lambda: [Key(total_visits(), True), Key(_folded("title"))],
        "title": lambda: [Key(_folded("title"))],
        "author": lambda: [Key(_folded(F.to_json("authors")))],
        "updated": lambda: [Key(F.coalesce("updated", "published"), True)],
        "published": lambda: [Key(F.col("published"), True)],
        "added": lambda: [Key(F.coalesce(F.col("fetched_at"), F.col("downloaded_at").cast("timestamp")), True)],
        "words": lambda: [Key(F.col("words"), True)],
        "shortest": lambda: [Key(F.col("words"))],
        "chapters": lambda: [Key(F.col("chapter_count"), True)],
        "recent": lambda: [Key(last_read(), True), Key(F.col("work_id"), True)],
        "kudos": lambda: [Key(F.col("kudos"), True)],
        "bookmarks": lambda: [Key(F.col("bookmark_count"), True)],
        "hits": lambda: [Key(F.col("hits"), True)],
        "random": lambda: [Key(shuffled(seed))],
    }
    return [*keys.get(sort, keys["title"])(), Key(F.col("work_id"))]


def sort_keys(sort: str, seed: int = 0) -> list[Column]:
    """Order-by list of a sort."""
    return [k.order() for k in keys_of(sort, seed)]


def cursor(sort: str, seed: int = 0) -> Column:
    """Where a row stands in a sort, as a value that :func:`after` takes."""
    return F.struct(*[k.value.alias(f"v{i}") for i, k in enumerate(keys_of(sort, seed))])


def after(mark: Sequence, sort: str, seed: int = 0) -> Column:
    """Rows that come after a cursor: equal in the first values and beyond in the next, for each number of them."""
    keys, out, same = keys_of(sort, seed), F.lit(False), F.lit(True)
    for key, value in zip(keys, mark, strict=True):
        given = F.lit(value) if value is not None else F.lit(None)
        out = out | (same & key.beyond(given, value is None))
        same = same & (key.value.isNull() if value is None else key.value == given)
    # the first value alone is a plain range, which a scan can use; the rest decides among its equals
    first, value = keys[0], mark[0]
    if value is None:
        return (first.value.isNull() if first.down else F.lit(True)) & out
    bound = (first.value <= F.lit(value)) | first.value.isNull() if first.down else first.value >= F.lit(value)
    return bound & out


def shuffled(seed: int) -> Column:
    """An order that looks random and is the same on every run of one seed."""
    return F.md5(F.concat(F.lit(f"{seed}/"), F.col("work_id")))


def works(lib: Library, spec: FilterSpec = FilterSpec(), sort: str = "title", limit: int | None = 50, offset: int = 0,
          seed: int = 0, begin: Sequence | None = None, with_cursor: bool = False) -> DataFrame:
    """One page of the catalogue, of any length; without a limit, all of it.

    A page begins at an ``offset``, or after the ``cursor`` of the row before it
    (``begin``), which costs the same however deep it lies.  The page is cut first,
    and only its works are looked up among the tags: a page of up to a few thousand
    works meets the tags where they lie, so they are not shuffled.
    """
    order = sort_keys(sort, seed)
    page = matching(lib, spec)
    page = (page if begin is None else page.where(after(begin, sort, seed))).orderBy(*order)
    page = page.offset(offset) if offset else page
    page = page if limit is None else page.limit(limit)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("name"))
    tags = lib.tags.where(F.col("kind").isin("fandom", "relationship")).select("work_id", "kind", "name")
    page = page.select("work_id", F.struct(*[c for c in page.columns if c != "work_id"]).alias("row"))
    if limit is not None and limit <= SHORT:
        # the page is the small side of an inner join; a row without a tag for every work keeps works that have none
        none = lib.works.select("work_id", F.lit("none").alias("kind"), F.lit(None).cast("string").alias("name"))
        dressed = tags.unionByName(none).join(F.broadcast(page), "work_id")
    else:
        dressed = page.join(tags, "work_id", "left")
    labelled = dressed.groupBy("work_id").agg(
        F.any_value("row").alias("row"), F.min(of("fandom")).alias("fandom"), F.min(of("relationship")).alias("relationship"),
        F.array_join(F.array_sort(F.collect_set(of("relationship"))), "\n").alias("relationships"))
    place = [cursor(sort, seed).alias("cursor")] if with_cursor else []
    return (
        labelled.select("work_id", "row.*", "fandom", "relationship", "relationships")
        .orderBy(*order)
        .select(
            "work_id", "title", "authors", "summary", "words", "chapter_count",
            "chapters_planned", "complete", "rating", "published", "updated",
            "downloaded_at", "language",
            (F.coalesce("skin_css", F.lit("")) != "").alias("has_skin"),
            "rec", "in_bookmarks", "in_history", "bookmarked_at", "visits",
            local_visits().alias("ff_visits"), last_read().alias("last_read_at"),
            "kudos", "bookmark_count", "hits", "has_text", "at_chapter", "chapters_read",
            "marked_later", "opened_at", "offset", "completed_before", "fandom",
            "relationship", F.nullif(F.col("relationships"), F.lit("")).alias("relationships"), *place)
    )


def detail(lib: Library, ids: DataFrame) -> DataFrame:
    """What heads a work's own page, for as many works as asked."""
    wanted = ids.select("work_id").distinct()
    versions = lib.chapter_versions.groupBy("work_id").agg(F.count(F.lit(1)).alias("versions"))
    return (
        rows(lib).join(wanted, "work_id", "left_semi").join(versions, "work_id", "left")
        .withColumn("ff_visits", local_visits())
        .withColumn("chapters_read", _zero("chapters_read"))
        .withColumn("offset", F.coalesce("offset", F.lit(0.0)))
        .withColumn("completed_before", _flag("completed_before"))
        .withColumn("chapters", _zero("held_chapters"))
        .withColumn("versions", _zero("versions"))
        .drop("held_chapters", "local_visits", "visit_last", "read_updated_at")
    )


def detail_tags(lib: Library, ids: DataFrame) -> DataFrame:
    """The page's tags, a row each rather than one cell holding them all."""
    return lib.tags.join(ids.select("work_id"), "work_id", "left_semi").orderBy("work_id", "kind", "name")


def detail_chapters(lib: Library, ids: DataFrame) -> DataFrame:
    """The page's contents list, a row a chapter, without the text."""
    return (lib.chapters.join(ids.select("work_id"), "work_id", "left_semi")
            .select("work_id", "number", "title", "words").orderBy("work_id", "number"))


def stored_images(images: DataFrame) -> DataFrame:
    """Rows whose picture is really there."""
    return images.where(
        (F.col("status") == "stored") & (F.length("sha256") == 64) & (F.length("bytes") > 0))


def chapter(lib: Library, keys: DataFrame) -> DataFrame:
    """Chapters by (work_id, number), each with the stored pictures it shows."""
    return _with_images(lib, lib.chapters.join(keys, ["work_id", "number"], "left_semi").select(
        "work_id", "number", "title", "html"))


def version(lib: Library, keys: DataFrame) -> DataFrame:
    """Archived copies by (work_id, number, archived_at), likewise."""
    found = lib.chapter_versions.join(keys, ["work_id", "number", "archived_at"], "left_semi")
    return _with_images(lib, found.select(
        "work_id", "number", "archived_at", "title", "html", "words", "reason"))


def _with_images(lib: Library, df: DataFrame) -> DataFrame:
    """A row per picture the markup names and the ledger holds, else one row.

    Pictures are looked up by address, so a work's chapters never meet all of
    its pictures.
    """
    pictures = stored_images(lib.images).select("work_id", "url", "sha256", "fetched_at")
    skins = lib.works.select("work_id", F.col("title").alias("work_title"), "skin_css")
    named = df.withColumn("url", F.explode_outer(image_urls(F.col("html"))))
    return named.join(pictures, ["work_id", "url"], "left").join(skins, "work_id", "left")
