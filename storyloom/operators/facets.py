"""What narrowing further would leave, counted against the current filter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.model import Library
from storyloom.operators import catalog
from storyloom.spec import FilterSpec


def _contains(name: Column, needle: str) -> Column:
    """Substring, letter case ignored, no wildcards."""
    return F.lower(name).contains(needle.lower())


def state_counts(lib: Library, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """How many works each reading state would leave: one pass for all."""
    counts = catalog.matching(lib, spec.but(state="all")).agg(
        *[F.count_if(catalog.state(s)).alias(s) for s in catalog.STATES])
    return counts.unpivot([], list(catalog.STATES), "state", "n")


def tags(lib: Library, spec: FilterSpec = FilterSpec(), kinds: Sequence[str] = catalog.TAG_KINDS,
         k: int | Mapping[str, int] = 40, needle: str = "") -> DataFrame:
    """The busiest names of each kind among the works left.

    Rank-limited windows keep only each task's own top k before the shuffle,
    so a kind with very many names never gathers whole.
    """
    unknown = set(kinds) - set(catalog.TAG_KINDS)
    if unknown:
        raise ValueError(f"unknown tag kind: {sorted(unknown)}")
    named = lib.tags.where(F.col("kind").isin(*kinds))
    if needle:
        named = named.where(_contains(F.col("name"), needle))
    counted = (
        named.join(catalog.matching(lib, spec).select("work_id"), "work_id", "left_semi")
        .groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")))
    most = k if isinstance(k, int) else max(k.values())
    order = Window.partitionBy("kind").orderBy(F.col("n").desc(), F.col("name"))
    top = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    if not isinstance(k, int):
        mine = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(v)) for kind, v in k.items()])
        top = top.where(F.col("place") <= mine)
    return top


def column(lib: Library, spec: FilterSpec, name: str) -> DataFrame:
    """Counts of a work's rating or language, its own filter set aside."""
    if name not in ("rating", "language"):
        raise ValueError(f"unknown column facet: {name}")
    without = spec.but(**{name: () if name == "rating" else None})
    value = F.col(name)
    return (
        catalog.matching(lib, without).where(value.isNotNull() & (value != ""))
        .groupBy(value.alias("name")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "name"))


def _names(lib: Library, spec: FilterSpec, needle: str = "") -> DataFrame:
    found = catalog.matching(lib, spec.but(author=())).select(F.explode("authors").alias("name"))
    return found.where(_contains(F.col("name"), needle)) if needle else found


def authors(lib: Library, spec: FilterSpec = FilterSpec(), k: int = 40, needle: str = "") -> DataFrame:
    return (
        _names(lib, spec, needle).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "name").limit(k))


def author_count(lib: Library, spec: FilterSpec = FilterSpec(), approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return _names(lib, spec).agg(count("name").alias("n"))


def panel(lib: Library, spec: FilterSpec = FilterSpec(), k: int = 40) -> DataFrame:
    """The whole filter panel as (section, name, n): one filtered set of works, one count, one ranking.

    The works are filtered by what no section sets aside.  What sections differ in
    (state, rating, language, author) are flags on a row, and a row names what it
    counts for; only the tags are fetched besides.
    """
    def on(**only) -> Column:
        return reduce(Column.__and__, catalog.column_conditions(FilterSpec(**only)), F.lit(True))

    mine = {"state": on(state=spec.state), "rating": on(rating=spec.rating), "language": on(language=spec.language),
            "author": on(author=spec.author, author_ignore_case=spec.author_ignore_case)}
    but = lambda *aside: F.coalesce(reduce(Column.__and__, [c for n, c in mine.items() if n not in aside], F.lit(True)), F.lit(False))
    item = lambda section, name: F.struct(F.lit(section).alias("section"), name.alias("name"))
    when = lambda condition, items: F.when(condition, items).otherwise(F.array().cast("array<struct<section:string,name:string>>"))
    plain = lambda c: but(c) & (F.coalesce(F.col(c), F.lit("")) != "")
    rows = catalog.matching(lib, spec.but(state="all", rating=(), language=None, author=()))
    items = F.concat(
        *[when(but("state") & F.coalesce(catalog.state(st), F.lit(False)), F.array(item("state", F.lit(st)))) for st in catalog.STATES],
        *[when(plain(c), F.array(item(c, F.col(c)))) for c in ("rating", "language")],
        when(but("author"), F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: item("author", a))))
    counted = rows.select(F.explode(items).alias("i")).select("i.*")
    tagged = lib.tags.where(F.col("kind").isin(*catalog.TAG_KINDS)).join(rows.where(but()).select("work_id"), "work_id", "left_semi")
    none = lib.works.sparkSession.range(len(catalog.STATES)).select(
        F.lit("state").alias("section"), F.element_at(F.array(*map(F.lit, catalog.STATES)), F.col("id").cast("int") + 1).alias("name"),
        F.lit(0).cast("bigint").alias("n"))
    n = F.lit(1).cast("bigint").alias("n")
    counts = counted.select("section", "name", n).unionByName(
        tagged.select(F.col("kind").alias("section"), "name", n)).unionByName(none).groupBy("section", "name").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("section").orderBy(F.col("n").desc(), F.col("name"))
    short = (*catalog.TAG_KINDS, "author")
    top = counts.where(F.col("section").isin(*short)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    total = counts.where("section = 'author'").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("author_total").alias("section"), F.lit("all").alias("name"), "n")
    return counts.where(~F.col("section").isin(*short)).unionByName(top.drop("place")).unionByName(total)


def library_stats(lib: Library) -> DataFrame:
    """Size of the library and how much of it was read, in one pass.

    A work without a reading row has read none of at least one chapter, so the
    finished count needs no separate join on those that have one.
    """
    done = catalog.completed()
    return catalog.visible(catalog.rows(lib)).agg(
        F.count(F.lit(1)).alias("works"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.count_if(done).alias("finished"),
        F.coalesce(F.sum(F.when(done, F.col("words"))), F.lit(0)).alias("words_read"),
        F.count_if(F.coalesce("marked_later", F.lit(False))).alias("later"))


def browse_top(lib: Library) -> DataFrame:
    """The front page's tags, and every rating, as (kind, name, n)."""
    most = {"fandom": 14, "relationship": 14, "character": 12, "freeform": 14}
    top = tags(lib, FilterSpec(), tuple(most), most).select("kind", "name", "n")
    ratings = column(lib, FilterSpec(), "rating").select(F.lit("rating").alias("kind"), "name", "n")
    return top.unionByName(ratings)


def names_per_work(lib: Library, kind: str) -> DataFrame:
    """Distinct names of a kind on each work."""
    return (lib.tags.where(F.col("kind") == kind).groupBy("work_id")
            .agg(F.count_distinct("name").alias("n")))


def person_counts(lib: Library) -> DataFrame:
    return lib.bookmarked_by.groupBy("person").agg(F.count(F.lit(1)).alias("n"))
