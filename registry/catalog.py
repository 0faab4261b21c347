"""Catalogue, facet and shelf queries."""

from pyspark.sql import functions as F

from registry import query
from registry.base import sql
from storyloom.operators import catalog, facets, shelves
from storyloom.sources.star import library
from storyloom.spec import FilterSpec

SHOWN = "SELECT work_id, title, words FROM shown WHERE {}"


def _list(name, spec, where, with_=()):
    """A filter's whole result: identifiers, so nothing hides behind a page."""
    @query(name, sql(SHOWN.format(where), *with_))
    def run(spark, root):
        lib = library(spark, root)
        made = spec(lib) if callable(spec) else spec
        return catalog.matching(lib, made).select("work_id", "title", "words")
    return run


def _has(name):
    return f"work_id IN (SELECT work_id FROM tags WHERE name = '{name}')"


_list("visible", FilterSpec(), "true")
_list("include_tags", FilterSpec(include=("Brand#3", "PROMO")), f"{_has('Brand#3')} AND {_has('PROMO')}")
_list("exclude_tags", FilterSpec(exclude=("ECONOMY", "small ring")),
      f"NOT {_has('ECONOMY')} AND NOT {_has('small ring')}")
_list("include_exclude_tags", FilterSpec(include=("Brand#7",), exclude=("LARGE",), complete=True),
      f"{_has('Brand#7')} AND NOT {_has('LARGE')} AND complete")
_list("author_any", FilterSpec(author=("supplier#000000007", "Supplier#000000011")),
      "list_has_any(list_transform(authors, lambda a: lower(a)), ['supplier#000000007', 'supplier#000000011'])")
_list("author_exact_case", FilterSpec(author=("supplier#000000007", "Supplier#000000011"), author_ignore_case=False),
      "list_contains(authors, 'Supplier#000000011')")
_list("rating_any", FilterSpec(rating=("1-URGENT", "5-LOW")), "rating IN ('1-URGENT', '5-LOW')")
_list("language_eq", lambda lib: FilterSpec(language="NATION_3"), "language = 'NATION_3'")
_list("complete_is", FilterSpec(complete=False), "NOT complete")
_list("range_words", FilterSpec(words_min=4000, words_max=9000), "words BETWEEN 4000 AND 9000")
_list("range_chapters", FilterSpec(chapters_min=2, chapters_max=4), "chapter_count BETWEEN 2 AND 4")
_list("updated_window", FilterSpec(updated_after="1998-01-01T10:00", updated_before="2000-06-30"),
      "coalesce(updated, published) BETWEEN DATE '1998-01-01' AND DATE '2000-06-30'")
_DISTINCT = "(SELECT count(DISTINCT name) FROM tags t WHERE t.work_id = shown.work_id AND kind = '{}')"
_list("otp", FilterSpec(otp=True), _DISTINCT.format("relationship") + " = 1")
_list("crossover_many", FilterSpec(crossover=True), _DISTINCT.format("fandom") + " > 1")
_list("crossover_one", FilterSpec(crossover=False), _DISTINCT.format("fandom") + " <= 1")
_list("ids_scope", lambda lib: FilterSpec(ids=lib.deleted), "work_id IN (SELECT work_id FROM deleted)")
_list("job_scope", lambda lib: FilterSpec(job_ids=catalog.job_members(lib.bookmarked_by), state="bookmarked"),
      "work_id IN (SELECT work_id FROM bookmarked_by) AND in_bookmarks")
_list("bookmarked_by", FilterSpec(bookmarked_by="reader 3"),
      "work_id IN (SELECT work_id FROM bookmarked_by WHERE person = 'reader 3')")

_STATE_SQL = {
    "all": "true", "reading": "started AND NOT finished", "unread": "NOT started",
    "finished": "completed", "later": "later", "rec": "rec", "held": "has_text",
    "known": "NOT has_text", "bookmarked": "in_bookmarks", "history": "in_history",
    "visited": "was_visited",
}
for _state, _where in _STATE_SQL.items():
    _list(f"state_{_state}", FilterSpec(state=_state), _where)
_list("availability", FilterSpec(state="reading", availability="held"), "started AND NOT finished AND has_text")
_list("collection", FilterSpec(state="unread", collection="rec"), "NOT started AND rec")


@query("placeholder", sql("SELECT work_id, placeholder FROM allrows WHERE NOT hidden AND placeholder"))
def placeholder(spark, root):
    lib = library(spark, root)
    unrevealed = catalog.matching(lib, FilterSpec(show_unrevealed=True))
    return unrevealed.where(catalog.placeholder()).select("work_id", catalog.placeholder().alias("placeholder"))


@query("has_text", sql("SELECT work_id FROM works WHERE work_id IN (SELECT work_id FROM chapters WHERE length(html) > 0)"))
def has_text(spark, root):
    lib = library(spark, root)
    held = lib.chapters.where(F.length(F.coalesce("html", F.lit(""))) > 0)
    return lib.works.select("work_id").join(held, "work_id", "left_semi")


@query("catalogue_page", sql("""
SELECT work_id, title, array_to_string(authors, '|') AS authors, words, chapter_count,
  coalesce(skin_css, '') <> '' AS has_skin, rating, published::VARCHAR AS published, ff_visits,
  strftime(last_read, '%Y-%m-%d %H:%M:%S') AS last_read_at, at_chapter, chapters_read, "offset",
  (SELECT min(name) FROM tags t WHERE t.work_id = p.work_id AND kind = 'fandom') AS fandom,
  (SELECT min(name) FROM tags t WHERE t.work_id = p.work_id AND kind = 'relationship') AS relationship,
  (SELECT string_agg(name, chr(10) ORDER BY name) FROM tags t WHERE t.work_id = p.work_id AND kind = 'relationship') AS relationships
FROM (SELECT * FROM shown WHERE complete AND work_id IN (SELECT work_id FROM tags WHERE name = 'Brand#3')
      ORDER BY words DESC NULLS LAST, work_id LIMIT 50 OFFSET 20) p"""))
def catalogue_page(spark, root):
    page = catalog.works(library(spark, root), FilterSpec(complete=True, include=("Brand#3",)),
                         sort="words", limit=50, offset=20)
    return page.select(
        "work_id", "title", F.array_join("authors", "|").alias("authors"), "words", "chapter_count",
        "has_skin", "rating", F.col("published").cast("string").alias("published"), "ff_visits",
        F.date_format("last_read_at", "yyyy-MM-dd HH:mm:ss").alias("last_read_at"), "at_chapter",
        "chapters_read", "offset", "fandom", "relationship", "relationships")


@query("catalogue_long_page", sql("""
SELECT work_id, title, words,
  (SELECT min(name) FROM tags t WHERE t.work_id = p.work_id AND kind = 'fandom') AS fandom
FROM (SELECT * FROM shown ORDER BY words DESC NULLS LAST, work_id LIMIT 1500 OFFSET 300) p"""))
def catalogue_long_page(spark, root):
    """A page is as long as it is asked to be."""
    return catalog.works(library(spark, root), sort="words", limit=1500, offset=300).select("work_id", "title", "words", "fandom")


@query("catalogue_seek", sql("""
SELECT work_id, title, words FROM shown ORDER BY words DESC NULLS LAST, work_id LIMIT 60 OFFSET 700"""))
def catalogue_seek(spark, root):
    """A deep page, begun after the row before it instead of counted to."""
    lib = library(spark, root)
    mark = catalog.works(lib, sort="words", limit=1, offset=699, with_cursor=True).first().cursor
    return catalog.works(lib, sort="words", limit=60, begin=mark).select("work_id", "title", "words")


@query("catalogue_seek_recent", sql("""
SELECT work_id, title FROM shown ORDER BY last_read DESC NULLS LAST, work_id DESC LIMIT 40 OFFSET 900"""))
def catalogue_seek_recent(spark, root):
    lib = library(spark, root)
    mark = catalog.works(lib, sort="recent", limit=1, offset=899, with_cursor=True).first().cursor
    return catalog.works(lib, sort="recent", limit=40, begin=mark).select("work_id", "title")


@query("tag_substring", sql("SELECT work_id, kind, name FROM tags WHERE contains(lower(name), 'ing')"))
def tag_substring(spark, root):
    return library(spark, root).tags.where(facets._contains(F.col("name"), "ING"))


@query("work_detail", sql("""
SELECT a.work_id, title, words, a.ff_visits, coalesce(at_chapter, 0) AS at_chapter,
  coalesce(chapters_read, 0) AS chapters_read, coalesce("offset", 0.0) AS "offset",
  coalesce(h.n, 0) AS chapters, coalesce(v.n, 0) AS versions
FROM allrows a LEFT JOIN held h USING (work_id)
LEFT JOIN (SELECT work_id, count(*) AS n FROM chapter_versions GROUP BY 1) v USING (work_id)
WHERE a.work_id IN (SELECT work_id FROM bookmarked_by)"""))
def work_detail(spark, root):
    lib = library(spark, root)
    return catalog.detail(lib, lib.bookmarked_by).select(
        "work_id", "title", "words", "ff_visits", F.coalesce("at_chapter", F.lit(0)).alias("at_chapter"),
        "chapters_read", "offset", "chapters", "versions")


@query("work_detail_tags", sql("SELECT * FROM tags WHERE work_id IN (SELECT work_id FROM bookmarked_by)"))
def work_detail_tags(spark, root):
    lib = library(spark, root)
    return catalog.detail_tags(lib, lib.bookmarked_by)


@query("work_detail_chapters", sql(
    "SELECT work_id, number, title, words FROM chapters WHERE work_id IN (SELECT work_id FROM bookmarked_by)"))
def work_detail_chapters(spark, root):
    lib = library(spark, root)
    return catalog.detail_chapters(lib, lib.bookmarked_by)


_IMG = ("(SELECT work_id, url, sha256 FROM images WHERE status = 'stored' AND length(sha256) = 64 "
        "AND length(bytes) > 0)")


def _pictured(lib):
    """Chapters showing their work's picture, and one that is not held."""
    mine = lib.images.select("work_id", "url")
    shown = F.concat("html", F.lit('<img src="'), "url", F.lit('"><img src="https://gone.example/x.png">'))

    def lay(df):
        return df.join(mine, "work_id", "left").withColumn("html", F.coalesce(shown, "html")).drop("url")
    return lib.with_(chapters=lay(lib.chapters), chapter_versions=lay(lib.chapter_versions))


_NAMED = """(SELECT c.*, unnest(CASE WHEN p.url IS NULL THEN [NULL] ELSE [p.url, 'https://gone.example/x.png'] END) AS url
  FROM {} c LEFT JOIN (SELECT work_id, url FROM images) p USING (work_id))"""


@query("chapter_get", sql(f"""
SELECT c.work_id, c.number, c.title, c.url, i.sha256 FROM {_NAMED.format("chapters")} c
LEFT JOIN {_IMG} i ON c.work_id = i.work_id AND c.url = i.url WHERE c.number = 2"""))
def chapter_get(spark, root):
    lib = _pictured(library(spark, root))
    keys = lib.chapters.where("number = 2").select("work_id", "number")
    return catalog.chapter(lib, keys).select("work_id", "number", "title", "url", "sha256")


@query("version_get", sql(f"""
SELECT c.work_id, c.number, c.reason, w.title AS work_title, c.url, i.sha256 FROM {_NAMED.format("chapter_versions")} c
LEFT JOIN {_IMG} i ON c.work_id = i.work_id AND c.url = i.url LEFT JOIN works w ON c.work_id = w.work_id WHERE c.number <= 5"""))
def version_get(spark, root):
    lib = _pictured(library(spark, root))
    keys = lib.chapter_versions.where("number <= 5").select("work_id", "number", "archived_at")
    return catalog.version(lib, keys).select("work_id", "number", "reason", "work_title", "url", "sha256")


# --- sorts: the first pages, cut by the order ---------------------------------

_ORDER_SQL = {
    "visits": "total_visits DESC, lower(title) NULLS FIRST",
    "title": "lower(title) NULLS FIRST",
    "author": "lower(to_json(authors)::VARCHAR)",
    "updated": "coalesce(updated, published) DESC NULLS LAST",
    "published": "published DESC NULLS LAST",
    "added": "coalesce(fetched_at, downloaded_at::TIMESTAMP) DESC NULLS LAST",
    "words": "words DESC NULLS LAST",
    "shortest": "words NULLS FIRST",
    "chapters": "chapter_count DESC NULLS LAST",
    "recent": "last_read DESC NULLS LAST, work_id DESC",
    "kudos": "kudos DESC NULLS LAST",
    "bookmarks": "bookmark_count DESC NULLS LAST",
    "hits": "hits DESC NULLS LAST",
    "random": "md5('7/' || work_id)",
}


def _sorted(sort, order):
    @query(f"sort_{sort}", sql(
        f"SELECT work_id, title, words FROM shown ORDER BY {order}, work_id LIMIT 200"))
    def run(spark, root):
        return catalog.works(library(spark, root), sort=sort, limit=200, seed=7).select(
            "work_id", "title", "words")
    return run


for _sort, _order in _ORDER_SQL.items():
    _sorted(_sort, _order)


# --- facets -------------------------------------------------------------------

_FACET_SPEC = FilterSpec(complete=True, rating=("1-URGENT", "2-HIGH"), author=("Supplier#000000007",), state="unread")
_FACET_WHERE = {
    "complete": "complete", "rating": "rating IN ('1-URGENT', '2-HIGH')",
    "author": "list_contains(authors, 'Supplier#000000007')", "state": "NOT started",
}


def _where(*without):
    return " AND ".join(v for k, v in _FACET_WHERE.items() if k not in without)


@query("count_works", sql(f"SELECT count(*) AS n FROM shown WHERE {_where()}"))
def count_works(spark, root):
    return catalog.count(library(spark, root), _FACET_SPEC)


_STATE_UNION = " UNION ALL ".join(
    f"SELECT '{s}' AS state, count(*) AS n FROM shown WHERE {w} AND {_where('state')}"
    for s, w in _STATE_SQL.items())


@query("state_counts", sql(_STATE_UNION))
def state_counts(spark, root):
    return facets.state_counts(library(spark, root), _FACET_SPEC)


def _tag_top(where, k, extra="true"):
    return f"""SELECT kind, name, n FROM (
      SELECT kind, name, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, name) AS place
      FROM tags WHERE work_id IN (SELECT work_id FROM shown WHERE {where}) AND {extra} GROUP BY 1, 2)
      WHERE place <= {k}"""


@query("facet_tags", sql(_tag_top(_where(), 40)))
def facet_tags(spark, root):
    return facets.tags(library(spark, root), _FACET_SPEC).select("kind", "name", "n")


@query("facet_search", sql(_tag_top("true", 60, "contains(lower(name), 'ed ') AND kind = 'freeform'")))
def facet_search(spark, root):
    return facets.tags(library(spark, root), FilterSpec(), ("freeform",), 60, "ED ").select("kind", "name", "n")


def _column_sql(column, *without):
    return (f"SELECT {column} AS name, count(*) AS n FROM shown WHERE {_where(*without)} "
            f"AND coalesce({column}, '') <> '' GROUP BY 1")


@query("facet_rating", sql(_column_sql("rating", "rating")))
def facet_rating(spark, root):
    return facets.column(library(spark, root), _FACET_SPEC, "rating")


@query("facet_language", sql(_column_sql("language")))
def facet_language(spark, root):
    return facets.column(library(spark, root), _FACET_SPEC, "language")


def _author_sql(k, where, extra="true"):
    return (f"SELECT name, count(*) AS n FROM (SELECT unnest(authors) AS name FROM shown WHERE {where}) "
            f"WHERE {extra} GROUP BY 1 ORDER BY n DESC, name LIMIT {k}")


@query("facet_authors", sql(_author_sql(40, _where("author"))))
def facet_authors(spark, root):
    return facets.authors(library(spark, root), _FACET_SPEC)


@query("facet_author_search", sql(_author_sql(60, "true", "contains(lower(name), '#00000002')")))
def facet_author_search(spark, root):
    return facets.authors(library(spark, root), FilterSpec(), 60, "#00000002")


@query("author_count", sql(
    f"SELECT count(DISTINCT name) AS n FROM (SELECT unnest(authors) AS name FROM shown WHERE {_where('author')})"))
def author_count(spark, root):
    return facets.author_count(library(spark, root), _FACET_SPEC)


@query("facet_panel", sql(f"""
SELECT 'state' AS section, state AS name, n FROM ({_STATE_UNION})
UNION ALL SELECT kind, name, n FROM ({_tag_top(_where(), 40)})
UNION ALL SELECT 'rating', name, n FROM ({_column_sql("rating", "rating")})
UNION ALL SELECT 'language', name, n FROM ({_column_sql("language")})
UNION ALL SELECT 'author', name, n FROM ({_author_sql(40, _where("author"))})
UNION ALL SELECT 'author_total', 'all', count(DISTINCT name) FROM (SELECT unnest(authors) AS name FROM shown WHERE {_where('author')})"""))
def facet_panel(spark, root):
    return facets.panel(library(spark, root), _FACET_SPEC)


@query("library_stats", sql("""
SELECT count(*) AS works, coalesce(sum(words), 0)::BIGINT AS words, count(*) FILTER (completed) AS finished,
  coalesce(sum(words) FILTER (completed), 0)::BIGINT AS words_read, count(*) FILTER (later) AS later FROM shown"""))
def library_stats(spark, root):
    return facets.library_stats(library(spark, root))


@query("browse_top", sql("""
SELECT kind, name, n FROM (
  SELECT kind, name, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, name) AS place
  FROM tags WHERE work_id IN (SELECT work_id FROM shown) AND kind IN ('fandom', 'relationship', 'freeform') GROUP BY 1, 2)
WHERE place <= 14
UNION ALL SELECT 'rating', rating, count(*) FROM shown WHERE coalesce(rating, '') <> '' GROUP BY 2"""))
def browse_top(spark, root):
    return facets.browse_top(library(spark, root))


def _per_work(kind, name):
    @query(name, sql(f"SELECT work_id, count(DISTINCT name) AS n FROM tags WHERE kind = '{kind}' GROUP BY 1"))
    def run(spark, root):
        return facets.names_per_work(library(spark, root), kind)


_per_work("relationship", "otp_counts")
_per_work("fandom", "fandom_counts")


@query("person_counts", sql("SELECT person, count(*) AS n FROM bookmarked_by GROUP BY 1"))
def person_counts(spark, root):
    return facets.person_counts(library(spark, root))


# --- shelves ------------------------------------------------------------------

_SHELF_SQL = {
    "reading": ("started AND NOT finished", "local_read DESC NULLS LAST, work_id DESC"),
    "added": ("true", "coalesce(fetched_at, downloaded_at::TIMESTAMP) DESC NULLS LAST, work_id"),
    "updated": ("updated IS NOT NULL", "updated DESC, work_id"),
    "long": ("complete AND NOT started", "words DESC NULLS LAST, work_id"),
    "short": ("complete AND words < 5000 AND NOT started", "md5('3/' || work_id), work_id"),
    "later": ("later", "lower(title) NULLS FIRST, work_id"),
    "visits": ("total_visits > 0", "total_visits DESC, lower(title) NULLS FIRST, work_id"),
}


def _shelf_sql(key):
    where, order = _SHELF_SQL[key]
    return (f"SELECT '{key}' AS shelf, row_number() OVER (ORDER BY {order})::INT AS place, work_id, title, words, "
            f"count(*) OVER () AS total FROM shown WHERE {where} QUALIFY place <= 12")


def _shelf(key):
    @query(f"shelf_{key}", sql(_shelf_sql(key)))
    def run(spark, root):
        return shelves.all(library(spark, root), seed=3, keys=(key,))


for _key in _SHELF_SQL:
    _shelf(_key)


@query("shelves_home", sql(" UNION ALL ".join(f"({_shelf_sql(k)})" for k in _SHELF_SQL)))
def shelves_home(spark, root):
    return shelves.all(library(spark, root), seed=3)


@query("surprise", sql("SELECT work_id FROM shown WHERE NOT started ORDER BY md5('5/' || work_id) LIMIT 1"))
def surprise(spark, root):
    return shelves.surprise(library(spark, root), seed=5)


@query("return_to_story", sql("""
SELECT w.work_id, w.title FROM works w JOIN reading r USING (work_id)
WHERE NOT hidden AND r.opened_at IS NOT NULL AND w.work_id IN (SELECT work_id FROM chapters)
ORDER BY r.opened_at DESC, r.read_at DESC NULLS LAST, w.work_id LIMIT 1"""))
def return_to_story(spark, root):
    return shelves.return_to_story(library(spark, root)).select("work_id", "title")
