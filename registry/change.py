"""Versions, merging, deletion and blocking."""

import uuid

from pyspark.sql import functions as F

from registry import query
from registry.base import sql
from storyloom.functions import text as tx
from storyloom.model import Library
from storyloom.operators import admin, merge, versions
from storyloom.session import scratch_root
from storyloom.sources import buckets
from storyloom.sources.star import library, table, tags_dealt, works_dealt

NOW, LATER = "2025-06-01 00:00:00", "2025-06-02 00:00:00"


def _wk():
    return F.col("work_id").cast("bigint")


# --- an incoming library ------------------------------------------------------


def device(lib: Library) -> Library:
    """What was here first: works but every ninth's fourth."""
    here = lambda df: df.where(_wk() % 9 != 4)
    return lib.with_(works=here(lib.works), chapters=here(lib.chapters), tags=here(lib.tags),
                     reading=here(lib.reading))


def incoming(lib: Library) -> Library:
    """What arrives: no tenth work, some edited, reflowed or shortened."""
    there = lambda df: df.where(_wk() % 10 != 0)
    works = there(lib.works).withColumns({
        "title": F.when(_wk() % 7 == 0, F.concat("title", F.lit(" (revised)"))).otherwise(F.col("title")),
        "visits": F.col("visits") + _wk() % 3 - 1,
        "visits_synced_at": F.when(_wk() % 2 == 0, F.col("visits_synced_at") + F.expr("INTERVAL 1 DAY"))
        .otherwise(F.col("visits_synced_at") - F.expr("INTERVAL 1 DAY")),
        "kudos_given": F.lit(True),
        "skin_css": F.when(_wk() % 6 == 0, F.lit(".new{}")).when(_wk() % 6 == 1, F.concat("skin_css", F.lit("  ")))
        .otherwise(F.col("skin_css")),
    })
    chapters = there(lib.chapters).where((_wk() % 6 != 0) | (F.col("number") != 3)).withColumn(
        "html", F.when(_wk() % 7 == 0, F.concat("html", F.lit("<p>More.</p>")))
        .when(_wk() % 7 == 1, F.regexp_replace("html", " ", "\n"))
        .when(_wk() % 7 == 2, F.concat(F.lit("<!-- stamp -->  "), "html"))
        .otherwise(F.col("html")))
    tags = there(lib.tags).withColumn("name", F.when(_wk() % 7 == 0, F.lower("name")).otherwise(F.col("name")))
    reading = there(lib.reading).withColumn("chapter", F.lit(99))
    return lib.with_(works=works, chapters=chapters, tags=tags.distinct(), reading=reading)


TWO = ("""
dev_w AS (SELECT * FROM works WHERE wk % 9 <> 4)""", """
dev_c AS (SELECT * FROM chapters WHERE work_id::BIGINT % 9 <> 4)""", """
dev_t AS (SELECT * FROM tags WHERE work_id::BIGINT % 9 <> 4)""", """
dev_r AS (SELECT * FROM reading WHERE work_id::BIGINT % 9 <> 4)""", """
inc_w AS (
  SELECT * REPLACE (
    CASE WHEN wk % 7 = 0 THEN title || ' (revised)' ELSE title END AS title,
    visits + wk % 3 - 1 AS visits,
    CASE WHEN wk % 2 = 0 THEN visits_synced_at + INTERVAL 1 DAY ELSE visits_synced_at - INTERVAL 1 DAY END AS visits_synced_at,
    CASE wk % 6 WHEN 0 THEN '.new{}' WHEN 1 THEN skin_css || '  ' ELSE skin_css END AS skin_css,
    true AS kudos_given)
  FROM works WHERE wk % 10 <> 0)""", """
inc_c AS (
  SELECT * REPLACE (CASE work_id::BIGINT % 7 WHEN 0 THEN html || '<p>More.</p>' WHEN 1 THEN replace(html, ' ', chr(10))
    WHEN 2 THEN '<!-- stamp -->  ' || html ELSE html END AS html)
  FROM chapters WHERE work_id::BIGINT % 10 <> 0 AND (work_id::BIGINT % 6 <> 0 OR number <> 3))""", """
inc_t AS (
  SELECT DISTINCT work_id, kind, CASE WHEN work_id::BIGINT % 7 = 0 THEN lower(name) ELSE name END AS name
  FROM tags WHERE work_id::BIGINT % 10 <> 0)""", """
inc_r AS (SELECT * REPLACE (99 AS chapter) FROM reading WHERE work_id::BIGINT % 10 <> 0)""")


def _two(spark, root):
    lib = library(spark, root)
    return device(lib), incoming(lib)


# --- versions -----------------------------------------------------------------

_NORM = ("trim(regexp_replace(regexp_replace(regexp_replace({}, '<!--.*?-->', '', 'gs'), '\\s+', ' ', 'g'), "
         "'> <', '><', 'g'))")
_LIGHT = "replace(replace(replace({}, chr(10), ' '), chr(13), ' '), '  ', ' ')"


def _diff_sql(norm, held="dev_c", arriving="inc_c", works="inc_c"):
    return f"""
SELECT work_id, number, CASE WHEN h.html IS NULL THEN 'new' WHEN i.html IS NULL THEN 'removed'
  WHEN {norm.format('h.html')} <> {norm.format('i.html')} THEN 'content' ELSE 'none' END AS change
FROM (SELECT * FROM {held} WHERE work_id IN (SELECT work_id FROM {works})) h
FULL JOIN {arriving} i USING (work_id, number)"""


@query("version_diff", sql(_diff_sql(_NORM), *TWO))
def version_diff(spark, root):
    d, i = _two(spark, root)
    return versions.diff(d.chapters, i.chapters).select("work_id", "number", "change")


@query("skin_diff", sql(f"""
SELECT i.work_id, CASE WHEN {_NORM.format("coalesce(h.skin_css, '')")} <> {_NORM.format("coalesce(i.skin_css, '')")}
  THEN 'layout' ELSE 'none' END AS change FROM inc_w i LEFT JOIN dev_w h USING (work_id)""", *TWO))
def skin_diff(spark, root):
    d, i = _two(spark, root)
    return versions.skin_diff(d.works, i.works).select("work_id", "change")


@query("skin_diff_exact", sql("""
SELECT i.work_id, CASE WHEN coalesce(h.skin_css, '') <> coalesce(i.skin_css, '')
  THEN 'layout' ELSE 'none' END AS change FROM inc_w i LEFT JOIN dev_w h USING (work_id)""", *TWO))
def skin_diff_exact(spark, root):
    d, i = _two(spark, root)
    return versions.skin_diff(d.works, i.works, exact=True).select("work_id", "change")


@query("archive_changes", sql(f"""
SELECT v.work_id, v.number, v.text, v.reason, v.content_hash, true AS now FROM (
  SELECT c.work_id, c.number, c.text, d.change AS reason,
    CASE WHEN d.change = 'content' THEN sha256({_NORM.format('c.html')}) END AS content_hash
  FROM dev_c c JOIN ({_diff_sql(_NORM, works='inc_w')}) d ON c.work_id = d.work_id AND c.number = d.number
  WHERE d.change IN ('content', 'removed')) v
UNION ALL SELECT work_id, number, text, reason, content_hash, false FROM chapter_versions""", *TWO))
def archive_changes(spark, root):
    d, i = _two(spark, root)
    kept = versions.archive(d, i, NOW).chapter_versions
    return kept.select("work_id", "number", "text", "reason", "content_hash", (F.col("archived_at") == F.lit(NOW).cast("timestamp")).alias("now"))


@query("archive_skins", sql(f"""
SELECT h.work_id, h.skin_css FROM dev_w h JOIN inc_w i USING (work_id)
WHERE coalesce(h.skin_css, '') <> '' AND {_NORM.format('h.skin_css')} <> {_NORM.format("coalesce(i.skin_css, '')")}
UNION ALL SELECT work_id, skin_css FROM skin_versions""", *TWO))
def archive_skins(spark, root):
    d, i = _two(spark, root)
    return versions.archive(d, i, NOW).skin_versions.select("work_id", "skin_css")


@query("version_list", sql("""
SELECT work_id, number, title, words, reason, archived_at::DATE::VARCHAR AS archived_on FROM chapter_versions
WHERE work_id IN (SELECT work_id FROM bookmarked_by)"""))
def version_list(spark, root):
    lib = library(spark, root)
    return versions.history(lib, lib.bookmarked_by).select(
        "work_id", "number", "title", "words", "reason", F.date_format("archived_at", "yyyy-MM-dd").alias("archived_on"))


@query("skin_asof", sql("""
SELECT c.work_id, c.number, coalesce(
  (SELECT s.skin_css FROM skin_versions s WHERE s.work_id = c.work_id AND s.archived_at >= c.archived_at
   ORDER BY s.archived_at LIMIT 1), w.skin_css) AS skin_css
FROM chapter_versions c LEFT JOIN works w USING (work_id)"""))
def skin_asof(spark, root):
    return versions.skin_asof(library(spark, root)).select("work_id", "number", "skin_css")


@query("epub_precedence", sql("""
SELECT work_id, number, 'version' AS kept_as FROM inc_c WHERE work_id IN (SELECT work_id FROM dev_w WHERE source = 'ao3')
UNION ALL SELECT work_id, number, 'chapter' FROM inc_c WHERE work_id NOT IN (SELECT work_id FROM dev_w WHERE source = 'ao3')""", *TWO))
def epub_precedence(spark, root):
    d, i = _two(spark, root)
    kept, free = versions.keep_books_as_versions(d, i, NOW)
    aside = kept.chapter_versions.where("reason = 'epub'").select("work_id", "number", F.lit("version").alias("kept_as"))
    return aside.unionByName(free.chapters.select("work_id", "number", F.lit("chapter").alias("kept_as")))


# --- merging ------------------------------------------------------------------

_MERGED_W = """
m AS (
  SELECT coalesce(d.work_id, i.work_id) AS work_id, CASE WHEN i.work_id IS NULL THEN d.title ELSE i.title END AS title,
    CASE WHEN i.work_id IS NULL THEN d.words ELSE i.words END AS words,
    coalesce(d.kudos_given, false) AS kudos_given,
    CASE WHEN i.visits IS NOT NULL AND (d.visits IS NULL OR i.visits_synced_at > coalesce(d.visits_synced_at, TIMESTAMP '0001-01-01'))
      THEN i.visits ELSE d.visits END AS visits,
    coalesce(d.work_id, i.work_id) IN (SELECT work_id FROM mc) AS has_text,
    CASE WHEN i.work_id IS NULL THEN d.authors ELSE i.authors END AS authors
  FROM dev_w d FULL JOIN (SELECT * FROM inc_w WHERE work_id NOT IN (SELECT work_id FROM deleted)) i ON d.work_id = i.work_id)"""
_MERGED_C = """
mc AS (
  SELECT * FROM dev_c WHERE work_id NOT IN (SELECT work_id FROM inc_w WHERE work_id NOT IN (SELECT work_id FROM deleted))
  UNION ALL SELECT * FROM inc_c WHERE work_id NOT IN (SELECT work_id FROM deleted))"""


def _merged(spark, root):
    d, i = _two(spark, root)
    return merge.libraries(d, i, NOW)


@query("merge_works", sql("""
SELECT work_id, title, words, kudos_given, visits, has_text,
  len(authors) > 0 AND len(list_filter(authors, lambda a: a NOT IN (SELECT name FROM blocked))) = 0 AS hidden FROM m""".replace(
    "len(authors) > 0 AND len(list_filter(authors, lambda a: a NOT IN (SELECT name FROM blocked))) = 0 AS hidden",
    "len(authors) > 0 AND list_has_all((SELECT list(name) FROM blocked), authors) AS hidden"), *TWO, _MERGED_C, _MERGED_W))
def merge_works(spark, root):
    return _merged(spark, root).works.select("work_id", "title", "words", "kudos_given", "visits", "has_text", "hidden")


@query("merge_chapters", sql("SELECT work_id, number, html FROM mc", *TWO, _MERGED_C))
def merge_chapters(spark, root):
    return _merged(spark, root).chapters.select("work_id", "number", "html")


#: Works to a bucket, so that a task sorts a few million tags at most.
TO_A_BUCKET = 100_000


def _stored_library(spark, root):
    """The library and how many buckets its tables should have; works and tags come dealt out for that."""
    n = max(8, -(-table(spark, root, "orders").count() // TO_A_BUCKET))
    return library(spark, root).with_(
        works=lambda: works_dealt(spark, root), tags=lambda: tags_dealt(spark, root, n)), n


def _saved(spark, lib, n):
    name = uuid.uuid4().hex
    buckets.save(lib, f"lib_{name}", f"{scratch_root(spark)}/buckets-{name}", n)
    return f"lib_{name}"


def _changed(spark, held, n, works, step):
    """A library saved in buckets by work, changed where a step touches it, and loaded again."""
    prefix = _saved(spark, held, n)
    buckets.change(spark, prefix, works, step)
    return buckets.load(spark, prefix)


@query("merge_bucketed", sql("""
SELECT work_id, number, html, 'held' AS kept FROM mc UNION ALL
SELECT c.work_id, c.number, c.html, 'aside' FROM dev_c c JOIN (""" + _diff_sql(_LIGHT, works="inc_w") + """) d
  ON c.work_id = d.work_id AND c.number = d.number WHERE d.change IN ('content', 'removed') AND c.work_id NOT IN (SELECT work_id FROM deleted)
UNION ALL SELECT work_id, number, html, 'aside' FROM chapter_versions""", *TWO, _MERGED_C))
def merge_bucketed(spark, root):
    """A merge of tables that lie bucketed by work: held text is not moved, and only the buckets of arriving works are written."""
    both, n = _stored_library(spark, root)
    # both sides are cut from it, and what arrives is read for every table and comparison: it is dealt out once
    whole = buckets.load(spark, _saved(spark, both, n))
    held, arriving = device(whole), incoming(whole)
    lib = _changed(spark, held, n, arriving.works.select("work_id").unionByName(arriving.images.select("work_id")).unionByName(
        arriving.reading.select("work_id")).unionByName(arriving.visits.select("work_id")), lambda lib: merge.libraries(lib, arriving, LATER))
    return lib.chapters.select("work_id", "number", "html", F.lit("held").alias("kept")).unionByName(
        lib.chapter_versions.select("work_id", "number", "html", F.lit("aside").alias("kept")))


@query("merge_tags", sql("""
SELECT work_id, kind, name FROM dev_t WHERE work_id NOT IN (SELECT work_id FROM inc_w WHERE work_id NOT IN (SELECT work_id FROM deleted))
UNION ALL SELECT work_id, kind, name FROM inc_t WHERE work_id NOT IN (SELECT work_id FROM deleted)""", *TWO))
def merge_tags(spark, root):
    return _merged(spark, root).tags.select("work_id", "kind", "name")


@query("merge_archive", sql(f"""
SELECT c.work_id, c.number, c.text, d.change AS reason FROM dev_c c
JOIN ({_diff_sql(_LIGHT, works="inc_w")}) d ON c.work_id = d.work_id AND c.number = d.number
WHERE d.change IN ('content', 'removed') AND c.work_id NOT IN (SELECT work_id FROM deleted)
UNION ALL SELECT work_id, number, text, reason FROM chapter_versions""", *TWO))
def merge_archive(spark, root):
    return _merged(spark, root).chapter_versions.select("work_id", "number", "text", "reason")


@query("merge_reading", sql("""
SELECT work_id, chapter FROM dev_r UNION ALL
SELECT work_id, chapter FROM inc_r WHERE work_id NOT IN (SELECT work_id FROM dev_r) AND work_id NOT IN (SELECT work_id FROM deleted)""", *TWO))
def merge_reading(spark, root):
    return _merged(spark, root).reading.select("work_id", "chapter")


@query("merge_visits_snapshot", sql("SELECT work_id, visits FROM m", *TWO, _MERGED_C, _MERGED_W))
def merge_visits_snapshot(spark, root):
    d, i = _two(spark, root)
    return merge.works(d.works, admin.gate_deleted(i.works, d.deleted)).select("work_id", "visits")


@query("merge_again", sql("""
SELECT (SELECT count(*) FROM m) AS works, (SELECT count(*) FROM mc) AS chapters, 0 AS new_versions, 0 AS new_visits""",
    *TWO, _MERGED_C, _MERGED_W))
def merge_again(spark, root):
    """Merging the same library twice leaves what merging it once left."""
    d, i = _two(spark, root)
    once = merge.libraries(d, i, NOW)
    twice = merge.libraries(once, i, LATER)
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    late = twice.chapter_versions.where(F.col("archived_at") > F.lit(NOW).cast("timestamp"))
    return spark.range(1).select(
        n(twice.works).alias("works"), n(twice.chapters).alias("chapters"), n(late).alias("new_versions"),
        (n(twice.visits) - n(once.visits)).alias("new_visits"))


@query("union_versions", sql("""
SELECT work_id, number, epoch(archived_at)::BIGINT AS at_ FROM chapter_versions WHERE number % 2 = 0
UNION SELECT work_id, number, epoch(archived_at)::BIGINT FROM chapter_versions WHERE number % 3 = 0"""))
def union_versions(spark, root):
    all_ = library(spark, root).chapter_versions
    both = merge.add_missing(all_.where("number % 2 = 0"), all_.where("number % 3 = 0"), ("work_id", "number", "archived_at"))
    return both.select("work_id", "number", F.unix_timestamp("archived_at").alias("at_"))


@query("union_skins", sql("SELECT work_id, skin_css FROM skin_versions"))
def union_skins(spark, root):
    all_ = library(spark, root).skin_versions
    return merge.add_missing(all_.where(_wk() % 2 == 0), all_.where(_wk() % 3 != 0).unionByName(all_), ("work_id", "archived_at")).select(
        "work_id", "skin_css")


@query("insert_ignore", sql("SELECT person, work_id, min(epoch_us(\"at\")) AS at_ FROM bookmarked_by GROUP BY 1, 2"))
def insert_ignore(spark, root):
    all_ = library(spark, root).bookmarked_by
    late = all_.withColumn("at", F.col("at") + F.expr("INTERVAL 1 DAY"))
    return merge.add_missing(all_, late, ("person", "work_id")).select("person", "work_id", F.unix_micros("at").alias("at_"))


@query("distinct_ids", sql("SELECT DISTINCT work_id FROM ev"))
def distinct_ids(spark, root):
    from storyloom.sources.star import events
    return events(spark, root).select("work_id").distinct()


# --- deletion and blocking ----------------------------------------------------

_OWNED = {"chapters": "chapters", "tags": "tags", "images": "images", "chapter_versions": "chapter_versions",
          "skin_versions": "skin_versions", "visits": "rvisits", "reading": "reading", "works": "works"}


@query("delete_works", sql(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n FROM {v} WHERE work_id NOT IN (SELECT work_id FROM bookmarked_by)"
    for t, v in _OWNED.items()) + """
UNION ALL SELECT 'deleted', count(*) FROM (SELECT work_id FROM deleted UNION SELECT work_id FROM bookmarked_by)"""))
def delete_works(spark, root):
    lib = library(spark, root)
    after = admin.delete(lib, lib.bookmarked_by, NOW)
    out = None
    for name in (*admin.OWNED, "deleted"):
        part = getattr(after, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("delete_bucketed", sql("""
SELECT 'chapters' AS table_name, work_id, count(*) AS n FROM chapters WHERE work_id NOT IN (SELECT work_id FROM bookmarked_by) GROUP BY 2
UNION ALL SELECT 'tags', work_id, count(*) FROM tags WHERE work_id NOT IN (SELECT work_id FROM bookmarked_by) GROUP BY 2
UNION ALL SELECT 'deleted', work_id, 1 FROM (SELECT work_id FROM deleted UNION SELECT work_id FROM bookmarked_by)"""))
def delete_bucketed(spark, root):
    lib, n = _stored_library(spark, root)
    after = _changed(spark, lib, n, lib.bookmarked_by, lambda held: admin.delete(held, lib.bookmarked_by, NOW))
    out = None
    for name in ("chapters", "tags", "deleted"):
        part = getattr(after, name).groupBy("work_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "work_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("tombstones", sql("""
SELECT b.work_id, w.title FROM (SELECT DISTINCT work_id FROM bookmarked_by) b LEFT JOIN works w USING (work_id)
UNION ALL SELECT work_id, title FROM deleted WHERE work_id NOT IN (SELECT work_id FROM bookmarked_by)"""))
def tombstones(spark, root):
    lib = library(spark, root)
    return admin.delete(lib, lib.bookmarked_by, NOW).deleted.select("work_id", "title")


@query("allow_again", sql("SELECT work_id FROM deleted WHERE work_id NOT IN (SELECT work_id FROM bookmarked_by)"))
def allow_again(spark, root):
    lib = library(spark, root)
    return admin.allow_again(lib, lib.bookmarked_by).deleted.select("work_id")


@query("gate_deleted", sql("SELECT work_id, title FROM works WHERE work_id NOT IN (SELECT work_id FROM deleted)"))
def gate_deleted(spark, root):
    lib = library(spark, root)
    return admin.gate_deleted(lib.works, lib.deleted).select("work_id", "title")


_ALL_OF = "len(authors) > 0 AND list_has_all((SELECT list(name) FROM {}), authors)"


@query("hidden_flag", sql(f"SELECT work_id, {_ALL_OF.format('blocked')} AS hidden FROM works"))
def hidden_flag(spark, root):
    lib = library(spark, root)
    return admin.hidden(lib.works, lib.blocked).select("work_id", "hidden")


_MORE = "names AS (SELECT name FROM blocked UNION SELECT 'Supplier#000000001')"
_LESS = "names AS (SELECT name FROM blocked WHERE name <> 'Supplier#000000008')"


@query("block_author", sql(f"SELECT work_id, {_ALL_OF.format('names')} AS hidden FROM works", _MORE))
def block_author(spark, root):
    return admin.block_author(library(spark, root), "Supplier#000000001", NOW).works.select("work_id", "hidden")


@query("unblock_author", sql(f"SELECT work_id, {_ALL_OF.format('names')} AS hidden FROM works", _LESS))
def unblock_author(spark, root):
    return admin.unblock_author(library(spark, root), "Supplier#000000008").works.select("work_id", "hidden")


@query("block_impact", sql(f"SELECT count(*) AS n, coalesce(sum(words), 0)::BIGINT AS words FROM works WHERE {_ALL_OF.format('blocked')}"))
def block_impact(spark, root):
    lib = library(spark, root)
    return admin.block_impact(lib.works, lib.blocked)


# --- repairs ------------------------------------------------------------------

@query("repair_has_text", sql("SELECT work_id, work_id IN (SELECT work_id FROM chapters) AS has_text FROM works"))
def repair_has_text(spark, root):
    lib = library(spark, root)
    return admin.repair_has_text(lib.works.withColumn("has_text", _wk() % 2 == 0), lib.chapters).select("work_id", "has_text")


@query("repair_complete", sql("SELECT work_id, complete OR coalesce(chapter_count >= chapters_planned, false) AS complete FROM works"))
def repair_complete(spark, root):
    return admin.repair_complete(library(spark, root).works).select("work_id", "complete")


@query("drop_bad_images", sql("SELECT work_id, url FROM images WHERE length(sha256) = 64 AND length(bytes) > 0"))
def drop_bad_images(spark, root):
    return admin.drop_bad_images(library(spark, root).images).select("work_id", "url")


@query("image_dedupe", sql("""
SELECT sha256, count(*) AS uses, min_by(url, (fetched_at, work_id, url)) AS url FROM images
WHERE sha256 IS NOT NULL GROUP BY 1"""))
def image_dedupe(spark, root):
    return admin.distinct_pictures(library(spark, root).images).select("sha256", "uses", "url")


@query("content_hash", sql(f"SELECT id, sha256({_NORM.format('html')}) AS hash FROM chapters"))
def content_hash(spark, root):
    return library(spark, root).chapters.select("id", tx.content_hash(F.col("html")).alias("hash"))


@query("normalise_html", sql(f"SELECT page_id, {_NORM.format('html')} AS html FROM pages"))
def normalise_html(spark, root):
    return table(spark, root, "pages").select("page_id", tx.normalise(F.col("html")).alias("html"))
