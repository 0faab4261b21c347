"""Listings, plans, job ledgers and journals."""

from pyspark.sql import functions as F

from registry import query
from registry.base import sql
from storyloom.functions.values import held_as_of
from storyloom.model import TAGS  # noqa: F401
from storyloom.operators import ledger
from storyloom.plans import sync
from storyloom.sources.star import events, library, table

NOW = "2025-06-01 00:00:00"


def _wk():
    return F.col("work_id").cast("bigint")


def _listed(lib, on, extra):
    """Listing entries of some works, and of others no one holds."""
    base = lib.works.withColumn("wk", _wk())
    base = base.where(on).unionByName(
        base.where(extra).withColumn("work_id", (F.col("wk") + 1000000).cast("string")))
    wk = F.col("wk")
    none = F.array().cast("array<string>")
    return base.select(
        "work_id", F.concat("title", F.lit(" (listed)")).alias("title"), "authors", "summary", "rating",
        "language", "complete", "words",
        (F.col("chapter_count") - F.when(wk % 4 == 0, 1).otherwise(0)).alias("chapters"), "chapters_planned",
        F.when(wk % 2 == 0, wk % 50).alias("kudos"), F.when(wk % 3 == 0, wk % 40).alias("bookmark_count"),
        "hits",
        F.when(wk % 13 != 0, F.col("updated_at") + (wk % 5 - 2) * 2592000).alias("updated_at"),
        F.lit(None).cast("string").alias("datetime"),
        F.array(F.concat(F.lit("Fandom "), (wk % 7).cast("string"))).alias("fandoms"),
        *[none.alias(f) for f in ("relationships", "characters", "freeform", "warnings", "categories")],
        (wk % 9 == 0).alias("bookmark_rec"), F.col("published").alias("bookmarked_at"),
        F.date_format("published", "yyyy-MM-dd").alias("last_visited"), (wk % 11).alias("visits"))


def bookmarks(lib):
    return _listed(lib, _wk() % 3 == 0, _wk() % 20 == 1).drop("last_visited", "visits")


def history(lib):
    return _listed(lib, _wk() % 4 == 0, _wk() % 20 == 11).drop("bookmark_rec", "bookmarked_at")


def _cte(name, on, extra):
    return f"""
{name} AS (
  SELECT work_id, title || ' (listed)' AS title, authors, wk, words,
    chapter_count - CASE WHEN wk % 4 = 0 THEN 1 ELSE 0 END AS chapters,
    CASE WHEN wk % 2 = 0 THEN wk % 50 END AS kudos, hits,
    CASE WHEN wk % 13 <> 0 THEN updated_at + (wk % 5 - 2) * 2592000 END AS updated_at,
    wk % 9 = 0 AS rec, wk % 11 AS visits, complete
  FROM (SELECT * FROM works WHERE {on} UNION ALL
        SELECT * REPLACE ((wk + 1000000)::VARCHAR AS work_id) FROM works WHERE {extra}))"""


LISTS = (_cte("bm", "wk % 3 = 0", "wk % 20 = 1"), _cte("hi", "wk % 4 = 0", "wk % 20 = 11"), """
ls AS (
  SELECT coalesce(b.work_id, h.work_id) AS work_id, CASE WHEN b.work_id IS NOT NULL THEN b.title ELSE h.title END AS title,
    CASE WHEN b.work_id IS NOT NULL THEN b.chapters ELSE h.chapters END AS chapters,
    CASE WHEN b.work_id IS NOT NULL THEN b.authors ELSE h.authors END AS authors,
    CASE WHEN b.work_id IS NOT NULL THEN b.kudos ELSE h.kudos END AS kudos,
    h.visits, nullif(greatest(coalesce(b.updated_at, 0), coalesce(h.updated_at, 0)), 0) AS updated_at,
    b.work_id IS NOT NULL AS in_bookmarks, h.work_id IS NOT NULL AS in_history
  FROM bm b FULL JOIN hi h ON b.work_id = h.work_id)""", """
hd AS (
  SELECT work_id, coalesce(downloaded_at, updated, published) AS held_on, chapter_count,
    wk % 5 = 2 AS needs_skin, skin_css FROM works)""", """
pl AS (
  SELECT l.work_id, in_bookmarks, CASE WHEN h.work_id IS NULL THEN 'fetch' WHEN to_timestamp(l.updated_at)::DATE > held_on THEN 'refetch'
      WHEN needs_skin AND coalesce(skin_css, '') = '' THEN 'skin' ELSE 'skip' END AS action,
    CASE WHEN h.work_id IS NULL THEN 'not held'
      WHEN to_timestamp(l.updated_at)::DATE > held_on THEN 'AO3 ' || to_timestamp(l.updated_at)::DATE || ' > held ' || held_on
      WHEN needs_skin AND coalesce(skin_css, '') = '' THEN 'custom markup with no skin stored' ELSE 'held and current' END AS reason
  FROM ls l LEFT JOIN hd h USING (work_id))""")


def _held(lib):
    return lib.works.select(
        "work_id", "downloaded_at", "updated", F.lit(None).cast("date").alias("completed"), "published",
        (_wk() % 5 == 2).alias("needs_skin"), "skin_css")


def _merged(lib):
    return sync.merge_listings(bookmarks(lib), history(lib))


@query("merge_listings", sql(
    "SELECT work_id, title, chapters, visits, updated_at, in_bookmarks, in_history FROM ls", *LISTS))
def merge_listings(spark, root):
    return _merged(library(spark, root)).select(
        "work_id", "title", "chapters", "visits", "updated_at", "in_bookmarks", "in_history")


@query("plan_sync", sql("SELECT work_id, action, reason FROM pl", *LISTS))
def plan_sync(spark, root):
    lib = library(spark, root)
    return sync.sync(_merged(lib), _held(lib))


@query("plan_counts", sql("""
SELECT count(*) AS listed, count(*) FILTER (action = 'fetch') AS fetch, count(*) FILTER (action = 'refetch') AS refetch,
  count(*) FILTER (action = 'skin') AS skin, count(*) FILTER (action = 'skip') AS skip,
  count(*) FILTER (action <> 'skip') AS requests FROM pl""", *LISTS))
def plan_counts(spark, root):
    lib = library(spark, root)
    return sync.counts(sync.sync(_merged(lib), _held(lib)))


@query("plan_cost", sql("""
SELECT requests, round(requests * 29000 / 3600000.0, 1)::DOUBLE AS hours, greatest(1, requests) * 20 AS works,
  ceil(greatest(1, requests) * 28000 / 60000.0)::BIGINT AS minutes
FROM (SELECT count(*) AS requests FROM pl WHERE action <> 'skip')""", *LISTS))
def plan_cost(spark, root):
    lib = library(spark, root)
    n = sync.counts(sync.sync(_merged(lib), _held(lib)))
    spent, walked = sync.cost(F.col("requests")), sync.listing_cost(F.col("requests"))
    return n.select("requests", spent["hours"].alias("hours"), walked["works"].alias("works"),
                    walked["minutes"].alias("minutes"))


@query("held_as_of", sql("SELECT work_id, held_on::VARCHAR AS held_on FROM hd", LISTS[3]))
def held(spark, root):
    return _held(library(spark, root)).select("work_id", held_as_of(
        *map(F.col, ("downloaded_at", "updated", "completed", "published"))).cast("string").alias("held_on"))


@query("needs_fetching", sql("""
SELECT l.work_id FROM ls l LEFT JOIN works w USING (work_id)
WHERE l.work_id NOT IN (SELECT work_id FROM deleted)
  AND NOT (len(l.authors) > 0 AND list_has_all((SELECT list(name) FROM blocked), l.authors))
  AND (w.work_id IS NULL OR NOT w.has_text OR (l.updated_at > 0 AND to_timestamp(l.updated_at)::DATE > w.updated))""", *LISTS))
def needs_fetching(spark, root):
    lib = library(spark, root)
    return sync.needs_fetching(_merged(lib), lib)


@query("phantom_chapters", sql(
    "SELECT w.work_id, w.chapter_count, l.chapters AS listed_chapters FROM works w JOIN ls l USING (work_id) WHERE w.chapter_count > l.chapters", *LISTS))
def phantom_chapters(spark, root):
    lib = library(spark, root)
    return sync.phantom_chapters(_merged(lib), lib.works)


@query("backlog_stages", sql("""
SELECT work_id, min(rank) AS rank, ['phantom', 'bookmarks', 'refetch', 'skins', 'history'][min(rank)] AS stage FROM (
  SELECT w.work_id, 1 AS rank FROM works w JOIN ls l USING (work_id) WHERE w.chapter_count > l.chapters
  UNION ALL SELECT work_id, CASE WHEN action = 'fetch' AND in_bookmarks THEN 2 WHEN action = 'refetch' THEN 3
    WHEN action = 'skin' THEN 4 ELSE 5 END FROM pl WHERE action <> 'skip')
WHERE work_id NOT IN (SELECT work_id FROM deleted) GROUP BY 1""", *LISTS))
def backlog_stages(spark, root):
    lib = library(spark, root)
    return sync.backlog(_merged(lib), _held(lib), lib.works, done=lib.deleted)


@query("stub_backlog", sql("""
SELECT work_id FROM shown WHERE bare ORDER BY coalesce(updated, published) DESC NULLS LAST, work_id DESC"""))
def stub_backlog(spark, root):
    return sync.stub_backlog(library(spark, root)).select("work_id")


@query("auto_batch", sql("""
SELECT work_id FROM shown WHERE bare AND work_id NOT IN (SELECT work_id FROM deleted) AND work_id NOT IN (
  SELECT work_id FROM ev WHERE k % 3 <> 0 AND k % 5 < 3)
ORDER BY coalesce(updated, published) DESC NULLS LAST, work_id DESC"""))
def auto_batch(spark, root):
    lib = library(spark, root)
    items = events(spark, root).select(
        "work_id", F.expr("if(k % 3 = 0, 'done', 'running')").alias("job_state"),
        F.expr("CASE k % 5 WHEN 0 THEN 'waiting' WHEN 1 THEN 'downloading' WHEN 2 THEN 'retrying' ELSE 'failed' END").alias("state"))
    return sync.auto_batch(lib, lib.deleted, items).select("work_id")


def _items(spark, root):
    error = F.expr("""element_at(array('the archive answered 429', 'the archive answered 404', 'the archive answered 503',
      'could not reach the archive', 'this work was deleted', 'the request timed out', 'Cloudflare verification required',
      'restricted: sign in first', 'the archive answered 525', 'something odd', 'java.net.UnknownHostException',
      'rate limit exceeded'), CAST(k % 12 + 1 AS int))""")
    return events(spark, root).select(
        (F.col("user_id") % 40).alias("job"), (F.col("user_id") * 17).cast("string").alias("work_id"), "k",
        F.expr("""CASE event_type WHEN 'view' THEN 'downloaded' WHEN 'click' THEN 'version' WHEN 'error' THEN 'failed'
          WHEN 'signup' THEN 'stopped' ELSE 'waiting' END""").alias("state"),
        F.when(F.col("event_type") == "error", error).alias("error"))


@query("verify_saved", sql("""
SELECT DISTINCT (user_id * 17)::VARCHAR AS work_id FROM ev WHERE event_type = 'view'
  AND (user_id * 17)::VARCHAR NOT IN (SELECT work_id FROM chapters)"""))
def verify_saved(spark, root):
    return sync.verify_saved(_items(spark, root), library(spark, root).chapters)


_LABELS = """
fail AS (SELECT * FROM (VALUES (0, 'Archive rate limit', true), (1, 'Unavailable on the archive', false),
  (2, 'Archive temporarily unavailable', true), (3, 'Connection failed', true), (4, 'Could not download', false),
  (5, 'Connection failed', true), (6, 'Archive verification required', false), (7, 'May need archive sign-in', false),
  (8, 'AO3 secure connection failed (525)', true), (9, 'Could not download', false), (10, 'Could not download', true),
  (11, 'Archive rate limit', true)) t(c, failure, transient))"""


@query("failure_classes", sql("""
SELECT failure, transient, count(*) AS n FROM ev JOIN fail ON k % 12 = c WHERE event_type = 'error' GROUP BY 1, 2""", _LABELS))
def failure_classes(spark, root):
    return ledger.failures(_items(spark, root))


_ROLL = """
roll AS (
  SELECT job, state, total, added, failed, stopped, added + failed AS done, greatest(0, total - added - failed - stopped) AS waiting
  FROM (SELECT job, ['running', 'queued', 'listing', 'paused', 'done', 'cancelled'][job % 6 + 1] AS state, stopped,
      ok + job % 4 AS added, bad + job % 3 AS failed,
      CASE WHEN job % 2 = 0 THEN n ELSE greatest(job * 10, n + job % 4 + job % 3) END AS total
    FROM (SELECT user_id % 40 AS job, count(*) AS n, count(*) FILTER (event_type IN ('view', 'click')) AS ok,
        count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'signup') AS stopped
      FROM ev GROUP BY 1)))"""


def _jobs(spark, root):
    job = F.col("job")
    return events(spark, root).select((F.col("user_id") % 40).alias("job")).distinct().select(
        "job", F.element_at(F.array(*map(F.lit, ("running", "queued", "listing", "paused", "done", "cancelled"))),
                            (job % 6 + 1).cast("int")).alias("state"),
        (job % 4).alias("legacy_added"), (job % 3).alias("legacy_failed"), (job * 10).alias("was_total"),
        (job % 2 == 0).alias("history_complete"))


@query("job_rollup", sql("SELECT * FROM roll", _ROLL))
def job_rollup(spark, root):
    return ledger.job_rollup(_items(spark, root), _jobs(spark, root))


def _status(name, where, title, paused):
    @query(name, sql(f"""
    SELECT '{title}' AS title, count(*) FILTER (state IN ('running', 'queued', 'listing')) AS active, {paused} AS paused,
      sum(added)::BIGINT AS added, sum(greatest(failed, 0) + stopped)::BIGINT AS missing, 0::BIGINT AS issues FROM roll WHERE {where}""", _ROLL))
    def run(spark, root):
        rolled = ledger.job_rollup(_items(spark, root), _jobs(spark, root)).where(where)
        return ledger.queue_status(rolled.select(
            "*", F.lit(0).alias("unfinished"), F.lit(False).alias("issue"), F.lit(False).alias("retrying")))


_status("queue_status", "true", "Downloads in progress", "count(*) FILTER (state = 'paused')")
_status("queue_status_settled", "state IN ('done', 'cancelled')", "Some works still need attention", "0::BIGINT")


# --- the frontier of a newest-first list --------------------------------------

@query("bookmark_frontier", sql("""
SELECT work_id, page, needed, new, page_stop >= total AS complete FROM (
  SELECT b.*, (SELECT coalesce(min(CASE WHEN n = 0 THEN page END), (SELECT max(page) FROM bp)) FROM
      (SELECT page, count(*) FILTER (new) AS n FROM bp GROUP BY 1)) AS page_stop FROM bp b)
WHERE page <= page_stop""", """
bp AS (
  SELECT work_id, page, total, work_id NOT IN (SELECT work_id FROM works WHERE has_text) AS needed,
    work_id NOT IN (SELECT work_id FROM works WHERE in_bookmarks) AS new
  FROM (SELECT work_id, (wk // 3) // 20 + 1 AS page, 3 AS total FROM works WHERE wk % 3 = 0 OR wk < 40))"""))
def bookmark_frontier(spark, root):
    lib = library(spark, root)
    pages = lib.works.where((_wk() % 3 == 0) | (_wk() < 40)).select(
        "work_id", F.expr("CAST(work_id AS bigint) div 3 div 20 + 1").alias("page"), F.lit(3).alias("total_pages"))
    return sync.bookmark_frontier(pages, lib.works.where("in_bookmarks"), lib.works.where("has_text"))


@query("bookmark_frontier_deep", sql("""
SELECT work_id, page, needed, true AS new, page_stop >= total AS complete FROM (
  SELECT b.*, (SELECT coalesce(min(CASE WHEN n = 0 THEN page END), (SELECT max(page) FROM bd)) FROM
      (SELECT page, count(*) FILTER (new) AS n FROM bd GROUP BY 1)) AS page_stop FROM bd b)
WHERE page <= page_stop""", """
bd AS (
  SELECT work_id, page, total, work_id NOT IN (SELECT work_id FROM works WHERE has_text) AS needed, true AS new
  FROM (SELECT work_id, wk // 20 + 1 AS page, (SELECT max(wk) // 20 + 1 FROM works) AS total FROM works WHERE NOT in_bookmarks))"""))
def bookmark_frontier_deep(spark, root):
    """A list of which nothing is known is walked to its last page."""
    lib = library(spark, root)
    total = lib.works.agg((F.max(_wk()) / 20).cast("bigint") + 1).scalar()
    pages = lib.works.where(~F.col("in_bookmarks")).select(
        "work_id", F.expr("CAST(work_id AS bigint) div 20 + 1").alias("page"), total.alias("total_pages"))
    return sync.bookmark_frontier(pages, lib.works.where("in_bookmarks"), lib.works.where("has_text"))


# --- listings into the library ------------------------------------------------

@query("apply_listings", sql("""
SELECT work_id, title, in_bookmarks, rec, in_history, visits, kudos, has_text FROM (
  SELECT w.work_id, w.title, b.work_id IS NOT NULL AS in_bookmarks, coalesce(b.rec, false) AS rec, h.work_id IS NOT NULL AS in_history,
    CASE WHEN h.work_id IS NOT NULL THEN h.visits ELSE w.visits END AS visits,
    coalesce(CASE WHEN b.work_id IS NOT NULL THEN b.kudos ELSE h.kudos END, w.kudos) AS kudos,
    w.has_text OR w.work_id IN (SELECT work_id FROM chapters) AS has_text
  FROM works w LEFT JOIN bm b USING (work_id) LEFT JOIN hi h USING (work_id)
  UNION ALL
  SELECT work_id, title, false, false, in_history, visits, kudos, false FROM ls WHERE work_id NOT IN (SELECT work_id FROM works))""", *LISTS))
def apply_listings(spark, root):
    lib = library(spark, root)
    return sync.apply_listings(lib, bookmarks(lib), history(lib)).works.select(
        "work_id", "title", "in_bookmarks", "rec", "in_history", "visits", "kudos", "has_text")


@query("apply_listings_tags", sql("""
SELECT work_id, kind, name FROM tags UNION ALL
SELECT work_id, 'fandom', 'Fandom ' || (work_id::BIGINT - 1000000) % 7 FROM ls WHERE work_id NOT IN (SELECT work_id FROM works)""", *LISTS))
def apply_listings_tags(spark, root):
    lib = library(spark, root)
    return sync.apply_listings(lib, bookmarks(lib), history(lib)).tags


@query("save_stubs", sql("""
SELECT w.work_id, CASE WHEN s.work_id IS NULL THEN w.title ELSE s.title END AS title,
  CASE WHEN s.work_id IS NULL THEN w.kudos ELSE s.kudos END AS kudos, CASE WHEN s.work_id IS NULL THEN w.source ELSE 'listing' END AS source
FROM stub_w w LEFT JOIN (SELECT * FROM stub_l SEMI JOIN stub_p USING (work_id)) s USING (work_id)
UNION ALL SELECT work_id, title, kudos, 'listing' FROM stub_l ANTI JOIN stub_w USING (work_id)""", *LISTS, """
stub_w AS MATERIALIZED (SELECT work_id, title, kudos, source FROM works)""", """
stub_p AS MATERIALIZED (SELECT DISTINCT work_id FROM allrows WHERE placeholder)""", """
stub_l AS MATERIALIZED (SELECT * FROM ls ANTI JOIN deleted USING (work_id))"""))
def save_stubs(spark, root):
    lib = library(spark, root)
    return sync.save_stubs(lib, _merged(lib)).works.select("work_id", "title", "kudos", "source")


# --- pictures -----------------------------------------------------------------

def pictured(spark, root):
    """Pages with pictures laid in by number, some of them already stored."""
    k = F.col("page_id")
    first = F.concat(F.lit('<img alt="a" src="'), F.col("url"), F.lit('">'))
    second = F.concat(F.lit('<p><IMG src="https://www.pics'), (k % 9).cast("string"), F.lit(".example.net/a?x=1&amp;y="), k.cast("string"), F.lit('"></p>'))
    third = F.when(k % 4 == 0, '<img src="images/cover.jpg">').when(k % 4 == 1, '<img src="data:image/png;base64,AA">').otherwise("")
    return table(spark, root, "pages").select(
        k.cast("string").alias("work_id"), F.lit(1).alias("number"), "page_id", "url",
        F.concat("html", first, second, second, third).alias("html"))


_WANT = """
want AS (
  SELECT page_id::VARCHAR AS work_id, url FROM pages UNION ALL
  SELECT page_id::VARCHAR, 'https://www.pics' || page_id % 9 || '.example.net/a?x=1&y=' || page_id FROM pages)"""


@query("image_urls", sql("SELECT work_id, url FROM want", _WANT))
def image_urls(spark, root):
    from storyloom.functions import text as tx
    return pictured(spark, root).select("work_id", F.explode(tx.image_urls(F.col("html"))).alias("url"))


_STORED = "status = 'stored' AND length(sha256) = 64 AND length(bytes) > 0"


@query("next_images", sql(f"""
SELECT work_id, url FROM want WHERE (work_id, url) NOT IN (SELECT (work_id, url) FROM images
  WHERE ({_STORED}) OR (status = 'failed' AND fetched_at > TIMESTAMP '2024-01-05' - INTERVAL 1 DAY))""", _WANT))
def next_images(spark, root):
    return sync.next_images(pictured(spark, root), library(spark, root).images, "2024-01-05 00:00:00").select("work_id", "url")


@query("missing_images", sql("""
SELECT url, min(work_id) AS work_id FROM want GROUP BY url
HAVING (min(work_id), url) NOT IN (SELECT (work_id, url) FROM images WHERE status = 'stored')""", _WANT))
def missing_images(spark, root):
    return sync.missing_images(pictured(spark, root), library(spark, root).images).select("url", "work_id")


# --- which copy ---------------------------------------------------------------

@query("snapshot_choose", sql("""
SELECT work_id, source, title FROM (
  SELECT o_orderkey::VARCHAR AS work_id, s.i AS i, ['ao3', 'mirror', 'wayback', 'wayback'][s.i] AS source, 'Copy ' || s.i AS title,
    (o_orderkey + s.i) % 3 AS n, CASE WHEN (o_orderkey * s.i) % 5 = 0 THEN 0 ELSE (o_orderkey + s.i * 7) % 3 END AS posted,
    (o_orderkey + s.i) % 7 <> 0 AS same
  FROM orders, (VALUES (1), (2), (3), (4)) s(i))
WHERE n > 0 AND CASE WHEN source = 'ao3' THEN posted = 0 OR posted = n ELSE same AND posted = n END
QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY CASE source WHEN 'ao3' THEN 0 WHEN 'mirror' THEN 1 ELSE 2 END, i DESC) = 1"""))
def snapshot_choose(spark, root):
    copies = table(spark, root, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("i")).selectExpr(
        "CAST(o_orderkey AS string) AS work_id", "element_at(array('ao3', 'mirror', 'wayback', 'wayback'), i) AS source",
        "timestamp_seconds(1700000000 + i * 86400) AS captured",
        "CAST(if((o_orderkey + i) % 7 <> 0, o_orderkey, -1) AS string) AS found_id", "concat('Copy ', i) AS title",
        """if((o_orderkey + i) % 3 = 0, CAST(array() AS array<struct<number: int, html: string>>),
           transform(sequence(1, CAST((o_orderkey + i) % 3 AS int)), n -> struct(n AS number, 'text' AS html))) AS chapters""",
        "CAST(if((o_orderkey * i) % 5 = 0, 0, (o_orderkey + i * 7) % 3) AS int) AS posted")
    return sync.choose_copy(copies).select("work_id", "source", "title")


# --- journal ------------------------------------------------------------------

def journal_lines(spark, root):
    """A journal written from the event table: ticks, and requests with ends."""
    e = events(spark, root).withColumn("ms", F.unix_millis("ts") - F.lit(1704067200000))
    line = F.expr("""filter(array(
      if(event_type = 'view', to_json(named_struct('schema', 1, 'timeMs', ms, 'elapsedMs', ms, 'session', concat('s', user_id % 50),
        'event', 'request_start', 'data', map('request', event_id))), NULL),
      if(event_type = 'view' AND event_id % 3 <> 0, to_json(named_struct('schema', 1, 'timeMs', ms, 'elapsedMs', ms + k * 10,
        'session', concat('s', user_id % 50), 'event', 'request_end', 'data', map('request', event_id, 'outcome', k % 3, 'bytes', k * 100))), NULL),
      if(event_type = 'error', to_json(named_struct('schema', 1, 'timeMs', ms, 'elapsedMs', ms, 'session', concat('s', user_id % 50),
        'event', 'native_tick', 'data', map('request', event_id))), NULL)), x -> x IS NOT NULL)""")
    cut = F.when(F.col("event_id") % 97 == 0, F.substring("line", 1, 40)).otherwise(F.col("line"))
    return e.select("event_id", F.explode(line).alias("line")).select(cut.alias("line"))


_EVMS = """
em AS (SELECT *, epoch_us(ts) // 1000 - 1704067200000 AS ms, 's' || user_id % 50 AS session FROM ev WHERE event_id % 97 <> 0)"""


@query("telemetry_jsonl", sql("""
SELECT session, event, count(*) AS n, sum("elapsedMs")::BIGINT AS elapsed FROM (
  SELECT session, 'request_start' AS event, ms AS "elapsedMs" FROM em WHERE event_type = 'view'
  UNION ALL SELECT session, 'request_end', ms + k * 10 FROM em WHERE event_type = 'view' AND event_id % 3 <> 0
  UNION ALL SELECT session, 'native_tick', ms FROM em WHERE event_type = 'error') GROUP BY 1, 2""", _EVMS))
def telemetry_jsonl(spark, root):
    return ledger.parse_journal(journal_lines(spark, root), "line").groupBy("session", "event").agg(
        F.count(F.lit(1)).alias("n"), F.sum("elapsedMs").alias("elapsed"))


@query("request_pairs", sql("""
SELECT session, event_id AS request, ms AS started_ms, CASE WHEN event_id % 3 <> 0 THEN k * 10 END AS took_ms,
  CASE WHEN event_id % 3 <> 0 THEN k % 3 END AS outcome, CASE WHEN event_id % 3 <> 0 THEN k * 100 END AS bytes,
  event_id % 3 = 0 AS pending FROM em WHERE event_type = 'view'""", _EVMS))
def request_pairs(spark, root):
    return ledger.request_pairs(ledger.parse_journal(journal_lines(spark, root), "line"))


@query("tick_gaps", sql("""
SELECT session, ms AS "elapsedMs", gap AS gap_ms FROM (
  SELECT session, ms, ms - lag(ms) OVER (PARTITION BY session ORDER BY ms) AS gap FROM em WHERE event_type = 'error')
WHERE gap > 43200000""", _EVMS))
def tick_gaps(spark, root):
    ticks = ledger.parse_journal(journal_lines(spark, root), "line").where("event = 'native_tick'")
    return ledger.tick_gaps(ticks.select("session", "elapsedMs"), gap_ms=43_200_000)
