"""Streaming jobs run over the event table as files that have arrived."""

import uuid

from pyspark.sql import functions as F

from registry import query
from registry.base import sql
from registry.pages import listing_table
from registry.reading import FOLD_SQL
from storyloom.session import scratch_root
from storyloom.sources.star import event_stream, library
from storyloom.streaming import jobs


def _path(spark, name):
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _visits(spark, root):
    return event_stream(spark, root).where("event_type = 'view'").select(
        F.expr("concat('v', event_id)").alias("id"), "work_id", F.col("ts").alias("started_at"))


_DONE = "(SELECT max(ts) FROM ev WHERE event_type = 'view') - INTERVAL 1 HOUR"


@query("visits_stream", sql("SELECT work_id, count(DISTINCT event_id) AS visits FROM ev WHERE event_type = 'view' GROUP BY 1"))
def visits_stream(spark, root):
    seen = _visits(spark, root)
    return jobs.upsert_to(jobs.visit_counts(seen), _path(spark, "visits"), ["work_id"])


def _windows(name, width_h, slide_h):
    starts = f"range(0, {width_h // slide_h}) s(i)"
    first = f"time_bucket(INTERVAL {slide_h} HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL {slide_h} HOUR * s.i::INT"

    @query(name, sql(f"""
    SELECT epoch(start)::BIGINT AS from_, work_id, count(*) AS visits FROM (
      SELECT work_id, {first} AS start FROM ev, {starts} WHERE event_type = 'view')
    WHERE start + INTERVAL {width_h} HOUR <= {_DONE} GROUP BY 1, 2"""))
    def run(spark, root):
        out = jobs.visits_by_window(_visits(spark, root), f"{width_h} hours", f"{slide_h} hours")
        return jobs.append_to(out, _path(spark, name)).select(
            F.unix_timestamp("from").alias("from_"), "work_id", "visits")


_windows("visits_tumbling", 24, 24)
_windows("visits_sliding", 24, 12)


@query("reading_sessions", sql("""
SELECT user_id AS reader, epoch_us(min(ts)) AS from_, epoch_us(max(ts)) + 10800000000 AS to_, count(*) AS events FROM (
  SELECT user_id, ts, sum(CASE WHEN ts < prev + INTERVAL 3 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (
    SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM ev))
GROUP BY user_id, run HAVING max(ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR"""))
def reading_sessions(spark, root):
    raw = event_stream(spark, root).select(F.col("user_id").alias("reader"), F.col("ts").alias("at"))
    out = jobs.append_to(jobs.reading_sessions(raw, "3 hours"), _path(spark, "sessions"))
    return out.select("reader", F.unix_micros("from").alias("from_"), F.unix_micros("to").alias("to_"), "events")


@query("reading_state_stream", sql("""
SELECT work_id, chapter, off_ AS "offset", coalesce(n, 0) AS chapters_read, cb AS completed_before,
  epoch_us(upd) AS updated_at, epoch_us(opn) AS opened_at
FROM replay WHERE made QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY rn DESC) = 1""",
    *FOLD_SQL).replace("WITH lines", "WITH RECURSIVE lines", 1))
def reading_state_stream(spark, root):
    kind = F.expr("""CASE event_type WHEN 'click' THEN 'progress' WHEN 'error' THEN 'opened'
        WHEN 'purchase' THEN if(k % 4 = 0, 'unfinished', 'finished') WHEN 'signup' THEN 'restart' END""")
    raw = event_stream(spark, root).select(
        "work_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"),
        (F.col("k") % 9 + 1).cast("int").alias("chapter"), F.col("value").alias("offset"))
    out = jobs.reading_state(raw, library(spark, root), _path(spark, "reading"), "1 day")
    return out.withColumn("updated_at", F.unix_micros("updated_at")).withColumn("opened_at", F.unix_micros("opened_at"))


@query("request_pairs_stream", sql("""
SELECT 's' || user_id % 50 AS session, event_id AS request, epoch_us(ts) AS started_us,
  CASE WHEN event_id % 3 <> 0 THEN k % 3 END AS outcome, event_id % 3 = 0 AS pending
FROM ev WHERE event_type = 'view'"""))
def request_pairs_stream(spark, root):
    seen = event_stream(spark, root).where("event_type = 'view'")
    named = [F.expr("concat('s', user_id % 50)").alias("session"), F.col("event_id").alias("request")]
    starts = seen.select(*named, F.col("ts").alias("at"))
    ends = event_stream(spark, root).where("event_type = 'view' AND event_id % 3 <> 0").select(
        *named, F.expr("ts + make_dt_interval(0, 0, 0, k / 10)").alias("at"), (F.col("k") % 3).alias("outcome"), (F.col("k") * 100).alias("bytes"))
    return jobs.requests_now(starts, ends, _path(spark, "pairs")).select(
        "session", "request", F.unix_micros("started_at").alias("started_us"), "outcome", "pending")


@query("tick_gap_alerts", sql("""
SELECT session, ms AS "elapsedMs", gap AS gap_ms FROM (
  SELECT session, ms, ms - lag(ms) OVER (PARTITION BY session ORDER BY ms) AS gap FROM (
    SELECT 's' || user_id % 50 AS session, epoch_us(ts) // 1000 - 1704067200000 AS ms FROM ev WHERE event_type = 'error'))
WHERE gap > 43200000"""))
def tick_gap_alerts(spark, root):
    ticks = event_stream(spark, root).where("event_type = 'error'").select(
        F.expr("concat('s', user_id % 50)").alias("session"), (F.unix_millis("ts") - F.lit(1704067200000)).alias("elapsedMs"))
    return jobs.tick_gap_alerts(ticks, _path(spark, "ticks"), 43_200_000)


@query("job_progress_stream", sql("""
SELECT user_id % 40 AS job, arg_max(event_type, (ts, event_id)) AS state, arg_max(k, (ts, event_id)) AS done,
  arg_max(k + 7, (ts, event_id)) AS total FROM ev GROUP BY 1"""))
def job_progress_stream(spark, root):
    raw = event_stream(spark, root).select(
        (F.col("user_id") % 40).alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("state"), F.col("k").alias("done"), (F.col("k") + 7).alias("total"))
    return jobs.upsert_to(jobs.job_progress(raw), _path(spark, "progress"), ["job"])


@query("listing_stream", sql("""
SELECT work_id, CASE WHEN wk % 2 = 0 THEN 'fetch' WHEN to_timestamp(updated_at)::DATE > coalesce(downloaded_at, updated, published)
  THEN 'refetch' ELSE 'skip' END AS action FROM works"""))
def listing_stream(spark, root):
    """Listing pages written as files, then planned against what is held as they arrive."""
    path = _path(spark, "listings")
    listing_table(spark, root).write.parquet(f"{path}/in")
    arriving = spark.readStream.schema("page_id long, html string").parquet(f"{path}/in")
    held = library(spark, root).works.where(F.col("work_id").cast("bigint") % 2 == 1).select(
        "work_id", "downloaded_at", "updated", F.lit(None).cast("date").alias("completed"), "published",
        F.lit(False).alias("needs_skin"), "skin_css")
    return jobs.listing_plans(arriving, held, path).select("work_id", "action")
