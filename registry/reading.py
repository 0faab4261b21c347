"""Reading-state queries."""

from pyspark.sql import functions as F

from registry import query
from registry.base import sql
from storyloom.functions import values
from storyloom.operators import catalog, reading
from storyloom.sources.star import events, library, table


@query("reading_state", sql("""
SELECT work_id, total, started, finished, completed, epoch_us(local_read) AS local_last_read,
  epoch_us(last_read) AS last_read, total_visits FROM allrows"""))
def reading_state(spark, root):
    out = reading.state_columns(library(spark, root))
    return out.withColumn("local_last_read", F.unix_micros("local_last_read")).withColumn(
        "last_read", F.unix_micros("last_read"))


@query("reading_status", sql("""
SELECT work_id, total, read, started, done, least(total, CASE WHEN read >= place AND NOT done THEN read + 1 ELSE place END) AS at_,
  coalesce(completed_before, false) AND NOT done AS rereading,
  least(100, floor(read * 100.0 / total + 0.5))::INT AS percent
FROM (SELECT *, read >= total AS done FROM (
  SELECT work_id, total, coalesce(chapters_read, 0) AS read, greatest(1, coalesce(at_chapter, 1)) AS place,
    started, completed_before FROM allrows))"""))
def reading_status(spark, root):
    return reading.status(library(spark, root)).withColumnRenamed("at", "at_")


@query("record_visit", sql("""
SELECT id, work_id, epoch_us(started_at) AS started_at FROM (
  SELECT 'e' || (event_id // 2) AS id, (user_id * 131)::VARCHAR AS work_id, ts AS started_at FROM ev)
WHERE work_id IN (SELECT work_id FROM works)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY started_at, work_id) = 1""".replace(
    "WHERE work_id IN (SELECT work_id FROM works)\nQUALIFY", "QUALIFY")
    .replace("SELECT id, work_id, epoch_us", "SELECT * FROM (SELECT id, work_id, epoch_us") + ") WHERE work_id IN (SELECT work_id FROM works)"))
def record_visit(spark, root):
    lib = library(spark, root)
    raw = events(spark, root).select(
        F.expr("concat('e', event_id div 2)").alias("id"),
        (F.col("user_id") * 131).cast("string").alias("work_id"), F.col("ts").alias("started_at"))
    return reading.record_visits(raw, lib.works).withColumn("started_at", F.unix_micros("started_at"))


@query("visits_total", sql("SELECT work_id, ff_visits, total_visits AS total FROM allrows"))
def visits_total(spark, root):
    return reading.visits_total(library(spark, root))


@query("visit_label", sql("""
SELECT work_id, CASE WHEN visits IS NULL AND ff_visits = 0 THEN '' WHEN total_visits = 1 THEN '1 visit'
  ELSE total_visits || ' visits' END AS label,
  CASE WHEN visits IS NULL AND ff_visits = 0 THEN '' WHEN visits IS NULL THEN 'AO3 not synced · ' || ff_visits || ' in this library'
  ELSE visits || ' on AO3 · ' || ff_visits || ' in this library' END AS breakdown FROM allrows"""))
def visit_label(spark, root):
    return catalog.rows(library(spark, root)).select(
        "work_id", values.visit_label(F.col("local_visits"), F.col("visits")).alias("label"),
        values.visit_breakdown(F.col("local_visits"), F.col("visits")).alias("breakdown"))


def fold_events(spark, root):
    """Clicks are progress, purchases finish or take it back, signups restart."""
    kind = F.expr("""CASE event_type WHEN 'click' THEN 'progress' WHEN 'error' THEN 'opened'
        WHEN 'purchase' THEN if(k % 4 = 0, 'unfinished', 'finished')
        WHEN 'signup' THEN 'restart' END""")
    return events(spark, root).select(
        "work_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"),
        (F.col("k") % 9 + 1).cast("int").alias("chapter"), F.col("value").alias("offset"))


# A replay, one event after another, by recursion over each work's line.
FOLD_SQL = ("""
fe AS (
  SELECT e.work_id, ts, event_id, kind, chapter, value, total,
    row_number() OVER (PARTITION BY e.work_id ORDER BY ts, event_id) AS rn
  FROM (SELECT *, (k % 9 + 1)::INT AS chapter, CASE event_type WHEN 'click' THEN 'progress' WHEN 'error' THEN 'opened'
          WHEN 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'unfinished' ELSE 'finished' END
          WHEN 'signup' THEN 'restart' END AS kind FROM ev) e
  JOIN (SELECT work_id, total FROM allrows) t USING (work_id) WHERE kind IS NOT NULL)""", """
replay AS (
  SELECT work_id, 0::BIGINT AS rn, false AS made, NULL::INT AS chapter, NULL::DOUBLE AS off_, NULL::INT AS n,
    false AS cb, NULL::TIMESTAMP AS upd, NULL::TIMESTAMP AS opn FROM (SELECT DISTINCT work_id FROM fe)
  UNION ALL
  SELECT r.work_id, e.rn, r.made OR e.kind <> 'unfinished',
    CASE e.kind WHEN 'progress' THEN e.chapter WHEN 'restart' THEN 1 ELSE r.chapter END,
    CASE e.kind WHEN 'progress' THEN e.value WHEN 'restart' THEN 0 ELSE r.off_ END,
    CASE e.kind WHEN 'progress' THEN greatest(coalesce(r.n, 0), e.chapter - 1) WHEN 'finished' THEN e.total
      WHEN 'unfinished' THEN CASE WHEN r.made THEN greatest(0, coalesce(r.chapter, 1) - 1) ELSE r.n END
      WHEN 'restart' THEN 0 ELSE r.n END,
    CASE WHEN e.kind = 'restart' THEN r.cb OR coalesce(r.n, 0) >= e.total ELSE r.cb END,
    CASE WHEN e.kind IN ('progress', 'finished', 'restart') OR (e.kind = 'unfinished' AND r.made) THEN e.ts ELSE r.upd END,
    CASE WHEN e.kind IN ('progress', 'opened', 'restart') OR (e.kind = 'finished' AND NOT r.made) THEN e.ts ELSE r.opn END
  FROM replay r JOIN fe e ON e.work_id = r.work_id AND e.rn = r.rn + 1)""")


@query("reading_fold", sql("""
SELECT work_id, chapter, off_ AS "offset", coalesce(n, 0) AS chapters_read, cb AS completed_before,
  epoch_us(upd) AS updated_at, epoch_us(opn) AS opened_at
FROM replay WHERE made QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY rn DESC) = 1""",
    *FOLD_SQL).replace("WITH lines", "WITH RECURSIVE lines", 1))
def reading_fold(spark, root):
    out = reading.fold(fold_events(spark, root), library(spark, root))
    return out.withColumn("updated_at", F.unix_micros("updated_at")).withColumn(
        "opened_at", F.unix_micros("opened_at"))


@query("history_snapshot", sql("""
SELECT w.work_id, CASE WHEN s.v IS NULL THEN w.visits ELSE s.v END AS visits, w.in_history OR s.v IS NOT NULL AS in_history
FROM works w LEFT JOIN (
  SELECT work_id, v FROM (SELECT work_id, CASE WHEN k % 13 = 0 THEN NULL ELSE k - 5 END AS v, ts FROM ev) WHERE v >= 0
  QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY ts DESC, v DESC) = 1) s USING (work_id)"""))
def history_snapshot(spark, root):
    snapshot = events(spark, root).select(
        "work_id", F.expr("if(k % 13 = 0, NULL, k - 5)").alias("visits"),
        F.date_format("ts", "yyyy-MM-dd").alias("last_visited"), F.col("ts").alias("synced_at"))
    return reading.apply_history(library(spark, root).works, snapshot).select("work_id", "visits", "in_history")


def _reconcile(name, complete):
    after = "listed" if complete else "in_bookmarks OR listed"

    @query(name, sql(f"""
    SELECT work_id, after AS in_bookmarks, CASE WHEN in_bookmarks AND after THEN 'kept' WHEN after THEN 'added'
      WHEN in_bookmarks THEN 'dropped' ELSE 'none' END AS change
    FROM (SELECT work_id, in_bookmarks, {after} AS after FROM (
      SELECT work_id, in_bookmarks, work_id IN (SELECT work_id FROM bookmarked_by) AS listed FROM works))"""))
    def run(spark, root):
        lib = library(spark, root)
        return reading.reconcile_bookmarks(lib.works, lib.bookmarked_by, complete).select(
            "work_id", "in_bookmarks", "change")


_reconcile("reconcile_bookmarks", True)
_reconcile("reconcile_bookmarks_partial", False)


@query("mark_work", sql("""
SELECT w.work_id, coalesce(max(CASE WHEN field = 'in_bookmarks' THEN on_ END)::BOOLEAN, any_value(in_bookmarks)) AS in_bookmarks,
  coalesce(max(CASE WHEN field = 'rec' THEN on_ END)::BOOLEAN, any_value(rec)) AS rec,
  coalesce(max(CASE WHEN field = 'kudos_given' THEN on_ END)::BOOLEAN, any_value(kudos_given)) AS kudos_given
FROM works w LEFT JOIN (
  SELECT work_id, field, on_ FROM (
    SELECT work_id, CASE k % 4 WHEN 0 THEN 'in_bookmarks' WHEN 1 THEN 'rec' WHEN 2 THEN 'kudos_given' ELSE 'title' END AS field,
      (value > 10)::INT AS on_, ts FROM ev)
  QUALIFY row_number() OVER (PARTITION BY work_id, field ORDER BY ts DESC, on_ DESC) = 1) m USING (work_id)
GROUP BY w.work_id"""))
def mark_work(spark, root):
    marks = events(spark, root).select(
        "work_id", F.expr("CASE k % 4 WHEN 0 THEN 'in_bookmarks' WHEN 1 THEN 'rec' WHEN 2 THEN 'kudos_given' ELSE 'title' END").alias("field"),
        (F.col("value") > 10).alias("on"), F.col("ts").alias("at"))
    return reading.mark_works(library(spark, root).works, marks).select("work_id", "in_bookmarks", "rec", "kudos_given")


_BACKUP = """
SELECT work_id, at_::INT AS chapter, coalesce(offsets[at_], 0.0) AS "offset",
  len(list_filter(marks, lambda m: m > 0)) AS chapters_read,
  CASE WHEN cnt > 0 THEN cnt ELSE greatest(len(offsets), len(marks), 1) END::INT AS chapter_count
FROM (SELECT *, coalesce(list_max(list_filter(range(1, greatest(len(offsets), len(marks)) + 1),
    lambda i: abs(coalesce(offsets[i], 0)) > 1e-9 OR coalesce(marks[i], 0) <> 0)), 1) AS at_
  FROM (SELECT o_orderkey::VARCHAR AS work_id, o_orderkey % 5 AS cnt,
    list_transform(range(1, o_orderkey % 6 + 1), lambda i: CASE WHEN (o_orderkey + i) % 3 = 0 THEN i * 1.5::DOUBLE ELSE 0.0::DOUBLE END) AS offsets,
    list_transform(range(1, o_orderkey % 4 + 1), lambda i: (o_orderkey + i) % 2) AS marks FROM orders))"""


@query("reading_backup", sql(_BACKUP))
def reading_backup(spark, root):
    return reading.from_backup(_positions(spark, root))


def _positions(spark, root):
    k = F.col("o_orderkey")
    return table(spark, root, "orders").select(
        k.cast("string").alias("work_id"), (k % 5).cast("int").alias("chapter_count"),
        F.expr("""if(o_orderkey % 6 = 0, CAST(array() AS array<double>), transform(sequence(1, CAST(o_orderkey % 6 AS int)),
            i -> if((o_orderkey + i) % 3 = 0, i * CAST(1.5 AS double), CAST(0 AS double))))""").alias("offsets"),
        F.expr("""if(o_orderkey % 4 = 0, CAST(array() AS array<bigint>),
            transform(sequence(1, CAST(o_orderkey % 4 AS int)), i -> (o_orderkey + i) % 2))""").alias("marks"))


@query("import_backup", sql("""
SELECT work_id, CASE WHEN p.chapter_count IS NULL THEN r.chapter ELSE p.chapter END AS chapter,
  CASE WHEN p.chapter_count IS NULL THEN r."offset" ELSE p."offset" END AS "offset",
  CASE WHEN p.chapter_count IS NULL THEN r.chapters_read ELSE p.chapters_read END AS chapters_read,
  coalesce(l.wanted, r.marked_later, false) AS marked_later
FROM reading r FULL JOIN bk p USING (work_id) FULL JOIN lt l USING (work_id)""",
    f"bk AS ({_BACKUP})", "lt AS (SELECT o_orderkey::VARCHAR AS work_id, true AS wanted FROM orders WHERE o_orderkey % 7 = 0)"))
def import_backup(spark, root):
    """Another reader's places and its later list, laid over what is held."""
    later = table(spark, root, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").cast("string").alias("work_id"))
    out = reading.import_backup(library(spark, root).reading, _positions(spark, root), later, "backup")
    return out.select("work_id", "chapter", "offset", "chapters_read", "marked_later")
