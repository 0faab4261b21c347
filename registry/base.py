"""The star-schema library again, as SQL common tables for the other engine.

Written apart from the Spark derivation, so that a slip in either shows.
"""

BASE = """
lines AS (
  SELECT l_orderkey AS ok, sum(l_quantity) AS qty, count(*) AS n,
         max(l_shipdate)::DATE AS last_ship,
         list_sort(list_distinct(list(s_name))) AS names,
         bool_and(l_suppkey % 4 = 0) AS all_blocked
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
src AS (
  SELECT o_orderkey AS k, o.*, c.c_name, c.c_mktsegment, n.n_name, l.*,
         o_orderdate::DATE AS pub,
         EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = o_orderkey) AS has_doc
  FROM orders o
  LEFT JOIN customer c ON o_custkey = c_custkey
  LEFT JOIN nation n ON c_nationkey = n_nationkey
  LEFT JOIN lines l ON o_orderkey = l.ok),
works AS (
  SELECT k::VARCHAR AS work_id, k AS wk,
    CASE WHEN k % 223 = 0 THEN NULL WHEN k % 227 = 0 THEN 'Mystery Work'
         ELSE (CASE WHEN k % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END)
              || ' of ' || n_name || ' ' || (k % 97)::VARCHAR END AS title,
    CASE WHEN k % 223 = 0 THEN ['Anonymous'] ELSE coalesce(names, []::VARCHAR[]) END AS authors,
    CASE WHEN k % 223 = 0 THEN '' WHEN k % 211 = 0
         THEN 'This is part of an ongoing challenge and will be revealed soon!'
         ELSE 'A ' || lower(o_orderpriority) || ' story kept by ' || c_name END AS summary,
    o_orderpriority AS rating, n_name AS language, pub AS published, last_ship AS updated,
    CASE WHEN k % 11 <> 0 THEN pub + (k % 400)::INT END AS downloaded_at,
    o_orderstatus = 'F' AS complete,
    CASE WHEN k % 223 = 0 OR k % 227 = 0 THEN 0 ELSE (qty * 100)::BIGINT END AS words,
    CASE WHEN k % 7 <> 0 THEN n::INT END AS chapter_count,
    CASE WHEN o_orderstatus <> 'P' THEN (n + k % 3)::INT END AS chapters_planned,
    epoch(last_ship)::BIGINT + k % 86400 AS updated_at,
    CASE WHEN k % 10 = 3 THEN '.chat' || (k % 7)::VARCHAR || '{color:red}' END AS skin_css,
    CASE k % 4 WHEN 0 THEN 'ao3' WHEN 1 THEN 'epub' ELSE 'listing' END AS source,
    CASE WHEN k % 5 <> 0 THEN (pub + (k % 900)::INT)::TIMESTAMP END AS fetched_at,
    k % 3 = 0 AS in_bookmarks, k % 15 = 0 AS rec, k % 4 = 0 AS in_history,
    CASE WHEN k % 4 = 0 THEN (pub + (k % 1000)::INT)::TIMESTAMP END AS visited,
    CASE WHEN k % 5 <> 0 THEN k % 6 END AS visits,
    CASE WHEN k % 5 <> 0 THEN (pub + 30)::TIMESTAMP END AS visits_synced_at,
    k % 17 = 0 AS kudos_given, has_doc AS has_text,
    CASE WHEN k % 8 <> 0 THEN k * 7 % 1000 END AS kudos,
    CASE WHEN k % 9 <> 0 THEN k * 3 % 200 END AS bookmark_count,
    CASE WHEN k % 10 <> 0 THEN k * 13 % 5000 END AS hits,
    k % 223 <> 0 AND coalesce(all_blocked, false) AS hidden
  FROM src),
tags AS (
  SELECT DISTINCT l_orderkey::VARCHAR AS work_id, t.kind, t.name
  FROM lineitem JOIN part ON l_partkey = p_partkey,
    LATERAL (VALUES ('fandom', p_brand), ('relationship', p_type), ('freeform', p_name),
             ('warning', l_returnflag), ('category', l_linestatus)) t(kind, name)),
chapters AS (
  SELECT doc_id * 1000000 + idx AS id, doc_id::VARCHAR AS work_id, idx::INT AS number,
         'Chapter ' || idx::VARCHAR AS title, '<p>' || line || '</p>' AS html, line AS text,
         len(regexp_extract_all(line, '[\\p{L}\\p{N}''’-]+')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents)
  WHERE length(trim(line)) > 0),
ev AS (
  SELECT event_id, ts, user_id, event_type, value, k, (user_id * 5 + k % 5)::VARCHAR AS work_id
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)),
reading AS (
  SELECT work_id, max(CASE WHEN event_type = 'click' THEN k % 9 + 1 END)::INT AS chapter,
    max(CASE WHEN event_type = 'click' THEN value END) AS "offset",
    max(CASE WHEN event_type = 'click' THEN k % 9
             WHEN event_type = 'purchase' AND k % 2 = 0 THEN 12 END)::INT AS chapters_read,
    bool_or(event_type = 'purchase' AND k % 10 = 0) AS completed_before,
    bool_or(event_type = 'signup' AND k % 4 = 0) AS marked_later,
    max(CASE WHEN event_type IN ('click', 'purchase') THEN ts END) AS read_at,
    max(CASE WHEN event_type = 'error' AND k % 2 = 0 THEN ts END) AS opened_at
  FROM ev GROUP BY 1),
rvisits AS (SELECT 'v' || event_id AS id, work_id, ts AS started_at FROM ev WHERE event_type = 'view'),
bookmarked_by AS (
  SELECT 'reader ' || user_id AS person, work_id, min(ts) AS "at"
  FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2),
deleted AS (
  SELECT o_orderkey::VARCHAR AS work_id, 'Removed ' || o_orderkey AS title, o_orderdate AS "at"
  FROM orders WHERE o_orderkey % 50 = 0),
blocked AS (SELECT s_name AS name FROM supplier WHERE s_suppkey % 4 = 0),
chapter_versions AS (
  SELECT work_id, number, title, '<p>Earlier.</p>' || html AS html, 'Earlier. ' || text AS text, words,
         sha256('<p>Earlier.</p>' || html) AS content_hash, 'content' AS reason,
         (DATE '2024-01-01' + (number % 20)::INT)::TIMESTAMP AS archived_at
  FROM chapters WHERE id % 3 = 0),
skin_versions AS (
  SELECT work_id, skin_css, sha256(skin_css) AS skin_hash, archived_at FROM (
    SELECT doc_id::VARCHAR AS work_id, '.v' || i || '{margin:' || (doc_id % 9) || 'px}' AS skin_css,
           (DATE '2024-01-03' + (i * 5)::INT)::TIMESTAMP AS archived_at
    FROM documents, range(4) r(i) WHERE doc_id % 5 <> 0 AND i <= doc_id % 4)),
images AS (
  SELECT page_id::VARCHAR AS work_id, url,
    CASE WHEN page_id % 6 <> 0 THEN sha256('picture ' || (page_id % 40)) END AS sha256,
    CASE WHEN page_id % 7 <> 0 THEN 'picture ' || (page_id % 40) END AS bytes,
    CASE WHEN page_id % 3 = 0 THEN 'failed' ELSE 'stored' END AS status,
    to_timestamp(1704067200 + page_id * 3600)::TIMESTAMP AS fetched_at
  FROM pages),
held AS (SELECT work_id, count(*) AS n FROM chapters GROUP BY 1),
vis AS (SELECT work_id, count(*) AS n, max(started_at) AS last FROM rvisits GROUP BY 1),
ro AS (
  SELECT w.*, r.chapter AS at_chapter, r."offset", r.chapters_read, r.completed_before,
    coalesce(r.marked_later, false) AS later, r.opened_at, r.read_at,
    coalesce(nullif(w.chapter_count, 0), h.n, 1) AS total,
    coalesce(v.n, 0) AS ff_visits, coalesce(w.visits, 0) + coalesce(v.n, 0) AS total_visits,
    v.last AS visit_last, h.n IS NULL AS bare,
    (r.opened_at IS NOT NULL OR coalesce(r."offset", 0) > 0 OR coalesce(r.chapters_read, 0) > 0
      OR coalesce(r.chapter, 0) > 1) AS started
  FROM works w LEFT JOIN reading r USING (work_id) LEFT JOIN held h USING (work_id)
  LEFT JOIN vis v USING (work_id)),
allrows AS (
  SELECT *, coalesce(chapters_read, 0) >= total AS finished,
    (coalesce(chapters_read, 0) >= total OR coalesce(completed_before, false)) AS completed,
    greatest(coalesce(opened_at, CASE WHEN started THEN read_at END), visit_last) AS local_read,
    greatest(coalesce(opened_at, CASE WHEN started THEN read_at END), visit_last, visited) AS last_read,
    (started OR coalesce(completed_before, false) OR in_history OR coalesce(visits, 0) > 0
      OR visited IS NOT NULL OR ff_visits > 0) AS was_visited,
    bare AND (contains(lower(coalesce(summary, '')), 'this is part of an ongoing challenge and will be revealed soon')
      OR (lower(trim(coalesce(title, ''))) = 'mystery work' AND coalesce(words, 0) = 0)
      OR (lower(trim(coalesce(title, ''))) IN ('', '(untitled)') AND trim(coalesce(summary, '')) = ''
          AND coalesce(words, 0) = 0
          AND (len(authors) = 0 OR (len(authors) = 1 AND lower(authors[1]) IN ('', 'anonymous'))))) AS placeholder
  FROM ro),
shown AS (SELECT * FROM allrows WHERE NOT hidden AND NOT placeholder)
"""


def sql(body: str, *more: str) -> str:
    """A statement over the base tables, with further common tables before it."""
    return "WITH " + ",\n".join([BASE.strip(), *[m.strip() for m in more]]) + "\n" + body.strip()
