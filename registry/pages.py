"""Queries that read markup: pages as given, and pages and books Spark writes from the tables."""

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from registry import query
from registry.base import sql
from storyloom.functions import markup, text as tx, urls, values
from storyloom.operators import profile
from storyloom.sources import books, pages
from storyloom.sources.star import library, spread, table

# --- listing pages written from the works -------------------------------------


def _blurbs(spark, root):
    lib = library(spark, root)
    fandoms = lib.tags.where("kind = 'fandom'").groupBy("work_id").agg(
        F.array_sort(F.collect_set("name")).alias("fandoms"))
    free = lib.tags.where("kind = 'freeform'").groupBy("work_id").agg(
        F.array_sort(F.collect_set("name")).alias("free"))
    rows = lib.works.join(fandoms, "work_id", "left").join(free, "work_id", "left")
    return rows.selectExpr("*", "CAST(work_id AS bigint) AS wk").selectExpr(
        "work_id", "wk",
        "if(wk % 2 = 0, concat('<li id=\"work_', wk, '\" class=\"work blurb group work-', wk, '\" role=\"article\">'),"
        " concat('<li id=\"bookmark_9', wk, '\" class=\"bookmark blurb group work-', wk, if(wk % 3 = 0, ' rec', ''),"
        " if(wk % 5 = 0, ' private', ''), '\" role=\"article\">')) AS opening",
        "concat(coalesce(concat('<!-- updated_at=', updated_at, ' -->'), ''), '<h4 class=\"heading\">\n<a href=\"/works/', wk, '\">',"
        " coalesce(concat(title, ' &amp; Co&#33;'), ''), '</a> by ', array_join(transform(authors, a ->"
        " concat('<a rel=\"author\" href=\"/users/x\">', a, '</a>')), ', '), '</h4>') AS heading",
        "concat('<h5 class=\"fandoms heading\">', array_join(transform(coalesce(fandoms, array()), f ->"
        " concat('<a class=\"tag\" href=\"/tags/x\">', f, '</a>')), ', '), '</h5>') AS fandom_part",
        "concat('<ul class=\"required-tags\"><li><span class=\"rating-x rating\" title=\"', rating, '\"><span class=\"text\">r</span></span></li>"
        "<li><span class=\"complete-', if(complete, 'yes', 'no'), ' iswip\" title=\"w\"></span></li></ul><p class=\"datetime\">',"
        " date_format(published, 'd MMM yyyy'), '</p>') AS symbols",
        "concat('<ul class=\"tags commas\">', array_join(transform(coalesce(free, array()), f ->"
        " concat('<li class=''freeforms''><a class=\"tag\" href=\"/tags/x\">', f, '</a></li>')), ' '), '</ul>') AS tag_part",
        "concat('<blockquote class=\"userstuff summary\"><p>', summary, '</p><blockquote>quoted</blockquote><p>end</p></blockquote>') AS summary_part",
        "concat('<dl class=\"stats\"><dd class=\"language\" lang=\"en\">', language, '</dd>', coalesce(concat('<dd class=\"words\">',"
        " format_number(words, 0), '</dd>'), ''), coalesce(concat('<dd class=\"chapters\"><a href=\"#\">', chapter_count, '</a>/',"
        " coalesce(CAST(chapters_planned AS string), '?'), '</dd>'), ''), coalesce(concat('<dd class=\"kudos\"><a href=\"#\">', kudos,"
        " '</a></dd>'), ''), coalesce(concat('<dd class=\"hits\">', hits, '</dd>'), ''), '</dl>') AS stats",
        "if(wk % 2 = 1, concat('<div class=\"own user module group\"><p class=\"datetime\">', date_format(date_add(published, 9), 'd MMM yyyy'),"
        " '</p><blockquote class=\"userstuff\"><p>Note ', wk % 13, '</p></blockquote><ul class=\"meta tags commas\"><li><a class=\"tag\">mine ',"
        " wk % 4, '</a></li></ul></div>'), concat('<h4 class=\"viewed heading\"><span>Last visited:</span> ', date_format(date_add(published, 20),"
        " 'dd MMM yyyy'), if(wk % 4 = 0, ' (Latest version.) ', ' (updated since) '), if(wk % 6 = 0, 'Visited once', concat('Visited ',"
        " format_number(wk % 6 * 1234, 0), ' times')), '</h4>')) AS tail")


def listing_table(spark, root):
    """Twenty entries to a page, with links to other pages after them."""
    li = F.concat("opening", "heading", "fandom_part", "symbols", "tag_part", "summary_part", "stats", "tail", F.lit("</li>\n"))
    page = F.floor(F.col("wk") / 20)
    grouped = _blurbs(spark, root).select(page.alias("page_id"), F.struct("wk", li.alias("li")).alias("e")).groupBy("page_id").agg(
        F.array_sort(F.collect_list("e")).alias("es"))
    nav = F.concat(
        F.lit('<ol class="pagination actions"><li class="current">'), (F.col("page_id") + 1).cast("string"),
        F.lit('</li><li><a href="/works?page='), (F.col("page_id") % 7 + 3).cast("string"), F.lit('">x</a></li></ol>'))
    return grouped.select("page_id", F.concat(
        F.lit('<ol class="work index group">\n'), F.array_join("es.li", ""), F.lit("</ol>"), nav).alias("html"))


@query("listing_pages", sql("""
SELECT work_id, title || ' & Co!' AS title, array_to_string(authors, '|') AS authors, len(authors) = 0 AS anonymous, updated_at,
  coalesce((SELECT string_agg(name, '|' ORDER BY name) FROM tags t WHERE t.work_id = works.work_id AND kind = 'fandom'), '') AS fandoms,
  coalesce((SELECT string_agg(name, '|' ORDER BY name) FROM tags t WHERE t.work_id = works.work_id AND kind = 'freeform'), '') AS freeform,
  rating, complete, CASE WHEN summary = '' THEN '' ELSE summary || chr(10) END || 'quoted' || chr(10) || 'end' AS summary, language,
  coalesce(words, 0) AS words, coalesce(chapter_count, 0) AS chapters, CASE WHEN chapter_count IS NOT NULL THEN chapters_planned END AS chapters_planned,
  coalesce(kudos, 0) AS kudos, coalesce(hits, 0) AS hits, 0::BIGINT AS bookmark_count FROM works"""))
def listing_pages(spark, root):
    j = lambda c: F.array_join(c, "|").alias(c)
    return pages.listings(listing_table(spark, root)).select(
        "work_id", "title", j("authors"), "anonymous", "updated_at", j("fandoms"), j("freeform"), "rating", "complete",
        "summary", "language", "words", "chapters", "chapters_planned", "kudos", "hits", "bookmark_count")


@query("bookmark_blurbs", sql("""
SELECT work_id, '9' || wk AS bookmark_id, strftime(published + 9, '%-d %b %Y') AS bookmarked_on, 'Note ' || wk % 13 AS bookmark_notes,
  'mine ' || wk % 4 AS bookmark_tags, wk % 5 = 0 AS bookmark_private, wk % 3 = 0 AS bookmark_rec FROM works WHERE wk % 2 = 1"""))
def bookmark_blurbs(spark, root):
    rows = pages.bookmark_fields(pages.entries(listing_table(spark, root)))
    return rows.where(F.col("bookmark_id").isNotNull()).select(
        F.regexp_extract("li", "work-(\\d+)", 1).alias("work_id"), "bookmark_id", "bookmarked_on", "bookmark_notes",
        F.array_join("bookmark_tags", "|").alias("bookmark_tags"), "bookmark_private", "bookmark_rec")


@query("history_blurbs", sql("""
SELECT work_id, (published + 20)::VARCHAR AS last_visited, CASE WHEN wk % 6 = 0 THEN 1 ELSE wk % 6 * 1234 END AS visits,
  wk % 4 <> 0 AS stale_since_visit FROM works WHERE wk % 2 = 0"""))
def history_blurbs(spark, root):
    rows = pages.history_fields(pages.entries(listing_table(spark, root)))
    return rows.where(F.col("last_visited").isNotNull()).select(
        F.regexp_extract("li", "work-(\\d+)", 1).alias("work_id"), "last_visited", F.col("visits").cast("bigint").alias("visits"),
        "stale_since_visit")


@query("listing_page_totals", sql("""
SELECT DISTINCT wk // 20 AS page_id, wk // 20 + 1 AS current, greatest(wk // 20 + 1, (wk // 20) % 7 + 3) AS total FROM works"""))
def listing_page_totals(spark, root):
    return pages.page_totals(listing_table(spark, root))


# --- work pages and books written from the documents --------------------------

_PARTS = """filter(transform(split(text, '\\n'), (l, i) -> struct(i + 1 AS n, replace(replace(replace(l, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS l)),
  x -> length(trim(x.l)) > 0)"""


def _written(spark, root):
    """Documents with a line that says something, told by a pattern as they are scanned: lines are cut once, after texts are spread."""
    return spread(table(spark, root, "documents").where(r"text RLIKE '[^ \\n]'"))


def work_page_table(spark, root):
    docs = _written(spark, root).selectExpr("*", f"{_PARTS} AS parts")
    chapter = """transform(parts, p -> concat('<div class="chapter" id="chapter-', p.n, '"><h3 class="title">Chapter ', p.n,
      ': &ldquo;x&rdquo;</h3><div class="notes module"><p>A note.</p></div><div class="userstuff module" role="article">',
      '<h3 class="landmark heading" id="work">Chapter Text</h3><p>', p.l,
      '</p><div class="chat"><div class="bubble">nested</div></div></div></div>'))"""
    body = f"""if(doc_id % 5 = 0, concat('<div class="userstuff"><p>', array_join(transform(parts, p -> p.l), '</p><p>'), '</p><div class="chat"><div class="bubble">nested</div></div></div>'),
      array_join({chapter}, ''))"""
    return docs.selectExpr("doc_id", f"""concat('<html><head><style>.chrome{{}}</style></head><body><li class="share hidden"><a href="/works/', doc_id, '/share">',
      '</a></li><dl class="work meta group"><dd class="rating tags"><ul><li><a class="tag" href="#">Rated ', source,
      '</a></li></ul></dd><dd class="fandom tags"><ul><li><a class="tag" href="#">Oh, ', lang, '</a></li><li><a class="tag" href="#">Two</a></li></ul></dd>',
      '<dd class="language">', lang, '</dd><dd class="stats"><dl class="stats"><dd class="published">2020-01-02</dd><dd class="words">',
      format_number(n_chars, 0), '</dd><dd class="chapters">', size(parts), '/', if(doc_id % 3 = 0, '?', CAST(size(parts) AS string)), '</dd></dl></dd></dl>',
      if(doc_id % 4 = 0, concat('<div id="work-skin"><style>.s', doc_id % 9, '{{}}</style><!-- BEGIN section where work skin applies --></div>'), ''),
      '<div id="workskin"><h2 class="title heading"> Doc ', doc_id, ' </h2><h3 class="byline heading"><a rel="author" href="#">',
      source, '</a></h3><div class="summary module"><blockquote class="userstuff"><p>About ', lang, '</p></blockquote></div>',
      '<div id="chapters">', {body}, '</div></div><form><input name="authenticity_token" value="z"></form></body></html>') AS html""")


_LINES = """
ln AS (
  SELECT doc_id, n, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rn, count(*) OVER (PARTITION BY doc_id) AS total FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
  WHERE length(trim(line)) > 0)"""
_SAID = "ltrim(regexp_replace(line, '[ \\t\\x{00a0}]+', ' ', 'g'))"


@query("work_pages", sql("""
SELECT d.doc_id::VARCHAR AS work_id, 'Doc ' || d.doc_id AS title, d.source AS authors, 'About ' || lang AS summary,
  CASE WHEN d.doc_id % 4 = 0 THEN '.s' || d.doc_id % 9 || '{}' END AS skin_css, 'Rated ' || d.source AS rating, 'Oh, ' || lang || '|Two' AS fandoms,
  lang AS language, '2020-01-02' AS updated, d.doc_id % 3 <> 0 AS complete, n_chars AS words, t.total AS chapter_count,
  CASE WHEN d.doc_id % 3 <> 0 THEN t.total END AS chapters_planned, CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE t.total END AS parsed
FROM documents d JOIN (SELECT DISTINCT doc_id, total FROM ln) t USING (doc_id)""", _LINES))
def work_pages(spark, root):
    return pages.work_pages(work_page_table(spark, root)).select(
        "work_id", "title", F.array_join("authors", "|").alias("authors"), "summary", "skin_css", "rating",
        F.array_join("fandoms", "|").alias("fandoms"), "language", "updated", "complete", "words", "chapter_count",
        "chapters_planned", F.size("chapters").alias("parsed"))


@query("work_page_chapters", sql(f"""
SELECT doc_id::VARCHAR AS work_id, n AS number, 'Chapter ' || n || ': “x”' AS title, {_SAID} || chr(10) || chr(10) || 'nested' AS text,
  len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}''’-]+')) + 1 AS words FROM ln WHERE doc_id % 5 <> 0
UNION ALL
SELECT doc_id::VARCHAR, 1, NULL, ltrim(string_agg(regexp_replace(line, '[ \\t\\x{{00a0}}]+', ' ', 'g'), chr(10) ORDER BY n)) || chr(10) || chr(10) || 'nested',
  sum(len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}''’-]+')))::BIGINT + 1 FROM ln WHERE doc_id % 5 = 0 GROUP BY 1""", _LINES))
def work_page_chapters(spark, root):
    return pages.to_chapters(pages.work_pages(work_page_table(spark, root))).select("work_id", "number", "title", "text", "words")


@query("work_page_tags", sql("""
SELECT doc_id::VARCHAR AS work_id, 'fandom' AS kind, unnest(['Oh, ' || lang, 'Two']) AS name FROM documents WHERE doc_id IN (SELECT doc_id FROM ln)""", _LINES))
def work_page_tags(spark, root):
    return pages.to_tags(pages.work_pages(work_page_table(spark, root)))


def _bind(batches):
    """Documents bound as books: a title page, a file a chapter, end notes."""
    for batch in (some for whole in batches for some in books.in_steps(whole)):
        files, docs = [], batch.column("doc_id").to_pylist()
        for doc, parts in zip(docs, batch.column("parts").to_pylist()):
            out, names = io.BytesIO(), [f"c{i}.xhtml" for i in range(len(parts))]
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
                book.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
                spine = ["front.xhtml", *names, "after.xhtml"]
                items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(spine))
                refs = "".join(f'<itemref idref="i{i}"/>' for i in range(len(spine)))
                book.writestr("OEBPS/content.opf", (
                    f"<package><metadata><dc:title>Book {doc} &amp; more</dc:title><dc:creator>Pen {doc % 7}</dc:creator>"
                    f'<dc:language>en</dc:language><meta name="calibre:timestamp" content="2024-03-05T10:00:00"/></metadata>'
                    f"<manifest>{items}</manifest><spine>{refs}</spine></package>"))
                book.writestr("OEBPS/front.xhtml", (
                    f'<html><body><div id="preface" ><p id="chapters">Posted originally on the <a href="x">Archive</a> at '
                    f'<a href="http://archiveofourown.org/works/{doc}">x</a></p><dl><dt>Rating:</dt><dd><a>Teen</a></dd>'
                    f"<dt>Fandoms:</dt><dd><a>One, two</a>, <a>Three</a></dd><dt>Stats:</dt><dd>Published: 2020-04-16 Words: 1,234 "
                    f"Chapters: {len(parts)}/{len(parts) if doc % 2 else '?'}</dd></dl></div></body></html>"))
                for name, part in zip(names, parts):
                    book.writestr(f"OEBPS/{name}", f'<html><head><title>t</title></head><body><div id="chapters"><p>{part["l"]}</p></div></body></html>')
                book.writestr("OEBPS/after.xhtml", '<html><body><div id="afterword"><p>Thanks.</p></div></body></html>')
            files.append(out.getvalue())
        yield pa.RecordBatch.from_pydict({"path": [f"{d}.epub" for d in docs], "content": files}, schema=pa.schema(
            [("path", pa.string()), ("content", pa.binary())]))


def book_table(spark, root):
    docs = _written(spark, root).selectExpr("doc_id", f"{_PARTS} AS parts")
    return docs.mapInArrow(_bind, "path string, content binary")


@query("epub_files", sql("""
SELECT doc_id::VARCHAR AS work_id, 'Book ' || doc_id || ' & more' AS title, 'Pen ' || doc_id % 7 AS authors, 'Teen' AS rating,
  'One, two|Three' AS fandoms, '2024-03-05' AS downloaded_at, '2020-04-16' AS published, doc_id % 2 = 1 AS complete,
  CASE WHEN doc_id % 2 = 1 THEN any_value(total) END AS chapters_planned, any_value(total) AS chapters, true AS has_notes FROM ln GROUP BY doc_id""", _LINES))
def epub_files(spark, root):
    return books.books(book_table(spark, root)).select(
        "work_id", "title", F.array_join("authors", "|").alias("authors"), "rating", F.array_join("fandoms", "|").alias("fandoms"),
        "downloaded_at", "published", "complete", "chapters_planned", F.size("chapters").alias("chapters"),
        F.col("end_notes_html").contains("Thanks.").alias("has_notes"))


@query("epub_chapters", sql(f"""
SELECT doc_id::VARCHAR AS work_id, rn::INT AS number, rtrim({_SAID}) AS text FROM ln""", _LINES))
def epub_chapters(spark, root):
    return books.books(book_table(spark, root)).select("work_id", F.inline("chapters")).select("work_id", "number", "text")


# --- text and markup of the pages as given ------------------------------------

def _bare(x):
    for pattern, new in (
        ("<script\\b[^>]*>.*?(</script\\s*>|$)", ""), ("<style\\b[^>]*>.*?(</style\\s*>|$)", ""),
        ("</(p|div|h[1-6]|li|blockquote|tr)>", "\n"), ("\n?<(p|div|h[1-6]|li|blockquote|tr)\\b[^>]*>", "\n"),
        ("<br\\s*/?>", "\n"), ("<[^>]*>", "")):
        new = "chr(10)" if new else "''"
        x = f"regexp_replace({x}, '{pattern}', {new}, 'gis')"
    return x


def _unescaped(x):
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("mdash", "—"), ("#39", "'"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


_TEXT = ("trim(regexp_replace(regexp_replace(" + _unescaped(_bare(_bare("html")))
         + ", '[ \\t\\x{00a0}]+', ' ', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))")


@query("html_to_text", sql(f"SELECT page_id, {_TEXT} AS text FROM pages"))
def html_to_text(spark, root):
    return spread(table(spark, root, "pages")).select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("count_words", sql("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}''’-]+')) AS words FROM documents"))
def count_words(spark, root):
    return table(spark, root, "documents").select("doc_id", tx.count_words(F.col("text")).alias("words"))


@query("strip_landmarks", sql("""
SELECT page_id, html || '<p>kept</p><div class="landmark">open' AS html FROM pages"""))
def strip_landmarks(spark, root):
    """Landmarks with elements of their own and of their own name inside, and one that never closes."""
    signed = F.concat(F.lit('<h3 class="landmark heading" id="a">Chapter <em>Text</em></h3>'), "html",
                      F.lit('<p>kept</p><span class="a landmark">x<span>y <b class="landmark">z</b></span> w</span><div class="landmark">open'))
    return spread(table(spark, root, "pages")).select("page_id", tx.strip_landmarks(signed).alias("html"))


@query("house_classes", sql("""
SELECT page_id, '<p class="userstuff chat">a</p><div>b</div><i class="mine">' || url || '</i>' AS html FROM pages"""))
def house_classes(spark, root):
    markup = F.concat(F.lit('<p class="calibre7 userstuff2 chat userstuff">a</p><div class="calibre1">b</div><i class="mine">'), "url", F.lit("</i>"))
    return spread(table(spark, root, "pages")).select("page_id", tx.house_classes(markup).alias("html"))


@query("needs_skin", sql("""
SELECT page_id::VARCHAR AS work_id, regexp_matches(html, '\\sstyle\\s*=', 'i') OR len(list_filter(flatten(list_transform(
  regexp_extract_all(html, 'class="([^"]+)"', 1, 'i'), lambda c: string_split_regex(c, '\\s+'))), lambda c: c <> '' AND NOT regexp_full_match(c,
  'calibre\\d*|userstuff\\d*|message|byline|toc-heading|heading|endnote-link|tags|meta|preface|afterword|chapter|title|summary|notes|jump|landmark|p|li|bold|italics|small|indent'))) > 0 AS needs_skin
FROM pages"""))
def needs_skin(spark, root):
    return profile.needs_skin(table(spark, root, "pages").select(F.col("page_id").cast("string").alias("work_id"), "html"))


def _address(value):
    bare = f"replace(regexp_replace({value}, '[\\x00-\\x20\\x7f]', '', 'g'), '&amp;', '&')"
    fine = f"(regexp_matches({bare}, '^(https?:|mailto:)', 'i') OR regexp_matches({bare}, '^[^:]*([/?#]|$)'))"
    return f"CASE WHEN {fine} AND NOT regexp_matches({bare}, '&#|&[A-Za-z]+;') THEN {bare} END"


def _kept(given, name, address):
    value = "coalesce(" + ", ".join(
        f"nullif(regexp_extract({given}, '\\s{name}\\s*=\\s*{q}([^{q}]*){q}', 1, 'is'), '')" for q in ('"', "''")) + ")"
    value = _address(value) if address else value
    return f"""coalesce(' {name}="' || replace(replace(replace({value}, '&', '&amp;'), '"', '&quot;'), '<', '&lt;') || '"', '')"""


_TAG = "'^(/?)([a-z][a-z0-9]*)(\\s[^>]*)?/?>'"
_PIECE = f"""CASE WHEN lower(regexp_extract(p, {_TAG}, 2, 'is')) IN ({', '.join(f"'{k}'" for k in markup.KEPT)})
  THEN '<' || regexp_extract(p, {_TAG}, 1, 'is') || lower(regexp_extract(p, {_TAG}, 2, 'is')) ||
    CASE WHEN regexp_extract(p, {_TAG}, 1, 'is') <> '' THEN ''
      WHEN lower(regexp_extract(p, {_TAG}, 2, 'is')) = 'a' THEN {_kept(f"regexp_extract(p, {_TAG}, 3, 'is')", 'href', True)}
      WHEN lower(regexp_extract(p, {_TAG}, 2, 'is')) = 'img'
      THEN {_kept(f"regexp_extract(p, {_TAG}, 3, 'is')", 'src', True)} || {_kept(f"regexp_extract(p, {_TAG}, 3, 'is')", 'alt', False)} ELSE '' END
    || '>' || regexp_replace(p, {_TAG}, '', 'is')
  WHEN regexp_matches(p, '^[/!?a-zA-Z][^>]*>', 's') THEN regexp_replace(p, '^[^>]*>', '', 's') ELSE '&lt;' || p END"""


def _reduced(html):
    out = f"regexp_replace({html}, '<!--.*?(-->|\\z)', '', 'gs')"
    for name in markup.UNREAD:
        out = f"regexp_replace({out}, '<{name}\\b[^>]*>.*?(</{name}\\s*>|\\z)', '', 'gis')"
    return f"(SELECT ps[1] || array_to_string(list_transform(ps[2:], lambda p: {_PIECE}), '') FROM (SELECT string_split({out}, '<') AS ps))"


@query("clean_html", f"SELECT page_id, {_reduced('html')} AS html FROM pages")
def clean_html(spark, root):
    return spread(table(spark, root, "pages")).select("page_id", markup.clean_html(F.col("html")).alias("html"))


_RISKY = """<p onclick="x()" style="position:fixed">Prose &amp; more</p><a href="java&#9;script:x">l</a><a HREF=" JaVaScRiPt:x">k</a>\
<a href='https://e.org/?a=1&amp;b=2' target="_top">m</a><scr<script>ipt>alert(1)</script><img src="a.png" alt="A < B" onerror="y()">1 < 2<!-- gone -->"""


@query("clean_html_safe", "SELECT page_id, " + _reduced("'" + _RISKY.replace("'", "''") + "' || html") + " AS html FROM pages")
def clean_html_safe(spark, root):
    """Nothing that acts is left in, and the prose is."""
    return table(spark, root, "pages").select("page_id", markup.clean_html(F.concat(F.lit(_RISKY), "html")).alias("html"))


_FEATURES = (("img", "<img\\b"), ("table", "<table\\b"), ("blockquote", "<blockquote\\b"), ("inline style=", "\\sstyle\\s*="),
             ("<style> block", "<style\\b"), ("centred/aligned", "align\\s*=|text-align"), ("external link", '<a\\b[^>]*href="https?://'),
             ("heading in body", "<h[1-6]\\b"), ("pre/code", "<(pre|code)\\b"))


@query("markup_survey", sql(" UNION ALL ".join(
    f"""SELECT '{n}' AS feature, count(*) FILTER (c > 0) AS works, coalesce(sum(c), 0)::BIGINT AS total
    FROM (SELECT len(regexp_extract_all(html, '(?i){p}')) AS c FROM pages)""" for n, p in _FEATURES)))
def markup_survey(spark, root):
    return profile.markup(table(spark, root, "pages"), "html")


@query("image_hosts", sql("""
SELECT host, count(*) AS n FROM (
  SELECT regexp_extract(url, '^https?://(www\\.)?([^/:?#]+)', 2) AS host FROM pages
  UNION ALL SELECT 'pics' || page_id % 9 || '.example.net' FROM pages UNION ALL SELECT 'pics' || page_id % 9 || '.example.net' FROM pages
  UNION ALL SELECT '(packaged in epub)' FROM pages WHERE page_id % 4 = 0
  UNION ALL SELECT '(inline data: uri)' FROM pages WHERE page_id % 4 = 1) GROUP BY 1"""))
def image_hosts(spark, root):
    from registry.planning import pictured
    return profile.image_hosts(pictured(spark, root), "html")


@query("class_vocabulary", sql("""
SELECT class, count(*) AS n FROM (SELECT unnest(string_split_regex(c, '\\s+')) AS class FROM (
  SELECT unnest(regexp_extract_all(html, 'class="([^"]+)"', 1, 'i')) AS c FROM pages)) WHERE class <> '' AND class NOT LIKE 'calibre%' GROUP BY 1"""))
def class_vocabulary(spark, root):
    return profile.class_vocabulary(table(spark, root, "pages"), "html")


@query("field_coverage", sql("""
SELECT '(rows)' AS field, count(*) AS n FROM works UNION ALL SELECT '(no key)', 0 UNION ALL SELECT '(repeats)', count(*) - count(DISTINCT title) FROM works WHERE title IS NOT NULL
UNION ALL SELECT '(no title)', count(*) FROM works WHERE title IS NULL
UNION ALL SELECT 'authors', count(*) FROM works WHERE len(authors) > 0 UNION ALL SELECT 'words', count(words) FROM works
UNION ALL SELECT 'skin_css', count(skin_css) FROM works UNION ALL SELECT 'chapter_count', count(chapter_count) FROM works"""))
def field_coverage(spark, root):
    works = library(spark, root).works.select("work_id", "title", "authors", "words", "skin_css", "chapter_count")
    by_id = profile.coverage(works.select("work_id", "authors", "words", "skin_css", "chapter_count"), "work_id").where(
        "field NOT IN ('work_id', '(repeats)')")
    by_title = profile.coverage(works.select("title"), "title").where("field IN ('(repeats)', '(no key)')").withColumn(
        "field", F.when(F.col("field") == "(no key)", "(no title)").otherwise(F.col("field")))
    return by_id.unionByName(by_title)


# --- links, names and small values --------------------------------------------

def _links(spark, root):
    return table(spark, root, "orders").selectExpr("o_orderkey AS k", """CASE o_orderkey % 9
      WHEN 0 THEN CAST(o_orderkey AS string) WHEN 1 THEN concat('https://archiveofourown.org/works/', o_orderkey, '/chapters/5?view=1')
      WHEN 2 THEN concat('ao3.org/chapters/', o_orderkey) WHEN 3 THEN concat('https://archiveofourown.org/series/', o_orderkey, '#x')
      WHEN 4 THEN concat('http://www.archiveofourown.com/external_works/', o_orderkey) WHEN 5 THEN concat(' https://example.com/works/', o_orderkey, ' ')
      WHEN 6 THEN concat('https://download.archiveofourown.org/downloads/', o_orderkey, '/a.epub') WHEN 7 THEN 'https://archiveofourown.org/tags/x/works'
      ELSE 'not a link' END AS link""")


@query("url_classify", sql("""
SELECT o_orderkey AS k, ['work', 'work', 'chapter', 'series', 'external', 'work', 'work', 'unknown', 'unknown'][o_orderkey % 9 + 1] AS kind,
  CASE WHEN o_orderkey % 9 < 7 THEN o_orderkey::VARCHAR END AS id, o_orderkey % 9 NOT IN (5, 8) AS known_host FROM orders"""))
def url_classify(spark, root):
    return _links(spark, root).select("k", *[c.alias(n) for n, c in urls.classify(F.col("link")).items()])


@query("byline_split", sql("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Pen ' || c_custkey END AS pseud,
  CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name ELSE 'orphan_account' END AS user, c_custkey % 3 = 2 AS orphan FROM customer"""))
def byline_split(spark, root):
    line = F.expr("""CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN concat('Pen ', c_custkey, ' (', c_name, ')')
      ELSE concat('Pen ', c_custkey, '  (orphan_account)') END""")
    return table(spark, root, "customer").select("c_custkey", *[c.alias(n) for n, c in urls.byline(line).items()])


@query("authors_array", sql("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '|x' WHEN 3 THEN c_name || ' "q"' ELSE '' END AS names FROM customer"""))
def authors_array(spark, root):
    raw = F.expr("""CASE c_custkey % 4 WHEN 0 THEN to_json(array(c_name, 'x')) WHEN 1 THEN c_name WHEN 2 THEN '{"not": "a list"}'
      ELSE to_json(array(concat(c_name, ' "q"'))) END""")
    return table(spark, root, "customer").select("c_custkey", F.array_join(values.authors_of(raw), "|").alias("names"))


@query("blurb_date", sql("SELECT work_id, CASE WHEN wk % 3 = 0 THEN to_timestamp(updated_at)::DATE ELSE published END::VARCHAR AS changed_on FROM works"))
def blurb_date(spark, root):
    wk = F.col("work_id").cast("bigint")
    shown = F.when(wk % 3 == 1, F.date_format("published", "d MMM yyyy")).when(wk % 3 == 2, F.date_format("published", "dd MMMM yyyy"))
    return library(spark, root).works.select("work_id", values.blurb_date(
        F.when(wk % 3 == 0, F.col("updated_at")), shown).cast("string").alias("changed_on"))


@query("stats_line", sql("""
SELECT work_id, published::VARCHAR AS published, CASE WHEN complete THEN updated::VARCHAR END AS completed, words,
  chapter_count AS chapters, chapters_planned, complete AND updated IS NOT NULL OR coalesce(chapter_count = chapters_planned, false) AS complete
FROM works WHERE chapter_count IS NOT NULL"""))
def stats_line(spark, root):
    line = F.expr("""concat('Published: ', published, coalesce(if(complete, concat(' Completed: ', updated), ''), ''), ' Words: ', format_number(words, 0),
      ' Chapters: ', chapter_count, '/', coalesce(CAST(chapters_planned AS string), '?'))""")
    read = values.stats_line(line)
    return library(spark, root).works.where("chapter_count IS NOT NULL").select(
        "work_id", *[read[n].alias(n) for n in ("published", "completed", "words", "chapters", "chapters_planned", "complete")])


@query("seed_hash", sql("""
SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)),
  lambda h, c: (h * 31 + c) % 4294967296) AS hash,
  (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_brand, ''), lambda c: ascii(c)::BIGINT)),
  lambda h, c: (h * 31 + c) % 4294967296) % 360)::INT AS hue FROM part"""))
def seed_hash(spark, root):
    return table(spark, root, "part").select("p_partkey", tx.seed_hash(F.col("p_name")).alias("hash"), tx.spine_hue(F.col("p_brand")).alias("hue"))


@query("language_name", sql("""
SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'Français' WHEN 'de' THEN 'Deutsch' WHEN 'es' THEN 'Español' ELSE lang END AS language FROM documents"""))
def language_name(spark, root):
    return table(spark, root, "documents").select("doc_id", tx.language_name(F.concat(F.upper("lang"), F.lit("-XX"))).alias("language"))
