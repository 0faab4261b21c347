"""Reading markup: text, links, listings, work pages, books and journals."""

import io
import zipfile

import pytest

from pyspark.sql import functions as F
from storyloom.functions import markup, text as tx, urls
from storyloom.operators import ledger
from storyloom.sources import books, pages


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(1)
        return [r[1] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]
    return run


def test_html_to_text(apply):
    cases = {
        "end.</p><p>Next": "end.\nNext", "<p>one<p>two": "one\ntwo", "a<br>b<BR/>c": "a\nb\nc",
        "a &amp; b &#39;c&#x27; &mdash; &bogus; &": "a & b 'c' — &bogus; &",
        "<style>p{}</style>text<script>var t='</p>'": "text", "  a \t  b  ": "a b", "plain": "plain", None: "", "<p>a</p>\n\n\n<p>b</p>": "a\n\nb",
        "&lt;b&gt;": "<b>",
    }
    assert apply(tx.html_to_text, *cases) == list(cases.values())
    nested = apply(tx.html_to_text, "<scr<script>ipt>alert(1)</scr</script>ipt>ok", "<<<b>i>u>deep")
    assert all("<" not in t for t in nested)


def test_small_text_functions(apply):
    assert apply(tx.count_words, "It’s a well-made day, 2 of 3", "", None) == [7, 0, 0]
    assert apply(tx.strip_landmarks, '<h3 class="landmark heading">Chapter Text</h3><p>a</p>', "<p>b</p>") == ["<p>a</p>", "<p>b</p>"]
    assert apply(tx.strip_landmarks, '<h3 class="landmark heading">Chapter <em>Text</em> more</h3>', 'a<DIV id="1" class="x landmark"><div>b</div>c</DIV>d',
                 '<p class="landmark">a', 'x<p class="seamark">y</p>', '<i class="landmark"><i class="landmark">a</i>b</i>c<b class="landmark">d</b>', None) == [
        "", "ad", '<p class="landmark">a', 'x<p class="seamark">y</p>', "c", ""]
    assert apply(tx.image_urls, '<img src="https://a/x?1&amp;2"><IMG alt="" src="https://a/x?1&amp;2"><img src="b.png">') == [["https://a/x?1&2"]]
    assert apply(tx.house_classes, '<p class="calibre1 userstuff2 mine">a</p><b class="calibre9">') == ['<p class="userstuff mine">a</p><b>']
    assert apply(tx.needs_skin, '<p class="calibre12 userstuff">', '<p class="chat">', '<p style="x">', "<p>") == [False, True, True, False]
    assert apply(tx.language_name, "en", "EN-gb", "xx", None, "") == ["English", "English", "xx", None, None]
    assert apply(tx.seed_hash, "", "a", "ab", "zzzzzzzzzzzz") == [0, 97, 97 * 31 + 98, _fold("zzzzzzzzzzzz")]


def _fold(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) % (1 << 32)
    return h


SITE = "https://archiveofourown.org"
# link, kind, number, on a host of the archive
LINKS = [
    ("4711", "work", "4711", True), (f"{SITE}/works/4711", "work", "4711", True), (f"{SITE}/works/4711?view_adult=1", "work", "4711", True),
    (f"{SITE}/works/4711/chapters/88", "work", "4711", True), ("http://ao3.org/works/9#main", "work", "9", True),
    ("https://download.archiveofourown.org/downloads/31/Tale.epub", "work", "31", True), (f"{SITE}/collections/winter/works/12", "work", "12", True),
    (f"{SITE}/chapters/88", "chapter", "88", True), (f"{SITE}/series/5", "series", "5", True), (f"{SITE}/external_works/6", "external", "6", True),
    (f"{SITE}/tags/Rain", "unknown", None, True), (f"{SITE}/works/new", "unknown", None, True), ("www.ao3.org/works/3", "work", "3", True),
    ("https://mirror.example.net/works/3", "work", "3", False), ("https://ao3.org.mirror.example/works/3", "work", "3", False),
    ("rain on the roof", "unknown", None, False), ("", "unknown", None, False),
]


def test_links(spark):
    df = spark.createDataFrame([(row[0],) for row in LINKS], "link string").repartition(1)
    got = df.select("link", *[c.alias(n) for n, c in urls.classify(F.col("link")).items()]).collect()
    assert [tuple(r) for r in got] == LINKS


def test_bylines(apply):
    assert apply(urls.author_path, "beebalm", "Anna (pineconepickers)", "someone (with) (two)", "a/b", "Ünicode (ünicode)") == [
        "/users/beebalm/pseuds/beebalm", "/users/pineconepickers/pseuds/Anna", "/users/two/pseuds/someone%20%28with%29",
        "/users/a%2Fb/pseuds/a%2Fb", "/users/%C3%BCnicode/pseuds/%C3%9Cnicode"]
    assert apply(lambda c: urls.byline(c)["orphan"], "x (orphan_account)", "orphan_account", "x") == [True, True, False]


def _item(kind, number, work, body, classes=""):
    return f'<li id="{kind}_{number}" class="{kind} blurb group work-{work}{classes}">{body}</li>'


LISTING = (
    '<p>before</p><ol class="index">' + _item("work", 301, 301, """
      <h4 class="heading"><a href="/works/301">Rain &amp; roofs</a> <a rel="author" href="/u">Mira</a> <a rel="author" href="/u">Tom, 2nd</a></h4>
      <!-- updated_at=86400 --><h5 class="fandoms heading"><a class="tag" href="#">Weather, the series</a></h5>
      <span class="rating-general rating" title="General"></span><span class="category-none category" title="Gen"></span>
      <p class="datetime">02 Jan 1970</p><ul class="tags commas"><li class='characters'><a class="tag" href="#">A cat</a></li></ul>
      <blockquote class="userstuff summary">One.<blockquote>Two.</blockquote>Three.</blockquote>
      <dl><dd class="language">Cymraeg</dd><dd class="words">1,002,003</dd><dd class="chapters">7/9</dd><dd class="hits">12</dd></dl>""")
    + _item("bookmark", 8, 302, """
      <h4 class="heading"><a href="/works/302">Fog</a></h4><span class="complete-no iswip"></span><dl><dd class="chapters">3/?</dd></dl>
      <div class="own user module group"><p class="datetime">11 Mar 2021</p><blockquote class="userstuff"><p>again!</p></blockquote>
      <ul class="meta tags commas"><li><a class="tag" href="#">wet</a></li></ul><ul class="actions"></ul></div>
      <h4 class="viewed heading">Last visited: 09 Nov 2022 Visited once (A work updated since)</h4>""", " private")
    + _item("work", 303, "x", "<p>hidden from view</p>").replace('id="work_303"', 'id="work_"')
    + '</ol><ol class="pagination"><li class="current">4</li><li><a href="?page=6">6</a></li><li><a href="?page=5">5</a></li></ol>')


def test_listing(spark):
    df = spark.createDataFrame([(1, LISTING), (2, "<p>nothing</p>"), (3, None)], "page_id long, html string")
    rows = pages.history_fields(pages.bookmark_fields(pages.listings(df))).orderBy("position").collect()
    assert [r.work_id for r in rows] == ["301", "302"]
    rain, fog = rows
    assert (rain.title, rain.authors, rain.updated_at, rain.datetime) == ("Rain & roofs", ["Mira", "Tom, 2nd"], 86400, "02 Jan 1970")
    assert (rain.fandoms, rain.rating, rain.categories, rain.characters) == (["Weather, the series"], "General", ["Gen"], ["A cat"])
    assert (rain.summary, rain.language, rain.words, rain.hits) == ("One.\nTwo.\nThree.", "Cymraeg", 1002003, 12)
    assert (rain.chapters, rain.chapters_planned, rain.complete, rain.bookmark_id, rain.visits) == (7, 9, True, None, None)
    assert (fog.anonymous, fog.complete, fog.chapters, fog.chapters_planned) == (True, False, 3, None)
    assert (fog.bookmark_id, fog.bookmarked_on, fog.bookmark_notes, fog.bookmark_tags) == ("8", "11 Mar 2021", "again!", ["wet"])
    assert (fog.bookmark_private, fog.bookmark_rec, fog.last_visited, fog.visits, fog.stale_since_visit) == (True, False, "2022-11-09", 1, True)
    assert {(r.page_id, r.current, r.total) for r in pages.page_totals(df).collect()} == {(1, 4, 6), (2, 1, 1), (3, 1, 1)}


def test_work_page(spark):
    deep = '<div class="box">' * 3 + "inside" + "</div>" * 3
    part = lambda n, title, prose: (
        f'<div class="chapter" id="chapter-{n}">{title}<div class="notes module">note</div><div class="userstuff module">'
        f'<h3 class="heading landmark">Text</h3>{prose}</div><div class="after">after</div></div>')
    long_ = "<div id='workskin'></div>" + "x" * 30000
    made = [
        ("5", '<div id="workskin"><h2 class="title heading">Tides</h2><div id="chapters">' + part(1, '<h3 class="title">Ebb</h3>', f"{deep}<p>end</p>")
         + part(2, "", "<p>flow</p>") + "</div></div><div>footer</div>"),
        ("6", '<div id="workskin"><div id="chapters"><div class="userstuff"><p>whole</p><div>kept</div></div><p>not</p></div></div>'),
        ("7", f'<div id="work-skin"><div><style>.a{{}}</style></div>{"y" * 25000}<style> .b{{}} </style></div><style>.c{{}}</style>{long_}'), ("8", None)]
    parsed = pages.work_pages(spark.createDataFrame(made, "id string, html string"), work_id="id")
    got = {(r.work_id, r.number): (r.title, r.text, r.words) for r in pages.to_chapters(parsed).collect()}
    assert got == {("5", 1): ("Ebb", "inside\n\nend", 2), ("5", 2): (None, "flow", 1), ("6", 1): (None, "whole\nkept", 2)}
    works = {r.work_id: r for r in pages.to_works(parsed, "ao3").collect()}
    assert works["5"].title == "Tides" and works["7"].skin_css == ".a{}\n.b{}" and works["6"].skin_css is None


def _book(*docs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<rootfile full-path="O/c.opf"/>')
        items = "".join(f'<item id="d{i}" href="d{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(docs)))
        z.writestr("O/c.opf", f"<package><metadata><dc:title>B</dc:title></metadata>{items}" + "".join(f'<itemref idref="d{i}"/>' for i in range(len(docs))) + "</package>")
        for i, d in enumerate(docs):
            z.writestr(f"O/d{i}.xhtml", f"<html><head><title>no</title></head><body>{d}</body></html>")
    return out.getvalue()


def test_books_are_opened_a_few_at_a_time(monkeypatch):
    import pyarrow as pa
    one = _book('<div id="preface">p</div>', "<p>only</p>")
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(300)], "content": [one] * 299 + [b"no book"]})
    monkeypatch.setattr(books, "STEP", 64)
    got = list(books._open_all([batch]))
    assert max(b.num_rows for b in got) <= 64 and [p for b in got for p in b.column("path").to_pylist()] == [str(i) for i in range(300)]
    assert [len(d) for b in got for d in b.column("docs").to_pylist()] == [2] * 299 + [0]
    monkeypatch.setattr(books, "STEP_BYTES", 2 * len(one))
    assert max(b.num_rows for b in books._open_all([batch])) <= 2


def test_books(spark):
    front = '<div id="preface">Posted originally on the <a>Archive</a> at http://archiveofourown.org/works/77</div><div id="chapters"></div>'
    made = [("a.epub", _book(front, '<div id="chapters"><h2>One</h2><p>first</p></div>', '<div id="chapters"><p>last</p></div><div id="afterword">x</div>', '<div id="afterword">notes</div>')),
            ("b.epub", _book('<div id="preface">p</div>', "<p>only</p>")), ("c.epub", b"not a zip")]
    got = {r.path: r for r in books.books(spark.createDataFrame(made, "path string, content binary")).collect()}
    a = got["a.epub"]
    assert a.work_id == "77" and [(c.number, c.title, c.text) for c in a.chapters] == [
        (1, "One", "One\nfirst"), (2, None, "last\n\nx")]
    assert "notes" in a.end_notes_html
    assert got["b.epub"].work_id is None and [c.text for c in got["b.epub"].chapters] == ["only"]
    assert got["c.epub"].problem and got["c.epub"].chapters == []


def test_clean_html(apply):
    cases = {
        "<P class=x onclick=y>a<B>c": "<p>a<b>c", "<script>1 < 2</script>ok<style>x": "ok", "<video src=v>film</video>": "film",
        "<a href=\"jav&#x61;script:1\">l</a><a href='/in?a=1&amp;b'>m</a>": '<a>l</a><a href="/in?a=1&amp;b">m</a>',
        "<a href=\" java\tscript:1\">l</a>": "<a>l</a>", "<a href='mailto:a@b'>": '<a href="mailto:a@b">', "1 < 2 <3": "1 &lt; 2 &lt;3",
        "<!-- no -->&lt;b&gt;<!-- open": "&lt;b&gt;", '<img src="p.png" alt="A" style="x">': '<img src="p.png" alt="A">', None: "",
    }
    assert apply(markup.clean_html, *cases) == list(cases.values())


def test_entities_of_any_length(apply):
    assert apply(tx.decode_entities, "&#x00000000000000000041;", "&#" + "0" * 40 + "66;", "&#99999999999999999999;", "&#0;") == [
        "A", "B", "&#99999999999999999999;", "&#0;"]


def test_failures(apply):
    texts = {"the archive answered 429": True, "the archive answered 403": False, "the archive answered 500": True, "retry after a while": True,
             "this work was deleted": False, "that work does not exist": False, "no chapters found": False, "the request timed out": True,
             "java.net.UnknownHostException": True, "Connection refused": True, "unexpected end of stream": True, "": False}
    assert apply(ledger.is_transient, *texts) == list(texts.values())
    assert apply(ledger.failure_class, "answered 525", "answered 404", "sign in first", "answered 503", "odd") == [
        "AO3 secure connection failed (525)", "Unavailable on the archive", "May need archive sign-in", "Archive temporarily unavailable", "Could not download"]


def test_a_cut_journal_line_is_ignored(spark, tmp_path):
    line = '{"schema":1,"timeMs":5,"elapsedMs":5,"session":"s","event":"request_start","data":{"request":1}}'
    (tmp_path / "j.jsonl").write_text(line + "\n" + line[:40])
    assert ledger.read_journal(spark, str(tmp_path)).count() == 1
    lines = spark.createDataFrame([(line,), (line[:40],)], "line string")
    pairs = ledger.request_pairs(ledger.parse_journal(lines, "line")).collect()
    assert [(p.request, p.pending) for p in pairs] == [(1, True)]


def test_chapters_of_pages_are_read_after_texts_are_spread(spark):
    """No filter on the chapters is inferred: it would read every page in the scan, before rows are dealt out."""
    given = spark.createDataFrame([("<div id='x'></div>",)], "html string").repartition(3)
    plan = pages.to_chapters(pages.work_pages(given))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Repartition"):]
    assert "lambda" not in below and "split(" not in below


def test_character_references_of_every_kind(spark):
    said = "&amp;&LT; &#65;&#x42;&#X43; &#0; &#1114112; &#x000000041; &#9999999999; &nope; &amp &; a&#39;b"
    row = spark.createDataFrame([(said,), (None,), ("",), ("&",)], "t string").select(tx.decode_entities(F.col("t")).alias("t")).collect()
    assert [r.t for r in row] == ["&< ABC &#0; &#1114112; A &#9999999999; &nope; &amp &; a'b", None, "", "&"]


def test_heading_and_tags_of_an_entry_are_looked_for_once(spark, tmp_path):
    """Not once for every field within; plain fragments, with or without blanks at their ends, are only trimmed."""
    from storyloom.functions import text as tx
    spark.createDataFrame([("x",)], "html string").write.parquet(str(tmp_path / "p"))
    plan = pages.listings(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('<ul class="tags commas">') == 1 and plan.count('<h4 class="heading">') == 1
    rows = spark.createDataFrame([(t,) for t in (" plain ", "", None, "a  b", "a\tb", "a &amp; b", "<b>x</b>", "a  b", "\n\nz")], "t string").repartition(2)
    got = {r.t: r.out for r in rows.select("t", tx.html_to_text(F.col("t")).alias("out")).collect()}
    assert got == {" plain ": "plain", "": "", None: "", "a  b": "a b", "a\tb": "a b", "a &amp; b": "a & b", "<b>x</b>": "x", "a  b": "a b", "\n\nz": "z"}
