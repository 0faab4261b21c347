"""Folders of EPUB books into works and chapters."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.functions.values import stats_line
from storyloom.sources.pages import first

_OPENED = "path string, opf string, docs array<struct<position: int, html: string>>, problem string"
_OPENED_ARROW = pa.schema([
    ("path", pa.string()), ("opf", pa.string()),
    ("docs", pa.list_(pa.struct([("position", pa.int32()), ("html", pa.string())]))), ("problem", pa.string())])
#: Books of one step in Python, and bytes of them: a task holds no more of them opened, however many a batch brings.
STEP, STEP_BYTES = 64, 8 << 20
# Groups of a book's preface, by the label before them.
GROUPS = (
    ("ratings", "Rating"), ("warnings", "Archive Warning"), ("categories", "Category"),
    ("fandoms", "Fandom"), ("relationships", "Relationship"), ("characters", "Character"),
    ("freeform", "Additional Tags"), ("series", "Series"), ("collections", "Collections"),
)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option(
        "recursiveFileLookup", "true").load(path).select("path", "content")


def _attr(tag: str, name: str) -> str:
    found = re.search(rf"""\b{name}\s*=\s*["']([^"']*)["']""", tag, re.I)
    return found.group(1) if found else ""


def _open(content: bytes) -> tuple:
    """The package file and the spine's documents in reading order."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            names = set(book.namelist())
            read = lambda n: book.read(n).decode("utf-8", "replace")
            rootfile = re.search(r"<rootfile\b[^>]*>", read("META-INF/container.xml"), re.I)
            root = _attr(rootfile.group(), "full-path")
            opf = read(root)
            items = {_attr(t, "id"): t for t in re.findall(r"<item\b[^>]*>", opf, re.I)}
            docs = []
            for ref in re.findall(r"<itemref\b[^>]*>", opf, re.I):
                item = items.get(_attr(ref, "idref"))
                if item is None or "html" not in _attr(item, "media-type"):
                    continue
                name = posixpath.normpath(posixpath.join(posixpath.dirname(root), _attr(item, "href")))
                if name in names:
                    docs.append({"position": len(docs), "html": read(name)})
            return opf, docs, None
    except (zipfile.BadZipFile, KeyError, AttributeError) as error:
        return None, [], f"not a readable book: {error}"


def in_steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of few rows and bytes, none copied; a row larger than that is one by itself."""
    begin = 0
    while begin < batch.num_rows:
        n = min(STEP, batch.num_rows - begin)
        while n > 1 and batch.slice(begin, n).nbytes > STEP_BYTES:
            n //= 2
        yield batch.slice(begin, n)
        begin += n


def _open_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in in_steps(batch):
            opened = [_open(content.as_py()) for content in some.column("content")]
            yield pa.RecordBatch.from_pylist([
                {"path": path.as_py(), "opf": opf, "docs": docs, "problem": problem}
                for path, (opf, docs, problem) in zip(some.column("path"), opened)], schema=_OPENED_ARROW)


def _element(opf: Column, name: str) -> Column:
    return F.trim(tx.decode_entities(first(opf, f"(?is)<{name}\\b[^>]*>(.*?)</{name}>")))


def _group(preface: Column, label: str) -> Column:
    """Names of one preface group: its links, else its text split at commas."""
    dd = F.coalesce(first(preface, f"(?is)<dt[^>]*>\\s*{label}s?:?\\s*</dt>\\s*<dd[^>]*>(.*?)</dd>"), F.lit(""))
    links = F.filter(F.transform(
        F.regexp_extract_all(dd, F.lit("(?is)<a\\b[^>]*>(.*?)</a>"), 1), tx.html_to_text), lambda n: n != "")
    said = F.filter(F.split(tx.html_to_text(dd), "\\s*,\\s*"), lambda n: n != "")
    return F.when(F.size(links) > 0, links).otherwise(said)


def books(files: DataFrame) -> DataFrame:
    """One row per file: identity, preface groups, and chapters in order.

    A document is a chapter when it carries the chapters marker and not the
    preface one; in a book with no such marker, when it is neither preface nor
    afterword.  End notes kept in documents of their own are joined apart.
    """
    opened = files.select("path", "content").mapInArrow(_open_all, _OPENED)
    has = lambda c, marker: c.rlike(f'(?i)\\bid="{marker}"')
    body = lambda h: F.coalesce(first(h, "(?is)<body\\b[^>]*>(.*?)</body>"), h)
    posted = "(?is)Posted originally on the(?:(?!</p>|</div>).)*?archiveofourown\\.org/works/(\\d+)"
    docs = F.transform("docs", lambda d: F.struct(
        d["position"].alias("position"), d["html"].alias("html"), body(d["html"]).alias("body")))
    opened = opened.withColumn("docs", docs)
    marked = F.filter("docs", lambda d: has(d["body"], "chapters") & ~has(d["body"], "preface"))
    plain = F.filter("docs", lambda d: ~has(d["body"], "(preface|afterword)"))
    notes = F.filter("docs", lambda d: has(d["body"], "afterword") & ~has(d["body"], "chapters"))
    named = F.filter("docs", lambda d: d["html"].rlike(posted))
    opened = opened.withColumns({
        "parts": F.when(F.size(marked) > 0, marked).otherwise(plain),
        "named": F.get(named, 0).getField("html"),
        "notes": F.array_join(F.transform(notes, lambda d: d["body"]), "\n"),
    }).withColumn("preface", F.regexp_replace(F.coalesce("named", F.lit("")), "\\s+", " "))
    chapter = lambda d: F.struct(
        F.nullif(tx.html_to_text(first(d["body"], "(?is)<h[1-3][^>]*>(.*?)</h[1-3]>")), F.lit("")).alias("title"),
        d["body"].alias("html"), tx.html_to_text(d["body"]).alias("text"))
    told = F.filter(F.transform("parts", chapter), lambda c: c["text"] != "")
    numbered = F.transform(told, lambda c, i: F.struct(
        (i + 1).cast("int").alias("number"), c["title"].alias("title"), c["html"].alias("html"),
        c["text"].alias("text"), tx.count_words(c["text"]).alias("words")))
    stats = stats_line(tx.html_to_text(first(
        F.col("preface"), "(?is)<dt[^>]*>\\s*Stats:?\\s*</dt>\\s*<dd[^>]*>(.*?)</dd>")))
    opf = F.col("opf")
    stamp = first(opf, '(?i)name="calibre:timestamp"\\s+content="([^"]+)"')
    creators = F.regexp_extract_all(opf, F.lit("(?is)<dc:creator\\b[^>]*>(.*?)</dc:creator>"), 1)
    out = opened.select(
        "path", "problem", first(F.col("named"), posted).alias("work_id"),
        F.substring(stamp, 1, 10).alias("downloaded_at"), _element(opf, "dc:title").alias("title"),
        F.filter(F.transform(creators, lambda c: F.trim(tx.decode_entities(c))), lambda n: n != "").alias("authors"),
        F.nullif(tx.html_to_text(_element(opf, "dc:description")), F.lit("")).alias("summary"),
        _element(opf, "dc:language").alias("language"),
        F.coalesce(stats["published"], F.substring(_element(opf, "dc:date"), 1, 10)).alias("published"),
        stats["updated"].alias("updated"), stats["chapters_planned"].alias("chapters_planned"),
        stats["complete"].alias("complete"), *[_group(F.col("preface"), label).alias(n) for n, label in GROUPS],
        numbered.alias("chapters"), F.nullif(F.col("notes"), F.lit("")).alias("end_notes_html"))
    return out.withColumn("rating", F.get("ratings", 0)).drop("ratings")
