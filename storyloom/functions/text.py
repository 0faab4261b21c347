"""Text and markup as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named character references that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "mdash": "—", "ndash": "–", "hellip": "…", "rsquo": "’", "lsquo": "‘",
    "ldquo": "“", "rdquo": "”",
}
# Elements whose tags break a line, and a run of word characters.
BLOCK_TAGS = "p|div|h[1-6]|li|blockquote|tr"
WORD = "[\\p{L}\\p{N}'’-]+"
# Fixed value: white space as a browser's regular expressions see it.
SPACE = "[\\s\\x0B\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _until_gone(value: Column, mark: str, pattern: str, step: Callable[[Column], Column]) -> Column:
    """Apply ``step`` until ``pattern`` no longer occurs.

    Text without ``mark`` is left alone.  Ordinary markup is done after one
    step; what still matches gets as many more as it has opening brackets,
    since every effective step removes one.
    """
    def rest(once: Column) -> Column:
        more = F.when(
            once.contains(mark) & once.rlike(pattern), F.regexp_count(once, F.lit("<")),
        ).otherwise(F.lit(0)).cast("int")
        return F.aggregate(F.array_repeat(F.lit(0), more), once, lambda acc, _: step(acc))

    return F.when(value.contains(mark), let(step(value), rest)).otherwise(value)


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def decode_entities(text: Column) -> Column:
    """Named and numeric character references; unknown ones stay as written.

    Pieces go through a chain of small steps, so that nothing is spelled twice:
    a plan holds this expression once for every field that is read.
    """
    table = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def named(part: Column) -> Column:
        return F.struct(part.alias("part"), F.regexp_extract(part, "^(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z]+);", 1).alias("body"))

    def numbered(p: Column) -> Column:
        digits = F.regexp_replace(p["body"], "^#[xX]?0*", "")
        return F.struct(p["part"].alias("part"), p["body"].alias("body"), F.when(p["body"].startswith("#"), digits).alias("digits"))

    def pointed(p: Column) -> Column:
        base = F.when(p["body"].rlike("^#[xX]"), 16).otherwise(10)
        point = F.when(F.length(p["digits"]) <= 8, F.call_function("conv", p["digits"], base, F.lit(10)).cast("bigint"))
        return F.struct(p["part"].alias("part"), p["body"].alias("body"), point.alias("point"))

    def known(p: Column) -> Column:
        sign = F.when(p["point"].between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(p["point"]), 8, "0")), "UTF-32"))
        return F.struct(p["part"].alias("part"), p["body"].alias("body"),
                        F.coalesce(sign, F.try_element_at(table, F.lower(p["body"]))).alias("sign"))

    def told(p: Column) -> Column:
        return F.coalesce(F.concat(p["sign"], F.substr(p["part"], F.length(p["body"]) + 2)), F.concat(F.lit("&"), p["part"]))

    def join(parts: Column) -> Column:
        read = F.slice(parts, 2, F.size(parts))
        for step in (named, numbered, pointed, known, told):
            read = F.transform(read, step)
        return F.concat(F.element_at(parts, 1), F.array_join(read, ""))

    return let(text, lambda t: F.when(t.contains("&"), let(F.split(t, "&"), join)).otherwise(t))


def _strip_tags(html: Column) -> Column:
    out = F.regexp_replace(html, "(?is)<(script|style)\\b[^>]*>.*?(?:</\\1\\s*>|\\z)", "")
    out = F.regexp_replace(out, f"(?i)</(?:{BLOCK_TAGS})>", "\n")
    out = F.regexp_replace(out, f"(?i)\n?<(?:{BLOCK_TAGS})\\b[^>]*>", "\n")
    out = F.regexp_replace(out, "(?i)<br\\s*/?>", "\n")
    return F.regexp_replace(out, "<[^>]*>", "")


def html_to_text(html: Column) -> Column:
    """Plain text: no tag of any kind, a line per block, blanks squeezed.

    Each pattern runs only over text that shows what it looks for, so that
    short plain fragments cost next to nothing.
    """
    def squeeze(text: Column) -> Column:
        blanks = text.contains("  ") | text.contains("\t") | text.contains("\u00a0")
        return F.when(blanks, F.regexp_replace(text, "[ \\t\\u00a0]+", " ")).otherwise(text)

    def thin(text: Column) -> Column:
        return F.when(text.contains("\n"), F.regexp_replace(text, "\\n\\s*\\n\\s*\\n+", "\n\n")).otherwise(text)

    def told(h: Column) -> Column:
        bare = _until_gone(h, "<", "<[^>]*>", _strip_tags)
        shown = [h.contains(mark) for mark in ("<", "&", "\n", "  ", "\t", "\u00a0")]
        return trim(F.when(reduce(Column.__or__, shown), let(let(decode_entities(bare), squeeze), thin)).otherwise(h))
    return let(F.coalesce(html, F.lit("")), told)


# Fixed value: the same white space, as the characters themselves.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    map(chr, range(0x2000, 0x200B)))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def normalise(html: Column) -> Column:
    """Markup without the differences two fetches of one chapter may show."""
    out = _until_gone(
        F.coalesce(html, F.lit("")), "<!--", "(?s)<!--.*?-->",
        lambda h: F.regexp_replace(h, "(?s)<!--.*?-->", ""))
    out = F.regexp_replace(
        out, '(?i)name="authenticity_token"[^>]*value="[^"]*"', 'name="authenticity_token"')
    out = F.regexp_replace(out, f"{SPACE}+", " ")
    return trim(F.regexp_replace(out, "> <", "><"))


def normalise_lightly(html: Column) -> Column:
    """Line ends and one doubling of spaces folded; NULL stays NULL."""
    out = F.regexp_replace(html, "[\\n\\r]", " ")
    return F.regexp_replace(out, "  ", " ")


def content_hash(html: Column) -> Column:
    return F.sha2(normalise(html), 256)


def enclosed(rest: Column, tag: str | Column) -> Column:
    """What follows an opening tag, parted where its element closes: ``inside`` and, if it closes, ``after``.

    The rest is cut at every tag of that name; a fold over the cuts counts the depth
    and the cuts it passes, so a page of many tags is read once.
    """
    name = F.lit(tag) if isinstance(tag, str) else tag
    # a blank in front: the first cut then never begins with a tag
    cuts = F.split(F.concat(F.lit(" "), rest), F.concat(F.lit("(?i)(?=<"), name, F.lit("\\b|</"), name, F.lit("\\s*>)")))

    def step(acc: Column, cut: Column) -> Column:
        depth = F.when(acc["depth"] == 0, 0).otherwise(acc["depth"] + F.when(cut.startswith("</"), -1).otherwise(1))
        return F.struct(depth.alias("depth"), (acc["n"] + F.when(depth > 0, 1).otherwise(0)).alias("n"))

    def parted(both: Column) -> Column:
        pieces, end = both["pieces"], both["end"]
        after = F.regexp_replace(F.array_join(F.slice(pieces, end["n"] + 1, F.size(pieces)), ""), "^</[^>]*>", "")
        return F.struct(F.substr(F.array_join(F.slice(pieces, F.lit(1), end["n"]), ""), F.lit(2)).alias("inside"),
                        F.when(end["depth"] == 0, after).alias("after"))
    start = F.struct(F.lit(1).alias("depth"), F.lit(1).alias("n"))
    return let(let(cuts, lambda p: F.struct(p.alias("pieces"), F.aggregate(F.slice(p, F.lit(2), F.size(p)), start, step).alias("end"))), parted)


# Fixed value: an element of this class steers screen readers and is no prose.
LANDMARK = '(?is)<[a-z][a-z0-9]*\\b[^>]*\\sclass="(?:[^"]*\\s)?landmark(?:\\s[^"]*)?"[^>]*>'


def strip_landmarks(html: Column) -> Column:
    """Drop elements of the class ``landmark``, with all they hold, from the prose; one that never closes stays."""
    def step(acc: Column, _: Column) -> Column:
        opening = F.regexp_extract(acc["rest"], LANDMARK, 0)
        halves = F.split(acc["rest"], LANDMARK, 2)

        def onward(h: Column) -> Column:
            rest = enclosed(F.element_at(h, 2), F.lower(F.regexp_extract(opening, "^<([A-Za-z][A-Za-z0-9]*)", 1)))
            return let(rest, lambda r: F.struct(
                F.concat(acc["done"], F.element_at(h, 1), F.when(r["after"].isNull(), opening).otherwise("")).alias("done"),
                F.coalesce(r["after"], F.element_at(h, 2)).alias("rest")))
        return F.when(opening == "", acc).otherwise(let(halves, onward))

    def whole(text: Column) -> Column:
        start = F.struct(F.lit("").alias("done"), text.alias("rest"))
        return F.aggregate(F.array_repeat(F.lit(0), F.regexp_count(text, F.lit(LANDMARK))), start, step,
                           lambda acc: F.concat(acc["done"], acc["rest"]))
    return let(F.coalesce(html, F.lit("")), lambda t: F.when(t.contains("landmark"), whole(t)).otherwise(t))


def image_sources(html: Column) -> Column:
    """Every ``src`` of an image, in order, repeats kept."""
    return F.regexp_extract_all(
        F.coalesce(html, F.lit("")), F.lit('(?i)<img\\b[^>]*\\bsrc="([^"]+)"'), 1)


def image_urls(html: Column) -> Column:
    """Distinct absolute image addresses, entities decoded."""
    found = F.transform(image_sources(html), decode_entities)
    return F.array_distinct(F.filter(found, lambda u: u.rlike("(?i)^https?:")))


def classes(html: Column) -> Column:
    """Every class name used, repeats kept."""
    values = F.regexp_extract_all(
        F.coalesce(html, F.lit("")), F.lit('(?i)class="([^"]+)"'), 1)
    return F.filter(F.flatten(F.transform(values, lambda v: F.split(v, "\\s+"))),
                    lambda c: c != "")


# Classes every book and page carries, so not an author's own.
HOUSE_NUMBERED = ("calibre", "userstuff")
HOUSE_NAMES = (
    "afterword", "bold", "byline", "chapter", "endnote-link", "heading", "indent", "italics", "jump", "landmark", "li",
    "message", "meta", "notes", "p", "preface", "small", "summary", "tags", "title", "toc-heading",
)


def needs_skin(html: Column) -> Column:
    """Whether the markup shows an author's own styling."""
    markup = F.coalesce(html, F.lit(""))
    return markup.rlike("(?i)\\sstyle\\s*=") | F.exists(
        classes(markup), lambda c: ~(c.isin(*HOUSE_NAMES) | F.regexp_replace(c, "[0-9]+$", "").isin(*HOUSE_NUMBERED)))


def house_classes(html: Column) -> Column:
    """Undo what a book converter did to class attributes.

    Numbered ``userstuff`` names lose the number, generated ``calibre`` names
    go, and an attribute left empty goes with them.
    """
    markup = F.coalesce(html, F.lit(""))
    attribute = '(?i)\\sclass="[^"]*"'

    def tidy(attr: Column) -> Column:
        names = F.split(F.regexp_extract(attr, '"([^"]*)"', 1), "\\s+")
        named = F.transform(names, lambda c: F.regexp_replace(c, "(?i)^userstuff\\d+$", "userstuff"))
        kept = F.array_distinct(F.filter(
            named, lambda c: (c != "") & ~c.rlike("(?i)^calibre\\d*$")))
        return F.when(F.size(kept) > 0, F.concat(F.lit(' class="'), F.array_join(kept, " "), F.lit('"'))
                      ).otherwise(F.lit(""))

    found = F.transform(F.regexp_extract_all(markup, F.lit(attribute), 0), tidy)
    between = F.split(markup, attribute)
    woven = F.zip_with(between, found, lambda b, a: F.concat(b, F.coalesce(a, F.lit(""))))
    return F.array_join(woven, "")


def seed_hash(text: Column) -> Column:
    """Thirty-one-fold character hash modulo 2**32."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(
        chars, F.lit(0).cast("bigint"),
        lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))


def local_book_id(title: Column, authors: Column) -> Column:
    said = F.concat(title, F.lit("|"), F.array_join(authors, ","))
    return F.lower(F.conv(seed_hash(said).cast("string"), 10, 36))


def spine_hue(seed: Column) -> Column:
    return (seed_hash(F.coalesce(seed, F.lit(""))) % 360).cast("int")


# Languages a two-letter code stands for.
LANGUAGES = {
    "en": "English", "fr": "Français", "es": "Español", "de": "Deutsch",
    "it": "Italiano", "pt": "Português", "ru": "Русский", "zh": "中文",
    "ja": "日本語", "ko": "한국어", "nl": "Nederlands", "pl": "Polski",
    "sv": "Svenska", "tr": "Türkçe", "id": "Bahasa Indonesia",
}


def language_name(code: Column) -> Column:
    """The name a code stands for; an unknown code is its own name."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    key = F.element_at(F.split(F.lower(code), "[-_]"), 1)
    return F.when(code != "", F.coalesce(F.try_element_at(table, key), code))
