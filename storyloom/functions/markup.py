"""Markup reduced to plain structure, as column expressions.

Elements of an allow-list stay, without attributes; links keep where they lead and
pictures what they show, if the address is harmless.  What is not meant to be read
goes with its contents, every other tag goes alone, and a stray ``<`` becomes text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.text import let

# Elements of the HTML standard that structure a text.
KEPT = (
    "a", "article", "aside", "b", "blockquote", "br", "caption", "cite", "code", "dd", "del", "details", "div", "dl", "dt",
    "em", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "img", "ins", "li", "mark", "ol", "p",
    "pre", "q", "s", "section", "small", "span", "strong", "sub", "summary", "sup", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "u", "ul",
)
# Elements whose contents are not prose.
UNREAD = ("iframe", "noscript", "object", "script", "style", "textarea", "title")


def _attribute(given: Column, name: str) -> Column:
    """A quoted attribute's value, or NULL."""
    return F.coalesce(*[F.nullif(F.regexp_extract(given, f"(?is)\\s{name}\\s*=\\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in "\"'"])


def safe_address(value: Column) -> Column:
    """An address that leads to the web, to mail or elsewhere on its site; NULL for any other.

    Blanks and controls are taken out first, as readers of markup do; character
    references other than ``&amp;`` could spell a scheme, so they disqualify.
    """
    bare = F.regexp_replace(F.regexp_replace(value, "[\\x00-\\x20\\x7f]", ""), "&amp;", "&")
    fine = bare.rlike("(?i)^(https?:|mailto:)") | bare.rlike("^[^:]*([/?#]|$)")
    return F.when(fine & ~bare.rlike("&#|&[A-Za-z]+;"), bare)


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def _shown(given: Column, name: str, as_: str, address: bool) -> Column:
    value = _attribute(given, name)
    value = safe_address(value) if address else value
    return F.coalesce(F.concat(F.lit(f' {as_}="'), _escaped(value), F.lit('"')), F.lit(""))


def _piece(piece: Column) -> Column:
    """What follows a ``<``: a tag of the list and the text after it, that text alone, or a literal ``<``."""
    tag = "(?is)^(/?)([a-z][a-z0-9]*)(\\s[^>]*)?/?>"
    name = F.lower(F.regexp_extract(piece, tag, 2))
    given = F.regexp_extract(piece, tag, 3)
    rest = F.regexp_replace(piece, tag, "")
    slash = F.regexp_extract(piece, tag, 1)
    own = F.when(slash != "", "").when(name == "a", _shown(given, "href", "href", True)).when(
        name == "img", F.concat(_shown(given, "src", "src", True), _shown(given, "alt", "alt", False))).otherwise("")
    other = piece.rlike("(?s)^[/!?a-zA-Z][^>]*>")
    return (F.when(name.isin(*KEPT), F.concat(F.lit("<"), slash, name, own, F.lit(">"), rest))
            .when(other, F.regexp_replace(piece, "(?s)^[^>]*>", "")).otherwise(F.concat(F.lit("&lt;"), piece)))


def clean_html(html: Column) -> Column:
    """Reduced markup; NULL is empty."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<!--.*?(?:-->|\\z)", "")
    for name in UNREAD:
        out = F.regexp_replace(out, f"(?is)<{name}\\b[^>]*>.*?(?:</{name}\\s*>|\\z)", "")
    return let(F.split(out, "<"), lambda p: F.concat(
        F.element_at(p, 1), F.array_join(F.transform(F.slice(p, 2, F.size(p)), _piece), "")))
