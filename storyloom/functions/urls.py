"""What an address points at, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts the archive answers on.
HOSTS = (
    "ao3.org",
    "archive.transformativeworks.org",
    "archiveofourown.com",
    "archiveofourown.gay",
    "archiveofourown.net",
    "archiveofourown.org",
    "download.archiveofourown.org",
    "www.ao3.org",
    "www.archiveofourown.com",
    "www.archiveofourown.org",
)
# Path shapes in the order they are tried, and what each names.
SHAPES = (
    ("work", "/works/(\\d+)(?:[/?#]|$)"),
    ("work", "/downloads/(\\d+)/"),
    ("chapter", "/chapters/(\\d+)(?:[/?#]|$)"),
    ("series", "/series/(\\d+)(?:[/?#]|$)"),
    ("external", "/external_works/(\\d+)"),
)
ORPHAN = "orphan_account"


def _absolute(link: Column) -> Column:
    return F.when(link.startswith("http"), link).otherwise(F.concat(F.lit("https://"), link))


def classify(raw: Column) -> dict[str, Column]:
    """Columns ``kind``, ``id`` and ``known_host`` for a column of links.

    A bare number is a work.  A chapter's or series' number never passes for a
    work's.  Nothing is guessed: an address of no known shape is ``unknown``.
    """
    link = F.trim(F.coalesce(raw, F.lit("")))
    bare = link.rlike("^\\d+$")
    authority = "^(?i)https?:[/\\\\]+([^/\\\\?#]*)"
    path = F.regexp_extract(_absolute(link), authority + "([^?#]*)", 2)
    host = F.lower(F.regexp_replace(
        F.regexp_extract(_absolute(link), authority, 1), "^[^@]*@|:\\d*$", ""))
    kind, ident = F.when(bare, F.lit("work")), F.when(bare, link)
    for name, shape in SHAPES:
        found = F.regexp_extract(path, shape, 1)
        kind, ident = kind.when(found != "", F.lit(name)), ident.when(found != "", found)
    return {"kind": kind.otherwise("unknown"), "id": ident,
            "known_host": bare | host.isin(*HOSTS)}


def byline(raw: Column) -> dict[str, Column]:
    """Columns ``pseud``, ``user`` and ``orphan`` of ``Pseud (User)``."""
    name = F.trim(F.coalesce(raw, F.lit("")))
    shape = "^(.*?)\\s*\\(([^()]+)\\)$"
    split = name.rlike(shape)
    user = F.when(split, F.trim(F.regexp_extract(name, shape, 2))).otherwise(name)
    pseud = F.when(split, F.trim(F.regexp_extract(name, shape, 1))).otherwise(name)
    return {"pseud": pseud, "user": user, "orphan": user == ORPHAN}


def author_path(raw: Column) -> Column:
    """The page of a pseud, as the archive links it."""
    parts = byline(raw)
    enc = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("/users/"), enc(parts["user"]), F.lit("/pseuds/"), enc(parts["pseud"]))
