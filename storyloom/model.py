"""The tables of a library, their schemas, and how a schema grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STR, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_BOOL, _DATE, _TS = T.BooleanType(), T.DateType(), T.TimestampType()
_DBL, _BIN = T.DoubleType(), T.BinaryType()
_NAMES = T.ArrayType(T.StringType())


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


WORKS = _schema(
    ("work_id", _STR), ("title", _STR), ("authors", _NAMES), ("summary", _STR),
    ("rating", _STR), ("language", _STR), ("published", _DATE), ("updated", _DATE),
    ("downloaded_at", _DATE), ("complete", _BOOL), ("words", _LONG),
    ("chapter_count", _INT), ("chapters_planned", _INT), ("updated_at", _LONG),
    ("skin_css", _STR), ("skin_hash", _STR), ("end_notes_html", _STR),
    ("source", _STR), ("source_file", _STR), ("fetched_at", _TS),
    ("in_bookmarks", _BOOL), ("rec", _BOOL), ("in_history", _BOOL),
    ("bookmarked_at", _DATE), ("last_visited", _STR), ("visits", _LONG),
    ("visits_synced_at", _TS), ("kudos_given", _BOOL), ("has_text", _BOOL),
    ("kudos", _LONG), ("bookmark_count", _LONG), ("hits", _LONG), ("hidden", _BOOL),
)
TAGS = _schema(("work_id", _STR), ("kind", _STR), ("name", _STR))
CHAPTERS = _schema(
    ("id", _LONG), ("work_id", _STR), ("number", _INT), ("title", _STR),
    ("html", _STR), ("text", _STR), ("words", _LONG), ("content_hash", _STR),
)
CHAPTER_VERSIONS = _schema(
    ("work_id", _STR), ("number", _INT), ("title", _STR), ("html", _STR),
    ("text", _STR), ("words", _LONG), ("content_hash", _STR), ("reason", _STR),
    ("archived_at", _TS),
)
SKIN_VERSIONS = _schema(
    ("work_id", _STR), ("skin_css", _STR), ("skin_hash", _STR), ("archived_at", _TS),
)
IMAGES = _schema(
    ("work_id", _STR), ("url", _STR), ("sha256", _STR), ("mime", _STR),
    ("bytes", _BIN), ("status", _STR), ("fetched_at", _TS),
)
READING = _schema(
    ("work_id", _STR), ("chapter", _INT), ("offset", _DBL), ("chapters_read", _INT),
    ("completed_before", _BOOL), ("chapter_count", _INT), ("marked_later", _BOOL),
    ("imported_from", _STR), ("updated_at", _TS), ("opened_at", _TS),
)
VISITS = _schema(("id", _STR), ("work_id", _STR), ("started_at", _TS))
DELETED = _schema(("work_id", _STR), ("title", _STR), ("at", _TS))
BOOKMARKED_BY = _schema(("person", _STR), ("work_id", _STR), ("at", _TS))
BLOCKED = _schema(("name", _STR), ("at", _TS))

SCHEMAS: dict[str, T.StructType] = {
    "works": WORKS, "tags": TAGS, "chapters": CHAPTERS,
    "chapter_versions": CHAPTER_VERSIONS, "skin_versions": SKIN_VERSIONS,
    "images": IMAGES, "reading": READING, "visits": VISITS, "deleted": DELETED,
    "bookmarked_by": BOOKMARKED_BY, "blocked": BLOCKED,
}

#: What one row of each table is identified by.
KEYS: dict[str, tuple[str, ...]] = {
    "works": ("work_id",), "tags": ("work_id", "kind", "name"),
    "chapters": ("work_id", "number"),
    "chapter_versions": ("work_id", "number", "archived_at"),
    "skin_versions": ("work_id", "archived_at"), "images": ("work_id", "url"),
    "reading": ("work_id",), "visits": ("id",), "deleted": ("work_id",),
    "bookmarked_by": ("person", "work_id"), "blocked": ("name",),
}

#: Values a column takes when an older table does not carry it.
DEFAULTS: dict[str, object] = {
    "in_bookmarks": False, "rec": False, "in_history": False, "kudos_given": False,
    "has_text": False, "hidden": False, "completed_before": False,
    "marked_later": False,
}


class Library:
    """Eleven tables; every operator takes one and reads what it needs.

    A table may be given as a function making it, which is then called the
    first time an operator asks for that table.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        unknown = set(tables) - set(SCHEMAS)
        if unknown or len(tables) != len(SCHEMAS):
            raise ValueError(f"a library has exactly {sorted(SCHEMAS)}")
        self._given = tables
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self._made:
            given = self._given[name]
            self._made[name] = given() if callable(given) else given
        return self._made[name]

    def with_(self, **tables: DataFrame) -> Library:
        return Library(**{**self._given, **self._made, **tables})

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}

    @staticmethod
    def of(spark: SparkSession, **tables: DataFrame) -> Library:
        """A library from whichever tables exist; the others are empty."""
        return Library(**{
            name: evolve(tables[name], schema) if name in tables
            else spark.createDataFrame([], schema)
            for name, schema in SCHEMAS.items()
        })


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the declared columns ``df`` lacks; columns of its own stay at the end."""
    have = {f.name: f.dataType for f in df.schema.fields}

    def declared(f: T.StructField) -> str:
        name, kind = f"`{f.name}`", f.dataType.simpleString()
        if f.name not in have:
            value = {None: "NULL", False: "false"}[DEFAULTS.get(f.name)]
            return f"CAST({value} AS {kind}) AS {name}"
        return name if have[f.name] == f.dataType else f"CAST({name} AS {kind}) AS {name}"

    extra = [f"`{c}`" for c in df.columns if c not in set(schema.fieldNames())]
    return df.selectExpr(*map(declared, schema.fields), *extra)


def missing_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    """Names :func:`evolve` would add."""
    have = set(df.columns)
    return [f.name for f in schema.fields if f.name not in have]
