import datetime as dt

import pytest

from storyloom.model import DEFAULTS, Library, SCHEMAS
from storyloom.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("local[8]", "tests", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.storyloom.textTasks": "8"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _value(kind, value):
    if isinstance(value, str) and kind == "date":
        return dt.date.fromisoformat(value)
    if isinstance(value, str) and kind == "timestamp":
        return dt.datetime.fromisoformat(value)
    return value


@pytest.fixture(scope="session")
def make(spark):
    """``make(works=[{...}], tags=[(...)])``: a library out of a few rows."""
    def rows(name, given):
        schema = SCHEMAS[name]
        out = []
        for row in given:
            if not isinstance(row, dict):
                row = dict(zip(schema.fieldNames(), row))
            out.append(tuple(_value(f.dataType.simpleString(), row.get(f.name, DEFAULTS.get(f.name)))
                             for f in schema.fields))
        return spark.createDataFrame(out, schema)

    def library(**tables):
        return Library.of(spark, **{name: rows(name, given) for name, given in tables.items()})

    library.rows = rows
    return library


@pytest.fixture(scope="session")
def ids():
    """Identifiers of a result, in its order."""
    return lambda df, column="work_id": [r[column] for r in df.collect()]


@pytest.fixture(scope="session")
def shelf(make):
    """Three works, as few as tell the filters apart."""
    work = lambda i, title, by, words, n, done, rating, lang, on: {
        "work_id": i, "title": title, "authors": [by], "words": words, "chapter_count": n, "complete": done,
        "rating": rating, "language": lang, "published": on}
    return make(
        works=[work("1", "Alpha", "ann", 1000, 5, True, "Explicit", "en", "2020-01-01"),
               work("2", "Bravo", "bee", 50000, 10, False, "Teen And Up Audiences", "en", "2021-01-01"),
               work("3", "Charlie", "cee", 5000, 3, True, "Explicit", "fr", "2022-01-01")],
        tags=[("1", "fandom", "BTS"), ("1", "freeform", "Fluff"), ("2", "fandom", "BTS"),
              ("2", "freeform", "Angst"), ("3", "fandom", "EXO"), ("3", "freeform", "Fluff")],
        reading=[{"work_id": "1", "chapter": 5, "chapters_read": 1},
                 {"work_id": "3", "chapter": 1, "chapters_read": 0, "marked_later": True}])
