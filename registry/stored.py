"""Storing a library and opening it again."""

import uuid

from pyspark.sql import functions as F

from registry import query
from registry.base import sql
from storyloom.model import SCHEMAS, WORKS, evolve, missing_columns
from storyloom.session import scratch_root
from storyloom.sources import tables
from storyloom.sources.star import library

_COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n FROM {'rvisits' if name == 'visits' else name}" for name in SCHEMAS)


def _counted(lib):
    out = None
    for name in SCHEMAS:
        part = getattr(lib, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("load_library", sql(_COUNTS))
def load_library(spark, root):
    """Every table of a snapshot, loaded as it was written."""
    return _counted(_stored(spark, root)[0])


def _stored(spark, root, buckets=16):
    path = f"{scratch_root(spark)}/library-{uuid.uuid4().hex}"
    tables.publish(spark, path, tables.write_library(library(spark, root), path, "first", buckets))
    return tables.load_library(spark, path), path


@query("write_library", sql("SELECT work_id, title, words, hidden FROM works"))
def write_library(spark, root):
    """Written as a snapshot, published, and read back as the current one."""
    return _stored(spark, root)[0].works.select("work_id", "title", "words", "hidden")


@query("stored_lookup", sql("SELECT work_id, number, words FROM chapters WHERE work_id IN ('1', '5', '77')"))
def stored_lookup(spark, root):
    """A few works' chapters, from their buckets alone."""
    return tables.lookup(spark, _stored(spark, root)[1], "chapters", ["1", "5", "77"]).select("work_id", "number", "words")


@query("evolve_schema", sql("SELECT work_id, title, false AS rec, NULL::BIGINT AS kudos, wk AS own, 30 AS added FROM works"))
def evolve_schema(spark, root):
    """A table of few columns gains the declared ones and keeps its own."""
    old = library(spark, root).works.select("work_id", "title", "words", F.col("work_id").cast("bigint").alias("own"))
    return evolve(old, WORKS).select(
        "work_id", "title", "rec", "kudos", "own", F.lit(len(missing_columns(old, WORKS))).alias("added"))
