"""What the operators of this package share: tables, ids, scratch tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from storyloom.session import scratch_root, ship

#: Lower-cases A-Z in UTF-8 bytes and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Rows of one Arrow batch; with whole texts of many kilobytes this bounds a worker's memory.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for long texts, and let workers import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{root}/{name}.parquet")


def octets(text: str = "text") -> Column:
    """A text as UTF-8 bytes, null as none: Python then never has to decode it."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def id_rest(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write a table to the shared scratch folder and read it back, which cuts lineage.

    A lost executor then costs a read, not the work behind it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def frames(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str) -> DataFrame:
    """Run ``work`` over the batches of every partition as pandas frames.

    Unlike ``mapInPandas``, whole numbers beside nulls stay whole numbers, so long ids keep all their digits.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))
    lists = [f.name for f in target if pa.types.is_list(f.type)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(b.to_pandas(integer_object_nulls=True) for b in batches):
            if not len(out):  # pandas takes an empty list of lists for numbers
                out = out.astype({c: object for c in lists})
            yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)
    return df.mapInArrow(run, schema)


def groups(batches: Iterator[pd.DataFrame], key: str, least: int) -> Iterator[pd.DataFrame]:
    """Cut a stream sorted by ``key`` into frames of at least ``least`` rows that never split a key."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < least:
            continue
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        last = whole[key].iloc[-1]
        open_from = int((whole[key] != last).to_numpy().nonzero()[0][-1]) + 1 if (whole[key].iloc[0] != last) else 0
        if open_from:
            yield whole.iloc[:open_from].reset_index(drop=True)
            whole = whole.iloc[open_from:].reset_index(drop=True)
        held, size = [whole], len(whole)
    if held:
        yield pd.concat(held, ignore_index=True)


def components(links: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """Connected components of links (a, b): each node that has a link, and the smallest node of its component.

    Alternates the large-star and small-star steps: every round is two joins of
    links with one minimum per node, so a hub is a skewed join that adaptive
    execution splits, never a gathered group.  Rounds are written to the shared
    folder; the driver only sees a count and a checksum.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u <> v").distinct(), "links")
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias(node), F.col("v").alias(root)).unionAll(
        edges.select(F.col("v").alias(node), F.col("v").alias(root)).distinct())
