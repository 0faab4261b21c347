"""Libraries stored as parquet: whole snapshots, and which one is current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.model import KEYS, Library, SCHEMAS, evolve

BUCKETS = 64


def _bucketed(name: str) -> bool:
    return "work_id" in KEYS[name] or name == "visits"


def write_library(lib: Library, root: str, snapshot: str, buckets: int = BUCKETS) -> str:
    """Write every table under a new snapshot; nothing that is read is replaced.

    Tables are laid out by hashed work, in as many buckets as asked; their number
    is written beside them, for :func:`lookup`.  The rebalance hint sizes the files, so
    a bucket grown large by one huge work is cut rather than left to one task.
    """
    for name in SCHEMAS:
        df = getattr(lib, name)
        if _bucketed(name):
            placed = df.withColumn("bucket", F.pmod(F.hash("work_id"), F.lit(buckets)))
            writer = placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "work_id").write.partitionBy("bucket")
        else:
            writer = df.write
        writer.mode("errorifexists").parquet(f"{root}/snapshots/{snapshot}/{name}")
    lib.works.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{root}/snapshots/{snapshot}/layout")
    return snapshot


def publish(spark: SparkSession, root: str, snapshot: str) -> None:
    """Make a snapshot the current one, once it is written whole."""
    spark.range(1).select(F.lit(snapshot).alias("snapshot"), F.current_timestamp().alias("at")).write.mode(
        "append").parquet(f"{root}/published")


def current(spark: SparkSession, root: str) -> str:
    """The snapshot published last."""
    rows = spark.read.schema("snapshot string, at timestamp").parquet(f"{root}/published")
    return rows.agg(F.max_by("snapshot", F.struct("at", "snapshot"))).first()[0]


def load_library(spark: SparkSession, root: str, snapshot: str | None = None) -> Library:
    """Open a snapshot with the declared schemas, older ones included."""
    at = f"{root}/snapshots/{snapshot or current(spark, root)}"

    def opened(name: str) -> DataFrame:
        df = spark.read.parquet(f"{at}/{name}")
        return evolve(df.drop("bucket"), SCHEMAS[name])

    return Library(**{name: (lambda name=name: opened(name)) for name in SCHEMAS})


def lookup(spark: SparkSession, root: str, name: str, works: list[str], snapshot: str | None = None) -> DataFrame:
    """Rows of a few works of a stored table; only the buckets those works hash to are read."""
    at = f"{root}/snapshots/{snapshot or current(spark, root)}"
    df = spark.read.parquet(f"{at}/{name}").where(F.col("work_id").isin(*works))
    if _bucketed(name):
        buckets = spark.read.parquet(f"{at}/layout").first()["buckets"]
        df = df.where(F.col("bucket").isin(*[F.pmod(F.hash(F.lit(w)), F.lit(buckets)) for w in works])).drop("bucket")
    return evolve(df, SCHEMAS[name])
