"""Work that depends on order, without gathering a whole key in one place.

One key may hold a large part of all rows, so nothing here orders a whole key.
Rows are cut into time slices; windows run within a (key, slice), and only one
summary row per slice is ordered by key to carry values across slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
AFTER = (1, Window.unboundedFollowing)


def time_slice(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def previous(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str,
             slice_of: Column, out: str) -> DataFrame:
    """The value of the row before, as ``lag`` over the key would give it.

    ``value`` must be unique-last per slice by ``order``; the first row of a
    slice takes the last value of the nearest earlier slice.
    """
    cut = df.withColumn("_slice", slice_of)
    within = Window.partitionBy(*key, "_slice").orderBy(*order)
    over = Window.partitionBy(*key).orderBy("_slice").rowsBetween(*BEFORE)
    stamp = F.struct(*order)
    carried = (
        cut.groupBy(*key, "_slice").agg(F.max_by(F.struct(F.col(value).alias("v")), stamp).alias("_last"))
        .withColumn("_carried", F.last("_last").over(over).getField("v")).drop("_last"))
    return (
        cut.withColumn("_near", F.lag(F.struct(F.col(value).alias("v"))).over(within))
        .join(carried, [*key, "_slice"], "left")
        .withColumn(out, F.when(F.col("_near").isNotNull(), F.col("_near").getField("v"))
                    .otherwise(F.col("_carried")))
        .drop("_near", "_carried", "_slice"))


def next_at_or_after(left: DataFrame, right: DataFrame, key: str, at: str, tie: Column,
                     value: str, seconds: int = 86400) -> DataFrame:
    """For each left row the value of the first right row at or after it.

    A forward as-of join: both sides are laid in one line per key, left rows
    before right rows on equal stamps, and the next right value is taken from
    the rest of the slice or else from the nearest later slice that has one.
    """
    put = left.withColumn("_side", F.lit(0)).withColumn("_tie", F.lit(None).cast("string")).withColumn(
        "_value", F.lit(None).cast("struct<v:string>"))
    source = right.select(
        F.col(key), F.col(at), F.lit(1).alias("_side"), tie.cast("string").alias("_tie"),
        F.struct(F.col(value).cast("string").alias("v")).alias("_value"))
    line = put.unionByName(source, allowMissingColumns=True).withColumn(
        "_slice", time_slice(F.col(at), seconds))
    within = Window.partitionBy(key, "_slice").orderBy(at, "_side", "_tie").rowsBetween(
        0, Window.unboundedFollowing)
    over = Window.partitionBy(key).orderBy("_slice").rowsBetween(*AFTER)
    first = source.withColumn("_slice", time_slice(F.col(at), seconds)).groupBy(key, "_slice").agg(
        F.min_by("_value", F.struct(at, "_tie")).alias("_first"))
    slices = line.where("_side = 0").select(key, "_slice").distinct()
    carried = (
        slices.join(first, [key, "_slice"], "full")
        .withColumn("_later", F.first("_first", ignorenulls=True).over(over)).drop("_first"))
    return (
        line.withColumn("_near", F.first("_value", ignorenulls=True).over(within))
        .where("_side = 0")
        .join(carried, [key, "_slice"], "left")
        .withColumn(value, F.coalesce("_near", "_later").getField("v"))
        .drop("_side", "_tie", "_value", "_slice", "_near", "_later"))
