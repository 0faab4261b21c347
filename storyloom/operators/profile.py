"""What a corpus is made of: fields filled, markup used, pictures linked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions import text as tx

# Markup features and the pattern that counts each.
FEATURES = {
    "img": "(?i)<img\\b",
    "table": "(?i)<table\\b",
    "blockquote": "(?i)<blockquote\\b",
    "inline style=": "(?i)\\sstyle\\s*=",
    "<style> block": "(?i)<style\\b",
    "centred/aligned": "(?i)align\\s*=|text-align",
    "external link": "(?i)<a\\b[^>]*href=\"https?://",
    "heading in body": "(?i)<h[1-6]\\b",
    "pre/code": "(?i)<(?:pre|code)\\b",
}


def _filled(field: T.StructField) -> Column:
    here = F.col(field.name).isNotNull()
    return here & (F.size(field.name) > 0) if isinstance(field.dataType, T.ArrayType) else here


def coverage(df: DataFrame, key: str) -> DataFrame:
    """Rows holding each field, rows without a key, and repeats of one."""
    counts = df.agg(
        F.count(F.lit(1)).alias("(rows)"),
        F.count_if(F.col(key).isNull()).alias("(no key)"),
        (F.count(key) - F.count_distinct(key)).alias("(repeats)"),
        *[F.count_if(_filled(f)).alias(f.name) for f in df.schema.fields])
    return counts.unpivot([], counts.columns, "field", "n")


def markup(pages: DataFrame, html: str) -> DataFrame:
    """Per feature: pages showing it and occurrences, in one pass."""
    body = F.coalesce(F.col(html), F.lit(""))
    hits = [F.regexp_count(body, F.lit(p)).cast("bigint").alias(f"f{i}") for i, p in enumerate(FEATURES.values())]
    sums = pages.select(*hits).agg(*[
        F.struct(F.count_if(F.col(f"f{i}") > 0).alias("works"),
                 F.coalesce(F.sum(f"f{i}"), F.lit(0)).alias("total")).alias(f"f{i}")
        for i in range(len(FEATURES))])
    laid = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"f{i}.works").alias("works"),
                              F.col(f"f{i}.total").alias("total")) for i, name in enumerate(FEATURES)])
    return sums.select(F.inline(laid))


def image_hosts(pages: DataFrame, html: str) -> DataFrame:
    """Where pictures come from, by host; inline, packaged and odd ones apart."""
    src = pages.select(F.explode(tx.image_sources(F.col(html))).alias("src"))
    host = F.lower(F.try_parse_url("src", F.lit("HOST")))
    label = (
        F.when(F.col("src").rlike("(?i)^data:"), "(inline data: uri)")
        .when(~F.col("src").rlike("(?i)^https?:"), "(packaged in epub)")
        .otherwise(F.coalesce(F.regexp_replace(host, "^www\\.", ""), F.lit("(unparseable)"))))
    return src.groupBy(label.alias("host")).agg(F.count(F.lit(1)).alias("n"))


def class_vocabulary(pages: DataFrame, html: str) -> DataFrame:
    """How often each class occurs, a book converter's own left out."""
    return (
        pages.select(F.explode(tx.classes(F.col(html))).alias("class"))
        .where(~F.col("class").startswith("calibre"))
        .groupBy("class").agg(F.count(F.lit(1)).alias("n")))


def needs_skin(chapters: DataFrame) -> DataFrame:
    """Works whose markup shows an author's own styling anywhere."""
    return chapters.select("work_id", tx.needs_skin(F.col("html")).alias("needs")).groupBy("work_id").agg(
        F.bool_or("needs").alias("needs_skin"))
