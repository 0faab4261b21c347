"""A library seen through a star schema of orders, lines and documents.

Orders stand for works, their lines for tags and authors, documents for the
chapters, and the event table for what readers did.  Everything is derived with
column arithmetic, so it grows with the tables it is read from.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.model import Library, SCHEMAS, evolve

CHALLENGE = "This is part of an ongoing challenge and will be revealed soon!"


# Declared, so that opening a table reads no file footers on the driver.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to as many tasks as the session asks for, if it does.

    A file of one row group is read by one task however large it is.  Where
    tables are written so, ``spark.storyloom.textTasks`` says how many tasks
    should share a table's texts; unset, tables are read as they lie.
    """
    tasks = df.sparkSession.conf.get("spark.storyloom.textTasks", None)
    return df.repartition(int(tasks)) if tasks else df


def _every(n: int, key: Column) -> Column:
    return key % n == 0


def _as_is(key: Column) -> Column:
    return key


def lines_by_order(spark: SparkSession, root: str, key: Callable[[Column], Column] = _as_is) -> DataFrame:
    """One pass over the lines: what a work needs from its own lines."""
    supplier = table(spark, root, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, root, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_shipdate")
    return (
        lines.join(supplier, lines.l_suppkey == supplier.s_suppkey, "left")
        .groupBy(key(F.col("l_orderkey")).alias("l_orderkey"))
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.count(F.lit(1)).cast("int").alias("n_lines"),
            F.max("l_shipdate").cast("date").alias("last_ship"),
            F.array_sort(F.collect_set("s_name")).alias("names"),
            F.every(F.col("l_suppkey") % 4 == 0).alias("all_blocked"),
        )
    )


def works(spark: SparkSession, root: str) -> DataFrame:
    return _works(spark, root, _as_is)


def works_dealt(spark: SparkSession, root: str) -> DataFrame:
    """The same rows, for a table stored by work: orders and lines meet by the name of the work, so that they come to lie by it."""
    return evolve(_works(spark, root, lambda key: key.cast("string")), SCHEMAS["works"])


def _works(spark: SparkSession, root: str, key: Callable[[Column], Column]) -> DataFrame:
    orders = table(spark, root, "orders").withColumn("_key", key(F.col("o_orderkey")))
    customer = table(spark, root, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    nation = table(spark, root, "nation").select("n_nationkey", "n_name")
    docs = table(spark, root, "documents").select(
        key(F.col("doc_id")).alias("doc_id"), F.lit(True).alias("has_doc"))
    base = (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
        .join(nation, F.col("c_nationkey") == nation.n_nationkey, "left")
        .join(lines_by_order(spark, root, key), F.col("_key") == F.col("l_orderkey"), "left")
        .join(docs, F.col("_key") == docs.doc_id, "left")
    )
    return base.selectExpr(
        "o_orderkey AS k", "CAST(o_orderdate AS date) AS pub", "*",
        "o_orderkey % 223 = 0 AS anonymous",
        "o_orderkey % 223 = 0 OR o_orderkey % 227 = 0 AS empty_story",
        "date_add(CAST(o_orderdate AS date), CAST(o_orderkey % 1000 AS int)) AS seen_on",
    ).selectExpr(
        "CAST(_key AS string) AS work_id",
        """CASE WHEN anonymous THEN NULL WHEN empty_story THEN 'Mystery Work'
           ELSE concat(if(k % 2 = 0, lower(c_mktsegment), c_mktsegment), ' of ', n_name, ' ', k % 97) END AS title""",
        "if(anonymous, array('Anonymous'), coalesce(names, CAST(array() AS array<string>))) AS authors",
        f"""CASE WHEN anonymous THEN '' WHEN k % 211 = 0 THEN '{CHALLENGE}'
            ELSE concat('A ', lower(o_orderpriority), ' story kept by ', c_name) END AS summary""",
        "o_orderpriority AS rating", "n_name AS language", "pub AS published", "last_ship AS updated",
        "if(k % 11 <> 0, date_add(pub, CAST(k % 400 AS int)), NULL) AS downloaded_at",
        "o_orderstatus = 'F' AS complete",
        "if(empty_story, 0L, CAST(qty * 100 AS bigint)) AS words",
        "if(k % 7 <> 0, n_lines, NULL) AS chapter_count",
        "CAST(if(o_orderstatus <> 'P', n_lines + k % 3, NULL) AS int) AS chapters_planned",
        "unix_timestamp(CAST(last_ship AS timestamp)) + k % 86400 AS updated_at",
        "if(k % 10 = 3, concat('.chat', k % 7, '{color:red}'), NULL) AS skin_css",
        "CASE k % 4 WHEN 0 THEN 'ao3' WHEN 1 THEN 'epub' ELSE 'listing' END AS source",
        "CAST(if(k % 5 <> 0, date_add(pub, CAST(k % 900 AS int)), NULL) AS timestamp) AS fetched_at",
        "k % 3 = 0 AS in_bookmarks", "k % 15 = 0 AS rec", "k % 4 = 0 AS in_history",
        """CASE WHEN k % 8 = 0 THEN date_format(seen_on, 'yyyy-MM-dd')
           WHEN k % 4 = 0 THEN date_format(seen_on, 'd MMM yyyy') END AS last_visited""",
        "if(k % 5 <> 0, k % 6, NULL) AS visits",
        "CAST(if(k % 5 <> 0, date_add(pub, 30), NULL) AS timestamp) AS visits_synced_at",
        "k % 17 = 0 AS kudos_given",
        "coalesce(has_doc, false) AS has_text",
        "if(k % 8 <> 0, k * 7 % 1000, NULL) AS kudos",
        "if(k % 9 <> 0, k * 3 % 200, NULL) AS bookmark_count",
        "if(k % 10 <> 0, k * 13 % 5000, NULL) AS hits",
        "NOT anonymous AND coalesce(all_blocked, false) AS hidden",
    )


def _lines_with_parts(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    lines = table(spark, root, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("work_id"), "p_brand", "p_type", "p_name", "l_returnflag", "l_linestatus")


def _tags_of(lines: DataFrame) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(col).alias("name"))
        for kind, col in (("fandom", "p_brand"), ("relationship", "p_type"),
                          ("freeform", "p_name"), ("warning", "l_returnflag"),
                          ("category", "l_linestatus"))])
    return lines.select("work_id", F.inline(pairs)).distinct()


def tags(spark: SparkSession, root: str) -> DataFrame:
    return _tags_of(_lines_with_parts(spark, root))


def tags_dealt(spark: SparkSession, root: str, parts: int | None = None) -> DataFrame:
    """The same rows, for who wants all of them or stores them by work: lines are dealt out by work, and a work's tags made and told apart where they come to lie."""
    lines = _lines_with_parts(spark, root)
    return evolve(_tags_of(lines.repartition("work_id") if parts is None else lines.repartition(parts, "work_id")), SCHEMAS["tags"])


def chapters(spark: SparkSession, root: str) -> DataFrame:
    docs = spread(table(spark, root, "documents").select("doc_id", "text"))
    return (
        docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .where(F.length(F.trim("line")) > 0)
        .select(
            (F.col("doc_id") * 1000000 + F.col("at") + 1).alias("id"),
            F.col("doc_id").cast("string").alias("work_id"),
            (F.col("at") + 1).cast("int").alias("number"),
            F.concat(F.lit("Chapter "), (F.col("at") + 1).cast("string")).alias("title"),
            F.concat(F.lit("<p>"), "line", F.lit("</p>")).alias("html"),
            F.col("line").alias("text"),
            tx.count_words(F.col("line")).alias("words"),
        )
    )


def _laid_on_works(raw: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        "value", k.alias("k"),
        (F.col("user_id") * 5 + k % 5).cast("string").alias("work_id"),
    )


def events(spark: SparkSession, root: str) -> DataFrame:
    """Reader events laid on works: about thirteen to a work at any scale."""
    return _laid_on_works(table(spark, root, "events"))


def event_stream(spark: SparkSession, root: str, per_batch: int = 1) -> DataFrame:
    """The same events as a file stream."""
    return _laid_on_works(
        spark.readStream.schema(TABLES["events"]).option("pathGlobFilter", "events*.parquet")
        .option("maxFilesPerTrigger", per_batch).parquet(root))


def reading(spark: SparkSession, root: str) -> DataFrame:
    return events(spark, root).groupBy("work_id").agg(*map(F.expr, (
        "CAST(max(if(event_type = 'click', k % 9 + 1, NULL)) AS int) AS chapter",
        "max(if(event_type = 'click', value, NULL)) AS offset",
        """CAST(max(CASE WHEN event_type = 'click' THEN k % 9
                WHEN event_type = 'purchase' AND k % 2 = 0 THEN 12 END) AS int) AS chapters_read""",
        "bool_or(event_type = 'purchase' AND k % 10 = 0) AS completed_before",
        "bool_or(event_type = 'signup' AND k % 4 = 0) AS marked_later",
        "max(if(event_type IN ('click', 'purchase'), ts, NULL)) AS updated_at",
        "max(if(event_type = 'error' AND k % 2 = 0, ts, NULL)) AS opened_at")))


def visits(spark: SparkSession, root: str) -> DataFrame:
    return events(spark, root).where("event_type = 'view'").select(
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("id"),
        "work_id", F.col("ts").alias("started_at"))


def bookmarked_by(spark: SparkSession, root: str) -> DataFrame:
    return (
        events(spark, root).where("event_type = 'purchase'")
        .groupBy(F.concat(F.lit("reader "), F.col("user_id").cast("string")).alias("person"), "work_id")
        .agg(F.min("ts").alias("at"))
    )


def deleted(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, root, "orders").where(k % 50 == 0).select(
        k.cast("string").alias("work_id"),
        F.concat(F.lit("Removed "), k.cast("string")).alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("at"))


def blocked(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "supplier").where(F.col("s_suppkey") % 4 == 0).select(
        F.col("s_name").alias("name"), F.lit("2024-01-01").cast("timestamp").alias("at"))


def chapter_versions(spark: SparkSession, root: str) -> DataFrame:
    """An earlier copy of every third document's chapters."""
    return chapters(spark, root).where(F.col("id") % 3 == 0).select(
        "work_id", "number", "title",
        F.concat(F.lit("<p>Earlier.</p>"), "html").alias("html"),
        F.concat(F.lit("Earlier. "), "text").alias("text"), "words",
        F.sha2(F.concat(F.lit("<p>Earlier.</p>"), "html"), 256).alias("content_hash"),
        F.lit("content").alias("reason"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("number") % 20).cast("int"))
        .cast("timestamp").alias("archived_at"))


def skin_versions(spark: SparkSession, root: str) -> DataFrame:
    """Up to four earlier skins for documents whose number is not a multiple of five."""
    docs = table(spark, root, "documents").select("doc_id").where("doc_id % 5 <> 0")
    turns = docs.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))).alias("i"))
    css = F.concat(F.lit(".v"), F.col("i").cast("string"), F.lit("{margin:"), (F.col("doc_id") % 9).cast("string"), F.lit("px}"))
    return turns.select(
        F.col("doc_id").cast("string").alias("work_id"), css.alias("skin_css"),
        F.sha2(css, 256).alias("skin_hash"),
        F.date_add(F.lit("2024-01-03").cast("date"), (F.col("i") * 5).cast("int"))
        .cast("timestamp").alias("archived_at"))


def images(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("page_id")
    return table(spark, root, "pages").select(
        k.cast("string").alias("work_id"), "url",
        F.when(~_every(6, k), F.sha2(F.concat(F.lit("picture "), (k % 40).cast("string")), 256)).alias("sha256"),
        F.lit("image/png").alias("mime"),
        F.when(~_every(7, k), F.encode(F.concat(F.lit("picture "), (k % 40).cast("string")), "UTF-8")).alias("bytes"),
        F.when(k % 3 == 0, "failed").otherwise("stored").alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + k * 3600).alias("fetched_at"))


_MAKERS = {
    "works": works, "tags": tags, "chapters": chapters,
    "chapter_versions": chapter_versions, "skin_versions": skin_versions,
    "images": images, "reading": reading, "visits": visits, "deleted": deleted,
    "bookmarked_by": bookmarked_by, "blocked": blocked,
}


def library(spark: SparkSession, root: str) -> Library:
    """The eleven tables, each planned only when an operator asks for it."""
    return Library(**{name: partial(_made, name, spark, root) for name in _MAKERS})


def _made(name: str, spark: SparkSession, root: str) -> DataFrame:
    return evolve(_MAKERS[name](spark, root), SCHEMAS[name])
