"""What download jobs came to, and what a diagnostics journal tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators.ordered import previous

JOURNAL = T.StructType([
    T.StructField("schema", T.IntegerType()), T.StructField("timeMs", T.LongType()),
    T.StructField("elapsedMs", T.LongType()), T.StructField("session", T.StringType()),
    T.StructField("pid", T.LongType()), T.StructField("event", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.DoubleType())),
])
TICK_GAP_MS = 15_000

# What an error text is called, first match wins.
FAILURES = (
    ("525", "AO3 secure connection failed (525)"),
    ("cloudflare verification", "Archive verification required"),
    ("404|does not exist|has been deleted", "Unavailable on the archive"),
    ("restricted|sign in|login|401|403", "May need archive sign-in"),
    ("429|rate limit|too many requests", "Archive rate limit"),
    ("5\\d\\d", "Archive temporarily unavailable"),
    ("could not reach|network|offline|timed? ?out", "Connection failed"),
)
OTHER_FAILURE = "Could not download"
# Whether an error is worth another try, first match wins.
RETRYABLE = (
    ("answered (429|408|425)", True),
    ("rate limit|too many requests|retry.?after|slow down", True),
    ("answered 4\\d\\d", False),
    ("deleted|does not exist|no chapters found", False),
    ("answered 5\\d\\d|could not reach|timed out|timeout|network|failed to fetch", True),
    ("unable to resolve host|no address associated|unknownhost|enotfound|eai_again", True),
    ("connection (reset|refused|abort|closed)|econnreset|econnrefused|econnaborted", True),
    ("unexpected end of stream|broken pipe|software caused connection abort", True),
    ("sslexception|handshake|socketexception|sockettimeout|protocol error", True),
)


def _first_match(error: Column, rules: tuple, otherwise: object) -> Column:
    said = F.coalesce(error, F.lit(""))
    out = None
    for pattern, value in rules:
        hit = said.rlike(f"(?i){pattern}")
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def failure_class(error: Column) -> Column:
    return _first_match(error, FAILURES, OTHER_FAILURE)


def is_transient(error: Column) -> Column:
    return _first_match(error, RETRYABLE, False)


def failures(items: DataFrame) -> DataFrame:
    """Failed items by what went wrong and whether to try again."""
    return (
        items.where(F.col("state") == "failed")
        .groupBy(failure_class(F.col("error")).alias("failure"), is_transient(F.col("error")).alias("transient"))
        .agg(F.count(F.lit(1)).alias("n")))


def job_rollup(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job: how many items there are, arrived, failed, stopped or wait.

    ``jobs`` carries what older records knew only as numbers: legacy_added,
    legacy_failed, was_total, and whether its item history is whole.
    """
    per = items.groupBy("job").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("state").isin("downloaded", "version")).alias("ok"),
        F.count_if(F.col("state") == "failed").alias("bad"),
        F.count_if(F.col("state") == "stopped").alias("off"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    added = zero("ok") + zero("legacy_added")
    failed = zero("bad") + zero("legacy_failed")
    known = zero("items") + zero("legacy_added") + zero("legacy_failed")
    total = F.when(F.coalesce("history_complete", F.lit(False)), zero("items")).otherwise(
        F.greatest(zero("was_total"), known))
    return jobs.join(per, "job", "left").select(
        "job", "state", total.alias("total"), added.alias("added"), failed.alias("failed"),
        zero("off").alias("stopped"), (added + failed).alias("done"),
        F.greatest(F.lit(0), total - added - failed - zero("off")).alias("waiting"))


def queue_status(jobs: DataFrame, cool_minutes: int = 0) -> DataFrame:
    """One line on the whole queue.

    ``jobs`` has (state, added, failed, stopped, unfinished, issue, retrying).
    """
    n = lambda c: F.coalesce(c, F.lit(0))
    sums = jobs.agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("state").isin("running", "queued", "listing")).alias("active"),
        F.count_if(F.col("state").isin("paused", "pausing")).alias("paused"),
        F.count_if(F.col("state") == "cancelled").alias("cancelled"),
        F.coalesce(F.sum(F.greatest(n("failed"), n("unfinished")) + n("stopped")), F.lit(0)).alias("missing"),
        F.count_if(F.col("issue")).alias("issues"), F.coalesce(F.sum(n("added")), F.lit(0)).alias("added"),
        F.coalesce(F.bool_or(F.col("retrying") & F.col("state").isin("running", "queued", "listing")), F.lit(False)).alias("retrying"))
    active, paused = F.col("active") > 0, F.col("paused") > 0
    wrong = (F.col("missing") > 0) | (F.col("issues") > 0)
    title = (
        F.when(active & F.lit(cool_minutes > 0), "Waiting for the archive")
        .when(active & F.col("retrying"), "Retrying a request")
        .when(active, "Downloads in progress").when(paused, "Downloads paused")
        .when(wrong, "Some works still need attention").when(F.col("cancelled") > 0, "Downloads stopped")
        .when(F.col("jobs") > 0, "Up to date with this queue").otherwise("Nothing downloading"))
    return sums.select(
        title.alias("title"), "active",
        F.when(active | paused, F.col("paused")).otherwise(F.lit(0)).alias("paused"),
        "added", "missing", "issues")


# --- journal ------------------------------------------------------------------

def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal files of JSON lines; a line cut short is left out."""
    return spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path)


def parse_journal(lines: DataFrame, column: str) -> DataFrame:
    """The same from a column of lines."""
    record = F.from_json(column, JOURNAL, {"mode": "PERMISSIVE"})
    whole = F.regexp_like(F.trim(F.col(column)), F.lit("^\\{.*\\}$"))
    return (lines.where(whole).select(record.alias("r"))
            .where(F.col("r.event").isNotNull() & F.col("r.session").isNotNull()).select("r.*"))


def _number(name: str) -> Column:
    return F.element_at("data", F.lit(name)).cast("bigint")


def request_pairs(journal: DataFrame) -> DataFrame:
    """Each request's start with its end; without one it is still pending."""
    key = ["session", "request"]
    tell = journal.withColumn("request", _number("request"))
    starts = tell.where(F.col("event") == "request_start").groupBy(*key).agg(F.min("elapsedMs").alias("started_ms"))
    ends = tell.where(F.col("event") == "request_end").groupBy(*key).agg(
        F.min_by(F.struct("elapsedMs", _number("outcome").alias("outcome"), _number("bytes").alias("bytes")),
                 "elapsedMs").alias("end"))
    return starts.join(ends, key, "left").select(
        *key, "started_ms", (F.col("end.elapsedMs") - F.col("started_ms")).alias("took_ms"),
        F.col("end.outcome").alias("outcome"), F.col("end.bytes").alias("bytes"),
        F.col("end").isNull().alias("pending"))


def tick_gaps(ticks: DataFrame, gap_ms: int = TICK_GAP_MS, slice_ms: int = 3_600_000) -> DataFrame:
    """Ticks that came more than ``gap_ms`` after the one before them.

    ``ticks`` has (session, elapsedMs).
    """
    cut = F.floor(F.col("elapsedMs") / slice_ms)
    seen = previous(ticks, ["session"], ["elapsedMs"], "elapsedMs", cut, "before")
    gap = F.col("elapsedMs") - F.col("before")
    return seen.where(gap > gap_ms).select("session", "elapsedMs", gap.alias("gap_ms"))
