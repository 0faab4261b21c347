"""The operators of this package as named queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import bpe, kneser_ney, language, licenses, media, outliers, packing, periodic, rtree, rule_ensemble, simhash, stats, suffix_dedup, warc
from storyloom.llm.common import id_rest, stored, table


def op1_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Bytes of every whole text that stand in a 400-byte string found elsewhere too, and what stays."""
    return suffix_dedup.remove_repeats(table(spark, root, "documents"), ["doc_id"])


def op2_rules(spark: SparkSession, root: str) -> DataFrame:
    """Quality of every whole text by a rule ensemble fitted on labelled rows that are not held out."""
    counted = stored(stats.text_counts(table(spark, root, "documents"), ["doc_id"]), "counted")
    rows = counted.select("doc_id", (id_rest("doc_id", 5) == 0).alias("held_out"),
                          *[c.alias(n) for n, c in rule_ensemble.statistics().items()])
    labels = table(spark, root, "labels").select("doc_id", F.col("quality").alias("label"))
    model = rule_ensemble.train(rows.where("not held_out").join(labels, "doc_id"))
    scored = rows.select("doc_id", "held_out", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_media(spark: SparkSession, root: str) -> DataFrame:
    """Groups of copies and edits among pictures drawn from every page, with each picture's number of links."""
    pictures = media.pictures_of(table(spark, root, "pages"))
    return media.copies(pictures.select("media_id", "picture")).withColumn("page_id", F.floor(F.col("media_id") / 2))


def op4_warc(spark: SparkSession, root: str) -> DataFrame:
    """A WARC record for every page, written and read back, equal payloads as revisits of the first."""
    found = warc.read(warc.write(table(spark, root, "pages"), "page_id", "url", "html", least=0))
    return found.where("gap IS NULL").select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"))


def op5_language(spark: SparkSession, root: str) -> DataFrame:
    """Language of every whole text, learned from rows that are not held out."""
    docs = table(spark, root, "documents").withColumn("held_out", id_rest("doc_id", 4) == 2)
    model = language.train(docs.where("not held_out").select("text", "lang"))
    return language.label(docs, model, ["doc_id", "held_out"])


def op6_packing(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of every document's tokens, placed gapless in sequences of 2,048."""
    made = packing.pieces(table(spark, root, "documents"), "doc_id", public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.PATTERN, 2048)
    return packing.pack(made, 2048)


def op7_bpe(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every whole text and the text decoded from them, as digests."""
    return bpe.round_trip(table(spark, root, "documents"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op8_kneser_ney(spark: SparkSession, root: str) -> DataFrame:
    """Log probability of every whole text under a model of the rows that are not held out."""
    docs = table(spark, root, "documents").withColumn("held_out", id_rest("doc_id", 10) == 0)
    model = kneser_ney.train(docs.where("not held_out"))
    return kneser_ney.score(docs, model, ["doc_id", "held_out"])


def op9_simhash(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprint of every whole text and the smallest id reachable over links of two bits."""
    docs = table(spark, root, "documents")
    found = simhash.near_duplicates(docs, "doc_id", "text", k=3, seed=42, radius=2)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op10_outliers(spark: SparkSession, root: str) -> DataFrame:
    """Base counts and rules of every whole text, and whether it lies within its language and source."""
    counted = stored(outliers.counted(table(spark, root, "documents"), ["doc_id"]), "counted")
    judged = outliers.judge(counted, outliers.fit(counted))
    return judged.select(
        "doc_id", *[F.col(f"_s_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_distance").alias("distance"))


def op11_negatives(spark: SparkSession, root: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100, among all rows."""
    rows = table(spark, root, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_licenses(spark: SparkSession, root: str) -> DataFrame:
    """License wording of every whole text: places of four phrases, and labels of the templates that accept."""
    return licenses.scan(table(spark, root, "documents"), ["doc_id"])


def op13_periodic(spark: SparkSession, root: str) -> DataFrame:
    """Runs of repeated words in every whole text, a tenth of which first get a periodic end."""
    return periodic.runs(table(spark, root, "documents"), ["doc_id"], key="doc_id", made_periodic=True)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_rules": op2_rules,
    "op3_media": op3_media,
    "op4_warc": op4_warc,
    "op5_language": op5_language,
    "op6_packing": op6_packing,
    "op7_bpe": op7_bpe,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_simhash": op9_simhash,
    "op10_outliers": op10_outliers,
    "op11_negatives": op11_negatives,
    "op12_licenses": op12_licenses,
    "op13_periodic": op13_periodic,
}

#: The digits of base 32, and its form of a SHA-1: five hex digits are four of its digits.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_OP4 = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}',
    ((('0x' || substr(hex, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

_OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row),
p AS (SELECT anchor, anchor_id, id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, place ORDER BY score DESC, id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT same
    AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def _places(phrase: str) -> str:
    words = phrase.split()
    return f"list_filter(range(len(w) - {len(words) - 2}), lambda i: w[i + 1:i + {len(words)}] = {words})"


#: The templates as regular expressions over the words, each with a blank after it.
_FOUND = [f"CASE WHEN regexp_matches(line, '{licenses.pattern(markup)}') THEN '{label}' END" for label, markup in licenses.TEMPLATES.items()]
_SHARES = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES).share
_OP12 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
l AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d),
p AS (SELECT doc_id, len(w) AS n_words, [{', '.join(_places(p) for p in licenses.PHRASES)}] AS places,
  list_filter([{', '.join(_FOUND)}], lambda x: x IS NOT NULL) AS found FROM l),
b AS (SELECT *, flatten(places) AS starts, list_filter([{', '.join(
    f"CASE WHEN len(places[{i + 1}]) > 0 THEN '{label}' END" for i, label in enumerate(licenses.PHRASES.values()))}],
  lambda x: x IS NOT NULL) AS base FROM p)
SELECT doc_id, n_words, len(starts) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, found))), ',') AS labels,
  CASE WHEN len(found) > 0 THEN 1.0::DOUBLE
    ELSE coalesce(list_max(list_transform(base, lambda x: MAP {_SHARES}[x])), 0.0)::DOUBLE END AS score
FROM b"""

#: SQL twins; where the method cannot be said in SQL, tests hold a brute-force version.
SQL: dict[str, str] = {"op4_warc": _OP4, "op11_negatives": _OP11, "op12_licenses": _OP12}
