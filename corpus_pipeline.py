"""From raw documents to packed sequences: five stages, each written as a table and read again by the next."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import language, outliers, packing, simhash, suffix_dedup
from storyloom.llm.common import prepare, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of a passage that must repeat to be cut: fifty words and more are longer in any of the languages.
PASSAGE = 240
#: Tokens of a sequence.
SEQUENCE = 2048


#: The columns that stages work with; any others are carried along under names of their own.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def carried(work: Stage) -> Stage:
    """A stage whose operators never meet a name of their own among the further columns of a table."""
    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
        names = docs.columns
        out = work(prepare(spark), docs.toDF(*[c if c in KNOWN else f"further_{i}" for i, c in enumerate(names)]), root)
        return out.toDF(*names)
    return run


@carried
def with_language(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Drop documents without letters, and those that no learned language explains better than chance.

    Where no row carries a language nothing is learned, and all texts with letters stay.
    """
    labelled = language.label(docs, language.train(docs), docs.columns)
    return labelled.where("letters > 0 AND coalesce(evidence > 0, true)").select(*docs.columns)


@carried
def of_quality(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Drop documents that fail the base rules or lie far outside their language and source."""
    fits = outliers.fit(stored(outliers.counted(docs, []), "counted"))
    judged = outliers.judge(outliers.counted(docs, docs.columns), fits)
    return judged.where("_kept").select(*docs.columns)


@carried
def without_copies(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return simhash.one_of_each(docs, "doc_id", "text")


@carried
def without_passages(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Cut passages that stand elsewhere too out of the texts; documents of which nothing is left go."""
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = suffix_dedup.remove_repeats(docs, kept, length=PASSAGE, with_text=True)
    cut = cut.withColumn("text", F.col("kept_text")).where(F.col("text").rlike(r"\S"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Tokens of the documents in gapless sequences."""
    prepare(spark)
    pieces = packing.pieces(docs.select("doc_id", "text"), "doc_id", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, SEQUENCE)
    return packing.pack(pieces, SEQUENCE)


STAGES: list[tuple[str, Stage]] = [
    ("language", with_language), ("quality", of_quality), ("near_copies", without_copies),
    ("passages", without_passages), ("packing", packed)]

#: Robust estimates, fingerprints and token merges cannot be said in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, root: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = prepare(spark).read.parquet(f"{root}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, root), name)
    return STAGES[-1][1](spark, docs, root)
