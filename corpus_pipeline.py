"""From raw documents to packed ones: quality, toxicity, repeated lines, near-duplicates by fingerprints, packing.

The classifiers have no SQL, so neither has the pipeline; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.llm.bpe import token_counts
from fairground.llm.common import materialize, read
from fairground.llm.line_dedup import line_dedup
from fairground.llm.near import near_dedup
from fairground.llm.packing import pack
from fairground.llm.quality import fit_quality, with_quality
from fairground.llm.queries import GOOD, TOXIC
from fairground.llm.toxicity import fit_toxicity, with_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of at least GOOD quality."""
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return with_quality(docs, model).where(F.col("score") >= GOOD).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below TOXIC toxicity."""
    docs = docs.select(*COLUMNS)
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return with_toxicity(docs, model).where(F.col("score") < TOXIC).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one has; n_chars counts what is left."""
    cut = line_dedup(docs.select(*COLUMNS))
    return cut.select("doc_id", "text", "lang", "source", F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of similarity 0.8 or more over five-word shingles connect: the
    one with the smallest id. Candidates come from fingerprints of these shingles."""
    return near_dedup(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and place of every document, by the tokenizer's ids; texts stay where they are."""
    return pack(token_counts(docs.select("doc_id", "lang", "source", "n_chars", "text")), "n_tokens")


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("line_dedup", without_repeated_lines), ("near_dedup", without_near_copies), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
