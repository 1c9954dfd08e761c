"""Exact dedup: group by a 128-bit content hash, keep one stable id, tell collisions apart by the bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_hot


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the smallest id
    stays (keep="max": the largest). Rows that repeat an id and its text are one document: all of them
    say kept, and group_size counts each. A null id is never kept beside others; alone it keeps itself
    (keep_id null). Empty tables give no rows; other columns of docs do not matter.

    The aggregate is keyed by (hash, text): Spark's hash table compares the keys byte by byte, so two
    texts with one hash stay apart. It combines before the shuffle, so a hot text sends one row a task.
    Only (id, hash, sha256) goes back through a join; texts that many rows share are broadcast there, fewer
    than HOT of them. If two texts shared the content hash and the sha256 too, the query would stop rather
    than mix them up."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("hash", content_hash(F.col("text")))
    pick = F.max if keep == "max" else F.min
    texts = rows.groupBy("hash", "text").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = texts.select("hash", F.sha2("text", 256).alias("sha"), "keep_id", "group_size")
    collided = F.raise_error(F.lit("two texts share the content hash and the sha256"))
    groups = groups.groupBy("hash", "sha").agg(F.max("keep_id").alias("keep_id"), F.when(F.count("*") == 1, F.max("group_size")).otherwise(collided.cast("long")).alias("group_size"))
    members = rows.select("id", "hash", F.sha2("text", 256).alias("sha"))
    found = with_hot(members, ["hash", "sha"], materialize(groups, "texts"), "group_size", ["keep_id", "group_size"])
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
