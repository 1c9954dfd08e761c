"""What the operators share: reading, shared storage and distributed ranks."""

from __future__ import annotations

import ctypes
import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.spread import HOT, with_hot
from ..storage import Scratch, drop_materialized, materialize, shared_dir, table_path, write_bytes

__all__ = ["HOT", "Scratch", "bounded_batches", "drop_materialized", "few", "free_name", "materialize", "partitions", "positional", "ranked", "read", "release_freed", "shared_dir", "sifted", "table_path", "whole", "with_hot", "write_bytes"]

#: Bytes of an Arrow batch sent to a Python worker, so that long texts do not add up: a task holds some of these,
#: outside the heap and as Python objects.
ARROW_BATCH_BYTES = 8 << 20
#: Bits of a sieve for each key that it holds, and at most (32 MB; beyond, only more rows pass that are not wanted).
SIEVE_BITS, SIEVE_MOST = 16, 1 << 28


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def release_freed() -> None:
    """Give memory that this process has freed back to the system. Else glibc keeps it below any block in use, for as long as the driver runs."""
    if sys.platform.startswith("linux") and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: str, cell: str, order: list[str], out: str) -> DataFrame:
    """df without cell, and out: gapless ranks from 0 within each group, in the order of (cell, order), without a task per group.

    df has no columns but those that its operator made. Each (group, cell) is sorted alone and shifted by the
    rows of the cells before it, so a group of any size spreads over its cells. df is read twice and must give
    the same rows both times (a stored table). The offsets are broadcast: groups times cells rows, both bounded
    by the caller."""
    before = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(group, cell).agg(F.count("*").alias("n")).select(group, cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(group, cell).orderBy(*order)
    return df.join(F.broadcast(offsets), [group, cell]).withColumn(out, F.col("before") + F.row_number().over(within) - 1).drop("before", cell)


def sifted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose key is not in wanted (a stored table with that column); all others stay.

    For a join with wanted: long rows that it would not keep are not shuffled. The sieve is one bit for each hash of
    a key, broadcast as bitmaps of 4,096 bytes; it holds SIEVE_BITS bits a key and never more than SIEVE_MOST."""
    bits = min(SIEVE_MOST, SIEVE_BITS * max(1, wanted.count()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    cell, at = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1)).cast("int")
    sieve = wanted.groupBy(cell.alias("_cell")).agg(F.bitmap_construct_agg(at).alias("_bitmap"))
    octet = F.conv(F.hex(F.substring("_bitmap", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    holds = F.getbit(octet, at.bitwiseAND(F.lit(7))) == 1
    return rows.join(F.broadcast(sieve), cell == F.col("_cell")).where(holds).select(*rows.columns)


def few(rows: DataFrame, key: str, wanted: DataFrame, of: str | None = None) -> DataFrame:
    """rows sifted by wanted's column `of` (the key's name if none is given) for a join that keeps few of them."""
    return sifted(rows, key, wanted.select(F.col(of or key).alias(key)))


def whole(df: DataFrame) -> Column:
    """All columns of df as one struct, so that an operator's own columns beside it clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def positional(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns as c0, c1, ...: functions over Arrow batches take no names with dots. toDF() gives the names back."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
