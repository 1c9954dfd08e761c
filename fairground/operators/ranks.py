"""Global ranks and pages by number, without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def _dealt(df: DataFrame, order: list[str], slices: int | None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """df stored by ranges of `order`, with the number of each row's range; and (range, rows before it, its rows) of each.

    A number a range comes to the driver. Rows that are equal in `order` share a range: end it with an id."""
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()), "ranges")
    begins, total = [], 0
    for number, rows in sorted(dealt.groupBy("_slice").count().collect()):
        begins.append((number, total, rows))
        total += rows
    return dealt, begins


def _numbered(dealt: DataFrame, begins: list[tuple[int, int, int]], order: list[str], out: str) -> DataFrame:
    before = dealt.sparkSession.createDataFrame([(n, b) for n, b, _ in begins], "_slice int, _before long")
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return dealt.join(F.broadcast(before), "_slice").withColumn(out, F.col("_before") + within - 1).drop("_slice", "_before")


def global_ranks(df: DataFrame, order: list[str], out: str = "rank", slices: int | None = None) -> DataFrame:
    """df with `out`: gapless numbers from 0 in the order of these columns (ascending, nulls first).

    Rows are dealt to ranges by sampled bounds, counted by range, and numbered within each range on top of the
    rows before it, so no task sorts more than a range. Repeated rows get numbers of their own."""
    dealt, begins = _dealt(df, order, slices)
    return _numbered(dealt, begins, order, out)


def ranks_within(df: DataFrame, group: str, order: list[str], out: str = "rank", slices: int | None = None) -> DataFrame:
    """As global_ranks(), but numbers begin anew in each group; a group may hold any share of the rows.

    Groups are met once more, by their own first number: one narrow row a group."""
    ranked = materialize(global_ranks(df, [group, *order], "_rank", slices), "ranked")
    firsts = ranked.groupBy(F.col(group).alias("_group")).agg(F.min("_rank").alias("_first"))
    return ranked.join(firsts, F.col(group).eqNullSafe(F.col("_group"))).withColumn(out, F.col("_rank") - F.col("_first")).drop("_rank", "_first", "_group")


def page(df: DataFrame, order: list[str], number: int, size: int, slices: int | None = None, out: str = "rank") -> DataFrame:
    """The rows of one page (from 0) in that order, with their rank: only the ranges that it touches are sorted."""
    dealt, begins = _dealt(df, order, slices)
    low, high = number * size, (number + 1) * size
    touched = [(n, b, rows) for n, b, rows in begins if b < high and b + rows > low]
    rows = _numbered(dealt.where(F.col("_slice").isin([n for n, _, _ in touched])), touched, order, out)
    return rows.where(F.col(out).between(low, high - 1))
