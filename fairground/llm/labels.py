"""Labelled rows for the classifiers, and scores beside the rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import by_value
from .common import bounded_batches, free_name, materialize, positional

#: Rows whose remainder is this are held out: no classifier learns from them.
HELD_OUT, FOLDS = 2, 4
by_value(__name__)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 4; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, balanced: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, y, fold, weight of at most `most` labelled rows of docs that are not held out.

    Labels that repeat an id are averaged (1 from a half on); null ids and null labels are left out. An id
    counts once: of several texts the least. Rows are taken by a hash of the id, so the sample does not
    depend on the order or the partitions. balanced: at most half from each label, with weights that restore
    the shares that the labels have in docs. The ids taken are broadcast: `most` of them, whatever the size
    of the tables."""
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y")).withColumn("fold", fold("id")).where(F.col("fold") != HELD_OUT)
    marks = materialize(docs.select(F.col(id_col).alias("id")).distinct().join(marks.hint("merge"), "id"), "labelled")
    at = F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1)) / F.lit(float(1 << 63))

    def first(rows: DataFrame, n: int, most: int) -> DataFrame:
        """The first `most` of n rows by their hash; few more than these are sorted."""
        likely = rows.where(at < (most + 6 * most**0.5 + 10) / n) if n > most else rows
        return likely.orderBy(at, "id").limit(most).withColumn("weight", F.lit(max(1.0, n / most) if balanced else 1.0))

    totals = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if balanced:
        parts = [first(marks.where(F.col("y") == y), n, most // 2) for y, n in sorted(totals.items())]
        taken = parts[0].unionByName(parts[1]) if len(parts) == 2 else (parts or [marks.withColumn("weight", F.lit(1.0))])[0]
    else:
        taken = first(marks, sum(totals.values()), most)
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(taken), "id")
    return found.groupBy("id", "y", "fold", "weight").agg(F.min("text").alias("text")).select("id", "text", "y", "fold", "weight")


def with_score(docs: DataFrame, score: Callable[[list[str | None]], np.ndarray], out: str, text_col: str = "text") -> DataFrame:
    """docs and, last, the column `out`: score() of each whole text, in Arrow batches of bounded bytes.

    Where docs has a column of that name, it stays and the new one takes a leading underscore."""
    bounded_batches(docs.sparkSession)
    out = free_name(docs, out)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(np.asarray(score(batch.column(at).to_pylist()), dtype=np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.names)

    schema = T.StructType([T.StructField(f"c{i}", kind) for i, kind in enumerate([*(f.dataType for f in docs.schema.fields), T.DoubleType()])])
    return positional(docs, docs.columns).mapInArrow(run, schema).toDF(*docs.columns, out)
