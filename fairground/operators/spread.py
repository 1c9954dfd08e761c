"""Meeting the values of a group though one group may hold any share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The share of all rows from which a group counts as hot is one in so many.
HOT = 4096


def with_hot(rows: DataFrame, keys: list[str], groups: DataFrame, size: str, values: list[str]) -> DataFrame:
    """rows and the values of their group (null where groups has none), though one group holds any share of the rows.

    groups: a stored table, one row for each of keys, with the number of its rows in `size`. A group that holds
    more than a HOT-th of all these rows is hot; there are fewer than HOT of them, so they are broadcast. Their
    rows need no join any more and are dealt by number instead of by key; all others meet their group by key."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT > total).select(*[F.col(k).alias(f"hot_{k}") for k in keys], F.struct(*values).alias("hot"))
    cold = groups.where(F.col(size) * HOT <= total).select(*[F.col(k).alias(f"cold_{k}") for k in keys], F.least(F.lit(-1).cast("long"), F.col(size)).alias("cold_at"), F.struct(*values).alias("cold"))
    # A group's cold_at is -1 as no size is less; a literal there would be taken out of the join's keys.
    same = lambda kind: [F.col(k) == F.col(f"{kind}_{k}") for k in keys]
    met = rows.join(F.broadcast(hot), same("hot"), "left").withColumn("at", F.when(reduce(and_, [F.col(k).isNotNull() for k in keys], F.col("hot").isNull()), -1).otherwise(F.monotonically_increasing_id()))
    found = met.join(cold, [F.col("at") == F.col("cold_at"), *same("cold")], "left")
    return found.select(*rows.columns, *[F.coalesce("hot", "cold")[v].alias(v) for v in values])
