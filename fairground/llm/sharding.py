"""Sharding: a uniform shuffle with exact shard sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, partitions, ranked, whole

#: The most blocks, and the most numbers of the matrix (blocks times shards): a few MB on the driver and in a broadcast.
MOST_BLOCKS, MOST_NUMBERS = 4096, 1 << 19
#: The share of all rows from which equal rows are numbered is one in so many.
HOT = 256


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many good ones are among draws from good + bad, at any size of these numbers.

    Weights go outward from the mode by the ratio of neighbours, 40 standard deviations far; what lies
    beyond has less weight than a double resolves."""
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = (draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1)) ** 0.5
    reach = int(40 * spread) + 40
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    fall = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([fall[::-1], [1.0], rise])
    at = int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right"))
    return mode - len(fall) + min(at, len(weights) - 1)


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard, with the law of a uniform permutation of all rows."""
    rng, left, matrix = np.random.default_rng(seed), list(shard_rows), []
    for rows in block_rows:
        sent, draws, pool = [], rows, sum(left)
        for capacity in left:
            pool -= capacity
            sent.append(hypergeometric(rng, capacity, pool, draws) if draws else 0)
            draws -= sent[-1]
        left = [a - b for a, b in zip(left, sent, strict=True)]
        matrix.append(sent)
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int = 24, seed: int = 42, blocks: int | None = None) -> DataFrame:
    """df with shard (0 to shards - 1; row counts differ by one at most) and slot (gapless from 0 in a shard).

    Every order of the rows is equally likely, up to the hash, and one seed gives one order. A row is dealt to a
    block by its hash, so a block holds the same rows whichever executors run; rows that more than a HOT-th of
    all equal are numbered first, by their places in a stored copy, and hashed with their numbers, so they
    spread too. In a block rows are put in random order (permute locally), the matrix says how many of them
    go to which shard (exchange), and there they are put in random order again. Nulls hash like other values,
    an empty table gives no rows, and columns called shard or slot already are kept, the new ones then take a
    leading underscore. Columns of map type can't be hashed and are not taken.

    The driver gets the counts of the blocks, MOST_BLOCKS at most, and fewer than HOT hashes. The matrix is
    broadcast: MOST_NUMBERS at most, or one block's where there are more shards than that. The assigned rows
    are stored too, because the ranks need the counts of the cells first."""
    spark = df.sparkSession
    blocks = max(1, min(MOST_BLOCKS, MOST_NUMBERS // shards, blocks or 4 * partitions(spark)))
    shard, slot = free_name(df, "shard"), free_name(df, "slot")
    stored = materialize(df.select(whole(df).alias("row")), "rows")
    hashed = stored.select("row", F.xxhash64("row").alias("hash"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("line"))
    same = hashed.groupBy("hash").count().where((F.col("count") > 1) & (F.col("count") * HOT > stored.count()))
    hot = F.col("hash").isin([r["hash"] for r in same.select("hash").collect()])
    numbered = ranked(hashed.where(hot).withColumn("cell", F.pmod(F.xxhash64("file"), F.lit(blocks)).cast("int")), "hash", "cell", ["file", "line"], "copy")
    rows = hashed.where(~hot).withColumn("copy", F.lit(0).cast("long")).unionByName(numbered)
    h = [F.xxhash64(F.lit(seed), F.lit(i), "row", "copy") for i in range(4)]
    rows = rows.select("row", F.pmod(h[0], F.lit(blocks)).cast("int").alias("block"), h[1].alias("first"), h[2].alias("second"), F.pmod(h[3], F.lit(blocks)).cast("int").alias("cell"))
    counts = dict(rows.groupBy("block").count().collect())
    total = sum(counts.values())
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], sizes, seed)
    ends = ", ".join(f"({b}, '{','.join(map(str, np.cumsum(sent).tolist()))}')" for b, sent in enumerate(matrix))
    sent = spark.sql(f"SELECT * FROM VALUES {ends} AS t(block, ends)").withColumn("ends", F.split("ends", ",").cast("array<bigint>"))
    local = F.row_number().over(Window.partitionBy("block").orderBy("first", "second")) - 1
    assigned = (
        rows.withColumn("at", local)
        .join(F.broadcast(sent), "block")
        .select("row", "second", "cell", F.size(F.filter("ends", lambda end: end <= F.col("at"))).alias("shard"))
    )
    out = ranked(materialize(assigned, "shards"), "shard", "cell", ["second"], "slot")
    return out.select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
