"""Packing: length buckets of least padding, and batches under a token budget inside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, partitions, ranked, whole

BUCKETS, BUDGET, CELLS = 16, 65536, 4096


def optimal_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length ranges, such that padding every length up to its bound is least.

    histogram: distinct lengths and their counts. The least cost with k buckets over the first j lengths
    is a minimum over lines in the length, whose slopes fall as j grows, so each layer of the dynamic
    programme is one sweep along a lower envelope: buckets times lengths steps, in exact integers."""
    lengths, counts = zip(*sorted(histogram), strict=True) if histogram else ((), ())
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    rows = [0]
    for c in counts:
        rows.append(rows[-1] + c)
    # Padded total of the first j lengths; the true total of all is a constant and is left out.
    best = [0] + [lengths[j - 1] * rows[j] for j in range(1, n + 1)]
    cuts = []
    for _ in range(buckets - 1):
        envelope: list[int] = []
        head, now, cut = 0, [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            while len(envelope) - head >= 2:
                a, b = envelope[-2], envelope[-1]
                # b is never least if a and i cross before b takes over from a.
                if (best[i] - best[a]) * (rows[b] - rows[a]) <= (best[b] - best[a]) * (rows[i] - rows[a]):
                    envelope.pop()
                else:
                    break
            envelope.append(i)
            x = lengths[j - 1]
            while len(envelope) - head >= 2 and best[envelope[head + 1]] - x * rows[envelope[head + 1]] <= best[envelope[head]] - x * rows[envelope[head]]:
                head += 1
            i = envelope[head]
            now[j], cut[j] = best[i] + x * (rows[j] - rows[i]), i
        best = now
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if not j:
            break
        bounds.append(lengths[j - 1])
        j = cut[j]
    if j:
        bounds.append(lengths[j - 1])
    return sorted(bounds)


def word_count(text: Column) -> Column:
    """Words of a text, runs of anything but space, tab, newline, VT, FF and CR; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def pack(df: DataFrame, length: str, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 42) -> DataFrame:
    """df with bucket (from 0), padded_length, batch (from 0 in its bucket) and slot (from 0 in its batch).

    length: a column of non-negative integers (null: 0). Bounds minimise the padding of all rows over the
    exact global histogram. A batch of bucket b holds budget // bound rows, at least one, in random order,
    so its padded tokens stay within the budget unless one row alone is longer. Equal rows are
    interchangeable, an empty table gives no rows, and where df has one of the new names, the new column
    takes a leading underscore.

    The histogram comes to the driver: a row for each distinct length, no more than the longest length in
    tokens. A bucket of any share of the rows is ranked over cells, not in one task."""
    spark = df.sparkSession
    names = {c: free_name(df, c) for c in ("bucket", "padded_length", "batch", "slot")}
    cells = min(CELLS, 4 * partitions(spark))
    cols = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(whole(df).alias("row"), F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0)).alias("length"), F.xxhash64(F.lit(seed), *cols).alias("order"), F.pmod(F.xxhash64(F.lit(seed + 1), *cols), F.lit(cells)).cast("int").alias("cell"))
    rows = materialize(rows, "packing")
    bounds = optimal_bounds([tuple(r) for r in rows.groupBy("length").count().collect()], buckets)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    placed = rows.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("length"))))
    out = ranked(placed, "bucket", "cell", ["order"], "rank")
    bound = F.get(limits, F.col("bucket"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(bound, F.lit(1)))).cast("long")
    placed_at = {"bucket": F.col("bucket"), "padded_length": bound, "batch": F.floor(F.col("rank") / room).cast("long"), "slot": F.pmod(F.col("rank"), room).cast("long")}
    return out.select("row.*", *[made.alias(names[c]) for c, made in placed_at.items()])
