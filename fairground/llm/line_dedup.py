"""Line dedup: windows of three lines that occur before are cut out where they occur again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, whole, with_hot

#: Lines of a window, and what a blank line has at most.
WINDOW, BLANK = 3, " \t\x0b\x0c\r"


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = WINDOW) -> DataFrame:
    """docs with text_col cut, and n_lines, removed_lines, removed_spans (such as "3-5,9-11", from 0).

    Lines end at newlines. A window is `lines` consecutive lines that are not blank (a blank line has nothing
    but spaces, tabs, VT, FF and CR); blank ones between them do not count and stay. Of equal windows, the
    first in the order (id, text hash, position) stays; every later one is cut, and overlapping cuts merge.
    So each distinct line of the corpus survives somewhere. A run of one line repeated shrinks to one
    window's head. Texts with fewer lines stay, a null text counts as empty and is returned as null, a
    document of which nothing is left has an empty text. Rows that repeat an id and its text are one
    document. Columns of docs stay; if docs has n_lines, removed_lines or removed_spans, the new ones take a
    leading underscore.

    Windows are hashed to 128 bits (md5), stored as narrow rows and counted with a combine before the shuffle,
    so a passage in a third of all documents is one row a task; in the join back, windows that many documents
    share are broadcast, fewer than HOT of them. Texts move once, by their document."""
    n_lines, removed_lines, removed_spans = (free_name(docs, c) for c in ("n_lines", "removed_lines", "removed_spans"))
    rows = docs.select(whole(docs).alias("row")).withColumn("body", F.coalesce(F.col("row")[text_col], F.lit("")))
    rows = rows.select("row", F.col("row")[id_col].alias("id"), F.xxhash64("body").alias("key"))
    parts = F.split(F.coalesce(F.col("row")[text_col], F.lit("")), "\n", -1)
    full = F.filter(F.transform("lines", lambda line, i: F.when(F.trim(line, F.lit(BLANK)) != "", i)), lambda i: i.isNotNull())
    at = rows.select("id", "key", parts.alias("lines")).select("id", "key", "lines", full.alias("at")).where(F.size("at") >= lines)

    def window(k):
        body = F.concat_ws("\n", *[F.get("lines", F.get("at", k + j)) for j in range(lines)])
        return F.struct(k.alias("k"), F.unhex(F.md5(body)).alias("hash"), F.slice("at", k + 1, lines).alias("covered"))

    windows = at.select("id", "key", F.explode(F.transform(F.sequence(F.lit(0), F.size("at") - lines), window)).alias("w")).select("id", "key", "w.*")
    windows = materialize(windows, "windows")
    place = F.struct("id", "key", "k")
    first = materialize(windows.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    later = with_hot(windows, ["hash"], first, "n", ["first"]).where(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")))
    cuts = later.select(F.col("id").alias("cut_id"), F.col("key").alias("cut_key"), F.explode("covered").alias("line")).groupBy("cut_id", "cut_key").agg(F.array_sort(F.collect_set("line")).alias("cut"))

    joined = rows.join(cuts, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("key") == F.col("cut_key")), "left")
    joined = joined.withColumns({"lines": parts, "cut": F.coalesce("cut", F.array().cast("array<int>"))})
    # Set differences hash their arguments, so a text of many lines and many cuts takes no more than linear time.
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cut"))
    left = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    heads = F.array_except(F.col("cut"), F.transform("cut", lambda i: i + 1))
    tails = F.array_except(F.col("cut"), F.transform("cut", lambda i: i - 1))
    spans = F.array_join(F.zip_with(heads, tails, lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))), ",")
    return joined.select(
        *[(F.when(F.size("cut") == 0, F.col("row")[c]).otherwise(left) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns],
        F.size("lines").cast("long").alias(n_lines),
        F.size("cut").cast("long").alias(removed_lines),
        spans.alias(removed_spans),
    )
