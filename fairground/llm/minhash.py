"""MinHash near-dedup: minima and maxima under each permutation of five-word shingles, banded; links confirmed on whole sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from ..shipping import by_value
from .common import Scratch, bounded_batches, drop_materialized, few, sifted, with_hot
from .near import ShingleSets

#: Permutations, each giving a minimum and a maximum; values of a band; least similarity in percent.
PERMUTATIONS, ROWS, SIMILARITY = 128, 8, 85
VALUES = 2 * PERMUTATIONS
BANDS = VALUES // ROWS
#: Standard deviations by which an estimate may fall short of the similarity, and the highest chance to share no band.
SPREAD, MISSED = 4.5, 0.005
#: Times that every class is compared with one class of each of its buckets before the rest of a bucket is.
TURNS = 3
#: Shingles hashed at once; sets that a tile's classes meet, or members of one bucket, that one task takes; classes of a tile.
AT_ONCE, CHUNK, TILE = 1 << 12, 1024, 64
_RANDOM = np.random.default_rng(42)
_XOR, _ODD = _RANDOM.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32), _RANDOM.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT, _MIX = _RANDOM.integers(0, 1 << 63, BANDS, dtype=np.uint64), _RANDOM.integers(0, 1 << 62, ROWS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
by_value(__name__)


def min_max(hashes: np.ndarray) -> np.ndarray:
    """VALUES numbers of a set of 64-bit hashes: its minima under the permutations, then its maxima.

    Each agrees for two sets with the chance of their Jaccard similarity; one product serves both ends."""
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(short), AT_ONCE):
        mixed = (short[at : at + AT_ONCE, None] ^ _XOR) * _ODD
        mixed ^= mixed >> np.uint32(16)
        np.minimum(low, mixed.min(axis=0), out=low)
        np.maximum(high, mixed.max(axis=0), out=high)
    return np.concatenate([low, high])


def bands_of(values: np.ndarray) -> np.ndarray:
    """One 64-bit bucket a band: its ROWS values and its number, mixed."""
    words, out = values.view(np.uint64).reshape(BANDS, ROWS // 2), _SALT.copy()
    for k in range(ROWS // 2):
        out = (out ^ words[:, k]) * _MIX[k]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def two_bits(values: np.ndarray) -> np.ndarray:
    """The signature with two bits a value, as longs: what unlike values share by chance is a quarter."""
    top = (values * np.uint32(0x9E3779B1)) >> np.uint32(30)
    return np.packbits(((top[:, None] >> np.array([1, 0], np.uint32)) & np.uint32(1)).astype(np.uint8).ravel()).view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (a digest of id and text), copy (a digest of the shingle set), n (its size), bands and bits of each row."""
    bounded_batches(docs.sparkSession)
    longs, kind = pa.list_(pa.int64()), docs.schema[id_col].dataType
    text = F.col(f"`{text_col}`")
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets()
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text in batch.column(2):
                hashes = sets(text.as_py())
                values = min_max(hashes) if len(hashes) else None
                row = (hashlib.md5(hashes.tobytes()).digest(), len(hashes), None if values is None else bands_of(values), None if values is None else two_bits(values))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), longs, longs), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "key", "copy", "n", "bands", "bits"])

    long_list = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", kind), T.StructField("key", T.StringType()), T.StructField("copy", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", long_list), T.StructField("bits", long_list)])
    return docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("key"), text.alias("text")).mapInArrow(run, schema)


def whole_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """copy and hashes, the whole shingle set, of each of wanted (copy, key; stored): key is a row that has it.

    Rows of one key have one text; they become one before the join, so that texts are shuffled once."""
    text = F.col(f"`{text_col}`")
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")))))
    texts = sifted(docs.select(key.alias("key"), text.alias("text")), "key", wanted).dropDuplicates(["key"]).join(wanted, "key").select("copy", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sets(t.as_py()).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], names=["copy", "hashes"])

    return texts.mapInArrow(run, "copy binary, hashes array<bigint>")


def may_link(similarity: int) -> Column:
    """Whether sizes n_a, n_b and two-bit signatures bits_a, bits_b allow the similarity.

    Sizes rule out exactly. Of unlike values 3 in 4 differ in two bits; as many may differ as do in the mean at
    this similarity, and SPREAD deviations."""
    differ = 0.75 * (1 - similarity / 100)
    most = math.ceil(VALUES * differ + SPREAD * math.sqrt(VALUES * differ * (1 - differ)))
    odd = [F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i))) for i in range(VALUES // 32)]
    apart = sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for x in odd), F.lit(0))
    return (F.least("n_a", "n_b") * 100 >= similarity * F.greatest("n_a", "n_b")) & (apart <= most)


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int, keep: Scratch) -> DataFrame:
    """Those pairs (a, b) of classes whose whole sets have that similarity.

    Classes a are put into tiles of about TILE; a set b comes once to each tile that has classes to meet it, not
    once a pair. What a tile meets is cut into chunks of about CHUNK sets, its own sets come once a chunk, so no
    task takes more. Sets (stored) of classes in no pair are sifted out before they are joined."""
    pairs = keep.table(pairs, "asked")
    firsts = keep.table(pairs.select("a").distinct(), "firsts")
    tile = F.pmod(F.xxhash64("a"), F.lit(math.ceil(firsts.count() / TILE) or 1)).alias("tile")
    asked = keep.table(pairs.groupBy(tile, "b").agg(F.collect_set("a").alias("those")), "asked")
    sizes = keep.table(asked.groupBy("tile").agg(F.count("*").alias("size")).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")), "chunks")
    sets = few(sets, "copy", firsts.union(pairs.select("b")), "a")
    dealt = with_hot(asked, ["tile"], sizes, "size", ["chunks"]).select("tile", "b", "those", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"))
    own = firsts.select("a", tile).join(sizes, "tile").select("a", "tile", "chunks")
    left = sets.join(own, sets["copy"] == own["a"]).select("a", "tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("hashes").alias("left"))
    both = dealt.join(sets.toDF("b", "right"), "b").join(left, ["tile", "chunk"]).where(F.array_contains("those", F.col("a")))
    shared = F.size(F.array_intersect("left", "right"))
    return both.where(shared * (100 + similarity) >= similarity * (F.size("left") + F.size("right"))).select("a", "b")


def mixed_buckets(members: DataFrame, placed: DataFrame, turn: int, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """members with their group's root; and the buckets that hold several groups, with their size and a head: a class picked anew each turn."""
    grouped = members.join(placed, "copy").select("bucket", "band", "copy", "root")
    head = F.min_by(F.struct("copy", "root"), F.xxhash64("copy", F.lit(turn))).alias("head")
    of = grouped.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), head, F.count("*").alias("size"))
    return grouped, keep.table(of.where("low <> high").select("bucket", "head", "size"), "mixed")


def merged(placed: DataFrame, links: DataFrame, keep: Scratch) -> DataFrame:
    """placed (copy, root) after links (a, b) have joined groups."""
    ends = [placed.select(F.col("copy").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    later = components(links.join(ends[0], "a").join(ends[1], "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    found = keep.table(placed.join(later.toDF("root", "later"), "root", "left").select("copy", F.coalesce("later", "root").alias("root")), "placed")
    drop_materialized(later)
    return found


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """id_col, n_shingles, component_id (smallest id that links reach) and kept for each row.

    Two rows are linked if 100 times the intersection of their shingle sets is `similarity` times the union or
    more; A-Z count as lower case, words are runs of anything but space, tab, newline, VT, FF and CR, and a text
    of fewer than five words is one shingle. Null texts and texts without words have no shingles and no links.
    Rows of one set are one class from the first shuffle on. Null ids are never the smallest unless all are null;
    repeated rows are returned as often as they come; an empty table gives an empty one; other columns do not
    matter, whatever their names.

    Candidates share a band of ROWS values. TURNS times each class is compared with one class of each of its
    buckets; only in buckets that then still hold several groups are classes of different groups compared with
    each other, once a pair, in chunks. There, shingles that no other such class has bound what two sets can
    share: this and the sizes rule out pairs exactly, two-bit signatures with a chance of some 1 in 100,000 to
    lose a link. All this is done with the classes of buckets that several share; the others only get their name
    at the end. A pair at the similarity itself shares no band with chance (1 - s^ROWS)^BANDS (1 in 26,000 at
    85), which must not exceed MISSED. What passes is confirmed on the whole sets."""
    if (1 - (similarity / 100) ** ROWS) ** BANDS > MISSED or similarity > 100:
        raise ValueError(f"{BANDS} bands of {ROWS} values do not find pairs of similarity {similarity} %")
    keep = Scratch(docs.sparkSession, "minhash")
    marked = keep.table(signed(docs, id_col, text_col), "marked")
    has_words = marked.where("n > 0").groupBy("copy")
    classes = keep.table(has_words.agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.min("key").alias("key"), F.min("id").alias("low"), F.count("*").alias("size")), "classes")

    rows = keep.table(marked.select("id", "copy", "n"), "rows")
    keep.drop(marked)

    own = classes.select("copy", F.posexplode("bands").alias("band", "bucket"))
    buckets = keep.table(own.groupBy("bucket").agg(F.count("*").alias("size"), F.lit(True).alias("shared")).where("size > 1"), "buckets")
    members = keep.table(with_hot(few(own, "bucket", buckets), ["bucket"], buckets, "size", ["shared"]).where("shared").drop("shared"), "members")
    theirs = keep.table(members.select("copy").distinct(), "theirs")
    several = keep.table(few(classes, "copy", theirs).join(theirs, "copy"), "several")
    alike = keep.table(classes.select("copy", "low", "size"), "alike")
    keep.drop(classes, buckets)
    sets = keep.table(whole_sets(docs, id_col, text_col, several.select("copy", "key")), "sets")

    placed = keep.table(several.select("copy", F.col("copy").alias("root")), "placed")
    for turn in range(TURNS):
        grouped, mixed = mixed_buckets(members, placed, turn, keep)
        star = with_hot(grouped, ["bucket"], mixed, "size", ["head"]).where(F.col("head.root") != F.col("root"))
        pairs = keep.table(star.select(F.col("head.copy").alias("a"), F.col("copy").alias("b")).distinct(), "stars")
        sides = {c: several.select(F.col("copy").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"}
        heads = keep.table(pairs.groupBy("a").agg(F.count("*").alias("size")).join(sides["a"], "a"), "heads")
        near = with_hot(pairs.join(sides["b"], "b"), ["a"], heads, "size", ["n_a", "bits_a"]).where(may_link(similarity)).select("a", "b")
        placed = merged(placed, confirmed(near, sets, similarity, keep), keep)

    grouped, mixed = mixed_buckets(members, placed, 0, keep)
    mixed = keep.table(mixed.select("bucket", F.col("head.root").alias("first"), F.col("size").alias("members"), "size"), "mixed")
    open_ = keep.table(with_hot(grouped, ["bucket"], mixed, "size", ["first", "members"]).where("members IS NOT NULL"), "open")
    keep.drop(members)
    shown = keep.table(several.join(open_.select("copy").distinct(), "copy").select("copy", "n", "bits", "bands"), "shown")
    for _ in range(2):  # without classes that cannot link, more shingles stand alone
        asked = few(sets, "copy", shown).join(shown.select("copy"), "copy").select("copy", F.explode("hashes").alias("hash"))
        alone = asked.groupBy("hash").agg(F.count("*").alias("sets"), F.first("copy").alias("copy")).where("sets = 1").groupBy("copy").agg(F.count("*").alias("alone"))
        shown = shown.select("copy", "n", "bits", "bands").join(alone, "copy", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
        shown = keep.table(shown.where(F.col("common") * 100 >= similarity * F.col("n")), "shown")

    tiles = F.ceil(F.col("members") / CHUNK).cast("int")
    dealt = open_.join(shown, "copy").withColumn("tiles", tiles)
    side = lambda of, c: of.select("bucket", "tile", "band", "first", *[F.col(k).alias(f"{k}_{c}") for k in ("copy", "root", "n", "bits", "bands", "common")])
    left = side(dealt.where("root <> first").withColumn("tile", F.pmod(F.xxhash64("copy"), "tiles").cast("int")), "a")
    right = side(dealt.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))), "b").drop("band", "first")
    once = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("first")) | (F.col("copy_a") < F.col("copy_b")))
    enough = F.least("common_a", "common_b") * (100 + similarity) >= similarity * (F.col("n_a") + F.col("n_b"))
    earlier = F.arrays_overlap(F.slice("bands_a", F.lit(1), F.col("band")), F.slice("bands_b", F.lit(1), F.col("band")))
    found = left.join(right, ["bucket", "tile"]).where(once & enough & may_link(similarity) & ~earlier)
    more = confirmed(found.select(F.col("copy_a").alias("a"), F.col("copy_b").alias("b")), sets, similarity, keep)
    last = merged(placed, more, keep)
    lowest = several.join(last, "copy").groupBy("root").agg(F.min("low").alias("component_id"))
    linked = last.join(lowest, "root").select("copy", "component_id")
    named = keep.table(alike.join(linked, "copy", "left").select("copy", "size", F.coalesce("component_id", "low").alias("component_id")), "named")
    keep.close(rows, named)
    placed = with_hot(rows, ["copy"], named, "size", ["component_id"])
    lowest = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), lowest.alias("component_id"), F.col("id").eqNullSafe(lowest).alias("kept"))
