"""SimHash near-dedup by similarity: wide fingerprints of five-word shingles, multi-index hashing, exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..shipping import by_value
from .common import Scratch, bounded_batches, free_name, sifted

SHINGLE, SEED, SIMILARITY = 5, 42, 0.8
#: A segment's ball: its value with up to FLIPS of its UNSURE least certain bits turned over.
UNSURE, FLIPS = 4, 2
BALL = [c for k in range(FLIPS + 1) for c in combinations(range(UNSURE), k)]
#: Bits of a complete fingerprint; segments are its first ones.
WIDE = 2048
#: The chance that two sets of similarity 0.8 meet nowhere, and standard deviations that their distance may exceed its mean by.
MISSED, SPREAD = 0.025, 3.0
#: Shingles whose bits are counted at once, and words whose hashes a task remembers.
AT_ONCE, REMEMBERED = 1 << 12, 1 << 18
#: Row b: the eight bits of the byte b, highest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)
_SALT, _ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
by_value(__name__)


def layout(documents: int) -> tuple[int, int]:
    """Bits of a segment, and segments, for so many documents.

    The width follows the logarithm of the table, so chance matches of a document stay few at any size. The
    chance that one segment's ball meets at similarity 0.8, where 15 % of the bits differ, falls by 0.87 with
    each bit (0.166 at 24 bits, by simulation of normal margins); the segments keep all of them at MISSED."""
    width = min(32, max(24, documents.bit_length() + 3))
    meets = 0.166 * 0.87 ** (width - 24)
    return width, math.ceil(math.log(MISSED) / math.log(1 - meets))


def close(a: str, b: str, similarity: float) -> Column:
    """Whether the rows' sizes n_a, n_b and complete fingerprints fp_a, fp_b allow that similarity.

    As many bits may differ as do in the mean for sets of that similarity and one size, and SPREAD deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = math.ceil(WIDE * share + SPREAD * math.sqrt(WIDE * share * (1 - share)))
    apart = sum((F.bit_count(F.get(f"fp_{a}", F.lit(i)).bitwiseXOR(F.get(f"fp_{b}", F.lit(i)))) for i in range(WIDE // 64)), F.lit(0))
    sizes = F.least(f"n_{a}", f"n_{b}") >= similarity * F.greatest(f"n_{a}", f"n_{b}") * (1 - 1e-9)
    return sizes & (apart <= most)


class ShingleSets:
    """Ascending distinct 64-bit hashes of the shingles of one text after another.

    A-Z become lower case, words are runs of anything but space, tab, newline, VT, FF and CR. A text of fewer
    words than a shingle has is one shingle; one without words (or null) has none. A word is hashed once while
    it is remembered; a shingle's hash chains those of its words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, SEED)
        hashes = np.array([known[w] for w in words], dtype=np.uint64)
        size = min(SHINGLE, len(words))
        chain = np.full(len(words) - size + 1, size, np.uint64)
        for j in range(size):
            chain = (chain ^ hashes[j : len(hashes) - size + 1 + j]) * _ODD[j]
            chain ^= chain >> np.uint64(31)
        return np.unique(chain * _ODD[SHINGLE])


def margins(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint how many more shingles have it set than clear."""
    words = WIDE // 64
    ones, columns = np.zeros(WIDE), np.arange(words * 8) * 256
    for at in range(0, len(hashes), AT_ONCE):
        mixed = (hashes[at : at + AT_ONCE, None] ^ _SALT[:words]) * _ODD[:words]
        mixed ^= mixed >> np.uint64(29)
        octets = (mixed * _ODD[words]).byteswap().view(np.uint8).reshape(-1, words * 8)
        ones += (np.bincount((octets + columns).ravel(), minlength=words * 2048).reshape(-1, 256).astype(np.float32) @ BITS).ravel()
    return (2 * ones - len(hashes)).astype(np.int64)


def segments_of(margin: np.ndarray, width: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The value of each segment of a fingerprint, and its UNSURE least certain bits as values."""
    parts = margin[: width * segments].reshape(segments, width)
    places = np.int64(1) << np.arange(width, dtype=np.int64)
    unsure = np.argsort(np.abs(parts), axis=1, kind="stable")[:, :UNSURE]
    return (parts > 0) @ places, places[unsure].ravel()


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a name of the row's id, text and other columns, and that column. Rows equal in all share it."""
    row = free_name(docs, "row")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    whole = F.concat(F.md5(F.to_json(F.struct(*others))), F.md5(F.coalesce("text", F.lit(""))), F.when(F.col("text").isNull(), "0").otherwise("1"))
    return docs.withColumn(row, whole), row


def sketches(rows: DataFrame, width: int, segments: int) -> DataFrame:
    """row, doc_id, copy (a digest of the shingle set), n (its size), fp (its fingerprint), keys and flips of its segments (none without words)."""
    bounded_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets()
        for batch in batches:
            copies, sizes, prints, keys, flips = [], [], [], [], []
            for text in batch.column(2):
                hashes = sets(text.as_py())
                margin = margins(hashes)
                key, flip = segments_of(margin, width, segments) if len(hashes) else ([], [])
                copies.append(hashlib.md5(hashes.tobytes()).digest())
                sizes.append(len(hashes))
                prints.append(np.packbits(margin > 0).view(np.int64))
                keys.append(key)
                flips.append(flip)
            arrays = [pa.array(copies, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, longs), pa.array(keys, longs), pa.array(flips, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["row", "doc_id", "copy", "n", "fp", "keys", "flips"])

    return rows.select("row", "doc_id", "text").mapInArrow(run, f"row string, doc_id {kind}, copy binary, n long, fp array<bigint>, keys array<bigint>, flips array<bigint>")


def bucket(segment: Column, key: Column) -> Column:
    """One number of a segment and a value of it."""
    return F.shiftleft(segment.cast("long"), 32).bitwiseOR(key)


def balls(classes: DataFrame, *more: str) -> DataFrame:
    """copy, these columns, bucket and owns (it is the segment's own value) for every value in the ball of each segment."""

    def probes(segment: Column) -> Column:
        flip = [F.get("flips", segment * UNSURE + i) for i in range(UNSURE)]
        return F.array(*[sum((flip[i] for i in c), F.lit(0).cast("long")) for c in BALL])

    segment = classes.select("copy", *more, "flips", F.posexplode("keys").alias("segment", "key"))
    turned = segment.select("copy", *more, "segment", "key", F.explode(probes(F.col("segment"))).alias("turned"))
    return turned.select("copy", *more, bucket(F.col("segment"), F.col("key").bitwiseXOR(F.col("turned"))).alias("bucket"), (F.col("turned") == 0).alias("owns"))


def likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of classes whose sizes and complete fingerprints allow that similarity."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = (classes.select(F.col("copy").alias(c), F.col("n").alias(f"n_{c}"), F.col("fp").alias(f"fp_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(close("a", "b", similarity)).select("a", "b")


def sets_of(asked: DataFrame, classes: DataFrame, rows: DataFrame, keep: Scratch) -> DataFrame:
    """copy and hashes, the whole shingle set, of each class asked for (copy), stored: its texts are read again."""
    wanted = keep.table(classes.join(asked, "copy", "left_semi").select("copy", F.col("best.row").alias("row")), "wanted")
    texts = sifted(rows.select("row", "text"), "row", wanted).join(wanted, "row").select("copy", "row", "text").dropDuplicates(["copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sets(t.as_py()).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], names=["copy", "hashes"])

    sets = keep.table(texts.select("copy", "text").mapInArrow(run, "copy binary, hashes array<bigint>"), "sets")
    keep.drop(wanted)
    return sets


def verified(near: DataFrame, classes: DataFrame, rows: DataFrame, similarity: float, keep: Scratch, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of near of that Jaccard similarity or more over their whole shingle sets (read again, unless given), stored."""
    near = keep.table(near, "close")
    made = None
    if sets is None:
        made = sets = sets_of(near.select(F.col("a").alias("copy")).union(near.select("b")).distinct(), classes, rows, keep)
    both = near.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    shared = F.size(F.array_intersect("left", "right"))
    found = keep.table(both.where(shared / (F.size("left") + F.size("right") - shared) >= similarity).select("a", "b"), "near")
    keep.drop(near, made)
    return found


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text and others) with one row of each group of near copies: the one with the smallest id.

    Two texts are near copies if their sets of five-word shingles have Jaccard similarity `similarity` or more;
    groups are what such pairs connect. Texts of one shingle set are one class from the first shuffle on, texts
    without words too. Null ids come after others; rows equal in all columns are one row; an empty table gives
    none; other columns stay as they are, whatever their names.

    Candidates: a segment's value is looked up under every value of its ball (multi-index hashing). A pair of
    similarity 0.8 is missed with chance MISSED, and with less above it. Each class is compared with the first
    of its own buckets, then with that of others in whose balls it is, unless one group holds both already, so
    a group costs as many pairs as it has members. Only classes that are then in another group than that first
    one are compared with the others of their bucket, once a pair, and of these only such pairs go on whose
    complete fingerprints are close and whose shared shingles can be enough: what no other class of such pairs
    has does not count. Each candidate is verified over the whole shingle sets. A `similarity` below SIMILARITY would
    need more segments than layout() gives and raises ValueError."""
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"a similarity from {SIMILARITY} to 1 is expected")
    keep = Scratch(docs.sparkSession, "near")
    rows, row = with_row(docs)
    named = rows.select(F.col(row).alias("row"), "doc_id", "text")
    width, segments = layout(docs.count())
    marked = keep.table(sketches(named, width, segments), "sketches")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    classes = keep.table(marked.groupBy("copy").agg(*[F.first(c).alias(c) for c in ("n", "fp", "keys", "flips")], best), "classes")
    keep.drop(marked)

    own = classes.select("copy", F.posexplode("keys").alias("segment", "key")).select("copy", bucket(F.col("segment"), F.col("key")).alias("bucket"))
    heads = keep.table(own.groupBy("bucket").agg(F.min("copy").alias("head")), "heads")
    pair = [F.col("head").alias("a"), F.col("copy").alias("b")]
    near = verified(likely(own.join(heads, "bucket").where(F.col("copy") != F.col("head")).select(*pair), classes, similarity), classes, named, similarity, keep)
    begun = classes.join(components(near), F.col("copy") == F.col("node"), "left").select("copy", "keys", "flips", F.coalesce("root", "copy").alias("root"))
    begun = keep.table(begun, "begun")
    first = heads.join(begun.select(F.col("copy").alias("head"), F.col("root").alias("first")), "head")
    star = balls(begun, "root").join(first.hint("merge"), "bucket").where(F.col("root") != F.col("first")).select(*pair)
    near = keep.table(near.unionByName(verified(likely(star, classes, similarity), classes, named, similarity, keep)), "near")
    roots = components(near)
    keep.drop(begun, heads)

    named_roots = F.coalesce("root", "copy").alias("root")
    placed = keep.table(classes.join(roots, F.col("copy") == F.col("node"), "left").select("copy", "n", "fp", "keys", "flips", named_roots), "placed")
    # Of a bucket whose owners are one group, only its owners and those of other groups are still of interest.
    owned = own.join(placed.select("copy", "root"), "copy").groupBy("bucket")
    shared = owned.agg(F.min_by("root", "copy").alias("first"), (F.min("root") < F.max("root")).alias("mixed"), F.count("*").alias("owners")).where("owners > 1").drop("owners")
    shared = keep.table(shared, "shared")
    entries = balls(placed, "root").join(shared.hint("merge"), "bucket").where(F.col("mixed") | F.col("owns") | (F.col("root") != F.col("first")))
    members = keep.table(entries.select("bucket", "copy", "owns", "root", (F.col("root") != F.col("first")).alias("apart")), "members")
    open_ = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    members = keep.table(members.join(open_, "bucket").join(placed.select("copy", "n", "fp"), "copy"), "open")
    side = lambda of, c: of.select("bucket", *[F.col(k).alias(f"{k}_{c}") for k in ("copy", "owns", "root", "apart", "n", "fp")])
    fits = (F.col("root_a") != F.col("root_b")) & close("a", "b", similarity)
    owners = members.where("owns")
    once = ~F.col("owns_b") | ~F.col("apart_b") | (F.col("copy_a") < F.col("copy_b"))
    more = side(owners.where("apart"), "a").join(side(members, "b"), "bucket").where(once & fits)
    more = more.unionByName(side(owners.where(~F.col("apart")), "a").join(side(members.where(~F.col("owns") & F.col("apart")), "b"), "bucket").where(fits))
    more = keep.table(more.select(F.least("copy_a", "copy_b").alias("low"), F.greatest("copy_a", "copy_b").alias("high")).distinct(), "likely")
    sets = sets_of(more.select(F.col("low").alias("copy")).union(more.select("high")).distinct(), classes, named, keep)
    alone = sets.select("copy", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("sets"), F.first("copy").alias("copy")).where("sets = 1").groupBy("copy").agg(F.count("*").alias("alone"))
    common = sets.select("copy", F.size("hashes").alias("n")).join(alone, "copy", "left").select("copy", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
    for c in ("low", "high"):
        more = more.join(common.select(F.col("copy").alias(c), F.col("n").alias(f"n_{c}"), F.col("common").alias(f"common_{c}")), c)
    # Two sets share no more than what the smaller number of shingles is that are not a class's alone.
    enough = F.least("common_low", "common_high") * (1 + similarity) >= similarity * (F.col("n_low") + F.col("n_high")) * (1 - 1e-9)
    more = verified(more.where(enough).select(F.col("low").alias("a"), F.col("high").alias("b")), classes, named, similarity, keep, sets)
    for c in "ab":
        more = more.join(placed.select(F.col("copy").alias(c), F.col("root").alias(f"root_{c}")), c)
    roots = components(more.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    last = placed.join(roots.toDF("root", "last"), "root", "left").select("copy", F.coalesce("last", "root").alias("root"))
    grouped = keep.table(classes.select("copy", "best").join(last, "copy").groupBy("root").agg(F.min("best").alias("best")), "grouped")
    keep.close(grouped)
    return rows.join(grouped.select(F.col("best.row").alias(row)), row, "left_semi").dropDuplicates([row]).drop(row)
