"""SimHash near-dedup: fingerprints of word shingles, linked through multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..shipping import by_value
from .common import bounded_batches, materialize, with_hot

SHINGLE, SEED, DISTANCE, SEGMENTS = 3, 42, 3, 2
#: Row b: the eight bits of the byte b, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Shingles hashed at once, so that a very long text needs no array of its own length.
AT_ONCE = 1 << 18
by_value(__name__)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; one is set if it is set in over half of the shingles' hashes, repeats included.

    A-Z become lower case, words are runs of anything but space, tab, newline, VT, FF and CR. A text of
    fewer words than a shingle has is one shingle; one without words (or null) has fingerprint 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        to = min(n, at + AT_ONCE)
        last = ends[np.minimum(np.arange(at, to) + shingle, len(words)) - 1]
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), last.tolist(), strict=True)], dtype="<u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ BITS
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id_col and fp (the fingerprint's 64 bits as a long) of each row; whole texts."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long").select(F.col("id").alias(id_col), "fp")


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints fp that differ in 1 to distance bits.

    If they differ in d bits, one of the segments differs in d // segments bits at most: here 1 of 32. So
    each fingerprint looks its segments up in the table under their own value and under those one bit
    away. Of two values one bit apart, one has that bit clear, so only clear bits are tried: half the
    ball finds every pair. Each match is verified over all 64 bits. A fingerprint has no more links than
    its ball has members, whatever the size of the corpus, so rows stay in proportion to the input. Probes
    are many times the table they come from, which size estimates do not see: both sides are sorted and
    merged, neither is broadcast."""
    assert distance // segments <= 1 and 64 % segments == 0
    width = 64 // segments
    mask = (1 << width) - 1
    pieces = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit(mask)).alias("key")) for s in range(segments)])).alias("p")
    table = prints.select("fp", pieces).select("fp", "p.seg", "p.key")
    bits = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(width)]), lambda bit: F.col("key").bitwiseAND(bit) == 0)
    ball = F.concat(F.array(F.lit(0).cast("long")), bits) if distance >= segments else F.array(F.lit(0).cast("long"))
    probes = table.select(F.col("fp").alias("a"), "seg", F.col("key").alias("own"), F.explode(ball).alias("flip"), "key").select("a", "seg", (F.col("key").bitwiseOR(F.col("flip"))).alias("key"), (F.col("flip") == 0).alias("same"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = probes.join(table.withColumnRenamed("fp", "b").hint("merge"), ["seg", "key"]).where((apart <= distance) & (~F.col("same") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (smallest id that links reach) for each row.

    Rows with one fingerprint are one class, so copies cost nothing after the first shuffle; classes are
    linked when their fingerprints differ in `distance` bits or fewer. Null and empty texts have
    fingerprint 0 and are linked like any other. Null ids are never the smallest unless all are null.
    Repeated rows are returned as often as they come; other columns of docs do not matter."""
    marked = materialize(with_fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("size")), "classes")
    roots = components(links(classes.select("fp"), distance, segments))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", "size")
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(placed.join(lowest, "root").select("fp", "component_id", "size"), "named")
    return with_hot(marked, ["fp"], named, "size", ["component_id"]).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
