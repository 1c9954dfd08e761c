"""Vector code compression: products of parts by matrix products in float32, with error bounds that decide what int64 must settle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import by_value
from .common import Scratch, bounded_batches, with_hot

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components are this many units at most, so that squared distances fit in a long.
LARGEST = 1 << 26
#: Vectors assigned at once.
AT_ONCE = 1 << 13
by_value(__name__)


def integers(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that count (not null or empty, no null or non-finite component), and their floors of SCALE times each component."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    values, holes = flat.fill_null(np.nan).to_numpy(zero_copy_only=False), np.zeros(len(column), np.int64)
    rows = np.repeat(np.arange(len(column)), sizes)
    np.add.at(holes, rows[~np.isfinite(values)], 1)
    good = (holes == 0) & (sizes > 0)
    if not good.any():
        return np.flatnonzero(good), np.zeros((0, width or 0), np.int64)
    width = int(sizes[good][0]) if width is None else width
    if (sizes[good] != width).any() or not width or width % PARTS:
        raise ValueError(f"vectors must have one length that {PARTS} divides; found {sorted(set(sizes[good].tolist()))[:3]}, expected {width}")
    scaled = np.floor(values[good[rows]].reshape(-1, width) * SCALE)
    if np.abs(scaled).max(initial=0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}")
    return np.flatnonzero(good), scaled.astype(np.int64)


def nearest(vectors: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The index of the nearest entry of book (entries x d) to each of vectors (n x d), both int64; ties go to the lower one.

    Without the vector's own square, a distance is |c|^2 - 2 x.c. A float32 product is off by no more than
    g |x| |c|, with g = (d + 4) u / (1 - (d + 4) u) for the roundings of both inputs, d products and sums in any
    order (u = 2^-24); |c|^2 and the subtraction add g more of their size. So each float32 value stands for an
    interval that surely holds the true one. Entries whose interval meets that of the least upper end are
    evaluated again in int64; often there is one, which needs nothing more."""
    d, u = vectors.shape[1], 2.0**-24
    g = np.float64((d + 4) * u / (1 - (d + 4) * u))
    single = book.astype(np.float32)
    squares = (book * book).sum(axis=1)
    product = (vectors.astype(np.float32) @ single.T).astype(np.float64)
    reach = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
    error = 1.001 * g * (2 * reach[:, None] * (np.sqrt(squares) * (1 + 1e-12))[None, :] + squares[None, :])
    value = squares - 2 * product
    rivals = value - error <= (value + error).min(axis=1)[:, None]
    best = rivals.argmax(axis=1)
    rows, entries = np.nonzero(rivals & (rivals.sum(axis=1) > 1)[:, None])
    if len(rows):
        apart = vectors[rows] - book[entries]
        exact = np.full((len(vectors), len(book)), np.iinfo(np.int64).max)
        exact[rows, entries] = (apart * apart).sum(axis=1)
        close = np.unique(rows)
        best[close] = exact[close].argmin(axis=1)  # the first of equals
    return best


def coded(vectors: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """Indexes (n x PARTS) of the nearest entries of each part's codebook."""
    parts = vectors.reshape(len(vectors), PARTS, -1)
    return np.stack([nearest(np.ascontiguousarray(parts[:, p]), books[p]) for p in range(PARTS)], axis=1) if len(vectors) else np.zeros((0, PARTS), np.int64)


def first_books(vectors: DataFrame, id_col: str, vector_col: str, entries: int) -> list[np.ndarray]:
    """The parts of the `entries` counting vectors of the smallest ids; null ids come last, equal ids by their components."""
    vector = F.col(f"`{vector_col}`")
    whole = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(vector) > 0)
    rows = vectors.where(whole).orderBy(F.col(f"`{id_col}`").asc_nulls_last(), vector).select(vector.alias("v")).limit(entries).collect()
    if not rows:
        return []
    _, found = integers(pa.array([r["v"] for r in rows], pa.list_(pa.float64())))
    return list(np.ascontiguousarray(found.reshape(len(found), PARTS, -1).transpose(1, 0, 2)))


def refined(vectors: DataFrame, vector_col: str, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry is the componentwise floor of its parts' mean; unused ones stay.

    A task gives one row of count and sum for each entry's component, however many vectors it has."""
    entries, width = books[0].shape
    bounded_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), np.int64)
        for batch in batches:
            _, found = integers(batch.column(0), PARTS * width)
            for at in range(0, len(found), AT_ONCE):
                some = found[at : at + AT_ONCE]
                codes, parts = coded(some, books), some.reshape(len(some), PARTS, width)
                for p in range(PARTS):
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(sums[p], codes[:, p], parts[:, p])
        cells = np.flatnonzero(np.repeat(counts.ravel() > 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.repeat(counts.ravel(), width)[cells]), pa.array(sums.ravel()[cells])], names=["cell", "n", "total"])

    cells = vectors.select(F.col(f"`{vector_col}`")).mapInArrow(run, "cell long, n long, total long")
    wide = T.DecimalType(38, 0)
    found = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast(wide)).alias("total")).collect()
    out = np.stack(books).ravel()
    for r in found:
        out[r["cell"]] = int(r["total"]) // r["n"]
    return list(out.reshape(PARTS, entries, width))


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """PARTS codebooks (entries x width, int64) after `rounds` rounds over all vectors; none if no vector counts."""
    books = first_books(vectors, id_col, vector_col, entries)
    for _ in range(rounds if books else 0):
        books = refined(vectors, vector_col, books)
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], id_col: str = "vec_id", vector_col: str = "embedding", others: tuple[str, ...] = ()) -> DataFrame:
    """id_col, others, code (bytes: an index a part) and error (squared distances summed over parts) of each vector that counts."""
    kept = [id_col, *others]
    bounded_batches(vectors.sparkSession)
    fields = [T.StructField(f"c{i}", vectors.schema[c].dataType) for i, c in enumerate(kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = PARTS * books[0].shape[1] if books else None
        for batch in batches:
            rows, found = integers(batch.column(len(kept)), width)
            codes = np.zeros((len(found), PARTS), np.int64)
            errors = np.zeros(len(found), np.int64)
            for at in range(0, len(found), AT_ONCE):
                some = found[at : at + AT_ONCE]
                codes[at : at + AT_ONCE] = coded(some, books)
                parts = some.reshape(len(some), PARTS, -1)
                for p in range(PARTS):
                    errors[at : at + AT_ONCE] += ((parts[:, p] - books[p][codes[at : at + AT_ONCE, p]]) ** 2).sum(axis=1)
            taken = [c.take(pa.array(rows)) for c in batch.columns[: len(kept)]]
            packed = pa.array([bytes(c) for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*taken, packed, pa.array(errors)], names=[*[f.name for f in fields], "code", "error"])

    schema = T.StructType([*fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    plain = vectors.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{vector_col}`").alias("v"))
    found = plain.mapInArrow(run, schema)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "code", "error")


def decode(codes: DataFrame, books: list[np.ndarray], code_col: str = "code", out: str = "approximation") -> DataFrame:
    """codes with `out`: the doubles that a code (bytes of encode()) stands for, its entries over SCALE."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for entry in book.tolist()]) for book in books])
    at = lambda p: F.conv(F.hex(F.substring(F.col(f"`{code_col}`"), p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn(out, F.flatten(F.array(*[F.get(F.get(entries, F.lit(p)), at(p)) for p in range(len(books))])))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id_col, code (two hex digits a part), error, label_error and codebooks_sha256 of each vector that counts.

    Vectors that are null or empty or hold null or non-finite components are dropped. Components become floors of SCALE
    times their value; every part position has a codebook of `entries` (256 at most), begun with the vectors of
    the smallest ids (fewer if there are fewer; null ids last, equal ids by their components) and refined in
    `rounds`. label_error sums error over rows of one label, nulls together. Repeated rows count and are
    returned as often as they come; no vectors give no rows. Vectors of unlike lengths, of a length that PARTS
    does not divide, or with components beyond LARGEST / SCALE raise ValueError. Other columns do not matter.

    The vectors are read once a round; a round brings one number for each entry's component to the driver."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has 1 to 256 entries")
    books = fit_codebooks(vectors, id_col, vector_col, entries, rounds)
    plain = vectors.select(F.col(f"`{id_col}`").alias("id"), F.to_json(F.struct(F.col(f"`{label_col}`").alias("x"))).alias("group"), F.col(f"`{vector_col}`").alias("v"))
    keep = Scratch(vectors.sparkSession, "vectors")
    codes = keep.table(encode(plain, books, "id", "v", ("group",)), "codes")
    groups = keep.table(codes.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("size")), "groups")
    digest = F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    return with_hot(codes, ["group"], groups, "size", ["label_error"]).select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", digest)
