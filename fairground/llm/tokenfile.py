"""Token-ID output: files of Simple-8b coded ids with the places of blocks, and their readers."""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import by_value
from .bpe import IdCoder, WordBpe, remembered, vocabulary_path
from .common import bounded_batches, partitions, table_path

#: Values in a word and bits of each, by selector from 2 on; selector 0: the next word is one value of 64
#: bits; selector 1: 120 zeros.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ZEROS, ESCAPE, ALL_ZERO, FIRST = 120, 0, 1, 2
#: Values of a block at most; a document starts a block.
BLOCK, MAGIC, TAIL, END_ID = 4096, b"S8BT", "<IQQQ", 1
#: Bytes of text behind a file, about.
RANGE_BYTES = 256 << 20
by_value(__name__)


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned value."""
    out = np.zeros(len(values), np.uint8)
    rest = values
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(step)
        if big.any():
            out += big * np.uint8(step)
            rest = np.where(big, rest >> np.uint64(step), rest)
    return out + (rest > 0)


def pack(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all values, and how many words each of the pieces that end at `ends` takes.

    Each word takes as many values as fit; no word crosses the end of a piece, where it may hold fewer.
    A value of over 60 bits is an escape and a word of its own."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    bits = widths(values)
    most = {1: bits}
    size = 1
    while size < ZEROS:
        wide = most[size].copy()
        wide[: n - size] = np.maximum(most[size][: n - size], most[size][size:]) if n > size else wide[: n - size]
        most[2 * size] = wide
        size *= 2

    def top(count: int) -> np.ndarray:
        """The widest of the `count` values from each place on; beyond the end there are none."""
        half = 1 << (count.bit_length() - 1)
        wide = most[half].copy()
        shift = count - half
        if shift and n > shift:
            wide[: n - shift] = np.maximum(wide[: n - shift], most[half][shift:])
        return wide

    selector = np.zeros(n, np.uint8)
    step = np.ones(n, np.int64)
    for s, count in reversed(list(enumerate(COUNTS, FIRST))):
        fits = top(count) <= 60 // count
        selector[fits], step[fits] = s, count
    zero = top(ZEROS) == 0
    selector[zero], step[zero] = ALL_ZERO, ZEROS
    pieces = np.searchsorted(ends, np.arange(n), side="right")
    take = np.minimum(step, ends[pieces] - np.arange(n)) if n else step
    jumps, starts, at = take.tolist(), [], 0
    while at < n:
        starts.append(at)
        at += jumps[at]
    starts = np.array(starts, np.int64)
    kinds, taken = selector[starts], take[starts]
    sizes = 1 + (kinds == ESCAPE)
    place = np.concatenate([[0], np.cumsum(sizes)])
    words = np.zeros(int(place[-1]), np.uint64)
    for s, count in enumerate(COUNTS, FIRST):
        mine = np.flatnonzero(kinds == s)
        if len(mine):
            where = starts[mine][:, None] + np.arange(count)
            inside = np.arange(count) < taken[mine][:, None]
            held = np.where(inside, values[np.minimum(where, n - 1)], np.uint64(0))
            shifts = (np.arange(count) * (60 // count)).astype(np.uint64)
            words[place[mine]] = np.bitwise_or.reduce(held << shifts, axis=1) | np.uint64(s) << np.uint64(60)
    words[place[:-1][kinds == ALL_ZERO]] = np.uint64(ALL_ZERO) << np.uint64(60)
    words[place[:-1][kinds == ESCAPE] + 1] = values[starts[kinds == ESCAPE]]
    used = np.bincount(pieces[starts], weights=sizes, minlength=len(ends)) if n else np.zeros(len(ends))
    return words, used.astype(np.int64)


def unpack(words: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of blocks that begin at `places` in words and hold `counts` values each, all at once.

    An escaped value is told from a selector by walking escapes only; other words need no walk."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    for at in np.flatnonzero(kinds == ESCAPE):
        if head[at] and at + 1 < len(words):
            head[at + 1] = False
    holds = np.array([1, ZEROS, *COUNTS])[kinds] * head
    before = np.concatenate([[0], np.cumsum(holds)])
    # Where each block's values begin if every word were full, and how many of them count.
    begin = before[places]
    out = np.zeros(int(counts.sum()), np.uint64)
    to = np.concatenate([[0], np.cumsum(counts)])
    block = np.searchsorted(places, np.arange(len(words)), side="right") - 1
    offset = before[:-1] - begin[block] if len(words) else before[:-1]
    for s, count in [(ESCAPE, 1), *enumerate(COUNTS, FIRST)]:
        mine = np.flatnonzero((kinds == s) & head)
        if not len(mine):
            continue
        if s == ESCAPE:
            found = words[mine + 1][:, None]
        else:
            wide = 60 // count
            found = words[mine][:, None] >> (np.arange(count) * wide).astype(np.uint64) & np.uint64((1 << wide) - 1)
        nth = offset[mine][:, None] + np.arange(count)
        inside = nth < counts[block[mine]][:, None]
        out[(to[block[mine]][:, None] + nth)[inside]] = found[inside]
    return out


def pack_documents(ids: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """For each document its words, and the words of each of its blocks."""
    if not ids:
        return []
    lengths = np.array([len(x) for x in ids])
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.concatenate([np.append(np.arange(1, b) * BLOCK, n) + a for a, b, n in zip(first[:-1], blocks, lengths, strict=True) if n] or [np.zeros(0, int)])
    words, used = pack(np.concatenate(ids), ends)
    cuts, at, block, out = np.concatenate([[0], np.cumsum(used)]), 0, 0, []
    for b in blocks:
        at, block = block, block + b
        out.append((words[cuts[at] : cuts[block]].astype("<u8").tobytes(), used[at:block].astype("<u4").tobytes()))
    return out


class TokenFile:
    """A file in writing: each document's words go out as they come, and only what finds them again is held.

    Layout: MAGIC, the words of all documents; then ids (has id, id), numbers of values, words of each block;
    and at the end block size, documents, blocks and values."""

    def __init__(self, folder: str, number: int) -> None:
        self.folder, self.number, self.name = folder, number, f"{number:06d}.s8b"
        self.files, self.at = place(folder)
        self.files.create_dir(self.at, recursive=True)
        self.draft = f"{self.at}/{self.name}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.named, self.ids, self.lengths, self.blocks = bytearray(), array("q"), array("Q"), []

    def add(self, key: int | None, length: int, blocks: bytes, words: bytes) -> None:
        self.named.append(key is not None)
        self.ids.append(key or 0)
        self.lengths.append(length)
        self.blocks.append(blocks)
        self.out.write(words)

    def close(self) -> tuple[int, str, int, int]:
        """Finish the file under its own name, so a task that runs again leaves the same; its row of write_tokens()."""
        heads, values = b"".join(self.blocks), sum(self.lengths)
        self.out.write(bytes(self.named) + np.array(self.ids, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes() + heads)
        self.out.write(struct.pack(TAIL, BLOCK, len(self.ids), len(heads) // 4, values))
        self.out.close()
        self.files.move(self.draft, f"{self.at}/{self.name}")
        return self.number, f"{self.folder}/{self.name}", len(self.ids), values


def read_file(file, at_once: int = 1 << 20) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Runs of documents of a file that can seek: their ids, their lengths and all their values, about at_once values at a time."""
    if file.read(4) != MAGIC:
        raise ValueError("not a token file")
    size = struct.calcsize(TAIL)
    end = file.seek(0, 2) - size
    file.seek(end)
    block, docs, heads, _ = struct.unpack(TAIL, file.read(size))
    file.seek(end - 17 * docs - 4 * heads)
    named = np.frombuffer(file.read(docs), np.uint8)
    ids = np.frombuffer(file.read(8 * docs), "<i8")
    lengths = np.frombuffer(file.read(8 * docs), "<u8").astype(np.int64)
    used = np.frombuffer(file.read(4 * heads), "<u4").astype(np.int64)
    file.seek(4)
    blocks = -(-lengths // block)
    last, values, done = np.cumsum(blocks), np.cumsum(lengths), 0
    while done < docs:
        start = int(values[done - 1]) if done else 0
        to = max(done + 1, int(np.searchsorted(values, start + at_once, side="right")))
        a, b = int(last[done - 1]) if done else 0, int(last[to - 1])
        words = np.frombuffer(file.read(8 * int(used[a:b].sum())), "<u8")
        counts = np.concatenate([np.append(np.full(k - 1, block), n - (k - 1) * block) for k, n in zip(blocks[done:to], lengths[done:to], strict=True) if k] or [np.zeros(0, int)]).astype(np.int64)
        yield [int(i) if n else None for i, n in zip(ids[done:to], named[done:to], strict=True)], lengths[done:to], unpack(words, np.cumsum(used[a:b]) - used[a:b], counts)
        done = to


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int, int]]:
    """Write the ids of all whole texts to files of folder, in ascending id; (range, file, documents, values) of each.

    A null text has no ids but the end id. Ids are integers; null ids come first; rows that repeat an id stand
    together in the order of (hash of the text, coded text). A range is one file: about RANGE_BYTES of text, or as
    `ranges` says. Their bounds are quantiles of the id alone; an id that fills several ranges by itself is dealt
    to them by the hash of its text. Each range is sorted by one task, which Spark spills, and its words go to
    the file as they come. The driver gets a row for each file."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"ids of token files are integers, {id_col} is not")
    path = path or vocabulary_path()
    if ranges is None:
        total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
        ranges = max(1, partitions(spark), -(-total // RANGE_BYTES))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = np.array((docs.agg(F.percentile_approx(id_col, shares, 10 * ranges + 1000)).first()[0] if shares else None) or [], dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = remembered(f"bpe {path}", lambda: WordBpe(path))
        coder = remembered(f"ids {path}", lambda: IdCoder(bpe))
        kind = f"<u{array(coder.code).itemsize}"
        tail = np.array([] if end_id is None else [end_id], kind).tobytes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [np.frombuffer(coder(t.as_py()) + tail, kind) for t in part.column(1)]
                packed = pack_documents(ids)
                keys, hashes = part.column(0).to_pylist(), part.column(2)
                low = [0 if k is None else int(np.searchsorted(bounds, k)) for k in keys]
                same = [1 if k is None else max(1, int(np.searchsorted(bounds, k, "right")) - at) for k, at in zip(keys, low, strict=True)]
                where = [at + h.as_py() * n // (1 << 32) for at, n, h in zip(low, same, hashes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(keys, pa.int64()), hashes, pa.array([len(x) for x in ids], pa.int64()), pa.array([p[1] for p in packed], pa.binary()), pa.array([p[0] for p in packed], pa.binary())], names=["range", "id", "hash", "n", "blocks", "words"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            for number, key, n, blocks, words in zip(*(batch.column(c).to_pylist() for c in ("range", "id", "n", "blocks", "words")), strict=True):
                if file is None:
                    file = TokenFile(folder, number)
                file.add(key, n, blocks, words)
        if file is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in file.close()], schema=pa.schema([("range", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("values", pa.int64())]))

    hashed = F.shiftrightunsigned(F.xxhash64(F.coalesce(text_col, F.lit(""))), 32)
    coded = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), hashed.alias("hash")).mapInArrow(encode, "range int, id long, hash long, n long, blocks binary, words binary")
    dealt = coded.repartitionById(ranges, F.col("range")).sortWithinPartitions(F.col("id").asc_nulls_first(), "hash", "n", "words")
    files = dealt.mapInArrow(write, "range long, file string, docs long, values long").collect()
    return sorted(tuple(r) for r in files)


def read_tokens(spark: SparkSession, files: list[tuple[int, str, int, int]], id_col: str = "doc_id") -> DataFrame:
    """id_col, start, n_tokens and ids_crc32 of each document, from the files alone."""
    starts = np.cumsum([0, *(f[3] for f in files)]).tolist()
    listed = spark.createDataFrame([(f[1], s) for f, s in zip(files, starts, strict=False)], "file string, start long").repartition(max(1, len(files)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files_, at = place(uri)
                with files_.open_input_file(at) as file:
                    for ids, lengths, values in read_file(file):
                        ends = np.cumsum(lengths)
                        raw = memoryview(values.astype("<u4").tobytes())
                        crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends - lengths + start), pa.array(lengths), pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])
                        start += int(lengths.sum())

    return listed.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_table(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to a folder of its own in the shared one, and read it back."""
    return read_tokens(docs.sparkSession, write_tokens(docs, table_path(docs.sparkSession, "tokens"), path, id_col=id_col, text_col=text_col), id_col)
