"""Cross-tokenizer alignment: distinct segments between which neither vocabulary merges are tokenised and aligned once."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import by_value
from .bpe import byte_letters, remembered
from .common import Scratch, bounded_batches, with_hot

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text and codes that share one dictionary of segments; aligned segments that go on together.
BLOCK, TOGETHER = 64 << 20, 1 << 16
#: White space as both tokenizers' patterns see it, and those of them that a segment may begin with.
SPACES, BEGINS = "\t-\r \x85\xa0  -     　", " \t\n\v\f\r"
SEGMENT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
ODD_SPACE = re.compile(f"(?![{BEGINS}])[{SPACES}]")
PIECE_SPACE, BYTE_PIECE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
by_value(__name__)


class Tokenizers:
    """Both vocabularies, the bytes of their tokens, and where a text may be cut for both."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        octet = {c: i for i, c in enumerate(byte_letters())}
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(octet[c] for c in n) if all(c in octet for c in n) else n.encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        shown = [p.replace(PIECE_SPACE, " ") for p in pieces]
        self.b_bytes = [bytes([int(BYTE_PIECE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else s.encode() for i, (p, s) in enumerate(zip(pieces, shown, strict=True))]
        self.before = self.b.encode("x")
        # The second vocabulary merges across a cut only within one of its pieces. The first one cuts before white space by its pattern.
        self.joined = {s[i : i + 2] for s in shown for i in range(len(s) - 1) if s[i + 1] in BEGINS and not re.match(f"[{SPACES}]", s[i])}
        if any(x[0] == "x" for x in self.joined):
            raise ValueError("this vocabulary has pieces across an x and white space")
        self.unsure = re.compile(f"[{re.escape(''.join(sorted({x[1] for x in self.joined})))}]" if self.joined else r"(?!)")

    def segments(self, text: str) -> list[str]:
        """A space and the text, cut before white space wherever no token of either vocabulary can reach across."""
        found = SEGMENT.findall(" " + text)
        if not (self.unsure.search(text) or ODD_SPACE.search(text)):
            return found
        starts = [i for i, s in enumerate(found) if not i or s[0] in BEGINS and found[i - 1][-1] + s[0] not in self.joined]
        return ["".join(found[i:j]) for i, j in zip(starts, [*starts[1:], len(found)], strict=True)]

    def align(self, segments: list[str]) -> list[tuple[str, list[int]]]:
        """Numbers of tokens, groups and links and the groups as text, all parted by spaces, and the linked pairs
        (a << 32 | b, as often as they are linked) of each segment; an empty text if its tokens' bytes are not its own.

        A segment begins with white space, which no piece joins to an x, so what follows the x in the encoding
        of both is the segment's."""
        out = []
        firsts = self.a.encode_batch(segments, add_special_tokens=False)
        seconds = self.b.encode(["x" + s for s in segments], num_threads=1)
        for segment, first, second in zip(segments, firsts, seconds, strict=True):
            a, b, whole = first.ids, second[len(self.before) :], segment.encode()
            if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
                out.append(("", []))
                continue
            groups, links = [], []
            i = j = from_a = from_b = at_a = at_b = 0
            while i < len(a):  # both end together at last
                if at_a <= at_b:
                    at_a += len(self.a_bytes[a[i]])
                    i += 1
                while at_b < at_a:
                    at_b += len(self.b_bytes[b[j]])
                    j += 1
                if at_a == at_b:
                    left, right = a[from_a:i], b[from_b:j]
                    groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                    links += [x << 32 | y for x in left for y in right]
                    from_a, from_b = i, j
            out.append((f"{len(a)} {len(b)} {len(groups)} {len(links)} {';'.join(groups)}", links))
        return out


def dictionaries(docs: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """Texts as numbers of segments, by blocks of about BLOCK bytes: a row (block, id, codes) for each document,
    and one (block, at, segment) for each distinct segment of a block, once however many documents have it."""
    bounded_batches(docs.sparkSession)
    fields = [("block", T.LongType()), ("id", docs.schema[id_col].dataType), ("codes", T.BinaryType()), ("at", T.IntegerType()), ("segment", T.StringType())]
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = remembered(f"aligner {a_path} {b_path}", lambda: Tokenizers(a_path, b_path))
        known: dict[str, int] = {}
        block, size, kind = uuid.uuid4().int >> 65, 0, None

        def dictionary() -> pa.RecordBatch:
            n = len(known)
            return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(list(known), pa.string())], names=names)

        for batch in batches:
            kind, codes = batch.column(0).type, []
            for text in batch.column(1):
                found = both.segments(text.as_py()) if text.as_py() else []
                for s in found:
                    if s not in known:
                        known[s] = len(known)
                codes.append(zlib.compress(np.array([known[s] for s in found], np.int32).tobytes(), 1))
                size += 4 * len(found) + sum(map(len, found))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), batch.column(0), pa.array(codes, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names)
            if size > BLOCK:
                yield dictionary()
                known, block, size = {}, uuid.uuid4().int >> 65, 0
        if known:
            yield dictionary()

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in fields]))


def aligned_entries(entries: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """What Tokenizers.align() says of each of entries (block, at, segment), many in a row: block, ats, texts, sizes, links.

    Entries of one segment follow one another, so each distinct segment is tokenised and aligned once, and its
    alignment goes to every block that has it without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = remembered(f"aligner {a_path} {b_path}", lambda: Tokenizers(a_path, b_path))
        held, known = [], {}

        def packed() -> pa.RecordBatch:
            rows: dict[int, list] = {}
            for block, at, found in held:
                rows.setdefault(block, []).append((at, found))
            columns: list[list] = [[], [], [], []]
            for row in rows.values():
                links = [f[1] for _, f in row]
                parts = [np.array([at for at, _ in row], np.int32), "\n".join([f[0] for _, f in row]), np.array(list(map(len, links)), np.int32), np.array([x for f in links for x in f], np.int64)]
                for column, part in zip(columns, parts, strict=True):
                    column.append(zlib.compress(part.encode() if isinstance(part, str) else part.tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], names=PACKED)

        for batch in batches:
            segments = batch.column(2).to_pylist()
            new = [s for s in dict.fromkeys(segments) if s not in known]
            known = {s: known[s] for s in segments[:1] if s in known} | dict(zip(new, both.align(new), strict=True))
            held += [(block, at, known[s]) for block, at, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), segments, strict=True)]
            known = {segments[-1]: known[segments[-1]]} if segments else known
            if len(held) >= TOGETHER:
                yield packed()
                held = []
        if held:
            yield packed()

    sorted_ = entries.repartition("segment").sortWithinPartitions("segment")
    return sorted_.mapInArrow(run, "block long, ats binary, texts binary, sizes binary, links binary")


PACKED = ["block", "ats", "texts", "sizes", "links"]
COUNTS, SUMS = ["n_a", "n_b", "n_groups", "n_links"], ["n_best", "count_sum"]


def unpacked(rows: pa.Table) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """COUNTS, groups, places of links (one more than entries) and links of a block's entries in their order; counts of -1 if not ok."""
    parts = {c: [zlib.decompress(x.as_py()) for x in rows.column(c)] for c in ("ats", "sizes", "links")}
    ats, sizes, links = (np.frombuffer(b"".join(parts[c]), k) for c, k in (("ats", np.int32), ("sizes", np.int32), ("links", np.int64)))
    counts, groups = np.full((len(ats), len(COUNTS)), -1, np.int64), [""] * len(ats)
    place = iter(ats.tolist())
    for packed in rows.column("texts"):  # one after another: no second copy of all groups
        for text, at in zip(zlib.decompress(packed.as_py()).decode().split("\n"), place, strict=False):
            if text:
                *numbers, groups[at] = text.split(" ")
                counts[at] = numbers
    order = np.argsort(ats)
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64)
    moved = np.repeat(begins[:-1][order] - ends[:-1], sizes[order]) + np.arange(len(links))
    return counts, groups, ends, links[moved]


def composed(found: pa.Table, rows: pa.Table, keep_groups: bool, names: list[str]) -> pa.Table:
    """A block's documents put together: COUNTS, the digest of groups and held (which of the block's pairs, how often);
    and a row for each of the block's pairs (k, pair) with the number n of its documents that hold it."""
    counts, groups, ends, links = unpacked(found)
    pairs, local = np.unique(links, return_inverse=True)
    totals, holders = np.zeros((rows.num_rows, len(COUNTS)), np.int64), np.zeros(len(pairs), np.int64)
    digests, shown, held = [], [], []
    for row, codes in enumerate(rows.column("codes")):
        mine = np.frombuffer(zlib.decompress(codes.as_py()), np.int32)
        text, has = "", b""
        if len(mine) and (counts[mine, 0] >= 0).all():
            totals[row] = counts[mine].sum(axis=0)
            text = ";".join([groups[c] for c in mine.tolist()])
            own, times = np.unique(mine, return_counts=True)
            sizes = ends[own + 1] - ends[own]
            at = np.repeat(ends[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            which, back = np.unique(local[at], return_inverse=True)
            holders[which] += 1
            often = np.bincount(back, weights=np.repeat(times, sizes)).astype(np.int64)
            has = zlib.compress(np.stack([which, often]).astype(np.int64).tobytes(), 1)
        digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        shown.append(text)
        held.append(has)
    n, m = rows.num_rows, len(pairs)
    none = lambda k: pa.nulls(m, k)
    both = {"block": pa.array([rows.column("of")[0].as_py() if n else found.column("block")[0].as_py()] * (n + m), pa.int64()), "id": pa.chunked_array([rows.column("id").combine_chunks(), none(rows.schema.field("id").type)])}
    both |= {c: pa.chunked_array([pa.array(totals[:, k]), none(pa.int64())]) for k, c in enumerate(COUNTS)}
    both |= {"groups_sha256": pa.array(digests + [None] * m, pa.string()), "held": pa.array(held + [None] * m, pa.binary())}
    both |= {"groups": pa.array(shown + [None] * m, pa.string())} if keep_groups else {}
    both |= {c: pa.chunked_array([pa.nulls(n, pa.int64()), pa.array(x, pa.int64())]) for c, x in (("k", np.arange(m)), ("pair", pairs), ("n", holders))}
    return pa.table({c: both[c] for c in names})


def summed(values: pa.Table, rows: pa.Table, names: list[str]) -> pa.Table:
    """rows of a block's documents with SUMS: values (k, n, best) of the pairs they hold, as often as they hold them."""
    each = np.zeros((2, values.num_rows), np.int64)
    for k, c in enumerate(("best", "n")):
        each[k, values.column("k").to_numpy()] = values.column(c).to_numpy()
    sums = np.zeros((rows.num_rows, 2), np.int64)
    for row, has in enumerate(rows.column("held")):
        if has.as_py():
            which, often = np.frombuffer(zlib.decompress(has.as_py()), np.int64).reshape(2, -1)
            sums[row] = each[:, which] @ often
    found = {c: pa.array(sums[:, k]) for k, c in enumerate(SUMS)}
    return pa.table({c: found[c] if c in found else rows.column(c) for c in names})


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, keep_groups: bool = False) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row; keep_groups: groups too.

    Both tokenizers encode a space and the text, special tokens as plain text. Byte offsets where tokens of both
    end cut them into groups; tokens of one group are linked, and an id pair counts the documents that hold it
    linked. n_best: links whose pair has its first id's highest count, ties included; count_sum: counts summed
    over links. groups: ids as `a1,a2|b1;a3|b2,b3`. Null and empty texts, and those of which some segment's tokens
    spell other bytes (a U+2581, say), have no tokens: zeros and ''. Repeated rows count and are returned as
    often as they come; an empty table gives an empty one; other columns do not matter, whatever their names.

    A text becomes numbers into its block's dictionary of segments. Each distinct segment of the corpus is
    aligned once, and the alignment goes to the blocks that have it; a block's documents are composed with its
    dictionary, both bounded by BLOCK and one text. Then each block gets the corpus's counts of its own pairs.
    Nothing is broadcast but the few pairs' first ids that are hot."""
    import public_tokenizers

    a_path, b_path = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    keep = Scratch(docs.sparkSession, "alignment", compression="zstd")
    coded = keep.table(dictionaries(docs, id_col, text_col, a_path, b_path), "coded")
    entries, texts = coded.where("at IS NOT NULL").select("block", "at", "segment"), coded.where("at IS NULL").select(F.col("block").alias("of"), "id", "codes")
    long = T.LongType()
    fields = [T.StructField("block", long), T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, long) for c in COUNTS], T.StructField("groups_sha256", T.StringType()), T.StructField("held", T.BinaryType())]
    fields += [T.StructField("groups", T.StringType())] * keep_groups + [T.StructField(c, long) for c in ("k", "pair", "n")]
    names = [f.name for f in fields]

    def compose(found: pa.Table, rows: pa.Table) -> pa.Table:
        return composed(found, rows, keep_groups, names)

    parts = keep.table(aligned_entries(entries, a_path, b_path).groupBy("block").cogroup(texts.groupBy("of")).applyInArrow(compose, T.StructType(fields)), "composed")
    keep.close(parts)
    mine = parts.where("k IS NOT NULL").select("block", "k", "pair", "n")
    counts = keep.table(mine.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32)), "counts")
    tops = keep.table(counts.groupBy("a").agg(F.max("n").alias("top"), F.count("*").alias("size")), "tops")
    judged = keep.table(with_hot(counts, ["a"], tops, "size", ["top"]).select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best")), "judged")
    keep.close(parts, judged)
    values = mine.select("block", "k", "pair").join(judged, "pair").select("block", "k", "n", "best")

    shown = ["id", *COUNTS, *SUMS, "groups_sha256", *["groups"] * keep_groups]
    kinds = {f.name: f.dataType for f in fields}
    schema = T.StructType([T.StructField(c, kinds.get(c, long)) for c in shown])

    def finish(found: pa.Table, rows: pa.Table) -> pa.Table:
        return summed(found, rows, shown)

    rows = parts.where("k IS NULL").select(F.col("block").alias("of"), "id", *COUNTS, "groups_sha256", "held", *["groups"] * keep_groups)
    return values.groupBy("block").cogroup(rows.groupBy("of")).applyInArrow(finish, schema).withColumnRenamed("id", id_col)
