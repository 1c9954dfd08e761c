"""BPE encoding and decoding: a minimal acyclic transducer of frequent words, and exact merges of the others."""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import struct
import sys
import types
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import by_value
from .common import bounded_batches, free_name, materialize, positional, shared_dir, write_bytes

VOCABULARY = "word_bpe_49k.json"
#: Frequent words compiled, the longest that is compiled or remembered, and chunks that a worker remembers.
LEXICON_WORDS, LONGEST, REMEMBERED = 65_536, 64, 300_000
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: Characters that the fast path takes: NFC leaves them as they are, and they lower to Latin letters.
OTHER = re.compile(r"[^\t-\r -įı-ſ]")
_OF = {k: "".join(re.escape(chr(i)) for i in range(0x180) if unicodedata.category(chr(i))[0] == k) for k in "LN"}
_SPACE = r"\t-\r \x85\xa0"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_OF['L']}]+|[{_OF['N']}]|[^{_SPACE}{_OF['L']}{_OF['N']}]+")
END = "</w>"
by_value(__name__)


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The tokenizer file's normalisation, words, merges and decoding, word by word."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.names = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}

    def chunks(self, text: str | None) -> list[str]:
        """What white space parts in a normalised text; special tokens are chunks of their own."""
        text = text or ""
        if "<|" in text and SPECIAL.search(text):
            return [c for part in SPECIAL.split(text) for c in ([part] if part in self.special else self.plain_chunks(part))]
        return self.plain_chunks(text)

    def plain_chunks(self, text: str) -> list[str]:
        if not OTHER.search(text):
            return text.lower().split()
        return [c for c in self.library.normalizer.normalize_str(text).split(" ") if c]

    def words(self, chunk: str) -> list[str]:
        """The words of a normalised chunk, as the pre-tokenizer cuts it."""
        if chunk in self.special:
            return [chunk]
        if chunk.isascii() or not OTHER.search(chunk):
            return WORD.findall(chunk)
        return [bytes(self.bytes[c] for c in piece).decode("utf-8") for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def merge(self, word: str) -> list[int]:
        """The ids of any word, by the exact merges."""
        if word in self.special:
            return [self.special[word]]
        if word.isascii() and word.isprintable():  # these bytes are their own letters
            return [t.id for t in self.library.model.tokenize(word)]
        return [t.id for t in self.library.model.tokenize("".join(self.letters[b] for b in word.encode("utf-8")))]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes with special tokens kept: the file has no decoder, so a space parts the tokens."""
        return " ".join(self.names[i] for i in ids)


class Builder:
    """A minimal acyclic automaton of byte strings added in ascending order; equal suffixes share states."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[int, int]]] = [[]]
        self.final = [False]
        self.register: dict[tuple, int] = {}
        self.path: list[int] = [0]
        self.last = b""

    def add(self, word: bytes) -> None:
        if word <= self.last and self.last:
            raise ValueError("words must ascend")
        common = len(os.path.commonprefix([word, self.last]))
        self.close(common)
        for b in word[common:]:
            self.edges.append([])
            self.final.append(False)
            self.edges[self.path[-1]].append((b, len(self.edges) - 1))
            self.path.append(len(self.edges) - 1)
        self.final[self.path[-1]] = True
        self.last = word

    def close(self, depth: int) -> None:
        """Replace the states of the current path below depth by equal ones where there are any."""
        while len(self.path) > depth + 1:
            state = self.path.pop()
            same = self.register.setdefault((self.final[state], tuple(self.edges[state])), state)
            label, _ = self.edges[self.path[-1]][-1]
            self.edges[self.path[-1]][-1] = (label, same)


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """A file of words and their ids.

    Every transition carries the number of words that sort before those behind it in its state, so the
    sum along a path is the word's rank, and the rank finds its ids: states hold no outputs and can share
    suffixes. Layout: five counts, then first transition of each state, targets, skips, places of ids,
    ids, labels, finals."""
    build, ordered = Builder(), sorted((w.encode("utf-8"), ids) for w, ids in words.items())
    for word, _ in ordered:
        build.add(word)
    build.close(0)
    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for _, to in build.edges[stack.pop()]:
            if to not in number:
                number[to] = len(order)
                order.append(to)
                stack.append(to)
    count: dict[int, int] = {}

    def below(state: int) -> int:
        if state not in count:
            count[state] = build.final[state] + sum(below(to) for _, to in build.edges[state])
        return count[state]

    first, labels, targets, skips = [0], [], [], []
    for state in order:
        passed = int(build.final[state])
        for label, to in build.edges[state]:
            labels.append(label)
            targets.append(number[to])
            skips.append(passed)
            passed += below(to)
        first.append(len(labels))
    places = np.cumsum([0, *(len(ids) for _, ids in ordered)])
    flat = [i for _, ids in ordered for i in ids]
    body = b"".join(np.asarray(a, "<u4").tobytes() for a in (first, targets, skips, places, flat))
    return struct.pack("<5I", len(order), len(labels), len(ordered), len(flat), 0) + body + bytes(labels) + bytes(build.final[s] for s in order)


class Lexicon:
    """A compiled lexicon, read through a memory map that all workers of a machine share."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        states, edges, words, ids, _ = struct.unpack_from("<5I", self.map)
        view, at, parts = memoryview(self.map), 20, []
        for n in (states + 1, edges, edges, words + 1, ids):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.targets, self.skips, self.places, self.ids = parts
        self.labels = at
        self.final = view[at + edges : at + edges + states]

    def get(self, word: str) -> list[int] | None:
        state = rank = 0
        find, base, first = self.map.find, self.labels, self.first
        for b in word.encode("utf-8"):
            edge = find(b.to_bytes(1, "little"), base + first[state], base + first[state + 1]) - base
            if edge < 0:
                return None
            rank += self.skips[edge]
            state = self.targets[edge]
        return self.ids[self.places[rank] : self.places[rank + 1]].tolist() if self.final[state] else None


def remembered(key: str, make: Callable[[], object], version: str = "") -> object:
    """What make() gives, kept for later tasks of the same Python worker: one version of a key, the last asked for."""
    kept = sys.modules.setdefault("_fairground_worker", types.ModuleType("_fairground_worker")).__dict__
    if key not in kept or kept[key][0] != version:
        kept.pop(key, None)
        kept[key] = (version, make())
    return kept[key][1]


class Coder:
    """Values of chunks, remembered up to a bound; of(chunk) computes one."""

    def __init__(self, of: Callable[[str], object], most: int = REMEMBERED) -> None:
        self.of, self.most, self.known = of, most, {}

    def __call__(self, chunks: list[str]) -> list:
        known = self.known
        missing = set(chunks).difference(known)
        for c in missing:
            known[c] = self.of(c)
        out = [known[c] for c in chunks]
        if len(known) > 2 * self.most:
            known.clear()
        elif missing:
            for c in [c for c in missing if len(c) > LONGEST]:
                del known[c]
        return out


class IdCoder:
    """Ids of chunks as packed bytes. A word is a chunk of itself, so one memory serves both."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe, self.code = bpe, "H" if len(bpe.names) <= 1 << 16 else "I"
        self.chunks = Coder(self.of)

    def of(self, chunk: str) -> bytes:
        words = self.bpe.words(chunk)
        if len(words) == 1:
            return array(self.code, self.bpe.merge(words[0])).tobytes()
        known, out = self.chunks.known, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = array(self.code, self.bpe.merge(w)).tobytes()
                if len(w) <= LONGEST:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str | None) -> bytes:
        return b"".join(self.chunks(self.bpe.chunks(text)))


def token_counts(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs without text_col, and n_tokens: how many ids with_codes() gives the whole text; null: 0.
    Where docs has that name, the new column takes a leading underscore."""
    path = path or vocabulary_path()
    bounded_batches(docs.sparkSession)
    kept, name = [c for c in docs.columns if c != text_col], free_name(docs, NAMES[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = remembered(f"bpe {path}", lambda: WordBpe(path))
        coder = remembered(f"counts {path}", lambda: Coder(lambda chunk: sum(len(bpe.merge(w)) for w in bpe.words(chunk))))
        for batch in batches:
            counts = [sum(coder(bpe.chunks(text.as_py()))) for text in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(counts, pa.int64())], names=schema.names)

    schema = T.StructType([T.StructField(f"c{i}", kind) for i, kind in enumerate([*(docs.schema[c].dataType for c in kept), T.LongType()])])
    return positional(docs, [*kept, text_col]).mapInArrow(count, schema).toDF(*kept, name)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """word and n: how often each word stands in all whole texts. Words over LONGEST bytes are left out here,
    as they are never compiled."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = remembered(f"bpe {path}", lambda: WordBpe(path))
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0):
                seen.update(bpe.chunks(text.as_py()))
            words: Counter[str] = Counter()
            for chunk, n in seen.items():
                for word in bpe.words(chunk):
                    words[word] += n
            kept = [w for w in words if len(w.encode("utf-8")) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([words[w] for w in kept], pa.int64())], names=["word", "n"])

    return positional(docs, [text_col]).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: n with only its eight leading bits: at most 128 values for each power of two.
ROUNDED = "n - n % shiftleft(1L, greatest(0, length(bin(n)) - 8))"


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON_WORDS, text_col: str = "text") -> list[str]:
    """The commonest words of all texts, `most` at most.

    How many words have each count, ROUNDED, comes to the driver first, some thousand rows at any size, and
    gives the least such count that no more than `most` words reach; then only these words come, however
    many partitions there are. Words of one count are all taken or none."""
    counts = materialize(word_counts(docs, path, text_col).withColumn("about", F.expr(ROUNDED)), "words")
    total, least = 0, None
    for n, words in sorted(counts.groupBy("about").count().collect(), reverse=True):
        total += words
        if total > most:
            break
        least = n
    return [] if least is None else sorted(r["word"] for r in counts.where(F.col("about") >= least).select("word").collect())


def ship_lexicon(spark: SparkSession, words: list[str], path: str) -> str:
    """Compile words into a file of the shared folder and give it to every executor, later ones too; its name there."""
    bpe = WordBpe(path)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    where = f"{shared_dir(spark)}/{name}"
    write_bytes(spark, where, compile_lexicon({w: bpe.merge(w) for w in words}))
    spark.sparkContext.addFile(where)
    return name


def with_codes(docs: DataFrame, lexicon: str, path: str, keep_ids: bool = False, text_col: str = "text") -> DataFrame:
    """docs without text_col, and n_tokens, ids_sha256, decoded_sha256; keep_ids: ids and decoded too.
    Where docs has one of these names, the new column takes a leading underscore.

    The ids are the tokenizers library's for the whole text without special tokens added: the lexicon's
    where it has a word, else exact merges. Special tokens that a text spells out are one id, as there.
    A null text is empty: no ids, and the digests of nothing. The ids are decoded chunk by chunk."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text_col]
    names = [free_name(docs, c) for c in NAMES[: 5 if keep_ids else 3]]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = remembered(f"bpe {path}", lambda: WordBpe(path))

        def make() -> Coder:
            table = Lexicon(SparkFiles.get(lexicon))

            def of(chunk: str) -> tuple[str, str]:
                ids = [i for w in bpe.words(chunk) for i in (table.get(w) or bpe.merge(w))]
                return " ".join(map(str, ids)), bpe.decode(ids)

            return Coder(of)

        coder = remembered("coder", make, lexicon)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(len(kept)):
                pairs = coder(bpe.chunks(text.as_py()))
                ids, decoded = " ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])
                row = (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                for column, value in zip(columns, (*row, [int(i) for i in ids.split()] if keep_ids else None, decoded if keep_ids else None), strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays[: 5 if keep_ids else 3]], names=schema.names)

    made = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType()), T.StringType()][: len(names)]
    schema = T.StructType([T.StructField(f"c{i}", kind) for i, kind in enumerate([*(docs.schema[c].dataType for c in kept), *made])])
    return positional(docs, [*kept, text_col]).mapInArrow(code, schema).toDF(*kept, *names)


NAMES = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]


def encode_decode(docs: DataFrame, path: str | None = None, most: int = LEXICON_WORDS, keep_ids: bool = False, text_col: str = "text") -> DataFrame:
    """with_codes() with a lexicon of the corpus's own `most` commonest words."""
    path = path or vocabulary_path()
    name = ship_lexicon(docs.sparkSession, frequent_words(docs, path, most, text_col), path)
    return with_codes(docs, name, path, keep_ids, text_col)
