"""Token alignment against whole texts encoded by both libraries."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers

from fairground.llm import alignment
from fairground.llm.bpe import byte_letters

SPACES = [chr(i) for i in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x2003, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]


def whole(texts):
    """Each text's groups [(ids of a, ids of b)], None where it has no tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    octet = {c: i for i, c in enumerate(byte_letters())}
    for text in texts:
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        raw = [bytes(octet[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or not b"".join(raw[0]) == (" " + text).encode() == b"".join(raw[1]):
            yield None
            continue
        ends = [np.cumsum([len(x) for x in r]) for r in raw]
        both = np.intersect1d(*ends)
        cuts = [np.concatenate([[0], np.searchsorted(e, both) + 1]) for e in ends]
        yield [(ids[0][i:j], ids[1][k:m]) for i, j, k, m in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False)]


def brute(texts):
    found = list(whole(texts))
    pairs = lambda groups: [(x, y) for left, right in groups or [] for x in left for y in right]
    held = Counter(p for groups in found for p in set(pairs(groups)))
    top: Counter = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    for groups in found:
        links = pairs(groups)
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups or [])
        sums = [sum(len(g[k]) for g in groups or []) for k in (0, 1)]
        yield (*sums, len(groups or []), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "", text)


def compare(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: tuple(r)[1:] for r in alignment.align_tokens(docs, keep_groups=True).collect()}
    assert out == dict(enumerate(brute(texts)))


def test_groups_of_whole_texts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    letters = [*SPACES, *"ab;){}'x9.<\x00", "é", "中", "😀", "'s", "<|endoftext|>", "<s>", "<0x0A>", "the", "▁", " ", " ", "\r\n", "̀"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(1500)]
    texts += [p + w + q + "z" for p in ("a", ";", "'", ".", "9", "é", chr(0x200B)) for w in SPACES for q in [*SPACES, ""]]
    texts += [None, "", " ", "foo ", "The cat.", "The cat.", "a" * 3000, "中" * 500, "say it again " * 3000]
    monkeypatch.setattr(alignment, "BLOCK", 2000)  # many blocks
    monkeypatch.setattr(alignment, "TOGETHER", 300)  # a block's entries come in many parts
    compare(spark, texts)


def test_one_text_many_times(spark):
    compare(spark, ["same words here"] * 400 + ["other words", "x▁y", None])


def test_odd_tables(spark):
    rows = [(None, "a b", 1, (2,)), (7, "a b", None, None), (7, "a b", None, None), (8, None, 3, (4,))]
    docs = spark.createDataFrame(rows, "`my.id` long, `the text` string, n_a int, `a.b` struct<`x y`: int>")
    out = alignment.align_tokens(docs, "my.id", "the text").collect()
    assert Counter(r["my.id"] for r in out) == {None: 1, 7: 2, 8: 1}
    assert len({tuple(r)[1:] for r in out if r["my.id"] != 8}) == 1 and next(tuple(r)[1:] for r in out if r["my.id"] == 8) == (0, 0, 0, 0, 0, 0, "")
    assert next(r["count_sum"] for r in out if r["my.id"] == 7) == 3 * next(r["n_links"] for r in out if r["my.id"] == 7)
    assert alignment.align_tokens(docs.limit(0), "my.id", "the text").count() == 0


def test_cuts_need_a_vocabulary_without_pieces_across_them():
    both = alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert both.segments("a b\r\nc;\rd  e f") == [" a", " b", "\r\nc;\rd", "  e f"]
    assert all(b[1] == "\r" for b in both.joined) and ";\r" in both.joined


@pytest.fixture(autouse=True, scope="module")
def no_threads():
    with pytest.MonkeyPatch.context() as m:
        m.setenv("TOKENIZERS_PARALLELISM", "false")
        yield
