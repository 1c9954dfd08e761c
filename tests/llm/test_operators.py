"""The training-data operators against brute force, on small tables with every odd case."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from fairground.llm import labels as labels_
from fairground.llm import bpe, exact_dedup, line_dedup, media, near, packing, quality, sharding, simhash, tokenfile, toxicity

LONG = "word " * 30_000
TEXTS = [None, "", " \n\t", "one", "one two", "One two three", "one TWO  three", "a b c d e f g", "a b c d e f h", LONG, "é ü ñ x", "same", "same", "l1\nl2\nl3\nl4", "x\nl1\nl2\nl3\ny", "r\nr\nr\nr\nr", "p\n\nq\n\nr\nend", "p\nq\nr"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "kept") for i, t in enumerate(TEXTS)]
    rows += [(2, TEXTS[2], "en", "s", None, "kept"), (None, "same", None, None, None, None), (None, "only", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Shard string")


def empty(docs):
    return docs.limit(0)


def test_exact_dedup_matches_brute_force(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    for keep, pick in (("min", min), ("max", max)):
        for hashed in (exact_dedup.F.md5, lambda t: exact_dedup.F.length(t).cast("string")):  # the second collides
            out = exact_dedup.exact_dedup(docs, keep=keep, content_hash=hashed).collect()
            assert len(out) == docs.count()
            by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
            for r in out:
                ids = by_sha[r["text_sha256"]]
                named = [i for i in ids if i is not None]
                assert r["group_size"] == len(ids)
                assert r["keep_id"] == (pick(named) if named else None)
                assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_dedup(empty(docs)).count() == 0


def brute_lines(rows, lines=3):
    """rows: (id, text) in the order in which windows count; the cut line numbers of each."""
    seen, cut = set(), {}
    for key, text in rows:
        parts = (text or "").split("\n")
        full = [i for i, p in enumerate(parts) if p.strip(" \t\x0b\x0c\r")]
        cut[key] = set()
        for k in range(len(full) - lines + 1):
            at = full[k : k + lines]
            body = tuple(parts[i] for i in at)
            if body in seen:
                cut[key] |= set(at)
            seen.add(body)
    return cut


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "d", " "]) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, None), (61, "\n".join(f"line {i}" for i in range(3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", line_dedup.F.lit("clash"))
    cut = brute_lines(rows)
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
    assert len(out) == len(rows)
    for key, text in rows:
        r, parts = out[key], (text or "").split("\n")
        assert r["removed_lines"] == len(cut[key])
        assert r["text"] == (text if not cut[key] else "\n".join(p for i, p in enumerate(parts) if i not in cut[key]))
        numbers = [i for span in r["removed_spans"].split(",") if span for a, b in [map(int, span.split("-"))] for i in range(a, b + 1)]
        assert numbers == sorted(cut[key]) and r["n_lines"] == "clash" and r["_n_lines"] == len(parts)
    left = {line for r in out.values() for line in (r["text"] or "").split("\n")}
    assert {line for _, t in rows for line in (t or "").split("\n") if line.strip(" ")} <= left


def test_line_dedup_takes_repeated_and_null_ids(docs):
    out = line_dedup.line_dedup(docs)
    assert out.count() == docs.count() and line_dedup.line_dedup(empty(docs)).count() == 0


def test_hypergeometric_has_its_law():
    rng = np.random.default_rng(1)
    drawn = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(drawn.mean() - 6) < 0.15 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.4
    big = sharding.hypergeometric(rng, 10**11, 3 * 10**11, 10**10)
    assert abs(big - 2.5 * 10**9) < 10**6
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0


def test_shards_are_exact_gapless_and_mixed(spark):
    df = spark.range(1003).selectExpr("id AS doc_id", "'x' AS shard", "id % 2 AS slot")
    out = sharding.shuffle_into_shards(df, shards=24, blocks=7).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(1003))
    by = defaultdict(list)
    for r in out:
        by[r["_shard"]].append(r["_slot"])
    assert len(by) == 24 and {len(v) for v in by.values()} <= {41, 42} and all(sorted(v) == list(range(len(v))) for v in by.values())
    first = [r["doc_id"] for r in out if r["_shard"] == 0]
    assert 250 < np.mean(first) < 750
    again = {(r["doc_id"], r["_shard"], r["_slot"]) for r in sharding.shuffle_into_shards(df.repartition(5), shards=24, blocks=7).collect()}
    assert again == {(r["doc_id"], r["_shard"], r["_slot"]) for r in out}


def test_sharding_takes_odd_tables(docs):
    out = sharding.shuffle_into_shards(docs, shards=4)
    assert out.count() == docs.count() and "Shard" in out.columns and "_shard" in out.columns
    assert sharding.shuffle_into_shards(empty(docs), shards=4).count() == 0


def brute_padding(histogram, buckets):
    lengths = sorted(histogram)
    n = len(lengths)
    best = {0: 0}
    costs = [[0] * (n + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 1, n + 1):
            costs[i][j] = sum((lengths[j - 1][0] - x) * c for x, c in lengths[i:j])
    for _ in range(buckets):
        best = {j: min(best[i] + costs[i][j] for i in best if i <= j) for j in range(n + 1)}
    return best[n]


def test_bounds_are_optimal():
    rng = random.Random(5)
    for _ in range(150):
        histogram = [(x, rng.randint(1, 20)) for x in rng.sample(range(60), rng.randint(1, 14))]
        for k in (1, 2, 3, 5):
            bounds = packing.optimal_bounds(histogram, k)
            assert len(bounds) <= k and bounds[-1] == max(x for x, _ in histogram)
            assert sum((min(b for b in bounds if b >= x) - x) * c for x, c in histogram) == brute_padding(histogram, k)
    assert packing.optimal_bounds([], 3) == []


def test_batches_hold_their_budget(docs):
    df = docs.select("doc_id", packing.word_count(packing.F.col("text")).alias("n"), packing.F.lit("x").alias("batch"))
    out = packing.pack(df, "n", buckets=3, budget=20).collect()
    assert len(out) == docs.count()
    batches = defaultdict(list)
    for r in out:
        assert r["padded_length"] >= r["n"] and r["batch"] == "x"
        batches[r["bucket"], r["_batch"]].append((r["slot"], r["padded_length"]))
    for rows in batches.values():
        assert sorted(s for s, _ in rows) == list(range(len(rows))) and len({p for _, p in rows}) == 1
        assert len(rows) == 1 or sum(p for _, p in rows) <= 20
    assert packing.pack(empty(df), "n").count() == 0


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode()
    import re

    found = re.findall(rb"[^\x20\x09-\x0D]+", words)
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)] for _ in range(12)]
    rows = list(enumerate(TEXTS)) + [(None, "same"), (5, "One two three")]
    for i in range(150):
        words = list(rng.choice(base))
        words[rng.randrange(60)] = "zz"
        rows.append((100 + i, " ".join(words)))
    out = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    prints = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    want = sorted((str(key), f"{prints[i]:016x}", min(k for k in least[find(i)] if k is not None)) for i, (key, _) in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in out) == want
    assert len({w[2] for w in want}) < len(rows) - 20


def test_links_find_every_close_pair(spark):
    rng = random.Random(2)
    prints = {0, 1, 3, (1 << 64) - 1}
    while len(prints) < 300:
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(4):
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_simhash_of_an_empty_table(docs):
    assert simhash.simhash_dedup(empty(docs)).count() == 0


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBpe(bpe.vocabulary_path())


ODD = ["<|endoftext|>", "a<|startoftext|>B", "'s'LL it's", "İstanbul ΣΑΣ Σ", "日本語 한국어", "🙂👍🏽", "é Å", "  \u0085\x1cx", "x" * 500, "ab12cd_a_", "²½ﬁⅧ", "﻿a", "!!!''s"]


def test_ids_and_text_are_the_library_s(coder):
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ODD + ["".join(rng.choice(ODD + ["a", " ", "Ab"]) for _ in range(8)) for _ in range(300)]
    for text in texts:
        ids = [i for c in coder.chunks(text) for w in coder.words(c) for i in coder.merge(w)]
        want = coder.library.encode(text, add_special_tokens=False).ids
        assert ids == want and coder.decode(ids) == coder.library.decode(want, skip_special_tokens=False)


def test_lexicon_is_minimal_and_exact(coder, tmp_path):
    words = ["tap", "taps", "top", "tops", "a", "stop", "stops", "é"]
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon({w: coder.merge(w) for w in words}))
    found = bpe.Lexicon(str(path))
    assert all(found.get(w) == coder.merge(w) for w in words) and all(found.get(w) is None for w in ("", "ta", "tapss", "b", "èx"))
    build = bpe.Builder()
    for w in sorted(w.encode() for w in words):
        build.add(w)
    build.close(0)
    used = {0} | {to for edges in build.edges for _, to in edges}
    rights = lambda s: frozenset([b""] if build.final[s] else []) | {bytes([c]) + r for c, t in build.edges[s] for r in rights(t)}
    languages = [rights(s) for s in used if s == 0 or any(s == to for e in range(len(build.edges)) if e in used for _, to in build.edges[e])]
    assert len(set(languages)) == len({s for s in used if s in set(build.register.values()) | {0}})


def test_codes_of_odd_tables(docs, coder):
    out = {(r["doc_id"], r["n_tokens"]): r for r in bpe.encode_decode(docs.select("doc_id", "text"), most=3, keep_ids=True).collect()}
    for r in docs.where("doc_id IS NOT NULL").collect():
        e = coder.library.encode(r["text"] or "", add_special_tokens=False).ids
        got = out[r["doc_id"], len(e)]
        assert got["ids"] == e and got["decoded"] == coder.library.decode(e, skip_special_tokens=False)
        assert got["ids_sha256"] == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()
    assert bpe.encode_decode(empty(docs).select("doc_id", "text")).count() == 0


def test_packing_counts_the_library_s_ids(spark, coder, tmp_path):
    import corpus_pipeline
    from fairground.llm.queries import QUERIES

    texts = [*TEXTS, *ODD, "QmFzZTY0" * 400]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: len(coder.library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for out in (QUERIES["op3_packing"](spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        rows = out.collect()
        assert {r["doc_id"]: r["n_tokens"] for r in rows} == want and len(rows) == len(texts)
        batches = defaultdict(list)
        for r in rows:
            batches[r["bucket"], r["batch"]].append(want[r["doc_id"]])
        assert all(len(b) == 1 or sum(b) <= packing.BUDGET for b in batches.values())


def test_packed_words_round_trip(tmp_path):
    rng = np.random.default_rng(0)
    for k in range(60):
        docs = [np.array([int(rng.integers(0, 1 << 62)) >> int(rng.integers(0, 63)) if rng.random() > 0.02 else (1 << 64) - 1 for _ in range(rng.integers(0, (4, 300, 9000)[k % 3]))], dtype=np.uint64) for _ in range(4)]
        docs.append(np.zeros(500, np.uint64))
        file = tokenfile.TokenFile(f"file://{tmp_path}", k)
        for i, d, (words, blocks) in zip([None, 1, 2, 3, 4], docs, tokenfile.pack_documents(docs), strict=True):
            file.add(i, len(d), blocks, words)
        number, name, n, values = file.close()
        assert (number, n, values) == (k, 5, sum(map(len, docs)))
        ids, back = [], []
        with open(name.removeprefix("file://"), "rb") as written:
            for i, lengths, values in tokenfile.read_file(written, 1000):
                ids += i
                back += np.split(values, np.cumsum(lengths)[:-1])
        assert ids == [None, 1, 2, 3, 4] and all(np.array_equal(a, b) for a, b in zip(docs, back, strict=True))


def test_token_files_match_the_library(docs, coder):
    out = sorted((r for r in tokenfile.token_table(docs).collect()), key=lambda r: r["start"])
    rows = sorted((r for r in docs.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in out] == [r["doc_id"] for r in rows]
    start, left = 0, defaultdict(list)
    for r in rows:
        ids = [*coder.library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        left[r["doc_id"]].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in out:
        assert r["start"] == start
        left[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        start += r["n_tokens"]
    assert tokenfile.token_table(empty(docs)).count() == 0
    with pytest.raises(TypeError):
        tokenfile.token_table(docs.withColumn("doc_id", tokenfile.F.col("doc_id").cast("string")))


def test_an_id_of_most_rows_fills_several_files(spark, coder):
    rows = [(7, f"text {i % 50} of {i % 7}") for i in range(700)] + [(i, f"other {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = tokenfile.table_path(spark, "hot")
    files = tokenfile.write_tokens(docs, folder, ranges=8)
    assert sum(f[2] for f in files) == 800 and max(f[2] for f in files) < 400
    out = tokenfile.read_tokens(spark, files).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == sorted(r[0] for r in rows) and out[-1]["start"] + out[-1]["n_tokens"] == sum(f[3] for f in files)
    want = sorted(len(coder.library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sorted(r["n_tokens"] for r in out) == want


def test_media_round_trip(docs):
    for t in TEXTS:
        payload = media.payload_of(t)
        raw = (t or "").encode()
        assert payload[: len(raw)] == raw and set(payload[len(raw) :]) <= {255} and len(payload) % 576 == 0 and payload
        assert media.from_png(media.to_png(payload)) == payload
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"a" * 576)[:-6] + b"broken")
    plain = docs.select("doc_id", "text")
    columns = ["n_bytes", "payload_sha256", "tail_crc32"]
    features = media.media_features(media.media_store(plain))
    shown = media.resolve(media.sequences(media.illustrated(plain)), features, "doc_id", columns).collect()
    assert len(shown) == docs.count()
    texts = {hashlib.sha256(media.payload_of(t)).hexdigest(): t or "" for t in [*TEXTS, "only"]}
    for r in shown:
        at = [i for i in r["sequence"] if i["kind"] == "media"]
        assert len(at) == 1 and [i["position"] for i in r["sequence"]] == list(range(len(r["sequence"])))
        text = texts[at[0]["payload_sha256"]]
        assert at[0]["n_bytes"] == len(text.encode()) and at[0]["tail_crc32"] == zlib.crc32(media.payload_of(text)[-32:])
        assert at[0]["caption"].startswith("Text of document") and at[0]["position"] == 1 + bool(text.split("\n")[0].strip())
        assert [" ".join(x.split()) for x in text.split("\n") if x.strip()] == [i["text"] for i in r["sequence"][1:] if i["kind"] == "text"]
        assert all(i["n_bytes"] is None for i in r["sequence"] if i["kind"] == "text")
    assert media.media_features(media.media_store(empty(plain))).count() == 0


def test_sequences_keep_order_and_captions(spark):
    html = "<h1>T&amp;U</h1><script>var x='<img src=no>'</script><p>one<img src='sha256:aa' alt='alt'>two</p><figure><img src='sha256:bb'><img src=http://x/y.png><figcaption>both <b>of</b> them</figcaption></figure><p>end"
    items = media.sequence(html)
    assert [(i["kind"], i["text"] or i["digest"] or i["src"], i["caption"]) for i in items] == [("text", "T&U", None), ("text", "one", None), ("media", "aa", "alt"), ("text", "two", None), ("media", "bb", "both of them"), ("media", "http://x/y.png", "both of them"), ("text", "end", None)]
    assert media.sequence(None) == [] and [i["position"] for i in items] == list(range(7))
    pages = media.sequences(spark.createDataFrame([(1, html), (1, html), (2, None)], "page_id long, html string"))
    found = {r["page_id"]: r["sequence"] for r in media.resolve(pages, spark.createDataFrame([("bb", 7)], "digest string, size int"), "page_id", ["size"]).collect()}
    assert [i["size"] for i in found[1]] == [None, None, None, None, 7, None, None] and found[2] == []


def brute_isotonic(y):
    """The least-squares rising fit, by the max-min formula over all blocks."""
    n = len(y)
    return [max(min(np.mean(y[a : b + 1]) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]


def test_malformed_pages_lose_no_text():
    shape = lambda html: [(i["text"] or i["src"], i["caption"]) for i in media.sequence(html)]
    assert shape("<html><head><title>t</title><body><p>hello <img src=q>") == [("hello", None), ("q", None)]
    assert shape("<figure><img src=a><figcaption>x</figure></figcaption>after") == [("a", "x"), ("after", None)]
    assert shape("<figure><img src=a><figcaption>c</figure><p>after") == [("a", "c"), ("after", None)]
    assert shape("<figure><figcaption>only</figcaption></figure>rest") == [("only", None), ("rest", None)]
    assert shape("<title>never closed<p>text</p>") == [("never closed", None), ("text", None)]
    assert shape("<noscript>a<p>b") == [("a", None), ("b", None)] and shape("<script>never closed") == []
    assert shape("<![foo bar]]>text") == [("<![foo bar]]>text", None)]
    assert shape("<figure><img src=a><figcaption>c<figure><img src=b><figcaption>d</figure>e</figure>f") == [("a", "c e"), ("b", "d"), ("f", None)]
    rng = random.Random(5)
    parts = [f"<{c}{t}{e}>" for t in ("figure", "figcaption", "head", "body", "p", "title", "noscript", "template", "br") for c in ("", "/") for e in ("", "/")] + ["<img src=m>", "<![x", "<!--", "-->", "&am ", "<!d>"]
    for _ in range(3000):
        words = [f"w{i}" for i in range(6)]
        html = "".join(rng.choice(parts) + w for w in words for _ in range(1)) + rng.choice(parts)
        found = " ".join(f"{i['text'] or ''} {i['caption'] or ''}" for i in media.sequence(html))
        if not any(x in html for x in ("title", "noscript", "template", "<!", "-->")):
            assert all(w in found for w in words), html


def test_isotonic_levels_rise_and_are_least_squares():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        x, y = rng.permutation(n).astype(float), rng.integers(0, 2, n).astype(float)
        knots, levels = quality.pool_adjacent(x, y)
        fitted = levels[np.searchsorted(knots, np.sort(x), side="right") - 1]
        assert np.allclose(fitted, brute_isotonic(y[np.argsort(x)])) and (np.diff(levels) > 0).all()


def test_ridge_sums_are_the_normal_equations(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["Aa", "bb!", "c1", "dd,", "ee"]) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, len(t) % 2) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, features=32)
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    rows = [(quality.statistics(t), len(t) % 2) for i, t in enumerate(texts) if fold(i) not in (2, quality.CALIBRATION_FOLD)]
    stats, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    assert np.allclose(model.mean, stats.mean(0))
    z = model.features(stats)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    held = [(quality.statistics(t), len(t) % 2) for i, t in enumerate(texts) if fold(i) == quality.CALIBRATION_FOLD]
    order = np.argsort(model.raw(np.array([h[0] for h in held])))
    fitted = np.interp(model.raw(np.array([h[0] for h in held]))[order], model.knots, model.levels)
    assert (np.diff(fitted) >= -1e-12).all() and len(model.knots) >= 1


def test_naive_bayes_ratios_scale_the_features():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 12)).astype(np.uint32) for _ in range(300)]
    y = np.array([float((r < 5).sum() >= 2) for r in rows])
    weight = np.where(y == 1, 1.0, 2.0)
    x = np.zeros((300, 50))
    for i, r in enumerate(rows):
        x[i, r] = 1
    model = toxicity.fit_rows([r.copy() for r in rows], y, weight, in_texts=1)
    hits, misses = weight * y @ x + toxicity.SMOOTH, weight * (1 - y) @ x + toxicity.SMOOTH
    ratio = np.log(hits / hits.sum()) - np.log(misses / misses.sum())

    def loss(w, b):
        z = x @ (ratio * w) + b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum() + toxicity.RIDGE / 2 * w @ w

    w = model.weights[:50] / ratio
    best = loss(w, model.bias)
    assert best < loss(np.zeros(50), np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    for k in range(50):  # no step along an axis makes it clearly better
        for step in (-0.05, 0.05):
            assert loss(w + step * (np.arange(50) == k), model.bias) > best - 1e-4
    assert not toxicity.fit_rows([r.copy() for r in rows], y, weight, in_texts=400).weights.any()


def test_training_rows_are_of_the_table_and_count_an_id_once(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(200)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1000)], "doc_id long, toxic int")
    rows = labels_.training_rows(docs, labels, "toxic", 20, balanced=True).collect()
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    hits = sum(i % 3 == 0 for i in ids)
    assert len({r["id"] for r in rows}) == len(rows) == 20 and {r["id"] for r in rows} <= set(ids)
    assert all(r["text"] == min(f"text {k}" for k in range(r["id"], 200, 40)) for r in rows)
    assert abs(sum(r["weight"] for r in rows if r["y"]) - hits) < 1e-9 and abs(sum(r["weight"] for r in rows) - len(ids)) < 1e-9


def test_toxicity_sample_is_bounded_by_its_ngrams(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(60)] + [(60, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, toxic int")
    seen, fit = [], toxicity.fit_rows
    try:
        toxicity.fit_rows = lambda rows, y, weight, **more: seen.append((len(rows), sum(map(len, rows)), weight.sum())) or fit(rows, y, weight, **more)
        for most in (4_000, 10**9):
            toxicity.fit_toxicity(docs, labels, most_grams=most)
    finally:
        toxicity.fit_rows = fit
    assert 0 < seen[0][1] <= 4_000 < seen[1][1] and seen[0][0] < seen[1][0] and abs(seen[0][2] - seen[1][2]) < 1e-6


def _labelled(spark, make, n=800):
    rng = random.Random(4)
    rows = [(i, *make(rng, i)) for i in range(n)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows] + [(n, None), (n + 1, ""), (None, "x")], "doc_id long, text string"), spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (n, None, None)], "doc_id long, quality int, toxic int"), {i: y for i, _, y in rows}


def _auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])


def test_quality_tells_junk_from_prose(spark):
    words = ["the", "river", "ran", "past", "old", "mills", "and", "quiet", "farms", "under", "grey", "skies"]

    def make(rng, i):
        prose = " ".join(rng.choice(words) for _ in range(rng.randint(20, 80)))
        return (prose.upper().replace(" ", "!! "), 0) if i % 5 == 0 else (prose + ".", 1)

    docs, labels, truth = _labelled(spark, make)
    out = quality.with_quality(docs, quality.fit_quality(docs, labels)).collect()
    held = [(r["score"], truth[r["doc_id"]]) for r in out if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(out) == 803 and _auc(held) > 0.99 and all(0 <= r["score"] <= 1 for r in out)
    none = quality.with_quality(docs, quality.fit_quality(docs, labels.limit(0))).collect()
    assert {round(r["score"], 2) for r in none} == {0.5}
    assert quality.with_quality(docs.limit(0), quality.fit_quality(docs.limit(0), labels)).count() == 0


def test_toxicity_tells_insults(spark):
    words = ["the", "river", "ran", "past", "old", "mills", "and", "quiet", "farms", "under"]

    def make(rng, i):
        prose = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        if i % 6 == 0:
            prose[rng.randrange(len(prose))] = rng.choice(["grumbak", "grumbaks", "Grumbaky"])
        return " ".join(prose), int(i % 6 == 0)

    docs, labels, truth = _labelled(spark, make)
    out = toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    held = [(r["score"], truth[r["doc_id"]]) for r in out if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(out) == 803 and _auc(held) > 0.99 and np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.98
    one = toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, labels.where("toxic = 0"))).collect()
    assert max(r["score"] for r in one) < 0.1
    assert {r["score"] for r in toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, labels.limit(0))).collect()} == {0.5}


CLASHES = ["__length", "__block", "__cut", "__lines", "__rid", "__order", "__cell", "_before", "row", "rank", "id", "key", "block", "score", "n_tokens", "ids_sha256", "bucket", "slot", "shard", "n_lines", "sequence", "hot", "at"]


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents with a column of every name that an operator might want, which must come back as they were."""
    texts = ["a b c d e f g", "l1\nl2\nl3\nl4", "x\nl1\nl2\nl3\ny", None, "", "same", "same", "word " * 3_000]
    rows = [(i, t, *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts)] + [(5, "same", *[f"{c}5" for c in CLASHES])]
    names = [f"`{c}` string" for c in CLASHES if c not in ("id",)] + ["`id` string"]
    order = ["doc_id", "text", *[c for c in CLASHES if c != "id"], "id"]
    made = [(r[0], r[1], *[dict(zip(CLASHES, r[2:], strict=True))[c] for c in order[2:]]) for r in rows]
    return spark.createDataFrame(made, ", ".join(["doc_id long, text string", *names]))


def kept_columns(out, docs, without=()):
    names = [c for c in docs.columns if c not in without]
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    mine = lambda df: sorted(tuple(r[c] for c in names) for r in df.collect()) if "text" not in names else sorted((tuple(r[c] for c in names if c != "text") for r in df.collect()), key=key)
    assert mine(out) == mine(docs) and len({c.lower() for c in out.columns}) == len(out.columns)


def test_columns_of_any_name_come_back(crowded, coder):
    kept_columns(line_dedup.line_dedup(crowded), crowded)
    kept_columns(sharding.shuffle_into_shards(crowded, shards=3), crowded)
    kept_columns(packing.pack(bpe.token_counts(crowded), "_n_tokens"), crowded, ["text"])
    model = quality.QualityModel(np.zeros(16), np.ones(16), np.zeros((16, 4)), np.zeros(4), np.zeros(21), np.array([0.0]), np.array([0.5]))
    kept_columns(quality.with_quality(crowded, model), crowded)
    kept_columns(toxicity.with_toxicity(crowded, toxicity.ToxicityModel(np.zeros(1 << toxicity.BITS, np.float32), 0.0)), crowded)
    kept_columns(bpe.encode_decode(crowded, keep_ids=True), crowded, ["text"])
    kept_columns(near.near_dedup(crowded).unionByName(crowded.where("doc_id IN (4, 6)")), crowded.dropDuplicates(["doc_id"]))
    kept_columns(media.sequences(crowded.withColumn("html", media.F.lit("<p>x"))), crowded)
    for out in (exact_dedup.exact_dedup(crowded), simhash.simhash_dedup(crowded), tokenfile.token_table(crowded), media.resolve(media.sequences(media.illustrated(crowded)), media.media_features(media.media_store(crowded)), "doc_id", ["n_bytes"])):
        assert out.count() == crowded.count()


def test_classifiers_take_empty_tables_repeated_rows_and_long_texts(spark):
    long_ = "word\n" * 400_000
    docs = spark.createDataFrame([(i % 30, f"text {i} good") for i in range(60)] + [(100, long_), (101, long_), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(102)], "doc_id long, quality int, toxic int")
    for fit, score in ((quality.fit_quality, quality.with_quality), (toxicity.fit_toxicity, toxicity.with_toxicity)):
        out = score(docs, fit(docs, labels)).collect()
        assert len(out) == 63 and len({r["score"] for r in out if r["doc_id"] in (100, 101)}) == 1
        assert score(docs.limit(0), fit(docs.limit(0), labels)).count() == 0
    assert media.sequences(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_equal_rows_spread_over_blocks(spark):
    docs = spark.createDataFrame([(7, "same")] * 3_000 + [(i, "other") for i in range(600)], "doc_id long, text string").repartition(5)
    out = sharding.shuffle_into_shards(docs, shards=8, seed=3).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(out) == 3_600 and all(sorted(s) == list(range(450)) for s in slots.values())
    hot = [sum(r["shard"] == s and r["doc_id"] == 7 for r in out) for s in range(8)]
    assert all(abs(h - 375) < 6 * (450 * 5 / 36) ** 0.5 for h in hot)
    again = sharding.shuffle_into_shards(docs.repartition(2), shards=8, seed=3).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
