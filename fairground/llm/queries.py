"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokens
from .bpe import encode_decode, token_counts
from .common import read
from .exact_dedup import exact_dedup
from .labels import HELD_OUT, fold
from .line_dedup import line_dedup
from .media import illustrated, media_features, media_store, resolve, sequences
from .minhash import minhash_dedup
from .packing import pack
from .quality import fit_quality, with_quality
from .sharding import shuffle_into_shards
from .simhash import simhash_dedup
from .tokenfile import token_table
from .toxicity import fit_toxicity, with_toxicity
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, compress

#: A document passes for good from this quality on, and for toxic from this toxicity on.
GOOD, TOXIC = 0.7, 0.3


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "removed_lines", "removed_spans", "text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = shuffle_into_shards(docs, shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(read(spark, sf_dir, "documents").select("doc_id", "text")), "n_tokens")


def scored(docs: DataFrame, threshold: float) -> DataFrame:
    return docs.select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return scored(with_quality(docs, model), GOOD)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    digests = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    shown = resolve(sequences(illustrated(docs), outline=True), media_features(media_store(docs)), "doc_id", digests)
    media = F.get(F.filter("sequence", lambda x: x["kind"] == "media"), F.lit(0))
    chars = F.aggregate("sequence", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["text"].cast("long"), F.lit(0)))
    return shown.select("doc_id", *[media[c].alias(c) for c in [*digests, "position", "caption"]], F.size("sequence").alias("n_items"), chars.alias("text_chars"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return scored(with_toxicity(docs, model), TOXIC)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="max")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read(spark, sf_dir, "embeddings"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(read(spark, sf_dir, "documents"))


def vector_codes_sql() -> str:
    """op12 in SQL: a CTE for each round's assignment and codebooks."""
    steps = [
        f"""kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {PARTS} AS width FROM kept),
comp AS MATERIALIZED (
  SELECT vec_id, CAST(i // width AS INTEGER) AS part, CAST(i % width AS INTEGER) AS pos, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM flat),
firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
book0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM comp JOIN firsts USING (vec_id))"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""apart{r} AS (
  SELECT vec_id, v.part AS part, entry, sum((x - c) * (x - c)) AS d FROM comp v JOIN book{r} b ON v.part = b.part AND v.pos = b.pos GROUP BY vec_id, v.part, entry),
best{r} AS MATERIALIZED (
  SELECT vec_id, part, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) AS k FROM apart{r}) WHERE k = 1)""")
        if r < ROUNDS:
            steps.append(f"""mean{r} AS (
  SELECT v.part AS part, entry, pos, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM comp v JOIN best{r} b ON v.vec_id = b.vec_id AND v.part = b.part GROUP BY v.part, entry, pos),
book{r + 1} AS MATERIALIZED (
  SELECT b.part AS part, b.entry AS entry, b.pos AS pos,
         CASE WHEN n IS NULL THEN c ELSE (total - ((total % n) + n) % n) // n END AS c
  FROM book{r} b LEFT JOIN mean{r} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)""")
    steps.append(f"""codes AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM best{ROUNDS} GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{ROUNDS})""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), digest"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_packing, op4_quality, op5_media, op6_bpe, op7_toxicity, op8_token_files, op9_exact_dedup, op10_simhash, op11_alignment, op12_vector_codes, op13_minhash)}

ORACLE: dict[str, str] = {
    "op1_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS nr
  FROM documents),
full_lines AS (
  SELECT doc_id, nr, line, row_number() OVER (PARTITION BY doc_id ORDER BY nr) - 1 AS k
  FROM lines WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
windows AS (
  SELECT doc_id, k, nr AS a0, lead(nr) OVER d AS a1, lead(nr, 2) OVER d AS a2,
         line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d AS body
  FROM full_lines WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS nth FROM windows WHERE body IS NOT NULL),
cut AS (
  SELECT DISTINCT doc_id, unnest([a0, a1, a2]) AS nr FROM ordered WHERE nth > 1),
islands AS (
  SELECT doc_id, min(nr) AS lo, max(nr) AS hi
  FROM (SELECT doc_id, nr, nr - row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS island FROM cut)
  GROUP BY doc_id, island),
spans AS (
  SELECT doc_id, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS removed_spans, sum(hi - lo + 1)::BIGINT AS removed_lines
  FROM islands GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.nr) AS text
  FROM lines l LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.nr = l.nr WHERE c.nr IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines,
       coalesce(s.removed_lines, 0)::BIGINT AS removed_lines, coalesce(s.removed_spans, '') AS removed_spans,
       CASE WHEN s.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
       doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op12_vector_codes": vector_codes_sql(),
    "op13_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM placed),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, b AS other FROM both_ways
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
lowest AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)""",
}
