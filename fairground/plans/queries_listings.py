"""From raw events to listings, and from listings to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes, places, rules, times, titles
from ..functions.similarity import RULES
from ..operators import clusters, pairs, reconcile
from ..operators.normalize import FIELDS, judged, normalize
from ..operators.same import same_pairs
from ..storage import materialize
from . import oracle as O
from .catalog import query
from .runs import cluster
from .standins import homes, raw_events

RAW = f"WITH {O.RAW}"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(judged(raw_events(spark, sf_dir)), homes(spark))


def key(*columns: str):
    return [F.concat_ws(":", "source_slug", "external_id").alias("id"), F.col("position"), *columns]


K = "source_slug || ':' || external_id AS id, position"


@query(f"{RAW} SELECT {K}, {O.clean_title('title')} AS clean_title, {O.status('title')} AS stated_status FROM raw")
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).select(*key(), titles.clean_title(F.col("title")).alias("clean_title"), titles.stated_status(F.col("title")).alias("stated_status"))


@query(f"{RAW} SELECT {K}, {O.is_meeting('title', 'label')} AS meeting, {O.category('title', 'label')} AS category FROM raw")
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_events(spark, sf_dir)
    return raw.select(*key(), titles.is_meeting(F.col("title"), F.col("categories")).alias("meeting"), rules.classify(F.col("title"), F.col("categories")).alias("category"))


@query(f"{RAW}, v AS (SELECT *, {O.cost('is_free', 'cost_text', 'title', 'description')} AS v FROM raw) SELECT {K}, split_part(v, '/', 1) AS cost, split_part(v, '/', 2) AS confidence, {O.has('description', O.R.MONEY)} AS money, {O.has('description', O.R.FUNDRAISING)} AS fundraising FROM v")
def cost_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = rules.assess_cost(F.col("is_free"), F.col("cost_text"), F.col("title"), F.col("description"))
    raw = raw_events(spark, sf_dir).withColumn("v", verdict)
    return raw.select(*key(), "v.cost", "v.confidence", rules.contains_money(F.col("description")).alias("money"), rules.looks_like_fundraising(F.col("description")).alias("fundraising"))


@query()
def cost_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = rules.assess_cost(F.col("is_free"), F.col("cost_text"), F.col("title"), F.col("description"), evidence=True)
    return raw_events(spark, sf_dir).withColumn("v", verdict).select(*key(), "v.cost", "v.confidence", "v.evidence")


@query(f"""{RAW}, v AS (SELECT *, CASE WHEN position % 3 = 0 THEN upper(substr(description, 1, 12)) WHEN position % 3 = 1 THEN 'never said $5' ELSE description END AS quote FROM raw),
w AS (SELECT *, {O.squeeze('quote')} AS said, split_part({O.cost('NULL::BOOLEAN', 'quote', 'title', 'NULL::VARCHAR')}, '/', 1) AS ruled FROM v)
SELECT {K}, CASE WHEN NOT contains(lower({O.squeeze('description')}), lower(said)) THEN 'unknown' WHEN ruled <> 'unknown' THEN ruled
  WHEN {O.has('said', O.R.MONEY)} AND length(said) <= 140 AND NOT {O.has('said', O.R.FUNDRAISING)} THEN 'paid' ELSE 'unknown' END AS decided FROM w""")
def cost_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.pmod(F.col("position"), F.lit(3))
    quote = F.when(third == 0, F.upper(F.substring("description", 1, 12))).when(third == 1, "never said $5").otherwise(F.col("description"))
    return raw_events(spark, sf_dir).select(*key(), rules.decide_cost(F.col("description"), F.col("title"), quote).alias("decided"))


@query(f"{RAW} SELECT {K}, {O.municipality('municipality_hint', 'address', 'venue_name')} AS by_place, {O.municipality('title')} AS by_title FROM raw")
def place_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = places.resolve_municipality
    return raw_events(spark, sf_dir).select(*key(), named(F.col("municipality_hint"), F.col("address"), F.col("venue_name")).alias("by_place"), named(F.col("title")).alias("by_title"))


@query(f"WITH {O.RAW}, {O.JUDGED} SELECT {K}, reason FROM judged WHERE reason IS NOT NULL")
def skipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(raw_events(spark, sf_dir)).where(F.col("reason").isNotNull()).select(*key("reason"))


ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.000Z')"
SHOWN = "id, source_kind, municipality_slug, title, description, category, local_date, local_time, time_precision, all_day, venue_name, address, cost, cost_text, organizer, image_url, url, status"


@query(f"{O.BASE} SELECT {SHOWN}, {ISO.format('starts')} AS starts_at_utc, {ISO.format('ends')} AS ends_at_utc FROM listings")
def normalize_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = listings(spark, sf_dir)
    return shown.select(*SHOWN.split(", "), times.iso(F.col("starts_at")).alias("starts_at_utc"), times.iso(F.col("ends_at")).alias("ends_at_utc"))


FNV = "lpad(to_hex(list_reduce(list_prepend({start}::HUGEINT, list_transform(string_split({text}, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h, c) * {by}::HUGEINT) % 4294967296::HUGEINT)::BIGINT), 8, '0')"
HASH = lambda text: f"lower({FNV.format(start=0x811C9DC5, by=0x01000193, text=text)} || {FNV.format(start=0x01000193, by=0x85EBCA6B, text=text)})"


@query(f"SELECT d AS doc_id, h AS hash, CASE WHEN h = '' THEN '' ELSE lpad(substr(regexp_replace(h, '^0+', ''), 1, 7), 7, '0') END AS short_code FROM (SELECT doc_id AS d, {HASH('t')} AS h FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each whole text; a null one counts as empty."""
    from .standins import table

    whole = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", hashes.text_hash(whole).alias("hash"), hashes.short_code(whole).alias("short_code"))


JSON = "'[' || concat_ws(',', to_json(title), coalesce(to_json(description), 'null'), to_json(local_start), coalesce(to_json(local_end), 'null'), all_day, to_json(time_precision), coalesce(to_json(venue_name), 'null'), coalesce(to_json(address), 'null'), coalesce(to_json(cost_text), 'null'), coalesce(is_free::VARCHAR, 'null'), to_json([label]), coalesce(to_json(organizer), 'null'), coalesce(to_json(image_url), 'null'), to_json(url)) || ']'"


@query(f"WITH {O.RAW}, {O.JUDGED}, v AS (SELECT *, raw_start AS local_start, end_wall AS local_end FROM judged) SELECT {K}, {JSON} AS content, {HASH(JSON)} AS content_hash FROM v")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_events(spark, sf_dir)
    fields = {f: F.col(f) for f in FIELDS}
    return raw.select(*key(), hashes.content_text(fields).alias("content"), hashes.content_hash(fields).alias("content_hash"))


@query(f"{O.BASE}, {O.FEATURES} SELECT id, array_to_string(tokens, ' ') AS tokens, len(grams)::INTEGER AS grams, street, array_to_string(list_sort(place), ' ') AS place, venue, page, last_date FROM feat")
def listing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs.featured(listings(spark, sf_dir))
    return rows.select("id", F.array_join("_tokens", " ").alias("tokens"), F.size("_grams").alias("grams"), F.col("_street").alias("street"), F.array_join(F.array_sort("_place"), " ").alias("place"), F.col("_venue").alias("venue"), F.col("_page").alias("page"), F.col("_last").alias("last_date"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.score_pairs(pairs.candidate_pairs(listings(spark, sf_dir).select(*pairs.READ)))


@query(f"{O.BASE}, {O.FEATURES}, {O.PAIRS} SELECT a, b FROM pairs")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.candidate_pairs(listings(spark, sf_dir).select(*pairs.READ).drop("content_hash")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


@query(f"{O.BASE}, {O.FEATURES}, {O.PAIRS} SELECT a, b, round(title, 9) AS title, time, place, same_page::INTEGER AS url, round(score, 9) AS score, verdict, same_place FROM verdicts")
def score_and_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(spark, sf_dir).select("a", "b", F.round("title", 9).alias("title"), "time", "place", "url", F.round("score", 9).alias("score"), "verdict", "same_place")


@query(f"{O.BASE}, {O.FEATURES}, {O.PAIRS} SELECT verdict, count(*) AS pairs, round(min(score), 6) AS low, round(max(score), 6) AS high FROM verdicts GROUP BY verdict")
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("pairs"), F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high"))


def _decisions(scored: DataFrame) -> DataFrame:
    """Earlier verdicts for a third of the pairs: some of other rules, some of a judge, some for older text."""
    n = F.pmod(F.crc32(F.concat("a", "b").cast("binary")), F.lit(9))
    method = F.when(n == 0, RULES).when(n == 1, "rule:v2").otherwise("judge")
    return scored.where(n < 3).select("a", "b", F.when(n == 2, F.col("hash_a")).when(n == 0, F.col("hash_a")).otherwise(F.lit("old")).alias("hash_a"), "hash_b", F.lit("same").alias("verdict"), method.alias("method"))


@query(f"""{O.BASE}, {O.FEATURES}, {O.PAIRS} SELECT a, b, CASE WHEN crc % 9 IN (0, 2) THEN 'same' ELSE verdict END AS verdict, crc % 9 IN (0, 2) AS cached, CASE WHEN crc % 9 = 2 THEN 'judge' ELSE '{RULES}' END AS method
FROM (SELECT *, a || b AS ab FROM verdicts) JOIN (SELECT 1) ON TRUE, LATERAL (SELECT list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(ab)), lambda i: ascii(substr(ab, (i + 1)::BIGINT, 1))::BIGINT)),
  lambda h, c: list_reduce(list_prepend(xor(h, c), range(8)::BIGINT[]), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS r), LATERAL (SELECT xor(r, 4294967295) AS crc)""")
def verdict_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = materialize(scored_pairs(spark, sf_dir).select("a", "b", "verdict", "hash_a", "hash_b"), "scored")
    return pairs.with_decisions(scored, _decisions(scored)).select("a", "b", "verdict", "cached", "method")


def roots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(listings(spark, sf_dir), "listings")
    return rows, materialize(clusters.cluster_roots(rows, same_pairs(rows)), "roots")


@query()
def clusters_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that never join two municipalities: an ordered fold, which SQL has no words for; tests hold it against brute force."""
    return roots(spark, sf_dir)[1]


def _placed_once(rows: DataFrame) -> DataFrame:
    return rows.withColumn("municipality_slug", F.lit("one"))


COMPONENTS = """reach AS (
  SELECT id AS node, id AS root FROM {nodes} UNION SELECT e.y, r.root FROM reach r JOIN ends e ON e.x = r.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""
SAME = f"""ends AS (SELECT a AS x, b AS y FROM verdicts WHERE verdict = 'same' UNION SELECT b, a FROM verdicts WHERE verdict = 'same')"""
RECURSIVE = O.BASE.replace("WITH ", "WITH RECURSIVE ", 1)
STATED = " + ".join(f"(coalesce({c}::VARCHAR, '') <> '')::INTEGER" for c in ("description", "venue_name", "address", "cost_text", "image_url", "ends", "organizer"))


@query(f"""{RECURSIVE}, {O.FEATURES}, {O.PAIRS}, {SAME}, {COMPONENTS.format(nodes='listings')},
members AS (SELECT l.*, c.root, row_number() OVER (PARTITION BY c.root ORDER BY l.priority, -({STATED} + 2 * (time_precision = 'exact')::INTEGER), l.id) AS nth FROM listings l JOIN comp c ON c.node = l.id)
SELECT max(CASE WHEN nth = 1 THEN id END) AS representative_id, string_agg(id, ',' ORDER BY id) AS listing_ids, count(*)::INTEGER AS listing_count,
       max(CASE WHEN nth = 1 THEN title END) AS title, max(CASE WHEN nth = 1 THEN category END) AS category, max(CASE WHEN nth = 1 THEN url END) AS url,
       arg_min(description, nth) FILTER (description <> '') AS description, arg_min(venue_name, nth) FILTER (venue_name <> '') AS venue_name,
       arg_min(address, nth) FILTER (address <> '') AS address, arg_min(organizer, nth) FILTER (organizer <> '') AS organizer, arg_min(image_url, nth) FILTER (image_url <> '') AS image_url,
       coalesce(arg_min(cost, nth) FILTER (cost <> 'unknown'), 'unknown') AS cost,
       CASE WHEN bool_or(status = 'cancelled') THEN 'cancelled' ELSE max(CASE WHEN nth = 1 THEN status END) END AS status
FROM members GROUP BY root""")
def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of plain components (as if all were one municipality), which a recursive query can check."""
    rows = materialize(listings(spark, sf_dir), "listings")
    found = clusters.cluster_roots(_placed_once(rows), same_pairs(rows))
    made = clusters.canonical(rows.join(found, "id"), homes(spark).select(F.col("slug").alias("source_slug"), "priority"))
    return made.select("representative_id", F.array_join("listing_ids", ",").alias("listing_ids"), "listing_count", "title", "category", "url", "description", "venue_name", "address", "organizer", "image_url", "cost", "status")


@query()
def events_with_sticky_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole second run after a whole first one over what was stored then: clusters keep the ids that the first run
    gave, short codes follow, and ids that no cluster carries any more are rows of their own, marked closed."""
    rows = materialize(listings(spark, sf_dir), "listings")
    priorities = homes(spark).select(F.col("slug").alias("source_slug"), "priority")
    before = materialize(_stored(rows).withColumn("cluster_id", F.lit(None).cast("string")), "before")
    first, given, _ = cluster(before, same_pairs(before), priorities, spark.createDataFrame([], "id string, created_at timestamp"))
    existing = materialize(first.select("id", F.col("starts_at").alias("created_at")), "existing")
    now = materialize(rows.join(given, "id", "left"), "now")
    events, _, closed = cluster(now, same_pairs(now), priorities, existing)
    shown = events.select("id", "short_code", "representative_id", "listing_count", "municipality_slug", "title", "status")
    gone = {c: F.lit(None).cast(shown.schema[c].dataType) for c in ("representative_id", "listing_count", "municipality_slug", "title")}
    return shown.unionByName(closed.withColumns(gone | {"short_code": hashes.short_code(F.col("id")), "status": F.lit("closed")}))


def _stored(rows: DataFrame) -> DataFrame:
    """What an earlier run left: some rows absent, some with other text, time, status or class, some inactive."""
    n = F.pmod(F.crc32(F.col("external_id").cast("binary")), F.lit(20))
    old = rows.where(n != 0).withColumns({
        "content_hash": F.when(n.isin(1, 2), "old").otherwise(F.lit("same")),
        "starts_at": F.when(n.isin(2, 3), F.col("starts_at") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("starts_at")),
        "status": F.when(n.isin(4, 5), "rescheduled").otherwise(F.col("status")),
        "category": F.when(n == 6, "other").otherwise(F.col("category")),
        "active": ~n.isin(7, 8),
    })
    return old


def _incoming(rows: DataFrame) -> DataFrame:
    n = F.pmod(F.crc32(F.col("external_id").cast("binary")), F.lit(20))
    return rows.withColumn("content_hash", F.lit("same")).where(~n.isin(8, 9) & (F.col("source_slug") != "src6"))


CRC = """crcs AS (SELECT *, (SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(external_id)), lambda i: ascii(substr(external_id, (i + 1)::BIGINT, 1))::BIGINT)),
  lambda h, c: list_reduce(list_prepend(xor(h, c), range(8)::BIGINT[]), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)) % 20 AS n FROM listings)"""


@query(f"""{O.BASE}, {CRC},
told AS (SELECT *, n NOT IN (8, 9) AND source_slug <> 'src6' AS sent, n <> 0 AS known, n NOT IN (7, 8) AS was_active, n IN (2, 3) AS moved, n IN (1, 2) AS rewritten,
         CASE WHEN n IN (4, 5) THEN 'rescheduled' ELSE status END AS old_status, CASE WHEN n = 6 THEN 'other' ELSE category END AS old_category FROM crcs),
steps AS (SELECT *, concat_ws(',', CASE WHEN moved THEN 'starts_at' END, CASE WHEN rewritten THEN 'content' END, CASE WHEN NOT was_active THEN 'reactivated' END,
         CASE WHEN status <> old_status AND NOT rewritten THEN 'status' END) AS steps FROM told WHERE sent OR known)
SELECT id, source_slug, CASE WHEN sent AND NOT known THEN 'insert' WHEN NOT sent AND source_slug = 'src6' THEN CASE WHEN was_active THEN 'refused' ELSE 'gone' END
         WHEN NOT sent THEN CASE WHEN was_active THEN 'remove' ELSE 'gone' END WHEN steps <> '' THEN 'update' WHEN category <> old_category THEN 'reclassify' ELSE 'unchanged' END AS action,
       CASE WHEN sent AND known THEN steps END AS changes,
       CASE WHEN NOT sent THEN NULL WHEN status = 'cancelled' THEN 'cancelled' WHEN known AND moved THEN 'rescheduled' WHEN known AND old_status = 'rescheduled' AND status = 'scheduled' THEN 'rescheduled' ELSE status END AS next_status
FROM steps""")
def reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(listings(spark, sf_dir), "listings")
    return reconcile.plan(_incoming(rows), _stored(rows)).select("id", "source_slug", "action", F.array_join("changes", ",").alias("changes"), "next_status")


@query(f"""{O.BASE}, {CRC},
told AS (SELECT *, n NOT IN (8, 9) AND source_slug <> 'src6' AS sent, n <> 0 AS known FROM crcs)
SELECT id, CASE WHEN sent THEN TRUE WHEN n IN (9) AND source_slug <> 'src6' THEN FALSE ELSE n NOT IN (7, 8) END AS active,
       CASE WHEN NOT known THEN FALSE ELSE n % 2 = 0 END AS has_cluster, CASE WHEN NOT sent AND n = 9 AND source_slug <> 'src6' THEN '2026-01-02' END AS removed_on,
       CASE WHEN NOT sent AND n = 6 THEN 'other' ELSE category END AS category FROM told WHERE sent OR known""")
def reconciled_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(listings(spark, sf_dir), "listings")
    n = F.pmod(F.crc32(F.col("external_id").cast("binary")), F.lit(20))
    before = F.lit("2025-01-01").cast("timestamp")
    stored = _stored(rows).withColumns({"cluster_id": F.when(n % 2 == 0, F.col("id")), "first_seen_at": before, "last_seen_at": before, "removed_at": F.lit(None).cast("timestamp"), "detail_hash": F.lit(None).cast("string"), "detail_attempts": F.lit(0)})
    after = reconcile.apply(_incoming(rows), stored, reconcile.plan(_incoming(rows), stored), "2026-01-02")
    return after.select("id", "active", F.col("cluster_id").isNotNull().alias("has_cluster"), F.date_format("removed_at", "yyyy-MM-dd").alias("removed_on"), "category")



