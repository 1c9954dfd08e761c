"""Limits with feedback, caps, sessions with an age limit, batches for a judge and pages by number, over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback, judging, ranks
from ..storage import Snapshots, table_path
from ..streaming import incremental
from .catalog import query
from .standins import table

#: Sent in ten hours at most; pins of a reader at most; seconds of idleness, of age and between touches on record.
MOST, SPAN, PINS = 3, 36_000, 4
IDLE, AGE, TOUCH = 86_400, 4 * 86_400, 3600
PAGE, SIZE = 7, 60

TAKEN = f"""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS k FROM events),
g AS (SELECT user_id, k, event_id, [t] AS held, TRUE AS accepted FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN len(list_filter(held, lambda x: x > t - {SPAN}000000)) < {MOST} THEN list_append(list_filter(held, lambda x: x > t - {SPAN}000000), t) ELSE held END,
    len(list_filter(held, lambda x: x > t - {SPAN}000000)) < {MOST} FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k + 1)
SELECT event_id, accepted FROM g"""


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as suggestions sent in."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


@query(TAKEN)
def limited_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions that are stored: those of a sender who had fewer than MOST stored in the span before."""
    return feedback.greedy_limit(sent(spark, sf_dir), "user_id", "ts", "event_id", MOST, SPAN).select("event_id", "accepted")


@query(TAKEN)
def stream_limited_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of three batches in the order of time, with what was stored kept between them."""
    rows = sent(spark, sf_dir)
    folder = table_path(spark, "sent")
    bounds = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    third = (bounds["high"] - bounds["low"]) / 3
    for n in range(3):  # files in the order in which they came
        low, high = bounds["low"] + n * third, bounds["low"] + (n + 1) * third
        rows.where((F.col("ts") >= low) & ((F.col("ts") < high) | F.lit(n == 2))).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    ledger = Snapshots(spark, table_path(spark, "limited"), ["user_id"], buckets=4)
    incremental.limit_stream(stream, ledger, table_path(spark, "limit-state"), "user_id", "ts", "event_id", MOST, SPAN).awaitTermination()
    return ledger.read().select("event_id", "accepted")


PINNED = f"""WITH a AS (SELECT o_custkey AS user_id, o_orderkey % 23 AS item, CAST(o_orderdate AS TIMESTAMP) AS came FROM orders),
f AS (SELECT user_id, item, min(came) AS came FROM a GROUP BY user_id, item), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY came, item) AS k FROM f)
SELECT user_id, item, strftime(came, '%Y-%m-%d') AS day FROM r WHERE k <= {PINS}"""


def pin_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 23).alias("item"), F.col("o_orderdate").cast("timestamp").alias("at"))


@query(PINNED)
def capped_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of readers, as many as each may have: orders ask for one of 23 events."""
    asked = pin_requests(spark, sf_dir)
    return feedback.capped(asked.limit(0), asked, "user_id", "item", "at", PINS).select("user_id", "item", F.date_format("at", "yyyy-MM-dd").alias("day"))


@query(PINNED)
def stream_capped_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that is delivered twice, a second time by a query that knows nothing of the first."""
    asked = pin_requests(spark, sf_dir)
    folder = table_path(spark, "asked")
    asked.write.parquet(folder)
    state = Snapshots(spark, table_path(spark, "pins"), ["user_id"], buckets=8)
    for name in ("first", "again"):
        stream = spark.readStream.schema(asked.schema).parquet(folder)
        incremental.cap_stream(stream, state, table_path(spark, name), "user_id", "item", "at", PINS).awaitTermination()
    return state.read().select("user_id", "item", F.date_format("at", "yyyy-MM-dd").alias("day"))


SESSIONS = f"""WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
g AS (SELECT user_id, k, ts AS start, ts AS seen, ts AS moment, NULL::VARCHAR AS ended FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, CASE WHEN {{over}} THEN ts ELSE start END, CASE WHEN {{over}} OR seen + INTERVAL '{TOUCH} seconds' < ts THEN ts ELSE seen END, ts,
    CASE WHEN ts >= start + INTERVAL '{AGE} seconds' THEN 'age' WHEN {{over}} THEN 'idle' END FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k + 1),
b AS (SELECT user_id, start, max(moment) AS last, count(*) AS touches, max(k) AS k FROM g GROUP BY user_id, start)
SELECT b.user_id AS user_id, strftime(b.start, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_at, touches, n.ended AS ended_by
FROM b LEFT JOIN g n ON n.user_id = b.user_id AND n.k = b.k + 1""".format(over=f"(ts >= start + INTERVAL '{AGE} seconds' OR ts >= seen + INTERVAL '{IDLE} seconds')")


def shown_sessions(found: DataFrame) -> DataFrame:
    return found.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started_at", "last_at")], "touches", "ended_by")


@query(SESSIONS)
def limited_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after a day without a touch and in any case after four."""
    return shown_sessions(feedback.limited_sessions(sent(spark, sf_dir), "user_id", "ts", IDLE, AGE, TOUCH))


@query("""WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR) AS b, o_orderkey AS n FROM orders),
r AS (SELECT *, (row_number() OVER (ORDER BY a, b) - 1) // 10 AS batch FROM p WHERE b IS NOT NULL)
SELECT a, b, batch, CASE WHEN batch >= 1000 THEN 'over budget' WHEN batch % 3 = 2 THEN 'failed' WHEN n % 11 = 0 THEN 'no answer' ELSE 'answered' END AS outcome,
  CASE WHEN batch < 1000 AND batch % 3 <> 2 AND n % 11 <> 0 THEN CASE WHEN n % 2 = 0 THEN 'same' ELSE 'distinct' END END AS verdict FROM r""")
def judged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders before a judge who fails every third time, in a thousand calls of ten pairs."""
    from pyspark.sql import Window

    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("a"), after.cast("string").alias("b"), F.col("o_orderkey").alias("n")).where("b IS NOT NULL")

    def ask(batch: list[dict]) -> list[str | None]:
        if batch[0]["batch"] % 3 == 2:
            raise TimeoutError("no answer in time")
        return [None if p["n"] % 11 == 0 else "same" if p["n"] % 2 == 0 else "distinct" for p in batch]

    return judging.judge_batches(pairs, ask, budget=1000)


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rank FROM orders QUALIFY rank BETWEEN {PAGE * SIZE} AND {(PAGE + 1) * SIZE - 1}")
def page_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of all orders by day, found without sorting the others."""
    return ranks.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], PAGE, SIZE).select("o_orderkey", "rank")
