"""Streams over the driver's tables, drained, so that SQL over the same rows can check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Snapshots, table_path
from ..streaming import incremental
from .catalog import query
from .standins import table


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


@query("""SELECT user_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS started, count(*) AS attempts FROM (SELECT user_id, ts, unnest([time_bucket(INTERVAL '6' HOUR, ts) , time_bucket(INTERVAL '6' HOUR, ts) - INTERVAL '6' HOUR]) AS w FROM events) GROUP BY user_id, w""")
def stream_attempt_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of twelve hours, every six, over the stream of events."""
    counts = incremental.attempts_by_window(_stream(spark, sf_dir), "user_id", "ts", "1 day", "12 hours", "6 hours")
    path = table_path(spark, "windows")
    return incremental.drain(counts, "complete", spark, path, f"{path}-state").select("user_id", F.date_format("from", "yyyy-MM-dd HH:mm:ss").alias("started"), "attempts")


@query("SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS period_key FROM events WHERE event_type = 'purchase'")
def stream_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim for each user and day, however often it is asked for."""
    asked = _stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("period_key"))
    ledger = Snapshots(spark, table_path(spark, "ledger"), ["user_id", "period_key"])
    incremental.claims_stream(asked, ledger, table_path(spark, "claims"), ["user_id", "period_key"]).awaitTermination()
    return ledger.read()
