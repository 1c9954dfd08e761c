"""Listings that arrive in batches: reconciled, limited, windowed and claimed as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.feedback import capped, greedy_limit
from ..operators.reconcile import apply, insert_absent, plan
from ..shipping import by_value
from ..storage import Snapshots, drop_materialized, materialize

by_value(__name__)


def reconcile_stream(batches: DataFrame, state: Snapshots, checkpoint: str, now: Callable[[int], str], available_now: bool = True) -> StreamingQuery:
    """Keep a snapshot table up to date with a stream of listings; each micro-batch is one run of the sources in it.

    state is bucketed by source_slug: only the buckets of the sources that a batch holds are read and written
    anew, and in them the other sources' rows pass through. A batch that is delivered again finds its rows
    unchanged, so replays write the same table."""

    def merge(batch: DataFrame, number: int) -> None:
        batch = materialize(batch, "batch")  # read once, used several times
        touched = state.touched(batch)
        stored = state.read(touched)
        empty = batch.limit(0)
        if stored is None:
            stored = apply(empty, with_cursors(empty), plan(empty, with_cursors(empty)), now(number))
        here = batch.select("source_slug").distinct()
        mine = stored.join(F.broadcast(here), "source_slug", "left_semi")
        others = stored.join(F.broadcast(here), "source_slug", "left_anti")
        after = apply(batch, mine, plan(batch, mine), now(number))
        state.replace(after.unionByName(others), touched)
        drop_materialized(batch)

    writer = batches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def with_cursors(listings: DataFrame) -> DataFrame:
    """Listings with the columns that the stored table has besides."""
    nothing = F.lit(None)
    return listings.withColumns({"cluster_id": nothing.cast("string"), "first_seen_at": nothing.cast("timestamp"), "last_seen_at": nothing.cast("timestamp"), "removed_at": nothing.cast("timestamp"), "detail_hash": nothing.cast("string"), "detail_attempts": F.lit(0)})


def attempts_by_window(attempts: DataFrame, key: str, moment: str, late: str = "10 minutes", size: str = "1 hour", step: str = "5 minutes") -> DataFrame:
    """Attempts of a key in sliding windows; rows later than `late` behind the newest no longer count."""
    return attempts.withWatermark(moment, late).groupBy(key, F.window(moment, size, step).alias("w")).agg(F.count("*").alias("attempts")).select(key, F.col("w.start").alias("from"), "attempts")


def sessions(touches: DataFrame, key: str, moment: str, idle: str = "30 days", late: str = "1 day") -> DataFrame:
    return touches.withWatermark(moment, late).groupBy(key, F.session_window(moment, idle).alias("s")).agg(F.count("*").alias("touches")).select(key, F.col("s.start").alias("started_at"), "touches")


def claims_stream(asked: DataFrame, ledger: Snapshots, checkpoint: str, key: list[str]) -> StreamingQuery:
    """An idempotent ledger: the first row of a key is kept, replays and rivals are not.

    ledger is bucketed by key: a batch reads the buckets of its keys, and what it wins is appended."""

    def claim(batch: DataFrame, _: int) -> None:
        batch = materialize(batch, "batch")
        held = ledger.read(ledger.touched(batch))
        ledger.append(batch.dropDuplicates(key) if held is None else insert_absent(held, batch, key))
        drop_materialized(batch)

    return asked.writeStream.foreachBatch(claim).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limit_stream(sent: DataFrame, ledger: Snapshots, checkpoint: str, key: str, moment: str, tie: str, most: int, seconds: int = 3600) -> StreamingQuery:
    """A ledger of all rows sent, with `accepted` as greedy_limit() decides over all batches.

    Batches come in the order of their moments; of earlier ones only accepted rows of the last span matter. tie
    names a row: one that is in the ledger already was decided, so a batch that is delivered again adds nothing."""

    def decide(batch: DataFrame, _: int) -> None:
        batch = materialize(batch.dropDuplicates([tie]), "batch")
        held = ledger.read(ledger.touched(batch))
        if held is None:
            held = batch.limit(0).withColumn("accepted", F.lit(True))
        new = batch.join(held.select(tie), tie, "left_anti").select(*batch.columns)
        since = batch.agg(F.min(moment).alias("low")).withColumn("low", F.col("low") - F.make_dt_interval(secs=F.lit(seconds)))
        stored = held.where("accepted").join(F.broadcast(since)).where(F.col(moment) > F.col("low")).select(key, moment)  # one row is broadcast
        ledger.append(greedy_limit(new, key, moment, tie, most, seconds, stored))
        drop_materialized(batch)

    return sent.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cap_stream(asked: DataFrame, state: Snapshots, checkpoint: str, owner: str, item: str, moment: str, most: int) -> StreamingQuery:
    """A table of what owners have, at most `most` items each: capped() batch by batch; replays change nothing.

    state is bucketed by owner: a batch reads its owners' buckets and appends what is new."""

    def put(batch: DataFrame, _: int) -> None:
        batch = materialize(batch, "batch")
        held = state.read(state.touched(batch))
        state.append(capped(batch.limit(0) if held is None else held, batch, owner, item, moment, most))
        drop_materialized(batch)

    return asked.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, mode: str, spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(path)
    stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


class SessionKeeper(StatefulProcessor):
    """The open session of each key: when it began, was last on record and last touched, and its touches.

    A session is emitted when a touch ends it, or when the watermark passes the moment from which none can
    belong to it any more. Touches of a batch are taken in the order of time."""

    def __init__(self, idle: int, absolute: int, touch: int) -> None:
        self.idle, self.absolute, self.touch = idle * 1_000_000, absolute * 1_000_000, touch * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "began long, seen long, last long, touches long")

    def _end(self, began: int, seen: int) -> int:
        """The first moment at which the session is over."""
        return min(began + self.absolute, seen + self.idle)

    def _row(self, key, state, why: str) -> dict:
        return {"key": key[0], "began": state[0], "last": state[2], "touches": state[3], "ended_by": why}

    def _why(self, state, at: int) -> str:
        return "age" if at >= state[0] + self.absolute else "idle"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = tuple(self.open.get()) if self.open.exists() else None, []
        for at in sorted(int(t) for part in rows for t in part["at"]):
            if state is not None and at >= self._end(state[0], state[1]):
                out.append(self._row(key, state, self._why(state, at)))
                state = None
            state = (at, at, at, 1) if state is None else (state[0], at if state[1] + self.touch < at else state[1], max(at, state[2]), state[3] + 1)
        if state is not None:
            self.open.update(state)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self._end(state[0], state[1]) // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "began", "last", "touches", "ended_by"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = tuple(self.open.get()) if self.open.exists() else None, []
        if state is not None:
            out.append(self._row(key, state, self._why(state, self._end(state[0], state[1]))))
            self.open.clear()
        yield pd.DataFrame(out, columns=["key", "began", "last", "touches", "ended_by"])

    def close(self) -> None:
        pass


def limited_sessions(touches: DataFrame, key: str, moment: str, idle: int = 30 * 86400, absolute: int = 180 * 86400, touch: int = 3600, late: str = "1 hour") -> DataFrame:
    """Sessions with an age limit, as operators.feedback.limited_sessions() has them, when they are over (append mode).

    Needs the RocksDB state store. Touches that come later than `late` no longer count; within that, a batch's
    touches are put in order, those of different batches stand as they came."""
    rows = touches.where(F.col(key).isNotNull() & F.col(moment).isNotNull()).withWatermark(moment, late).select(F.col(key).cast("string").alias("key"), F.col(moment).alias("moment"), F.unix_micros(moment).alias("at"))
    made = rows.groupBy("key").transformWithStateInPandas(SessionKeeper(idle, absolute, touch), "key string, began long, last long, touches long, ended_by string", "Append", "EventTime")
    return made.select("key", F.timestamp_micros("began").alias("started_at"), F.timestamp_micros("last").alias("last_at"), "touches", "ended_by")
