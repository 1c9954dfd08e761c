"""Decisions that depend on those before them: limits that count what was taken, caps, and sessions that begin where the last one ended."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import by_value
from ..storage import Scratch

by_value(__name__)


class Limit:
    """Decides rows that come sorted by key, piece and time: one is taken if fewer than `most` taken ones lie in the span up to it."""

    def __init__(self, most: int, span: int) -> None:
        self.most, self.span, self.piece = most, span, None

    def decide(self, batch: pa.RecordBatch) -> Iterator[tuple[bool, tuple | None]]:
        """For each row (k, piece, t, forced, tie, before) whether it is taken, and the piece that ended before it.

        before: moments taken before the piece. A forced row is taken whatever came before."""
        k, pieces, times, forced, _, before = (c.to_pylist() for c in batch.columns)
        for row, piece in enumerate(zip(k, pieces, strict=True)):
            ended = None
            if piece != self.piece:
                ended = self.ended()
                self.piece, self.before = piece, before[row]
                self.held, self.own = deque(before[row], self.most), deque([], self.most)
            t = times[row]
            taken = forced[row] or len(self.held) < self.most or self.held[0] <= t - self.span
            if taken:
                self.held.append(t)
                self.own.append(t)
            yield taken, ended

    def ended(self) -> tuple | None:
        return None if self.piece is None else (*self.piece, self.before, list(self.own))


def greedy_limit(rows: DataFrame, key: str, moment: str, tie: str, most: int, seconds: int = 3600, stored: DataFrame | None = None) -> DataFrame:
    """rows with `accepted`: fewer than `most` accepted rows of the key lie in the `seconds` up to it, in the order of (moment, tie).

    A row counts against later ones only if it was accepted, so each decision depends on those before. stored: key
    and moment of rows accepted earlier. A null key is a key of its own; a row without a moment is not accepted
    and does not count.

    The time of a key is cut into pieces as long as the limit's span, so a piece needs nothing of the past but the
    last accepted moments of the piece before. Every piece is decided as if nothing came before it; then those are
    decided again whose predecessor left other moments than they were given, until none is: what is handed on is
    then what the sequence gives. Busy keys thus spread over their pieces. Rounds: one more than the longest run
    of pieces through which a change moves on."""
    span = seconds * 1_000_000
    keep = Scratch(rows.sparkSession, "limit")
    named = lambda df, tie_: df.select(F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("k"), F.unix_micros(moment).alias("t"), tie_.cast("string").alias("tie"), F.lit(tie_ is nothing).alias("forced"))
    nothing = F.lit(None).cast("string")
    narrow = named(rows, F.col(tie))
    narrow = (narrow if stored is None else narrow.unionByName(named(stored, nothing))).where("t IS NOT NULL").withColumn("piece", F.floor(F.col("t") / span))
    narrow = keep.table(narrow, "narrow")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = Limit(most, span)
        lists = pa.list_(pa.int64())
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), lists, lists))], names=["k", "piece", "before", "left"])
        for batch in batches:
            yield made([ended for _, ended in limit.decide(batch) if ended])
        yield made([ended] if (ended := limit.ended()) else [])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = Limit(most, span)
        for batch in batches:
            taken = pa.array([taken for taken, _ in limit.decide(batch)], pa.bool_())
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4), taken], names=["k", "t", "tie", "accepted"])
            yield rows.filter(pc.invert(batch.column(3)))

    def sorted_with(given: DataFrame) -> DataFrame:
        rows = narrow.join(given.select("k", "piece", "before"), ["k", "piece"]).repartition("k", "piece")
        return rows.sortWithinPartitions("k", "piece", "t", F.col("forced").desc(), "tie").select("k", "piece", "t", "forced", "tie", "before")

    pieces = keep.table(narrow.select("k", "piece").distinct().withColumn("before", F.array().cast("array<bigint>")), "pieces")
    again, found = pieces, None
    while True:
        made = sorted_with(again).mapInArrow(leave, "k string, piece long, before array<bigint>, left array<bigint>")
        newer = made if found is None else found.join(again.select("k", "piece"), ["k", "piece"], "left_anti").unionByName(made)
        found = keep.table(newer, "left")
        given = found.select("k", (F.col("piece") + 1).alias("piece"), F.col("left").alias("given"))
        wanted = found.join(given, ["k", "piece"], "left").withColumn("given", F.coalesce("given", F.array().cast("array<bigint>")))
        again = keep.table(wanted.where(F.col("given") != F.col("before")).select("k", "piece", F.col("given").alias("before")), "again")
        keep.close(narrow, found, again)
        if not again.limit(1).count():
            break
    marks = keep.table(sorted_with(found).mapInArrow(mark, "k string, t long, tie string, accepted boolean"), "marks")
    keep.close(marks)
    # Rows equal in key, moment and tie are told apart by their number among themselves.
    nth = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_t", "_tie").orderBy(*by)))
    left = nth(rows.withColumns({"_k": F.coalesce(F.col(key).cast("string"), F.lit("\0")), "_t": F.unix_micros(moment), "_tie": F.coalesce(F.col(tie).cast("string"), F.lit(""))}), F.lit(0))
    right = nth(marks.select(F.col("k").alias("_k"), F.col("t").alias("_t"), F.coalesce("tie", F.lit("")).alias("_tie"), "accepted"), F.col("accepted").desc())
    return left.join(right, ["_k", "_t", "_tie", "_n"], "left").select(*rows.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def capped(stored: DataFrame, asked: DataFrame, owner: str, item: str, moment: str, most: int) -> DataFrame:
    """What of asked is stored now (its columns, the first request of each item): items that the owner does not have
    yet, in the order of their first request (ties by item), until the owner has `most`.

    stored has owner and item. An item asked for again, now or in an earlier batch, counts once, so replays
    change nothing; one refused is refused again as long as nothing was removed. Per owner only the first `most`
    new items of a task go into the ranking. Requests without an owner, item or moment are not stored."""
    whole = F.struct(*asked.columns)
    clean = asked.where(F.col(owner).isNotNull() & F.col(item).isNotNull() & F.col(moment).isNotNull())
    firsts = clean.groupBy(owner, item).agg(F.min(F.struct(F.col(moment).alias("_at"), whole.alias("_row"))).alias("_first"))
    fresh = firsts.join(stored.select(owner, item), [owner, item], "left_anti")
    nth = F.row_number().over(Window.partitionBy(owner).orderBy(F.col("_first._at"), F.col(item)))
    ranked = fresh.withColumn("_nth", nth).where(F.col("_nth") <= most)
    had = stored.groupBy(owner).agg(F.count_distinct(item).alias("_had"))
    return ranked.join(had, owner, "left").where(F.col("_nth") + F.coalesce("_had", F.lit(0)) <= most).select("_first._row.*")


def first_from(points: DataFrame, probes: DataFrame, strict: bool, width: int) -> DataFrame:
    """probes (k, at and more) with `found`: the first at of points (k, at) of that k from the probe's on (strict: after it).

    A key's time is cut into pieces of `width`: a probe looks in its own piece and else takes the first point of
    the next piece that has any, found among one row a piece. So a busy key is not one task."""
    piece = lambda c: F.floor(F.col(c) / width)
    sides = points.select("k", "at", F.lit(1).alias("kind"), F.lit(None).alias("more")).withColumn("piece", piece("at"))
    asked = probes.select("k", "at", F.lit(0).alias("kind"), F.struct(*probes.columns).alias("more")).withColumn("piece", piece("at"))
    both = sides.withColumn("more", F.lit(None).cast(asked.schema["more"].dataType)).unionByName(asked)
    near = F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(Window.partitionBy("k", "piece").orderBy(F.col("at").desc(), F.col("kind") if strict else F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("near", near).where("kind = 0")
    firsts = both.groupBy("k", "piece").agg(F.min(F.when(F.col("kind") == 1, F.col("at"))).alias("low"))
    later = F.last("low", ignorenulls=True).over(Window.partitionBy("k").orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1))
    return met.join(firsts.select("k", "piece", later.alias("far")), ["k", "piece"]).select("more.*", F.coalesce("near", "far").alias("found"))


def limited_sessions(touches: DataFrame, user: str, moment: str, idle: int = 30 * 86400, absolute: int = 180 * 86400, touch: int = 3600) -> DataFrame:
    """user, started_at, last_at, touches and ended_by (age, idle, or null for a last one) of each session, in seconds.

    A session ends at the first touch that comes `absolute` after its start, or `idle` after the last touch on
    record; that touch begins the next one. A touch goes on record if the last one on record is more than `touch`
    old, so where a session ends depends on where it began. Null users or moments have no session; touches at one
    moment count each.

    Pointers to the next touch that would be on record are followed to the first gap by doubling, and so are
    pointers from a session's start to the next one's: the rounds grow with the logarithm of a user's touches."""
    if idle <= touch:
        raise ValueError("idle must exceed touch")
    micro = 1_000_000
    keep = Scratch(touches.sparkSession, "sessions")
    width = min(absolute, 86400) * micro
    points = touches.where(F.col(user).isNotNull() & F.col(moment).isNotNull()).groupBy(F.col(user).alias("k"), F.unix_micros(moment).alias("at")).agg(F.count("*").alias("n"))
    points = keep.table(points, "points")
    probe = lambda shift: points.select("k", (F.col("at") + shift * micro).alias("at"), F.col("at").alias("from"))
    aged = first_from(points, probe(absolute), False, width).select("k", F.col("from").alias("at"), F.col("found").alias("aged"))
    recorded = first_from(points, probe(touch), True, width).select("k", F.col("from").alias("at"), F.col("found").alias("to"))
    gap = keep.table(recorded.withColumn("done", F.col("to").isNull() | (F.col("to") >= F.col("at") + idle * micro)), "gap")
    while gap.where("NOT done").limit(1).count():
        on = gap.select("k", F.col("at").alias("to"), F.col("to").alias("on_to"), F.col("done").alias("on_done"))
        gap_ = gap.join(on, ["k", "to"], "left").select("k", "at", F.when(F.col("done"), F.col("to")).otherwise(F.col("on_to")).alias("to"), (F.col("done") | F.col("on_done")).alias("done"))
        last, gap = gap, keep.table(gap_, "gap")
        keep.drop(last)
    nexts = keep.table(gap.join(aged, ["k", "at"]).select("k", "at", F.least("to", "aged").alias("to")).where("to IS NOT NULL"), "next")
    starts, jump = keep.table(points.groupBy("k").agg(F.min("at").alias("at")), "starts"), nexts
    while True:
        grown = keep.table(starts.join(jump, ["k", "at"]).select("k", F.col("to").alias("at")).unionByName(starts).distinct(), "starts")
        if grown.count() == starts.count():
            break
        jump_ = keep.table(jump.join(jump.select("k", F.col("at").alias("to"), F.col("to").alias("far")), ["k", "to"]).select("k", "at", F.col("far").alias("to")), "next")
        keep.drop(starts, *[jump] * (jump is not nexts))
        starts, jump = grown, jump_
    # The last start up to a touch, as the first from it on with time turned around.
    back = lambda df: df.withColumn("at", -F.col("at"))
    placed = first_from(back(starts), back(points), False, width).select("k", (-F.col("at")).alias("at"), "n", (-F.col("found")).alias("start"))
    made = placed.groupBy("k", "start").agg(F.max("at").alias("last"), F.sum("n").alias("touches"))
    ended = made.join(nexts.select("k", F.col("at").alias("start"), F.col("to").alias("next")), ["k", "start"], "left")
    why = F.when(F.col("next") >= F.col("start") + absolute * micro, "age").when(F.col("next").isNotNull(), "idle")
    done = keep.table(ended.select(F.col("k").alias(user), F.timestamp_micros("start").alias("started_at"), F.timestamp_micros("last").alias("last_at"), "touches", why.alias("ended_by")), "sessions")
    keep.close(done)
    return done
