"""Asking a judge about pairs that rules leave open: exact batches, each a call that may fail, under a budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import by_value
from ..storage import materialize
from .ranks import global_ranks

BATCH = 10
by_value(__name__)


def judge_batches(pairs: DataFrame, ask: Callable[[list[dict]], list[str | None]], size: int = BATCH, budget: int | None = None) -> DataFrame:
    """a, b, batch, verdict and outcome (answered, no answer, failed, over budget) of each of pairs (a, b and more).

    Pairs are numbered globally in the order of (a, b) and every `size` of them make a batch, the last what is
    left; no task sees more than its ranges and batches. ask gets a batch as dicts (with `batch`) and gives as
    many verdicts, None where it has none. If it raises, or gives another number, only its own batch fails. No
    more than `budget` batches are asked. Nothing but answers is a verdict, so the caller remembers those alone
    and the others are asked again in the next run. The result is stored: a call is not made twice by reading it,
    though a lost task asks its batches again."""
    names = pairs.columns
    numbered = global_ranks(pairs, ["a", "b"], "_rank").withColumn("batch", F.floor(F.col("_rank") / size))
    within = numbered if budget is None else numbered.where(F.col("batch") < budget)
    batches = within.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_rank", *names))).alias("pairs"))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            rows = []
            for number, asked in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
                try:
                    verdicts = ask([{k: v for k, v in p.items() if k != "_rank"} | {"batch": number} for p in asked])
                    if len(verdicts) != len(asked):
                        raise ValueError("one verdict a pair is expected")
                    rows += [(p["_rank"], v, "no answer" if v is None else "answered") for p, v in zip(asked, verdicts, strict=True)]
                except Exception:  # a call may fail in any way; its pairs stay open
                    rows += [(p["_rank"], None, "failed") for p in asked]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["_rank", "verdict", "outcome"])

    answers = batches.mapInArrow(run, "_rank long, verdict string, outcome string")
    found = numbered.select("a", "b", "batch", "_rank").join(answers, "_rank", "left")
    return materialize(found.select("a", "b", "batch", "verdict", F.coalesce("outcome", F.lit("over budget")).alias("outcome")), "judged")


def batched(ask: Callable[[list[dict]], list[str | None]], name: str, size: int = BATCH, budget: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A judge for pairs.judge_ambiguous(): its answers, each with the judge's name as method."""

    def judge(pairs: DataFrame) -> DataFrame:
        answers = judge_batches(pairs, ask, size, budget)
        return answers.where("verdict IS NOT NULL").select("a", "b", "verdict", F.lit(name).alias("method"))

    return judge
