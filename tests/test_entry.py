"""The driver's contract."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from fairground.plans.registered import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_loads_without_a_session_or_the_training_data_operators(tmp_path):
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py"):
            os.symlink(os.path.join(ROOT, name), tmp_path / name)
    os.remove(tmp_path / "fairground")
    os.mkdir(tmp_path / "fairground")
    for name in os.listdir(os.path.join(ROOT, "fairground")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "fairground", name), tmp_path / "fairground" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["filter_places", "facet_counts", "event_page", "digest_sections", "reconcile_plan", "canonical_events", "adapter_govstack", "adapter_drupal", "adapter_eventon", "adapter_spaces", "adapter_tixhub", "event_pages", "stream_claims", "image_sizes"])
def test_queries_give_rows(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_halves_share_nothing(spark):
    import fairground.plans.queries_serving as s

    halves = [{r["id"] for r in s._select(spark, SF, f"{h}=2000-03-15&cost=all").collect()} for h in ("since", "before")]
    everything = {r["id"] for r in s._select(spark, SF, "cost=all").collect()}
    assert halves[0] & halves[1] == set() and halves[0] | halves[1] == everything and all(halves)


def test_a_long_queue_is_not_sorted_in_one_task(spark):
    from pyspark.sql import functions as F

    from fairground.operators.queues import next_in_queue

    rows = [(f"e{i:03}", f"2000-01-{1 + i % 3:02}" if i % 4 else None, i * 37 % 50, "done" if i % 5 == 0 else None) for i in range(200)]
    queue = sorted((r for r in rows if r[3] is None), key=lambda r: (r[1] or "", -r[2], r[0]))
    want = {r[0]: after[0] if after else None for r, after in zip(queue, [*queue[1:], None], strict=True)}
    table = spark.createDataFrame(rows, "id string, day string, start long, handled string").repartition(4)
    out = next_in_queue(table, "handled", "day", [F.desc("start"), F.col("id")]).withColumn("task", F.spark_partition_id()).collect()
    assert {r["id"]: r["next_id"] for r in out} == want and len(out) == len(want)
    plan = next_in_queue(table, "handled", "day", [F.desc("start"), F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "Window [lead(id#" in plan and "_nth" in plan.split("SinglePartition")[1]  # one row a day reaches the single task


def test_flagship_runs(spark):
    assert "verdict" in entry.entry(spark).columns
