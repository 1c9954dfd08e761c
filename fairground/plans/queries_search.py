"""Searches by the positional trigram index of all events' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import postings
from ..storage import materialize, table_path
from .catalog import ORACLE, query
from .queries_serving import with_places


#: Columns that the conditions of a search look at besides its text.
ASKED = ["active", "municipality_slug", "category", "cost", "source_slugs", "status", "local_date", "ends_at"]


def _indexed(spark: SparkSession, sf_dir: str, asked: str) -> DataFrame:
    """The filtered search as fl.select() does it, with the index in place of looking into every text."""
    wanted = fl.Filters.parse(asked)
    events = materialize(with_places(spark, sf_dir).select("id", *ASKED, fl.search_text().alias("text")), "events")
    folder = table_path(spark, "postings")
    postings.build(events.select("id", "text"), folder)
    found = postings.searched(events, F.col("text"), folder, fl.search_terms(wanted.search))
    for condition in wanted.conditions():
        found = found.where(condition)
    return found.select("id")


@query(ORACLE["search_words"])
def indexed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, "q=CAF%C3%89+maple&cost=all&civic=1")


@query(ORACLE["search_phrase"])
def indexed_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, "q=%22farmers+market%22+barrie&cost=all")
