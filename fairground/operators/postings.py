"""A positional trigram index of texts: searches read the postings of their own trigrams and nothing else."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of postings, and parts that one folder is written by, so that a common trigram is not one task.
BUCKETS, PARTS, GRAM = 64, 8, 3


def build(texts: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Write the index of texts (id, text) to folder: for each trigram and text where it stands, in folders by the
    trigram's checksum. Equal texts have postings once, under the least of their ids, and a list of their ids beside
    them. Ids are unique; texts of fewer than three characters and null ones have no postings."""
    held = texts.where(F.length("text") >= GRAM).select("id", "text")
    held.groupBy("text").agg(F.min("id").alias("first")).write.parquet(f"{folder}/texts")
    firsts = texts.sparkSession.read.parquet(f"{folder}/texts")
    held.join(firsts, "text").select("first", "id").write.parquet(f"{folder}/ids")
    places = F.transform(F.sequence(F.lit(1), F.length("text") - GRAM + 1), lambda i: F.struct(F.substring(F.col("text"), i, F.lit(GRAM)).alias("gram"), i.alias("at")))
    rows = firsts.select(F.col("first").alias("id"), F.explode(places).alias("x")).groupBy("id", F.col("x.gram").alias("gram")).agg(F.collect_list("x.at").alias("places"))
    rows = rows.withColumn("bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(PARTS))).write.partitionBy("bucket").parquet(f"{folder}/postings")


def pieces(term: str) -> list[tuple[str, int]]:
    """Trigrams of a term that together cover it, and where in it they stand."""
    at = sorted({*range(0, len(term) - GRAM + 1, GRAM), len(term) - GRAM})
    return [(term[k : k + GRAM], k) for k in at]


def search(spark: SparkSession, folder: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """id of the texts that contain each of terms, three characters or longer, exactly as contains() says.

    Only the folders of the terms' trigrams are read, and of their rows only these trigrams' (a filter that reaches
    the files). A term stands where all its trigrams do, each as far on as it is in the term; so places decide
    and no text is read. The trigrams of a search, a few dozen, are broadcast."""
    if not terms or min(map(len, terms)) < GRAM:
        raise ValueError("a search of the index has terms of three characters or more")
    wanted = [(n, gram, k) for n, term in enumerate(dict.fromkeys(terms)) for gram, k in pieces(term)]
    grams = sorted({gram for _, gram, _ in wanted})
    kept = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(sorted({zlib.crc32(g.encode()) % buckets for g in grams})) & F.col("gram").isin(grams))
    asked = spark.createDataFrame(wanted, "term int, gram string, k int")
    asked = asked.join(asked.groupBy("term").agg(F.count("*").alias("pieces")), "term")
    starts = kept.join(F.broadcast(asked), "gram").select("id", "term", "pieces", F.explode("places").alias("at"), "k").groupBy("id", "term", "pieces", (F.col("at") - F.col("k")).alias("start")).agg(F.count("*").alias("met"))
    found = starts.where("met = pieces").select("id", "term").distinct()
    firsts = found.groupBy("id").agg(F.count("*").alias("terms")).where(F.col("terms") == len(set(terms))).select(F.col("id").alias("first"))
    return spark.read.parquet(f"{folder}/ids").join(firsts, "first").select("id")


def searched(events: DataFrame, text: Column, folder: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The events whose text contains all terms: by the index, and by looking into what it leaves for terms that are too short for it."""
    long, short = [t for t in terms if len(t) >= GRAM], [t for t in terms if len(t) < GRAM]
    found = events.join(search(events.sparkSession, folder, long, buckets), "id", "left_semi") if long else events
    for term in short:
        found = found.where(F.contains(text, F.lit(term)))
    return found
