"""Retrieval quality and keyword extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import STOP_WORDS, words


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row (precision, recall, map, ndcg), means over the queries with relevant documents, to 5 places.

    ranked(query_id, doc_id, place from 1); relevant(query_id, doc_id). Relevance is binary; a relevant
    document that was not found counts as zero, precision divides by k, average precision by the number
    of relevant documents, the ideal gain by min(k, that number). Repeated rows of relevant count once.
    """
    relevant = relevant.select("query_id", "doc_id").distinct()
    counts = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.filter((F.col("place") >= 1) & (F.col("place") <= k)).join(relevant, ["query_id", "doc_id"], "left_semi")
    upto = Window.partitionBy("query_id").orderBy("place")
    hits = hits.withColumn("seen", F.row_number().over(upto))
    per = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("h"), F.sum(F.col("seen") / F.col("place")).alias("ap"), F.sum(1 / F.log2(F.col("place") + 1)).alias("gain")
    )
    every = counts.join(per, "query_id", "left").fillna(0, ["h", "ap", "gain"])
    best = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return every.agg(
        F.round(F.avg(F.col("h") / k), 5).alias("precision"),
        F.round(F.avg(F.col("h") / F.col("n")), 5).alias("recall"),
        F.round(F.avg(F.col("ap") / F.col("n")), 5).alias("map"),
        F.round(F.avg(F.col("gain") / best), 5).alias("ndcg"),
    )


def keywords(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, least_bytes: int = 4) -> DataFrame:
    """(key, keywords): the n most frequent words of at least so many bytes that are no stop words, ties by first place, joined by spaces."""
    placed = documents.filter(F.col(text).isNotNull()).select(key, F.posexplode(words(F.col(text))).alias("at", "word"))
    kept = placed.filter((F.octet_length("word") >= least_bytes) & ~F.col("word").isin(*STOP_WORDS))
    counted = kept.groupBy(key, "word").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    best = Window.partitionBy(key).orderBy(F.desc("c"), "first")
    top = counted.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= n)
    listed = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("w"))
    return listed.select(key, F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("keywords"))
