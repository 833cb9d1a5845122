"""Keyword search over sparse vectors: postings, inverse document frequency, scores."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import STOP_WORDS, bm25_weight, words


def postings(records: DataFrame, vector: str = "sparse") -> DataFrame:
    """(rowid, dim, value) of STRUCT<indices, values, ...> or of parallel arrays; derived, never stored apart."""
    pairs = F.arrays_zip(F.col(f"{vector}.indices").alias("dim"), F.col(f"{vector}.values").alias("value"))
    return records.filter(F.col(vector).isNotNull()).select("rowid", F.inline(pairs).alias("dim", "value"))


def _kept(text: str, stop_words: Sequence[str]) -> Column:
    every = words(F.col(text))
    return F.filter(every, lambda w: ~w.isin(*stop_words)) if stop_words else every


def text_postings(records: DataFrame, text: str = "document", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(rowid, dim STRING, value DOUBLE): keyword weights with the term itself as the dimension, of every term.

    A text's length travels with its terms, so they are shuffled once, combined before. Searches for
    stated terms need no postings: see TextIndex.
    """
    kept = records.filter(F.col(text).isNotNull()).select("rowid", _kept(text, stop_words).alias("w"))
    terms = kept.select("rowid", F.size("w").cast("double").alias("n"), F.explode("w").alias("dim"))
    counted = terms.groupBy("rowid", "n", "dim").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    return counted.select("rowid", "dim", bm25_weight(F.col("tf"), F.col("n")).alias("value"))


@dataclass(frozen=True)
class TextIndex:
    """Keyword search over a text column for stated terms: each text is counted and scored where it lies, nothing is shuffled."""

    text: str = "document"
    stop_words: tuple = STOP_WORDS

    def counted(self, records: DataFrame, terms: Sequence[str]) -> DataFrame:
        """(rowid, n, tf ARRAY): a text's length and its count of each term, of the texts that have one."""
        kept = records.filter(F.col(self.text).isNotNull()).select("rowid", _kept(self.text, self.stop_words).alias("w"))
        same = lambda term: lambda x: x == F.lit(term)
        tf = F.array(*(F.size(F.filter("w", same(t))) for t in terms))
        return kept.filter(F.arrays_overlap("w", F.array(*map(F.lit, terms)))).select("rowid", F.size("w").cast("double").alias("n"), tf.alias("tf"))

    def scores(self, records: DataFrame, query: Sequence[tuple], keep: DataFrame | None = None, total: int | None = None) -> DataFrame:
        """As sparse_scores() over text_postings(records). keep: the records that the filter keeps."""
        query = [(t, float(w)) for t, w in query]
        if not query:
            return records.limit(0).select("rowid", F.lit(1.0).alias("raw"))
        terms = [t for t, _ in query]
        weights = [w for _, w in query]
        if total is not None:
            found = self.counted(records, terms).agg(*(F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"d{i}") for i in range(len(terms)))).first()
            frequency = [min(d or 0, total) for d in found]
            weights = [w * math.log1p((total - d + 0.5) / (d + 0.5)) for w, d in zip(weights, frequency, strict=True)]
        rows = self.counted(records if keep is None else keep, terms)
        part = lambda i, w: F.when(F.col("tf")[i] > 0, bm25_weight(F.col("tf")[i].cast("double"), F.col("n")) * F.lit(w)).otherwise(F.lit(0.0))
        return rows.select("rowid", (F.lit(1.0) - sum((part(i, w) for i, w in enumerate(weights)), F.lit(0.0))).alias("raw"))


def document_frequency(rows: DataFrame) -> DataFrame:
    """(dim, df) of postings."""
    return rows.groupBy("dim").agg(F.count(F.lit(1)).alias("df"))


def query_frame(rows: DataFrame, query: Sequence[tuple]) -> DataFrame:
    kind = rows.schema["dim"].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(d, float(w)) for d, w in query], f"dim {kind}, weight double")


def idf(rows: DataFrame, terms: DataFrame, total: int) -> DataFrame:
    """(dim, weight) of the query terms, times ln(1 + (N - n + 0.5) / (n + 0.5)); N is all records, whatever a filter keeps."""
    n = document_frequency(rows.join(F.broadcast(terms.select("dim")), "dim"))
    scaled = terms.join(F.broadcast(n), "dim", "left")
    df = F.least(F.coalesce("df", F.lit(0)), F.lit(total))
    return scaled.select("dim", (F.col("weight") * F.log1p((F.lit(total) - df + 0.5) / (df + 0.5))).alias("weight"))


def sparse_scores(rows: DataFrame, query: Sequence[tuple], keep: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """(rowid, raw DOUBLE): 1 - sum of products over shared dimensions; records that share none do not appear.

    query: ((dim, weight), ...), a stated list that is broadcast. keep: rowids that the filter keeps.
    total: the collection's record count, for scaling by inverse document frequency.
    """
    terms = query_frame(rows, query)
    terms = terms if total is None else idf(rows, terms, total)
    met = rows.join(F.broadcast(terms), "dim")
    if keep is not None:
        met = met.join(keep.select("rowid"), "rowid", "left_semi")
    return met.groupBy("rowid").agg((F.lit(1.0) - F.sum(F.col("value") * F.col("weight"))).alias("raw"))
