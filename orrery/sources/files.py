"""Sources: movie tables, JSON lines, id-to-text objects, text lines; sinks in request order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOVIE = "title string, year int, original_language string, genres array<string>, budget bigint, overview string"
MOVIE_CSV = "adult string, budget string, genres string, id string, original_language string, overview string, release_date string, title string"


def movies_csv(spark: SparkSession, path: str) -> DataFrame:
    """Movies of a CSV file with a header, quoted fields over several lines; rows without title or overview are dropped.

    Rows may be ragged: fields that a short row lacks are null, what a long row has too many of is left out. An empty field is null.

    year is the first four characters of release_date, where they are a number; a budget that is none is null.
    """
    header = spark.read.text(path).first()
    names = [c.strip().strip('"') for c in header[0].split(",")] if header else []
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    for wanted in ("title", "overview", "release_date", "budget", "id", "original_language", "adult"):
        if wanted not in rows.columns:
            rows = rows.withColumn(wanted, F.lit(None).cast("string"))
    rows = rows.filter((F.trim("title") != "") & (F.trim("overview") != ""))
    year = F.substring("release_date", 1, 4).try_cast("int")
    return rows.select("id", "title", year.alias("year"), "original_language", F.col("budget").try_cast("bigint").alias("budget"), "adult", "release_date", "overview")


def movies_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MOVIE).json(path)


def corpus_object(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a file with one JSON object {id: text}, ordered by id."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "text")).orderBy("id")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text, filename, line_number): trimmed lines that are not empty, numbered from 1 with the empty ones counted."""
    whole = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"))
    lines = whole.select("filename", F.posexplode(F.split("value", "\n")).alias("at", "line"))
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    return lines.select(text.alias("text"), F.url_decode(F.replace(F.col("filename"), F.lit("+"), F.lit("%2B"))).alias("filename"), (F.col("at") + 1).alias("line_number")).filter("text != ''")


def nested_response(results: DataFrame, query: str = "qid", place: str = "place", columns: tuple = ("rowid", "distance")) -> DataFrame:
    """One row a query with parallel arrays in rank order, as a client of several queries at once expects them.

    Grouped by query; a query's rows are at most its n results.
    """
    listed = results.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(place, *columns))).alias("__r"))
    return listed.select(query, *(F.col(f"__r.{c}").alias(c) for c in columns))


def flat_response(results: DataFrame, columns: tuple) -> DataFrame:
    """One JSON text a record, with null for what was not asked for."""
    return results.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def include(df: DataFrame, wanted: tuple) -> DataFrame:
    """Columns that are not included become null; Spark then reads none of them."""
    from orrery.errors import Unprocessable

    names = {"embeddings": "embedding", "documents": "document", "metadatas": "metadata", "uris": "uri", "distances": "distance"}
    unknown = set(wanted) - set(names)
    if unknown:
        raise Unprocessable(f"unknown variant `{sorted(unknown)[0]}`, expected one of {', '.join(names)}")
    off = {names[n] for n in names if n not in wanted} & set(df.columns)
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in off})


def by_position(df: DataFrame, order: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page in the given order."""
    page = df.orderBy(order)
    page = page.offset(offset) if offset else page
    return page if limit is None else page.limit(limit)


def ranked_places(df: DataFrame, partition: str, *order) -> DataFrame:
    """df with `place` from 1 in each partition."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
