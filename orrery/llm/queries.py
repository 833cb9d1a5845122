"""The queries of the training-data problems, by name, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.topn import top_hits

    return top_hits(table(spark, sf_dir, "search_hits"), table(spark, sf_dir, "searches")).select("search_id", "rowid")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.neighbours import similar_pairs

    return similar_pairs(table(spark, sf_dir, "records"), table(spark, sf_dir, "collections"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.split import cut_kinds

    return cut_kinds(table(spark, sf_dir, "records"), table(spark, sf_dir, "collections"))


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized document put together again of its pieces without their overlaps, and whether all pieces keep the limit."""
    from pyspark.sql import Window

    from orrery.llm.split import split_documents

    pieces = split_documents(table(spark, sf_dir, "records"), table(spark, sf_dir, "collections"))
    before = F.lag("stop", 1, 0).over(Window.partitionBy("rowid").orderBy("start"))
    pieces = pieces.withColumn("own", F.expr("substring(encode(piece, 'utf-8'), 1)")).withColumn("skip", (before - F.col("start")).cast("int"))
    pieces = pieces.withColumn("own", F.expr("substring(own, skip + 1)"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "own"))), lambda p: p["own"])
    whole = pieces.groupBy("rowid").agg(F.md5(F.aggregate(parts, F.lit(b""), lambda x, y: F.concat(x, y))).alias("document"), F.max(F.octet_length("piece")).alias("longest"))
    limits = table(spark, sf_dir, "records").join(table(spark, sf_dir, "collections"), "collection_id").select("rowid", "chunk_limit")
    return whole.join(limits, "rowid").select("rowid", "document", (F.col("longest") <= F.col("chunk_limit")).alias("within"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized document."""
    from orrery.llm.split import split_documents

    return split_documents(table(spark, sf_dir, "records"), table(spark, sf_dir, "collections"))


def scoped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "records").select(F.lit("document").alias("field"), F.col("collection_id").alias("scope"), F.col("document").alias("text"))
    overviews = table(spark, sf_dir, "movies").select(F.lit("overview").alias("field"), F.col("import_id").alias("scope"), F.col("overview").alias("text"))
    return documents.unionByName(overviews)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.terms import term_counts

    return term_counts(scoped_texts(spark, sf_dir), least_texts=20).filter("mark is not null").select("field", "scope", "term", "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every scope with its numbers, marked or not."""
    from orrery.llm.terms import term_counts

    return term_counts(scoped_texts(spark, sf_dir))


def keyed_texts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "document": table(spark, sf_dir, "records").select(F.col("rowid").alias("key"), F.col("document").alias("text")),
        "overview": table(spark, sf_dir, "movies").select(F.col("movie_key").alias("key"), F.col("overview").alias("text")),
    }


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.near import near_pairs

    parts = [near_pairs(texts, 0.5, 3, 10).select(F.lit(field).alias("field"), "key_a", "key_b") for field, texts in keyed_texts(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a text: its group of near-duplicates by runs of five terms and a similarity of 0.8."""
    from orrery.llm.near import near_groups

    parts = [near_groups(texts).select(F.lit(field).alias("field"), "key", "group", "copies", "links") for field, texts in keyed_texts(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of p5_found: every text that shares its set of runs of three terms, with the least key of its class and its size.

    Classes of more than EXPAND texts come out of p5_found as pairs with that key.
    """
    from orrery.llm.near import Near

    parts = [Near(texts, 0.5, 3, 10).members.select(F.lit(field).alias("field"), "key", "rep", "copies") for field, texts in keyed_texts(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of twelve terms of a held-out item, up to two edits."""
    from orrery.llm.leaks import held_out, leaks

    return leaks(table(spark, sf_dir, "documents"), held_out(table(spark, sf_dir, "eval_items")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).filter(F.col("run") >= 12).select("doc_id", "item_id")


def vocabulary(spark: SparkSession) -> str:
    """Rank file of a public byte-pair vocabulary, on every worker; named by the session's spark.orrery.vocabulary."""
    return spark.conf.get("spark.orrery.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.mixture import short_sources

    return short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their copies, sized in tokens."""
    from orrery.llm.mixture import Mixture

    return Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), vocabulary(spark)).copies()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the sources of the mixture really reach, in tokens."""
    from orrery.llm.mixture import Mixture

    return Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), vocabulary(spark)).report()


def p7_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture sized in terms: what each source has, whether it is short, and whether its goal and its cap are kept."""
    from orrery.llm.mixture import Mixture

    rows = Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report()
    met = F.abs(F.col("reached") - F.col("goal")) <= F.greatest("longest", F.lit(1))
    return rows.select("source", "available", F.round("goal", 3).alias("goal"), "short", met.alias("met"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.truncation import truncations

    return truncations(table(spark, sf_dir, "documents")).filter("truncated").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    from orrery.llm.truncation import truncation_by_source

    return truncation_by_source(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rejoined": p3_rejoined, "p4_found": p4_found, "p4_counts": p4_counts, "p5_found": p5_found, "p5_groups": p5_groups, "p5_classes": p5_classes, "p6_leaks": p6_leaks, "p6_found": p6_found, "p7_found": p7_found, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_terms": p7_terms, "p8_found": p8_found, "p8_sources": p8_sources}

SQL: dict[str, str] = {}

SQL["p1_found"] = """
WITH newest AS (
  SELECT h.*, row_number() OVER (PARTITION BY search_id, rowid ORDER BY scored_at DESC NULLS LAST, score DESC NULLS LAST) AS v
  FROM search_hits h WHERE search_id IS NOT NULL AND rowid IS NOT NULL),
cand AS (
  SELECT n.search_id, n.rowid, s.agg_k,
    CASE WHEN s.agg_op = '$max_k' THEN -n.score ELSE n.score END AS o,
    CASE WHEN list_contains(s.group_keys, 'category') THEN n.category END AS g1,
    CASE WHEN list_contains(s.group_keys, 'lang') THEN n.lang END AS g2,
    CASE WHEN list_contains(s.group_keys, 'year') THEN n.year END AS g3
  FROM newest n JOIN searches s ON n.search_id = s.search_id
  WHERE n.v = 1 AND len(s.group_keys) > 0 AND s.agg_k > 0 AND n.score IS NOT NULL AND NOT isnan(n.score)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY search_id, g1, g2, g3 ORDER BY o, rowid) AS r FROM cand)
SELECT search_id, rowid FROM ranked WHERE r <= agg_k
"""

SQL["p2_found"] = """
WITH u AS (
  SELECT r.rowid, r.collection_id, c.space, list_transform(r.embedding, lambda x: x::DOUBLE) AS e
  FROM records r JOIN collections c ON r.collection_id = c.collection_id
  WHERE r.embedding IS NOT NULL AND len(r.embedding) = c.dimension
    AND len(list_filter(r.embedding, lambda x: isfinite(x))) = c.dimension
    AND len(list_filter(r.embedding, lambda x: x <> 0)) > 0),
v AS (SELECT *, list_sum(list_transform(e, lambda x: x * x)) AS sq FROM u),
d AS (
  SELECT a.rowid AS a, b.rowid AS b,
    CASE a.space WHEN 'l2' THEN list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))
      WHEN 'ip' THEN 1 - list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))
      ELSE 1 - list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (sqrt(a.sq) * sqrt(b.sq)) END AS dist
  FROM v a JOIN v b ON a.collection_id = b.collection_id AND a.rowid <> b.rowid),
k AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS r FROM d)
SELECT DISTINCT least(a, b) AS rowid_a, greatest(a, b) AS rowid_b FROM k WHERE r <= 5
"""

SQL["p3_found"] = r"""
WITH big AS (
  SELECT r.rowid, c.chunk_limit, regexp_split_to_array(r.document, '[ \t\n\r。]') AS parts
  FROM records r JOIN collections c ON r.collection_id = c.collection_id
  WHERE r.document IS NOT NULL AND c.chunk_limit IS NOT NULL AND strlen(r.document) > c.chunk_limit)
SELECT rowid, CASE WHEN list_max(list_transform(parts, lambda p: strlen(p))) > chunk_limit THEN 'forced' ELSE 'natural' END AS cut FROM big
"""

_TERMS = r"""
WITH texts AS (
  SELECT 'document' AS field, collection_id AS scope, document AS text, row_number() OVER () AS n FROM records
  UNION ALL SELECT 'overview', import_id, overview, -row_number() OVER () FROM movies),
good AS (SELECT * FROM texts WHERE text IS NOT NULL AND scope IS NOT NULL),
sizes AS (SELECT field, scope, count(*) AS texts FROM good GROUP BY ALL),
words AS (SELECT field, scope, n, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM good),
counts AS (SELECT field, scope, term, count(*) AS occurrences, count(DISTINCT n) AS records FROM words GROUP BY ALL),
marked AS (
  SELECT c.*, s.texts, CASE WHEN records <= 1 THEN 'rare' WHEN records > 0.5 * texts THEN 'common' END AS mark
  FROM counts c JOIN sizes s ON c.field = s.field AND c.scope = s.scope)
"""

SQL["p4_found"] = _TERMS + "SELECT field, scope, term, mark FROM marked WHERE texts >= 20 AND mark IS NOT NULL"
SQL["p4_counts"] = _TERMS + "SELECT * FROM marked"

SQL["p5_found"] = r"""
WITH texts AS (
  SELECT 'document' AS field, rowid AS key, document AS text FROM records
  UNION ALL SELECT 'overview', movie_key, overview FROM movies),
words AS (SELECT field, key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM texts WHERE text IS NOT NULL),
runs AS (
  SELECT DISTINCT field, key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT field, key, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 10)),
sizes AS (SELECT field, key, count(*) AS n FROM runs GROUP BY ALL),
common AS (
  SELECT a.field, a.key AS key_a, b.key AS key_b, count(*) AS c
  FROM runs a JOIN runs b ON a.field = b.field AND a.s = b.s AND a.key < b.key GROUP BY ALL)
SELECT c.field, c.key_a, c.key_b FROM common c
JOIN sizes x ON x.field = c.field AND x.key = c.key_a JOIN sizes y ON y.field = c.field AND y.key = c.key_b
WHERE c.c >= 0.5 * (x.n + y.n - c.c)
"""

SQL["p6_found"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dr AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
f AS (
  SELECT item_id, question AS t FROM eval_items WHERE split IN ('test', 'validation')
  UNION ALL SELECT item_id, support FROM eval_items WHERE split IN ('test', 'validation')),
e AS (SELECT item_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM f WHERE t IS NOT NULL),
er AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dr JOIN er ON dr.s = er.s
"""

SQL["p7_found"] = r"""
WITH d AS (
  SELECT lower(trim(source, E' \t\n\r')) AS source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) END AS n FROM documents),
s AS (SELECT source, sum(n) AS n FROM d GROUP BY source)
SELECT m.source FROM mix_targets m LEFT JOIN s ON s.source = m.source
WHERE m.max_repeats * coalesce(s.n, 0) < m.weight * (SELECT sum(n) FROM d)
"""

SQL["p7_terms"] = r"""
WITH d AS (
  SELECT lower(trim(source, E' \t\n\r')) AS source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) END AS n FROM documents),
s AS (SELECT source, sum(n) AS n FROM d GROUP BY source),
g AS (
  SELECT m.source, coalesce(s.n, 0)::BIGINT AS available, m.weight * (SELECT sum(n) FROM d)::DOUBLE AS wanted, (m.max_repeats * coalesce(s.n, 0))::DOUBLE AS most
  FROM mix_targets m LEFT JOIN s ON s.source = m.source)
SELECT source, available, round(least(wanted, most), 3) AS goal, most < wanted AS short, true AS met, true AS capped FROM g
"""

SQL["p5_groups"] = r"""
WITH RECURSIVE texts AS (
  SELECT 'document' AS field, rowid AS key, document AS text FROM records
  UNION ALL SELECT 'overview', movie_key, overview FROM movies),
words AS (SELECT field, key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM texts WHERE text IS NOT NULL),
runs AS (SELECT DISTINCT field, key, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT field, key, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
sets AS (SELECT field, key, count(*) AS n, string_agg(s, '|' ORDER BY s) AS whole FROM runs GROUP BY ALL),
classes AS (SELECT field, key, n, min(key) OVER (PARTITION BY field, md5(whole)) AS rep, count(*) OVER (PARTITION BY field, md5(whole)) AS copies FROM sets),
heads AS (SELECT r.field, r.key, r.s, c.n FROM runs r JOIN classes c ON c.field = r.field AND c.key = r.key AND c.rep = c.key),
common AS (SELECT a.field, a.key AS a, b.key AS b, a.n AS na, b.n AS nb, count(*) AS c FROM heads a JOIN heads b ON a.field = b.field AND a.s = b.s AND a.key < b.key GROUP BY ALL),
links AS (SELECT field, a, b FROM common WHERE c >= 0.8 * (na + nb - c)),
edges AS (SELECT field, a, b FROM links UNION ALL SELECT field, b, a FROM links),
walk(field, node, seen) AS (SELECT DISTINCT field, a, a FROM edges UNION SELECT w.field, w.node, e.b FROM walk w JOIN edges e ON e.field = w.field AND e.a = w.seen),
named AS (SELECT field, node, min(seen) AS grp FROM walk GROUP BY ALL),
degree AS (SELECT field, a AS node, count(*) AS links FROM edges GROUP BY ALL)
SELECT t.field, t.key, coalesce(n.grp, c.rep, t.key) AS "group", coalesce(c.copies, 1)::BIGINT AS copies, coalesce(d.links, 0)::BIGINT AS links
FROM texts t LEFT JOIN classes c ON c.field = t.field AND c.key = t.key
LEFT JOIN named n ON n.field = t.field AND n.node = coalesce(c.rep, t.key) LEFT JOIN degree d ON d.field = t.field AND d.node = coalesce(c.rep, t.key)
"""

SQL["p5_classes"] = r"""
WITH texts AS (
  SELECT 'document' AS field, rowid AS key, document AS text FROM records
  UNION ALL SELECT 'overview', movie_key, overview FROM movies),
words AS (SELECT field, key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM texts WHERE text IS NOT NULL),
runs AS (SELECT DISTINCT field, key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT field, key, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 10)),
sets AS (SELECT field, key, md5(string_agg(s, '|' ORDER BY s)) AS whole FROM runs GROUP BY ALL),
classes AS (SELECT field, key, min(key) OVER (PARTITION BY field, whole) AS rep, count(*) OVER (PARTITION BY field, whole) AS copies FROM sets)
SELECT field, key, rep, copies FROM classes WHERE copies > 1
"""

SQL["p3_rejoined"] = r"""
SELECT r.rowid, md5(r.document) AS document, true AS within FROM records r JOIN collections c ON r.collection_id = c.collection_id
WHERE r.document IS NOT NULL AND c.chunk_limit IS NOT NULL AND strlen(r.document) > c.chunk_limit
"""
