"""Queries over the test tables, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.text import STOP_WORDS, content_words, hashing_embedder, sparse_documents, words
from orrery.functions.values import typed_metadata
from orrery.functions.vectors import decode_base64, encode_base64
from orrery.operators import records as log
from orrery.operators.filters import ColumnBinding, where
from orrery.operators.knn import Ivf, knn, knn_batch, knn_join, knn_two_stage, restrict_ids
from orrery.operators.metrics import keywords, retrieval_metrics
from orrery.operators.rank import combine, dense, rrf, sparse, val
from orrery.operators.search import Collection
from orrery.operators.sparse import TextIndex, document_frequency, idf, query_frame, text_postings
from orrery.plans.catalog import Catalog, fork_counts, listing
from orrery.runtime import shared_folder, table
from orrery.sources.files import by_position, include, movies_csv, nested_response, text_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _digits(c, places: int):
    """Rounded in a way that both engines do alike, without a negative zero."""
    return F.floor(c.cast("double") * 10**places + 0.5) / float(10**places)


def _sql_digits(expression: str, places: int) -> str:
    return f"(floor(({expression})::FLOAT::DOUBLE * {10**places} + 0.5) / {10**places}.0)"


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# Filters over records; `recent` and `flag` are made of others so that booleans occur.

_MARKED = "SELECT *, CASE WHEN year IS NULL THEN NULL ELSE year >= 2010 END AS recent FROM records"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").withColumn("recent", F.col("year") >= 2010)


def _filter(name: str, clause: dict | None, predicate: str, document: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _records(spark, sf_dir)
        return where(rows, clause, document, ColumnBinding(rows)).select("rowid", "id")

    QUERIES[name] = run
    SQL[name] = f"SELECT rowid, id FROM ({_MARKED}) WHERE {predicate}"


_filter("where_eq_int", {"year": 2020}, "year = 2020")
_filter("where_eq_float_matches_int", {"year": 2020.0}, "year = 2020")
_filter("where_eq_float_no_int", {"year": 2020.5}, "false")
_filter("where_eq_string", {"lang": "en"}, "lang = 'en'")
_filter("where_eq_empty_string", {"category": ""}, "category = ''")
_filter("where_ne_missing", {"category": {"$ne": "biology"}}, "category IS NULL OR category <> 'biology'")
_filter("where_ne_unknown_key", {"nothing": {"$ne": 1}}, "true")
_filter("where_eq_unknown_key", {"nothing": 1}, "false")
_filter("where_gt", {"year": {"$gt": 2015}}, "year > 2015")
_filter("where_gte_float_bound", {"year": {"$gte": 2015.5}}, "year >= 2016")
_filter("where_lt", {"rating": {"$lt": 3}}, "rating < 3")
_filter("where_lte", {"rating": {"$lte": 2.5}}, "rating <= 2.5")
_filter("where_in", {"lang": {"$in": ["de", "fr"]}}, "lang IN ('de', 'fr')")
_filter("where_in_floats", {"year": {"$in": [2001.0, 2003]}}, "year IN (2001, 2003)")
_filter("where_nin_missing", {"lang": {"$nin": ["en", "de"]}}, "lang IS NULL OR lang NOT IN ('en', 'de')")
_filter("where_and", {"$and": [{"lang": "en"}, {"year": {"$gte": 2010}}]}, "lang = 'en' AND year >= 2010")
_filter("where_or", {"$or": [{"lang": "fr"}, {"rating": {"$gt": 4}}]}, "coalesce(lang = 'fr', false) OR coalesce(rating > 4, false)")
_filter(
    "where_nested", {"$and": [{"$or": [{"lang": "en"}, {"lang": "de"}]}, {"category": {"$nin": ["biology", ""]}}]},
    "lang IN ('en', 'de') AND (category IS NULL OR category NOT IN ('biology', ''))",
)
_filter("where_empty_and", {"$and": []}, "true")
_filter("where_empty_or", {"$or": []}, "false")
_filter("where_id_eq", {"#id": "doc-0000010"}, "id = 'doc-0000010'")
_filter("where_id_ne", {"#id": {"$ne": "doc-0000010"}}, "id <> 'doc-0000010'")
_filter("where_id_in", {"#id": {"$in": ["doc-0000010", "100000", "none"]}}, "id IN ('doc-0000010', '100000', 'none')")
_filter("where_id_nin", {"#id": {"$nin": ["doc-0000010"]}}, "id NOT IN ('doc-0000010')")
_filter("where_id_range_is_false", {"#id": {"$gt": 3}}, "false")
_filter("where_document_key_is_metadata", {"#document": {"$ne": "x"}}, "true")
_filter("where_type_mismatch", {"year": "2020"}, "false")
_filter("where_type_mismatch_ne", {"year": {"$ne": "2020"}}, "true")
_filter("where_bool", {"recent": True}, "recent")
_filter("where_bool_not_number", {"recent": 1}, "false")
_filter("where_bool_in", {"recent": {"$in": [False]}}, "NOT recent")
_filter("where_array_scalar_is_false", {"tags": "faq"}, "false")
_filter("array_contains", {"tags": {"$contains": "howto"}}, "list_contains(tags, 'howto')")
_filter("array_not_contains", {"tags": {"$not_contains": "howto"}}, "tags IS NULL OR NOT list_contains(tags, 'howto')")
_filter("scalar_contains_is_false", {"lang": {"$contains": "en"}}, "false")
_filter("doc_contains", None, "contains(document, 'shard')", {"$contains": "shard"})
_filter("doc_contains_special", None, "contains(document, '[')", {"$contains": "["})
_filter("doc_not_contains", None, "document IS NULL OR NOT contains(document, 'the')", {"$not_contains": "the"})
_filter("doc_regex", None, r"regexp_matches(document, '\b[A-Z][a-z]+ and [A-Z]\w+')", {"$regex": r"\b[A-Z][a-z]+ and [A-Z]\w+"})
_filter("doc_regex_fold", None, "regexp_matches(document, '(?i)WITHOUT THE [a-m]+,')", {"$regex": "(?i)WITHOUT THE [a-m]+,"})
_filter("doc_regex_multiline", None, r"regexp_matches(document, '(?m)^\W*In \d{1,3}\b')", {"$regex": r"(?m)^\W*In \d{1,3}\b"})
_filter("doc_regex_end", None, r"regexp_matches(document, 'rest\.$')", {"$regex": r"rest\.$"})
_filter("doc_not_regex", None, "document IS NULL OR NOT regexp_matches(document, 'a.e')", {"$not_regex": "a.e"})
_filter(
    "doc_and_or", {"lang": "en"}, "lang = 'en' AND contains(document, 'the') AND (contains(document, 'shard') OR NOT contains(document, 'index'))",
    {"$and": [{"$contains": "the"}, {"$or": [{"$contains": "shard"}, {"$not_contains": "index"}]}]},
)


@query("where_json_key", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def where_json_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return where(rows.withColumn("id", F.col("event_id").cast("string")).withColumn("document", F.lit(None).cast("string")), {"k": {"$gt": 50}}).select("event_id")


# Scans, counts, projections


@query("get_all_paged", "SELECT rowid, id, document FROM records ORDER BY rowid LIMIT 20 OFFSET 15")
def get_all_paged(spark, sf_dir):
    return by_position(table(spark, sf_dir, "records").select("rowid", "id", "document"), "rowid", 20, 15)


@query("get_by_ids", "SELECT rowid, id FROM records WHERE id IN ('100000', 'doc-0000010', 'missing')")
def get_by_ids(spark, sf_dir):
    return log.with_ids(table(spark, sf_dir, "records").select("rowid", "id"), ["100000", "doc-0000010", "missing"])


@query("get_by_many_ids", "SELECT rowid, id FROM records WHERE id IN (SELECT 'doc-' || lpad(CAST(i AS VARCHAR), 7, '0') FROM range(0, 5000) t(i))")
def get_by_many_ids(spark, sf_dir):
    return log.with_ids(table(spark, sf_dir, "records").select("rowid", "id"), [f"doc-{i:07d}" for i in range(5000)])


@query("get_filtered_page", "SELECT rowid FROM records WHERE lang = 'en' AND id LIKE 'doc%' ORDER BY rowid LIMIT 5 OFFSET 2")
def get_filtered_page(spark, sf_dir):
    rows = where(table(spark, sf_dir, "records"), {"lang": "en"}).filter(F.col("id").startswith("doc"))
    return by_position(rows.select("rowid"), "rowid", 5, 2)


@query("count_records", "SELECT count(*) AS n FROM records")
def count_records(spark, sf_dir):
    return log.counts(table(spark, sf_dir, "records"))


@query("count_by_collection", "SELECT collection_id, count(*) AS n FROM records GROUP BY collection_id")
def count_by_collection(spark, sf_dir):
    return log.counts(table(spark, sf_dir, "records"), "collection_id")


@query("fork_counts", "SELECT p.collection_id, count(f.collection_id) AS forks FROM collections p LEFT JOIN collections f ON f.forked_from = p.collection_id GROUP BY p.collection_id")
def _fork_counts(spark, sf_dir):
    return fork_counts(table(spark, sf_dir, "collections"))


@query("catalog_collections", "SELECT t.name AS tenant, c.database_name, c.name FROM tenants t JOIN collections c ON c.tenant = t.name")
def catalog_collections(spark, sf_dir):
    return listing(table(spark, sf_dir, "tenants"), table(spark, sf_dir, "collections"))


@query("get_include_subset", "SELECT rowid, id, NULL::VARCHAR AS document, uri FROM records")
def get_include_subset(spark, sf_dir):
    return include(table(spark, sf_dir, "records").select("rowid", "id", "document", "uri"), ("uris",))


# Dense search over embeddings: rowid = vec_id, filtered by label


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("rowid"), F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").cast("long").alias("label"), F.lit(None).cast("string").alias("document"))


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding


_E = "SELECT vec_id AS rowid, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"


def _sql_distance(space: str, a: str = "x.e", b: str = "q.e") -> str:
    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
    if space == "l2":
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    norm = f"sqrt(list_sum(list_transform({a}, lambda v: v * v))) * sqrt(list_sum(list_transform({b}, lambda v: v * v)))"
    return f"1 - {dot}" if space == "ip" else f"1 - {dot} / ({norm})"


def _sql_knn(space: str, n: int, q: int, predicate: str = "true") -> str:
    return f"""SELECT rowid, {_sql_digits('d', 3)} AS distance FROM (
      SELECT x.rowid, {_sql_distance(space)} AS d FROM ({_E}) x, ({_E} WHERE vec_id = {q}) q WHERE {predicate}) ORDER BY d, rowid LIMIT {n}"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("rowid", _digits(F.col("distance"), 3).alias("distance"))


for _space in ("l2", "ip", "cosine"):

    @query(f"knn_{_space}", _sql_knn(_space, 10, 0))
    def _knn(spark, sf_dir, space=_space):
        return _shown(knn(_vectors(spark, sf_dir), _vector(spark, sf_dir, 0), 10, space))


@query("knn_filtered", _sql_knn("l2", 10, 3, "x.label IN (1, 2)"))
def knn_filtered(spark, sf_dir):
    return _shown(knn(where(_vectors(spark, sf_dir), {"label": {"$in": [1, 2]}}), _vector(spark, sf_dir, 3), 10, "l2"))


@query("knn_ids_restricted", _sql_knn("cosine", 3, 1, "x.rowid IN (5, 6, 7, 8, 9, 10)"))
def knn_ids_restricted(spark, sf_dir):
    return _shown(knn(restrict_ids(_vectors(spark, sf_dir), ["5", "6", "7", "8", "9", "10"]), _vector(spark, sf_dir, 1), 3, "cosine"))


@query("knn_two_stage", _sql_knn("l2", 10, 5))
def _two_stage(spark, sf_dir):
    return _shown(knn_two_stage(_vectors(spark, sf_dir), _vector(spark, sf_dir, 5), 10, "l2"))


@query("knn_empty", "SELECT vec_id AS rowid, 0.0 AS distance FROM embeddings WHERE false")
def knn_empty(spark, sf_dir):
    return _shown(knn(_vectors(spark, sf_dir), _vector(spark, sf_dir, 0), 0, "l2"))


@query("ivf_one", _sql_knn("l2", 10, 2))
def ivf_one(spark, sf_dir):
    """One vector asked of the stored index."""
    return _shown(Ivf.build(_vectors(spark, sf_dir)).search(_vector(spark, sf_dir, 2), 10, "l2"))


def _dirty(space: str) -> None:
    """All records of the most usual length, null, zero and odd ones among the embeddings, by their distance to one."""
    width = "(SELECT len(embedding) AS w FROM records WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    e = "list_transform(embedding, lambda x: x::DOUBLE)"
    asked = f"(SELECT {e} AS e FROM records WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: isfinite(x) AND x <> 0)) = len(embedding) ORDER BY rowid LIMIT 1)"
    zero = "WHEN len(list_filter(x.e, lambda v: v <> 0)) = 0 THEN 'nan'::DOUBLE" if space == "cosine" else ""
    sql = f"SELECT x.rowid, CASE WHEN false THEN 0.0 {zero} ELSE {_sql_distance(space)} END AS d FROM (SELECT rowid, {e} AS e FROM records WHERE len(embedding) = {width}) x, {asked} q"

    @query(f"knn_dirty_{space}", f"SELECT rowid, row_number() OVER (ORDER BY d, rowid) - 1 AS place FROM ({sql}) WHERE NOT isnan(d)")
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "records")
        width = rows.filter("embedding is not null").groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first().w
        usable = rows.filter((F.size("embedding") == width) & F.expr("forall(embedding, x -> x <> 0 and not isnan(x) and abs(x) < double('inf'))"))
        found = knn_join(rows, usable.orderBy("rowid").limit(1).select(F.lit(0).cast("long").alias("qid"), "embedding"), rows.count(), space)
        found = found.filter(~F.isnan("distance"))
        return found.select("rowid", F.col("place").cast("long").alias("place"))



def _stated(spark: SparkSession, sf_dir: str) -> list[tuple[int, list[float]]]:
    """The queries: every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select("vec_id", "embedding").orderBy("vec_id")
    return [(r.vec_id, r.embedding) for r in rows.collect()]


_BATCH = f"""SELECT qid, rowid, place, {_sql_digits('d', 3)} AS distance FROM (
  SELECT q.rowid AS qid, x.rowid, d, row_number() OVER (PARTITION BY q.rowid ORDER BY d, x.rowid) - 1 AS place
  FROM (SELECT q.rowid AS q_, x.rowid AS x_, {_sql_distance('l2')} AS d FROM ({_E}) x, ({_E} WHERE vec_id % 20 = 0) q) m
  JOIN ({_E}) x ON x.rowid = m.x_ JOIN ({_E}) q ON q.rowid = m.q_) WHERE place < 5"""


@query("knn_batch", _BATCH)
def _knn_batch(spark, sf_dir):
    found = knn_batch(_vectors(spark, sf_dir), _stated(spark, sf_dir), 5, "l2")
    return found.select("qid", "rowid", F.col("place").cast("long").alias("place"), _digits(F.col("distance"), 3).alias("distance"))


@query("ivf_default", _BATCH.replace("place < 5", "place < 10"))
def ivf_default(spark, sf_dir):
    """The index with its default lists and probes, asked for every stated vector."""
    found = Ivf.build(_vectors(spark, sf_dir)).search_batch(_stated(spark, sf_dir), 10, "l2")
    return found.select("qid", "rowid", F.col("place").cast("long").alias("place"), _digits(F.col("distance"), 3).alias("distance"))


@query("knn_join", _BATCH)
def _knn_join(spark, sf_dir):
    """The stated vectors as a table of queries."""
    rows = _vectors(spark, sf_dir)
    found = knn_join(rows, table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 5, "l2")
    return found.select("qid", "rowid", F.col("place").cast("long").alias("place"), _digits(F.col("distance"), 3).alias("distance"))


@query("knn_nested_response", f"SELECT qid, list(rowid ORDER BY place) AS rowid, list(distance ORDER BY place) AS distance FROM ({_BATCH}) GROUP BY qid")
def knn_nested_response(spark, sf_dir):
    return nested_response(_knn_batch(spark, sf_dir))


@query("self_match_accuracy", f"SELECT avg((qid = rowid)::INTEGER) AS accuracy FROM ({_BATCH}) WHERE place = 0")
def self_match_accuracy(spark, sf_dir):
    """The nearest vector of each stated vector is the vector itself."""
    found = knn_batch(_vectors(spark, sf_dir), _stated(spark, sf_dir), 1, "l2")
    return found.agg(F.avg((F.col("qid") == F.col("rowid")).cast("double")).alias("accuracy"))


# Rank expressions over two dense leaves (vectors 0 and 1)

_LEAVES = f"""
a AS (SELECT rowid, d::FLOAT AS v, row_number() OVER (ORDER BY d::FLOAT, rowid) - 1 AS r FROM (
  SELECT x.rowid, {_sql_distance('l2')} AS d FROM ({_E}) x, ({_E} WHERE vec_id = 0) q ORDER BY d, x.rowid LIMIT 60)),
b AS (SELECT rowid, d::FLOAT AS v, row_number() OVER (ORDER BY d::FLOAT, rowid) - 1 AS r FROM (
  SELECT x.rowid, {_sql_distance('l2')} AS d FROM ({_E}) x, ({_E} WHERE vec_id = 1) q ORDER BY d, x.rowid LIMIT 60)),
u AS (SELECT coalesce(a.rowid, b.rowid) AS rowid, a.v AS av, b.v AS bv, a.r AS ar, b.r AS br FROM a FULL JOIN b ON a.rowid = b.rowid)
"""


def _rank(name: str, make: Callable[[dict, dict], dict], sql: str, ranks: bool = False, defaults: tuple = (None, None), more: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        queries = [_vector(spark, sf_dir, i) for i in (0, 1)]
        parts = [dense(q, 60, d, ranks) for q, d in zip(queries, defaults, strict=True)]
        made = {"rank": make(*parts), "select": {"keys": ["#score"]}} | (more or {})
        found = Collection(_vectors(spark, sf_dir), "l2", 64).search(made)
        return found.select(F.col("id").cast("long").alias("rowid"), _digits(F.col("score"), 3).alias("score"))

    QUERIES[name] = run
    SQL[name] = f"WITH {_LEAVES} SELECT rowid, {_sql_digits('s', 3)} AS score FROM ({sql})"


_rank("rank_sum_intersection", lambda a, b: combine("$sum", a, b), "SELECT rowid, av + bv AS s FROM u WHERE av IS NOT NULL AND bv IS NOT NULL")
_rank("rank_sum_default", lambda a, b: combine("$sum", a, b), "SELECT rowid, coalesce(av, 9) + coalesce(bv, 7) AS s FROM u", defaults=(9, 7))
_rank("rank_sum_left_default", lambda a, b: combine("$sum", a, b), "SELECT rowid, coalesce(av, 9) + bv AS s FROM u WHERE bv IS NOT NULL", defaults=(9, None))
_rank("rank_mul_val", lambda a, b: combine("$mul", a, val(2.5)), "SELECT rowid, av * 2.5 AS s FROM u WHERE av IS NOT NULL")
_rank("rank_sub", lambda a, b: combine("$sub", a, b), "SELECT rowid, av - bv AS s FROM u WHERE av IS NOT NULL AND bv IS NOT NULL")
_rank("rank_div", lambda a, b: combine("$div", b, combine("$sum", a, val(1))), "SELECT rowid, bv / (av + 1) AS s FROM u WHERE av IS NOT NULL AND bv IS NOT NULL")
_rank("rank_max", lambda a, b: combine("$max", a, b), "SELECT rowid, greatest(coalesce(av, 9), bv) AS s FROM u WHERE bv IS NOT NULL", defaults=(9, None))
_rank("rank_min", lambda a, b: combine("$min", a, b), "SELECT rowid, least(coalesce(av, 0.5), coalesce(bv, 0.5)) AS s FROM u", defaults=(0.5, 0.5))
_rank(
    "rank_abs_exp_log", lambda a, b: combine("$abs", combine("$log", combine("$exp", combine("$sub", val(0), a)))), "SELECT rowid, abs(ln(exp(-av::DOUBLE))) AS s FROM u WHERE av IS NOT NULL"
)
_rank("rank_return_rank", lambda a, b: a, "SELECT rowid, ar AS s FROM u WHERE ar IS NOT NULL", ranks=True)
_rank("rrf_two_leaves", lambda a, b: rrf([a, b]), "SELECT rowid, -(1.0 / (60 + ar) + 1.0 / (60 + br)) AS s FROM u WHERE ar IS NOT NULL AND br IS NOT NULL", ranks=True)
_rank(
    "rrf_defaults_page", lambda a, b: rrf([a, b]), "SELECT * FROM (SELECT rowid, -(1.0 / (60 + coalesce(ar, 100)) + 1.0 / (60 + coalesce(br, 100))) AS s FROM u) ORDER BY s::FLOAT, rowid LIMIT 10 OFFSET 3",
    ranks=True, defaults=(100, 100), more={"limit": {"limit": 10, "offset": 3}},
)
_rank("rank_constants_only", lambda a, b: combine("$sum", val(1), val(2)), "SELECT rowid, 0 AS s FROM u WHERE false")


@query("search_unranked", "SELECT rowid FROM records WHERE lang = 'en' ORDER BY rowid LIMIT 7 OFFSET 1")
def search_unranked(spark, sf_dir):
    found = Collection(table(spark, sf_dir, "records")).search({"filter": {"lang": "en"}, "limit": {"limit": 7, "offset": 1}, "select": {"keys": ["rowid"]}})
    return found.select("rowid")


# Groups


def _group(name: str, keys: list, op: str, aggregate: list, k: int, order: str, partition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _vectors(spark, sf_dir).withColumn("parity", F.when(F.col("rowid") % 3 != 0, F.col("rowid") % 2)).withColumn("label", F.when(F.col("label") != 4, F.col("label")))
        made = {"rank": dense(_vector(spark, sf_dir, 0), 200), "group_by": {"keys": keys, "aggregate": {op: {"keys": aggregate, "k": k}}}, "select": {"keys": ["label"]}}
        return Collection(rows, "l2", 64).search(made).select(F.col("id").cast("long").alias("rowid"), "label")

    QUERIES[name] = run
    SQL[name] = f"""
WITH v AS (SELECT rowid, CASE WHEN label <> 4 THEN label END::BIGINT AS label, CASE WHEN rowid % 3 <> 0 THEN rowid % 2 END AS parity, e FROM ({_E})),
s AS (SELECT x.rowid, x.label, x.parity, d::FLOAT AS score FROM (
  SELECT x.*, {_sql_distance('l2')} AS d FROM v x, ({_E} WHERE vec_id = 0) q ORDER BY d, x.rowid LIMIT 200) x)
SELECT rowid, label FROM (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}, score, rowid) AS r FROM s) WHERE r <= {k}"""


_group("group_min_k", ["label"], "$min_k", ["#score"], 2, "score", "label")
_group("group_max_k", ["label"], "$max_k", ["#score"], 2, "score DESC", "label")
_group("group_missing_key", ["label"], "$min_k", ["parity"], 3, "parity ASC NULLS FIRST", "label")
_group("group_missing_key_max", ["label"], "$max_k", ["parity"], 3, "parity DESC NULLS LAST", "label")
_group("group_two_keys", ["label", "parity"], "$min_k", ["#score"], 1, "score", "label, parity")


# Keywords

_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
_POSTINGS = f"""
w AS (SELECT doc_id AS rowid, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS dim FROM documents WHERE text IS NOT NULL),
tf AS (SELECT rowid, dim, count(*)::DOUBLE AS tf FROM w WHERE dim NOT IN ({_STOP_SQL}) GROUP BY rowid, dim),
n AS (SELECT rowid, sum(tf) AS n FROM tf GROUP BY rowid),
p AS (SELECT tf.rowid, dim, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256)) AS value FROM tf JOIN n ON tf.rowid = n.rowid)
"""
_TERMS = ("shard", "vector", "index")
_IDF = f"""
df AS (SELECT dim, count(*) AS df FROM p WHERE dim IN {_TERMS} GROUP BY dim),
i AS (SELECT dim, ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) AS idf FROM df)
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("rowid"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), "lang", "source", F.lit(None).cast("array<float>").alias("embedding"))


@query("bm25_doc_weights", f"WITH {_POSTINGS} SELECT rowid, dim, round(value, 6) AS value FROM p")
def bm25_doc_weights(spark, sf_dir):
    return text_postings(_documents(spark, sf_dir)).select("rowid", "dim", F.round("value", 6).alias("value"))


@query("document_frequency", f"WITH {_POSTINGS} SELECT dim, count(*) AS df FROM p GROUP BY dim")
def _document_frequency(spark, sf_dir):
    return document_frequency(text_postings(_documents(spark, sf_dir)))


@query("bm25_idf", f"WITH {_POSTINGS}, {_IDF} SELECT dim, round(idf, 6) AS weight FROM i")
def bm25_idf(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    rows = text_postings(docs)
    return idf(rows, query_frame(rows, [(t, 1.0) for t in _TERMS]), docs.count()).select("dim", F.round("weight", 6).alias("weight"))


def _keyword_collection(spark: SparkSession, sf_dir: str) -> Collection:
    docs = _documents(spark, sf_dir)
    return Collection(docs, "l2", None, {"bm25": TextIndex()}, ["bm25"])


def _bm25(spark: SparkSession, sf_dir: str, limit: int, clause: dict | None = None) -> DataFrame:
    from orrery.operators.filters import parse_where
    from orrery.operators.rank import Leaf, Node
    from orrery.operators.search import Payload

    leaf = Leaf(sparse=tuple((t, 1.0) for t in _TERMS), key="bm25", limit=limit)
    found = _keyword_collection(spark, sf_dir).ranked(Payload(parse_where(clause) if clause else None, Node("$knn", leaf=leaf)))
    return found.select("rowid", _digits(F.col("score"), 3).alias("score"))


def _sql_bm25(limit: int, keep: str = "true") -> str:
    return f"""WITH {_POSTINGS}, {_IDF} SELECT rowid, {_sql_digits('raw', 3)} AS score FROM (
      SELECT rowid, 1 - sum(value * idf) AS raw FROM p JOIN i ON p.dim = i.dim WHERE rowid IN (SELECT doc_id FROM documents WHERE {keep}) GROUP BY rowid)
      ORDER BY raw, rowid LIMIT {limit}"""


@query("bm25_topk", _sql_bm25(15))
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 15)


@query("bm25_filtered", _sql_bm25(15, "lang = 'en'"))
def bm25_filtered(spark, sf_dir):
    return _bm25(spark, sf_dir, 15, {"lang": "en"})


_HYBRID = f"""WITH {_POSTINGS}, {_IDF},
e AS (SELECT vec_id AS rowid, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
dl AS (SELECT rowid, row_number() OVER (ORDER BY d::FLOAT, rowid) - 1 AS r FROM (
  SELECT x.rowid, {_sql_distance('cosine')} AS d FROM e x JOIN documents o ON o.doc_id = x.rowid, e q WHERE q.rowid = 0 ORDER BY d, x.rowid LIMIT 100)),
kl AS (SELECT rowid, row_number() OVER (ORDER BY raw::FLOAT, rowid) - 1 AS r FROM (
  SELECT p.rowid, 1 - sum(value * idf) AS raw FROM p JOIN i ON p.dim = i.dim JOIN e ON e.rowid = p.rowid GROUP BY p.rowid ORDER BY raw, p.rowid LIMIT 100)),
h AS (SELECT coalesce(dl.rowid, kl.rowid) AS rowid, -(1.0 / (60 + coalesce(dl.r, 100)) + 1.0 / (60 + coalesce(kl.r, 100))) AS s FROM dl FULL JOIN kl ON dl.rowid = kl.rowid)
"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rowid, lang, score): documents with a vector, by fusion of a dense and a keyword leaf."""
    from orrery.operators.rank import Leaf, leaf_scores, parse_rank, score

    docs = _documents(spark, sf_dir).drop("embedding")
    both = docs.join(_vectors(spark, sf_dir).select("rowid", "embedding"), "rowid")
    collection = Collection(both, "cosine", 64)
    vector = _vector(spark, sf_dir, 0)
    keyword = Leaf(sparse=tuple((t, 1.0) for t in _TERMS), key="bm25", limit=100, default=100.0, return_rank=True)
    found = [
        collection.leaf(Leaf(query=tuple(vector), limit=100, default=100.0, return_rank=True), both, False),
        leaf_scores(TextIndex().scores(docs, keyword.sparse, both, docs.count()), keyword),
    ]
    tree = parse_rank(rrf([dense(vector, 100, 100, True), sparse({"indices": [], "values": []}, "bm25", 100, 100, True)]))
    return score(tree, found).join(docs.select("rowid", "lang"), "rowid")


@query("hybrid_rrf", f"{_HYBRID} SELECT rowid, {_sql_digits('s', 4)} AS score FROM h")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("rowid", _digits(F.col("score"), 4).alias("score"))


@query(
    "hybrid_best_per_group",
    f"{_HYBRID} SELECT rowid, lang FROM (SELECT h.rowid, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY s::FLOAT, h.rowid) AS r FROM h JOIN documents d ON d.doc_id = h.rowid) WHERE r <= 2",
)
def hybrid_best_per_group(spark, sf_dir):
    from orrery.operators.grouping import GroupBy, best_of_groups

    return best_of_groups(_hybrid(spark, sf_dir), GroupBy(("lang",), "$min_k", ("#score",), 2)).select("rowid", "lang")


@query("movies_keyword_search", f"""
WITH w AS (SELECT movie_key AS rowid, unnest(regexp_extract_all(lower(overview), '[\\p{{L}}\\p{{N}}]+')) AS dim FROM movies WHERE overview IS NOT NULL),
tf AS (SELECT rowid, dim, count(*)::DOUBLE AS tf FROM w WHERE dim NOT IN ({_STOP_SQL}) GROUP BY rowid, dim),
n AS (SELECT rowid, sum(tf) AS n FROM tf GROUP BY rowid),
p AS (SELECT tf.rowid, dim, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256)) AS value FROM tf JOIN n ON tf.rowid = n.rowid)
SELECT rowid, {_sql_digits('raw', 3)} AS score FROM (SELECT rowid, 1 - sum(value) AS raw FROM p WHERE dim IN ('lighthouse', 'captain') GROUP BY rowid) ORDER BY raw, rowid LIMIT 10
""")
def movies_keyword_search(spark, sf_dir):
    from orrery.operators.rank import Leaf, leaf_scores

    rows = table(spark, sf_dir, "movies").select(F.col("movie_key").alias("rowid"), F.col("overview").alias("document"))
    leaf = Leaf(sparse=(("lighthouse", 1.0), ("captain", 1.0)), key="bm25", limit=10)
    found = leaf_scores(TextIndex().scores(rows, leaf.sparse), leaf)
    return found.select("rowid", _digits(F.col("v"), 3).alias("score"))


# Words, encodings, analysis


@query("tokenize", "SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM documents WHERE text IS NOT NULL")
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", words(F.col("text")).alias("words"))


@query("content_words", f"""SELECT doc_id, CASE WHEN len(k) = 0 THEN w ELSE k END AS words FROM (
  SELECT doc_id, w, list_filter(w, lambda x: x NOT IN ({_STOP_SQL})) AS k FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL))""")
def _content_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", content_words(F.col("text")).alias("words"))


@query("hash_embed")
def hash_embed(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").select("item_id", hashing_embedder(64)(F.col("question")).alias("embedding"))


@query("question_nearest_passage")
def question_nearest_passage(spark, sf_dir):
    """Each question's nearest support passage, both embedded by feature hashing; whether it is the question's own."""
    items = table(spark, sf_dir, "eval_items")
    made = hashing_embedder(256)
    passages = items.filter("support is not null").select(F.col("item_id").alias("rowid"), made(F.col("support")).alias("embedding"))
    questions = [(r.item_id, r.q) for r in items.select("item_id", made(F.col("question")).alias("q")).orderBy("item_id").collect()]  # a fixed 240
    return knn_batch(passages, questions, 1, "cosine").select(F.col("qid").alias("item_id"), F.col("rowid").alias("passage"), (F.col("qid") == F.col("rowid")).alias("own"))


@query("base64_roundtrip", "SELECT vec_id, embedding FROM embeddings")
def base64_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", decode_base64(encode_base64(F.col("embedding"))).alias("embedding"))


@query("keyword_top5", f"""
WITH w AS (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS l FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id, word, count(*) AS c, min(pos) AS f FROM w WHERE strlen(word) >= 4 AND word NOT IN ({_STOP_SQL}) GROUP BY doc_id, word),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) AS r FROM c)
SELECT doc_id, string_agg(word, ' ' ORDER BY r) AS keywords FROM r WHERE r <= 5 GROUP BY doc_id""")
def keyword_top5(spark, sf_dir):
    return keywords(table(spark, sf_dir, "documents"))


_TRIAL = """
WITH ranked AS (SELECT search_id AS query_id, rowid AS doc_id, row_number() OVER (PARTITION BY search_id ORDER BY score, rowid) AS place
  FROM (SELECT DISTINCT search_id, rowid, min(score) AS score FROM search_hits WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY search_id, rowid)),
relevant AS (SELECT DISTINCT search_id AS query_id, rowid AS doc_id FROM search_hits WHERE category = 'biology'),
n AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY query_id),
h AS (SELECT r.query_id, place, row_number() OVER (PARTITION BY r.query_id ORDER BY place) AS seen FROM ranked r JOIN relevant l ON r.query_id = l.query_id AND r.doc_id = l.doc_id WHERE place <= 10),
p AS (SELECT query_id, count(*) AS h, sum(seen / place) AS ap, sum(1 / log2(place + 1)) AS gain FROM h GROUP BY query_id),
e AS (SELECT n.query_id, n, coalesce(h, 0) AS h, coalesce(ap, 0) AS ap, coalesce(gain, 0) AS gain,
  list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS best FROM n LEFT JOIN p ON n.query_id = p.query_id)
SELECT round(avg(h / 10), 5) AS precision, round(avg(h / n), 5) AS recall, round(avg(ap / n), 5) AS map, round(avg(gain / best), 5) AS ndcg FROM e"""


@query("retrieval_metrics", _TRIAL)
def _retrieval_metrics(spark, sf_dir):
    hits = table(spark, sf_dir, "search_hits")
    best = hits.filter("score is not null and not isnan(score)").groupBy("search_id", "rowid").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("search_id").orderBy("score", "rowid"))
    ranked = best.select(F.col("search_id").alias("query_id"), F.col("rowid").alias("doc_id"), place.alias("place"))
    return retrieval_metrics(ranked, hits.filter("category = 'biology'").select(F.col("search_id").alias("query_id"), F.col("rowid").alias("doc_id")), 10)


@query("schema_key_growth", """
SELECT DISTINCT key, kind FROM (
  SELECT 'category' AS key, 4 AS kind FROM records WHERE category IS NOT NULL UNION ALL SELECT 'lang', 4 FROM records WHERE lang IS NOT NULL
  UNION ALL SELECT 'year', 2 FROM records WHERE year IS NOT NULL UNION ALL SELECT 'rating', 3 FROM records WHERE rating IS NOT NULL)""")
def schema_key_growth(spark, sf_dir):
    parts = [F.struct(F.lit(k).alias("key"), F.struct(F.when(F.col(k).isNotNull(), F.lit(n)).alias("kind")).alias("value")) for k, n in (("category", 4), ("lang", 4), ("year", 2), ("rating", 3))]
    rows = table(spark, sf_dir, "records").select(F.map_from_entries(F.array(*parts)).alias("metadata"))
    return log.key_growth(rows).filter("kind is not null")


# Writes: the state are all records, the batch changes every one and brings as many new ones


def _entries(*keys: str):
    made = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.col(k) for k in keys)))
    kept = F.map_filter(made, lambda k, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "records").withColumn("id", F.col("rowid").cast("string"))
    return rows.select("rowid", "id", "embedding", "document", "uri", _entries("category", "lang").alias("metadata"), "seq")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record under its own and under a new id, each twice: once with a new language and no category, then with a new document."""
    rows = table(spark, sf_dir, "records").withColumn("id", F.explode(F.array(F.col("rowid").cast("string"), F.concat(F.lit("new-"), "rowid"))))
    null = F.lit(None).cast("string")
    first = F.map_from_arrays(F.array(F.lit("category"), F.lit("lang")), F.array(null, F.upper("lang")))
    second = F.map_from_arrays(F.array(F.lit("extra")), F.array(F.lit("yes")))
    one = rows.select((F.col("rowid") * 2).alias("ord"), "id", "embedding", null.alias("document"), "uri", first.alias("metadata"))
    two = rows.select((F.col("rowid") * 2 + 1).alias("ord"), "id", F.lit(None).cast("array<float>").alias("embedding"), F.lit("changed").alias("document"), null.alias("uri"), second.alias("metadata"))
    return one.unionByName(two)


def _written(state: DataFrame) -> DataFrame:
    meta = F.col("metadata")
    return state.select("id", "rowid", F.size("embedding").alias("dims"), "document", "uri", *(F.try_element_at(meta, F.lit(k)).alias(k) for k in ("category", "lang", "extra")), F.col("seq").alias("seq"))


_LOG = """
WITH s AS (SELECT rowid, rowid::VARCHAR AS id, len(embedding) AS dims, document, uri, category, lang, seq FROM records),
b AS (SELECT rowid AS o, unnest([rowid::VARCHAR, 'new-' || rowid]) AS id, len(embedding) AS dims, uri, upper(lang) AS lang FROM records),
kept AS (SELECT s.id, s.rowid, CASE WHEN b.id IS NULL THEN s.dims ELSE coalesce(b.dims, s.dims) END AS dims, CASE WHEN b.id IS NULL THEN s.document ELSE 'changed' END AS document,
  CASE WHEN b.id IS NULL THEN s.uri ELSE coalesce(b.uri, s.uri) END AS uri, CASE WHEN b.id IS NULL THEN category END AS category,
  CASE WHEN b.id IS NULL THEN s.lang ELSE b.lang END AS lang, CASE WHEN b.id IS NOT NULL THEN 'yes' END AS extra, CASE WHEN b.id IS NULL THEN s.seq ELSE 99 END AS seq
  FROM s LEFT JOIN b ON s.id = b.id),
fresh AS (SELECT b.id, (SELECT max(rowid) FROM s) + row_number() OVER (ORDER BY b.o) AS rowid, b.dims, b.uri, b.lang FROM b WHERE b.id NOT IN (SELECT id FROM s))
"""


@query("add_ignore_existing", f"""{_LOG} SELECT id, rowid, dims::INTEGER AS dims, document, uri, category, lang, NULL::VARCHAR AS extra, seq FROM s
UNION ALL SELECT id, rowid, dims::INTEGER, NULL, uri, NULL, lang, NULL, 99 FROM fresh""")
def add_ignore_existing(spark, sf_dir):
    return _written(log.add(_state(spark, sf_dir), _batch(spark, sf_dir), 99))


@query("update_existing_only", f"{_LOG} SELECT id, rowid, dims::INTEGER AS dims, document, uri, category, lang, extra, seq FROM kept")
def update_existing_only(spark, sf_dir):
    return _written(log.update(_state(spark, sf_dir), _batch(spark, sf_dir), 99))


@query("upsert_merge", f"""{_LOG} SELECT id, rowid, dims::INTEGER AS dims, document, uri, category, lang, extra, seq FROM kept
UNION ALL SELECT id, rowid, dims::INTEGER, 'changed', uri, NULL, lang, 'yes', 99 FROM fresh""")
def upsert_merge(spark, sf_dir):
    return _written(log.upsert(_state(spark, sf_dir), _batch(spark, sf_dir), 99))


@query("delete_by_filter_limit", "WITH d AS (SELECT rowid FROM records WHERE lang = 'en' ORDER BY rowid LIMIT 50) SELECT rowid, id FROM records WHERE rowid NOT IN (SELECT rowid FROM d)")
def delete_by_filter_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "records").select("rowid", "id", "lang")
    return log.delete(rows, None, F.col("lang") == "en", 50)[0].select("rowid", "id")


@query("delete_by_ids", "SELECT rowid, id FROM records WHERE id NOT IN ('100000', 'none')")
def delete_by_ids(spark, sf_dir):
    return log.delete(table(spark, sf_dir, "records").select("rowid", "id"), ["100000", "none"])[0]


@query("replay_log", """
WITH l AS (SELECT collection_id, id, row_number() OVER (PARTITION BY collection_id, id ORDER BY seq DESC, rowid DESC) AS r, rowid, seq FROM records)
SELECT collection_id, id, rowid, seq FROM l WHERE r = 1""")
def replay_log(spark, sf_dir):
    """The last write of each id of each collection."""
    rows = table(spark, sf_dir, "records")
    return log.last_writes(rows, ["collection_id", "id"], ["seq", "rowid"], ["rowid", "seq"])


@query("movies_csv_year", """SELECT id, title, nullif(original_language, '') AS original_language, nullif(adult, '') AS adult, budget, overview, nullif(release_date, '') AS release_date, try_cast(substr(release_date, 1, 4) AS INTEGER) AS year
FROM movies WHERE trim(title) <> '' AND trim(overview) <> ''""")
def movies_csv_year(spark, sf_dir):
    """The movies written as a CSV file and read again."""
    path = shared_folder(spark, "movies-csv")
    flat = table(spark, sf_dir, "movies").select("adult", "budget", "id", "original_language", "overview", "release_date", "title")
    flat.coalesce(1).write.csv(path, header=True, quote='"', escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return movies_csv(spark, path)


@query("document_lines", r"""
SELECT trim(line, E' \t\r') AS text, place AS line_number FROM (SELECT unnest(l) AS line, unnest(range(1, len(l) + 1)) AS place FROM (
  SELECT string_split(string_agg(question, E'\n' ORDER BY item_id), E'\n') AS l FROM eval_items)) WHERE trim(line, E' \t\r') <> ''""")
def document_lines(spark, sf_dir):
    """The questions written as one text file and read by lines with their numbers."""
    path = shared_folder(spark, "lines")
    table(spark, sf_dir, "eval_items").filter("question is not null").orderBy("item_id").select("question").coalesce(1).write.text(path)
    return text_lines(spark, path).select("text", F.col("line_number").cast("long").alias("line_number"))


@query("line_retrieval")
def line_retrieval(spark, sf_dir):
    """For each question's own line of a file, the nearest line with its file and number, both embedded by feature hashing."""
    path = shared_folder(spark, "lines")
    table(spark, sf_dir, "eval_items").filter("support is not null").orderBy("item_id").select(F.regexp_replace("support", r"\s+", " ").alias("line")).coalesce(1).write.text(path)
    made = hashing_embedder(256)
    lines = text_lines(spark, path).withColumn("rowid", F.col("line_number").cast("long")).withColumn("embedding", made(F.col("text")))
    asked = table(spark, sf_dir, "eval_items").filter("question is not null").select(F.col("item_id").alias("qid"), made(F.col("question")).alias("embedding"))
    found = knn_join(lines, asked, 1, "cosine")
    return found.join(lines.select("rowid", "filename", "line_number", "text"), "rowid").select("qid", "line_number", "text")


@query("movies_hybrid")
def movies_hybrid(spark, sf_dir):
    """Movies by fusion of a hashed embedding of the overview and its keywords, leaves of 100 with the default 100, ten best."""
    made = hashing_embedder(128)
    rows = table(spark, sf_dir, "movies").filter("overview is not null").select(
        F.col("movie_key").alias("rowid"), F.col("movie_key").cast("string").alias("id"), F.col("overview").alias("document"), "title", made(F.col("overview")).alias("embedding"))
    text = "a captain near the lighthouse"
    vector = spark.range(1).select(made(F.lit(text)).alias("v")).first().v
    keyword = {"indices": [], "values": []}
    from orrery.operators.rank import Leaf, leaf_scores, ordered, parse_rank, score

    both = Collection(rows, "cosine", 128)
    found = [
        both.leaf(Leaf(query=tuple(vector), limit=100, default=100.0, return_rank=True), rows, False),
        leaf_scores(TextIndex().scores(rows, [("captain", 1.0), ("lighthouse", 1.0)], None, rows.count()), Leaf(sparse=(), key="bm25", limit=100, default=100.0, return_rank=True)),
    ]
    tree = parse_rank(rrf([dense(vector, 100, 100, True), sparse(keyword, "bm25", 100, 100, True)]))
    return ordered(score(tree, found)).limit(10).join(rows.select("rowid", "title"), "rowid")


@query("sparse_documents", f"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+')) AS term FROM eval_items WHERE question IS NOT NULL),
tf AS (SELECT item_id, term, count(*)::DOUBLE AS tf FROM w WHERE term NOT IN ({_STOP_SQL}) GROUP BY ALL),
n AS (SELECT item_id, sum(tf) AS n FROM tf GROUP BY ALL),
raw AS (SELECT DISTINCT term, hex(encode(term)) AS x FROM tf),
h AS (SELECT term, list_reduce(list_transform(range(0, len(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1),
  lambda a, b: (xor(a, b) * 16777619) % 4294967296, 2166136261) % 2147483648 AS dim FROM raw)
SELECT tf.item_id, dim, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256))), 4) AS value FROM tf JOIN n ON n.item_id = tf.item_id JOIN h ON h.term = tf.term GROUP BY ALL
""")
def _sparse_documents(spark, sf_dir):
    """Keyword vectors with hashed dimensions."""
    rows = table(spark, sf_dir, "eval_items").filter("question is not null").select("item_id", sparse_documents(F.col("question")).alias("s"))
    pairs = F.arrays_zip(F.col("s.indices").alias("dim"), F.col("s.values").alias("value"))
    return rows.select("item_id", F.inline(pairs).alias("dim", "value")).select("item_id", "dim", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("search_responses", """
SELECT 0 AS search, list(id ORDER BY rowid) AS ids, list(document ORDER BY rowid) AS documents, NULL AS scores FROM (SELECT * FROM records WHERE lang = 'en' ORDER BY rowid LIMIT 7)
UNION ALL SELECT 1, list(id ORDER BY rowid), NULL, NULL FROM (SELECT * FROM records WHERE year > 2015 ORDER BY rowid LIMIT 3 OFFSET 2)""")
def search_responses(spark, sf_dir):
    """Two searches answered together, the second without documents."""
    asked = [{"filter": {"lang": "en"}, "limit": {"limit": 7}, "select": {"keys": ["#document"]}}, {"filter": {"year": {"$gt": 2015}}, "limit": {"limit": 3, "offset": 2}}]
    return Collection(table(spark, sf_dir, "records")).respond(asked).select("search", "ids", "documents", F.lit(None).cast("string").alias("scores"))


# Collections of a catalog


def _store(spark: SparkSession) -> Catalog:
    return Catalog(spark, shared_folder(spark, "catalog"))


def _labelled(spark: SparkSession, sf_dir: str, more: dict | None = None, id: str = "cast(vec_id as string)") -> DataFrame:  # noqa: A002
    """All embeddings as a batch of writes."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").cast("long").alias("ord"), F.expr(id).alias("id"), "embedding", F.lit(None).cast("string").alias("document"), F.lit(None).cast("string").alias("uri"),
        typed_metadata({"label": "label as long"} | (more or {})).alias("metadata"),
    )


def _held(collection, name: str) -> DataFrame:
    meta = lambda key, field: F.try_element_at("metadata", F.lit(key))[field]
    return collection.get().select(F.lit(name).alias("collection"), "id", "rowid", meta("label", "i").alias("label"), meta("tag", "s").alias("tag"), "seq")


@query("catalog_fork_diverge", """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS one FROM embeddings),
v AS (SELECT vec_id::VARCHAR AS id, row_number() OVER (ORDER BY vec_id) AS rowid, label::BIGINT AS label FROM embeddings)
SELECT 'parent' AS collection, id, rowid, label, NULL AS tag, n AS seq FROM v, n WHERE label <> 3
UNION ALL SELECT 'child', id, rowid, label, CASE WHEN label = 1 THEN 'forked' END, CASE WHEN label = 1 THEN n + one ELSE n END FROM v, n WHERE label <> 2""")
def catalog_fork_diverge(spark, sf_dir):
    """A collection and its fork, written apart."""
    store = _store(spark)
    parent = store.create_collection("parent")
    parent.write("add", _labelled(spark, sf_dir))
    child = parent.fork("child")
    child.write("update", _labelled(spark, sf_dir, {"tag": "'forked' as string"}).filter(F.try_element_at("metadata", F.lit("label"))["i"] == 1))
    child.delete(where={"label": 2})
    parent.delete(where={"label": 3})
    return _held(parent, "parent").unionByName(_held(child, "child"))


@query("catalog_upsert", """
WITH n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, label::BIGINT AS label FROM embeddings)
SELECT 'c' AS collection, vec_id::VARCHAR AS id, r AS rowid, label + 100 AS label, NULL AS tag, 3 * n AS seq FROM v, n
UNION ALL SELECT 'c', 'new-' || vec_id, n + r, label, 'x', 3 * n FROM v, n""")
def catalog_upsert(spark, sf_dir):
    """Every record changed and as many added, in one write of a collection that is read again."""
    store = _store(spark)
    c = store.create_collection("store")
    c.write("add", _labelled(spark, sf_dir))
    c.write("upsert", _labelled(spark, sf_dir, {"label": "label + 100 as long"}).unionByName(_labelled(spark, sf_dir, {"tag": "'x' as string"}, "concat('new-', vec_id)")))
    return _held(Catalog(spark, store.root).collection("store"), "c")


@query("stream_twice", """SELECT vec_id::VARCHAR AS id, label::BIGINT + 7 AS label FROM embeddings UNION ALL SELECT 'other-' || vec_id, label::BIGINT FROM embeddings""")
def stream_twice(spark, sf_dir):
    """Two streams of writes into one collection, the first run again after its end: each batch counts once."""
    from orrery.streaming.sink import write_stream

    c = _store(spark).create_collection("streamed")
    folder = shared_folder(spark, "streams")
    for name, batch in (("one", _labelled(spark, sf_dir, {"label": "label + 7 as long"})), ("two", _labelled(spark, sf_dir, id="concat('other-', vec_id)"))):
        batch.write.parquet(f"{folder}/{name}")
        for _ in range(2):
            stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/{name}")
            write_stream(stream, c, f"{folder}/checkpoint-{name}").awaitTermination()
    return _held(c, "s").select("id", "label")


for _space in ("l2", "ip", "cosine"):
    _dirty(_space)
