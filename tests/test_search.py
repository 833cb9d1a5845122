import math

import numpy as np
import pytest

from orrery.errors import EngineError, InvalidArgument, Unprocessable, Validation
from orrery.functions.text import embed, embedder, encode_document, encode_query, fnv, split_words, term_dimensions
from orrery.functions.vectors import decode_base64, distance_to, encode_base64, parse_vector
from orrery.operators.grouping import parse_group_by
from orrery.operators.knn import Ivf, knn, knn_batch, knn_join, knn_two_stage, restrict_ids
from orrery.operators.metrics import keywords, retrieval_metrics
from orrery.operators.rank import combine, dense, leaves, parse_rank, rrf, score, sparse, val
from orrery.operators.search import Collection, parse_payload, sort_keys
from orrery.operators.sparse import postings


@pytest.fixture(scope="module")
def plane(spark):
    rows = [(1, "u", [2.0, 0.0]), (2, "v", [0.5, 0.5]), (3, "w", [-1.0, 3.0]), (4, "n", None), (5, "z", [0.0])]
    return spark.createDataFrame(rows, "rowid long, id string, embedding array<float>").selectExpr("*", "cast(null as string) document")


@pytest.mark.parametrize("space,query,want", [
    ("l2", [3, 0], [("u", 1.0), ("v", 6.5), ("w", 25.0)]), ("l2", [0.1, 0.9], [("v", 0.32), ("u", 4.42), ("w", 5.62)]),
    ("ip", [3, 0], [("u", -5.0), ("v", -0.5), ("w", 4.0)]), ("ip", [0.1, 0.9], [("w", -1.6), ("v", 0.5), ("u", 0.8)]),
    ("cosine", [3, 0], [("u", 0.0), ("v", 0.292893), ("w", 1.316228)]), ("cosine", [0.1, 0.9], [("w", 0.092041), ("v", 0.219131), ("u", 0.889568)]),
])
def test_distances(plane, space, query, want):
    got = [(r.id, r.distance) for r in knn(plane, query, 3, space).collect()]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([d for _, d in got], [d for _, d in want], atol=1e-5)
    assert knn(plane, query, 0, space).count() == 0
    with pytest.raises(InvalidArgument):
        knn(plane, query, 3, space, dimension=3)


@pytest.mark.parametrize("d", [16, 300])
def test_filtered_search_is_exact(spark, d):
    rng = np.random.default_rng(d)
    x = rng.uniform(-1, 1, (600, d)).astype(np.float32)
    df = spark.createDataFrame([(i, str(i), [float(v) for v in x[i]], i % 50) for i in range(600)], "rowid long, id string, embedding array<float>, bucket long")
    for space in ("l2", "cosine"):
        for q in (0, 7):
            query = x[q].astype(float).tolist()
            rows = [i for i in range(600) if i % 50 == 7]
            a, b = x[rows].astype(float), x[q].astype(float)
            dist = ((a - b) ** 2).sum(1) if space == "l2" else 1 - a @ b / (np.linalg.norm(a, axis=1) * np.linalg.norm(b))
            want = [rows[i] for i in np.lexsort((rows, dist))[:10]]
            kept = df.filter("bucket = 7")
            assert [r.rowid for r in knn(kept, query, 10, space).collect()] == want
            batch = knn_batch(kept, [(5, query)], 10, space).orderBy("place").collect()
            assert [r.rowid for r in batch] == want and [r.place for r in batch] == list(range(10))
    assert [r.rowid for r in knn_two_stage(df, x[3].tolist(), 4, "l2").collect()] == [r.rowid for r in knn(df, x[3].tolist(), 4, "l2").collect()]
    index = Ivf.build(df, lists=12)
    hits = [len({r.rowid for r in index.search(x[q].tolist(), 10, "l2", probes=9).collect()} & {r.rowid for r in knn(df, x[q].tolist(), 10, "l2").collect()}) for q in range(5)]
    assert sum(hits) >= 45
    assert index.search(x[0].tolist(), 590, "l2", probes=1).count() == 590  # falls back to all lists


@pytest.mark.parametrize("space", ["l2", "ip", "cosine"])
def test_index_with_default_probes_loses_no_neighbour(spark, space):
    x = np.random.default_rng(4).normal(size=(700, 24)).astype(np.float32)
    x[5] = 0
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(700)], "rowid long, embedding array<float>")
    index = Ivf.build(df)
    stated = [(q, x[q].tolist()) for q in range(0, 700, 20)]
    want = {(r.qid, r.place): r.rowid for r in knn_batch(df, stated, 10, space).collect()}
    assert {(r.qid, r.place): r.rowid for r in index.search_batch(stated, 10, space).collect()} == want
    assert [r.rowid for r in index.search(stated[1][1], 10, space).collect()] == [want[20, p] for p in range(10)]
    assert index.search_batch([(1, x[5].tolist())], 10, space, probes=1).count() == 10
    if space == "l2":
        near = {(r.qid, r.rowid) for r in index.search_batch(stated, 10, space, exact=False).collect()}
        assert len(near & {(q, r) for (q, _), r in want.items()}) >= 0.9 * len(want) and index.probes < 64


def test_batches_and_joins_of_dirty_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    x[7], x[8], x[9, 0], x[10, 0], x[11] = 0, x[3], np.nan, np.inf, x[3] * 1e20
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(900, None), (901, [1.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "rowid long, embedding array<float>")
    asked = [*range(0, 12), 50, 290]
    for space in ("l2", "ip", "cosine"):
        a = x.astype(float)
        with np.errstate(all="ignore"):
            d = [((a - a[q]) ** 2).sum(1) if space == "l2" else 1 - (a * a[q]).sum(1) / (1 if space == "ip" else np.sqrt((a * a).sum(1)) * np.sqrt((a[q] * a[q]).sum())) for q in asked]
        want = {(q, p): int(r) for q, v in zip(asked, d, strict=True) for p, r in enumerate(np.lexsort((np.arange(300), v))[:295])}
        got = knn_batch(df.filter("rowid is not null"), [(q, x[q].tolist()) for q in asked], 295, space).collect()
        finite = {(r.qid, r.rowid): r.place for r in got}
        assert len(got) == len(finite) == len(want)
        for q in asked:
            assert {r for (a_, r) in finite if a_ == q} == {want[q, p] for p in range(295)}, (space, q)
        table = df.filter(df.rowid.isin(*asked)).selectExpr("rowid qid", "embedding")
        for blocks in ({}, {"query_block": 3, "record_block": 40}):
            joined = {(r.qid, r.rowid): r.place for r in knn_join(df, table, 20, space, **blocks).collect()}
            assert joined == {(r.qid, r.rowid): r.place for r in knn_batch(df.filter("rowid is not null"), [(q, x[q].tolist()) for q in asked], 20, space).collect()}
    assert knn_join(df, table.limit(0), 3).count() == 0 and knn_join(df.limit(0), table, 3).count() == 0


def test_ids_and_zero_vectors(spark, plane):
    with pytest.raises(EngineError, match="Error finding id"):
        restrict_ids(plane, ["u", "missing"])
    df = spark.createDataFrame([(1, [0.0, 0.0])], "rowid long, embedding array<float>")
    assert math.isnan(df.select(distance_to(df.embedding, [1.0, 0.0], "cosine").alias("d")).first().d)
    assert knn_batch(plane, [], 3).count() == 0 and knn_batch(plane.limit(0), [(1, [1.0, 2.0])], 3).count() == 0


def frame(spark, pairs):
    return spark.createDataFrame([(int(r), float(v)) for r, v in pairs], "rowid long, v float")


def ranked(spark, tree, *found):
    node = parse_rank(tree)
    assert len(leaves(node)) == len(found)
    return {r.rowid: r.score for r in score(node, [frame(spark, f) for f in found]).collect()}


def test_partial_domains(spark):
    a, b = dense([1.0]), dense([2.0])
    one, two = [(1, 1.0), (2, 2.0)], [(2, 3.0)]
    assert ranked(spark, combine("$sum", a, b), one, two) == {2: 5.0}
    assert ranked(spark, combine("$sum", a, dense([2.0], default=10)), one, two) == {1: 11.0, 2: 5.0}
    assert ranked(spark, combine("$sum", dense([1.0], default=1), dense([2.0], default=10)), [(1, 1.0)], [(2, 3.0)]) == {1: 11.0, 2: 4.0}
    assert ranked(spark, combine("$sub", val(5), a), one) == {1: 4.0, 2: 3.0}
    assert ranked(spark, combine("$max", a, val(1.5)), one) == {1: 1.5, 2: 2.0}
    assert ranked(spark, combine("$min", a, b), one, two) == {2: 2.0}
    got = ranked(spark, combine("$div", a, val(0)), [(1, 1.0), (2, -1.0), (3, 0.0)])
    assert got[1] == math.inf and got[2] == -math.inf and math.isnan(got[3])
    got = ranked(spark, combine("$log", a), [(1, 0.0), (2, -1.0), (3, math.e)])
    assert got[1] == -math.inf and math.isnan(got[2]) and abs(got[3] - 1) < 1e-6
    got = ranked(spark, combine("$min", a, val(1)), [(1, float("nan"))])
    assert math.isnan(got[1])


def test_rank_errors():
    for bad in ({}, {"$sum": [], "$mul": []}, {"$bogus": 1}, {"$sub": {"left": {"$val": 1}}}, {"$sum": 3}, {"$val": "x"}, {"$knn": {"query": "text"}}, {"$knn": {}}):
        with pytest.raises(Unprocessable):
            parse_rank(bad)
    with pytest.raises(InvalidArgument, match="ascending"):
        parse_rank({"$knn": {"query": {"indices": [2, 1], "values": [1, 1]}}})
    assert sort_keys(["n", "#score", "a", "#document", "n"]) == ("#document", "#score", "a", "n")


def test_search_payloads(spark):
    rows = [(1, "a", [1.0, 0.0], "x", 1), (2, "b", [0.0, 1.0], "y", 2), (3, "c", [0.6, 0.8], "x", 3), (4, "d", [0.9, 0.1], "y", 4)]
    df = spark.createDataFrame(rows, "rowid long, id string, embedding array<float>, g string, n long").selectExpr("*", "id as document")
    c = Collection(df, "cosine", 2)
    got = c.search({"filter": {"$or": [{"g": "x"}, {"n": {"$gte": 4}}]}, "rank": dense([1, 0]), "limit": {"limit": 2}, "select": {"keys": ["n", "#score", "#document"]}})
    assert got.columns == ["id", "document" if "document" in got.columns else "#document", "n", "score"]
    found = got.collect()
    assert [r.id for r in found] == ["a", "d"] and found[0].score == 0
    assert [r.id for r in c.search({"limit": {"limit": 2, "offset": 1}}).collect()] == ["b", "c"]
    assert c.search({"rank": combine("$sum", val(1), val(2))}).count() == 0
    with pytest.raises(InvalidArgument):
        c.search({"rank": dense([1, 0, 0])})


def test_fusion_groups_and_keywords(spark):
    rows = [(1, "a", [1.0, 0.0], "x", ([1, 2], [1.0, 1.0])), (2, "b", [0.0, 1.0], "y", ([2], [1.0])), (3, "c", [0.7, 0.7], "x", ([3], [1.0]))]
    df = spark.createDataFrame(rows, "rowid long, id string, embedding array<float>, g string, sparse struct<indices:array<bigint>,values:array<float>>").selectExpr("*", "id as document")
    c = Collection(df, "cosine", 2, {"s": postings(df)}, ["s"])
    keyword = {"indices": [1], "values": [1.0]}
    assert [r.id for r in c.search({"rank": rrf([dense([1, 0], return_rank=True), sparse(keyword, "s", return_rank=True)])}).collect()] == ["a"]
    grouped = {"rank": dense([1, 0]), "group_by": {"keys": ["g"], "aggregate": {"$min_k": {"keys": ["#score"], "k": 1}}}}
    assert [r.id for r in c.search(grouped).collect()] == ["a", "b"]
    assert [r.id for r in c.search({"rank": sparse({"indices": [2], "values": [1.0]}, "s")}).collect()] == ["a", "b"]
    assert [r.id for r in c.search({"filter": {"g": "y"}, "rank": sparse({"indices": [2], "values": [1.0]}, "s")}).collect()] == ["b"]
    for bad in ({"keys": ["g"]}, {"aggregate": {"$min_k": {"keys": ["#score"], "k": 1}}}, {"keys": ["#score"], "aggregate": {"$min_k": {"keys": ["g"], "k": 1}}},
                {"keys": ["g"], "aggregate": {"$min_k": {"keys": [], "k": 1}}}, {"keys": ["g"], "aggregate": {"$min_k": {"keys": ["g"], "k": 0}}}):
        with pytest.raises(Validation):
            parse_group_by(bad)
    with pytest.raises(Validation, match="requires rank"):
        parse_payload({"group_by": grouped["group_by"]})


def test_hashes_of_many_strings():
    texts = ["", "a", "foobar", "é", "a" * 70, "b", "foobar"]
    for bits, start, prime in ((32, 0x811C9DC5, 0x01000193), (64, 0xCBF29CE484222325, 0x100000001B3)):
        want = []
        for t in texts:
            h = start
            for byte in t.encode():
                h = ((h ^ byte) * prime) % 2**bits
            want.append(h)
        assert fnv(texts, bits).tolist() == want and fnv([], bits).tolist() == []


def test_numbers_of_both_kinds_tie(spark):
    from orrery.functions.values import METADATA, parse_metadata
    from orrery.operators.grouping import GroupBy, best_of_groups

    values = [(1, '{"n": 1}', 0.5), (2, '{"n": 1.0}', 0.4), (3, '{"n": 2}', 0.1), (4, '{"n": true}', 0.9), (5, "{}", 0.9)]
    rows = [(i, parse_metadata(m), s) for i, m, s in values]
    df = spark.createDataFrame(rows, f"rowid long, metadata {METADATA}, score float").selectExpr("rowid", "score", "'g' g", "try_element_at(metadata, 'n') n")
    got = [r.rowid for r in best_of_groups(df, GroupBy(("g",), "$min_k", ("n",), 3)).collect()]
    assert sorted(got) == [2, 4, 5]  # missing, boolean, then the better score of the two ones


def test_responses_of_several_searches(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0], "x", 1), (2, "b", [0.0, 1.0], "y", 2)], "rowid long, id string, embedding array<float>, g string, n long").selectExpr("*", "id as document")
    c = Collection(df, "l2", 2)
    got = {r.search: r for r in c.respond([{"rank": dense([0, 1]), "select": {"keys": ["#score", "#document", "g"]}}, {"limit": {"limit": 1}}, {"filter": {"g": "none"}, "select": {"keys": ["#metadata"]}}]).collect()}
    assert got[0].ids == ["b", "a"] and got[0].scores == [0, 2] and got[0].documents == ["b", "a"] and got[0].metadatas == ['{"g":"y"}', '{"g":"x"}'] and got[0].embeddings is None
    assert got[1].ids == ["a"] and (got[1].scores, got[1].documents, got[1].metadatas) == (None, None, None)
    assert got[2].ids == [] and got[2].metadatas == []


def test_encoders():
    assert split_words("Ab_c 12é") == ["ab", "c", "12é"]
    doc = encode_document("the shard shard vector")
    at = doc["tokens"].index("shard")
    norm = 1.2 * (0.25 + 0.75 * 3 / 256)
    assert abs(doc["values"][at] - 2 * 2.2 / (2 + norm)) < 1e-6 and doc["indices"] == sorted(doc["indices"])
    assert encode_query("the shard SHARD")["values"] == [1.0] and term_dimensions(["a"]).tolist() == [0xE40C292C & 0x7FFFFFFF]
    e = embed("", 8)
    assert e[0] == 1 and abs(np.linalg.norm(embed("green field", 64)) - 1) < 1e-6
    near, far = (float(embed("green fields of grass", 256) @ embed(t, 256)) for t in ("a green field", "stock market news"))
    assert near > far


def test_configured_embedder(spark):
    df = spark.createDataFrame([("green field",), (None,)], "t string")
    rows = [r.v for r in df.select(embedder({"dimension": 16})("t").alias("v")).collect()]
    assert np.allclose(rows[0], embed("green field", 16)) and rows[1][0] == 1 and len(df.select(embedder()("t").alias("v")).first().v) == 384
    with pytest.raises(InvalidArgument):
        embedder({"type": "other"})


def test_base64(spark):
    assert parse_vector("AACAPgAAQD8AAAAA") == [0.25, 0.75, 0.0]
    df = spark.createDataFrame([([0.25, 0.75, 0.0],), (None,)], "v array<float>")
    got = df.select(encode_base64("v").alias("t"), "v").select("t", decode_base64("t").alias("w"), "v").collect()
    assert got[0].t == "AACAPgAAQD8AAAAA" and got[0].w == got[0].v and got[1].t is None and got[1].w is None
    for bad in ("AAA", [1, "x"], [True]):
        with pytest.raises(InvalidArgument):
            parse_vector(bad)


def test_metrics_and_keywords(spark):
    ranked_rows = [("q1", "x", 1), ("q1", "d1", 2), ("q1", "y", 3), ("q2", "a", 1), ("q2", "b", 2), ("q2", "c", 3), ("q3", "a", 1)]
    r = spark.createDataFrame(ranked_rows, "query_id string, doc_id string, place int")
    rel = spark.createDataFrame([("q1", "d1"), ("q2", "d2"), ("q1", "d1")], "query_id string, doc_id string")
    m = retrieval_metrics(r, rel, 3).first()
    assert (m.precision, m.recall, m.map, m.ndcg) == (0.16667, 0.5, 0.25, 0.31546)
    assert retrieval_metrics(r, rel, 1).first().precision == 0
    d = spark.createDataFrame([(1, "shard index shard the vector index shard ab"), (2, None)], "doc_id long, text string")
    assert [tuple(x) for x in keywords(d).collect()] == [(1, "shard index vector")]
