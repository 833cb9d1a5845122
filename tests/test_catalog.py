import json

import pytest
from pyspark.sql import functions as F

from orrery.errors import AlreadyExists, InvalidArgument, NotFound, Unprocessable, Validation
from orrery.functions.values import METADATA, METADATA_TYPE, encode_value, parse_metadata, parse_value
from orrery.operators import records as log
from orrery.plans import schema as schemas
from orrery.plans.catalog import Catalog, batch_of
from orrery.sources.files import corpus_object, movies_csv, movies_jsonl, text_lines
from orrery.streaming.sink import write_stream


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/store")


def batch(spark, *rows):
    made = [(i, r[0], None if r[1] is None else [float(x) for x in r[1]], r[2] if len(r) > 2 else None, r[4] if len(r) > 4 else None, parse_metadata(json.dumps(r[3]), True) if len(r) > 3 and r[3] is not None else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, f"ord long, id string, embedding array<float>, document string, uri string, metadata {METADATA}")


def plain(records):
    out = {}
    for r in records.collect():
        meta = None if r.metadata is None else {k: json.loads(encode_value(v.asDict(True))) for k, v in r.metadata.items()}
        out[r.id] = (r.embedding, r.document, r.uri, meta)
    return out


def test_values():
    for text, kind in (("true", 1), ("3", 2), ("3.0", 3), ("1e2", 3), ("-2.5", 3), ("9223372036854775808", 3), ('"x"', 4), ("[1,2]", 7), ("[1,2.5]", 8), ('["a","b"]', 9), ("[true,false]", 6), ("[]", 6), ('{"indices":[1,3],"values":[0.5,1]}', 5)):
        assert parse_value(json.loads(text))["kind"] == kind, text
    assert encode_value(parse_value(3.0)) == "3.0" and encode_value(parse_value(3)) == "3" and encode_value(parse_value([1, 2.5])) == "[1.0,2.5]"
    for bad in ("null", "[1,\"x\"]", "[null]", "[[1]]", '{"a":1}', '{"indices":[2,1],"values":[1,1]}', '{"indices":[1],"values":[1,2]}'):
        with pytest.raises(InvalidArgument):
            parse_value(json.loads(bad))
    with pytest.raises(InvalidArgument):
        parse_metadata('{"#a": 1}')
    assert parse_metadata('{"a": null}', True) == {"a": None} and METADATA_TYPE.simpleString() == METADATA


def test_record_log(spark, catalog):
    c = catalog.create_collection("records", configuration={"hnsw": {"space": "cosine"}})
    c.write("add", batch(spark, ("a", [1.0, 0, 0], "hello world", {"k": 1, "tags": ["x", "y"], "f": 3.0}), ("b", [0, 1.0, 0], "Foo bar", {"k": 2.5, "s": "str", "flag": True}), ("c", [0.6, 0.8, 0],)))
    c.write("add", batch(spark, ("a", [9.0, 9, 9], "no")))
    c.write("add", batch(spark, ("d", [1.0, 0, 0]), ("d", [0, 0, 1.0])))
    with pytest.raises(InvalidArgument):
        c.write("add", batch(spark, ("e", [1.0, 0])))
    with pytest.raises(InvalidArgument, match="Empty ID"):
        c.write("add", batch(spark, ("", [1.0, 0, 0])))
    with pytest.raises(Validation, match="Invalid metadata at index 1"):
        c.write("upsert", batch(spark, ("e", [1.0, 0, 0]), ("g", [1.0, 0, 0])).withColumn("metadata", F.expr("case when ord = 1 then map('#x', cast(null as " + METADATA[METADATA.index("struct"):-1] + ")) end")))
    with pytest.raises(Unprocessable):
        c.write("add", batch(spark, ("e", [1.0, 0, 0], None, {"k": None})))
    with pytest.raises(InvalidArgument, match="exceeds"):
        c.write("add", batch(spark, ("e", [1.0, 0, 0]), ("f", [1.0, 0, 0])), most=1)
    with pytest.raises(InvalidArgument):
        c.write("add", batch(spark, ("e", None)))
    c.write("update", batch(spark, ("zzz", None, "x"), ("a", None, None, {"k": 10, "f": None, "z": "new"}), ("c", None, None, {"only": 1})))
    c.write("upsert", batch(spark, ("b", [0, 2.0, 0], None, {"w": 1}), ("n1", [0, 0, 3.0], "new doc", {"new": True})))
    got = plain(c.records())
    assert got["a"] == ([1, 0, 0], "hello world", None, {"k": 10, "tags": ["x", "y"], "z": "new"})
    assert got["b"] == ([0, 2, 0], "Foo bar", None, {"k": 2.5, "s": "str", "flag": True, "w": 1})
    assert got["c"][3] == {"only": 1} and got["d"][0] == [1, 0, 0] and got["n1"][1] == "new doc"
    assert [r.id for r in c.get().collect()] == ["a", "b", "c", "d", "n1"]
    assert [r.id for r in c.get(ids=["c", "a", "zz"]).collect()] == ["a", "c"] and [r.id for r in c.get(limit=2, offset=1).collect()] == ["b", "c"]
    assert [r.id for r in c.query([1, 0, 0], 10, where={"k": {"$gte": 2}}).collect()] == ["a", "b"]
    assert c.delete(where={"k": 2.5}) == 1 and c.delete() == 0 and c.delete(ids=["n1", "nope"]) == 2
    assert [r.id for r in c.get().collect()] == ["a", "c", "d"]
    c.write("add", batch(spark, ("late", [1.0, 1, 1])))
    rowids = {r.id: r.rowid for r in c.records().collect()}
    assert rowids["late"] > 5  # numbers are not used again
    assert c.info["schema"]["keys"]["k"].keys() == {"int", "float"} and c.indexing_status()["op_indexing_progress"] == 1.0


def test_requests_of_parallel_lists(spark, catalog):
    c = catalog.create_collection("requests")
    made = batch_of(spark, ["a", "b"], ["AACAPgAAQD8AAAAA", [1, 2, 3]], ["one", None], None, [{"k": 1, "f": 1.0}, '{"t": ["x"]}'])
    assert c.write("add", made) == 2
    assert plain(c.records()) == {"a": ([0.25, 0.75, 0], "one", None, {"k": 1, "f": 1.0}), "b": ([1, 2, 3], None, None, {"t": ["x"]})}
    assert c.write("update", batch_of(spark, ["a"], metadatas=[{"k": None}], update=True)) == 1
    assert plain(c.records())["a"][3] == {"f": 1.0}
    with pytest.raises(InvalidArgument, match="Inconsistent number"):
        batch_of(spark, ["a", "b"], [[1.0]])
    with pytest.raises(InvalidArgument):
        batch_of(spark, ["a"], [[1.0]], metadatas=[{"k": None}])


def test_merging_in_one_batch(spark):
    state = spark.createDataFrame([(1, "a", [1.0, 0.0], None, "u1", {"x": "1", "y": "keep"}, 1), (2, "b", [0.0, 1.0], None, None, {"only": "1"}, 1)],
                                  "rowid long, id string, embedding array<float>, document string, uri string, metadata map<string,string>, seq long")
    kind = "ord long, id string, embedding array<float>, document string, uri string, metadata map<string,string>"
    up = spark.createDataFrame([(0, "a", [1.0, 1.0], None, None, {"x": "2"}), (1, "a", [2.0, 2.0], None, None, {"y": None}), (2, "z", [3.0, 3.0], None, None, {"z": "1", "q": None})], kind)
    state = log.upsert(state, up, 5)
    state = log.update(state, spark.createDataFrame([(0, "b", None, None, None, {"only": None}), (1, "a", None, None, "u2", None)], kind), 6)
    got = {r.id: (r.rowid, r.embedding, r.uri, r.metadata, r.seq) for r in state.collect()}
    assert got == {"a": (1, [2, 2], "u2", {"x": "2"}, 6), "b": (2, [0, 1], None, None, 6), "z": (3, [3, 3], None, {"z": "1"}, 5)}
    assert log.add(state.limit(0), up, 1).count() == 2 and log.update(state.limit(0), up).count() == 0
    left, n = log.delete(state, None, state.rowid > 0, 1)
    assert n == 1 and left.count() == 2


def test_forks_and_reopening(spark, catalog):
    a = catalog.create_collection("first", configuration={"hnsw": {"space": "cosine"}})
    a.write("add", batch(spark, ("a", [1.0, 0]), ("b", [0, 1.0])))
    f = a.fork("second")
    f.write("add", batch(spark, ("c", [1.0, 1])))
    assert [r.id for r in f.query([1, 0], 3).collect()] == ["a", "c", "b"]
    assert (a.count(), f.count(), a.fork_count(), f.fork_count()) == (2, 3, 1, 1)
    again = Catalog(spark, catalog.root)
    assert again.collection("second").count() == 3 and len(again.collections()) == 2
    again.create_tenant("other")
    catalog.create_tenant("third")  # on top of what the other object wrote
    assert again.tenant("third") and catalog.tenant("other")
    with pytest.raises(AlreadyExists):
        catalog.create_tenant("other")


def test_a_fork_outlives_its_parent(spark, catalog):
    a = catalog.create_collection("parent")
    a.write("add", batch(spark, ("a", [1.0, 0]), ("b", [0, 1.0])))
    f = a.fork("child")
    f.write("upsert", batch(spark, ("b", [5.0, 5]), ("c", [1.0, 1])))
    g = f.fork("grandchild")
    catalog.delete_collection("parent")
    assert {r.id: r.embedding for r in f.get().collect()} == {"a": [1, 0], "b": [5, 5], "c": [1, 1]} and f.count() == 3
    catalog.delete_collection("child")
    assert [r.id for r in g.get().collect()] == ["a", "b", "c"]
    catalog.delete_collection("grandchild")
    assert [n for n in catalog.files.names("*") if not n.startswith("catalog")] == []


def test_two_writers(spark, catalog):
    one, two = catalog.create_collection("one"), Catalog(spark, catalog.root).create_collection("two")
    again = Catalog(spark, catalog.root).collection("one")
    one.write("add", batch(spark, ("a", [1.0])))
    two.write("add", batch(spark, ("b", [1.0, 2])))
    again.write("add", batch(spark, ("a", [3.0]), ("c", [2.0])))
    assert [r.id for r in one.get().collect()] == ["a", "c"] and (one.count(), again.count(), two.count()) == (2, 2, 1)
    # a write that is refused leaves nothing behind
    with pytest.raises(InvalidArgument):
        one.write("add", batch(spark, ("d", [1.0, 2])))
    assert one.count() == 2 == one.records().count()
    # a write made on a state that another one has replaced is made again
    lay, met = one._lay, []

    def late(rows, info, update, base=False):
        if not met:
            met.append(1)
            again.write("add", batch(spark, ("x", [9.0])))
        return lay(rows, info, update, base)

    one._lay = late
    one.write("upsert", batch(spark, ("x", [1.0]), ("y", [1.0])))
    assert {r.id: (r.rowid, r.embedding) for r in one.get().collect()}["x"] == (3, [1.0]) and one.count() == 4 == one.records().count()


def test_layers_are_merged_and_compacted(spark, catalog):
    c = catalog.create_collection("layers")
    c.write("add", batch(spark, *((f"r{i}", [float(i)]) for i in range(40))))
    c.write("upsert", batch(spark, ("r1", [100.0]), ("new", [7.0])))
    c.delete(ids=["r2", "new"])
    c.write("upsert", batch(spark, ("r1", [101.0]), ("new", [8.0])))
    assert len(c.info["layers"]) == 4
    want = {r.id: (r.rowid, r.embedding, r.seq) for r in c.records().collect()}
    assert want["r1"][1] == [101.0] and want["new"] == (42, [8.0], 44) and "r2" not in want and c.count() == len(want) == 40
    c.compact()
    assert len(c.info["layers"]) == 1 and {r.id: (r.rowid, r.embedding, r.seq) for r in c.records().collect()} == want
    c.write("upsert", batch(spark, *((f"r{i}", [0.5]) for i in range(3, 40)), *((f"n{i}", [0.5]) for i in range(9))))
    assert len(c.info["layers"]) == 1 and c.count() == c.records().count() == 49
    many = [f"r{i}" for i in range(3, 40)] + [f"none{i}" for i in range(300)]
    assert c.delete(ids=many) == len(many) and c.count() == c.records().count() == 12


def test_search_in_a_collection(spark, catalog):
    from orrery.functions.text import bm25_schema, encode_document, encode_query
    from orrery.operators.rank import dense, rrf, sparse
    from orrery.operators.search import project_metadata, shows_metadata

    c = catalog.create_collection("hybrid", schema=bm25_schema("kw") | {"keys": bm25_schema("kw")["keys"]})
    texts = {"a": "shard index shard", "b": "vector index", "c": "captain of the lighthouse"}
    c.write("add", batch(spark, *((i, [float(n), 1.0], t, {"kw": {k: v for k, v in encode_document(t).items()}, "g": n % 2, "n": n}) for n, (i, t) in enumerate(texts.items()))))
    found = c.search({"rank": sparse(encode_query("index shard"), "kw"), "select": {"keys": ["#document", "n", "#score", "#metadata"]}}).collect()
    assert [r.id for r in found] == ["a", "b"] and found[0]["n"].i == 0 and found[0]["#metadata"]["n"].i == 0
    both = rrf([dense([2, 1], return_rank=True, default=9), sparse(encode_query("lighthouse"), "kw", return_rank=True, default=9)])
    assert [r.id for r in c.search({"rank": both, "limit": {"limit": 1}}).collect()] == ["c"]
    grouped = {"rank": dense([0, 1]), "group_by": {"keys": ["g"], "aggregate": {"$max_k": {"keys": ["n"], "k": 1}}}}
    assert [r.id for r in c.search(grouped).collect()] == ["b", "c"]
    assert [r.id for r in c.search({"filter": {"n": {"$gt": 0}}, "rank": dense([0, 1])}).collect()] == ["b", "c"]
    assert shows_metadata(["#score", "#id"]) and not shows_metadata(["#document"]) and shows_metadata(["#metadata", "#score"])
    got = c.get(["a"]).selectExpr("*").select(*(project_metadata(F.col("metadata"), [k]).alias(n) for k, n in (("n", "m"), ("x", "none")))).first()
    assert set(got.m) == {"n"} and got.none is None


def test_catalog(catalog):
    catalog.create_tenant("acme")
    catalog.update_tenant("acme", "res")
    catalog.create_database("db1", "acme")
    c = catalog.create_collection("one", {"a": 1}, database="db1", tenant="acme")
    assert catalog.create_collection("one", {"a": 2}, get_or_create=True, database="db1", tenant="acme").info["metadata"] == {"a": 1}
    assert catalog.collection_by_crn("res:db1:one").id == c.id == catalog.collection_by_id(c.id).id
    c.modify(name="renamed", metadata={"b": 1}, configuration={"hnsw": {"ef_search": 7, "space": "ip"}})
    assert c.configuration["hnsw"]["ef_search"] == 7 and c.space == "l2"
    for error, call in ((AlreadyExists, lambda: catalog.create_tenant("acme")), (Validation, lambda: catalog.create_tenant("ab")), (NotFound, lambda: catalog.collection("one")),
                        (AlreadyExists, lambda: catalog.create_database("db1", "acme")), (Validation, lambda: catalog.create_collection("a..b")), (Validation, lambda: catalog.create_collection("192.168.0.1")),
                        (NotFound, lambda: catalog.database("none")), (InvalidArgument, lambda: catalog.create_collection("empty", {}))):
        with pytest.raises(error):
            call()
    assert [d["name"] for d in catalog.databases("acme")] == ["db1"] and catalog.count_collections("db1", "acme") == 1
    catalog.delete_database("db1", "acme")
    with pytest.raises(NotFound):
        catalog.collection_by_id(c.id)


def test_schemas(spark, catalog):
    legacy = schemas.reconcile(None, None, {"hnsw:space": "cosine"})
    assert schemas.configuration_of(legacy) == {"hnsw": {"space": "cosine", "ef_construction": 100, "ef_search": 100, "max_neighbors": 16, "resize_factor": 1.2, "sync_threshold": 1000}, "spann": None, "embedding_function": None}
    assert schemas.configuration_of(schemas.reconcile(None, {"spann": {"space": "cosine"}}))["hnsw"]["space"] == "cosine"
    for bad in ({"hnsw": {}, "spann": {}},):
        with pytest.raises(InvalidArgument, match="Multiple vector index"):
            schemas.from_configuration(bad)
    with pytest.raises(InvalidArgument, match="Failed to parse hnsw parameters"):
        schemas.from_configuration(None, {"hnsw:bogus": 1})
    with pytest.raises(InvalidArgument, match="^Expected a name containing"):
        schemas.check_database("a")
    own = {"keys": {"k": {"int": {"int_inverted_index": {"enabled": False, "config": {}}}}, "#document": {"string": {"fts_index": {"enabled": False, "config": {}}}}}}
    with pytest.raises(InvalidArgument, match="simultaneously"):
        schemas.reconcile(own, {"hnsw": {"space": "ip"}})
    with pytest.raises(Validation, match="reserved"):
        schemas.validate_schema({"keys": {"#other": {}}})
    with pytest.raises(Validation, match="Vector index cannot"):
        schemas.validate_schema({"defaults": {"float_list": {"vector_index": {"enabled": True}}}})
    assert schemas.index_plan(3000, schemas.default_hnsw())["type"] == "halfvec" and schemas.index_plan(5000, schemas.default_hnsw()) is None
    c = catalog.create_collection("disabled", schema=own)
    c.write("add", batch(spark, ("a", [1.0], "doc", {"k": 1, "s": "x"})))
    assert [r.id for r in c.get(where={"s": "x"}).collect()] == ["a"]
    for call in (lambda: c.get(where={"k": 1}), lambda: c.get(where_document={"$contains": "doc"}), lambda: c.delete(where={"k": {"$gt": 0}})):
        with pytest.raises(InvalidArgument, match="disabled"):
            call()


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text('adult,budget,id,original_language,overview,release_date,title\nFalse,10,1,en,"A ""b"",\nc",2001-05-01,T\nFalse,x,2,en,,1999-01-01,U\nFalse,x,3,fr,O,,V\nTrue,5,4,de,Short,2002-02-02\nTrue,5,5,de,Over,2003-03-03,W,more,fields\nTrue,6,6,it,Cut\n')
    assert [(r.id, r.year, r.budget, r.overview) for r in movies_csv(spark, str(tmp_path / "m.csv")).collect()] == [("1", 2001, 10, 'A "b",\nc'), ("3", None, None, "O"), ("5", 2003, 5, "Over")]
    (tmp_path / "late.csv").write_text("title,overview,id,budget,release_date\nA,B,1,2,1990-01-01\nShort,Row,2\n")
    assert [(r.id, r.title, r.budget, r.year) for r in movies_csv(spark, str(tmp_path / "late.csv")).collect()] == [("1", "A", 2, 1990), ("2", "Short", None, None)]
    (tmp_path / "m.jsonl").write_text('{"title":"T","year":2000,"genres":["a"],"budget":null}\n')
    assert movies_jsonl(spark, str(tmp_path / "m.jsonl")).first().genres == ["a"]
    (tmp_path / "c.json").write_text('{"b": "two",\n "a": "one"}')
    assert [tuple(r) for r in corpus_object(spark, str(tmp_path / "c.json")).collect()] == [("a", "one"), ("b", "two")]
    (tmp_path / "t+1 é.txt").write_text("one\n\n  two \r\n")
    assert [tuple(r) for r in text_lines(spark, str(tmp_path / "t+1 é.txt")).collect()] == [("one", "t+1 é.txt", 1), ("two", "t+1 é.txt", 3)]


def test_stream_is_applied_once(spark, catalog, tmp_path):
    c = catalog.create_collection("stream")
    batch(spark, ("a", [1.0, 2.0], "x", {"k": 1})).write.parquet(f"{tmp_path}/in/1")
    schema = batch(spark, ("a", [1.0, 2.0])).schema
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    write_stream(stream(), c, f"{tmp_path}/cp").awaitTermination(120)
    batch(spark, ("b", [1.0, 3.0]), ("a", [2.0, 2.0])).write.parquet(f"{tmp_path}/in/2")
    write_stream(stream(), c, f"{tmp_path}/cp").awaitTermination(120)
    assert {r.id: r.embedding for r in c.records().collect()} == {"a": [2, 2], "b": [1, 3]}
    assert list(c.info["streams"].values()) == [1]
    # another stream, whose numbers begin anew, on the same collection
    batch(spark, ("z", [4.0, 4.0])).write.parquet(f"{tmp_path}/other/1")
    write_stream(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/other"), c, f"{tmp_path}/cp2").awaitTermination(120)
    assert c.count() == 3 and len(c.info["streams"]) == 2
    # a batch whose write failed is applied when it comes again; one that was applied is not
    with pytest.raises(InvalidArgument):
        c.write("upsert", batch(spark, ("q", [1.0])), stream=("s", 0))
    assert c.write("upsert", batch(spark, ("q", [1.0, 1.0])), stream=("s", 0)) == 1 and c.write("upsert", batch(spark, ("q", [2.0, 2.0])), stream=("s", 0)) == 0
    assert c.count() == 4
