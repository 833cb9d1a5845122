import json

import pytest

from orrery.errors import InvalidArgument
from orrery.functions.regex import java_pattern
from orrery.functions.values import METADATA
from orrery.operators.filters import ColumnBinding, MapBinding, parse, where

ROWS = [
    ("a", "The quick brown fox", 1, 1.5, "x", True, ["p", "q"], [1.0, 2.0]),
    ("b", "lazy dog 50% off", 2, 2.0, "y", False, ["q"], None),
    ("c", "Under_score and API docs", 3, None, "x", None, None, [3.5]),
    ("d", None, None, None, None, None, None, None),
    ("e", "line one\nline two", -1, 0.0, None, True, None, None),
]
SCHEMA = "id string, document string, i bigint, f double, s string, b boolean, arr array<string>, nums array<double>"
CASES = [
    ({"i": 1}, "a"), ({"i": {"$ne": 1}}, "bcde"), ({"missing": {"$ne": 1}}, "abcde"), ({"missing": {"$eq": 1}}, ""), ({"f": 2}, "b"), ({"i": 2.0}, "b"),
    ({"i": {"$gt": 1}}, "bc"), ({"i": {"$gte": 2}}, "bc"), ({"f": {"$lt": 2}}, "ae"), ({"f": {"$lte": 2}}, "abe"), ({"i": {"$in": [1, 3]}}, "ac"),
    ({"i": {"$in": [1.0, 3]}}, "ac"), ({"i": {"$nin": [1, 3]}}, "bde"), ({"s": {"$in": ["x"]}}, "ac"), ({"s": {"$nin": ["x"]}}, "bde"), ({"b": True}, "ae"),
    ({"b": {"$ne": True}}, "bcd"), ({"b": 1}, ""), ({"b": {"$in": [False]}}, "b"), ({"arr": {"$contains": "q"}}, "ab"), ({"arr": {"$not_contains": "p"}}, "bcde"),
    ({"nums": {"$contains": 1}}, "a"), ({"s": {"$contains": "x"}}, ""), ({"arr": "q"}, ""), ({"$and": [{"s": "x"}, {"i": {"$gt": 1}}]}, "c"),
    ({"$or": [{"s": "y"}, {"i": {"$lt": 0}}]}, "be"), ({"$and": []}, "abcde"), ({"$or": []}, ""), ({"#document": {"$contains": "lazy"}}, "b"),
    ({"i": {"$gte": 2.5}}, "c"), ({"i": {"$lt": 1e300}}, "abce"), ({"#id": {"$in": ["a", "e"]}}, "ae"), ({"#id": {"$gt": 1}}, ""), ({"#document": "x"}, ""),
]
DOCUMENTS = [
    ({"$contains": "quick"}, "a"), ({"$contains": "QUICK"}, ""), ({"$contains": "50%"}, "b"), ({"$contains": "_"}, "c"), ({"$not_contains": "dog"}, "acde"),
    ({"$regex": "^The"}, "a"), ({"$regex": r"\bAPI\b"}, "c"), ({"$regex": "(?i)QUICK"}, "a"), ({"$regex": "[0-9]+%"}, "b"), ({"$regex": "(?m)^line two$"}, "e"),
    ({"$not_regex": "o"}, "d"), ({"$and": [{"$contains": "o"}, {"$not_contains": "quick"}]}, "bce"), ({"$or": [{"$contains": "fox"}, {"$regex": "docs$"}]}, "ac"),
]


@pytest.fixture(scope="module")
def frames(spark):
    flat = spark.createDataFrame(ROWS, SCHEMA)
    from orrery.functions.values import parse_metadata

    typed = [(r[0], r[1], parse_metadata(json.dumps({k: v for k, v in zip(("i", "f", "s", "b", "arr", "nums"), r[2:], strict=True) if v is not None}))) for r in ROWS]
    return flat, spark.createDataFrame(typed, f"id string, document string, metadata {METADATA}")


def ids(df):
    return "".join(sorted(r.id for r in df.select("id").collect()))


def test_every_clause_in_both_bindings(frames):
    flat, typed = frames
    for clause, want in CASES:
        assert ids(where(flat, clause, None, ColumnBinding(flat))) == want, clause
        assert ids(where(typed, json.dumps(clause), None, MapBinding())) == want, clause
    for clause, want in DOCUMENTS:
        assert ids(where(flat, None, clause, ColumnBinding(flat))) == want, clause
    assert ids(where(flat, {"s": "x"}, {"$contains": "API"}, ColumnBinding(flat))) == "c"


def test_large_integers_compare_exactly(spark):
    big = 2**53
    df = spark.createDataFrame([("a", big + 1, float(big)), ("b", big, float(big + 2))], "id string, i bigint, f double").selectExpr("*", "'x' document")
    assert ids(where(df, {"i": float(big)})) == "b" and ids(where(df, {"f": big + 1})) == ""
    assert ids(where(df, {"f": {"$gt": big + 1}})) == "b" and ids(where(df, {"f": {"$lt": big + 1}})) == "a"


def test_rejected_clauses():
    for bad in ({"year": {}}, {"lang": None}, {"year": {"$gte": "2000"}}, {"tags": {"$in": []}}, {"year": {"$nin": [2001, "old"]}}, {"rating": {"$in": [4, 4.5]}}, {"lang": {"$near": "en"}},
                {"year": {"$gt": 1, "$lt": 9}}, {"lang": ["en", "de"]}, {"lang": "en", "year": 2000}, {"$not": [{"lang": "en"}]}, {"#document": {"$regex": 7}}, {"year": 2**70}, {}):
        with pytest.raises(InvalidArgument, match="Invalid where clause"):
            parse(bad)
    for bad in ({"$contains": None}, {"$starts": "x"}, {"$regex": "a", "$not_regex": "b"}, {}):
        with pytest.raises(InvalidArgument, match="Invalid where document clause"):
            parse(None, bad)
    for bad in ("shard)", "(shard", "[z-q]", "(?<=the )end", r"(x)\1", "+1", "y{2,1}", "w{1001}", "(?P<a b>c)", "[["):
        with pytest.raises(InvalidArgument, match="Regex syntax errror"):
            java_pattern(bad)
    assert parse({"$or": []}) is not None and parse(None, None) is None


def test_a_records_own_fields_are_no_metadata(spark):
    df = spark.createDataFrame([("a", "x", 1, "u", 5, 2000)], "id string, document string, rowid long, uri string, seq long, year long")
    assert where(df, {"seq": {"$gte": 0}}).count() == 0 and where(df, {"year": {"$gte": 0}}).count() == 1
    assert set(ColumnBinding(df).keys) == {"year"}


def test_patterns_mean_what_they_mean_in_re2(spark):
    import duckdb

    patterns = [
        "o$", r"\bof\b", "index|shard", "(?i)TEXT", r"[\d.]+%", "l{2}", r"\$\d", "(?s)e.f", "[^\\W_]é", "gr[ae]y?", "(?i)straße", r"\p{Lu}\d", r"[[:digit:]]{3}", r"\Qx|y\E", r"\x41\x42",
        "(?m)^second$", r"\Bard", "(?:ab)+?$", r"[\w-]+@", "(?U)e+f", "(?i:q)Z", r"\pN", r"^\s", r"\z", "",
    ]
    texts = ["end of it", "shards", "Text", "12.5% off", "all", "$5", "$x", "e\nf", "café", "grey gr", "STRASSE straße", "Q7", "a123", "x|y", "AB", "first\nsecond", "first\nsecond\n", "ard", "abab", "a-b@c", "eef", "qZ", "½", " x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        got = [r[0] for r in df.filter(df.t.rlike(java_pattern(p))).collect()]
        want = [t for t in texts if duckdb.execute("select regexp_matches(?, ?)", [t, p]).fetchall()[0][0]]
        assert got == want, p
