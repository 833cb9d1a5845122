import random

from orrery.llm import mixture as module
from orrery.llm.mixture import Mixture, short_sources

TARGETS = "source string, weight double, max_repeats int, text string"


def test_goals_are_met_within_a_document(spark):
    rnd = random.Random(1)
    docs = []
    for i in range(1500):
        source = rnd.choice(["a", " A ", "a", "b", "c", None, "unlisted", "d"])
        docs.append((i, source, rnd.choice([None, "", "w " * 7, "w " * rnd.randrange(1, 60)]), "x"))
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, size string")
    targets = spark.createDataFrame(
        [("a", 0.2, 3, "x"), ("b", 0.35, 4, "x"), ("c", 0.3, 2, "x"), ("d", 0.05, 1, "x"), ("absent", 0.1, 2, "x"), (None, 0.5, 1, "x"), ("e", None, 1, "x")], TARGETS)
    n = {}
    for _, s, t, _ in docs:
        n[s.strip().lower() if s else None] = n.get(s.strip().lower() if s else None, 0) + len((t or "").split())
    total = sum(n.values())
    mixture = Mixture(df, targets)
    rows = {r.source: r for r in mixture.report().collect()}
    assert set(rows) == {"a", "b", "c", "d", "absent"}
    short = set()
    for s, w, r in (("a", 0.2, 3), ("b", 0.35, 4), ("c", 0.3, 2), ("d", 0.05, 1), ("absent", 0.1, 2)):
        goal = min(w * total, r * n.get(s, 0))
        assert abs(rows[s].reached - goal) <= 70, (s, rows[s], goal)
        assert rows[s].most_copies <= r
        if r * n.get(s, 0) < w * total:
            short.add(s)
    assert "absent" in short and "a" not in short
    assert {r.source for r in short_sources(df, targets).collect()} == short
    copies = mixture.copies().collect()
    assert len({c.doc_id for c in copies}) == len(copies) and all(c.size > 0 for c in copies)
    assert {c.source for c in copies} <= {"a", "b", "c", "d"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 2, "x")], TARGETS)
    assert Mixture(docs, targets).copies().count() == 0
    assert [r.reached for r in Mixture(docs, targets).report().collect()] == [0]
    assert short_sources(docs, targets.limit(0)).count() == 0


def test_one_hot_size_and_tokens_of_a_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(module, "LOT_ROWS", 100)
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "same words here") for i in range(2000)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.75, 2, "x"), ("b", 0.25, 2, "x")], TARGETS)
    rows = {r.source: r for r in Mixture(docs, targets, "/opt/tokenizers/byte_bpe_50k.tiktoken").report().collect()}
    assert abs(rows["a"].share - 0.75) < 0.002 and abs(rows["b"].share - 0.25) < 0.002
