import random
import re

import numpy as np
import pytest

from orrery.llm.split import cut_kinds, cuts, reachable, split_texts


def walk(successor, first):
    seen = set()
    for f in first:
        while f not in seen:
            seen.add(f)
            f = successor[f]
    return seen


def test_doubling_visits_what_walking_visits():
    rnd = random.Random(1)
    for _ in range(50):
        n = rnd.randrange(1, 60)
        successor = np.array([rnd.randrange(i, n) for i in range(n)])
        first = np.array([rnd.randrange(n)])
        assert set(np.flatnonzero(reachable(successor, first))) == walk(successor, first)


def pieces(texts, limit, overlap):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw]).astype(np.int64)
    n = len(texts)
    t, a, b, k = cuts(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, np.full(n, limit), np.full(n, overlap))
    return [[(x - offsets[i], y - offsets[i], z) for j, x, y, z in zip(t, a, b, k, strict=True) if j == i] for i in range(n)]


@pytest.mark.parametrize("limit,overlap", [(9, 0), (20, 6), (40, 15), (40, 35), (64, 0), (8, 3)])
def test_pieces_of_random_texts(limit, overlap):
    rnd = random.Random(limit + overlap)
    parts = ["a", "bc", "é", "語", "。", " ", "  ", "\n\n", ". ", "! ", "\r\n", "😀", "word", "longer-word", "x" * 30, "ö" * 25]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 120))) for _ in range(80)]
    texts = [t for t in texts if len(t.encode()) > limit]
    for text, found in zip(texts, pieces(texts, limit, overlap), strict=True):
        raw = text.encode()
        assert found[0][0] == 0 and found[-1][1] == len(raw)
        for a, b, _ in found:
            assert 0 < b - a <= limit
            raw[a:b].decode()
        for (a, b, _), (c, d, _) in zip(found, found[1:], strict=False):
            assert a < c <= b < d and b - c <= overlap
        forced = max(len(s.encode()) for s in re.split("[ \t\n\r。]", text)) > limit
        assert forced == any(k == 4 for *_, k in found)


def test_prefers_paragraphs_then_sentences():
    text = "One two three. Four five six.\n\nSeven eight. Nine ten eleven twelve thirteen"
    found = pieces([text], 40, 0)[0]
    assert [text[a:b] for a, b, _ in found][0] == "One two three. Four five six.\n\n"
    assert pieces(["aaa bbb. ccc ddd eee fff"], 12, 0)[0][0][1] == 9


def test_edge_cases_in_spark(spark):
    rows = [(1, "a", None, "x"), (2, "a", "", "x"), (3, "a", "word " * 4000, "x"), (4, "b", "word " * 50, "x"), (5, None, "word " * 50, "x"),
            (6, "a", "y" * 500, "x"), (3, "a", "word " * 4000, "x"), (7, "a", "é" * 16, "x")]
    r = spark.createDataFrame(rows, "rowid long, collection_id string, document string, chunk_limit string").drop("chunk_limit")
    c = spark.createDataFrame([("a", 32, 8, 1), ("b", None, None, 1)], "collection_id string, chunk_limit int, chunk_overlap int, rowid long")
    assert {tuple(x) for x in cut_kinds(r, c).collect()} == {(3, "natural"), (6, "forced")}
    assert cut_kinds(r.limit(0), c).count() == 0 and cut_kinds(r, c.limit(0)).count() == 0
    got = split_texts(r, "document", 32, 0, ["rowid"]).filter("rowid = 6").orderBy("start").collect()
    assert "".join(g.piece for g in got) == "y" * 500
