import random

import numpy as np
from pyspark.sql import functions as F

from orrery.llm.leaks import Items, held_out, leaks, myers, search
from orrery.llm.terms import terms


def substring_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = np.random.default_rng(1)
    p, t = rng.integers(1, 4, (300, 9)), rng.integers(-1, 4, (300, 15))
    want = [substring_distance(a, [x if x >= 0 else None for x in b]) for a, b in zip(p.tolist(), t.tolist(), strict=True)]
    assert myers(p, t).tolist() == want


def brute(docs, items, window, edits):
    out = {}
    for d, text in docs:
        for i, passage in items:
            if text is None or passage is None:
                continue
            a, b = terms(text), terms(passage)
            e = min((substring_distance(b[s : s + window], a) for s in range(len(b) - window + 1)), default=99)
            if e <= edits:
                run = max((n for n in range(window, len(b) + 1) for s in range(len(b) - n + 1) if any(a[x : x + n] == b[s : s + n] for x in range(len(a)))), default=0)
                old = out.get((d, i), (99, 0))
                out[d, i] = (min(old[0], e), max(old[1], run))
    return out


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    passages = [(i // 2, " ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 16)))) for i in range(24)] + [(50, None), (51, "")]
    docs = [(900, None), (901, "")]
    for d in range(120):
        w = [rnd.choice(words) for _ in range(rnd.randrange(0, 30))]
        if rnd.random() < 0.7:
            p = rnd.choice(passages[:24])[1].split()
            p = p[rnd.randrange(3) :]
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(p) + 1)
                p[at : at + rnd.randrange(2)] = [rnd.choice(words)] * rnd.randrange(2)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p
        docs.append((d, ", ".join(w)))
    docs.append(docs[-1])
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, run string")
    items = spark.createDataFrame([(*p, 1) for p in passages], "item_id long, passage string, edits int")
    for edits in (0, 1, 2):
        want = brute(docs, passages, 8, edits)
        for block in (10**6, 400):
            got = {(r.doc_id, r.item_id): (r.edits, r["run"]) for r in leaks(df, items, 8, edits, block).collect()}
            assert got == want and len(want) > 10, (edits, block)
    assert leaks(df.limit(0), items).count() == 0 and leaks(df, items.limit(0)).count() == 0


def test_few_hits_are_held_at_once():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(4)]
    rows = [(i, " ".join(rng.choice(words, 20))) for i in range(15)]
    items = Items(rows, 9, 2)
    symbols = np.concatenate([np.append(rng.integers(0, 5, 60), 0) for _ in range(12)])
    document = np.repeat(np.arange(12), 61)
    want = {x[:3] + (x[3],) for x in zip(*(c.tolist() for c in search(items, symbols, document)), strict=True)}
    assert len(want) > 30
    for held in (3, 40, 1000):
        assert set(zip(*(c.tolist() for c in search(items, symbols, document, held=held)), strict=True)) == want


def test_held_out_fields(spark):
    rows = [(1, "test", "q1", None), (2, "train", "q2", "s2"), (3, "validation", None, "s3"), (4, None, "q", "s")]
    df = spark.createDataFrame(rows, "item_id long, split string, question string, support string")
    assert {tuple(r) for r in held_out(df).filter(F.col("passage").isNotNull()).collect()} == {(1, "q1"), (3, "s3")}
