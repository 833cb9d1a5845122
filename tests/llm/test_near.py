import random

import pandas as pd
import pytest

from orrery.llm import near
from orrery.llm.near import Near, components, near_groups, near_pairs
from orrery.llm.terms import terms


def brute(rows, similarity, width, least):
    sets = {}
    for key, text, *_ in rows:
        if text is None or len(terms(text)) < max(least, width):
            continue
        w = terms(text)
        sets[key] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def corpus(seed, n=260):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(n):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(texts).split()
            for _ in range(rnd.choice([0, 1, 2, 4, 8])):
                at = rnd.randrange(len(w) + 1)
                w[at : at + rnd.randrange(2)] = [rnd.choice(words)] * rnd.randrange(2)
            if rnd.random() < 0.2:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            texts.append(" ".join(w) or "w1")
        else:
            texts.append(" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))))
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)]
    return rows + [(2, None, "x"), (5, "", "x"), (8, "w1 w2", "x")]


@pytest.mark.parametrize("method", ["universe", "prefix"])
@pytest.mark.parametrize("similarity,width", [(0.8, 1), (0.8, 3), (0.9, 2), (0.7, 2), (0.5, 3)])
def test_both_methods_find_every_link(spark, method, similarity, width):
    rnd = random.Random(int(100 * similarity) + width)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 40, 90, 200, 400) for _ in range(4)]
    for _ in range(220):
        w = rnd.choice(texts).split()
        for _ in range(rnd.choice([1, 1, 2, 3, max(1, len(w) // 15)])):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randrange(2)] = [rnd.choice(words)] * rnd.randrange(2)
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(texts)) if t]
    want = brute(rows, similarity, width, 0)
    got = Near(spark.createDataFrame(rows, "key long, text string"), similarity, width, method=method)
    reps = {r.key: r.rep for r in got.members.collect()}
    want = {tuple(sorted((reps.get(a, a), reps.get(b, b)))) for a, b in want}
    found = [tuple(sorted((r.a, r.b))) for r in got.links().collect()]
    assert len(want) > 20 and set(found) == {x for x in want if x[0] != x[1]} and len(found) == len(set(found))


@pytest.mark.parametrize("similarity,width,least", [(0.5, 3, 10), (0.8, 5, 0), (0.6, 2, 0)])
def test_pairs_equal_brute_force(spark, similarity, width, least):
    rows = corpus(int(similarity * 10) + width)
    df = spark.createDataFrame(rows, "key long, text string, n string")
    got = [tuple(r) for r in near_pairs(df, similarity, width, least).collect()]
    want = brute(rows, similarity, width, least)
    assert len(want) > 50 and set(got) == want and len(got) == len(want)


def test_repeated_rows_change_nothing(spark):
    rows = corpus(3, 80)
    df = spark.createDataFrame(rows + rows[:40] + rows[10:20], "key long, text string, n string")
    got = [tuple(r) for r in near_pairs(df, 0.6, 2).collect()]
    assert set(got) == brute(rows, 0.6, 2, 0) and len(got) == len(set(got))
    groups = near_groups(df, 0.6, 2).collect()
    assert len(groups) == len({r.key for r in groups}) == len(rows)


def test_large_classes_are_stars_and_keep_links(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text) for i in range(20)] + [(100, text + " z"), (101, text + " y"), (102, text + " y")]
    df = spark.createDataFrame(rows, "key long, text string")
    got = {tuple(r) for r in near_pairs(df, 0.8, 3, 0, expand=5).collect()}
    assert {(0, i) for i in range(1, 20)} <= got
    assert {(0, 100), (0, 101), (0, 102), (100, 101), (100, 102), (101, 102)} <= got
    assert len(got) == 25
    assert near_pairs(df.limit(0)).count() == 0
    assert Near(df.selectExpr("key", "cast(null as string) text")).links().count() == 0


def test_texts_that_only_share_common_runs_hardly_meet(spark, monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.choice((30, 60, 120, 300)))) for _ in range(300)]
    texts += [t + " a" for t in texts[:40]]
    rows = list(enumerate(dict.fromkeys(texts)))
    met, by_prefixes = [], Near._by_prefixes
    monkeypatch.setattr(Near, "_by_prefixes", lambda self, cost: met.append(by_prefixes(self, cost).distinct().count()) or by_prefixes(self, cost))
    df = spark.createDataFrame(rows, "key long, text string")
    want = brute(rows, 0.5, 3, 0)
    assert {tuple(r) for r in near_pairs(df, 0.5, 3).collect()} == want
    assert len(want) > 30 and met[0] < 2 * len(want), (met, len(want))


def test_many_repeated_texts_do_not_travel_to_a_join(spark, monkeypatch):
    monkeypatch.setattr(near, "BROADCAST_ROWS", 5)
    rows = [r[:2] for r in corpus(12)]
    rows += [(k + 10_000, t) for k, t in rows]
    found = Near(spark.createDataFrame(rows, "key long, text string"), 0.6, 2)
    assert "Join" not in found.sets._jdf.queryExecution().optimizedPlan().toString()
    assert found.sets.count() < len(rows) // 2
    assert {tuple(r) for r in near_pairs(spark.createDataFrame(rows, "key long, text string"), 0.6, 2).collect()} == brute(rows, 0.6, 2, 0)


def test_links_of_repeated_rows_come_once(spark):
    rows = [r[:2] for r in corpus(3, 80)]
    links = [tuple(r) for r in Near(spark.createDataFrame(rows + rows[:40], "key long, text string"), 0.6, 2).links().collect()]
    assert links and len(links) == len(set(links))


def grouped(pairs, keys):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in keys}


def test_components_of_paths_stars_and_random_graphs(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)] + [(7, 3), (7, 3)]
    edges += [(3000, 2000 + i) for i in range(50)]  # a hub above its leaves
    edges += [(5000 + 20 * i + j, 5000 + 20 * i + j + 1) for i in range(20) for j in range(19)] + [(5000 + 20 * i + j, 5000 + 20 * (i + 1) + j) for i in range(19) for j in range(20)]
    edges += [(4, 4), (None, 5), (6, None)]
    got = {r.node: r.group for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [(a, b) for a, b in edges if a != b and a is not None and b is not None]
    assert got == grouped(edges, {x for e in edges for x in e})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_shuffled_path_settle_in_few_rounds(spark, monkeypatch):
    names = list(range(100_000))
    random.Random(8).shuffle(names)
    edges = pd.DataFrame({"a": names[:-1], "b": names[1:]})
    rounds = []
    marks = near._marks
    monkeypatch.setattr(near, "_marks", lambda edges: rounds.append(1) or marks(edges))
    got = components(spark.createDataFrame(edges)).agg({"group": "max", "node": "count"}).first()
    assert tuple(got) == (100_000, 0) or tuple(got) == (0, 100_000)
    assert len(rounds) <= 20, len(rounds)
    print("rounds", len(rounds))


def test_groups_equal_brute_force(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "key long, text string, n string")
    want = grouped(brute(rows, 0.8, 3, 0), {r[0] for r in rows})
    got = near_groups(df, 0.8, 3).collect()
    assert {r.key: r.group for r in got} == want and len(got) == len(rows)
    assert all(r.links == 0 and r.copies == 1 for r in got if r.key == 2)
