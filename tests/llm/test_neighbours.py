import numpy as np
import pytest

from orrery.llm.neighbours import Side, nearest, products, quantise, similar_pairs, strip


def brute(space, ids, x, k):
    x = x.astype(np.float64)
    out = {}
    for i in range(len(ids)):
        if space == "l2":
            d = ((x[i] - x) ** 2).sum(axis=1)
        else:
            d = 1 - (x[i] * x).sum(axis=1) / (np.sqrt((x[i] ** 2).sum()) * np.sqrt((x * x).sum(axis=1)) if space == "cosine" else 1.0)
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def test_quantisation_rest_is_exact():
    x = np.random.default_rng(1).normal(size=(50, 17)) * 10.0 ** np.arange(-4, 6).repeat(5)[:, None]
    q, s, rest = quantise(x)
    assert q.dtype == np.int8
    assert np.allclose(np.linalg.norm(x - s[:, None] * q, axis=1), rest)


@pytest.mark.parametrize("space", ["l2", "ip", "cosine"])
def test_strip_equals_brute_force(space):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:200] = x[0:100]  # ties
    x[300:320] *= 1e6
    x[320:330] *= 1e-6
    x[330:333] *= 1e25
    ids = rng.permutation(9000)[:3000].astype(np.int64)
    side = Side(ids, x, space)
    row, name, _ = strip(space, 5, side, side)
    got = {}
    for r, n in zip(row, name, strict=True):
        got.setdefault(ids[r], []).append(n)
    assert got == brute(space, ids, x, 5)


@pytest.mark.parametrize("d", [384, 1536, 2500])
@pytest.mark.parametrize("space", ["l2", "ip", "cosine"])
def test_strip_is_exact_in_many_dimensions(space, d):
    rng = np.random.default_rng(d)
    x = (rng.normal(size=(20, d))[rng.integers(0, 20, 700)] + 1e-4 * rng.normal(size=(700, d))).astype(np.float32)
    x[:9] = x[9:18]
    ids = np.arange(700)
    side = Side(ids, x, space)
    row, name, _ = strip(space, 5, side, side)
    got = {}
    for r, n in zip(row, name, strict=True):
        got.setdefault(ids[r], []).append(n)
    assert got == brute(space, ids, x, 5)


def test_products_of_codes_are_whole_numbers():
    rng = np.random.default_rng(9)
    for d in (1024, 1536, 5000):
        a, b = rng.choice([-127, 127, 100], (30, d)), rng.choice([-127, 127, 126], (40, d))
        a[0], b[0] = 127, 127
        got, slack = products(a.astype(np.float32), b.astype(np.float32))
        wrong = np.abs(got.astype(np.float64) - a @ b.T).max()
        assert wrong <= slack and (slack == 0) == (d <= 1024)


@pytest.mark.parametrize("blocks", [{}, {"row_block": 64, "column_block": 100}])
def test_nearest_in_collections(spark, blocks):
    rng = np.random.default_rng(4)
    rows, by = [], {"a": [], "b": [], "c": []}
    for i in range(500):
        c = "abc"[0 if i < 400 else 1 if i < 404 else 2]
        v = [float(np.float32(z)) for z in rng.normal(size=6)]
        if i % 50 == 7:
            v = [None, [], v[:3], [0.0] * 6, [float("nan")] * 6, [float("inf")] * 6][i // 50 % 6]
        else:
            by[c].append((i, v))
        rows.append((i, c if i != 490 else None, v, "text"))
    by["c"] = [x for x in by["c"] if x[0] != 490]
    r = spark.createDataFrame(rows, "rowid long, collection_id string, embedding array<float>, space string")
    c = spark.createDataFrame([("a", 6, "cosine", 1), ("b", 6, "l2", 1), ("c", 6, "ip", 1), ("d", 6, "l2", 1), ("e", None, "l2", 1)], "collection_id string, dimension int, space string, rowid long")
    got = {}
    for x in sorted(nearest(r, c, **blocks).collect(), key=lambda x: (x.rowid, x.distance, x.neighbour)):
        got.setdefault(x.rowid, []).append(x.neighbour)
    want = {}
    for name, space in (("a", "cosine"), ("b", "l2"), ("c", "ip")):
        ids = np.array([i for i, _ in by[name]])
        want |= brute(space, ids, np.array([v for _, v in by[name]], dtype=np.float32), 5)
    assert got == want
    pairs = {(p.rowid_a, p.rowid_b) for p in similar_pairs(r, c, **blocks).collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, bs in want.items() for b in bs}
    again = r.unionByName(r.filter("rowid % 3 = 0")).unionByName(r.limit(40))
    assert {(p.rowid_a, p.rowid_b) for p in similar_pairs(again, c, **blocks).collect()} == pairs
    assert nearest(r.limit(0), c).count() == 0 and nearest(r, c.limit(0)).count() == 0
