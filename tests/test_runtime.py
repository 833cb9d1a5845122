import random

from pyspark.sql import functions as F

from orrery.operators.records import number_rows
from orrery.runtime import at_most, cut_lineage, join_small


def test_join_small_either_way(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(500)] + [(900, None)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), (None, 3)], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "k", how).collect()))
        for most in (100, 1):
            got = join_small(left, right, ["k"], ["id"], how, max_rows=most).select("k", "id", "v")
            assert sorted(map(str, got.collect())) == want
    assert at_most(right, 3) and not at_most(right, 2) and at_most(right.limit(0), 0)


def test_rows_are_numbered_in_order(spark):
    order = list(range(3000))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(o,) for o in order], "ord long")
    got = number_rows(df, "ord", "n", 10).collect()
    assert {r.ord: r.n for r in got} == {i: i + 10 for i in range(3000)}
    assert number_rows(df.limit(0), "ord", "n").count() == 0
    assert cut_lineage(df).agg(F.sum("ord")).first()[0] == sum(order)
