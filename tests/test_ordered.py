import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators.ordered import hot_join, lookup_join, scan


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for n in range(600):
        group = rng.choice(["hot"] * 6 + ["a", "b", None, "c"])
        out.append((group, rng.randint(0, 50), n, rng.choice([None, rng.randint(-9, 9)])))
    return out


def brute(data):
    expected = {}
    for group in {r[0] for r in data}:
        total, top, last = None, None, None
        for rank, r in enumerate(sorted((r for r in data if r[0] == group), key=lambda r: r[1:3]), 1):
            if r[3] is not None:
                total = (total or 0) + r[3]
                top = r[3] if top is None else max(top, r[3])
                last = r[3]
            expected[r[2]] = (rank, total, top, last)
    return expected


@pytest.mark.parametrize("hot_rows", [0, 5, 10_000])
def test_scan(spark, hot_rows):
    data = rows()
    df = spark.createDataFrame(data, "g string, t int, id int, v int").repartition(5)
    out = scan(
        df, ["g"], ["t", "id"], {"rank": ("rank", None), "total": ("sum", "v"), "top": ("max", "v"), "last": ("last", "v")}, hot_rows
    )
    got = {r["id"]: (r["rank"], r["total"], r["top"], r["last"]) for r in out.collect()}
    assert got == brute(data)


@pytest.mark.parametrize("hot_rows", [0, 10_000])
def test_scan_without_group(spark, hot_rows):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    out = scan(df, [], ["x"], {"n": ("rank", None)}, hot_rows).collect()
    assert {r["x"]: r["n"] for r in out} == {x: x + 1 for x in range(500)}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_join_equals_plain_join(spark, how):
    fact = spark.createDataFrame([(g or "none", n) for g, _, n, _ in rows()], "k string, id int")
    lookup = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, v int")
    plain = sorted(map(tuple, fact.join(lookup, ["k"], how).collect()), key=repr)
    for hot in (5, 100, None):
        joined = hot_join(fact, lookup, ["k"], ["id"], how, hot_rows=hot)
        assert sorted(map(tuple, joined.collect()), key=repr) == plain
    assert sorted(map(tuple, lookup_join(fact, lookup, ["k"], ["id"], how).collect()), key=repr) == plain


def test_hot_join_with_residual(spark):
    fact = spark.createDataFrame([("h", n) for n in range(50)], "k string, t int")
    lookup = spark.createDataFrame([("h", 0, 20), ("h", 20, 50)], "k string, lo int, hi int")
    inside = (F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi"))
    out = hot_join(fact, lookup, ["k"], ["t"], "inner", inside, hot_rows=10)
    assert sorted((r["t"], r["lo"]) for r in out.collect()) == [(t, 0 if t < 20 else 20) for t in range(50)]
