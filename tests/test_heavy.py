"""The most frequent values against a full count and sort, for any k, with skew, ties and few buckets."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import heavy


def rows_of(seed, kind, count=4000):
    draw = random.Random(seed)
    pick = {
        "skewed": lambda: f"v{int(draw.paretovariate(0.6))}",
        "even": lambda: f"v{draw.randrange(3000)}",
        "ties": lambda: f"v{draw.randrange(40) // 2 * 2}",
        "unique": lambda: f"v{draw.random()}",
    }[kind]
    rows = [(draw.choice(["x", "x", "x", "y", None]), pick(), line) for line in range(count)]
    return rows + [("x", None, count), ("z", "only", count + 1)]


def expected(rows, k):
    out = []
    for group in {r[0] for r in rows}:
        own = [(v, line) for g, v, line in rows if g == group and v is not None]
        n, first = collections.Counter(v for v, _ in own), {}
        for v, line in own:
            first[v] = min(line, first.get(v, line))
        ranked = sorted(n, key=lambda v: (-n[v], first[v], v))[:k]
        out += [(group, v, n[v], first[v], at) for at, v in enumerate(ranked, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["skewed", "even", "ties", "unique"])
@pytest.mark.parametrize("k,buckets", [(1, 64), (3, 1 << 14), (10, 16), (20, 2), (5000, 64)])
def test_like_a_full_sort(spark, kind, k, buckets):
    rows = rows_of(3, kind)
    frame = spark.createDataFrame(rows, "tool string, v string, line_number bigint").repartition(5)
    found = heavy.frequent_values(frame, F.col("v"), k, buckets=buckets)
    assert sorted((tuple(r) for r in found.select("tool", "value", "n", "first_line", "position").collect()), key=repr) == expected(rows, k)


def test_many_groups_and_no_rows(spark, monkeypatch):
    rows = rows_of(5, "skewed", 500)
    frame = spark.createDataFrame(rows, "tool string, v string, line_number bigint")
    monkeypatch.setattr(heavy, "small_enough", lambda _: False)
    found = heavy.frequent_values(frame, F.col("v"), 3)
    assert sorted((tuple(r) for r in found.select("tool", "value", "n", "first_line", "position").collect()), key=repr) == expected(rows, 3)
    assert heavy.frequent_values(frame.limit(0), F.col("v"), 3).isEmpty()


def test_only_candidates_are_grouped(spark, monkeypatch):
    """Of skewed data with many single values, the last count sees next to none of them."""
    rows = [("x", "often", n) for n in range(500)] + [("x", f"v{n}", 500 + n) for n in range(5000)]
    frame = spark.createDataFrame(rows, "tool string, v string, line_number bigint").repartition(4)
    counted, sizes = heavy._counted, []

    def watched(rows, by):
        sizes.append(rows.select("value").distinct().count())
        return counted(rows, by)

    monkeypatch.setattr(heavy, "_counted", watched)
    found = heavy.frequent_values(frame, F.col("v"), 1)
    assert [(r["value"], r["n"]) for r in found.collect()] == [("often", 500)]
    assert max(sizes) < 20
