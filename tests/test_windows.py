import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import exports, windows


def greedy(walls, width):
    starts = []
    for wall in sorted(walls):
        if not starts or wall >= starts[-1] + width:
            starts.append(wall)
    return starts


def edges_of(spark, runs):
    data, line = [], 0
    for run, walls in runs.items():
        for wall in walls:
            line += 1
            data.append((run, str(line), f"p{wall % 3}", f"o{wall % 2}", wall, 0, line, line % 4 == 0))
    schema = "run_id string, raw_edge_id string, src string, dst string, wall_time_ns bigint, `order` bigint, line_number bigint, hit boolean"
    df = spark.createDataFrame(data, schema)
    return df.withColumn("y", F.col("hit").cast("int")).drop("hit")


GOLDEN = [0, 10, 30, 59, 60, 61, 130, 185, 190, 400]


def random_runs(seed):
    rng = random.Random(seed)
    runs = {"golden": GOLDEN, "single": [5], "even": list(range(0, 900, 3)), "burst": [7000 + n % 90 for n in range(400)]}
    for n in range(25):
        base = rng.randint(0, 10**6)
        span = rng.choice([50, 500, 20_000])
        runs[f"r{n}"] = [base + rng.randint(0, span) for _ in range(rng.randint(1, 120))]
    return runs


def starts_of(df):
    out = {}
    for r in df.orderBy("run_id", "window_index").collect():
        out.setdefault(r["run_id"], []).append((r["window_index"], r["start_ns"]))
    return out


def test_golden_windows(spark):
    edges = edges_of(spark, {"g": GOLDEN})
    stats = windows.window_stats(windows.window_edges(edges, 60)).orderBy("window_index").collect()
    assert [(r["start_ns"], r["end_ns"]) for r in stats] == [(0, 59), (60, 61), (130, 185), (190, 190), (400, 400)]


@pytest.mark.parametrize("seed, hot", [(1, 10**6), (1, 1), (2, 30), (3, 1)])
def test_starts_equal_the_sequential_rule(spark, seed, hot):
    runs = random_runs(seed)
    got = starts_of(windows.window_starts(edges_of(spark, runs), 60, hot_times=hot))
    assert got == {run: list(enumerate(greedy(walls, 60), 1)) for run, walls in runs.items()}


def test_properties_of_windows(spark):
    edges = edges_of(spark, random_runs(4))
    cut = windows.window_edges(edges, 60)
    assert cut.count() == edges.count()
    stats = windows.window_stats(cut)
    assert stats.filter("end_ns - start_ns >= 60").isEmpty()
    rows = stats.orderBy("run_id", "window_index").collect()
    for a, b in zip(rows, rows[1:]):
        assert a["run_id"] != b["run_id"] or b["start_ns"] >= a["start_ns"] + 60


def test_rewindowing_equals_a_direct_cut(spark):
    edges = edges_of(spark, random_runs(5))
    narrow = windows.window_edges(edges, 60)
    wide = windows.window_stats(windows.rewindow(narrow, 60, 240))
    direct = windows.window_stats(windows.window_edges(edges, 240))
    assert wide.exceptAll(direct.select(*wide.columns)).isEmpty() and direct.count() == wide.count()
    kept = exports.conservation(windows.window_stats(narrow), wide)
    assert kept.filter("source_edges <> derived_edges or source_attack_edges <> derived_attack_edges").isEmpty()
    with pytest.raises(ValueError):
        windows.rewindow(narrow, 60, 60)


def test_parallel_edges_are_numbered(spark):
    cut = windows.window_edges(edges_of(spark, {"g": [1, 1, 4, 7, 300]}), 60)
    keys = windows.parallel_edge_keys(cut, ["wall_time_ns", "order", "line_number"]).orderBy("line_number")
    # src and dst repeat with period 3 and 2: 1, 1 and 7 share a pair; 300 is in another window.
    assert [r["edge_key"] for r in keys.collect()] == [0, 1, 0, 2, 0]


def test_export_checks(spark):
    stats = windows.window_stats(windows.window_edges(edges_of(spark, {"g": GOLDEN}), 60))
    assert exports.index_mismatches(stats, stats).isEmpty()
    off = stats.withColumn("edge_count", F.when(F.col("window_index") == 2, 9).otherwise(F.col("edge_count")))
    assert [r["window_index"] for r in exports.index_mismatches(stats, off).collect()] == [2]
    unchecked = off.withColumn("edge_count", F.lit(-1).cast("bigint"))
    assert exports.index_mismatches(stats, unchecked).isEmpty()
    assert exports.name_collisions(stats, ["run_id"]).isEmpty()
