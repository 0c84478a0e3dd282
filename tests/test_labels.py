import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import labels

SECOND = 10**9


def case(seed):
    rng = random.Random(seed)
    edges = [(f"r{n % 3}", 1000 * SECOND + rng.randint(0, 5000) * SECOND + rng.choice([0, 1, 999_999_999]), rng.choice([1, 1000, SECOND]), n) for n in range(300)]
    windows = []
    for _ in range(25):
        start = 1000 * SECOND + rng.randint(0, 5000) * SECOND + rng.choice([0, 1, 999_999_999])
        windows.append((f"r{rng.randint(0, 1)}", start, start + rng.choice([0, 5, -7, -2 * SECOND, 40 * SECOND, 900 * SECOND])))
    return edges, windows


@pytest.mark.parametrize("few", [64, 0])
def test_labels_equal_brute_force(spark, few):
    edges, windows = case(7)
    expected = {
        n: int(any(r == wr and t <= e and t + p - 1 >= s for wr, s, e in windows)) for r, t, p, n in edges
    }
    df = spark.createDataFrame(edges, "run_id string, wall_time_ns bigint, wall_time_precision_ns bigint, line_number bigint")
    frames = spark.createDataFrame(windows, "run_id string, start_ns bigint, end_ns bigint")
    got = {r["line_number"]: r["y"] for r in labels.label_edges(df, frames, ["line_number"], few).collect()}
    assert got == expected and 0 < sum(expected.values()) < len(expected)


def test_precision_counts(spark):
    edges = spark.createDataFrame([("r", 5 * SECOND, SECOND, 1)], "run_id string, wall_time_ns bigint, wall_time_precision_ns bigint, line_number bigint")
    for start, y in ((6 * SECOND - 1, 1), (6 * SECOND, 0)):
        windows = spark.createDataFrame([("r", start, start + 10)], "run_id string, start_ns bigint, end_ns bigint")
        assert labels.label_edges(edges, windows, ["line_number"]).first()["y"] == y


def test_attack_windows(spark):
    runs = spark.createDataFrame(
        [("web_CVE-1_recap", "recap", "web_CVE-1", "cve"), ("web_benign_1_recap", "recap", "web_benign_1", "benign"), ("odd_recap", "recap", "odd", "cve")],
        "run_id string, tool string, scenario string, kind string",
    )
    edges = spark.createDataFrame(
        [(r, 100 * SECOND, SECOND, 1) for r in ("web_CVE-1_recap", "web_benign_1_recap", "odd_recap")],
        "run_id string, wall_time_ns bigint, wall_time_precision_ns bigint, line_number bigint",
    )
    rows = [
        ("web", "CVE-1", "recap", "1970-01-01T00:01:40.5", "1970-01-01T00:02:00", "", ""),
        ("web", "CVE-1", "recap", "1970-01-01T00:01:41", "1970-01-01T00:02:00", "", ""),
        ("web", "CVE-1", "camflow", "", "", "100.5", "120"),
    ]
    schema = "scenario string, cve string, tool string, cve_start string, cve_end string, cve_start_epoch string, cve_end_epoch string"
    label_rows = labels.label_windows(spark.createDataFrame(rows, schema))
    assert label_rows.filter("tool = 'camflow'").first()["start_ns"] == 100_500_000_000
    got = labels.attack_windows(runs, edges, label_rows).collect()
    assert [(r["run_id"], r["start_ns"]) for r in got] == [("web_CVE-1_recap", 100_500_000_000)]


@pytest.mark.parametrize("few", [64, 0])
def test_coarse_precision(spark, few):
    """An edge that covers a window which starts long after it, in another bucket."""
    edges = spark.createDataFrame([("r", 0, 5000 * SECOND, 1), ("r", 0, SECOND, 2), ("r", 0, None, 3)], "run_id string, wall_time_ns bigint, wall_time_precision_ns bigint, line_number bigint")
    windows = spark.createDataFrame([("r", 4000 * SECOND, 4001 * SECOND)], "run_id string, start_ns bigint, end_ns bigint")
    got = {r["line_number"]: r["y"] for r in labels.label_edges(edges, windows, ["line_number"], few).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
