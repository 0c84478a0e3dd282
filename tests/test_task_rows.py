"""More rows make more tasks, not larger ones."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_repair import fold, frame, random_nodes
from traceloom.operators import ordered, repair, trials


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 20)


def tasks(df):
    """Tasks that hold rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_scan_deals_rows_to_as_many_tasks_as_they_need(spark, few):
    df = spark.range(600).select((F.col("id") % 100).alias("g"), (F.col("id") * 7 % 600).alias("x"))
    out = ordered.scan(df, ["g"], ["x"], {"n": ("rank", None)})
    assert tasks(out) > 15
    ranks = {}
    for r in sorted(out.collect(), key=lambda r: r["x"]):
        ranks.setdefault(r["g"], []).append(r["n"])
    assert ranks == {g: [1, 2, 3, 4, 5, 6] for g in range(100)}


@pytest.mark.parametrize("limit", [5, 60, 10**6])
def test_group_sizes_by_cells(spark, limit):
    df = spark.range(500).select(F.when(F.col("id") < 60, 1).when(F.col("id") < 70, None).otherwise(F.col("id")).alias("g"))
    largest, total = ordered.group_sizes(df, ["g"], limit)
    assert total == 500 and largest >= 60 and (largest == 60 or largest <= limit)


@pytest.mark.parametrize("hot", [10**6, 40, 3])
def test_ranges_of_many_owners(spark, few, monkeypatch, hot):
    monkeypatch.setattr(trials, "HOT_GROUP_ROWS", hot)
    rng = random.Random(hot)
    data = [(rng.choice([None, *"abcdefghijklmnopqrstuvwxyz"]), rng.choice([None, *range(40)])) for _ in range(900)]
    expected = set()
    for owner in {g for g, _ in data}:
        mine = {n for g, n in data if g == owner}
        if None in mine:
            expected.add((owner, None, None, 1, None))
        for first in (n for n in mine if n is not None and n - 1 not in mine):
            last = first
            while last + 1 in mine:
                last += 1
            expected.add((owner, first, last, last - first + 1, f"{first}-{last}" if last > first else f"{first}"))
    ranges = trials.integer_ranges(spark.createDataFrame(data, "g string, n bigint"), ["g"], "n")
    assert sorted(map(repr, ((r["g"], r["first"], r["last"], r["length"], r["text"]) for r in ranges.collect()))) == sorted(map(repr, expected))
    if hot == 10**6:
        assert tasks(ranges) > 10


def test_merged_records_are_dealt_by_their_number(spark, few):
    nodes = random_nodes(4)
    merged = repair.merge_duplicates(frame(spark, nodes))
    assert tasks(merged) > 15
    got = {r["raw_node_id"]: (r["prov_type"], r["attributes"], r["duplicate_count"], r["duplicate_exact_count"], r["duplicate_conflict_count"], sorted(r["conflicting_fields"])) for r in merged.collect()}
    assert got == {id_: fold(records) for id_, records in nodes.items()}
