"""The index of a dataset after any sequence of built, rebuilt and removed runs equals one made from scratch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from test_raw import write_run
from traceloom.operators import indexes
from traceloom.plans import pipeline
from traceloom.sources import snapshots


def rows(df):
    return sorted(tuple(r) for r in df.select("tool", "aspect", "value", "n").collect())


def scratch(spark, root):
    store = snapshots.open_store(spark, root)
    parts = indexes.run_parts(store.read("runs"), store.read("nodes"), store.read("edges"))
    empty = spark.createDataFrame([], indexes.PARTS)
    return rows(indexes.apply_changes(empty, parts, empty))


def test_any_sequence_of_changes(spark):
    draw = random.Random(4)
    held, index = {}, spark.createDataFrame([], indexes.INDEX)
    for _ in range(6):
        old, new = [], []
        for run in draw.sample("abcdef", 3):
            old += held.pop(run, [])
            if draw.random() < 0.7:
                held[run] = [(run, "xy"[ord(run) % 2], "label", draw.choice("pqr"), draw.randrange(1, 9))]
                new += held[run]
        frames = [spark.createDataFrame(r, indexes.PARTS) for r in (new, old)]
        index = spark.createDataFrame(indexes.apply_changes(index, *frames).collect(), indexes.INDEX)
        total = {}
        for run_id, tool, aspect, value, n in sum(held.values(), []):
            total[tool, aspect, value] = total.get((tool, aspect, value), 0) + n
        assert rows(index) == sorted((*k, n) for k, n in total.items())


@pytest.mark.parametrize("versioned", [True, False])
def test_dataset_index(spark, tmp_path, versioned):
    source, root = tmp_path / "raw", str(tmp_path / "dataset")
    source.mkdir()
    if versioned:
        snapshots.create(spark, root)
    for n in range(3):
        write_run(source, f"svc{n}_benign_1_recap", [n, 13 + n])
    pipeline.build_dataset(spark, str(source), root)
    assert rows(snapshots.open_store(spark, root).read("dataset_index")) == scratch(spark, root)
    # Another source of a run: a label that only it had leaves, a new one comes.
    moved = tmp_path / "moved"
    moved.mkdir()
    lines = [{"id": "q", "type": "Entity", "annotations": {"object_type": "socket"}}, {"from": "q", "to": "q", "annotations": {"ts": "2024-01-01T00:00:00", "relation": "send"}}]
    (moved / "svc1_benign_1_recap.jsonl").write_text("".join(json.dumps(line) + "\n" for line in lines))
    pipeline.build_dataset(spark, str(moved), root)
    found = rows(snapshots.open_store(spark, root).read("dataset_index"))
    assert found == scratch(spark, root) and ("recap", "runs", "", 3) in found and any(a == "node_type" and v == "socket" for _, a, v, _ in found)
    gone = spark.createDataFrame([("recap", "svc1_benign_1_recap"), ("recap", "svc0_benign_1_recap")], "tool string, run_id string")
    pipeline.remove_runs(spark, root, gone)
    found = rows(snapshots.open_store(spark, root).read("dataset_index"))
    assert found == scratch(spark, root) and not any(v == "socket" for _, _, v, _ in found)
    total = indexes.rollup(snapshots.open_store(spark, root).read("dataset_index")).first()
    assert (total["tool"], total["runs"], total["edges"], total["scenarios"], total["kinds"]) == ("recap", 1, 2, 1, 1)


def test_only_changed_runs_are_read(spark, tmp_path):
    source, root = tmp_path / "raw", str(tmp_path / "dataset")
    source.mkdir()
    snapshots.create(spark, root)
    for n in range(3):
        write_run(source, f"svc{n}_benign_1_recap", [n, 13 + n])
    pipeline.build_dataset(spark, str(source), root)
    changed = spark.createDataFrame([("recap", "svc1_benign_1_recap")], "tool string, run_id string")
    old = snapshots.open_store(spark, root).begin().before("run_parts", changed)
    assert all("run_id=svc1_benign_1_recap" in f for f in old.inputFiles()) and old.count() > 5


def test_index_of_an_older_dataset(spark, tmp_path):
    """A dataset that has no index yet gets a whole one at its next change."""
    source, root = tmp_path / "raw", str(tmp_path / "dataset")
    source.mkdir()
    snapshots.create(spark, root)
    write_run(source, "svc0_benign_1_recap", [1, 2])
    write_run(source, "svc1_benign_1_recap", [3])
    pipeline.build_dataset(spark, str(source), root)
    head, made = snapshots.snapshot(spark, root), ("dataset_index", "run_parts")
    head.manifest().filter(~F.col("table").isin(*made)).write.parquet(f"{root}/_manifests/older")
    entry = head.entry | {"version": 2, "manifest": "_manifests/older", "tables": {t: d for t, d in head.entry["tables"].items() if t not in made}}
    snapshots._put_if_absent(spark, snapshots._log(root, 2), json.dumps(entry))
    write_run(source, "svc2_benign_1_recap", [5])
    pipeline.build_dataset(spark, str(source), root)
    assert rows(snapshots.open_store(spark, root).read("dataset_index")) == scratch(spark, root)
    pipeline.remove_runs(spark, root, spark.createDataFrame([("recap", "svc0_benign_1_recap")], "tool string, run_id string"))
    assert rows(snapshots.open_store(spark, root).read("dataset_index")) == scratch(spark, root)
