"""Versioned folders: commits that fail leave the old version, readers keep theirs, retention removes only what nobody names."""

import json

import pytest
from pyspark.sql import functions as F

from test_raw import write_run
from traceloom.operators import exports
from traceloom.plans import pipeline
from traceloom.session import materialize
from traceloom.sources import snapshots

ROWS = "tool string, run_id string, n bigint"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def put(spark, root, rows, replaced=(), **note):
    """One commit of table ``t`` that replaces the named runs."""
    commit = snapshots.open_store(spark, root).begin()
    if replaced:
        commit.replace(["t"], spark.createDataFrame([(r,) for r in replaced], "run_id string"))
    commit.write("t", frame(spark, rows), ["tool", "run_id"])
    return commit.publish(**note)


def rows_of(store, table="t", **where):
    return sorted(tuple(r) for r in store.read(table, **where).select("tool", "run_id", "n").collect())


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "store")
    snapshots.create(spark, path)
    snapshots.create(spark, path)
    return path


def test_replace_and_add(spark, root):
    assert put(spark, root, [("x", "a", 1), ("x", "a", 2), ("y", "b", 3)], job="first") == 1
    old = snapshots.open_store(spark, root)
    assert put(spark, root, [("x", "a", 9), ("x", "c", 4)], ["a"]) == 2
    assert rows_of(snapshots.open_store(spark, root)) == [("x", "a", 9), ("x", "c", 4), ("y", "b", 3)]
    # The reader of version 1 goes on seeing version 1, and can open it again.
    assert rows_of(old) == rows_of(snapshots.VersionedStore(snapshots.snapshot(spark, root, 1))) == [("x", "a", 1), ("x", "a", 2), ("y", "b", 3)]
    manifest = snapshots.snapshot(spark, root).manifest("t").collect()
    assert sum(r["rows"] for r in manifest) == 3 and all(r["bytes"] > 0 for r in manifest)
    assert {(r["partition"]["tool"], r["partition"]["run_id"]) for r in manifest} == {("x", "a"), ("x", "c"), ("y", "b")}
    assert [e["version"] for e in snapshots.history(spark, root)] == [2, 1, 0]
    assert next(e for e in snapshots.history(spark, root) if e["version"] == 1)["note"] == {"job": "first"}


def test_nothing_is_seen_before_the_switch(spark, root):
    put(spark, root, [("x", "a", 1)])
    commit = snapshots.open_store(spark, root).begin()
    commit.replace(["t"], spark.createDataFrame([("a",)], "run_id string"))
    staged = commit.write("t", frame(spark, [("x", "a", 2)]), ["tool", "run_id"])
    assert [r["n"] for r in staged.collect()] == [2]
    during = snapshots.open_store(spark, root)
    commit.publish()
    after = snapshots.open_store(spark, root)
    assert rows_of(during) == [("x", "a", 1)] and rows_of(after) == [("x", "a", 2)]


def test_pruning_lists_only_the_wanted_files(spark, root):
    put(spark, root, [("x", "a", 1), ("y", "b", 2)])
    store = snapshots.open_store(spark, root)
    assert rows_of(store, tool=["y"]) == [("y", "b", 2)] and rows_of(store, tool=["z"]) == []
    assert all("tool=y" in f for f in store.read("t", tool=["y"]).inputFiles())


def test_odd_values_and_empty_tables(spark, root):
    odd = ["a b%20c+d", "ü=1/x", "[1]{2}*?", "007", "x'y\"z#"]
    commit = snapshots.open_store(spark, root).begin()
    commit.write("t", frame(spark, [("x", r, i) for i, r in enumerate(odd)]), ["tool", "run_id"])
    commit.write("nothing", frame(spark, []), ["tool", "run_id"])
    commit.write("plain", frame(spark, [("x", "a", 1)]), [], overwrite=True)
    commit.publish()
    store = snapshots.open_store(spark, root)
    assert rows_of(store) == sorted(("x", r, i) for i, r in enumerate(odd))
    assert rows_of(store, run_id=[odd[2]]) == [("x", odd[2], 2)]
    assert store.has("nothing") and rows_of(store, "nothing") == [] and rows_of(store, "plain") == [("x", "a", 1)]
    put(spark, root, [], [odd[0]])
    assert rows_of(snapshots.open_store(spark, root)) == sorted(("x", r, i) for i, r in enumerate(odd) if i)


def test_two_writers(spark, root):
    put(spark, root, [("x", "a", 1), ("x", "b", 2)])
    first, second, third = (snapshots.open_store(spark, root).begin() for _ in range(3))
    for commit, run, n in ((first, "a", 10), (second, "b", 20), (third, "a", 30)):
        commit.replace(["t"], spark.createDataFrame([(run,)], "run_id string"))
        commit.write("t", frame(spark, [("x", run, n)]), ["tool", "run_id"])
    assert first.publish() == 2 and second.publish() == 3  # other partitions: put on top of version 2
    with pytest.raises(snapshots.CommitConflict):
        third.publish()
    assert rows_of(snapshots.open_store(spark, root)) == [("x", "a", 10), ("x", "b", 20)]


def test_a_version_has_one_writer(spark, root):
    entry = json.dumps({"version": 1})
    assert snapshots._put_if_absent(spark, snapshots._log(root, 1), entry)
    assert not snapshots._put_if_absent(spark, snapshots._log(root, 1), "other")
    assert snapshots.read_text(spark, snapshots._log(root, 1)) == entry
    assert snapshots._names(spark, f"{root}/_log") == [f"{0:020d}.json", f"{1:020d}.json"]


def test_vacuum(spark, root, tmp_path):
    for n in range(4):
        put(spark, root, [("x", "a", n), ("x", f"r{n}", n)], ["a"])
    lost = snapshots.open_store(spark, root).begin()
    lost.write("t", frame(spark, [("x", "never", 1)]), ["tool", "run_id"])
    before = rows_of(snapshots.open_store(spark, root))
    assert snapshots.vacuum(spark, root, keep=2) == 0  # all of it is younger than the grace
    assert snapshots.versions(spark, root) == [3, 4]
    pinned = snapshots.VersionedStore(snapshots.snapshot(spark, root, 3))
    assert snapshots.vacuum(spark, root, keep=2, grace_seconds=-60) == 3  # run a of versions 1 and 2, and the commit that was lost
    assert rows_of(snapshots.open_store(spark, root)) == before and ("x", "a", 2) in rows_of(pinned)
    with pytest.raises(ValueError, match="not retained"):
        snapshots.snapshot(spark, root, 1)


LABELS = "scenario,cve,tool,cve_start,cve_end,cve_start_epoch,cve_end_epoch\nweb,CVE-2024-0001,recap,2024-01-01T00:01:01.2,2024-01-01T00:02:10,,\n"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """A versioned dataset, export and re-windowed export."""
    path = tmp_path_factory.mktemp("jobs")
    (path / "raw").mkdir()
    for n in range(3):
        write_run(path / "raw", f"svc{n}_benign_1_recap", [7 * n + 13 * k for k in range(20)])
    write_run(path / "raw", "web_CVE-2024-0001_recap", [0, 10, 30, 59, 60, 61, 130, 185, 190, 400])
    (path / "raw" / "labels.csv").write_text(LABELS)
    source, dataset, export, wide = (str(path / d) for d in ("raw", "dataset", "export", "wide"))
    for folder in (dataset, export, wide):
        snapshots.create(spark, folder)
    pipeline.build_dataset(spark, source, dataset)
    pipeline.build_splits(spark, dataset)
    pipeline.export_windows(spark, dataset, export, 60)
    pipeline.rewindow_export(spark, export, wide, 240)
    return source, dataset, export, wide


def contents(spark, root):
    store = snapshots.open_store(spark, root)
    return {t: sorted((tuple(map(str, r)) for r in store.read(t).collect()), key=repr) for t in store.pinned.entry["tables"]}


def test_jobs_equal_those_of_plain_folders(spark, built, tmp_path):
    source, dataset, export, wide = built
    flat = {d: str(tmp_path / d) for d in ("dataset", "export", "wide")}
    pipeline.build_dataset(spark, source, flat["dataset"])
    pipeline.build_splits(spark, flat["dataset"])
    pipeline.export_windows(spark, flat["dataset"], flat["export"], 60)
    pipeline.rewindow_export(spark, flat["export"], flat["wide"], 240)
    for name, root in (("dataset", dataset), ("export", export), ("wide", wide)):
        store = snapshots.open_store(spark, root)
        for table in store.pinned.entry["tables"]:
            ours = store.read(table)
            if ours.isEmpty():  # a plain folder keeps no schema of an empty table
                continue
            columns = [c for c in sorted(ours.columns) if c != "derived_from"]
            theirs = spark.read.parquet(f"{flat[name]}/{table}")
            assert sorted((tuple(map(str, r)) for r in ours.select(columns).collect())) == sorted((tuple(map(str, r)) for r in theirs.select(columns).collect())), (name, table)


def test_failed_rebuild_keeps_the_dataset(spark, built, tmp_path, monkeypatch):
    source, dataset, *_ = built
    before, version = contents(spark, dataset), snapshots.snapshot(spark, dataset).version
    bad = tmp_path / "raw"
    bad.mkdir()
    write_run(bad, "web_CVE-2024-0001_recap", [5, 6])  # another source file: to be built again
    with (bad / "web_CVE-2024-0001_recap.jsonl").open("a") as handle:
        handle.write('{"from":"a","to":"b","annotations":{"ts":"never"}}\n')
    with pytest.raises(ValueError, match="edge_without_time"):
        pipeline.build_dataset(spark, str(bad), dataset, strict=True)
    monkeypatch.setattr(pipeline, "summarize_runs", lambda runs, nodes, edges, attacks: edges.limit(0).select("run_id", "tool", F.lit(0).cast("bigint").alias("edge_count")))
    with pytest.raises(ValueError, match="is not whole"):
        pipeline.build_dataset(spark, str(bad), dataset)
    assert contents(spark, dataset) == before and snapshots.snapshot(spark, dataset).version == version


def test_failed_rebuild_of_a_plain_folder(spark, built, tmp_path):
    source = built[0]
    flat = str(tmp_path / "dataset")
    pipeline.build_dataset(spark, source, flat)
    before = {t: spark.read.parquet(f"{flat}/{t}").count() for t in ("runs", "nodes", "edges")}
    bad = tmp_path / "raw"
    bad.mkdir()
    (bad / "web_CVE-2024-0001_recap.jsonl").write_text('{"from":"a","to":"b","annotations":{"ts":"never"}}\n')
    with pytest.raises(ValueError, match="edge_without_time"):
        pipeline.build_dataset(spark, str(bad), flat, strict=True)
    assert {t: spark.read.parquet(f"{flat}/{t}").count() for t in before} == before


def test_failed_export_keeps_the_export(spark, built, monkeypatch):
    _, dataset, export, _ = built
    before = contents(spark, export)
    clash = spark.createDataFrame([("recap", "test", "x")], "tool string, split string, file_name string")
    monkeypatch.setattr(exports, "name_collisions", lambda *_: clash)
    with pytest.raises(ValueError, match="used twice"):
        pipeline.export_windows(spark, dataset, export, 120)  # another size: everything is exported again
    monkeypatch.undo()
    assert contents(spark, export) == before
    pipeline.export_windows(spark, dataset, export, 60)
    assert contents(spark, export) == before and snapshots.snapshot(spark, export).version == 1


def test_failed_rewindowing_keeps_the_export(spark, built, monkeypatch):
    _, _, export, wide = built
    before = contents(spark, wide)
    lost = materialize(spark.createDataFrame([("r", 1, 0, 0, 0)], "run_id string, source_edges int, derived_edges int, source_attack_edges int, derived_attack_edges int"), "lost")
    monkeypatch.setattr(exports, "conservation", lambda *_: lost)
    with pytest.raises(ValueError, match="changed"):
        pipeline.rewindow_export(spark, export, wide, 480)
    monkeypatch.undo()
    assert contents(spark, wide) == before
    pipeline.rewindow_export(spark, export, wide, 480)
    assert contents(spark, wide) != before and snapshots.snapshot(spark, wide).version == 2
