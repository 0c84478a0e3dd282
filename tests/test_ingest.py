"""Incremental ingest: each file once, whatever fails, and the same tables as a batch build."""

import os

import pytest

from test_raw import write_run
from test_snapshots import LABELS, contents
from traceloom.plans import pipeline
from traceloom.sources import raw, snapshots, tables
from traceloom.streaming import ingest as I


@pytest.fixture
def folders(spark, tmp_path):
    source, dataset = tmp_path / "raw", str(tmp_path / "dataset")
    source.mkdir()
    snapshots.create(spark, dataset)
    return source, dataset, str(tmp_path / "checkpoint")


def fill(source, benign=3):
    for n in range(benign):
        write_run(source, f"svc{n}_benign_1_recap", [7 * n + 13 * k for k in range(12)])
    write_run(source, "web_CVE-2024-0001_recap", [0, 10, 30, 59, 60, 61, 130])
    (source / "labels.csv").write_text(LABELS)


def batch_build(spark, source, path):
    root = str(path)
    snapshots.create(spark, root)
    pipeline.build_dataset(spark, str(source), root)
    return contents(spark, root)


def test_only_new_files_are_read(spark, folders, tmp_path):
    source, dataset, checkpoint = folders
    fill(source)
    (source / "nothing_benign_1_recap.jsonl").write_text("")
    first = I.ingest(spark, str(source), dataset, checkpoint, files_per_batch=2)
    assert first["lines"] == 3 * 13 + 8 and first["caught_up"] == 0
    assert first["versions"] in (2, 3)
    assert contents(spark, dataset) == batch_build(spark, source, tmp_path / "one")
    assert I.ingest(spark, str(source), dataset, checkpoint) == {"versions": 0, "lines": 0, "caught_up": 0}
    write_run(source, "late_benign_1_recap", [1, 2])
    assert I.ingest(spark, str(source), dataset, checkpoint) == {"versions": 1, "lines": 3, "caught_up": 0}
    assert contents(spark, dataset) == batch_build(spark, source, tmp_path / "two")


def test_changed_file_is_rebuilt(spark, folders, tmp_path):
    source, dataset, checkpoint = folders
    fill(source)
    I.ingest(spark, str(source), dataset, checkpoint)
    before = os.stat(source / "svc1_benign_1_recap.jsonl").st_mtime
    write_run(source, "svc1_benign_1_recap", [5, 6, 7])
    os.utime(source / "svc1_benign_1_recap.jsonl", (before + 100, before + 100))
    done = I.ingest(spark, str(source), dataset, checkpoint)
    assert (done["versions"], done["caught_up"]) == (1, 1)
    assert contents(spark, dataset) == batch_build(spark, source, tmp_path / "again")


def test_scan_of_changed_files_is_pruned(spark, folders):
    source, *_ = folders
    fill(source)
    files = sorted(source.glob("*.jsonl"))
    for n, path in enumerate(files):
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    listed = tables.discover_runs(spark, str(source))
    newest = listed.filter(f"file_name = '{files[-1].name}'").first()["modified"]
    lines = raw.text_lines(spark, str(source), since=newest)
    assert {r["file_path"].rsplit("/", 1)[1] for r in lines.select("file_path").distinct().collect()} == {files[-1].name}
    lines.write.format("noop").mode("overwrite").save()
    scans = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(lines._jdf.queryExecution().executedPlan().collectLeaves())
    scans[0].inputRDD()
    assert scans[0].metrics().apply("numFiles").value() == 1


@pytest.mark.parametrize("when", ["before", "after"])
def test_killed_around_the_switch(spark, folders, tmp_path, monkeypatch, when):
    """A batch that dies before or after its commit is run again and lands once."""
    source, dataset, checkpoint = folders
    fill(source, 1)
    publish, calls = snapshots.VersionedCommit.publish, []

    def dying(self, **note):
        calls.append(note)
        if len(calls) == 2 and when == "before":
            raise RuntimeError("killed")
        version = publish(self, **note)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return version

    monkeypatch.setattr(snapshots.VersionedCommit, "publish", dying)
    with pytest.raises(Exception, match="killed"):
        I.ingest(spark, str(source), dataset, checkpoint, files_per_batch=1)
    assert snapshots.snapshot(spark, dataset).version == (1 if when == "before" else 2)
    I.ingest(spark, str(source), dataset, checkpoint, files_per_batch=1)
    notes = [e["note"]["batch"] for e in snapshots.history(spark, dataset) if "batch" in e["note"]]
    assert sorted(notes) == [0, 1]
    assert contents(spark, dataset) == batch_build(spark, source, tmp_path / "batch")


def test_unknown_tool_stops_the_stream(spark, folders):
    source, dataset, checkpoint = folders
    write_run(source, "svc_benign_1_other", [1])
    with pytest.raises(Exception, match="no known tool"):
        I.ingest(spark, str(source), dataset, checkpoint)
    assert snapshots.snapshot(spark, dataset).version == 0
