import json

import pytest
from pyspark.sql import functions as F

from traceloom.operators import profiles
from traceloom.plans import pipeline
from traceloom.session import materialize
from traceloom.sources import raw, sinks, tables

SAMPLE = [
    b'{"id":"p1","type":"Activity","annotations":{"object_type":"process","comm":"nginx","cmdLine":"nginx -g x","cwd":"/"}}\n',
    b'{"id":"f1","type":"Entity","annotations":{"object_type":"file","path":"/etc/passwd"}}\n',
    b'{"id":"f1","type":"Entity","annotations":{"object_type":"file","path":"/etc/shadow"}}\r\n',
    b"\n",
    b"  \t \n",
    b'{"from":"p1","to":"f1","type":"Used","annotations":{"id":"e1","ts":"2024-01-01T00:00:00.5Z","relation_type":"Read File"}}\n',
    b'{"from":"p1","to":"s9","type":"Used","annotations":{"id":"e2","ts":"2024-01-01T00:01:00Z","relation":"connect","to_type":" Socket "}}\n',
    b'{"id":"caf\xe9","type":"Entity","annotations":{"object_type":"file"}}\n',
    b'{"id":"q1","type":"Entity","annotations":{"path":"/a"b/c"}}\n',
    b'{"id":"n1","type":"Entity","annotations":{"size":NaN}}\n',
    b"[1, 2]\n",
    b'{"id":"d1","id":"d2","type":null,"annotations":[1]}\n',
    b'{"id":"cut","type":"Entity"\n',
    '{"id":"ü1","type":"Entity","annotations":{"object_type":"file"}}'.encode(),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("captures")
    (path / "web_CVE-2024-0001_recap.jsonl").write_bytes(b"".join(SAMPLE))
    (path / "labels.csv").write_text(
        "scenario,cve,tool,cve_start,cve_end,cve_start_epoch,cve_end_epoch\n"
        "web,CVE-2024-0001,recap,2024-01-01T00:00:59,2024-01-01T00:02:00,,\n"
    )
    return path


def test_tiers_and_line_numbers(spark, folder):
    lines = {r["line_number"]: r["tier"] for r in raw.read_lines(spark, str(folder)).collect()}
    assert lines == {
        1: "strict_ok", 2: "strict_ok", 3: "strict_ok", 5: "whitespace", 6: "strict_ok", 7: "strict_ok", 8: "repairable_latin1",
        9: "repairable_escape_quotes", 10: "strict_ok", 11: "unrepaired", 12: "strict_ok", 13: "unrepaired", 14: "strict_ok",
    }


def test_records(spark, folder):
    records = raw.read_capture(spark, str(folder))
    got = {r["line_number"]: r for r in records.collect()}
    assert {n: r["record_class"] for n, r in got.items()} == {
        1: "node", 2: "node", 3: "node", 6: "edge", 7: "edge", 8: "node", 9: "node", 10: "node", 11: None, 12: "node", 13: None, 14: "node",
    }
    assert got[8]["raw_node_id"] == "café" and got[14]["raw_node_id"] == "ü1"
    assert got[9]["attributes"] == {"path": '/a"b/c'}
    assert got[10]["attributes"] == {"size": None}
    assert got[12]["raw_node_id"] == "d2" and got[12]["prov_type"] is None and got[12]["attributes"] == {}
    assert got[7]["to_type"] == " Socket " and got[7]["raw_edge_id"] == "e2"
    assert got[1]["tool"] == "recap" and got[1]["scenario"] == "web_CVE-2024-0001" and got[1]["kind"] == "cve"
    counters = profiles.parse_counters(records).first()
    assert (counters["non_ascii_lines"], counters["skipped_lines"]) == (2, 2)
    assert sorted((r["line_number"], r["reason"]) for r in raw.rejects(records).collect()) == [(11, "unreadable"), (13, "unreadable")]
    raw.require_clean(records)


def test_audit(spark, folder):
    lines = raw.audit_lines(raw.read_lines(spark, str(folder)))
    row = profiles.line_audit(lines).first()
    assert (row["strict_ok"], row["repairable_latin1"], row["repairable_escape_quotes"], row["unrepaired"]) == (8, 1, 1, 3)
    assert row["total_problem_lines"] == 5 and profiles.problem_lines(lines).count() == 5


def test_line_numbers_across_blocks(spark, tmp_path):
    for name, size in (("a_recap", 4000), ("b_recap", 30)):
        text = "".join(json.dumps({"id": f"{name}{n}", "pad": "x" * (n % 40)}) + "\n" * (1 + n % 2) for n in range(size))
        (tmp_path / f"{name}.jsonl").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        records = raw.read_capture(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(records) == 4030
    assert all(r["line_number"] == n + 1 + n // 2 for r in records for n in [int(r["raw_node_id"].split("recap")[1])])


def test_reports(spark, folder, tmp_path):
    totals = pipeline.audit_captures(spark, str(folder), str(tmp_path / "audit")).filter("tool = '*'").first()
    assert totals["total_problem_lines"] == 5
    assert spark.read.json(str(tmp_path / "audit" / "details")).count() == 5
    pipeline.profile_captures(spark, str(folder), str(tmp_path / "profile"))

    def report(name):
        return spark.read.parquet(str(tmp_path / "profile" / name))

    assert report("coverage_gaps").first()["missing"] == "camflow,conprov,provbpf"
    duplicate = report("first_duplicates").first()
    assert (duplicate["raw_node_id"], duplicate["first_line"], duplicate["duplicate_line"]) == ("f1", 2, 3)
    assert report("first_dangling").first()["dst"] == "s9"
    total = report("records").filter("tool = '*'").first()
    assert (total["records"], total["nodes"], total["edges"], total["parse_errors"]) == (10, 8, 2, 2)
    assert total["bytes"] == len(b"".join(SAMPLE))


def test_strict_policy(spark, tmp_path):
    (tmp_path / "x_recap.jsonl").write_text('{"from":"a","to":"b","annotations":{"ts":"never"}}\n')
    with pytest.raises(ValueError, match="edge_without_time at line 1"):
        raw.require_clean(raw.read_capture(spark, str(tmp_path)))


def test_odd_file_names(spark, tmp_path):
    for name in ("a b%20c+d_recap", "ü_recap"):
        (tmp_path / f"{name}.jsonl").write_text('{"id":"x"}\n')
    found = {r["run_id"] for r in tables.discover_runs(spark, str(tmp_path)).collect()}
    assert found == {r["run_id"] for r in raw.read_capture(spark, str(tmp_path)).collect()} == {"a b%20c+d_recap", "ü_recap"}


def test_discovery(spark, folder):
    run = tables.discover_runs(spark, str(folder)).first()
    assert run["run_id"] == "web_CVE-2024-0001_recap" and run["bytes"] == len(b"".join(SAMPLE))
    assert tables.read_labels(spark, str(folder / "none")).count() == 0


def write_run(path, name, walls, shift=0):
    lines = [{"id": "p", "type": "Activity", "annotations": {"object_type": "process", "comm": name}}]
    for n, wall in enumerate(walls):
        stamp = f"2024-01-01T{wall // 3600:02d}:{wall // 60 % 60:02d}:{wall % 60:02d}"
        lines.append({"from": "p", "to": f"f{n % 3 + shift}", "type": "Used", "annotations": {"id": n, "ts": stamp, "relation": "read"}})
    (path / f"{name}.jsonl").write_text("".join(json.dumps(line) + "\n" for line in lines))


def test_whole_pipeline(spark, tmp_path):
    source, dataset, export, wide = (tmp_path / d for d in ("raw", "dataset", "export", "wide"))
    source.mkdir()
    for n in range(4):
        write_run(source, f"svc{n}_benign_1_recap", [7 * n + 13 * k for k in range(20)])
    write_run(source, "web_CVE-2024-0001_recap", [0, 10, 30, 59, 60, 61, 130, 185, 190, 400])
    write_run(source, "web_CVE-2024-0001_recap_run_2", [3000, 3600])
    (source / "labels.csv").write_text(
        "scenario,cve,tool,cve_start,cve_end,cve_start_epoch,cve_end_epoch\n"
        "web,CVE-2024-0001,recap,2024-01-01T00:01:01.2,2024-01-01T00:02:10,,\n"
    )

    def build():
        return {r["status"]: r["runs"] for r in pipeline.build_dataset(spark, str(source), str(dataset)).collect()}

    assert build() == {"built": 6}
    assert build() == {"skipped": 6}
    write_run(source, "late_benign_1_recap", [1, 2])
    with (source / "late_benign_1_recap.jsonl").open("a") as handle:
        handle.write("broken\n")
    assert build() == {"skipped": 6, "built": 1}
    assert spark.read.parquet(str(dataset / "rejects")).count() == 1
    # A run stored under another schema version is built again and leaves nothing behind.
    old = spark.read.parquet(str(dataset / "runs")).filter("run_id like 'late%'").withColumn("schema_version", F.lit(2))
    sinks.write_partitioned(materialize(old, "old"), str(dataset / "runs"), ["tool", "run_id"])
    write_run(source, "late_benign_1_recap", [1, 2])
    assert build() == {"skipped": 6, "rebuilt": 1}
    left = spark.read.schema("run_id string, reason string").parquet(str(dataset / "rejects"))
    assert left.isEmpty()

    runs = {r["run_id"]: r for r in spark.read.parquet(str(dataset / "runs")).collect()}
    attacked = runs["web_CVE-2024-0001_recap"]
    assert (attacked["node_count"], attacked["edge_count"], attacked["placeholder_node_count"], attacked["attack_window_count"]) == (4, 10, 3, 1)
    assert runs["web_CVE-2024-0001_recap_run_2"]["attack_window_count"] == 0

    summary = {r["split"]: r["run_count"] for r in pipeline.build_splits(spark, str(dataset)).collect()}
    assert summary == {"train": 3, "val": 1, "test": 3}
    index = pipeline.export_windows(spark, str(dataset), str(export), 60).first()
    assert index["edge_count"] == 4 * 20 + 10 + 2 + 2 and index["attack_edge_count"] == 2
    windows = spark.read.parquet(str(export / "windows")).filter("run_id = 'web_CVE-2024-0001_recap'").orderBy("window_index").collect()
    assert [(w["edge_count"], w["attack_edge_count"]) for w in windows] == [(4, 0), (2, 1), (2, 1), (1, 0), (1, 0)]
    assert windows[0]["file_name"] == "2024-01-01 00:00:00.000000000~2024-01-01 00:00:59.000000000"
    before = spark.read.parquet(str(export / "windows")).inputFiles()
    pipeline.export_windows(spark, str(dataset), str(export), 60)
    assert spark.read.parquet(str(export / "windows")).inputFiles() == before

    kept = pipeline.rewindow_export(spark, str(export), str(wide), 240).collect()
    assert sum(r["derived_edges"] for r in kept) == index["edge_count"]
    direct = tmp_path / "direct"
    pipeline.export_windows(spark, str(dataset), str(direct), 240)
    columns = ["run_id", "window_index", "file_name", "node_count", "edge_count", "attack_edge_count"]
    a = spark.read.parquet(str(wide / "windows")).select(columns)
    b = spark.read.parquet(str(direct / "windows")).select(columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    columns = ["tool", "aspect", "value", "n"]
    a = spark.read.parquet(str(wide / "export_vocabulary")).select(columns)
    b = spark.read.parquet(str(direct / "export_vocabulary")).select(columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == 3


def test_mender_has_no_cap_and_survives_odd_lines():
    from traceloom.sources.raw import json_mender

    mend = json_mender().func
    import pandas as pd

    bare = '{"type": "x", "v": "' + 'a" b ' * 12 + '"}'
    out = mend(pd.Series([bare, '{"id": "\\ud800", "x": NaN}', "[" * 100_000, '{"n": ' + "9" * 6_000 + "}"]))
    assert out["mended"][0] is not None and not out["readable"][0]
    assert out["readable"][1] and out["mended"][1].isascii()
    assert out["mended"][2] is None and out["mended"][3] is None
