import json
import random
import time

from pyspark.sql import functions as F

from traceloom.operators import labels, windows
from traceloom.streaming import captures

EDGE = "run_id string, wall_time_ns bigint, wall_time_precision_ns bigint, line_number bigint"


def feed(spark, folder, batches):
    """One Parquet folder per micro-batch, read in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, EDGE).coalesce(1).write.parquet(f"{folder}/batch={n}")
    return spark.readStream.schema(EDGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def drain(df, name, mode="append", rows=0, seconds=60):
    """Run until ``rows`` input rows are through.  (With processing-time timeouts there is always a next batch
    to run, so waiting for the end of the input would never return.)"""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    deadline = time.time() + seconds
    try:
        while time.time() < deadline:
            if query.exception():
                raise query.exception()
            if sum(p["numInputRows"] for p in query.recentProgress) >= rows:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows, flush = [], []
    for run in ("a", "b", "c"):
        walls = sorted(rng.randint(0, 3000) for _ in range(120))
        rows += [(run, w, 1, n) for n, w in enumerate(walls)]
        flush.append((run, 10**6, 1, 10**6))
    rows.sort(key=lambda r: r[1] + rng.randint(0, 40))  # at most 40 out of order
    batches = [rows[n : n + 60] for n in range(0, len(rows), 60)] + [flush]
    out = drain(captures.stream_windows(feed(spark, tmp_path / "in", batches), 60, 50), "anchored", rows=len(rows) + len(flush))
    got = {(r["run_id"], r["start_ns"], r["end_ns"], r["edge_count"]) for r in out.filter("kind = 'window'").collect()}
    edges = spark.createDataFrame(rows, EDGE).withColumns({"src": F.lit("p"), "dst": F.lit("o"), "y": F.lit(0)})
    stats = windows.window_stats(windows.window_edges(edges, 60, ["line_number"])).collect()
    assert got == {(r["run_id"], r["start_ns"], r["end_ns"], r["edge_count"]) for r in stats}
    assert out.filter("kind = 'late'").isEmpty()


def test_late_edges_are_kept(spark, tmp_path):
    batches = [[("a", 10, 1, 1), ("a", 500, 1, 2)], [("a", 20, 1, 3), ("a", 480, 1, 4)], [("a", 5000, 1, 5)]]
    out = drain(captures.stream_windows(feed(spark, tmp_path / "in", batches), 60, 50), "late", rows=5).collect()
    assert {(r["kind"], r["start_ns"], r["end_ns"], r["edge_count"]) for r in out} == {
        ("window", 10, 10, 1), ("late", 20, 20, 1), ("window", 480, 500, 2)
    }


def test_stream_labels(spark, tmp_path):
    second = 10**9
    rows = [("a", n * second, second, n) for n in range(50)]
    attacks = spark.createDataFrame([("a", 10 * second + 5, 12 * second)], "run_id string, start_ns bigint, end_ns bigint")
    stream = captures.stream_labels(feed(spark, tmp_path / "in", [rows[:30], rows[30:]]), attacks)
    got = {r["line_number"] for r in drain(stream, "labelled", rows=50).filter("y = 1").collect()}
    batch = labels.label_edges(spark.createDataFrame(rows, EDGE), attacks, ["line_number"]).filter("y = 1")
    assert got == {r["line_number"] for r in batch.collect()} == {10, 11, 12}


def test_stream_audit(spark, tmp_path):
    lines = [json.dumps({"id": n}) for n in range(5)] + ["", "[1]", '{"id":"a"b"}', '{"id": NaN}', '{"id"']
    (tmp_path / "x_recap.jsonl").write_text("\n".join(lines))
    out = drain(captures.stream_audit(captures.stream_lines(spark, str(tmp_path))), "audit", "complete", rows=10)
    assert {r["tier"]: r["lines"] for r in out.collect()} == {"strict_ok": 6, "unrepaired": 2, "repairable_escape_quotes": 1}


def test_tumbling_stream(spark, tmp_path):
    minute = 60 * 10**9
    rows = [("a", n * minute // 2, 1, n) for n in range(8)]
    stream = captures.stream_tumbling(feed(spark, tmp_path / "in", [rows]), "1 minute", "1 minute")
    assert [r["edge_count"] for r in drain(stream, "tumbling", "complete", rows=8).collect()] == [2, 2, 2, 2]
