"""Streams with state: windows handed on from bucket to bucket, landed edges, labels of two streams.  All against the batch operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.operators import labels, windows
from traceloom.sources import snapshots
from traceloom.streaming import landing
from traceloom.streaming import labels as L
from traceloom.streaming import windows as W

S = 10**9
EDGE = "run_id string, wall_time_ns bigint, wall_time_precision_ns bigint, line_number bigint, src string, dst string"
LABEL = "run_id string, start_ns bigint, end_ns bigint"


def feed(spark, folder, batches, schema, first=0):
    for n, rows in enumerate(batches, first):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/batch={n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def edge(run, wall, n, precision=1):
    return run, wall, precision, n, f"p{n % 7}", f"o{n % 5}"


def shuffled(rng, runs, per_run, span, disorder, low=0):
    """Edges in an order that is at most ``disorder`` seconds off; run a has most of them."""
    rows = []
    for k, run in enumerate(runs):
        walls = sorted(rng.randint(low, span * S) for _ in range(per_run if k else 4 * per_run))
        rows += [edge(run, w, n) for n, w in enumerate(walls)]
    return sorted(rows, key=lambda r: r[1] + rng.randint(0, disorder * S))


def batch_windows(spark, rows, width):
    edges = spark.createDataFrame(rows, EDGE).withColumn("y", F.lit(0))
    stats = windows.window_stats(windows.window_edges(edges, width, ["line_number"])).collect()
    return {(r["run_id"], r["start_ns"], r["end_ns"], r["edge_count"]) for r in stats}


def run_to_end(frame, out, checkpoint):
    query = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_cut_goes_on_from_the_open_window():
    rng = np.random.default_rng(1)
    for _ in range(200):
        times = np.unique(rng.integers(0, 400, size=40))
        counts = rng.integers(1, 5, size=len(times))
        whole, last = W.cut(times, counts, 30, None)
        got, window = [], None
        for part in np.array_split(np.arange(len(times)), rng.integers(1, 9)):
            closed, window = W.cut(times[part], counts[part], 30, window)
            got += closed
        assert got == whole and window == last and sum(w[2] for w in [*whole, last]) == counts.sum()


@pytest.mark.parametrize("bucket", [None, 60 * S, 500 * S])
def test_window_chain_equals_batch(spark, tmp_path, bucket):
    rng = random.Random(5)
    rows = shuffled(rng, "abc", 60, 3000, 40)
    flush = [edge("z", 10**6 * S, 0)]
    half = len(rows) // 2
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for n, part in enumerate(([rows[:150], rows[150:half]], [rows[half:], flush])):  # stopped and started again in between
        stream = feed(spark, tmp_path / "in", part, EDGE, 2 * n)
        run_to_end(W.stream_window_chain(stream, 60 * S, "50 seconds", bucket), out, checkpoint)
    found = spark.read.parquet(out).filter("run_id <> 'z'").collect()
    assert len(found) == len({tuple(r) for r in found}) and {tuple(r) for r in found} == batch_windows(spark, rows, 60 * S)


def test_run_is_spread_over_tasks(spark, tmp_path):
    """The edges of one run are dealt by bucket and time, not by run."""
    stream = feed(spark, tmp_path / "in", [[edge("a", n * S, n) for n in range(50)]], EDGE)
    plan = W.stream_window_chain(stream, 60 * S, "50 seconds")._jdf.queryExecution().analyzed().toString()
    assert "Aggregate [run_id" in plan and plan.count("window") > 2 and "wall_time_ns" in plan.split("Aggregate [run_id")[2]


@pytest.mark.parametrize("dies", [None, "before", "after"])
def test_every_edge_lands_once(spark, tmp_path, monkeypatch, dies):
    rng = random.Random(9)
    rows = shuffled(rng, "abc", 40, 2000, 30, -50 * S)
    rng.shuffle(late := [edge("a", rng.randint(0, 500 * S), 10_000 + n) for n in range(25)])
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third] + [edge("d", 5 * S, 0)], late[:12] + rows[2 * third :], late[12:]]
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")
    snapshots.create(spark, root)
    stream = feed(spark, tmp_path / "in", batches, EDGE)
    publish, calls = snapshots.VersionedCommit.publish, []

    def dying(self, **note):
        calls.append(1)
        if len(calls) in (2, 4) and dies == "before":
            raise RuntimeError("killed")
        version = publish(self, **note)
        if len(calls) in (2, 4) and dies == "after":
            raise RuntimeError("killed")
        return version

    monkeypatch.setattr(snapshots.VersionedCommit, "publish", dying)
    for _ in range(3):
        query = landing.land_edges(stream, root, checkpoint, 60 * S, 40 * S).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            break
        except Exception as error:  # noqa: BLE001
            assert dies and "killed" in str(error)
    store = snapshots.open_store(spark, root)
    columns = EDGE.replace(" string", "").replace(" bigint", "").split(", ")
    on_time = [tuple(r) for r in store.read("on_time").select(columns).collect()]
    tardy = [tuple(r) for r in store.read("late_edges").select(columns).collect()]
    assert sorted(on_time + tardy) == sorted(sum(batches, []))
    # Late by hand: the run was 40 s past the edge in an earlier batch.
    newest, expected = {}, []
    for batch in batches:
        expected += [r for r in batch if r[0] in newest and r[1] < newest[r[0]] - 40 * S]
        for r in batch:
            newest[r[0]] = max(newest.get(r[0], r[1]), r[1])
    assert sorted(tardy) == sorted(expected) and len(tardy) > 10
    assert all(r["reached_ns"] - 40 * S > r["wall_time_ns"] for r in store.read("late_edges").collect())
    landing.close_windows(spark, root, 60 * S)
    landing.close_windows(spark, root, 60 * S)
    store = snapshots.open_store(spark, root)
    found = [tuple(r) for r in store.read("windows").select("run_id", "start_ns", "end_ns", "edge_count").collect()]
    assert len(found) == len(set(found)) and set(found) == batch_windows(spark, on_time, 60 * S)
    assert store.read("pending").isEmpty()


def test_pieces_cover_their_window(spark):
    rows = [("a", 5, 5), ("d", -7, 28), ("b", 9, 10), ("c", 20, 10)]
    pieces = L.label_pieces(spark.createDataFrame(rows, LABEL), 3, 10).collect()
    for run, start, end in rows:
        own = {(p["start_ns"], p["end_ns"]) for p in pieces if p["run_id"] == run}
        assert sorted(t for a, b in own for t in range(a, b + 1)) == list(range(start, end + 1))
    # Every bucket with a time t such that [t, t + 2] meets the piece.
    for p in pieces:
        assert p["bucket"] in {t // 10 for t in range(p["start_ns"] - 3, p["end_ns"] + 1)}


@pytest.mark.parametrize("order", ["labels first", "edges first", "mixed"])
def test_labels_in_any_order_of_arrival(spark, tmp_path, order):
    rng = random.Random(17)
    edges = [edge(run, w * S // 4, n, S) for run in "ab" for n, w in enumerate(sorted(rng.sample(range(8000), 150)))]
    rng.shuffle(edges)
    attacks = [("a", 100 * S + 5, 180 * S), ("a", 150 * S, 160 * S), ("a", 900 * S, 1700 * S), ("b", 40 * S, 40 * S), ("b", 60 * S, 50 * S), ("c", 0, 9)]
    rng.shuffle(attacks)
    end = 10**6 * S
    flush_edges, flush_labels = [edge("z", end, 0, S)], [("z", end, end)]
    quiet_edge, quiet_label = [edge("y", 1, 0, S)], [("y", 0, 1)]
    if order == "labels first":
        left, right = [quiet_edge, quiet_edge[:0], edges[:200], edges[200:]], [attacks[:3], attacks[3:], quiet_label]
    elif order == "edges first":
        left, right = [edges[:150], edges[150:]], [quiet_label, quiet_label[:0], attacks[:2], attacks[2:]]
    else:
        left, right = [edges[:100], edges[100:220], edges[220:]], [attacks[:1], attacks[1:4], attacks[4:]]
    left, right = [b for b in left if b] + [flush_edges], [b for b in right if b] + [flush_labels]
    streams = feed(spark, tmp_path / "edges", left, EDGE), feed(spark, tmp_path / "labels", right, LABEL)
    out = str(tmp_path / "out")
    run_to_end(L.stream_interval_labels(*streams, "3000 seconds", ["line_number"], S), out, str(tmp_path / "checkpoint"))
    found = spark.read.parquet(out).filter("run_id in ('a', 'b')").select("run_id", "line_number", "y").collect()
    table = spark.createDataFrame(edges, EDGE)
    expected = labels.label_edges(table, spark.createDataFrame(attacks, LABEL), ["line_number"]).select("run_id", "line_number", "y").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected)) and sum(r["y"] for r in expected) > 20
