"""Streaming counterparts: data-anchored windows, attack labels, and the line audit of arriving captures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from traceloom.functions.names import plain_path
from traceloom.functions.times import NS_PER_SECOND
from traceloom.operators.labels import label_by_arrays, window_arrays
from traceloom.session import materialize
from traceloom.sources.raw import mend_lines, with_tier

_STATE = "walls binary, counts binary, start bigint, last bigint, edges bigint, top bigint"
_OUTPUT = "run_id string, kind string, start_ns bigint, end_ns bigint, edge_count bigint"


def stream_windows(edges: DataFrame, width_ns: int, delay_ns: int, idle: str = "1 hour") -> DataFrame:
    """Anchored windows of a stream of edges (run_id, wall_time_ns).

    Edges may come up to ``delay_ns`` out of order within their run.  A window is given out (kind ``window``)
    when the run's newest time less the delay has passed its end, or after ``idle`` without edges.  Edges
    that come later than that are given out one row per time (kind ``late``), never dropped.  The state of a
    run holds its open window and the distinct times inside the delay.
    """

    def fold(key, chunks, state: GroupState):
        out = []
        if state.exists:
            walls, counts, start, last, edges_, top = state.get
            walls, counts = np.frombuffer(walls, "int64"), np.frombuffer(counts, "int64")
        else:
            walls = counts = np.empty(0, "int64")
            start = last = top = -1
            edges_ = 0

        if state.hasTimedOut:
            ready, rest = np.ones(len(walls), bool), False
        else:
            rest = True
            sealed = top - delay_ns if top >= 0 else None
            parts = [c["wall_time_ns"].value_counts() for c in chunks]
            fresh = pd.concat(parts).groupby(level=0).sum()
            if sealed is not None:
                for wall, n in fresh[fresh.index < sealed].items():
                    out.append(("late", int(wall), int(wall), int(n)))
                fresh = fresh[fresh.index >= sealed]
            held = pd.concat([pd.Series(counts, index=walls), fresh]).groupby(level=0).sum().sort_index()
            walls, counts = held.index.to_numpy("int64"), held.to_numpy("int64")
            if len(walls):
                top = max(top, int(walls[-1]))
            ready = walls < top - delay_ns

        at, stop = 0, int(ready.sum())
        while at < stop:
            if edges_ == 0:
                start = int(walls[at])
            reach = min(stop, int(np.searchsorted(walls, start + width_ns)))
            if reach > at:
                edges_ += int(counts[at:reach].sum())
                last = int(walls[reach - 1])
                at = reach
            if at < stop:
                out.append(("window", start, last, edges_))
                edges_ = 0
        if edges_ and (not rest or top - delay_ns >= start + width_ns):
            out.append(("window", start, last, edges_))
            edges_ = 0
        if rest:
            state.update((walls[stop:].tobytes(), counts[stop:].tobytes(), start, last, edges_, top))
            state.setTimeoutDuration(idle_ms)
        else:
            state.remove()
        frame = pd.DataFrame(out, columns=["kind", "start_ns", "end_ns", "edge_count"])
        frame.insert(0, "run_id", key[0])
        yield frame

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return edges.select("run_id", "wall_time_ns").groupBy("run_id").applyInPandasWithState(
        fold, _OUTPUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def stream_labels(edges: DataFrame, windows: DataFrame, reach_ns: int = NS_PER_SECOND) -> DataFrame:
    """Attack labels of a stream of edges, of a precision of up to ``reach_ns``, against a table of windows."""
    return label_by_arrays(edges, materialize(window_arrays(windows.distinct(), reach_ns), "arrays"))


def stream_tumbling(edges: DataFrame, width: str, watermark: str) -> DataFrame:
    """Epoch-aligned windows of a stream: a cheap baseline beside the anchored ones."""
    timed = edges.withColumn("at", F.timestamp_micros(F.call_function("div", F.col("wall_time_ns"), F.lit(1000))))
    return (
        timed.withWatermark("at", watermark)
        .groupBy("run_id", F.window("at", width))
        .agg(F.count(F.lit(1)).alias("edge_count"))
        .select("run_id", F.col("window.start").alias("start"), "edge_count")
    )


def stream_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    lines = spark.readStream.option("lineSep", "\n").option("pathGlobFilter", glob).text(path)
    return lines.select(plain_path(F.col("_metadata.file_path")).alias("file_path"), "value")


def stream_audit(lines: DataFrame) -> DataFrame:
    """Running count of lines per file and decoding tier (update or complete mode)."""
    decoded = with_tier(lines).select("file_path", "tier", "text", "valid_utf8")
    fine = decoded.filter("tier not in ('blank', 'whitespace')").select("file_path", "tier")
    # Two reads of the stream, so that only lines no decoder could read go through Python.
    mended = mend_lines(decoded.filter("tier is null")).select("file_path", "tier")
    return fine.unionByName(mended).groupBy("file_path", "tier").agg(F.count(F.lit(1)).alias("lines"))
