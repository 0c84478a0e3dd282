"""Data-anchored windows of a stream, with the work of a run spread over its buckets of time.

Edges are counted per (run, bucket, time) and the times of a bucket are gathered, each a state of its own in the state store; a bucket
comes out when the watermark passes its end.  Only the distinct times and their counts go on to the state of the run, which holds nothing but the open window:
it follows the buckets in order, hands the window's start on from one to the next, and closes the last window by an event-time timer.
So a run with a third of all edges is spread over many tasks, and what one task does for a run is as much as its distinct times.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOW = "run_id string, start_ns bigint, end_ns bigint, edge_count bigint"
_OPEN = "start bigint, last bigint, edges bigint"
_MS = 1_000_000


def event_time(column: str = "wall_time_ns"):
    """Nanoseconds as an event time; Spark's are microseconds, so this only places an edge in its bucket."""
    return F.timestamp_micros(F.call_function("div", F.col(column) - F.pmod(F.col(column), F.lit(1000)), F.lit(1000)))


def cut(times: np.ndarray, counts: np.ndarray, width_ns: int, window: tuple[int, int, int] | None):
    """Windows (start, last, edges) closed by sorted times, and the one left open, after the open ``window`` handed on."""
    closed, at = [], 0
    upto = np.append(0, np.cumsum(counts))
    while at < len(times):
        if window is not None and times[at] >= window[0] + width_ns:
            closed.append(window)
            window = None
        start = int(times[at]) if window is None else window[0]
        reach = int(np.searchsorted(times, start + width_ns))
        edges = int(upto[reach] - upto[at]) + (0 if window is None else window[2])
        window, at = (start, int(times[reach - 1]), edges), reach
    return closed, window


class _Chain(StatefulProcessor):
    """The open window of a run."""

    def __init__(self, width_ns: int, bucket_ns: int):
        self.width_ns, self.bucket_ns = width_ns, bucket_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def _due(self, start: int) -> int:
        """When every bucket that can hold a time of the window has come out, in milliseconds."""
        return -(-(start + self.width_ns + self.bucket_ns) // _MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = [(times, counts) for frame in rows for times, counts in zip(frame["times"], frame["counts"], strict=True)]
        times = np.concatenate([np.asarray(t, np.int64) for t, _ in seen])
        counts = np.concatenate([np.asarray(c, np.int64) for _, c in seen])
        order = np.argsort(times)
        window = tuple(self.open.get()) if self.open.exists() else None
        closed, left = cut(times[order], counts[order], self.width_ns, window)
        if window is None or left[0] != window[0]:
            self.handle.registerTimer(self._due(left[0]))
        self.open.update(left)
        yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer of a window that later times have closed already finds another one open.
        if self.open.exists() and self._due((window := tuple(self.open.get()))[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
            yield self._rows(key, [window])

    def _rows(self, key, windows) -> pd.DataFrame:
        frame = pd.DataFrame(windows, columns=["start_ns", "end_ns", "edge_count"], dtype="int64")
        frame.insert(0, "run_id", key[0])
        return frame

    def close(self) -> None:
        pass


def stream_window_chain(edges: DataFrame, width_ns: int, delay: str, bucket_ns: int | None = None) -> DataFrame:
    """Anchored windows (run_id, start_ns, end_ns, edge_count) of a stream of edges (run_id, wall_time_ns), in append mode.

    Edges may come ``delay`` behind the newest time of the stream, and not from before 1970, where Spark's watermarks begin; windows then
    equal those of the batch job.  Later ones are not counted here; ``landing.land_edges`` keeps them.  ``bucket_ns`` (a sixteenth of the width if not given) is what one state holds of a run.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    edges.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    micros = max(1, (bucket_ns or width_ns // 16) // 1000)
    timed = edges.select("run_id", "wall_time_ns", event_time().alias("at")).withWatermark("at", delay)
    counted = timed.groupBy("run_id", F.window("at", f"{micros} microseconds"), "wall_time_ns").agg(F.count(F.lit(1)).alias("n"))
    gathered = counted.groupBy("run_id", "window").agg(F.collect_list(F.struct("wall_time_ns", "n")).alias("seen"))
    buckets = gathered.select("run_id", "window", F.col("seen.wall_time_ns").alias("times"), F.col("seen.n").alias("counts"))
    return buckets.groupBy("run_id").transformWithStateInPandas(_Chain(width_ns, micros * 1000), WINDOW, "Append", "EventTime")
