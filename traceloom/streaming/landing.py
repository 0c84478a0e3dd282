"""Edges of a stream landed in versioned tables: on-time and late edges as rows, and the windows that are complete.

Every micro-batch is one commit (``snapshots``) tagged with the stream and the number of the batch, so that all tables move together and a
batch that runs again after a failure changes nothing.  An edge is late when its run was already seen ``delay_ns`` past it in an earlier batch.
Late edges keep every column, beside the time their run had reached.

Tables: ``on_time`` and ``late_edges`` (added to), ``newest`` (one row per run), ``windows`` (complete windows, added to) and ``pending``, the times and
counts not yet in a complete window.  Windows are cut by the batch operators, which split a run of any size; greedy windows start anew at the first time
that is left, so the pending times alone decide how they go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators import windows
from traceloom.operators.ordered import lookup_join
from traceloom.session import materialize
from traceloom.sources import snapshots
from traceloom.streaming.ingest import landed, stream_id

_NEWEST = "run_id string, newest_ns bigint"
_PENDING = "run_id string, wall_time_ns bigint, n bigint"


def _stored(store, table: str, schema: str, spark: SparkSession) -> DataFrame:
    return store.read(table) if store.has(table) else spark.createDataFrame([], schema)


def cut_pending(pending: DataFrame, newest: DataFrame, width_ns: int, delay_ns: int | None) -> tuple[DataFrame, DataFrame]:
    """Complete windows (run_id, start_ns, end_ns, edge_count) of pending times, and the times that are left.

    A window is complete when no edge that is still on time can belong to it; without a delay all are.
    """
    starts = windows.window_starts(pending, width_ns)
    cut = materialize(windows.assign_windows(pending, starts, width_ns, ["wall_time_ns"]), "cut")
    if delay_ns is None:
        complete = F.lit(True)
    else:
        cut = lookup_join(cut, newest, ["run_id"], ["wall_time_ns"], "left")
        complete = F.col("start_ns") + F.lit(width_ns) <= F.col("newest_ns") - F.lit(delay_ns)
    closed = cut.filter(complete).groupBy("run_id", "start_ns").agg(F.max("wall_time_ns").alias("end_ns"), F.sum("n").alias("edge_count"))
    return closed.select("run_id", "start_ns", "end_ns", "edge_count"), cut.filter(~complete).select("run_id", "wall_time_ns", "n")


def land_batch(arrived: DataFrame, store, width_ns: int, delay_ns: int, **note) -> None:
    """One commit for the edges of ``arrived`` (run_id, wall_time_ns and any other columns)."""
    spark = arrived.sparkSession
    edges = materialize(arrived, "landed")
    before = materialize(_stored(store, "newest", _NEWEST, spark), "newest")
    identity = [c for c in edges.columns if c != "run_id"]
    seen = lookup_join(edges, before.withColumnRenamed("newest_ns", "reached_ns"), ["run_id"], identity, "left")
    late = F.coalesce(F.col("wall_time_ns") < F.col("reached_ns") - F.lit(delay_ns), F.lit(False))
    commit = store.begin()
    commit.write("late_edges", seen.filter(late), [])
    on_time = commit.write("on_time", seen.filter(~late).drop("reached_ns"), [])
    fresh = edges.groupBy("run_id").agg(F.max("wall_time_ns").alias("newest_ns"))
    newest = commit.write("newest", before.unionByName(fresh).groupBy("run_id").agg(F.max("newest_ns").alias("newest_ns")), [], overwrite=True)
    counted = on_time.groupBy("run_id", "wall_time_ns").agg(F.count(F.lit(1)).alias("n"))
    pending = _stored(store, "pending", _PENDING, spark).unionByName(counted).groupBy("run_id", "wall_time_ns").agg(F.sum("n").alias("n"))
    closed, left = cut_pending(materialize(pending, "pending"), newest, width_ns, delay_ns)
    commit.write("windows", closed, [])
    commit.write("pending", left, [], overwrite=True)
    commit.publish(**note)


def land_edges(edges: DataFrame, out_dir: str, checkpoint: str, width_ns: int, delay_ns: int):
    """A writer of a stream of edges into a versioned folder; start it with the trigger of your choice."""

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = stream_id(spark, checkpoint)
        if number > landed(spark, out_dir, stream):
            land_batch(batch, snapshots.open_store(spark, out_dir), width_ns, delay_ns, job="land", stream=stream, batch=number)

    return edges.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)


def close_windows(spark: SparkSession, out_dir: str, width_ns: int) -> None:
    """At the end of the stream: what is pending becomes windows."""
    store = snapshots.open_store(spark, out_dir)
    pending = store.read("pending")
    if pending.isEmpty():
        return
    closed, left = cut_pending(pending, store.read("newest"), width_ns, None)
    commit = store.begin()
    commit.write("windows", closed, [])
    commit.write("pending", left, [], overwrite=True)
    commit.publish(job="close")
