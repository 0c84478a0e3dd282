"""Data-anchored time windows of a run.

A window opens at an edge and takes every edge less than ``width`` later; the next edge opens the next
window.  Only the distinct (run, time) pairs matter, and a window start in one aligned bucket of
``width`` is followed by a start in a later bucket, never in the same one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.times import window_name
from traceloom.operators.ordered import hot_join, lookup_join, scan
from traceloom.session import materialize

# Distinct times of one run that a single task may hold: about 100 MB in Arrow with the run name.
HOT_RUN_TIMES = 2_000_000


def _bucket(time: str, width_ns: int) -> Column:
    return F.expr(f"({time} - pmod({time}, {width_ns}L)) div {width_ns}L")


def window_starts(edges: DataFrame, width_ns: int, hot_times: int = HOT_RUN_TIMES) -> DataFrame:
    """(run_id, window_index, start_ns) of every window, as a written table.

    Runs with few distinct times are hopped through in one task each; the others by ``_contract``.
    """
    times = materialize(edges.select("run_id", "wall_time_ns").distinct(), "times")
    sizes = times.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= hot_times:
        return materialize(_hop(times, width_ns), "starts")

    hot = F.broadcast(materialize(sizes.filter(F.col("n") > hot_times).select("run_id"), "hot_runs"))
    cold = _hop(times.join(hot, "run_id", "left_anti"), width_ns)
    starts = _contract(materialize(times.join(hot, "run_id", "left_semi"), "hot_times"), width_ns, hot_times)
    ranked = scan(starts, ["run_id"], ["start_ns"], {"window_index": ("rank", None)}, hot_times)
    return materialize(cold.unionByName(ranked.select(*cold.columns)), "starts")


def _hop(times: DataFrame, width_ns: int) -> DataFrame:
    def hop(run: pa.Table) -> pa.Table:
        walls = np.sort(run["wall_time_ns"].to_numpy())
        starts, at = [], 0
        while at < len(walls):
            starts.append(walls[at])
            at = int(np.searchsorted(walls, walls[at] + width_ns, side="left"))
        columns = {
            "run_id": pa.repeat(run["run_id"][0], len(starts)),
            "window_index": pa.array(np.arange(1, len(starts) + 1)),
            "start_ns": pa.array(starts, pa.int64()),
        }
        return pa.table(columns)

    return times.groupBy("run_id").applyInArrow(hop, "run_id string, window_index bigint, start_ns bigint")


def _successors(times: DataFrame, width_ns: int) -> DataFrame:
    """(run_id, t, nxt): the first time of the run at or after t + width, null when there is none."""
    points = times.select("run_id", F.col("wall_time_ns").alias("point"), F.lit(None).cast("bigint").alias("t"))
    asks = times.select(
        "run_id", (F.col("wall_time_ns") + F.lit(width_ns)).alias("point"), F.col("wall_time_ns").alias("t")
    )
    rows = points.unionByName(asks).select(
        "run_id",
        (-F.col("point")).alias("back"),
        F.col("t").isNotNull().alias("asks"),
        "t",
        F.when(F.col("t").isNull(), F.col("point")).alias("seen"),
    )
    found = scan(rows, ["run_id"], ["back", "asks"], {"nxt": ("last", "seen")}, hot_rows=0)
    return found.filter("asks").select("run_id", "t", "nxt")


def _contract(times: DataFrame, width_ns: int, limit: int) -> DataFrame:
    """Window starts of runs too large for one task, by halving and expanding blocks of buckets.

    A level keeps, per block of 2^level buckets, the times that can be the first start in the block and,
    for each, the first start behind the block.  Two neighbouring blocks merge by one equi-join.  Times
    of the right half can be entered from outside only at their minimum, so each level shrinks.  Once a
    run has few entries its chain is followed in one task, and the levels are walked back down to add
    the starts inside the blocks.
    """
    origin = F.broadcast(materialize(times.groupBy("run_id").agg(F.min("wall_time_ns").alias("t0")), "origin"))
    level = _successors(times, width_ns).join(origin, "run_id").select(
        "run_id",
        "t",
        "nxt",
        F.expr(f"(t - t0) div {width_ns}L").alias("block"),
        F.expr(f"(nxt - t0) div {width_ns}L").alias("nxt_block"),
        "t0",
    )
    # The first bucket of a run is entered at its first time only.
    level = materialize(level.filter("block > 0 or t = t0").drop("t0"), "level")
    levels = []
    while True:
        size = level.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("block").alias("b"))
        size = size.agg(F.max("n").alias("n"), F.max("b").alias("b")).first()
        if size["n"] <= limit or size["b"] == 0:
            break
        levels.append(level)
        level = materialize(_halve(level), "level")
    starts = materialize(_follow(level), "visited")
    for lower in reversed(levels):
        inner = (
            lower.filter("block % 2 = 0 and nxt_block = block + 1")
            .join(starts.withColumnRenamed("start_ns", "t"), ["run_id", "t"], "left_semi")
            .select("run_id", F.col("nxt").alias("start_ns"))
        )
        starts = materialize(starts.unionByName(inner), "visited")
    return starts


def _halve(level: DataFrame) -> DataFrame:
    left = level.filter("block % 2 = 0")
    right = level.filter("block % 2 = 1")
    first = right.groupBy("run_id", "block").agg(F.min("t").alias("t"))
    entered = right.join(first, ["run_id", "block", "t"], "left_semi")
    step = right.select(
        "run_id",
        F.col("t").alias("nxt"),
        F.col("nxt").alias("far"),
        F.col("nxt_block").alias("far_block"),
        F.lit(True).alias("found"),
    )
    inside = left.filter("nxt_block = block + 1")
    outside = left.filter("nxt_block is null or nxt_block <> block + 1")
    hopped = hot_join(inside, step, ["run_id", "nxt"], ["t"], "inner").select(
        "run_id", "t", F.col("far").alias("nxt"), "block", F.col("far_block").alias("nxt_block")
    )
    merged = hopped.unionByName(outside).unionByName(entered)
    return merged.withColumns(
        {"block": F.expr("block div 2"), "nxt_block": F.expr("nxt_block div 2")}
    )


def _follow(level: DataFrame) -> DataFrame:
    def follow(run: pa.Table) -> pa.Table:
        run = run.sort_by("t")
        walls, jumps = run["t"].to_numpy(), run["nxt"].to_numpy()
        starts, at = [walls[0]], 0
        while jumps[at] != walls[at]:
            at = int(np.searchsorted(walls, jumps[at]))
            starts.append(walls[at])
        return pa.table({"run_id": pa.repeat(run["run_id"][0], len(starts)), "start_ns": pa.array(starts, pa.int64())})

    # The last window of a run has no successor and points at itself.
    rows = level.select("run_id", "t", F.coalesce("nxt", "t").alias("nxt"))
    return rows.groupBy("run_id").applyInArrow(follow, "run_id string, start_ns bigint")


def assign_windows(edges: DataFrame, starts: DataFrame, width_ns: int, identity: list[str]) -> DataFrame:
    """Add window_index and start_ns to every edge.

    A start lies less than ``width`` before its edges, hence in the edge's own aligned bucket or the one
    before, so an equi-join on (run, bucket) with at most two candidates finds it.
    """
    buckets = F.array(_bucket("start_ns", width_ns), _bucket("start_ns", width_ns) + 1)
    lookup = starts.select("run_id", "window_index", "start_ns", F.explode(buckets).alias("_bucket"))
    inside = (F.col("wall_time_ns") >= F.col("start_ns")) & (
        F.col("wall_time_ns") < F.col("start_ns") + F.lit(width_ns)
    )
    keyed = edges.withColumn("_bucket", _bucket("wall_time_ns", width_ns))
    return lookup_join(keyed, lookup, ["run_id", "_bucket"], identity, "inner", inside).drop("_bucket")


def window_edges(edges: DataFrame, width_ns: int, identity: list[str] | None = None) -> DataFrame:
    """Greedy windows of every run and the window of every edge."""
    edges = edges.drop("window_index", "start_ns")
    return assign_windows(edges, window_starts(edges, width_ns), width_ns, identity or ["raw_edge_id", "line_number"])


def rewindow(windowed: DataFrame, source_ns: int, target_ns: int, identity: list[str] | None = None) -> DataFrame:
    """Cut stored windows again to a larger size; edges and their labels are kept as they are."""
    if target_ns <= source_ns:
        raise ValueError(f"target window {target_ns} must be larger than the source window {source_ns}")
    return window_edges(windowed, target_ns, identity)


def window_stats(windowed: DataFrame) -> DataFrame:
    """Distinct nodes, edges, attack edges, flag, span and name per window; expects y, src, dst."""
    ends = windowed.select(
        "run_id",
        "window_index",
        "start_ns",
        "wall_time_ns",
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(1).alias("edge"), F.col("y").alias("y")),
                F.struct(F.col("dst").alias("node"), F.lit(0).alias("edge"), F.lit(0).alias("y")),
            )
        ).alias("e"),
    )
    return (
        ends.groupBy("run_id", "window_index", "start_ns")
        .agg(
            F.count_distinct("e.node").alias("node_count"),
            F.sum("e.edge").alias("edge_count"),
            F.sum("e.y").alias("attack_edge_count"),
            F.max("wall_time_ns").alias("end_ns"),
        )
        .withColumn("y", (F.col("attack_edge_count") > 0).cast("int"))
        .withColumn("file_name", window_name(F.col("start_ns"), F.col("end_ns")))
    )


def run_rollup(stats: DataFrame) -> DataFrame:
    """Per run: windows, attack windows and sums.  node_count adds up windows, so nodes count repeatedly."""
    return stats.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("window_count"),
        F.sum("y").alias("attack_window_count"),
        F.sum("node_count").alias("node_count"),
        F.sum("edge_count").alias("edge_count"),
        F.sum("attack_edge_count").alias("attack_edge_count"),
    )


def export_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count(F.lit(1)).alias("window_count"),
        F.sum("edge_count").alias("edge_count"),
        F.sum("attack_edge_count").alias("attack_edge_count"),
    )


def parallel_edge_keys(windowed: DataFrame, order: list[str]) -> DataFrame:
    """Number parallel edges of the same pair inside a window 0, 1, 2, … in edge order."""
    ranked = scan(windowed, ["run_id", "window_index", "src", "dst"], order, {"edge_key": ("rank", None)})
    return ranked.withColumn("edge_key", F.col("edge_key") - 1)


def tumbling_windows(edges: DataFrame, width_ns: int) -> DataFrame:
    """Epoch-aligned windows, the cheap counterpart of the anchored ones."""
    start = (_bucket("wall_time_ns", width_ns) * F.lit(width_ns)).alias("start_ns")
    return edges.groupBy("run_id", start).agg(F.count(F.lit(1)).alias("edge_count"))
