"""Attack periods: which label windows belong to a run, and which edges fall inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.names import attack_scenario
from traceloom.functions.times import NS_PER_SECOND, event_end_ns, label_window_ns, overlaps
from traceloom.operators.ordered import BROADCAST_ROWS, lookup_join, scan
from traceloom.session import materialize

# Label windows of one run and bucket that are compared with an edge one by one.
FEW_WINDOWS = 64
BUCKET_NS = 600 * NS_PER_SECOND


def _bucket(time: Column) -> Column:
    width = F.lit(BUCKET_NS)
    return F.call_function("div", time - F.pmod(time, width), width)


def label_windows(labels: DataFrame) -> DataFrame:
    """Start and end of every label row in nanoseconds."""
    tool = F.col("tool")
    return labels.withColumns(
        {"start_ns": label_window_ns(tool, "cve_start"), "end_ns": label_window_ns(tool, "cve_end")}
    )


def run_time_range(edges: DataFrame) -> DataFrame:
    end = event_end_ns(F.col("wall_time_ns"), F.col("wall_time_precision_ns"))
    return edges.groupBy("run_id").agg(
        F.min("wall_time_ns").alias("range_start_ns"), F.max(end).alias("range_end_ns")
    )


def attack_windows(runs: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Label windows (scenario, cve, tool, start_ns, end_ns) that overlap their run.

    Benign runs have none, so their edges are not read for the ranges.
    """
    named = runs.filter("kind <> 'benign'").withColumn("a", attack_scenario(F.col("scenario")))
    named = named.filter("a is not null").select(
        "run_id", F.col("a.name").alias("scenario"), F.col("a.cve").alias("cve"), "tool"
    )
    ranges = run_time_range(lookup_join(edges, named.select("run_id"), ["run_id"], ["line_number"], "left_semi"))
    ranged = materialize(named.join(ranges, "run_id"), "ranges")
    overlap = overlaps(F.col("start_ns"), F.col("end_ns"), F.col("range_start_ns"), F.col("range_end_ns"))
    matched = lookup_join(labels, ranged, ["scenario", "cve", "tool"], ["start_ns", "end_ns"], "inner", overlap)
    return matched.select("run_id", "scenario", "cve", "tool", "start_ns", "end_ns")


def window_arrays(windows: DataFrame, reach_ns: int = NS_PER_SECOND) -> DataFrame:
    """Windows as one array per (run_id, bucket of the edge's time), for edges of a precision of up to ``reach_ns``.

    A window is listed in every bucket in which an edge that overlaps it can start.
    """
    first, last = _bucket(F.col("start_ns") - F.lit(reach_ns)), _bucket(F.col("end_ns"))
    reaches = F.col("end_ns") >= F.col("start_ns") - F.lit(reach_ns)
    listed = windows.filter(reaches).select(
        "run_id", F.struct("start_ns", "end_ns").alias("w"), F.explode(F.sequence(first, last)).alias("_bucket")
    )
    return listed.groupBy("run_id", "_bucket").agg(F.collect_list("w").alias("_w"))


def label_by_arrays(edges: DataFrame, arrays: DataFrame) -> DataFrame:
    """Add ``y`` with the arrays of ``window_arrays``; also for streams.  The planner picks the join by size."""
    end = event_end_ns(F.col("wall_time_ns"), F.col("wall_time_precision_ns"))
    hit = F.exists("_w", lambda w: overlaps(F.col("wall_time_ns"), end, w["start_ns"], w["end_ns"]))
    joined = edges.withColumn("_bucket", _bucket(F.col("wall_time_ns"))).join(arrays, ["run_id", "_bucket"], "left")
    return joined.withColumn("y", F.coalesce(hit, F.lit(False)).cast("int")).drop("_w", "_bucket")


def label_edges(
    edges: DataFrame, windows: DataFrame, identity: list[str], few: int = FEW_WINDOWS
) -> DataFrame:
    """Add ``y``: 1 when the edge's interval overlaps any attack window of its run.

    With few windows per run and bucket, listed as far back as the coarsest edge reaches, an edge tests them in place.
    Both ways give the same labels.  Otherwise edges and windows are scanned in time order: an edge ending at ``b`` and starting at ``a`` overlaps some window exactly when the
    latest end among windows starting at or before ``b`` is at least ``a``.
    """
    windows = materialize(windows.select("run_id", "start_ns", "end_ns").distinct(), "attacks")
    reach = edges.agg(F.max("wall_time_precision_ns")).first()[0] or 1
    span = F.call_function("div", F.col("end_ns") - F.col("start_ns") + F.lit(reach), F.lit(BUCKET_NS)) + 2
    listings = windows.agg(F.sum(F.greatest(span, F.lit(0)))).first()[0] or 0
    if listings <= BROADCAST_ROWS:
        arrays = materialize(window_arrays(windows, reach), "arrays")
        if (arrays.agg(F.max(F.size("_w"))).first()[0] or 0) <= few:
            return label_by_arrays(edges, F.broadcast(arrays))
    return _label_by_scan(edges, windows, identity)


def _label_by_scan(edges: DataFrame, windows: DataFrame, identity: list[str]) -> DataFrame:
    attacked = materialize(windows.select("run_id").distinct(), "attacked")
    quiet = lookup_join(edges, attacked, ["run_id"], identity, "left_anti").withColumn("y", F.lit(0))
    busy = lookup_join(edges, attacked, ["run_id"], identity, "left_semi")
    end = event_end_ns(F.col("wall_time_ns"), F.col("wall_time_precision_ns"))
    asks = busy.select("*", end.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_end"))
    opens = windows.select(
        "run_id", F.col("start_ns").alias("_at"), F.lit(0).alias("_kind"), F.col("end_ns").alias("_end")
    )
    rows = asks.unionByName(opens, allowMissingColumns=True)
    # Rows that tie here get the same running value: windows come before edges of the same time, and
    # edges carry no end.
    scanned = scan(rows, ["run_id"], ["_at", "_kind", *identity], {"_latest": ("max", "_end")})
    hit = F.coalesce(F.col("_latest") >= F.col("wall_time_ns"), F.lit(False)).cast("int")
    loud = scanned.filter("_kind = 1").withColumn("y", hit).select(*quiet.columns)
    return quiet.unionByName(loud)
