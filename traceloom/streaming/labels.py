"""Attack labels of a stream of edges from a stream of label windows, whichever of the two comes first.

A stream-stream join: both sides wait in the state store, keyed by (run, bucket of time), and leave it when the watermark says that nothing
can match them any more.  Edges that a window marks come out at once; edges that none marks come out when their state expires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.times import NS_PER_SECOND, event_end_ns, overlaps
from traceloom.streaming.windows import ROCKSDB, event_time

#: Label windows are cut into pieces of at most this length, which bounds how long an edge waits for them.
PIECE_NS = 600 * NS_PER_SECOND


def _bucket(time, width_ns: int):
    return F.call_function("div", time - F.pmod(time, F.lit(width_ns)), F.lit(width_ns))


def label_pieces(windows: DataFrame, reach_ns: int, piece_ns: int = PIECE_NS) -> DataFrame:
    """Windows (run_id, start_ns, end_ns) cut at the borders of buckets, each piece listed in every bucket in which an edge that overlaps it can start.

    Windows that end before they start have no pieces.
    """
    whole = windows.select("run_id", "start_ns", "end_ns").filter("end_ns >= start_ns")
    cut = whole.withColumn("b", F.explode(F.sequence(_bucket(F.col("start_ns"), piece_ns), _bucket(F.col("end_ns"), piece_ns))))
    first, last = F.col("b") * F.lit(piece_ns), (F.col("b") + 1) * F.lit(piece_ns) - 1
    pieces = cut.select("run_id", F.greatest("start_ns", first).alias("start_ns"), F.least("end_ns", last).alias("end_ns"))
    held = F.sequence(_bucket(F.col("start_ns") - F.lit(reach_ns), piece_ns), _bucket(F.col("end_ns"), piece_ns))
    return pieces.select("*", F.explode(held).alias("bucket"))


def stream_interval_labels(
    edges: DataFrame, windows: DataFrame, delay: str, identity: list[str], reach_ns: int = NS_PER_SECOND, piece_ns: int = PIECE_NS
) -> DataFrame:
    """Add ``y`` to a stream of edges (run_id, wall_time_ns, wall_time_precision_ns of up to ``reach_ns``), in append mode.

    ``windows`` is a stream of (run_id, start_ns, end_ns).  Both may come ``delay`` behind the newest time of their stream, in any order to each other;
    the labels are then those of the batch job.  ``identity`` names the columns that, with the run, tell edges apart: an edge comes out once, however many
    windows mark it.
    """
    edges.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    pieces = label_pieces(windows, reach_ns, piece_ns).withColumn("from_at", event_time("start_ns")).withWatermark("from_at", delay)
    pieces = pieces.select(F.col("run_id").alias("_run"), F.col("bucket").alias("_bucket"), "start_ns", "end_ns", "from_at")
    timed = edges.withColumn("at", event_time()).withWatermark("at", delay).withColumn("bucket", _bucket(F.col("wall_time_ns"), piece_ns))
    end = event_end_ns(F.col("wall_time_ns"), F.col("wall_time_precision_ns"))
    # The range in event time is what lets state expire; a microsecond on either side makes up for what they leave out of nanoseconds.
    near = F.expr(f"at >= from_at - interval {reach_ns // 1000 + 2} microseconds and at <= from_at + interval {piece_ns // 1000 + 2} microseconds")
    hit = overlaps(F.col("wall_time_ns"), end, F.col("start_ns"), F.col("end_ns"))
    same = (F.col("run_id") == F.col("_run")) & (F.col("bucket") == F.col("_bucket"))
    joined = timed.join(pieces, same & near & hit, "left_outer")
    labelled = joined.select(*edges.columns, "at", F.when(F.col("_run").isNull(), 0).otherwise(1).alias("y"))
    return labelled.dropDuplicatesWithinWatermark(["run_id", *identity]).drop("at")
