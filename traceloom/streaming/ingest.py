"""Incremental ingest: captures that arrive in a folder are curated exactly once, by a file stream that runs until nothing is new.

The stream's checkpoint knows which files were read; no list of them is made here.  A micro-batch becomes one commit of the versioned
dataset (``snapshots``), tagged with the stream and the number of the batch.  A batch that runs again after a failure finds its tag in the
log and is skipped, so a crash at any point leaves each file's rows in the dataset once.

What a file stream cannot see is caught afterwards by comparing the folder's listing with the stored runs: files that changed after they
were read, and runs stored under an older schema version.  Only those files are opened, found by their time of
change, which prunes the scan, and by a join with the runs in question.  Files of no bytes are no runs, as in the batch job.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.names import plain_path
from traceloom.operators import incremental
from traceloom.operators.ordered import lookup_join
from traceloom.plans import pipeline
from traceloom.session import apply_runtime_settings, materialize
from traceloom.sources import raw, snapshots, tables

FILES_PER_BATCH = 1000
_FILE = ("file_path", "bytes", "modified")


def arriving_lines(spark: SparkSession, raw_dir: str, glob: str = "*.jsonl", files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """A stream of the lines of new files, with what tells their file and their place in it."""
    reader = spark.readStream.option("lineSep", "\n").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return reader.text(raw_dir).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified"), "value",
    )


def _runs(files: DataFrame) -> DataFrame:
    """Run rows of (file_path, bytes, modified), as ``tables.discover_runs`` gives them."""
    path = F.regexp_replace(plain_path(F.col("file_path")), "^file:/*", "file:/")
    named = files.select(path.alias("file_path"), "bytes", "modified").select("*", *raw.run_columns())
    return named.select(
        "run_id", F.col("file_path").alias("source_file"), F.regexp_extract("file_path", r"([^/]*)$", 1).alias("file_name"),
        "bytes", "modified", "tool", "scenario", "kind",
    )


def _publish(lines: DataFrame, runs: DataFrame, raw_dir: str, store, strict: bool, **note) -> None:
    unknown = tables.unknown_tools(runs).take(1)
    if unknown:
        raise ValueError(f"no known tool in file name {unknown[0]['file_name']}")
    commit = store.begin()
    commit.replace(pipeline.DATASET, runs.select(*pipeline.BY_RUN))
    pipeline.curate(raw.capture(lines), runs, tables.read_labels(lines.sparkSession, raw_dir), commit, strict)
    commit.publish(**note)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    return json.loads(snapshots.read_text(spark, f"{checkpoint}/metadata"))["id"]


def landed(spark: SparkSession, out_dir: str, stream: str) -> int:
    """The newest batch of a stream that is in the dataset, -1 if there is none."""
    return next((e["note"]["batch"] for e in snapshots.history(spark, out_dir) if e["note"].get("stream") == stream), -1)


def _land(raw_dir: str, out_dir: str, checkpoint: str, strict: bool):
    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = stream_id(spark, checkpoint)
        if number <= landed(spark, out_dir, stream):
            return
        staged = materialize(batch.withColumn("row", F.monotonically_increasing_id()), "arrived")
        runs = materialize(_runs(staged.select(*_FILE).distinct()), "runs")
        lines = staged.select(plain_path(F.col("file_path")).alias("file_path"), "block_start", "row", "value")
        _publish(lines, runs, raw_dir, snapshots.open_store(spark, out_dir), strict, job="ingest", stream=stream, batch=number)

    return land


def ingest(spark: SparkSession, raw_dir: str, out_dir: str, checkpoint: str, strict: bool = False, files_per_batch: int = FILES_PER_BATCH) -> dict:
    """Bring a versioned dataset up to date with a folder of captures; returns versions published, lines read and runs caught up on.

    ``checkpoint`` is a folder that belongs to this dataset.  Two ingests into one dataset must not run at the same time.
    """
    apply_runtime_settings(spark)
    first = snapshots.snapshot(spark, out_dir).version
    writer = arriving_lines(spark, raw_dir, files_per_batch=files_per_batch).writeStream.foreachBatch(_land(raw_dir, out_dir, checkpoint, strict))
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    late = catch_up(spark, raw_dir, out_dir, strict)
    return {"versions": snapshots.snapshot(spark, out_dir).version - first, "lines": read, "caught_up": late}


def changed_runs(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed runs that are not stored as they are: other file, size, time of change or schema version, or not at all."""
    same = ["run_id", "source_file", "bytes", "modified"]
    fresh = stored.filter(F.col("schema_version") == incremental.SCHEMA_VERSION).select(*same)
    return listed.join(fresh, same, "left_anti")


def changed_lines(spark: SparkSession, raw_dir: str, todo: DataFrame) -> DataFrame:
    """Lines of the files of ``todo`` (a written table); files that changed before the oldest of them are pruned from the scan."""
    since = todo.agg(F.min("modified")).first()[0]
    lines = raw.text_lines(spark, raw_dir, since=since)
    path = F.regexp_replace("file_path", "^file:/*", "file:/")
    wanted = todo.select(F.col("source_file").alias("_source"))
    return lookup_join(lines.withColumn("_source", path), wanted, ["_source"], ["row"], "left_semi").drop("_source")


def catch_up(spark: SparkSession, raw_dir: str, out_dir: str, strict: bool = False) -> int:
    """Build again what changed since it was read; returns the number of runs."""
    listed = tables.discover_runs(spark, raw_dir)
    store = snapshots.open_store(spark, out_dir)
    todo = materialize(changed_runs(listed, store.read("runs")) if store.has("runs") else listed, "todo")
    runs = todo.count()
    if runs:
        lines = materialize(changed_lines(spark, raw_dir, todo), "changed")
        _publish(lines, todo, raw_dir, store, strict, job="catch up")
    return runs
