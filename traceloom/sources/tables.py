"""Other inputs: label files, file listings, trial results, training logs, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.names import file_stem, metric_number, plain_path, run_name, run_name_loose, scenario_alias
from traceloom.operators.labels import label_windows
from traceloom.session import materialize
from traceloom.sources.raw import number_lines, text_lines
from traceloom.sources.snapshots import FlatStore, VersionedStore, path_exists

LABEL_SCHEMA = (
    "scenario string, cve string, tool string, cve_start string, cve_end string, "
    "cve_start_epoch string, cve_end_epoch string"
)
# Summary files that lie beside the result files.
SUMMARY_FILES = ("results.json", "leaderboard.json", "asha_status.json")


def discover_runs(spark: SparkSession, path: str, glob: str = "*.jsonl", loose: bool = False) -> DataFrame:
    """One row per capture file: run_id, source_file, file_name, bytes, modified, tool, scenario, kind.

    A strict name must end in a known tool; ``loose`` takes the text behind the last underscore.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    stem = file_stem(F.col("path"))
    named = files.select(
        stem.alias("run_id"),
        F.col("path").alias("source_file"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
        (run_name_loose(stem) if loose else run_name(stem)).alias("n"),
    )
    return named.select("run_id", "source_file", "file_name", "bytes", "modified", "n.tool", "n.scenario", "n.kind")


def unknown_tools(runs: DataFrame) -> DataFrame:
    return runs.filter("tool is null").select("file_name")


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """``labels.csv`` beside the captures, with windows in nanoseconds; empty when there is none."""
    path = f"{folder.rstrip('/')}/labels.csv"
    if not path_exists(spark, path):
        return label_windows(spark.createDataFrame([], LABEL_SCHEMA))
    rows = spark.read.schema(LABEL_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)
    return label_windows(rows.withColumn("scenario", scenario_alias(F.col("scenario"))))


def read_results(spark: SparkSession, path: str, metric: str = "adp_score") -> DataFrame:
    """Trial results, one JSON file each; unreadable files and files without a name are left out.

    ``exit_code_present`` tells an absent exit code from a null one.  ``fields`` holds every top-level value
    as text, ``overrides`` the nested overrides.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    read = files.select(
        F.regexp_extract(plain_path(F.col("_metadata.file_path")), r"([^/]*)$", 1).alias("file_name"),
        F.try_parse_json("value").alias("v"),
    ).filter(~F.col("file_name").isin(*SUMMARY_FILES))

    def text(key: str):
        return F.try_variant_get("v", f"$['{key}']", "string")

    named = read.select(
        F.coalesce(text("method"), F.lit("")).alias("method"),
        F.coalesce(text("rung"), F.lit("")).alias("rung"),
        text("name").alias("name"),
        metric_number(text(metric)).alias("metric"),
        text("phase").alias("phase"),
        F.try_variant_get("v", "$.exit_code", "int").alias("exit_code"),
        F.variant_get("v", "$.exit_code", "variant").isNotNull().alias("exit_code_present"),
        F.try_variant_get("v", "$.oom", "boolean").alias("oom"),
        F.try_variant_get("v", "$.checkpoint_saved", "boolean").alias("checkpoint_saved"),
        text("checkpoint_path").alias("checkpoint_path"),
        F.try_variant_get("v", "$.overrides", "map<string,string>").alias("overrides"),
        F.try_variant_get("v", "$", "map<string,string>").alias("fields"),
        "file_name",
    )
    return named.filter("name <> ''")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths and sizes; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("bytes"))


def read_logs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Log lines: file, pos, text.  A carriage return, which progress bars write, ends a line too."""
    staged = materialize(text_lines(spark, path, glob, None), "log")
    return number_lines(staged).select(
        F.regexp_extract("file_path", r"([^/]*)$", 1).alias("file"),
        F.col("line_number").alias("pos"),
        F.col("value").alias("text"),
    )


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).withColumn("index", F.col("index").cast("bigint"))


def read_curated(store: FlatStore | VersionedStore, table: str, tools: list[str] | None = None) -> DataFrame:
    """A curated table (runs, nodes, edges, split_runs …); naming tools prunes partitions.  Unknown tools fail."""
    df = store.read(table)
    if tools is None:
        return df
    known = {r["tool"] for r in df.select("tool").distinct().collect()}
    unknown = sorted(set(tools) - known)
    if unknown:
        raise ValueError(f"unknown tools: {unknown}")
    return store.read(table, tool=tools)
