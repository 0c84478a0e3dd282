"""Table writers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading columns of a results table.
RESULT_COLUMNS = (
    "name", "phase", "exit_code", "oom", "duration_sec", "node", "artifact", "best_epoch", "best_val_loss",
    "test_epoch", "test_loss", "adp_score", "precision", "recall", "tp", "fp", "tn", "fn",
)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace just the partitions present in ``df``.

    Rows are rebalanced by the partition columns, so small partitions get one file and a run with a third of
    all rows is split over many tasks.
    """
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def drop_partitions(spark: SparkSession, path: str, values: Iterable[dict[str, str]]) -> None:
    """Remove whole partitions that are about to be written anew, so that none stays behind when a rebuilt run or
    tool has no rows left in a table.  Each value names the partition columns in order."""
    jvm = spark.sparkContext._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for value in values:
        folder = "/".join([path, *[escape(c, v) for c, v in value.items()]])
        target = jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def result_columns(results: DataFrame) -> DataFrame:
    """Results as one column per field: the fixed columns, then all others sorted, without overrides."""
    keys = results.select(F.explode(F.map_keys("fields")).alias("k")).distinct()
    extra = sorted(r["k"] for r in keys.collect() if r["k"] not in (*RESULT_COLUMNS, "overrides"))
    return results.select(*[F.col("fields")[k].alias(k) for k in (*RESULT_COLUMNS, *extra)])


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON and CSV tables side by side."""
    wide = result_columns(results)
    wide.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    results.select(F.to_json("fields").alias("value")).write.mode("overwrite").text(f"{path}/json")


def write_leaderboard(ranked: DataFrame, path: str, json_path: str | None = None) -> None:
    """Ranked results in order of position, as one sorted CSV table and, beside it, as JSON with the nested overrides."""
    if json_path is not None:
        nested = F.struct("position", F.col("fields").alias("result"), F.col("overrides").alias("overrides"))
        ranked.orderBy("position").select(F.to_json(nested).alias("value")).write.mode("overwrite").text(json_path)
    wide = result_columns(ranked).columns
    ordered = ranked.orderBy("position").select(
        F.col("position"), *[F.col("fields")[k].alias(k) for k in wide]
    )
    ordered.write.mode("overwrite").option("header", True).csv(path)


def write_grid(grid: DataFrame, path: str) -> None:
    grid.write.mode("overwrite").option("header", True).csv(path)
