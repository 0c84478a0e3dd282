"""Indexes of a dataset kept up to date by signed changes.

Every run has its parts: counts per aspect and value.  The index of a tool is their sum.  When runs are built, rebuilt or removed, their new parts are
added and their old ones subtracted, so only changed runs are read; since values are counted, one that no run has any more leaves the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aspects that are plain sums; all others list values.
SUMS = ("runs", "records", "nodes", "edges", "bytes")
LISTS = ("scenario", "kind", "node_type", "edge_label")
PARTS = "run_id string, tool string, aspect string, value string, n bigint"
INDEX = "tool string, aspect string, value string, n bigint"


def _entry(aspect: str, value: Column, n: Column) -> Column:
    return F.struct(F.lit(aspect).alias("aspect"), value.cast("string").alias("value"), n.cast("bigint").alias("n"))


def run_parts(runs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parts (run_id, tool, aspect, value, n) of runs, given their summaries, nodes and edges."""
    one, none = F.lit(1), F.lit("")
    sums = (one, F.col("record_count"), F.col("node_count"), F.col("edge_count"), F.col("bytes"))
    entries = [_entry(a, none, n) for a, n in zip(SUMS, sums, strict=True)] + [_entry(a, F.col(a), one) for a in ("scenario", "kind")]
    own = runs.select("run_id", "tool", F.explode(F.array(*entries)).alias("p")).select("run_id", "tool", "p.*")

    def listed(rows: DataFrame, aspect: str) -> DataFrame:
        counted = rows.groupBy("run_id", "tool", F.col(aspect).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        return counted.select("run_id", "tool", F.lit(aspect).alias("aspect"), F.coalesce("value", F.lit("")).alias("value"), "n")

    return own.unionByName(listed(nodes, "node_type")).unionByName(listed(edges, "edge_label"))


def apply_changes(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The index (tool, aspect, value, n) after parts are added and removed; values counted down to nothing leave."""
    keys = ["tool", "aspect", "value"]
    rows = index.select(*keys, "n").unionByName(added.select(*keys, "n")).unionByName(removed.select(*keys, (-F.col("n")).alias("n")))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")


def rollup(index: DataFrame) -> DataFrame:
    """Per tool the sums, and how many different values each list has."""
    sums = [F.coalesce(F.sum(F.when(F.col("aspect") == a, F.col("n"))), F.lit(0)).alias(a) for a in SUMS]
    lists = [F.count_if(F.col("aspect") == a).alias(f"{a}s") for a in LISTS]
    return index.groupBy("tool").agg(*sums, *lists)
