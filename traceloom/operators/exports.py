"""Dense export ids, dictionaries, vocabularies and consistency checks of window exports.

Checks return the offending rows, so an empty result means all is well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.ordered import hot_join, scan
from traceloom.session import materialize


def dense_ids(nodes: DataFrame) -> DataFrame:
    """(tool, global_node_id, export_id): distinct ids of a tool in order, numbered from "1"."""
    distinct = materialize(nodes.select("tool", "global_node_id").distinct(), "ids")
    ranked = scan(distinct, ["tool"], ["global_node_id"], {"n": ("rank", None)})
    return ranked.select("tool", "global_node_id", F.col("n").cast("string").alias("export_id"))


def with_export_ids(edges: DataFrame, ids: DataFrame, identity: list[str]) -> DataFrame:
    """Add src_export_id and dst_export_id; edges need tool, src_global_node_id, dst_global_node_id."""
    for side in ("src", "dst"):
        lookup = ids.select(
            "tool",
            F.col("global_node_id").alias(f"{side}_global_node_id"),
            F.col("export_id").alias(f"{side}_export_id"),
        )
        edges = hot_join(edges, lookup, ["tool", f"{side}_global_node_id"], identity, "left")
    return edges


def used_nodes(edges: DataFrame, extra: list[str]) -> DataFrame:
    """Distinct (extra…, node) over both ends of the edges."""
    ends = edges.select(*extra, F.explode(F.array("src", "dst")).alias("node"))
    return ends.distinct()


def split_nodes(edges: DataFrame) -> DataFrame:
    return used_nodes(edges, ["tool", "split"])


def export_vocabulary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct node types on edges and edge labels per tool with their counts: tool, aspect, value, n.

    One row per value, since labels come from the captures and have no bound.
    ``nodes``: tool, run_id, node, node_type.  ``edges``: tool, run_id, src, dst, edge_label.
    """
    on_edges = nodes.join(used_nodes(edges, ["tool", "run_id"]), ["tool", "run_id", "node"], "left_semi")
    parts = [
        df.groupBy("tool", F.lit(aspect).alias("aspect"), F.col(aspect).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        for df, aspect in ((on_edges, "node_type"), (edges, "edge_label"))
    ]
    return parts[0].unionByName(parts[1])


def export_index(vocabulary: DataFrame, nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """Totals per tool: all nodes (also those without edges), messages (nodes on edges), types, labels, windows."""
    is_type = F.col("aspect") == "node_type"
    sizes = vocabulary.groupBy("tool").agg(
        F.count_if(is_type).alias("node_type_count"),
        F.count_if(~is_type).alias("edge_label_count"),
        F.sum(F.when(is_type, F.col("n"))).alias("message_count"),
    )
    every = nodes.groupBy("tool").agg(F.count(F.lit(1)).alias("node_count"))
    totals = stats.groupBy("tool").agg(
        F.count(F.lit(1)).alias("window_count"),
        F.sum("edge_count").alias("edge_count"),
        F.sum("attack_edge_count").alias("attack_edge_count"),
    )
    return every.join(sizes, "tool", "left").join(totals, "tool", "left")


def node_dictionary(nodes: DataFrame) -> DataFrame:
    """Type, label and path entry per node id; ids are unique, copies of a row are dropped."""
    return nodes.select("node", "node_type", "label", "path").dropDuplicates(["node"])


def name_collisions(stats: DataFrame, scope: list[str]) -> DataFrame:
    """Window names used more than once inside a run or a split."""
    return stats.groupBy(*scope, "file_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def export_complete(expected: DataFrame, exported: DataFrame, width_seconds: int) -> DataFrame:
    """Per (tool, split): whether an export may be reused.

    ``expected``: tool, split, run_id.  ``exported``: tool, split, run_id, window_size_seconds, window_count,
    stored_windows.  Run ids must be the same set, each with windows, all stored, all of the asked size.
    """
    both = expected.withColumn("_e", F.lit(1)).join(
        exported.withColumn("_x", F.lit(1)), ["tool", "split", "run_id"], "full_outer"
    )
    fine = (
        F.col("_e").isNotNull()
        & F.col("_x").isNotNull()
        & (F.col("window_count") > 0)
        & (F.col("stored_windows") == F.col("window_count"))
        & (F.col("window_size_seconds") == width_seconds)
    )
    return both.groupBy("tool", "split").agg(
        F.count("_e").alias("expected_runs"),
        F.count("_x").alias("exported_runs"),
        F.min(F.coalesce(fine, F.lit(False)).cast("int")).alias("complete"),
    )


def index_mismatches(stats: DataFrame, index: DataFrame) -> DataFrame:
    """Windows whose counts differ from the index.  A negative or absent index value is not checked."""
    numbers = ("node_count", "edge_count", "attack_edge_count")
    listed = index.select("run_id", "window_index", *[F.col(c).alias(f"index_{c}") for c in numbers])
    joined = stats.select("run_id", "window_index", *numbers).join(listed, ["run_id", "window_index"], "full_outer")
    wrong = F.lit(False)
    for c in numbers:
        wrong = wrong | ((F.coalesce(f"index_{c}", F.lit(-1)) >= 0) & ~F.col(c).eqNullSafe(F.col(f"index_{c}")))
    return joined.filter(wrong)


def attribute_conflicts(window_nodes: DataFrame) -> DataFrame:
    """Nodes of a run that carry different (label, node_type) in different windows."""
    seen = F.struct("label", "node_type")
    spread = window_nodes.groupBy("run_id", "node").agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"))
    return spread.filter("lo <> hi").select("run_id", "node")


def conservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges and attack edges per run before and after re-windowing, both sides kept."""

    def summed(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy("run_id").agg(
            F.sum("edge_count").alias(f"{side}_edges"),
            F.sum("attack_edge_count").alias(f"{side}_attack_edges"),
            F.count(F.lit(1)).alias(f"{side}_windows"),
        )

    return summed(before, "source").join(summed(after, "derived"), "run_id", "full_outer")


def violations(runs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Guards of an export: runs without edges, edges without a time, endpoints without a node."""
    empty = runs.select("run_id").join(edges.select("run_id").distinct(), "run_id", "left_anti")
    timeless = edges.filter("wall_time_ns is null")
    ends = used_nodes(edges, ["run_id"])
    known = nodes.select("run_id", F.col("raw_node_id").alias("node")).distinct()
    unknown = ends.join(known, ["run_id", "node"], "left_anti")
    none = F.lit(None).cast("string")
    return (
        empty.select("run_id", F.lit("run_without_edges").alias("check"), none.alias("item"))
        .unionByName(timeless.select("run_id", F.lit("edge_without_time").alias("check"), F.col("line_number").cast("string").alias("item")))
        .unionByName(unknown.select("run_id", F.lit("endpoint_without_node").alias("check"), F.col("node").alias("item")))
    )
