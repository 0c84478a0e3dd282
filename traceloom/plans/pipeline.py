"""Whole jobs: captures to curated tables, splits, window exports, and re-windowed exports.

Every job reads one state of its folders, writes all its tables aside, checks them, and only then puts them in place: in a folder
set up with ``snapshots.create`` by one atomic switch to a new version, in a plain folder table by table.  A dataset folder holds Parquet tables: runs, nodes, edges, attack_windows, rejects, split_scenarios,
split_runs; an export folder: window_edges, windows, node_dictionary, split_nodes, export_vocabulary,
export_index, export_runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import ids, text
from traceloom.functions.times import NS_PER_SECOND
from traceloom.operators import exports, incremental, indexes, integrity, labels, profiles, repair, splits, windows
from traceloom.operators.ordered import lookup_join
from traceloom.session import apply_runtime_settings, materialize
from traceloom.sources import raw, sinks, snapshots, tables

EDGE = ["run_id", "line_number"]
BY_RUN = ["tool", "run_id"]
# The first table of each list says that the others are whole: in a plain folder it is dropped first and written last.
DATASET = ("runs", "nodes", "edges", "source_records", "attack_windows", "rejects", "run_parts")
EXPORT = (
    "export_runs", "window_edges", "windows", "split_nodes", "node_dictionary", "export_vocabulary", "export_index",
)


def curate_edges(edges: DataFrame) -> DataFrame:
    c = F.col
    stamp = ids.timestamp_text(
        c("wall_time_ns"), c("wall_time_precision_ns"), c("model_time"), c("model_time_unit"), c("order"), c("timestamp.raw")
    )
    edge_id = ids.global_edge_id(c("run_id"), c("raw_edge_id"), c("src"), c("dst"), stamp, c("line_number"))
    return text.annotate_edges(edges).select(
        *BY_RUN, "raw_edge_id", "src", "dst", "prov_type", "line_number", "timestamp", "wall_time_ns", "wall_time_precision_ns",
        "model_time", "model_time_unit", "order", "relation_field", "relation_value", "raw_relation_value", "timestamp_source",
        "edge_label", "features", "attributes", "raw",
        edge_id.alias("global_edge_id"),
        ids.global_node_id(c("run_id"), c("src")).alias("src_global_node_id"),
        ids.global_node_id(c("run_id"), c("dst")).alias("dst_global_node_id"),
    )


def curate_nodes(nodes: DataFrame, tools: DataFrame) -> DataFrame:
    attributes = F.col("attributes")
    described = nodes.withColumns({"features": text.node_features(attributes), "node_type": text.node_type(attributes)})
    label = text.node_label(F.col("node_type"), attributes, F.col("features"), F.col("is_placeholder"))
    named = lookup_join(described, tools.select("run_id", "tool"), ["run_id"], ["raw_node_id"], "inner")
    return named.select(
        *BY_RUN, "raw_node_id", ids.global_node_id(F.col("run_id"), F.col("raw_node_id")).alias("global_node_id"), "prov_type",
        "line_number", "is_placeholder", "attributes", "features", "node_type", label.alias("label"),
        text.node_path(F.col("node_type"), F.col("features")).alias("path"), "duplicate_count", "duplicate_exact_count",
        "duplicate_conflict_count", "conflicting_fields", "raw",
    )


def summarize_runs(found: DataFrame, nodes: DataFrame, edges: DataFrame, attacks: DataFrame) -> DataFrame:
    per_nodes = nodes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.count_if("is_placeholder").alias("placeholder_node_count"),
        F.count_if(F.col("duplicate_count") > 1).alias("duplicate_logical_node_count"),
    )
    per_edges = edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("edge_count"))
    per_attacks = attacks.groupBy("run_id").agg(F.count(F.lit(1)).alias("attack_window_count"))
    joined = found
    for part in (per_nodes, per_edges, per_attacks):
        joined = joined.join(part, "run_id", "left")
    zero = F.lit(0).cast("bigint")
    counts = ("node_count", "edge_count", "placeholder_node_count", "duplicate_logical_node_count", "attack_window_count")
    return joined.select(
        "run_id", "tool", "scenario", "kind", "source_file", "file_name", "bytes", "modified",
        F.lit(incremental.SCHEMA_VERSION).alias("schema_version"),
        *[F.coalesce(c, zero).alias(c) for c in counts],
        (F.coalesce("node_count", zero) + F.coalesce("edge_count", zero)).alias("record_count"),
    )


def build_dataset(spark: SparkSession, raw_dir: str, out_dir: str, strict: bool = False) -> DataFrame:
    """Curate the captures of a folder that are new or changed; returns the tally of built, rebuilt and skipped."""
    apply_runtime_settings(spark)
    found = materialize(tables.discover_runs(spark, raw_dir), "found")
    unknown = tables.unknown_tools(found).take(1)
    if unknown:
        raise ValueError(f"no known tool in file name {unknown[0]['file_name']}")
    store = snapshots.open_store(spark, out_dir)
    if store.has("runs"):
        stored = store.read("runs")
    else:
        stored = spark.createDataFrame([], "run_id string, source_file string, schema_version int")
    plan = materialize(incremental.build_plan(found, stored), "plan")
    todo = materialize(plan.filter("status <> 'skipped'"), "todo")
    # The list of input files; Spark's own file index keeps the same list on the driver.
    paths = [r["source_file"] for r in todo.select("source_file").collect()]
    if paths:
        commit = store.begin()
        commit.replace(DATASET, materialize(todo.filter("status = 'rebuilt'").select(*BY_RUN), "again"))
        curate(raw.read_capture(spark, paths), todo.drop("status"), tables.read_labels(spark, raw_dir), commit, strict)
        commit.publish(job="build")
    return incremental.build_tally(plan)


def curate(records: DataFrame, runs: DataFrame, label_rows: DataFrame, commit, strict: bool = False) -> None:
    """Write the tables of ``runs`` (a written table), whose records are given, into a commit, and check them."""
    if strict:
        raw.require_clean(records)
    edges = materialize(raw.edge_records(records), "edges")
    nodes = raw.node_records(records)
    attacks = commit.write("attack_windows", labels.attack_windows(runs, edges, label_rows), BY_RUN)
    clean_nodes = commit.write("nodes", curate_nodes(repair.repair(nodes, edges), runs), BY_RUN)
    commit.write("edges", curate_edges(edges), BY_RUN)
    owner = runs.select(*BY_RUN)
    commit.write("source_records", lookup_join(repair.source_records(nodes), owner, ["run_id"], ["line_number"], "inner"), BY_RUN)
    commit.write("rejects", lookup_join(raw.rejects(records), owner, ["run_id"], ["line_number"], "inner"), BY_RUN)
    done = materialize(summarize_runs(runs, clean_nodes, edges, attacks), "done")
    require_whole(runs, done, commit.written("edges"))
    write_index(commit, owner, indexes.run_parts(done, clean_nodes, commit.written("edges")))
    commit.write("runs", done, BY_RUN)


def write_index(commit, changed: DataFrame, parts: DataFrame) -> None:
    """The dataset's index after ``changed`` runs (tool, run_id) got new ``parts``: only their old parts are read.

    A dataset from before there were parts gets those of all its runs once.
    """
    spark = changed.sparkSession
    index, old = commit.before("dataset_index"), commit.before("run_parts", changed)
    if index is None or old is None:
        index, old = spark.createDataFrame([], indexes.INDEX), spark.createDataFrame([], indexes.PARTS)
        if commit.before("runs") is not None:
            kept = [commit.before(t).join(changed, BY_RUN, "left_anti") for t in ("runs", "nodes", "edges")]
            parts = parts.unionByName(indexes.run_parts(*kept))
    stored = commit.write("run_parts", parts, BY_RUN)
    commit.write("dataset_index", indexes.apply_changes(index, stored, old), [], overwrite=True)


def remove_runs(spark: SparkSession, out_dir: str, runs: DataFrame) -> None:
    """Take runs (tool, run_id) out of a dataset and its index."""
    commit = snapshots.open_store(spark, out_dir).begin()
    gone = materialize(runs.select(*BY_RUN), "gone")
    commit.replace(DATASET, gone)
    write_index(commit, gone, spark.createDataFrame([], indexes.PARTS))
    commit.publish(job="remove")


def require_whole(runs: DataFrame, done: DataFrame, edges: DataFrame) -> None:
    """Every run is there once, with as many edges as its summary says."""
    counted = edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("edges"))
    rows = done.groupBy("run_id").agg(F.count(F.lit(1)).alias("times"), F.sum("edge_count").alias("told")).join(counted, "run_id", "left")
    checked = runs.select("run_id").join(rows, "run_id", "left")
    wrong = checked.filter("times is null or times <> 1 or told <> coalesce(edges, 0)").take(1)
    if wrong:
        raise ValueError(f"run {wrong[0]['run_id']} is not whole: {wrong[0].asDict()}")


def audit_captures(spark: SparkSession, raw_dir: str, out_dir: str) -> DataFrame:
    """Write the audit of a folder of captures: problem lines and the totals per run, tool and overall."""
    apply_runtime_settings(spark)
    lines = materialize(raw.audit_lines(raw.read_lines(spark, raw_dir)), "audit")
    sinks.write_json(raw.problem_details(lines), f"{out_dir}/details")
    sinks.write_json(profiles.audit_totals(lines), f"{out_dir}/summary")
    return profiles.audit_totals(lines)


def profile_captures(spark: SparkSession, raw_dir: str, out_dir: str) -> None:
    """Write coverage, gaps, record counts, vocabularies, integrity and examples of a folder of captures."""
    apply_runtime_settings(spark)
    files = materialize(tables.discover_runs(spark, raw_dir), "files")
    records = raw.read_capture(spark, raw_dir)
    nodes, edges = raw.node_records(records), records.filter("record_class = 'edge'")
    by_run = materialize(
        integrity.integrity_by_run(files, nodes, edges, profiles.record_counts(records).select("run_id", "parse_errors")), "by_run"
    )
    flags = integrity.endpoint_flags(edges, integrity.unlinked_nodes(records))
    reports = {
        "coverage": profiles.coverage(files),
        "coverage_gaps": profiles.coverage_gaps(files),
        "sizes": profiles.size_pivot(files),
        "records": profiles.record_profile(records, files.select("run_id", "bytes")),
        "vocabulary": profiles.vocabulary(records),
        "integrity": integrity.integrity_report(by_run),
        "anomalies": integrity.anomalies(by_run),
        "first_examples": integrity.first_examples(records),
        "first_duplicates": integrity.first_duplicates(nodes),
        "first_dangling": integrity.first_dangling(flags),
    }
    for name, report in reports.items():
        sinks.write_table(report, f"{out_dir}/{name}")


def dataset_index(spark: SparkSession, out_dir: str) -> DataFrame:
    runs = snapshots.open_store(spark, out_dir).read("runs")
    return runs.groupBy("tool").agg(F.count(F.lit(1)).alias("run_count"), F.sum("record_count").alias("record_count"))


def build_splits(spark: SparkSession, out_dir: str, **ratios) -> DataFrame:
    """Write the scenario lists and the split of every run; returns the summary per tool and split."""
    store = snapshots.open_store(spark, out_dir)
    runs = store.read("runs").select("run_id", "tool", "scenario", "kind")
    commit = store.begin()
    scenarios = commit.write("split_scenarios", splits.split_scenarios(runs, **ratios), [], overwrite=True)
    assigned = commit.write("split_runs", splits.split_runs(runs, scenarios), [], overwrite=True)
    commit.publish(job="splits")
    return splits.split_summary(assigned)


def export_windows(
    spark: SparkSession, dataset: str, out_dir: str, window_seconds: int = 60, tools: list[str] | None = None
) -> DataFrame:
    """Export the split runs as windows; tools whose export is already complete are left alone.

    Returns the export index: totals and vocabularies per tool.
    """
    apply_runtime_settings(spark)
    source, store = snapshots.open_store(spark, dataset), snapshots.open_store(spark, out_dir)
    assigned = tables.read_curated(source, "split_runs", tools).select("tool", "split", "run_id")
    if store.has("export_runs"):
        done = completed_tools(store, assigned, window_seconds)
        assigned = assigned.filter(~F.col("tool").isin(*done)) if done else assigned
    assigned = materialize(assigned, "assigned")
    if not assigned.isEmpty():
        commit = store.begin()
        commit.replace(EXPORT, materialize(assigned.select("tool").distinct(), "stale"))
        _export(source, commit, window_seconds, assigned)
        commit.publish(job="export")
    return snapshots.open_store(spark, out_dir).read("export_index")


def completed_tools(store, assigned: DataFrame, window_seconds: int) -> list[str]:
    stored = store.read("windows").groupBy("run_id").agg(F.count(F.lit(1)).alias("stored_windows"))
    exported = store.read("export_runs").join(stored, "run_id", "left")
    checked = exports.export_complete(assigned, exported, window_seconds)
    per_tool = checked.groupBy("tool").agg(F.min("complete").alias("c")).filter("c = 1")
    return [r["tool"] for r in per_tool.collect()]


def _export(source, commit, window_seconds, assigned) -> None:
    nodes = lookup_join(source.read("nodes"), assigned, BY_RUN, ["raw_node_id"], "inner")
    edges = lookup_join(source.read("edges"), assigned, BY_RUN, EDGE, "inner")
    runs = assigned.select("run_id")
    problem = exports.violations(runs, edges, nodes).take(1)
    if problem:
        raise ValueError(f"{problem[0]['check']} in run {problem[0]['run_id']}: {problem[0]['item']}")
    attacks = lookup_join(source.read("attack_windows"), runs, ["run_id"], ["start_ns"], "left_semi")
    width = window_seconds * NS_PER_SECOND
    dense = materialize(exports.dense_ids(nodes), "dense")
    starts = windows.window_starts(edges, width)
    labelled = labels.label_edges(edges, attacks, EDGE)
    cut = windows.assign_windows(labelled, starts, width, EDGE)
    out = exports.with_export_ids(cut, dense, EDGE).select(
        "tool", "split", "run_id", "window_index", "start_ns", F.col("src_export_id").alias("src"), F.col("dst_export_id").alias("dst"),
        F.col("global_edge_id").alias("event_uuid"), F.col("model_time").alias("time"), F.col("model_time_unit").alias("time_unit"),
        "wall_time_ns", "wall_time_precision_ns", "order", F.col("edge_label").alias("label"), "y", "line_number",
    )
    stored = commit.write("window_edges", out, ["tool", "split"])
    messages = nodes.join(dense, ["tool", "global_node_id"]).select(
        "tool", "split", "run_id", F.col("export_id").alias("node"), "node_type", "label", "path"
    )
    finish_export(stored, materialize(messages, "messages"), commit, window_seconds)


def finish_export(stored: DataFrame, messages: DataFrame, commit, window_seconds: int, derived_from: str | None = None) -> None:
    """Window table, dictionaries, run table and index of the window edges of a commit."""
    runs = materialize(stored.select("tool", "split", "run_id").distinct(), "runs")
    at = ["window_index"]
    stats = lookup_join(windows.window_stats(stored), runs, ["run_id"], at, "inner")
    stats = commit.write("windows", stats, ["tool", "split"])
    clash = exports.name_collisions(stats, ["tool", "split"]).take(1)
    if clash:
        raise ValueError(f"window name used twice in {clash[0]['tool']}/{clash[0]['split']}: {clash[0]['file_name']}")
    used = commit.write("split_nodes", exports.used_nodes(stored, ["tool", "split"]), ["tool", "split"])
    on_edges = messages.join(used.select("tool", "node").distinct(), ["tool", "node"], "left_semi")
    commit.write("node_dictionary", on_edges.select("tool", "node", "node_type", "label", "path"), ["tool"])
    labelled = stored.select("tool", "run_id", "src", "dst", F.col("label").alias("edge_label"))
    vocabulary = commit.write("export_vocabulary", exports.export_vocabulary(labelled, messages), ["tool"])
    size = F.lit(window_seconds).alias("window_size_seconds")
    index = exports.export_index(vocabulary, messages, stats)
    origin = F.lit(derived_from).cast("string").alias("derived_from")
    commit.write("export_index", index.select("*", size, origin), ["tool"])
    rolled = windows.run_rollup(stats).join(runs, "run_id").select("*", size)
    commit.write("export_runs", rolled, ["tool", "split"])


def rewindow_export(
    spark: SparkSession, source: str, out_dir: str, window_seconds: int, tools: list[str] | None = None
) -> DataFrame:
    """Cut a stored export to larger windows; returns edges and attack edges per run before and after.

    The source is checked against its own index and node table first; every edge must be in the result.
    """
    apply_runtime_settings(spark)
    origin, store = snapshots.open_store(spark, source), snapshots.open_store(spark, out_dir)
    index = tables.read_curated(origin, "export_runs", tools)
    source_seconds = index.agg(F.max("window_size_seconds")).first()[0]
    stored = tables.read_curated(origin, "window_edges", tools)
    before = tables.read_curated(origin, "windows", tools)
    wrong = exports.index_mismatches(windows.window_stats(stored), before).take(1)
    if wrong:
        raise ValueError(f"window {wrong[0]['window_index']} of {wrong[0]['run_id']} differs from its index")
    if source.rstrip("/") == out_dir.rstrip("/"):
        raise ValueError("a re-windowed export needs a folder of its own")
    commit = store.begin()
    commit.replace(EXPORT, materialize(index.select("tool").distinct(), "again"))
    identity = ["run_id", "event_uuid"]
    cut = windows.rewindow(stored, source_seconds * NS_PER_SECOND, window_seconds * NS_PER_SECOND, identity)
    derived = commit.write("window_edges", cut, ["tool", "split"])
    messages = tables.read_curated(origin, "node_dictionary", tools)
    owners = exports.used_nodes(stored, ["tool", "split", "run_id"])
    owned = materialize(owners.join(messages, ["tool", "node"]), "messages")
    finish_export(derived, owned, commit, window_seconds, f"{source} at {source_seconds} s")
    kept = materialize(exports.conservation(before, commit.written("windows")), "kept")
    lost = kept.filter(
        "not (source_edges <=> derived_edges) or not (source_attack_edges <=> derived_attack_edges)"
    ).take(1)
    if lost:
        raise ValueError(f"edges of run {lost[0]['run_id']} changed: {lost[0].asDict()}")
    commit.publish(job="rewindow", source=source, source_seconds=source_seconds)
    return kept
