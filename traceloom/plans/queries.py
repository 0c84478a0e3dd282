"""Registered queries: the operators over the views of a scale-factor folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import ids as I
from traceloom.functions import names as N
from traceloom.functions import text as X
from traceloom.functions import times as T
from traceloom.operators import exports, grids, heavy, incremental, indexes, integrity, labels, profiles, repair, splits, trials, windows
from traceloom.operators.ordered import lookup_join
from traceloom.plans.views import Views, run_columns
from traceloom.session import apply_runtime_settings, materialize, stage_root
from traceloom.sources import snapshots
from traceloom.sources.raw import audit_lines
from traceloom.streaming import landing

HOUR_NS = 3_600_000_000_000
SIX_HOURS, ONE_DAY = 6 * HOUR_NS, 24 * HOUR_NS
EDGE = ["line_number"]
ETA = 2
LANDING_DELAY = 10 * ONE_DAY

_registry: dict[str, Callable[[Views], DataFrame]] = {}


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    _registry[build.__name__] = build
    return build


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_runtime_settings(spark)
            return build(Views(spark, sf_dir))

        return run

    return {name: bind(build) for name, build in _registry.items()}


def big(column: str):
    return F.col(column).cast("bigint").alias(column)


def labelled(v: Views) -> DataFrame:
    windows_ = labels.attack_windows(v.runs, v.edges, v.labels)
    return labels.label_edges(v.edges, windows_, EDGE)


def windowed(v: Views, width: int = SIX_HOURS) -> DataFrame:
    starts = windows.window_starts(v.edges, width)
    return windows.assign_windows(labelled(v), starts, width, EDGE)


STATS = ("node_count", "edge_count", "attack_edge_count", "y", "start_ns", "end_ns")


# Windows ---------------------------------------------------------------------------------------------


@query
def window_stats(v: Views) -> DataFrame:
    stats = windows.window_stats(windowed(v))
    return stats.select("run_id", big("window_index"), "file_name", *[big(c) for c in STATS])


@query
def window_edges(v: Views) -> DataFrame:
    return windows.window_edges(v.edges, SIX_HOURS, EDGE).select(
        "run_id", "raw_edge_id", "src", "dst", "wall_time_ns", big("window_index"), "start_ns"
    )


@query
def window_run_rollup(v: Views) -> DataFrame:
    rolled = windows.run_rollup(windows.window_stats(windowed(v)))
    return rolled.select("run_id", *[big(c) for c in rolled.columns if c != "run_id"])


@query
def window_totals(v: Views) -> DataFrame:
    totals = windows.export_totals(windows.window_stats(windowed(v)))
    return totals.select(*[big(c) for c in totals.columns])


@query
def rewindow_stats(v: Views) -> DataFrame:
    stored = materialize(windowed(v), "windowed")
    stats = windows.window_stats(windows.rewindow(stored, SIX_HOURS, ONE_DAY, EDGE))
    return stats.select("run_id", big("window_index"), "file_name", *[big(c) for c in STATS])


@query
def rewindow_conservation(v: Views) -> DataFrame:
    stored = materialize(windowed(v), "windowed")
    before = windows.window_stats(stored)
    after = windows.window_stats(windows.rewindow(stored, SIX_HOURS, ONE_DAY, EDGE))
    kept = exports.conservation(before, after)
    return kept.select("run_id", *[big(c) for c in kept.columns if c != "run_id"])


@query
def multi_edge_key(v: Views) -> DataFrame:
    cut = windows.window_edges(v.edges, ONE_DAY, EDGE)
    keyed = windows.parallel_edge_keys(cut, ["wall_time_ns", "order", "line_number"])
    return keyed.select("run_id", "raw_edge_id", big("window_index"), "src", "dst", big("edge_key"))


@query
def tumbling_windows(v: Views) -> DataFrame:
    return windows.tumbling_windows(v.edges, SIX_HOURS).select("run_id", "start_ns", big("edge_count"))


# Attack labels ---------------------------------------------------------------------------------------


@query
def run_time_range(v: Views) -> DataFrame:
    return labels.run_time_range(v.edges)


@query
def attack_windows(v: Views) -> DataFrame:
    return labels.attack_windows(v.runs, v.edges, v.labels)


@query
def edge_attack_label(v: Views) -> DataFrame:
    return labelled(v).select("run_id", "raw_edge_id", big("y"))


@query
def label_ns(v: Views) -> DataFrame:
    seconds = T.whole_seconds(F.col("wall_time_ns"))
    epoch = F.format_string("%d.%09d99", seconds, F.col("wall_time_ns") % T.NS_PER_SECOND)
    stamp = F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".25Z"))
    rows = v.edges.select(
        "tool", "raw_edge_id", stamp.alias("cve_start"), stamp.alias("cve_end"), epoch.alias("cve_start_epoch"), epoch.alias("cve_end_epoch")
    )
    return labels.label_windows(rows).select("raw_edge_id", "tool", "start_ns", "end_ns")


# Repair ----------------------------------------------------------------------------------------------


@query
def merged_nodes(v: Views) -> DataFrame:
    merged = repair.merge_duplicates(v.nodes)
    return merged.select(
        "run_id",
        "raw_node_id",
        "prov_type",
        F.col("attributes")["flag"].alias("flag"),
        F.col("attributes")["part"].alias("part"),
        big("duplicate_count"),
        big("duplicate_exact_count"),
        big("duplicate_conflict_count"),
        F.array_join(F.array_sort("conflicting_fields"), ",").alias("conflicting_fields"),
    )


@query
def merge_counts(v: Views) -> DataFrame:
    merged = repair.merge_duplicates(v.nodes)
    return merged.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("logical_nodes"),
        F.count_if(F.col("duplicate_count") > 1).alias("duplicate_logical_nodes"),
        F.sum("duplicate_count").alias("records"),
        F.sum("duplicate_exact_count").alias("exact"),
        F.sum("duplicate_conflict_count").alias("conflicting"),
    )


@query
def source_records(v: Views) -> DataFrame:
    return repair.source_records(v.nodes).select("run_id", "raw_node_id", big("line_number"), "raw")


@query
def placeholder_nodes(v: Views) -> DataFrame:
    return repair.placeholder_nodes(v.edges, v.declared).select(
        "run_id",
        "raw_node_id",
        F.col("attributes")["object_type"].alias("object_type"),
        F.col("attributes")["_placeholder_reason"].alias("reason"),
        F.col("attributes")["_raw_type_hint"].alias("raw_type_hint"),
    )


@query
def placeholder_hints(v: Views) -> DataFrame:
    return repair.missing_hints(v.edges, v.declared).select("run_id", "raw_node_id", "hint", big("line"), big("side"))


# Integrity -------------------------------------------------------------------------------------------


def _report(by_run: DataFrame) -> DataFrame:
    report = integrity.integrity_report(by_run)
    numbers = ("files", *integrity.COUNTS)
    return report.select("tool", "run_id", *[big(c) for c in numbers], "duplicate_pct", "dangling_pct", "late_pct")


@query
def graph_integrity(v: Views) -> DataFrame:
    return _report(integrity.integrity_by_run(v.runs, v.declared, v.edges))


def _raw_integrity(v: Views) -> DataFrame:
    records = materialize(v.records_of("record_class", "raw_node_id", "src", "dst"), "records")
    nodes = records.filter("record_class = 'node'")
    edges = records.filter("record_class = 'edge'")
    errors = profiles.record_counts(records).select("run_id", "parse_errors")
    return integrity.integrity_by_run(v.runs, nodes, edges, errors)


@query
def raw_integrity(v: Views) -> DataFrame:
    return _report(_raw_integrity(v))


@query
def integrity_anomalies(v: Views) -> DataFrame:
    return integrity.anomalies(_raw_integrity(v)).select("run_id", *[big(c) for c in integrity.COUNTS])


@query
def missing_when_seen(v: Views) -> DataFrame:
    flags = integrity.endpoint_flags(v.edges, v.declared)
    return flags.select(
        "run_id", "line_number", *[F.col(c).cast("int").alias(c) for c in ("src_missing", "dst_missing", "missing_when_seen")]
    )


@query
def first_examples(v: Views) -> DataFrame:
    return integrity.first_examples(v.records).select(
        "run_id", "record_class", big("line_number"), F.get_json_object("raw", "$.type").alias("type")
    )


@query
def first_duplicate(v: Views) -> DataFrame:
    nodes = v.records_of("record_class", "raw_node_id").filter("record_class = 'node'")
    return integrity.first_duplicates(nodes).select("run_id", "raw_node_id", big("first_line"), big("duplicate_line"))


@query
def first_dangling(v: Views) -> DataFrame:
    found = integrity.first_dangling(integrity.endpoint_flags(v.edges, v.declared))
    return found.select(
        "run_id", "line_number", "src", "dst", F.col("src_missing").cast("int").alias("src_missing"), F.col("dst_missing").cast("int").alias("dst_missing")
    )


@query
def export_guards(v: Views) -> DataFrame:
    return exports.violations(v.runs, v.edges, v.declared).select("run_id", "check", "item")


# Features, labels and ids ----------------------------------------------------------------------------


def _described(v: Views) -> DataFrame:
    described = v.features.withColumn("features", X.node_features(F.col("attributes")))
    described = described.withColumn("node_type", X.node_type(F.col("attributes")))
    label = X.node_label(F.col("node_type"), F.col("attributes"), F.col("features"), F.col("is_placeholder"))
    return described.withColumn("label", label).withColumn("path", X.node_path(F.col("node_type"), F.col("features")))


@query
def node_features(v: Views) -> DataFrame:
    return _described(v).select("raw_node_id", "features.*")


@query
def node_labels(v: Views) -> DataFrame:
    return _described(v).select("raw_node_id", "node_type", "label")


@query
def node_paths(v: Views) -> DataFrame:
    return _described(v).select("raw_node_id", "path.path", "path.type", "path.cmd")


@query
def node_dictionary(v: Views) -> DataFrame:
    nodes = _described(v).withColumnRenamed("raw_node_id", "node")
    twice = nodes.unionByName(nodes)
    return exports.node_dictionary(twice).select("node", "node_type", "label", F.col("path")["path"].alias("path"))


@query
def edge_labels(v: Views) -> DataFrame:
    return X.annotate_edges(v.edges).select("run_id", "raw_edge_id", "edge_label")


@query
def edge_annotations(v: Views) -> DataFrame:
    edges = v.records.filter("record_class = 'edge'")
    return X.annotate_edges(edges).select(
        "run_id", "raw_edge_id", "relation_field", "relation_value", "raw_relation_value", "edge_label",
        F.col("features")["relation"].alias("relation"),
    )


@query
def stable_node_ids(v: Views) -> DataFrame:
    return v.declared.select("run_id", "raw_node_id", I.global_node_id(F.col("run_id"), F.col("raw_node_id")).alias("global_node_id"))


@query
def stable_edge_ids(v: Views) -> DataFrame:
    c = F.col
    seconds = T.whole_seconds(c("wall_time_ns"))
    stamp = I.timestamp_text(
        c("wall_time_ns"), c("wall_time_precision_ns"), seconds, F.lit("seconds"), c("order"), F.lit("none")
    )
    edge = I.global_edge_id(c("run_id"), c("raw_edge_id"), c("src"), c("dst"), stamp, c("line_number"))
    return v.edges.select("run_id", "raw_edge_id", edge.alias("global_edge_id"))


def _used_global(v: Views) -> DataFrame:
    ends = exports.used_nodes(v.edges, ["tool", "run_id"])
    return ends.select("tool", "run_id", "node", I.global_node_id(F.col("run_id"), F.col("node")).alias("global_node_id"))


@query
def dense_ids(v: Views) -> DataFrame:
    return exports.dense_ids(_used_global(v))


@query
def export_edge_ids(v: Views) -> DataFrame:
    ids = materialize(exports.dense_ids(_used_global(v)), "dense")
    edges = v.edges.select(
        "tool",
        "raw_edge_id",
        "line_number",
        I.global_node_id(F.col("run_id"), F.col("src")).alias("src_global_node_id"),
        I.global_node_id(F.col("run_id"), F.col("dst")).alias("dst_global_node_id"),
    )
    return exports.with_export_ids(edges, ids, EDGE).select("tool", "raw_edge_id", "src_export_id", "dst_export_id")


# Times and names -------------------------------------------------------------------------------------


@query
def event_timestamps(v: Views) -> DataFrame:
    second = F.timestamp_seconds(T.whole_seconds(F.col("wall_time_ns")))
    micros = F.format_string("%06d", F.call_function("div", F.col("wall_time_ns") % T.NS_PER_SECOND, F.lit(1000)))
    dashed = F.concat(F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), micros, F.lit("Z"))
    coloned = F.date_format(second, "yyyy:MM:dd'T'HH:mm:ss")
    written = F.when(F.col("wall_time_precision_ns") == 1000, dashed).otherwise(coloned)
    field = F.when(F.col("user_id") % 4 == 0, "ts").otherwise("cf:date")
    attributes = F.map_concat(
        F.create_map(field, written), F.create_map(F.lit("cf:jiffies"), F.when(F.col("k") % 2 == 0, F.col("raw_edge_id")))
    )
    stamped = v.edges.select("run_id", "tool", "raw_edge_id", T.event_timestamp(F.col("tool"), attributes).alias("t"))
    return stamped.select(
        "run_id", "raw_edge_id", "t.wall_time_ns", "t.wall_time_precision_ns", "t.model_time", "t.model_time_unit", "t.order", "t.source",
        T.ns_label(F.col("t.wall_time_ns")).alias("label"),
        T.event_end_ns(F.col("t.wall_time_ns"), F.col("t.wall_time_precision_ns")).alias("end_ns"),
    )


@query
def run_names(v: Views) -> DataFrame:
    """Names of every user's runs, numbered captures and unknown tools among them."""
    stem = F.concat(
        F.col("scenario"),
        F.lit("_"),
        F.when(F.col("user_id") % 9 == 0, "other").otherwise(F.col("tool")),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("_run_"), F.col("user_id").cast("string"))).otherwise(""),
    )
    stems = v.edges.select(stem.alias("stem")).distinct()
    attack = N.attack_scenario(N.run_name(F.col("stem"))["scenario"])
    return stems.select(
        "stem",
        N.run_name(F.col("stem"))["scenario"].alias("scenario"),
        N.run_name(F.col("stem"))["tool"].alias("tool"),
        N.run_name(F.col("stem"))["kind"].alias("kind"),
        N.run_name_loose(F.col("stem"))["tool"].alias("loose_tool"),
        attack["name"].alias("attack_name"),
        attack["cve"].alias("cve"),
    )


@query
def name_tokens(v: Views) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    return v.table("part").select(
        "p_partkey",
        N.safe_name(F.concat(F.lit("__"), F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit(" . "))).alias("safe_name"),
        N.value_token(F.concat(F.lit("-"), price)).alias("token"),
        N.fixed_number(F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string")).otherwise("n/a"), 1).alias("number"),
        X.short_json(F.concat_ws(" ", "p_name", "p_brand", "p_type"), 12).alias("short"),
    )


# Splits and exports ----------------------------------------------------------------------------------


@query
def split_scenarios(v: Views) -> DataFrame:
    return splits.split_scenarios(v.runs).select(F.col("benign").cast("int").alias("benign"), "scenario", big("position"), "split")


def _split_runs(v: Views, with_validation: bool = False) -> DataFrame:
    return splits.split_runs(v.runs, splits.split_scenarios(v.runs, with_validation=with_validation))


@query
def split_runs(v: Views) -> DataFrame:
    return _split_runs(v).select("run_id", "tool", "scenario", "kind", "split")


@query
def split_runs_attack_validation(v: Views) -> DataFrame:
    return _split_runs(v, True).select("run_id", "split")


@query
def split_summary(v: Views) -> DataFrame:
    summary = splits.split_summary(_split_runs(v))
    return summary.select("tool", "split", *[big(c) for c in summary.columns if c not in ("tool", "split")])


@query
def split_nodes(v: Views) -> DataFrame:
    assigned = _split_runs(v).select("run_id", "split")
    return exports.split_nodes(lookup_join(v.edges, assigned, ["run_id"], EDGE, "inner")).select("tool", "split", "node")


@query
def run_summary(v: Views) -> DataFrame:
    records = profiles.record_counts(v.records_of("record_class")).select("run_id", "records", "nodes", "edges")
    holes = repair.placeholders(v.edges, v.declared).groupBy("run_id").agg(F.count(F.lit(1)).alias("placeholders"))
    joined = v.runs.join(records, "run_id", "left").join(holes, "run_id", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select("run_id", "tool", *[F.coalesce(c, zero).alias(c) for c in ("records", "nodes", "edges", "placeholders")])


@query
def runs_per_tool(v: Views) -> DataFrame:
    return v.edges.groupBy("tool").agg(F.count_distinct("run_id").alias("runs"), F.count(F.lit(1)).alias("edges"))


def _vocabulary(v: Views) -> tuple[DataFrame, DataFrame]:
    kinds = v.declared.select(
        run_tool().alias("tool"), "run_id", F.col("raw_node_id").alias("node"),
        F.when(F.startswith("raw_node_id", F.lit("p")), "process").otherwise("file").alias("node_type"),
    )
    return X.annotate_edges(v.edges), kinds


@query
def export_vocab(v: Views) -> DataFrame:
    return exports.export_vocabulary(*_vocabulary(v)).select("tool", "aspect", "value", big("n"))


@query
def export_index(v: Views) -> DataFrame:
    edges, kinds = _vocabulary(v)
    vocabulary = materialize(exports.export_vocabulary(edges, kinds), "vocabulary")
    stats = windows.window_stats(windowed(v, ONE_DAY)).join(v.runs.select("run_id", "tool"), "run_id")
    index = exports.export_index(vocabulary, kinds, stats)
    return index.select("tool", *[big(c) for c in index.columns if c != "tool"])


def run_tool():
    return F.substring_index("run_id", "_", -1)


@query
def export_complete(v: Views) -> DataFrame:
    """The export of the one-day windows against the expected runs; user activity decides what was stored."""
    stats = materialize(windows.window_stats(windows.window_edges(v.edges.withColumn("y", F.lit(0)), ONE_DAY, EDGE)), "stats")
    stored = stats.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("window_count"), F.count_if(F.expr("edge_count < 15 or window_index > 1")).alias("stored_windows")
    )
    assigned = _split_runs(v).select("tool", "split", "run_id")
    exported = assigned.join(stored, "run_id").withColumn("window_size_seconds", F.lit(86400))
    done = exports.export_complete(assigned, exported, 86400)
    return done.select("tool", "split", big("expected_runs"), big("exported_runs"), big("complete"))


@query
def name_collisions(v: Views) -> DataFrame:
    """Names of windows cut to whole seconds, which do collide inside a tool."""
    cut = windows.tumbling_windows(v.edges, HOUR_NS).withColumn("tool", run_tool())
    named = cut.withColumn("file_name", T.window_name(F.col("start_ns"), F.col("start_ns") + F.lit(HOUR_NS - 1)))
    return exports.name_collisions(named, ["tool"]).select("tool", "file_name", big("n"))


@query
def index_mismatch(v: Views) -> DataFrame:
    """Counts of the one-day windows against an index that knows some sources under one name and missed their attacks."""
    stored = materialize(windowed(v, ONE_DAY), "windowed")
    stats = windows.window_stats(stored)
    lost = (F.col("relation") == "error") & (F.col("k") % 10 == 0)
    index = windows.window_stats(stored.withColumn("src", F.when(lost, "lost").otherwise(F.col("src"))).withColumn("y", F.when(lost, 0).otherwise(F.col("y"))))
    wrong = exports.index_mismatches(stats, index)
    return wrong.select("run_id", *[big(c) for c in wrong.columns if c != "run_id"])


@query
def node_attr_conflicts(v: Views) -> DataFrame:
    """Targets whose type hint differs between windows of a run."""
    cut = windows.window_edges(v.edges, ONE_DAY, EDGE)
    seen = cut.select("run_id", "window_index", F.col("dst").alias("node"), F.col("dst").alias("label"), F.col("to_type").alias("node_type"))
    return exports.attribute_conflicts(seen)


# Profiles --------------------------------------------------------------------------------------------


def _sizes(v: Views) -> DataFrame:
    stem = N.file_stem(F.col("file_path"))
    return v.raw_lines.groupBy(stem.alias("run_id")).agg(F.sum(F.octet_length("value") + 1).alias("bytes"))


def _files(v: Views) -> DataFrame:
    return v.runs.join(_sizes(v), "run_id")


@query
def line_audit(v: Views) -> DataFrame:
    return profiles.line_audit(audit_lines(v.decoded))


@query
def line_audit_totals(v: Views) -> DataFrame:
    totals = profiles.audit_totals(audit_lines(v.decoded))
    return totals.select("tool", "run_id", *[big(c) for c in totals.columns if c not in ("tool", "run_id")])


@query
def problem_lines(v: Views) -> DataFrame:
    return profiles.problem_lines(audit_lines(v.decoded)).select("run_id", "tool", "line_number", "tier", "excerpt", "text")


@query
def parse_counters(v: Views) -> DataFrame:
    return profiles.parse_counters(v.records_of())


@query
def written_numbers(v: Views) -> DataFrame:
    """The numbers of an attribute as they stand in the lines, mended ones included."""
    sized = v.records.filter("record_class is not null")
    return sized.groupBy("tool", "record_class", F.col("attributes")["size"].alias("size")).agg(F.count(F.lit(1)).alias("n"))


# Versioned tables ------------------------------------------------------------------------------------


def _fresh_root(v: Views, name: str) -> str:
    root = f"{stage_root(v.spark)}/{name}-{uuid.uuid4().hex}"
    snapshots.create(v.spark, root)
    return root


@query
def snapshot_rebuild(v: Views) -> DataFrame:
    """Edges and edge ids per run, as a reader of the first version and one of the second see them: in between the runs of a tool are rebuilt."""
    root = _fresh_root(v, "rebuild")
    rows = v.edges.select("tool", "run_id", F.col("raw_edge_id").cast("bigint").alias("id"), "user_id")
    first = snapshots.open_store(v.spark, root).begin()
    first.write("edges", rows, ["tool", "run_id"])
    first.publish(job="build")
    old = snapshots.open_store(v.spark, root)
    second = old.begin()
    second.replace(["edges"], materialize(v.runs.filter("tool = 'recap'").select("tool", "run_id"), "again"))
    second.write("edges", rows.filter("tool = 'recap' and user_id % 2 = 0").withColumn("id", F.col("id") + 1), ["tool", "run_id"])
    second.publish(job="rebuild")

    def seen(store, name: str) -> DataFrame:
        return store.read("edges").groupBy("run_id").agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.sum("id").alias(f"{name}_ids"))

    both = seen(old, "old").join(seen(snapshots.open_store(v.spark, root), "new"), "run_id", "left")
    return both.select("run_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in both.columns if c != "run_id"])


@query
def signed_index(v: Views) -> DataFrame:
    """The index of relations and edges per tool after the runs of one tool were rebuilt and those of another removed."""

    def parts(edges: DataFrame) -> DataFrame:
        entries = F.array(F.struct(F.lit("edges").alias("aspect"), F.lit("").alias("value")), F.struct(F.lit("relation").alias("aspect"), F.col("relation").alias("value")))
        listed = edges.select("run_id", "tool", F.explode(entries).alias("p"))
        return listed.groupBy("run_id", "tool", "p.aspect", "p.value").agg(F.count(F.lit(1)).alias("n"))

    empty = v.spark.createDataFrame([], indexes.PARTS)
    first = materialize(parts(v.edges), "parts")
    index = materialize(indexes.apply_changes(empty, first, empty), "index")
    rebuilt = parts(v.edges.filter("tool = 'recap' and user_id % 2 = 0 and relation <> 'click'"))
    index = materialize(indexes.apply_changes(index, rebuilt, first.filter("tool = 'recap'")), "index")
    return indexes.apply_changes(index, empty, first.filter("tool = 'camflow'"))


@query
def landed_edges(v: Views) -> DataFrame:
    """All edges, landed in four batches: on time, or late with the time their run had reached."""
    root = _fresh_root(v, "landed")
    edges = v.edges.select("run_id", "wall_time_ns", "line_number", "src", "dst")
    for number in range(4):
        batch = edges.filter(F.pmod(F.col("line_number") * 7919, F.lit(4)) == number)
        landing.land_batch(batch, snapshots.open_store(v.spark, root), SIX_HOURS, LANDING_DELAY, job="land", batch=number)
    store = snapshots.open_store(v.spark, root)
    columns = ["run_id", "line_number", "src", "dst"]
    late = store.read("late_edges").select(*columns, F.lit(1).alias("late"), "reached_ns")
    return store.read("on_time").select(*columns, F.lit(0).alias("late"), F.lit(None).cast("bigint").alias("reached_ns")).unionByName(late)


@query
def record_profile(v: Views) -> DataFrame:
    profile = profiles.record_profile(v.records_of("record_class"), _sizes(v))
    return profile.select("tool", "run_id", *[big(c) for c in profile.columns if c not in ("tool", "run_id")])


@query
def coverage(v: Views) -> DataFrame:
    return profiles.coverage(_files(v)).select(
        "tool", "kind", big("files"), big("bytes"), big("scenarios"), "files_pct", "bytes_pct"
    )


@query
def coverage_gaps(v: Views) -> DataFrame:
    """Scenarios that lack a tool when events worth less than 250 are booked on one tool."""
    tool = F.when(F.col("value") >= 250, F.col("tool")).otherwise("recap")
    return profiles.coverage_gaps(v.edges.select("scenario", tool.alias("tool")).distinct())


@query
def size_pivot(v: Views) -> DataFrame:
    return profiles.size_pivot(_files(v))


def _described_records(v: Views) -> DataFrame:
    return v.records_of("record_class", "prov_type", "attributes")


@query
def relation_vocab(v: Views) -> DataFrame:
    vocab = profiles.vocabulary(_described_records(v)).filter("aspect in ('relation', 'relation_field', 'prov_type', 'object_type')")
    return vocab.select("tool", "aspect", "value", big("n"), big("first_line"))


@query
def key_counts(v: Views) -> DataFrame:
    return profiles.vocabulary(_described_records(v)).filter("aspect like '%_key'").select("tool", "aspect", "value", big("n"))


@query
def top_relations(v: Views) -> DataFrame:
    vocab = materialize(profiles.vocabulary(_described_records(v)), "vocabulary")
    return profiles.top_values(vocab, "relation", 3).select("tool", "value", big("n"), "share", big("position"))


def _frequent(rows: DataFrame, value, k: int, by: tuple[str, ...] = ("tool",)) -> DataFrame:
    found = heavy.frequent_values(rows, value, k, by)
    return found.select(*by, "value", big("n"), "share", big("first_line"), big("position"))


@query
def frequent_sizes(v: Views) -> DataFrame:
    """The 20 most frequent values of an attribute per tool."""
    sized = v.records_of("record_class", F.col("attributes")["size"].alias("size"))
    return _frequent(sized.filter("record_class is not null"), F.col("size"), 20)


@query
def frequent_sources(v: Views) -> DataFrame:
    """The 10 sources with the most edges per tool."""
    return _frequent(v.records_of("src"), F.col("src"), 10)


@query
def frequent_relations_per_run(v: Views) -> DataFrame:
    """The 3 most frequent relations per run."""
    relation = F.coalesce(F.col("attributes")["relation_type"], F.col("attributes")["relation"])
    return _frequent(v.records_of(relation.alias("relation")), F.col("relation"), 3, ("run_id",))


@query
def top_types_per_run(v: Views) -> DataFrame:
    by = ("tool", "run_id")
    vocab = materialize(profiles.vocabulary(_described_records(v), by), "vocabulary")
    return profiles.top_values(vocab, "prov_type", 3, by).select("run_id", "value", big("n"), "share", big("position"))


# Trials ----------------------------------------------------------------------------------------------

RUNG = ["method", "rung"]


def _planned(v: Views) -> DataFrame:
    return v.trials.select("method", "rung", "name")


def _finished(v: Views) -> DataFrame:
    return v.trials.filter("o_orderstatus <> 'P'")


def _promoted_before(v: Views) -> DataFrame:
    """Trials of an earlier promotion: the good ones among the first results."""
    return _finished(v).filter(trials.promotable() & (F.col("metric") > 450000)).select("method", "rung", "name", "metric")


@query
def leaderboard(v: Views) -> DataFrame:
    ranked = trials.leaderboard(v.trials, RUNG)
    return ranked.select("method", "rung", "name", "metric", big("position"))


@query
def leaderboard_minimize(v: Views) -> DataFrame:
    ranked = trials.leaderboard(v.trials, RUNG, maximize=False)
    return ranked.select("method", "rung", "name", big("position"))


@query
def valid_counts(v: Views) -> DataFrame:
    return trials.rung_counts(_planned(v), _finished(v)).select("method", "rung", big("planned"), big("completed"), big("valid"))


@query
def halving_sync(v: Views) -> DataFrame:
    chosen = trials.halving_sync(_planned(v), v.trials, ETA)
    return chosen.select("method", "rung", "name", "metric", big("position"))


@query
def halving_async(v: Views) -> DataFrame:
    chosen = trials.halving_async(_planned(v), _finished(v), _promoted_before(v), ETA)
    return chosen.select("method", "rung", "name", "metric", big("position"))


@query
def cutoff(v: Views) -> DataFrame:
    return trials.cutoffs(trials.halving_sync(_planned(v), v.trials, ETA)).select("method", "rung", "cutoff", big("promoted"))


@query
def final_topk(v: Views) -> DataFrame:
    return trials.final_topk(_planned(v), v.trials, "r5_e5").select("method", "name", "metric", big("position"))


@query
def final_report(v: Views) -> DataFrame:
    """The top trials of the deepest rung beside results of the same orders' line items."""
    planned = materialize(trials.final_topk(_planned(v), v.trials, "r5_e5", 10), "finals")
    finals = (
        v.table("lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("metric"))
        .join(planned.select("method", "name", F.col("name").cast("bigint").alias("l_orderkey")), "l_orderkey")
        .select("method", "name", "metric", F.lpad("name", 12, "0").alias("file_name"))
    )
    source = v.trials.filter(F.col("rung") == "r5_e5")
    report = trials.final_report(planned, finals, source)
    return report.select(
        "method", "name", big("planned_rank"), "final_metric", big("final_rank"), "source_metric", big("source_rank"), "status"
    )


@query
def rung_status(v: Views) -> DataFrame:
    submitted = v.trials.filter("o_orderkey % 4 <> 0")
    cancelled = v.trials.filter("o_orderkey % 4 = 0")
    status = trials.rung_status(_planned(v), submitted, _promoted_before(v), cancelled, _finished(v))
    counts = ("planned", "submitted", "completed", "valid", "promoted", "cancelled")
    return status.select("method", "rung", *[big(c) for c in counts], "best", "best_metric")


@query
def final_status(v: Views) -> DataFrame:
    """Status of the deepest rung's trials as final trials."""
    rows = v.trials.filter(F.col("rung") == "r5_e5")
    finished = _finished(v).filter(F.col("rung") == "r5_e5")
    status = trials.final_status(rows, rows.filter("o_orderkey % 4 <> 0"), finished)
    counts = ("planned", "submitted", "completed", "valid")
    return status.select("method", *[big(c) for c in counts], "best", "best_metric")


@query
def cancellable_trials(v: Views) -> DataFrame:
    """With a reduction of 30 some rungs have promoted all they can; trials of even orders were cancelled before."""
    cancelled = v.trials.filter("o_orderkey % 2 = 0")
    left = trials.cancellable(v.trials, _finished(v), _promoted_before(v), cancelled, 30)
    return left.select("method", "rung", "name")


@query
def best_results(v: Views) -> DataFrame:
    return trials.best_result(v.trials, RUNG).select("method", "rung", "name", "metric")


@query
def method_summary(v: Views) -> DataFrame:
    submitted = v.trials.filter("o_orderkey % 4 <> 0")
    summary = trials.method_summary(_planned(v), submitted, _promoted_before(v), _finished(v), ETA)
    counts = ("planned", "submitted", "promoted", "failed", "done", "checkpointed", "top_checkpointed", "waiting")
    return summary.select("method", "rung", *[big(c) for c in counts], "best")


@query
def deepest_rung(v: Views) -> DataFrame:
    return trials.deepest_rung(v.trials)


@query
def deepest_leaderboard(v: Views) -> DataFrame:
    return trials.deepest_leaderboard(v.trials, 5).select("method", "rung", "name", "metric", big("position"))


@query
def pending_trials(v: Views) -> DataFrame:
    return trials.without(_planned(v), _finished(v), ["method", "rung", "name"]).select("method", "rung", "name")


@query
def reusable_results(v: Views) -> DataFrame:
    return trials.reusable(v.trials, need_checkpoint=True).select("method", "rung", "name")


@query
def trials_to_run(v: Views) -> DataFrame:
    return trials.to_run(_planned(v), v.trials, need_checkpoint=True).select("method", "rung", "name")


@query
def completion_override(v: Views) -> DataFrame:
    saved = v.table("orders").select(
        F.col("o_orderkey").cast("string").alias("name"), (F.col("o_custkey") % 10).alias("next_epoch"), F.lit(5).alias("target_epochs")
    )
    done = trials.completion_override(v.trials, saved)
    return done.select(
        "name", big("exit_code"), big("original_exit_code"), F.col("completed_by_checkpoint").cast("int").alias("completed_by_checkpoint")
    )


@query
def last_results(v: Views) -> DataFrame:
    """The last of several result files of a trial: one file per line item of an order."""
    rows = v.table("lineitem").select(
        F.lit("m").alias("method"),
        F.lit("r").alias("rung"),
        F.col("l_orderkey").cast("string").alias("name"),
        F.format_string("%04d-%09d-%06d-%s", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string")).alias("file_name"),
    )
    return trials.last_result_per_name(rows).select("name", "file_name")


@query
def name_problems(v: Views) -> DataFrame:
    """Part names planned as trials against a grid that has the larger parts under another name."""
    named = v.table("part").select(N.safe_name(F.col("p_name")).alias("name"), "p_size")
    moved = F.when(F.col("p_size") < 5, F.col("name")).otherwise(F.concat("name", F.lit("_moved")))
    return trials.name_problems(named.select("name"), named.select(moved.alias("name")))


@query
def log_metrics(v: Views) -> DataFrame:
    read = trials.log_metrics(v.log_lines)
    return read.select(
        "file", big("best_epoch"), "best_val_loss", big("test_epoch"), "test_loss", F.col("oom").cast("int").alias("oom"), "adp_score", "tp"
    )


@query
def log_exit_codes(v: Views) -> DataFrame:
    """Out-of-memory flags with the exit codes of the runs beside the logs."""
    exits = v.events.groupBy(F.col("user_id").alias("file")).agg(
        F.max(F.when(F.col("value") > 300, 137).otherwise(0)).alias("exit_code")
    )
    joined = trials.with_exit_code(trials.log_metrics(v.log_lines), exits)
    return joined.select("file", big("exit_code"), F.col("oom").cast("int").alias("oom"))


@query
def int_ranges(v: Views) -> DataFrame:
    items = v.table("lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("task"))
    ranges = trials.integer_ranges(items, ["owner"], "task")
    return ranges.select("owner", big("first"), big("last"), big("length"), "text")


@query
def ordered_union(v: Views) -> DataFrame:
    """Targets of a user's views in order, then targets of the user's other events not seen before."""
    view = F.col("event_type") == "view"

    def ordered(which: Column) -> DataFrame:
        return v.events.filter(which).select(F.col("user_id").alias("owner"), F.col("event_id").alias("pos"), F.col("k").alias("item"))

    return trials.ordered_union(ordered(view), ordered(~view), ["owner"]).select("owner", big("item"), big("position"))


@query
def job_tally(v: Views) -> DataFrame:
    return trials.job_tally(_jobs(v)).select("method", "rung", "state", "account", big("tasks"))


def _jobs(v: Views) -> DataFrame:
    """Orders as array jobs: one per order, with a task list of its own."""
    label = N.job_label(F.col("job"), "raw100")
    span = F.format_string("9_[%d-%d,77%%10]", F.col("o_orderkey") % 5, F.col("o_orderkey") % 5 + F.col("o_custkey") % 7)
    jobs = v.table("orders").select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string"), F.lit("_raw100_r"), F.left("o_orderpriority", F.lit(1)), F.lit("_x")).alias("job"),
        F.when(F.col("o_orderkey") % 3 == 0, span).otherwise("9_3").alias("job_id"),
        F.col("o_orderstatus").alias("state"),
        F.concat(F.lit("a"), (F.col("o_custkey") % 3).cast("string")).alias("account"),
    )
    return jobs.select(label["method"].alias("method"), label["rung"].alias("rung"), "state", "account", trials.task_count(F.col("job_id")).alias("tasks"))


@query
def account_slots(v: Views) -> DataFrame:
    return trials.account_slots(_jobs(v), 10_000).select("account", big("used"), big("free"))


@query
def namespace_inventory(v: Views) -> DataFrame:
    states = v.trials.groupBy(F.col("o_orderstatus").alias("suffix"), "method", "rung").agg(
        F.count_if(F.col("rung") == "r5_e5").alias("final_rows"), F.max("file_name").alias("updated_at")
    )
    listed = trials.namespace_inventory(states)
    return listed.select("suffix", "methods", big("states"), big("rungs"), big("final_rows"), "updated_at")


# Grids -----------------------------------------------------------------------------------------------


def _axes(v: Views) -> DataFrame:
    """Axis values found in the tables: flags, statuses and priorities, one row."""
    items = v.table("lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line")).distinct()
    orders = v.table("orders").select(F.left("o_orderpriority", F.lit(1)).alias("prio")).distinct()
    rows = items.unionByName(orders, allowMissingColumns=True).agg(
        *[F.array_sort(F.collect_set(c)).alias(c) for c in ("flag", "line", "prio")]
    )
    return rows.withColumn("default", F.array(F.col("flag")[1], F.col("line")[0], F.col("prio")[2]))


@query
def param_grid(v: Views) -> DataFrame:
    return grids.parameter_grid(_axes(v), ["flag", "line", "prio"]).select(big("index"), "name", "flag", "line", "prio")


@query
def override_maps(v: Views) -> DataFrame:
    """Overrides of parts as trials: sizes as dimension, price bands as capacity."""
    bands = F.when(F.col("p_retailprice") < 950, "small").when(F.col("p_retailprice") < 1000, "default").otherwise("large")
    trials_ = v.table("part").select("p_partkey", F.col("p_size").alias("batch"), bands.alias("cap"))
    mapped = trials_.withColumn("o", grids.override_map("kairos", ["cap", "batch"]))
    key = grids.AXIS_KEYS["batch"][0]
    return mapped.select(
        "p_partkey",
        F.size("o").cast("bigint").alias("keys"),
        F.col("o")[key].alias("batch"),
        F.col("o")["training.node_hid_dim"].alias("hidden"),
        F.col("o")["training.encoder.tgn.tgn_time_dim"].alias("time_dim"),
        F.col("o")["training.seed"].alias("seed"),
    )


@query
def planned_runs(v: Views) -> DataFrame:
    grid = grids.parameter_grid(_axes(v), ["flag", "line", "prio"])
    plan = grids.planned_runs(grid.select("index", "name", "flag", "line", "prio"), "table")
    return plan.select("rung", big("epochs"), "resume_from", big("index"), "name")


@query
def expanded_templates(v: Views) -> DataFrame:
    templates = v.table("part").select(
        F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") > 25, F.create_map(F.lit("training.seed"), F.lit("9"))).otherwise(
            F.create_map(F.lit("training.lr"), F.col("p_size").cast("string"))
        ).alias("overrides"),
    )
    runs = grids.expand_templates(templates, [0, 1, 2])
    return runs.select(
        "name", big("seed"), F.size("overrides").cast("bigint").alias("keys"), F.col("overrides")["training.seed"].alias("training_seed")
    )


# Incremental builds ----------------------------------------------------------------------------------


def _plan(v: Views) -> DataFrame:
    found = v.table("orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("source_file"))
    stored = v.table("orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise("moved").alias("source_file"),
        F.when(F.col("o_orderstatus") == "F", 3).otherwise(2).alias("schema_version"),
    )
    return incremental.build_plan(found, stored)


@query
def incremental_plan(v: Views) -> DataFrame:
    return _plan(v).select("run_id", "status")


@query
def build_tally(v: Views) -> DataFrame:
    return incremental.build_tally(_plan(v)).select("status", big("runs"))
