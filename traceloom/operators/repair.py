"""Clean node tables: merged duplicates and placeholders for undeclared endpoints.  Edges are never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.text import MISSING, UNKNOWN, type_hint
from traceloom.operators.ordered import HOT_GROUP_ROWS, dealt, group_sizes, hot_join
from traceloom.session import materialize

NODE = ["run_id", "raw_node_id"]


def merge_duplicates(nodes: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """One row per (run_id, raw_node_id) with counts of exact and conflicting duplicates.

    The first record by line is the base.  A key keeps its only non-missing value, takes ``<unknown>``
    when there are several, and else the last missing value (null or empty).  Differing types leave no type.
    Input: run_id, raw_node_id, prov_type, line_number, attributes, raw.

    Ids with up to ``hot_rows`` records are merged in one shuffle; the few with more by ``_merged``, which
    never brings the records of an id together.
    """
    largest, total = group_sizes(nodes, NODE, hot_rows)
    if largest <= hot_rows:
        return _merged_together(nodes, total)
    sizes = nodes.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("duplicate_count"), F.min("line_number").alias("first_line")
    )
    hot = F.broadcast(materialize(sizes.filter(F.col("duplicate_count") > hot_rows), "hot_nodes"))
    cold = _merged_together(nodes.join(hot, NODE, "left_anti"), total)
    records = _typed_records(nodes.join(hot, NODE), hot_rows)
    return cold.unionByName(_merged(records, hot_rows))


def _merged_together(nodes: DataFrame, total: int) -> DataFrame:
    """Merge ids whose records fit in a task, of ``total`` records at most.  All windows and groups start with
    the id, so the records are shuffled once, into as many tasks as their number needs."""
    together = Window.partitionBy(*NODE)
    in_order = together.orderBy("line_number")
    base_type = F.first("prov_type").over(in_order)
    line = F.col("line_number")
    records = dealt(nodes.select(*NODE, "prov_type", "line_number", "attributes", "raw"), NODE, total).withColumns(
        {
            "base_type": base_type,
            "later": F.row_number().over(in_order) > 1,
            "copy": F.col("raw").eqNullSafe(F.first("raw").over(in_order)),
        }
    )
    differs = ~F.col("prov_type").eqNullSafe(F.col("base_type"))
    change = F.min(F.when(differs, line)).over(together)
    records = records.withColumns({"change": change, "count": F.count(F.lit(1)).over(together)})
    # The type is the base type up to the first differing record, then null for good.
    lost = F.col("base_type").isNull() | F.coalesce(line > F.col("change"), F.lit(False))
    clash = F.col("later") & F.when(lost, F.col("prov_type").isNotNull()).otherwise(differs)
    records = records.withColumn("clash", clash).withColumn("exact", F.col("later") & F.col("copy") & ~F.col("clash"))

    # One row for the type of a record and one per attribute; exact copies and single records need the first only.
    alone = (F.col("count") == 1) | F.col("exact")
    typed = F.struct(F.lit("").alias("key"), F.col("prov_type").alias("value"), F.lit(True).alias("is_type"))
    keyed = F.transform(
        F.map_entries("attributes"),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lit(False).alias("is_type")),
    )
    first = ~F.col("later")
    fields = records.select(
        *NODE,
        "line_number",
        "exact",
        "clash",
        F.explode(F.when(alone, F.array(typed)).otherwise(F.concat(F.array(typed), keyed))).alias("f"),
        F.when(first, F.col("raw")).alias("base_raw"),
        F.when(first & (F.col("count") == 1), F.col("attributes")).alias("own"),
    ).select(*NODE, "line_number", "exact", "clash", "f.*", "base_raw", "own")

    full = F.when(~F.col("is_type") & (F.col("value") != ""), F.col("value"))
    before = Window.partitionBy(*NODE, "is_type", "key").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    fields = fields.withColumn("full", full).withColumns(
        {"lo": F.min("full").over(before), "hi": F.max("full").over(before), "seen": F.count(F.lit(1)).over(before)}
    )
    unknown = (F.col("lo") != F.col("hi")) | (F.col("lo") == UNKNOWN)
    conflict = (
        F.when(F.col("is_type"), F.col("clash"))
        .when(F.col("seen") == 0, False)
        .when(F.col("lo").isNull(), F.col("value").eqNullSafe(F.lit(UNKNOWN)))
        .when(unknown, ~F.col("value").eqNullSafe(F.lit(UNKNOWN)))
        .otherwise(F.coalesce(F.col("full") != F.col("lo"), F.lit(False)))
    )
    typed_only = F.col("is_type")
    per_key = (
        fields.withColumn("at", F.when(conflict, line))
        .groupBy(*NODE, "is_type", "key")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if("exact").alias("exact"),
            F.min("line_number").alias("line"),
            F.min("full").alias("lo"),
            F.max("full").alias("hi"),
            F.max_by("value", F.when(F.col("full").isNull(), line)).alias("last_missing"),
            F.min_by("value", "line_number").alias("first_value"),
            F.min("at").alias("conflict_from"),
            F.collect_list("at").alias("conflicts"),
            F.max("base_raw").alias("raw"),
            F.first("own", ignorenulls=True).alias("own"),
        )
    )
    value = F.when(F.col("lo") != F.col("hi"), UNKNOWN).otherwise(F.coalesce("lo", "last_missing"))
    name = F.when(typed_only, "prov_type").otherwise(F.col("key"))
    merged = per_key.groupBy(*NODE).agg(
        F.max(F.when(typed_only & F.col("conflict_from").isNull(), F.col("first_value"))).alias("prov_type"),
        F.max(F.when(typed_only, F.col("line"))).alias("line_number"),
        F.first("own", ignorenulls=True).alias("own"),
        F.map_from_entries(
            F.collect_list(F.when(~typed_only, F.struct("key", value.alias("value"))))
        ).alias("merged"),
        F.max("raw").alias("raw"),
        F.max(F.when(typed_only, F.col("records"))).alias("duplicate_count"),
        F.max(F.when(typed_only, F.col("exact"))).alias("duplicate_exact_count"),
        F.array_distinct(F.flatten(F.collect_list("conflicts"))).alias("conflict_lines"),
        F.array_sort(
            F.collect_list(F.when(F.col("conflict_from").isNotNull(), F.struct("conflict_from", name.alias("name"))))
        ).alias("conflict_names"),
    )
    return merged.select(
        *NODE,
        "prov_type",
        "line_number",
        F.coalesce("own", "merged").alias("attributes"),
        "raw",
        "duplicate_count",
        "duplicate_exact_count",
        F.size("conflict_lines").cast("bigint").alias("duplicate_conflict_count"),
        F.transform("conflict_names", lambda c: c["name"]).alias("conflicting_fields"),
    )


def _typed_records(repeated: DataFrame, hot: int | None) -> DataFrame:
    """Records of repeated ids with the base record beside them, and whether they are exact copies."""
    base = repeated.filter("line_number = first_line").select(
        *NODE, F.col("prov_type").alias("base_type"), F.col("raw").alias("base_raw")
    )
    records = hot_join(repeated, base, NODE, ["line_number"], "inner", hot_rows=hot)
    change = (
        records.filter("not (prov_type <=> base_type)")
        .groupBy(*NODE)
        .agg(F.min("line_number").alias("type_change"))
    )
    records = hot_join(records, change, NODE, ["line_number"], "left", hot_rows=hot)
    # The type is the base type up to the first differing record, then null for good.
    lost = F.col("base_type").isNull() | (F.col("line_number") > F.col("type_change"))
    lost = F.coalesce(lost, F.lit(False))
    later = F.col("line_number") > F.col("first_line")
    same_type = F.when(lost, F.col("prov_type").isNull()).otherwise(F.col("prov_type").eqNullSafe(F.col("base_type")))
    exact = later & same_type & F.col("raw").eqNullSafe(F.col("base_raw"))
    records = records.withColumn("exact", exact).withColumn("type_conflict", later & ~same_type)
    return materialize(records.drop("base_raw"), "records")


def _merged(records: DataFrame, hot: int | None) -> DataFrame:
    pairs = records.filter("not exact").select(
        *NODE, "line_number", F.explode("attributes").alias("key", "value")
    )
    pair = [*NODE, "key"]
    missing = F.col("value").isNull() | (F.col("value") == "")
    # Copies collapse before anything is compared.
    values = pairs.groupBy(*pair, "value").agg(
        F.min("line_number").alias("line"), F.max("line_number").alias("last_line")
    )
    values = values.withColumn("missing", missing)
    keys = values.groupBy(*pair).agg(
        F.min("line").alias("seen"),
        F.min(F.when(~F.col("missing"), F.col("line"))).alias("first_full"),
        F.min_by("value", F.when(~F.col("missing"), F.col("line"))).alias("first_value"),
        F.max_by("value", F.when(F.col("missing"), F.col("last_line"))).alias("last_missing"),
        F.count_if(~F.col("missing")).alias("distinct_values"),
    )
    keys = materialize(keys, "keys")
    merged_value = (
        F.when(F.col("distinct_values") > 1, UNKNOWN)
        .when(F.col("distinct_values") == 1, F.col("first_value"))
        .otherwise(F.col("last_missing"))
    )
    attributes = keys.groupBy(*NODE).agg(
        F.map_from_entries(F.collect_list(F.struct("key", merged_value.alias("value")))).alias("merged_attributes")
    )

    disputed = keys.filter(F.col("distinct_values") > 1)
    second = (
        hot_join(
            values.filter(~F.col("missing")),
            disputed.select(*pair, "first_full"),
            pair,
            ["value"],
            "inner",
            hot_rows=hot,
        )
        .filter("line > first_full")
        .groupBy(*pair)
        .agg(F.min("line").alias("second_full"))
    )
    watched = (
        keys.filter((F.col("distinct_values") > 1) | (F.col("first_value") == UNKNOWN))
        .join(second, pair, "left")
        .select(
            *pair,
            "seen",
            "first_full",
            "second_full",
            F.when(F.col("first_value") == UNKNOWN, F.col("first_full"))
            .otherwise(F.col("second_full"))
            .alias("unknown_from"),
            (F.col("first_value") == UNKNOWN).alias("born_unknown"),
        )
    )
    line = F.col("line_number")
    clash = (
        (line == F.col("second_full"))
        | ((line > F.col("unknown_from")) & ~F.col("value").eqNullSafe(F.lit(UNKNOWN)))
        | (F.col("born_unknown") & (line == F.col("first_full")) & (F.col("seen") < line))
    )
    key_conflicts = (
        hot_join(pairs, watched, pair, ["line_number"], "inner", hot_rows=hot)
        .filter(F.coalesce(clash, F.lit(False)))
        .select(*NODE, "line_number", F.col("key").alias("field"))
    )
    type_conflicts = records.filter("type_conflict").select(*NODE, "line_number", F.lit("prov_type").alias("field"))
    conflicts = key_conflicts.unionByName(type_conflicts)
    per_field = conflicts.groupBy(*NODE, "field").agg(F.min("line_number").alias("line"))
    fields = per_field.groupBy(*NODE).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "field"))), lambda s: s["field"]).alias(
            "conflicting_fields"
        )
    )
    lines = (
        conflicts.select(*NODE, "line_number").distinct()
        .groupBy(*NODE).agg(F.count(F.lit(1)).alias("duplicate_conflict_count"))
    )
    exact = records.groupBy(*NODE).agg(F.count_if("exact").alias("duplicate_exact_count"))
    base = records.filter("line_number = first_line").select(
        *NODE,
        F.when(F.col("type_change").isNull(), F.col("base_type")).alias("prov_type"),
        "line_number",
        "raw",
        "duplicate_count",
    )
    return (
        base.join(exact, NODE)
        .join(attributes, NODE, "left")
        .join(lines, NODE, "left")
        .join(fields, NODE, "left")
        .select(
            *NODE,
            "prov_type",
            "line_number",
            F.coalesce("merged_attributes", F.expr("map()").cast("map<string,string>")).alias("attributes"),
            "raw",
            "duplicate_count",
            "duplicate_exact_count",
            F.coalesce("duplicate_conflict_count", F.lit(0).cast("bigint")).alias("duplicate_conflict_count"),
            F.coalesce("conflicting_fields", F.array().cast("array<string>")).alias("conflicting_fields"),
        )
    )


def source_records(nodes: DataFrame) -> DataFrame:
    """Every record of a repeated id (line number and raw text), one row each instead of a list per node."""
    repeated = nodes.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    kept = hot_join(nodes, repeated, NODE, ["line_number"], "left_semi")
    return kept.select(*NODE, "line_number", "raw")


def endpoints(edges: DataFrame) -> DataFrame:
    """Source and target of every edge with its type hint: run_id, raw_node_id, line_number, side, hint."""
    return edges.select(
        "run_id",
        "line_number",
        F.explode(
            F.array(
                F.struct(F.col("src").alias("raw_node_id"), F.lit(0).alias("side"), type_hint(F.col("from_type")).alias("hint")),
                F.struct(F.col("dst").alias("raw_node_id"), F.lit(1).alias("side"), type_hint(F.col("to_type")).alias("hint")),
            )
        ).alias("e"),
    ).select("run_id", "e.raw_node_id", "line_number", "e.side", "e.hint")


def missing_hints(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """(run_id, raw_node_id, hint, line, side) of undeclared endpoints: each distinct hint where first seen.

    Endpoints without any hint appear once with a null hint.  Mentions collapse per (id, hint) before the
    anti join, so an id mentioned by a third of all edges costs one row there.
    """
    order = F.struct("line_number", "side")
    seen = endpoints(edges).groupBy(*NODE, "hint").agg(F.min(order).alias("at"))
    known = declared.select(*NODE).distinct()
    return seen.join(known, NODE, "left_anti").select(*NODE, "hint", F.col("at.line_number").alias("line"), F.col("at.side").alias("side"))


def placeholders(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """One placeholder per undeclared endpoint: a single hint is kept, differing hints become ``<unknown>``."""
    per_node = missing_hints(edges, declared).groupBy(*NODE).agg(
        F.count("hint").alias("hint_count"), F.min("hint").alias("hint")
    )
    return per_node.withColumn(
        "raw_type_hint",
        F.when(F.col("hint_count") > 1, UNKNOWN).when(F.col("hint_count") == 1, F.col("hint")),
    ).drop("hint")


def placeholder_nodes(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """Placeholders in the shape of merged nodes."""
    fixed = [
        F.lit("object_type"), F.lit(MISSING),
        F.lit("_missing_endpoint"), F.lit("true"),
        F.lit("_placeholder_reason"), F.lit("missing_edge_endpoint"),
    ]
    attributes = F.when(
        F.col("raw_type_hint").isNull(), F.create_map(*fixed)
    ).otherwise(F.create_map(*fixed, F.lit("_raw_type_hint"), F.col("raw_type_hint")))
    return placeholders(edges, declared).select(
        *NODE,
        F.lit(None).cast("string").alias("prov_type"),
        F.lit(0).cast("bigint").alias("line_number"),
        attributes.alias("attributes"),
        F.lit(None).cast("string").alias("raw"),
        F.lit(0).cast("bigint").alias("duplicate_count"),
        F.lit(0).cast("bigint").alias("duplicate_exact_count"),
        F.lit(0).cast("bigint").alias("duplicate_conflict_count"),
        F.array().cast("array<string>").alias("conflicting_fields"),
        F.lit(True).alias("is_placeholder"),
    )


def repair(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Merged nodes and placeholders of all runs."""
    merged = merge_duplicates(nodes).withColumn("is_placeholder", F.lit(False))
    return merged.unionByName(placeholder_nodes(edges, nodes))
