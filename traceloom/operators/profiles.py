"""Profiles of raw captures: audit tiers, coverage, record counts and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.names import TOOLS, percentage
from traceloom.functions.text import relation_field
from traceloom.operators.ordered import scan

TIERS = ("strict_ok", "repairable_latin1", "repairable_escape_quotes", "unrepaired")


def line_audit(lines: DataFrame) -> DataFrame:
    """Lines per decoding tier and run, with the total of problem lines."""
    return lines.groupBy("run_id", "tool").agg(
        *[F.count_if(F.col("tier") == t).alias(t) for t in TIERS],
        F.count_if(F.col("tier") != "strict_ok").alias("total_problem_lines"),
    )


def audit_totals(lines: DataFrame) -> DataFrame:
    """The audit rolled up: run, tool, all."""
    counted = line_audit(lines)
    return (
        counted.rollup("tool", "run_id")
        .agg(*[F.sum(c).alias(c) for c in (*TIERS, "total_problem_lines")])
        .select(
            F.coalesce("tool", F.lit("*")).alias("tool"),
            F.coalesce("run_id", F.lit("*")).alias("run_id"),
            *TIERS,
            "total_problem_lines",
        )
    )


def problem_lines(lines: DataFrame, width: int = 400) -> DataFrame:
    """Lines that are not strict JSON: an excerpt of ``width`` characters, and the whole text beside it."""
    return lines.filter("tier <> 'strict_ok'").select(
        "run_id", "tool", "line_number", "tier", F.left("text", F.lit(width)).alias("excerpt"), "text"
    )


def parse_counters(lines: DataFrame) -> DataFrame:
    """Per run: lines with a byte outside ASCII that were read, and lines that were skipped."""
    read = F.col("tier") != "unrepaired"
    return lines.groupBy("run_id").agg(
        F.count_if(read & F.col("non_ascii")).alias("non_ascii_lines"), F.count_if(~read).alias("skipped_lines")
    )


CLASSES = {"nodes": "node", "edges": "edge", "other": "other"}


def record_counts(records: DataFrame) -> DataFrame:
    """Records by class and unreadable lines per run; ``record_class`` is null on unreadable lines."""
    return records.groupBy("tool", "run_id").agg(
        F.count("record_class").alias("records"),
        *[F.count_if(F.col("record_class") == c).alias(n) for n, c in CLASSES.items()],
        F.count_if(F.col("record_class").isNull()).alias("parse_errors"),
    )


def record_profile(records: DataFrame, sizes: DataFrame) -> DataFrame:
    """Record counts and bytes per run, per tool and overall.  ``sizes``: run_id, bytes."""
    counts = ("records", *CLASSES, "parse_errors", "bytes")
    by_run = record_counts(records).join(sizes, "run_id", "left")
    return (
        by_run.rollup("tool", "run_id")
        .agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in counts])
        .select(
            F.coalesce("tool", F.lit("*")).alias("tool"),
            F.coalesce("run_id", F.lit("*")).alias("run_id"),
            "files",
            *counts,
        )
    )


def coverage(files: DataFrame) -> DataFrame:
    """Files, bytes and shares by tool, by kind and overall.  Input: tool, kind, scenario, bytes."""
    grouped = files.groupingSets([["tool"], ["kind"], []], "tool", "kind").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("bytes"),
        F.count_distinct("scenario").alias("scenarios"),
    )
    total = files.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).first()
    return grouped.select(
        F.coalesce("tool", F.lit("*")).alias("tool"),
        F.coalesce("kind", F.lit("*")).alias("kind"),
        "files",
        "bytes",
        "scenarios",
        F.round(F.col("bytes") / F.lit(float(1 << 30)), 2).alias("size_gib"),
        percentage(F.col("files"), F.lit(total["files"])).alias("files_pct"),
        percentage(F.col("bytes"), F.lit(total["bytes"])).alias("bytes_pct"),
    )


def coverage_gaps(files: DataFrame, expected: tuple[str, ...] = TOOLS) -> DataFrame:
    """Scenarios that lack an expected tool or have another one."""
    wanted = F.array(*[F.lit(t) for t in expected])
    present = files.groupBy("scenario").agg(
        *[F.max((F.col("tool") == t).cast("int")).alias(f"has_{t}") for t in expected],
        F.array_sort(F.collect_set(F.when(~F.col("tool").isin(*expected), F.col("tool")))).alias("extra"),
    )
    absent = F.filter(
        wanted,
        lambda t: ~F.array_contains(
            F.array(*[F.when(F.col(f"has_{x}") == 1, F.lit(x)).otherwise(F.lit("")) for x in expected]), t
        ),
    )
    gaps = present.select("scenario", absent.alias("missing"), "extra")
    return gaps.filter("size(missing) > 0 or size(extra) > 0").select(
        "scenario", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra")
    )


def size_pivot(files: DataFrame, tools: tuple[str, ...] = TOOLS) -> DataFrame:
    """Bytes per scenario, one column per tool."""
    return files.groupBy("scenario").pivot("tool", list(tools)).agg(F.sum("bytes"))


def vocabulary(records: DataFrame, by: tuple[str, ...] = ("tool",)) -> DataFrame:
    """Counts per tool (or run) of PROV types, object types, relations, relation fields and annotation keys.

    One row per (group, aspect, value), with the first line it occurs on.
    Input: tool, run_id, record_class, line_number, prov_type, attributes.
    """
    attributes = F.col("attributes")
    field = relation_field(attributes)
    is_edge, is_node = F.col("record_class") == "edge", F.col("record_class") == "node"

    def entry(aspect: str, value, condition):
        return F.when(condition, F.array(F.struct(F.lit(aspect).alias("aspect"), value.alias("value"))))

    key_aspect = F.when(is_edge, "edge_key").otherwise("node_key")
    keys = F.when(
        is_edge | is_node,
        F.transform(F.map_keys(attributes), lambda k: F.struct(key_aspect.alias("aspect"), k.alias("value"))),
    )
    relation = F.coalesce(F.when(field != "<missing>", attributes[field]), F.lit("<missing>"))
    object_type = F.coalesce(attributes["object_type"], F.lit("<missing>"))
    none = F.array().cast("array<struct<aspect:string,value:string>>")
    entries = F.concat(
        *[
            F.coalesce(part, none)
            for part in (
                entry("prov_type", F.coalesce("prov_type", F.lit("<missing>")), F.col("record_class").isNotNull()),
                entry("relation_field", field, is_edge),
                entry("relation", relation, is_edge),
                entry("object_type", object_type, is_node),
                keys,
            )
        ]
    )
    exploded = records.select("tool", "run_id", "line_number", F.explode(entries).alias("v"))
    return exploded.groupBy(*by, F.col("v.aspect").alias("aspect"), F.col("v.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first_line")
    )


def top_values(vocab: DataFrame, aspect: str, k: int, by: tuple[str, ...] = ("tool",)) -> DataFrame:
    """The ``k`` most frequent values per tool (or run) with their share; ties go to the value seen first."""
    counted = vocab.filter(F.col("aspect") == aspect).withColumn("less", -F.col("n"))
    ranked = scan(counted, list(by), ["less", "first_line", "value"], {"position": ("rank", None)})
    totals = counted.groupBy(*by).agg(F.sum("n").alias("total"))
    top = ranked.filter(F.col("position") <= k).join(totals, list(by))
    return top.select(*by, "value", "n", percentage(F.col("n"), F.col("total")).alias("share"), "position")
