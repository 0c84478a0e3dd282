"""Graph integrity: duplicate records, undeclared endpoints, endpoints declared too late, worked examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.names import percentage
from traceloom.operators.ordered import hot_join, lookup_join
from traceloom.session import materialize

NODE = ["run_id", "raw_node_id"]


def endpoint_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, raw_node_id, records, declared_line, seen_line): every id once, from one aggregate over node records and edge ends.

    Rows of both kinds are tagged and counted together, so an id with a third of all rows is one row per task before the shuffle.
    declared_line is null where no record declares the id, seen_line where no edge uses it.
    """
    line = F.col("line_number").cast("bigint")
    records = nodes.select(*NODE, line.alias("declared"), F.lit(None).cast("bigint").alias("seen"))
    ends = edges.select("run_id", F.explode(F.array("src", "dst")).alias("raw_node_id"), F.lit(None).cast("bigint").alias("declared"), line.alias("seen"))
    return records.unionByName(ends).groupBy(*NODE).agg(
        F.count("declared").alias("records"), F.min("declared").alias("declared_line"), F.min("seen").alias("seen_line")
    )


def late_ids(ids: DataFrame) -> DataFrame:
    """Ids that some edge uses before a record declares them, or that none declares: all that edges need to be compared with."""
    return ids.filter("seen_line is not null and (declared_line is null or declared_line > seen_line)").select(*NODE, "declared_line")


def _flagged(edges: DataFrame, late: DataFrame) -> DataFrame:
    """Flags per edge from the written table of ``late_ids``; edges are not shuffled while that is counted to be small."""
    found = edges.select("run_id", "line_number", "src", "dst")
    for side in ("src", "dst"):
        lookup = late.select("run_id", F.col("raw_node_id").alias(side), F.struct("declared_line").alias(f"{side}_late"))
        found = lookup_join(found, lookup, ["run_id", side], ["line_number"], "left")
    missing = {c: F.col(f"{c}_late").isNotNull() & F.col(f"{c}_late.declared_line").isNull() for c in ("src", "dst")}
    unseen = [missing[c] | F.coalesce(F.col(f"{c}_late.declared_line") > F.col("line_number"), F.lit(False)) for c in missing]
    return found.select(
        "run_id",
        "line_number",
        "src",
        "dst",
        missing["src"].alias("src_missing"),
        missing["dst"].alias("dst_missing"),
        (unseen[0] | unseen[1]).alias("missing_when_seen"),
    )


def endpoint_flags(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """Per edge: which endpoints are never declared, and whether one was undeclared when the edge came."""
    return _flagged(edges, materialize(late_ids(endpoint_ids(declared, edges)), "late_ids"))


COUNTS = (
    "nodes",
    "duplicate_node_records",
    "edges",
    "missing_src_edges",
    "missing_dst_edges",
    "true_dangling_edges",
    "edges_missing_when_seen",
    "parse_errors",
)


def integrity_by_run(
    runs: DataFrame, nodes: DataFrame, edges: DataFrame, parse_errors: DataFrame | None = None
) -> DataFrame:
    """Counts per run of ``runs``: what is known of ids, edges and errors is added up in one aggregate."""
    ids = materialize(endpoint_ids(nodes, edges), "ids")
    flags = _flagged(edges, materialize(late_ids(ids), "late_ids"))
    dangling = F.col("src_missing") | F.col("dst_missing")
    parts = [
        runs.select("run_id", "tool"),
        ids.select("run_id", F.col("records").alias("nodes"), F.greatest(F.col("records") - 1, F.lit(0)).alias("duplicate_node_records")),
        flags.select(
            "run_id", F.lit(1).alias("edges"), F.col("src_missing").cast("int").alias("missing_src_edges"),
            F.col("dst_missing").cast("int").alias("missing_dst_edges"), dangling.cast("int").alias("true_dangling_edges"),
            F.col("missing_when_seen").cast("int").alias("edges_missing_when_seen"),
        ),
    ]
    if parse_errors is not None:
        parts.append(parse_errors.select("run_id", "parse_errors"))
    tagged = [
        part.select(
            "run_id",
            F.col("tool") if "tool" in part.columns else F.lit(None).cast("string").alias("tool"),
            F.lit("tool" in part.columns).alias("listed"),
            *[F.col(c).cast("bigint").alias(c) if c in part.columns else F.lit(0).cast("bigint").alias(c) for c in COUNTS],
        )
        for part in parts
    ]
    rows = tagged[0]
    for part in tagged[1:]:
        rows = rows.unionByName(part)
    summed = rows.groupBy("run_id").agg(F.max("tool").alias("tool"), F.max("listed").alias("listed"), *[F.sum(c).alias(c) for c in COUNTS])
    return summed.filter("listed").select("run_id", "tool", *COUNTS)


def integrity_report(by_run: DataFrame) -> DataFrame:
    """Counts and shares per run, per tool and overall; ``run_id`` and ``tool`` are ``*`` on totals."""
    summed = by_run.rollup("tool", "run_id").agg(
        F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in COUNTS]
    )
    return summed.select(
        F.coalesce("tool", F.lit("*")).alias("tool"),
        F.coalesce("run_id", F.lit("*")).alias("run_id"),
        "files",
        *COUNTS,
        percentage(F.col("duplicate_node_records"), F.col("nodes"), 3).alias("duplicate_pct"),
        percentage(F.col("true_dangling_edges"), F.col("edges"), 3).alias("dangling_pct"),
        percentage(F.col("edges_missing_when_seen"), F.col("edges"), 3).alias("late_pct"),
    )


def anomalies(by_run: DataFrame) -> DataFrame:
    return by_run.filter("parse_errors > 0 or duplicate_node_records > 0 or true_dangling_edges > 0")


def first_examples(records: DataFrame) -> DataFrame:
    """First node and first edge record of every run in line order.

    Lines first, then their text: the text of all other records is never carried through an aggregate.
    """
    rows = records.filter(F.col("record_class").isin("node", "edge")).select("run_id", "record_class", "line_number", "raw")
    firsts = rows.groupBy("run_id", "record_class").agg(F.min("line_number").alias("line_number"))
    keys = ["run_id", "record_class", "line_number"]
    return lookup_join(rows, materialize(firsts, "firsts"), keys, keys, "left_semi")


def first_duplicates(nodes: DataFrame) -> DataFrame:
    """Per run the earliest record that repeats an id, with the first record of that id."""
    firsts = nodes.groupBy(*NODE).agg(
        F.min("line_number").alias("first_line"), F.count(F.lit(1)).alias("n")
    )
    repeats = hot_join(
        nodes.select(*NODE, "line_number"), firsts.filter("n > 1"), NODE, ["line_number"], "inner"
    ).filter("line_number > first_line")
    pair = F.struct("raw_node_id", "first_line", "line_number")
    picked = repeats.groupBy("run_id").agg(F.min_by(pair, "line_number").alias("p")).select("run_id", "p.*")
    return picked.select(
        "run_id", "raw_node_id", "first_line", F.col("line_number").alias("duplicate_line")
    )


def unlinked_nodes(records: DataFrame) -> DataFrame:
    """Declarations as the dangling-edge example sees them: records with an id and neither from nor to."""
    return records.filter("record_class = 'node' and not has_from and not has_to").select(*NODE, "line_number")


def first_dangling(flags: DataFrame) -> DataFrame:
    """Per run the earliest edge with an undeclared endpoint."""
    lost = flags.filter("src_missing or dst_missing")
    edge = F.struct("line_number", "src", "dst", "src_missing", "dst_missing")
    return lost.groupBy("run_id").agg(F.min_by(edge, "line_number").alias("e")).select("run_id", "e.*")
