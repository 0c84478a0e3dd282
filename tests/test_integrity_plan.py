"""Integrity: the same flags as edge by edge, and plans that shuffle ids rather than edges."""

import random

from pyspark.sql import functions as F

from traceloom.operators import integrity, ordered


def tables(spark, seed):
    draw = random.Random(seed)
    nodes = [(draw.choice("ab"), f"n{int(draw.paretovariate(0.5)) % 40}", line) for line in draw.sample(range(400), 60)]
    edges = [(draw.choice("abc"), line, f"n{int(draw.paretovariate(0.5)) % 60}", f"n{draw.randrange(60)}") for line in draw.sample(range(400), 200)]
    return nodes, edges, spark.createDataFrame(nodes, "run_id string, raw_node_id string, line_number bigint"), spark.createDataFrame(edges, "run_id string, line_number bigint, src string, dst string")


def expected(nodes, edges):
    first = {}
    for run, node, line in nodes:
        first[run, node] = min(line, first.get((run, node), line))
    out = []
    for run, line, src, dst in edges:
        at = [first.get((run, end)) for end in (src, dst)]
        out.append((run, line, src, dst, at[0] is None, at[1] is None, any(a is None or a > line for a in at)))
    return sorted(out)


def test_flags_edge_by_edge(spark, monkeypatch):
    for seed in range(3):
        nodes, edges, node_frame, edge_frame = tables(spark, seed)
        found = integrity.endpoint_flags(edge_frame, node_frame)
        assert sorted(map(tuple, found.collect())) == expected(nodes, edges)
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ordered.small_enough, "__defaults__", (0,))
    assert sorted(map(tuple, integrity.endpoint_flags(edge_frame, node_frame).collect())) == expected(nodes, edges)


def test_counts_per_run(spark):
    nodes, edges, node_frame, edge_frame = tables(spark, 7)
    runs = spark.createDataFrame([(r, "recap") for r in "abd"], "run_id string, tool string")
    errors = spark.createDataFrame([("a", 3), ("c", 9)], "run_id string, parse_errors bigint")
    flags = expected(nodes, edges)
    got = {r["run_id"]: r.asDict() for r in integrity.integrity_by_run(runs, node_frame, edge_frame, errors).collect()}
    assert set(got) == {"a", "b", "d"}
    for run in "abd":
        own, records = [f for f in flags if f[0] == run], [n for n in nodes if n[0] == run]
        row = got[run]
        assert (row["nodes"], row["duplicate_node_records"]) == (len(records), len(records) - len({n[1] for n in records}))
        assert row["edges"] == len(own) and row["missing_src_edges"] == sum(f[4] for f in own) and row["missing_dst_edges"] == sum(f[5] for f in own)
        assert row["true_dangling_edges"] == sum(f[4] or f[5] for f in own) and row["edges_missing_when_seen"] == sum(f[6] for f in own)
        assert row["parse_errors"] == (3 if run == "a" else 0) and row["tool"] == "recap"


def test_edges_are_not_shuffled(spark):
    """What reaches an exchange is grouped by id or by run; no exchange carries an edge's line."""
    *_, node_frame, edge_frame = tables(spark, 7)
    runs = spark.createDataFrame([(r, "recap") for r in "abc"], "run_id string, tool string")
    report = integrity.integrity_report(integrity.integrity_by_run(runs, node_frame, edge_frame))
    plan = report._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) <= 2 and not any("line_number" in line for line in shuffles)
    flags = integrity.endpoint_flags(edge_frame, node_frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in flags and flags.count("BroadcastHashJoin") == 2
