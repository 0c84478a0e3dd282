import random

import pytest

from traceloom.operators import integrity, repair

U = "<unknown>"


def fold(records):
    """The sequential merge of one id: records are (type, attributes) in line order."""
    kind, attributes = records[0][0], dict(records[0][1])
    exact = conflicts = 0
    fields = []
    for other_kind, other in records[1:]:
        if kind == other_kind and (records[0][0], records[0][1]) == (other_kind, other):
            exact += 1
            continue
        clash = False
        if kind != other_kind:
            kind, clash = None, True
            fields += ["prov_type"] * ("prov_type" not in fields)
        for key, value in other.items():
            if key not in attributes:
                attributes[key] = value
                continue
            mine = attributes[key]
            if mine == value:
                merged = mine
            elif mine in (None, ""):
                merged = value
            elif value in (None, ""):
                merged = mine
            else:
                merged = U
            if merged == U and mine != value:
                clash = True
                fields += [key] * (key not in fields)
            attributes[key] = merged
        conflicts += clash
    return kind, attributes, len(records), exact, conflicts, sorted(fields)


def random_nodes(seed, ids=150):
    rng = random.Random(seed)
    nodes = {}
    for n in range(ids):
        size = rng.choice([1, 1, 2, 3, 5, 9])
        pool = rng.choice([["x"], ["x", "y"], ["x", "", None], ["", None], ["x", "y", "", None, U], [U, None, "x"]])
        records = []
        for _ in range(size):
            keys = [k for k in ("a", "b", "c") if rng.random() < 0.7]
            record = (rng.choice(["E", "E", "A", None]), {k: rng.choice(pool) for k in keys})
            records.append(rng.choice(records) if records and rng.random() < 0.3 else record)
        nodes[f"n{n}"] = records
    return nodes


def frame(spark, nodes):
    data = []
    for id_, records in nodes.items():
        for line, (kind, attributes) in enumerate(records, 1):
            raw = repr((kind, sorted(attributes.items(), key=lambda kv: kv[0])))
            data.append(("run", id_, kind, line, attributes, raw))
    random.Random(0).shuffle(data)
    schema = "run_id string, raw_node_id string, prov_type string, line_number bigint, attributes map<string,string>, raw string"
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("seed, hot", [(1, 10**6), (1, 1), (2, 10**6), (2, 3), (3, 2)])
def test_merge_equals_the_sequential_fold(spark, seed, hot):
    nodes = random_nodes(seed)
    got = {
        r["raw_node_id"]: (
            r["prov_type"], r["attributes"], r["duplicate_count"], r["duplicate_exact_count"], r["duplicate_conflict_count"],
            sorted(r["conflicting_fields"]),
        )
        for r in repair.merge_duplicates(frame(spark, nodes), hot_rows=hot).collect()
    }
    assert got == {id_: fold(records) for id_, records in nodes.items()}


def test_golden_merges(spark):
    nodes = {
        "f": [("E", {"path": "/etc/passwd"}), ("E", {"path": "/etc/shadow"})],
        "m": [("E", {"k": ""}), ("E", {"k": None})],
        "u": [("E", {"k": "x"}), ("E", {"k": "y"}), ("E", {"k": ""})],
    }
    got = {r["raw_node_id"]: r for r in repair.merge_duplicates(frame(spark, nodes)).collect()}
    assert got["f"]["attributes"] == {"path": U} and got["f"]["conflicting_fields"] == ["path"]
    assert got["f"]["duplicate_exact_count"] == 0 and got["f"]["duplicate_conflict_count"] == 1
    assert got["m"]["attributes"] == {"k": None}
    assert got["u"]["attributes"] == {"k": U} and got["u"]["duplicate_conflict_count"] == 2
    assert repair.source_records(frame(spark, nodes)).count() == 7


EDGE = "run_id string, src string, dst string, line_number bigint, from_type string, to_type string"


def test_placeholders(spark):
    edges = spark.createDataFrame(
        [
            ("r", "p", "s", 1, None, " Socket "), ("r", "p", "s", 2, None, None), ("r", "p", "s", 3, None, "SOCKET"),
            ("r", "p", "t", 4, None, "socket"), ("r", "t", "p", 5, "file", None), ("r", "p", "n", 6, None, None),
        ],
        EDGE,
    )
    declared = spark.createDataFrame([("r", "p", 1)], "run_id string, raw_node_id string, line_number bigint")
    got = {r["raw_node_id"]: r["attributes"] for r in repair.placeholder_nodes(edges, declared).collect()}
    assert {k: v.get("_raw_type_hint") for k, v in got.items()} == {"s": "socket", "t": U, "n": None}
    assert "_raw_type_hint" not in got["n"] and got["s"]["object_type"] == "<missing>"


def test_integrity(spark):
    edges = spark.createDataFrame([("r", "a", "b", 2, None, None), ("r", "a", "x", 4, None, None), ("r", "y", "x", 5, None, None)], EDGE)
    nodes = spark.createDataFrame([("r", "a", 1), ("r", "b", 3), ("r", "a", 6)], "run_id string, raw_node_id string, line_number bigint")
    runs = spark.createDataFrame([("r", "recap"), ("empty", "recap")], "run_id string, tool string")
    by_run = integrity.integrity_by_run(runs, nodes, edges)
    row = by_run.filter("run_id = 'r'").first().asDict()
    assert {k: row[k] for k in integrity.COUNTS} == {
        "nodes": 3, "duplicate_node_records": 1, "edges": 3, "missing_src_edges": 1, "missing_dst_edges": 2, "true_dangling_edges": 2,
        "edges_missing_when_seen": 3, "parse_errors": 0,
    }
    assert [r["run_id"] for r in integrity.anomalies(by_run).collect()] == ["r"]
    total = integrity.integrity_report(by_run).filter("tool = '*'").first()
    assert total["files"] == 2 and total["dangling_pct"] == 66.667
    assert tuple(integrity.first_duplicates(nodes).first()) == ("r", "a", 1, 6)
    lost = integrity.first_dangling(integrity.endpoint_flags(edges, nodes)).first()
    assert (lost["line_number"], lost["src_missing"], lost["dst_missing"]) == (4, False, True)
