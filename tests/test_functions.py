import pytest
from pyspark.sql import functions as F

from traceloom.functions import ids, names, text, times


def evaluate(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "stamp, ns, precision",
    [
        ("2024:01:02T03:04:05", 1704164645000000000, 10**9),
        ("2024-01-02T03:04:05.5Z", 1704164645500000000, 10**8),
        ("2024-01-02T03:04:05.1234567899", 1704164645123456789, 1),
        ("2024-1-2T3:4:5", 1704164645000000000, 10**9),
        ("2024-01-02T03:04:05.Z", 1704164645000000000, 10**9),
        ("2024-01-02 03:04:05", None, 10**9),
    ],
)
def test_datetime(spark, stamp, ns, precision):
    assert evaluate(spark, stamp, times.datetime_ns) == ns
    assert evaluate(spark, stamp, times.precision_ns) == precision


def test_decimal_seconds(spark):
    assert evaluate(spark, "1700000000.1234567899", times.decimal_seconds_ns) == 1700000000123456789


def test_ns_label(spark):
    assert evaluate(spark, 1704164645500000001, times.ns_label, "bigint") == "2024-01-02 03:04:05.500000001"
    assert evaluate(spark, 1999999999999999999, times.whole_seconds, "bigint") == 1999999999


def test_event_timestamp(spark):
    rows = [
        ("recap", {"ts": "2024-01-01T00:00:00.5Z"}),
        ("recap", {"cf:date": "2024:01:01T00:00:01"}),
        ("camflow", {"cf:date": "2024:01:01T00:00:00", "cf:jiffies": "77"}),
        ("camflow", {"cf:date": "2024:01:01T00:00:00", "cf:jiffies": "", "jiffies": "5"}),
        ("conprov", {"ts": "2024:01:01T00:00:00", "cf:jiffies": "77"}),
    ]
    df = spark.createDataFrame(rows, "tool string, a map<string,string>")
    got = [r["t"] for r in df.select(times.event_timestamp(F.col("tool"), F.col("a")).alias("t")).collect()]
    base = 1704067200 * 10**9
    assert [(g["wall_time_ns"] - base, g["model_time"], g["model_time_unit"], g["order"], g["source"]) for g in got] == [
        (5 * 10**8, base + 5 * 10**8, "ns", 0, "ts"),
        (10**9, base + 10**9, "ns", 0, "ts"),
        (0, 77, "jiffies", 77, "cf:date+cf:jiffies"),
        (0, 5, "jiffies", 5, "cf:date+cf:jiffies"),
        (0, 1704067200, "seconds", 0, "cf:date"),
    ]


def test_run_names(spark):
    strict = evaluate(spark, "web_benign_1_recap_run_12", names.run_name)
    assert tuple(strict) == ("web_benign_1", "recap", "benign")
    assert tuple(evaluate(spark, "x_foo", names.run_name)) == (None, None, None)
    assert evaluate(spark, "web_benign_1_recap_run_12", names.run_name_loose)["tool"] == "12"
    assert evaluate(spark, "/a/b/web_CVE-1_recap.jsonl", names.file_stem) == "web_CVE-1_recap"
    assert tuple(evaluate(spark, "web_CVE-2024-1_CVE-2", names.attack_scenario)) == ("web", "CVE-2024-1_CVE-2")
    assert evaluate(spark, "web_benign_1", names.attack_scenario) is None
    assert evaluate(spark, "opensmtpd", names.scenario_alias) == "smtpd"


def test_name_helpers(spark):
    assert evaluate(spark, "0.0003", names.value_token) == "0p0003"
    assert evaluate(spark, "1e-05", names.value_token) == "1em05"
    assert evaluate(spark, "__a b/c.-", names.safe_name) == "a_b_c"
    assert evaluate(spark, None, names.fixed_number) == "-"
    assert evaluate(spark, "0.12345", names.fixed_number) == "0.123"
    assert evaluate(spark, "r3_e9", names.rung_number) == 3
    assert evaluate(spark, "final", names.rung_number) == 999


def test_relations(spark):
    rows = [
        ({"relation_type": None, "relation": "x"},),
        ({"cf:relation": " Read  File "},),
        ({"prov:relation": ""},),
        ({},),
    ]
    df = spark.createDataFrame(rows, "attributes map<string,string>").withColumn("prov_type", F.lit(None).cast("string"))
    got = text.annotate_edges(df).select("relation_field", "relation_value", "raw_relation_value", "edge_label", "features.relation").collect()
    assert [tuple(r) for r in got] == [
        ("relation_type", "<missing>", "<missing>", "<missing>:<missing>", None),
        ("cf:relation", "read_file", " Read  File ", "<missing>:read_file", "read_file"),
        ("prov:relation", "<missing>", "", "<missing>:<missing>", None),
        ("<missing>", "<missing>", "<missing>", "<missing>:<missing>", None),
    ]


def test_node_labels(spark):
    rows = [
        ({"object_type": "Process", "comm": "nginx", "cmdLine": "nginx -g", "cwd": "/"}, False),
        ({"object_type": "odd", "_raw_type_hint": "file"}, False),
        ({"object_type": "<missing>", "_raw_type_hint": "Regular  File", "path": "/x"}, False),
        ({"object_type": "socket", "remote_ip": "1.2.3.4", "port": "80", "family": "ip"}, False),
        ({"object_type": "<missing>", "_raw_type_hint": "<unknown>"}, True),
        ({"object_type": "<missing>"}, True),
    ]
    df = spark.createDataFrame(rows, "a map<string,string>, p boolean")
    df = df.withColumn("f", text.node_features(F.col("a"))).withColumn("t", text.node_type(F.col("a")))
    label = text.node_label(F.col("t"), F.col("a"), F.col("f"), F.col("p"))
    got = df.select("t", label.alias("l"), text.node_path(F.col("t"), F.col("f"))["path"].alias("path")).collect()
    assert [tuple(r) for r in got] == [
        ("process", "process nginx nginx -g /", "nginx"),
        ("unknown", "unknown file", "missing_endpoint"),
        ("regular file", "regular file Regular  File /x /x", "/x"),
        ("socket", "socket 1.2.3.4 80 ip", "1.2.3.4:80"),
        ("unknown", "missing_endpoint <unknown>", "missing_endpoint"),
        ("unknown", "missing_endpoint", "missing_endpoint"),
    ]
    assert len(text.NODE_TYPES) == 26


def test_stable_ids(spark):
    df = spark.createDataFrame([("r", "n")], "r string, n string")
    got = df.select(ids.global_node_id(F.col("r"), F.col("n")).alias("i")).first()["i"]
    assert got == "node_347f6f991c8aca91d9c9f974b4e2d5cfa7c32947"
