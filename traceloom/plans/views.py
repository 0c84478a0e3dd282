"""Views that give the driver's tables the shape of captures, labels and trials.

The tables hold no provenance data.  Every view maps all rows of its table; remainders only decide which
run a row belongs to or which rows are made dirty, they never thin the data out.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.names import TOOLS
from traceloom.operators.ordered import scan
from traceloom.session import materialize
from traceloom.sources.raw import chosen, drop_blank, name_runs, project_records, repair_undecided, with_tier

RUNS = 40
LABEL_NS = 600_000_000_000


def run_columns(number: Column) -> dict[str, Column]:
    """run_id, tool, scenario and kind of run number 0..39: ten scenarios, four tools."""
    r = number.cast("int")
    s = F.call_function("div", r, F.lit(4)).cast("int")
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), r % 4 + 1)
    benign = s < 7
    scenario = F.when(benign, F.concat(F.lit("svc"), s.cast("string"), F.lit("_benign_1"))).otherwise(
        F.concat(F.lit("svc"), s.cast("string"), F.lit("_CVE-2024-"), (s + 1000).cast("string"))
    )
    return {
        "run_id": F.concat_ws("_", scenario, tool),
        "tool": tool,
        "scenario": scenario,
        "kind": F.when(benign, "benign").otherwise("cve"),
    }


class Views:
    """The views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        wall = F.unix_micros(F.col("ts").cast("timestamp")) * F.lit(1000)
        return self.table("events").select(
            "event_id",
            "user_id",
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            wall.alias("wall_time_ns"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        numbers = self.table("events").select((F.col("event_id") % RUNS).alias("r")).distinct()
        return numbers.select(*[c.alias(n) for n, c in run_columns(F.col("r")).items()])

    @cached_property
    def edges(self) -> DataFrame:
        return self.events.select(
            *[c.alias(n) for n, c in run_columns(F.col("event_id") % RUNS).items()],
            F.col("event_id").cast("string").alias("raw_edge_id"),
            F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("src"),
            F.concat(F.lit("o"), F.col("k").cast("string")).alias("dst"),
            F.when(F.col("event_type") != "error", "Used").alias("prov_type"),
            F.col("event_type").alias("relation"),
            F.create_map(F.lit("relation"), F.col("event_type")).alias("attributes"),
            "wall_time_ns",
            F.when(F.col("event_id") % 3 == 0, 1_000_000_000).otherwise(1000).cast("bigint").alias("wall_time_precision_ns"),
            F.lit(0).cast("bigint").alias("order"),
            (F.col("event_id") + 1).alias("line_number"),
            F.lit(None).cast("string").alias("from_type"),
            F.when(F.col("user_id") % 2 == 0, "file").otherwise("socket").alias("to_type"),
            "value",
            "user_id",
            "k",
        )

    @cached_property
    def declared(self) -> DataFrame:
        """Declared ids with their line: a seventh of the sources and a fifth of the targets are declared under another id."""
        late = F.when(F.col("k") % 3 == 0, 50).otherwise(0)
        declared = lambda end, other: F.when(other, F.concat(F.lit("x"), F.col(end))).otherwise(F.col(end)).alias("raw_node_id")
        src = F.struct(declared("src", F.col("user_id") % 7 == 0), F.col("line_number"))
        dst = F.struct(declared("dst", F.col("k") % 5 == 0), (F.col("line_number") + late).alias("line_number"))
        ends = self.edges.select("run_id", F.explode(F.array(src, dst)).alias("e"))
        return ends.groupBy("run_id", "e.raw_node_id").agg(F.min("e.line_number").alias("line_number"))

    @cached_property
    def nodes(self) -> DataFrame:
        """Node records with many duplicates: one logical node per order, one record per line item."""
        items = self.table("lineitem")
        numbered = scan(items, ["l_orderkey"], _NODE_ORDER, {"line_number": ("rank", None)})
        part = F.when(F.col("l_partkey") % 4 == 0, "").otherwise((F.col("l_partkey") % 3).cast("string"))
        shaped = numbered.select(
            *[c.alias(n) for n, c in run_columns(F.col("l_orderkey") % RUNS).items() if n in ("run_id", "tool")],
            F.col("l_orderkey").cast("string").alias("raw_node_id"),
            F.col("l_linestatus").alias("prov_type"),
            F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("part"), part).alias("attributes"),
            F.concat_ws("|", "l_linestatus", "l_returnflag", part).alias("raw"),
            "line_number",
        )
        return shaped

    @cached_property
    def features(self) -> DataFrame:
        """Nodes of every family: customers as processes, parts as files, suppliers as sockets, nations as placeholders."""
        text = F.col
        process = self.table("customer").select(
            F.concat(F.lit("c"), text("c_custkey").cast("string")).alias("raw_node_id"),
            F.create_map(
                F.lit("object_type"), F.when(F.col("c_custkey") % 7 == 0, " Task ").otherwise("process"),
                F.lit("comm"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")),
                F.lit("processName"), F.when(F.col("c_custkey") % 10 == 0, "<unknown>").otherwise(F.col("c_mktsegment")),
                F.lit("cmd"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise(""),
                F.lit("cwd"), F.concat(F.lit("/n/"), F.col("c_nationkey").cast("string")),
            ).alias("attributes"),
            F.lit(False).alias("is_placeholder"),
        )
        file = self.table("part").select(
            F.concat(F.lit("f"), text("p_partkey").cast("string")).alias("raw_node_id"),
            F.create_map(
                F.lit("object_type"),
                F.when(F.col("p_type") == "ECONOMY", " Regular   FILE").when(F.col("p_type") == "STANDARD", "File").otherwise(F.col("p_type")),
                F.lit("path"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")),
                F.lit("filename"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("<missing>"),
            ).alias("attributes"),
            F.lit(False).alias("is_placeholder"),
        )
        network = self.table("supplier").select(
            F.concat(F.lit("s"), text("s_suppkey").cast("string")).alias("raw_node_id"),
            F.create_map(
                F.lit("object_type"), F.when(F.col("s_suppkey") % 3 == 0, "Socket").when(F.col("s_suppkey") % 3 == 1, "<missing>").otherwise("netflow"),
                F.lit("_raw_type_hint"), F.lit("address"),
                F.lit("remote_ip"), F.when(F.col("s_suppkey") % 6 != 0, F.col("s_name")),
                F.lit("remote_port"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey").cast("string")),
                F.lit("family"), F.concat(F.lit("af"), F.col("s_nationkey").cast("string")),
            ).alias("attributes"),
            F.lit(False).alias("is_placeholder"),
        )
        placeholder = self.table("nation").select(
            F.concat(F.lit("n"), text("n_nationkey").cast("string")).alias("raw_node_id"),
            F.create_map(
                F.lit("object_type"), F.lit("<missing>"),
                F.lit("_raw_type_hint"), F.when(F.col("n_nationkey") % 2 == 0, "<unknown>").otherwise(F.lower("n_name")),
            ).alias("attributes"),
            F.lit(True).alias("is_placeholder"),
        )
        return process.unionByName(file).unionByName(network).unionByName(placeholder)

    @cached_property
    def labels(self) -> DataFrame:
        """A ten-minute label window at every valuable event of an attack run."""
        return self.edges.filter("kind = 'cve' and value >= 100").select(
            F.substring_index("scenario", "_CVE-", 1).alias("scenario"),
            F.concat(F.lit("CVE-"), F.substring_index("scenario", "_CVE-", -1)).alias("cve"),
            "tool",
            F.col("wall_time_ns").alias("start_ns"),
            (F.col("wall_time_ns") + F.lit(LABEL_NS)).alias("end_ns"),
        )

    @cached_property
    def raw_lines(self) -> DataFrame:
        """One JSON line per event: some cut short, blank or not an object, some with a byte that is no UTF-8, some with bare quotes in a string."""
        run = run_columns(F.col("event_id") % RUNS)
        text = {c: F.col(c).cast("string") for c in ("user_id", "k", "event_id")}
        user = F.col("user_id") % 7
        stray = F.when(user == 1, F.unhex(F.lit("E9")).cast("string")).when(user == 2, "é").otherwise("")
        node = F.concat(
            F.format_string('{"id": "p%s", "type": "Activity", "annotations": {"object_type": "process", "size": %s.%s0, "comm": "u', text["user_id"], text["user_id"], text["k"]),
            stray, text["user_id"], F.lit('"}}'),
        )
        said = F.when(F.col("event_id") % 7 == 3, F.concat(F.lit(', "cmd": "say "'), text["k"], F.lit('" now"'))).otherwise("")
        edge = F.format_string(
            '{"from": "p%s", "to": "o%s", "type": "Used", "annotations": {"id": "%s", "%s": "%s", "size": %se0%s}}',
            text["user_id"], text["k"], text["event_id"],
            F.when(F.col("user_id") % 3 == 0, "relation_type").otherwise("relation"), F.col("event_type"), text["k"], said,
        )
        line = F.when(F.col("event_type") == "signup", node).otherwise(edge)
        line = (
            F.when(F.col("event_id") % 17 == 0, "")
            .when(F.col("event_id") % 13 == 0, F.concat(F.lit("["), text["event_id"], F.lit("]")))
            .when(F.col("event_id") % 11 == 0, F.left(line, F.length(line) - 1))
            .otherwise(line)
        )
        # A line takes far longer to decode than its event to read: dealt evenly, however few the splits of the table are.
        return self.events.repartition("event_id").select(
            F.concat(F.lit("/raw/"), run["run_id"], F.lit(".jsonl")).alias("file_path"),
            (F.col("event_id") + 1).alias("line_number"),
            line.alias("value"),
        )

    @cached_property
    def decoded(self) -> DataFrame:
        staged = materialize(with_tier(self.raw_lines), "decoded")
        return name_runs(repair_undecided(staged.filter("tier is null or tier <> 'blank'")))

    @cached_property
    def records(self) -> DataFrame:
        return project_records(drop_blank(self.decoded))

    def records_of(self, *columns: str | Column) -> DataFrame:
        """``records`` with these columns beside file_path, line_number, tier, non_ascii and the run columns."""
        return chosen(self.raw_lines, [F.col(c) if isinstance(c, str) else c for c in columns])

    @cached_property
    def trials(self) -> DataFrame:
        return self.table("orders").select(
            F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string")).alias("method"),
            F.concat(F.lit("r"), F.left("o_orderpriority", F.lit(1)), F.lit("_e"), F.left("o_orderpriority", F.lit(1))).alias("rung"),
            F.col("o_orderkey").cast("string").alias("name"),
            F.when(F.col("o_orderkey") % 19 != 0, F.col("o_totalprice")).alias("metric"),
            F.lit("hpo").alias("phase"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("exit_code"),
            F.lit(True).alias("exit_code_present"),
            (F.col("o_orderkey") % 23 == 0).alias("oom"),
            (F.col("o_orderkey") % 5 != 0).alias("checkpoint_saved"),
            (F.col("o_orderkey") % 5 != 0).alias("checkpoint_exists"),
            F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("file_name"),
            "o_orderstatus",
            "o_orderkey",
        )

    @cached_property
    def log_lines(self) -> DataFrame:
        value = F.col("value").cast("string")
        text = (
            F.when(F.col("event_type") == "view", F.concat(F.lit("[@epoch"), (F.col("event_id") % 12).cast("string"), F.lit("] Val Loss: "), value))
            .when(F.col("event_type") == "click", F.concat(F.lit("[@epoch"), (F.col("event_id") % 12).cast("string"), F.lit("] Test Loss: "), value))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("{'adp_score': "), value, F.lit(", 'tp': "), F.col("k").cast("string"), F.lit("}")))
            .when((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0), "CUDA out of memory")
            .otherwise(F.col("event_type"))
        )
        return self.events.select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), text.alias("text"))


_NODE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
