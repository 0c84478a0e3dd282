"""The registered queries in plain SQL, written independently of the Spark plans (DuckDB dialect)."""

from __future__ import annotations

SIX_HOURS, ONE_DAY = 21_600_000_000_000, 86_400_000_000_000

RUNS = """
v_runs AS (
  SELECT r, tool, kind, scenario, scenario || '_' || tool AS run_id FROM (
    SELECT r, (['camflow','conprov','provbpf','recap'])[r % 4 + 1] AS tool,
      CASE WHEN r // 4 < 7 THEN 'benign' ELSE 'cve' END AS kind,
      CASE WHEN r // 4 < 7 THEN 'svc' || (r // 4) || '_benign_1'
           ELSE 'svc' || (r // 4) || '_CVE-2024-' || (1000 + r // 4) END AS scenario
    FROM (SELECT DISTINCT CAST(event_id % 40 AS INT) AS r FROM events)))"""

EDGES = RUNS + """,
ev AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    CAST(epoch_us(ts) AS BIGINT) * 1000 AS wall_time_ns, CAST(event_id % 40 AS INT) AS r
  FROM events),
v_edges AS (
  SELECT run_id, tool, scenario, kind, CAST(event_id AS VARCHAR) AS raw_edge_id, event_id, 'p' || user_id AS src, 'o' || k AS dst,
    CASE WHEN event_type <> 'error' THEN 'Used' END AS prov_type, event_type AS relation, wall_time_ns,
    CAST(CASE WHEN event_id % 3 = 0 THEN 1000000000 ELSE 1000 END AS BIGINT) AS wall_time_precision_ns,
    event_id + 1 AS line_number, CASE WHEN user_id % 2 = 0 THEN 'file' ELSE 'socket' END AS to_type, value, user_id, k
  FROM ev JOIN v_runs USING (r)),
v_ends AS (SELECT *, wall_time_ns + wall_time_precision_ns - 1 AS end_ns FROM v_edges)"""

DECLARED = EDGES + """,
v_declared AS (
  SELECT run_id, src AS raw_node_id, min(line_number) AS line_number FROM (SELECT * REPLACE (CASE WHEN user_id % 7 = 0 THEN 'x' || src ELSE src END AS src) FROM v_edges) GROUP BY 1, 2
  UNION ALL
  SELECT run_id, dst, min(line_number + CASE WHEN k % 3 = 0 THEN 50 ELSE 0 END) FROM (SELECT * REPLACE (CASE WHEN k % 5 = 0 THEN 'x' || dst ELSE dst END AS dst) FROM v_edges) GROUP BY 1, 2)"""

LABELLED = EDGES + """,
v_labels AS (
  SELECT split_part(scenario, '_CVE-', 1) AS scenario, 'CVE-' || split_part(scenario, '_CVE-', 2) AS cve, tool,
    wall_time_ns AS start_ns, wall_time_ns + 600000000000 AS end_ns
  FROM v_edges WHERE kind = 'cve' AND value >= 100),
v_range AS (SELECT run_id, min(wall_time_ns) AS range_start_ns, max(end_ns) AS range_end_ns FROM v_ends GROUP BY 1),
v_attack AS (
  SELECT run_id, l.scenario, l.cve, l.tool, l.start_ns, l.end_ns
  FROM v_runs r JOIN v_range USING (run_id) JOIN v_labels l
    ON l.tool = r.tool AND r.scenario = l.scenario || '_' || l.cve
  WHERE kind <> 'benign' AND l.start_ns <= range_end_ns AND l.end_ns >= range_start_ns),
v_y AS (
  SELECT e.*, CASE WHEN EXISTS (SELECT 1 FROM v_attack a WHERE a.run_id = e.run_id AND a.start_ns <= e.end_ns
    AND a.end_ns >= e.wall_time_ns) THEN 1 ELSE 0 END AS y
  FROM v_ends e)"""


def cut(source: str, width: int, name: str) -> str:
    """Greedy windows by recursion, and the window of every row of ``source``."""
    return f""",
{name}_starts AS (
  SELECT run_id, CAST(1 AS BIGINT) AS window_index, min(wall_time_ns) AS start_ns FROM {source} GROUP BY run_id
  UNION ALL
  SELECT w.run_id, w.window_index + 1, min(e.wall_time_ns)
  FROM {name}_starts w JOIN {source} e ON e.run_id = w.run_id AND e.wall_time_ns >= w.start_ns + {width}
  GROUP BY w.run_id, w.window_index),
{name} AS (
  SELECT e.*, w.window_index, w.start_ns FROM {source} e JOIN {name}_starts w
    ON e.run_id = w.run_id AND e.wall_time_ns >= w.start_ns AND e.wall_time_ns < w.start_ns + {width})"""


def label(ns: str) -> str:
    return f"strftime(make_timestamp({ns} // 1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST({ns} % 1000000000 AS VARCHAR), 9, '0')"


def stats(source: str, name: str) -> str:
    return f""",
{name}_nodes AS (
  SELECT run_id, window_index, count(DISTINCT node) AS node_count FROM (
    SELECT run_id, window_index, src AS node FROM {source} UNION ALL SELECT run_id, window_index, dst FROM {source})
  GROUP BY 1, 2),
{name} AS (
  SELECT run_id, window_index, node_count, edge_count, attack_edge_count, CAST(attack_edge_count > 0 AS BIGINT) AS y, start_ns, end_ns,
    {label('start_ns')} || '~' || {label('end_ns')} AS file_name
  FROM (SELECT run_id, window_index, start_ns, max(wall_time_ns) AS end_ns, count(*) AS edge_count, CAST(sum(y) AS BIGINT) AS attack_edge_count
        FROM {source} GROUP BY ALL) JOIN {name}_nodes USING (run_id, window_index))"""


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip().lstrip(',')}\n{select}"


def frequent(by: str, value: str, k: int) -> str:
    return f"""SELECT {by}, value, n, round(n * 100.0 / sum(n) OVER (PARTITION BY {by}), 2) AS share, first_line,
      row_number() OVER (PARTITION BY {by} ORDER BY n DESC, first_line, value) AS position
    FROM (SELECT {by}, {value} AS value, count(*) AS n, min(line_number) AS first_line FROM v_records
      WHERE record_class IS NOT NULL AND {value} IS NOT NULL GROUP BY 1, 2) QUALIFY position <= {k}"""


NODES = RUNS + """,
v_nodes AS (
  SELECT run_id, CAST(l_orderkey AS VARCHAR) AS raw_node_id, l_linestatus AS prov_type, l_returnflag AS flag,
    CASE WHEN l_partkey % 4 = 0 THEN '' ELSE CAST(l_partkey % 3 AS VARCHAR) END AS part,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line
  FROM lineitem JOIN v_runs ON r = CAST(l_orderkey % 40 AS INT)),
v_raw AS (SELECT *, prov_type || '|' || flag || '|' || part AS raw FROM v_nodes),
step AS (
  SELECT run_id, raw_node_id, line, prov_type, flag, part, raw AS raw0, 0 AS ex, 0 AS cf,
    false AS c_type, false AS c_flag, false AS c_part
  FROM v_raw WHERE line = 1
  UNION ALL
  SELECT run_id, raw_node_id, line,
    CASE WHEN same OR t IS NOT DISTINCT FROM nt THEN t END,
    CASE WHEN same THEN f ELSE mf END, CASE WHEN same THEN p ELSE mp END, raw0,
    ex + CAST(same AS INT), cf + CAST(NOT same AND (dt OR df OR dp) AS INT),
    c_type OR (NOT same AND dt), c_flag OR (NOT same AND df), c_part OR (NOT same AND dp)
  FROM (
    SELECT *, t IS DISTINCT FROM nt AS dt, mf = '<unknown>' AND f <> nf AS df, mp = '<unknown>' AND p <> np AS dp FROM (
      SELECT s.run_id, s.raw_node_id, n.line, s.prov_type AS t, n.prov_type AS nt, s.flag AS f, n.flag AS nf, s.part AS p, n.part AS np,
        s.raw0, s.ex, s.cf, s.c_type, s.c_flag, s.c_part,
        s.prov_type IS NOT DISTINCT FROM n.prov_type AND s.raw0 = n.raw AS same,
        CASE WHEN s.flag = n.flag THEN s.flag WHEN s.flag = '' THEN n.flag WHEN n.flag = '' THEN s.flag ELSE '<unknown>' END AS mf,
        CASE WHEN s.part = n.part THEN s.part WHEN s.part = '' THEN n.part WHEN n.part = '' THEN s.part ELSE '<unknown>' END AS mp
      FROM step s JOIN v_raw n ON n.run_id = s.run_id AND n.raw_node_id = s.raw_node_id AND n.line = s.line + 1))),
v_merged AS (
  SELECT run_id, raw_node_id, prov_type, flag, part, CAST(line AS BIGINT) AS duplicate_count,
    CAST(ex AS BIGINT) AS duplicate_exact_count, CAST(cf AS BIGINT) AS duplicate_conflict_count,
    concat_ws(',', CASE WHEN c_flag THEN 'flag' END, CASE WHEN c_part THEN 'part' END, CASE WHEN c_type THEN 'prov_type' END) AS conflicting_fields
  FROM step QUALIFY line = max(line) OVER (PARTITION BY run_id, raw_node_id))"""

HOLES = DECLARED + """,
v_mentions AS (
  SELECT run_id, src AS raw_node_id, CAST(NULL AS VARCHAR) AS hint, line_number AS line, 0 AS side FROM v_edges
  UNION ALL SELECT run_id, dst, to_type, line_number, 1 FROM v_edges),
v_holes AS (
  SELECT m.* FROM v_mentions m WHERE NOT EXISTS (
    SELECT 1 FROM v_declared d WHERE d.run_id = m.run_id AND d.raw_node_id = m.raw_node_id)),
v_place AS (
  SELECT run_id, raw_node_id,
    CASE WHEN count(DISTINCT hint) > 1 THEN '<unknown>' ELSE min(hint) END AS raw_type_hint
  FROM v_holes GROUP BY 1, 2)"""

KINDS = """,
kinds AS (SELECT tool, run_id, raw_node_id AS node, CASE WHEN raw_node_id LIKE 'p%' THEN 'process' ELSE 'file' END AS node_type
  FROM v_declared JOIN v_runs USING (run_id)),
used AS (SELECT run_id, src AS node FROM v_edges UNION SELECT run_id, dst FROM v_edges)"""

FLAGS = DECLARED + """,
v_flags AS (
  SELECT e.run_id, e.tool, e.line_number, e.src, e.dst, s.line_number IS NULL AS src_missing, d.line_number IS NULL AS dst_missing,
    s.line_number IS NULL OR d.line_number IS NULL OR s.line_number > e.line_number OR d.line_number > e.line_number AS late
  FROM v_edges e
  LEFT JOIN v_declared s ON s.run_id = e.run_id AND s.raw_node_id = e.src
  LEFT JOIN v_declared d ON d.run_id = e.run_id AND d.raw_node_id = e.dst)"""


def report(nodes: str, flags: str, errors: str) -> str:
    """Integrity counts per run, tool and overall."""
    return f""",
by_run AS (
  SELECT r.tool, r.run_id,
    (SELECT count(*) FROM {nodes} n WHERE n.run_id = r.run_id) AS nodes,
    (SELECT count(*) - count(DISTINCT raw_node_id) FROM {nodes} n WHERE n.run_id = r.run_id) AS duplicate_node_records,
    coalesce(edges, 0) AS edges, coalesce(ms, 0) AS missing_src_edges, coalesce(md, 0) AS missing_dst_edges,
    coalesce(td, 0) AS true_dangling_edges, coalesce(la, 0) AS edges_missing_when_seen, {errors} AS parse_errors
  FROM v_runs r LEFT JOIN (
    SELECT run_id, count(*) AS edges, count(*) FILTER (src_missing) AS ms, count(*) FILTER (dst_missing) AS md,
      count(*) FILTER (src_missing OR dst_missing) AS td, count(*) FILTER (late) AS la FROM {flags} GROUP BY 1) f ON f.run_id = r.run_id)"""


REPORT = """
SELECT coalesce(tool, '*') AS tool, coalesce(run_id, '*') AS run_id, count(*) AS files,
  CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(duplicate_node_records) AS BIGINT) AS duplicate_node_records,
  CAST(sum(edges) AS BIGINT) AS edges, CAST(sum(missing_src_edges) AS BIGINT) AS missing_src_edges,
  CAST(sum(missing_dst_edges) AS BIGINT) AS missing_dst_edges, CAST(sum(true_dangling_edges) AS BIGINT) AS true_dangling_edges,
  CAST(sum(edges_missing_when_seen) AS BIGINT) AS edges_missing_when_seen, CAST(sum(parse_errors) AS BIGINT) AS parse_errors,
  coalesce(round(sum(duplicate_node_records) * 100.0 / nullif(sum(nodes), 0), 3), 0.0) AS duplicate_pct,
  coalesce(round(sum(true_dangling_edges) * 100.0 / nullif(sum(edges), 0), 3), 0.0) AS dangling_pct,
  coalesce(round(sum(edges_missing_when_seen) * 100.0 / nullif(sum(edges), 0), 3), 0.0) AS late_pct
FROM by_run GROUP BY ROLLUP (tool, run_id)"""

LANDING_DELAY = 10 * 86_400_000_000_000

RAW = EDGES + """,
v_text AS (
  SELECT run_id, tool, line_number, event_id, relation = 'signup' AND user_id % 7 = 1 AS latin1,
    CASE WHEN relation = 'signup'
      THEN '{"id": "p' || user_id || '", "type": "Activity", "annotations": {"object_type": "process", "size": ' || user_id || '.' || k || '0, "comm": "u'
        || CASE WHEN user_id % 7 IN (1, 2) THEN 'é' ELSE '' END || user_id || '"}}'
      ELSE '{"from": "p' || user_id || '", "to": "o' || k || '", "type": "Used", "annotations": {"id": "' || event_id || '", "'
        || CASE WHEN user_id % 3 = 0 THEN 'relation_type' ELSE 'relation' END || '": "' || relation || '", "size": ' || k || 'e0'
        || CASE WHEN event_id % 7 = 3 THEN ', "cmd": "say "' || k || '" now"' ELSE '' END || '}}' END AS whole
  FROM v_edges),
v_lines AS (
  SELECT run_id, tool, line_number, latin1, CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 13 = 0 THEN '[' || event_id || ']'
    WHEN event_id % 11 = 0 THEN whole[:-2] ELSE whole END AS line FROM v_text),
v_mended AS (SELECT *, regexp_replace(line, 'say "([0-9]+)" now', 'say \\\\"\\1\\\\" now') AS mended FROM v_lines WHERE line <> ''),
v_audit AS (
  SELECT *, CASE WHEN NOT json_valid(mended) OR line NOT LIKE '{%' THEN 'unrepaired' WHEN latin1 THEN 'repairable_latin1'
    WHEN mended <> line THEN 'repairable_escape_quotes' ELSE 'strict_ok' END AS tier
  FROM v_mended),
v_records AS (
  SELECT *, CASE WHEN j IS NULL THEN NULL
    WHEN json_exists(j, '$.from') AND json_exists(j, '$.to') THEN 'edge' WHEN json_exists(j, '$.id') THEN 'node' ELSE 'other' END AS record_class,
    j ->> '$.id' AS raw_node_id, j ->> '$.from' AS src, j ->> '$.to' AS dst, j ->> '$.type' AS prov_type,
    j ->> '$.annotations.id' AS raw_edge_id, j ->> '$.annotations.relation_type' AS rt, j ->> '$.annotations.relation' AS rel,
    j ->> '$.annotations.object_type' AS object_type, regexp_extract(mended, '"size": ([^,}]*)', 1) AS size
  FROM (SELECT *, CASE WHEN tier <> 'unrepaired' THEN CAST(mended AS JSON) END AS j FROM v_audit))"""

RAW_GRAPH = RAW + """,
r_nodes AS (SELECT * FROM v_records WHERE record_class = 'node'),
r_decl AS (SELECT run_id, raw_node_id, min(line_number) AS line_number FROM r_nodes GROUP BY 1, 2),
r_flags AS (
  SELECT e.run_id, s.line_number IS NULL AS src_missing, d.line_number IS NULL AS dst_missing,
    s.line_number IS NULL OR d.line_number IS NULL OR s.line_number > e.line_number OR d.line_number > e.line_number AS late
  FROM v_records e
  LEFT JOIN r_decl s ON s.run_id = e.run_id AND s.raw_node_id = e.src
  LEFT JOIN r_decl d ON d.run_id = e.run_id AND d.raw_node_id = e.dst
  WHERE e.record_class = 'edge')""" + report(
    "r_nodes", "r_flags", "(SELECT count(*) FROM v_records x WHERE x.run_id = r.run_id AND record_class IS NULL)"
)

VOCAB = RAW + """,
v_field AS (
  SELECT *, CASE WHEN rt IS NOT NULL THEN 'relation_type' WHEN rel IS NOT NULL THEN 'relation' ELSE '<missing>' END AS field FROM v_records),
v_aspects AS (
  SELECT tool, line_number, 'prov_type' AS aspect, prov_type AS value FROM v_field WHERE record_class IS NOT NULL
  UNION ALL SELECT tool, line_number, 'relation_field', field FROM v_field WHERE record_class = 'edge'
  UNION ALL SELECT tool, line_number, 'relation', coalesce(rt, rel, '<missing>') FROM v_field WHERE record_class = 'edge'
  UNION ALL SELECT tool, line_number, 'object_type', coalesce(object_type, '<missing>') FROM v_field WHERE record_class = 'node'
  UNION ALL SELECT tool, line_number, record_class || '_key', unnest(json_keys(j, '$.annotations')) FROM v_field WHERE record_class IN ('node', 'edge')),
v_vocab AS (
  SELECT tool, aspect, value, count(*) AS n, min(line_number) AS first_line FROM v_aspects GROUP BY 1, 2, 3)"""

FEATURES = """
f_raw AS (
  SELECT 'c' || c_custkey AS raw_node_id, false AS is_placeholder,
    CASE WHEN c_custkey % 7 = 0 THEN 'task' ELSE 'process' END AS object_type, CAST(NULL AS VARCHAR) AS raw_hint,
    CAST(NULL AS VARCHAR) AS path, CASE WHEN c_custkey % 5 <> 0 THEN c_name WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS process_name,
    CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS command_line, '/n/' || c_nationkey AS working_directory,
    CAST(NULL AS VARCHAR) AS network_address, CAST(NULL AS VARCHAR) AS port, CAST(NULL AS VARCHAR) AS network_family
  FROM customer
  UNION ALL
  SELECT 'f' || p_partkey, false, CASE p_type WHEN 'ECONOMY' THEN 'regular file' WHEN 'STANDARD' THEN 'file' ELSE 'unknown' END, NULL,
    CASE WHEN p_partkey % 5 <> 0 THEN p_name WHEN p_partkey % 2 = 0 THEN p_brand END, NULL, NULL, NULL, NULL, NULL, NULL
  FROM part
  UNION ALL
  SELECT 's' || s_suppkey, false, CASE s_suppkey % 3 WHEN 0 THEN 'socket' WHEN 1 THEN 'address' ELSE 'netflow' END, 'address',
    NULL, NULL, NULL, NULL, CASE WHEN s_suppkey % 6 <> 0 THEN s_name END,
    CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey AS VARCHAR) END, 'af' || s_nationkey
  FROM supplier
  UNION ALL
  SELECT 'n' || n_nationkey, true, CASE WHEN lower(n_name) IN ('file', 'process') AND n_nationkey % 2 = 1 THEN lower(n_name) ELSE 'unknown' END,
    CASE WHEN n_nationkey % 2 = 0 THEN '<unknown>' ELSE lower(n_name) END, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM nation),
f_nodes AS (
  SELECT *, object_type AS node_type,
    coalesce(process_name, path, CASE WHEN network_address IS NOT NULL AND port IS NOT NULL THEN network_address || ':' || port END, network_address) AS display_name
  FROM f_raw),
f_labels AS (
  SELECT *, CASE WHEN is_placeholder THEN 'missing_endpoint ' || raw_hint
    WHEN node_type IN ('process', 'task') THEN concat_ws(' ', node_type, process_name, command_line, working_directory)
    WHEN node_type IN ('socket', 'address', 'netflow') THEN concat_ws(' ', node_type, raw_hint, network_address, port, network_family)
    ELSE concat_ws(' ', node_type, raw_hint, path, display_name, command_line) END AS label
  FROM f_nodes)"""

SPLITS = EDGES + """,
s_list AS (
  SELECT kind = 'benign' AS benign, scenario, row_number() OVER (PARTITION BY kind = 'benign' ORDER BY scenario) AS position,
    count(*) OVER (PARTITION BY kind = 'benign') AS n
  FROM (SELECT DISTINCT kind, scenario FROM v_runs)),
s_counts AS (
  SELECT *, CASE WHEN n <= 2 THEN 1 ELSE greatest(1, CAST(floor(n * 0.7::DOUBLE) AS INT)) END AS train,
    CASE WHEN n <= 2 THEN 0 ELSE greatest(1, CAST(floor(n * 0.15::DOUBLE) AS INT)) END AS val
  FROM s_list),
s_split AS (
  SELECT benign, scenario, position, CASE WHEN benign AND position <= train THEN 'train'
    WHEN benign AND position <= train + val THEN 'val' ELSE 'test' END AS split,
    CASE WHEN benign AND position <= train THEN 'train' WHEN benign AND position <= train + val THEN 'val'
      WHEN NOT benign AND n > 1 AND position <= least(n - 1, greatest(1, CAST(floor(n * 0.5::DOUBLE) AS INT))) THEN 'val' ELSE 'test' END AS split_v
  FROM s_counts),
v_split AS (
  SELECT r.run_id, r.tool, r.scenario, r.kind, s.split, s.split_v FROM v_runs r JOIN s_split s
    ON s.benign = (r.kind = 'benign') AND s.scenario = r.scenario)"""

TRIALS = """
t AS (
  SELECT 'm' || (o_custkey % 4) AS method, 'r' || o_orderpriority[1] || '_e' || o_orderpriority[1] AS rung,
    CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice END AS metric,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS exit_code, o_orderkey % 23 = 0 AS oom, o_orderkey % 5 <> 0 AS ckpt,
    o_orderkey, o_custkey, o_orderstatus
  FROM orders),
ok AS (SELECT * FROM t WHERE exit_code = 0 AND NOT oom AND metric IS NOT NULL),
fin AS (SELECT * FROM t WHERE o_orderstatus <> 'P'),
fin_ok AS (SELECT * FROM ok WHERE o_orderstatus <> 'P'),
before AS (SELECT * FROM fin_ok WHERE metric > 450000),
sizes AS (SELECT method, rung, count(*) AS n FROM t GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY method, rung ORDER BY metric DESC, o_orderkey) AS position FROM ok),
sync AS (SELECT method, rung, name, metric, position FROM ranked JOIN sizes USING (method, rung) WHERE position <= greatest(1, n // 2))"""

LOGS = EDGES + """,
logs AS (
  SELECT user_id AS file, event_id AS pos, relation, value, k, event_id % 12 AS epoch,
    relation = 'error' AND event_id % 50 = 0 AS oom FROM v_edges),
log_read AS (
  SELECT file, arg_min(epoch, (value, pos)) FILTER (relation = 'view') AS best_epoch, min(value) FILTER (relation = 'view') AS best_val_loss,
    arg_max(epoch, pos) FILTER (relation = 'click') AS test_epoch, arg_max(value, pos) FILTER (relation = 'click') AS test_loss,
    max(CAST(oom AS BIGINT)) AS oom, arg_max(value, pos) FILTER (relation = 'purchase') AS adp_score,
    CAST(arg_max(k, pos) FILTER (relation = 'purchase') AS DOUBLE) AS tp
  FROM logs GROUP BY 1)"""

FILES = RAW + """,
v_files AS (
  SELECT r.*, b.bytes FROM v_runs r JOIN (
    SELECT run_id, CAST(sum(strlen(line) + 1 - CASE WHEN latin1 AND line LIKE '%é%' THEN 1 ELSE 0 END) AS BIGINT) AS bytes FROM v_lines GROUP BY 1) b USING (run_id))"""

AXES = """
g AS (
  SELECT *, row_number() OVER (ORDER BY flag, line, prio) - 1 AS place FROM (SELECT DISTINCT l_returnflag AS flag FROM lineitem)
  CROSS JOIN (SELECT DISTINCT l_linestatus AS line FROM lineitem) CROSS JOIN (SELECT DISTINCT o_orderpriority[1] AS prio FROM orders)),
d AS (
  SELECT place AS default_place FROM g WHERE flag = (SELECT list_sort(list(DISTINCT l_returnflag))[2] FROM lineitem)
    AND line = (SELECT min(l_linestatus) FROM lineitem) AND prio = (SELECT list_sort(list(DISTINCT o_orderpriority[1]))[3] FROM orders)),
grid AS (
  SELECT index, 'c' || lpad(CAST(index AS VARCHAR), 3, '0') || '_flag' || flag || '_line' || line || '_prio' || prio || '_seed0' AS name, flag, line, prio FROM (
    SELECT *, CAST(CASE WHEN place = default_place THEN 0 WHEN place < default_place THEN place + 1 ELSE place END AS BIGINT) AS index
    FROM g CROSS JOIN d))"""

JOBS = """
j AS (
  SELECT 'm' || (o_custkey % 4) AS method, 'r' || o_orderpriority[1] AS rung, o_orderstatus AS state, 'a' || (o_custkey % 3) AS account,
    CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 7 + 2 ELSE 1 END AS tasks FROM orders)"""

PLAN = """
p AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'built'
    WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'skipped' ELSE 'rebuilt' END AS status FROM orders)"""

WINDOWED = LABELLED + cut("v_y", SIX_HOURS, "w6")
STAT6 = WINDOWED + stats("w6", "s6")
STAT24 = LABELLED + cut("v_y", ONE_DAY, "w24") + stats("w24", "s24")
PLAIN24 = EDGES + cut("v_edges", ONE_DAY, "w24")

STAT_COLUMNS = "run_id, window_index, file_name, node_count, edge_count, attack_edge_count, y, start_ns, end_ns"


def sql() -> dict[str, str]:
    return {
        "window_stats": with_(STAT6, f"SELECT {STAT_COLUMNS} FROM s6"),
        "window_edges": with_(
            EDGES + cut("v_edges", SIX_HOURS, "w6"),
            "SELECT run_id, raw_edge_id, src, dst, wall_time_ns, window_index, start_ns FROM w6",
        ),
        "window_run_rollup": with_(
            STAT6,
            """SELECT run_id, count(*) AS window_count, CAST(sum(y) AS BIGINT) AS attack_window_count, CAST(sum(node_count) AS BIGINT) AS node_count,
            CAST(sum(edge_count) AS BIGINT) AS edge_count, CAST(sum(attack_edge_count) AS BIGINT) AS attack_edge_count FROM s6 GROUP BY 1""",
        ),
        "window_totals": with_(
            STAT6,
            """SELECT count(*) AS window_count, CAST(sum(edge_count) AS BIGINT) AS edge_count,
            CAST(sum(attack_edge_count) AS BIGINT) AS attack_edge_count FROM s6""",
        ),
        "rewindow_stats": with_(STAT24, f"SELECT {STAT_COLUMNS} FROM s24"),
        "rewindow_conservation": with_(
            LABELLED + cut("v_y", SIX_HOURS, "w6") + cut("v_y", ONE_DAY, "w24"),
            """SELECT run_id, source_edges, source_attack_edges, source_windows, derived_edges, derived_attack_edges, derived_windows FROM
            (SELECT run_id, count(*) AS source_edges, CAST(sum(y) AS BIGINT) AS source_attack_edges, count(DISTINCT window_index) AS source_windows FROM w6 GROUP BY 1)
            FULL JOIN
            (SELECT run_id, count(*) AS derived_edges, CAST(sum(y) AS BIGINT) AS derived_attack_edges, count(DISTINCT window_index) AS derived_windows FROM w24 GROUP BY 1)
            USING (run_id)""",
        ),
        "multi_edge_key": with_(
            PLAIN24,
            """SELECT run_id, raw_edge_id, window_index, src, dst, row_number() OVER (
            PARTITION BY run_id, window_index, src, dst ORDER BY wall_time_ns, line_number) - 1 AS edge_key FROM w24""",
        ),
        "tumbling_windows": with_(
            EDGES,
            f"SELECT run_id, wall_time_ns // {SIX_HOURS} * {SIX_HOURS} AS start_ns, count(*) AS edge_count FROM v_edges GROUP BY ALL",
        ),
        "run_time_range": with_(LABELLED, "SELECT * FROM v_range"),
        "attack_windows": with_(LABELLED, "SELECT run_id, scenario, cve, tool, start_ns, end_ns FROM v_attack"),
        "edge_attack_label": with_(LABELLED, "SELECT run_id, raw_edge_id, CAST(y AS BIGINT) AS y FROM v_y"),
        "label_ns": with_(
            EDGES,
            """SELECT raw_edge_id, tool, b AS start_ns, b AS end_ns FROM (SELECT raw_edge_id, tool, CASE WHEN tool = 'recap'
            THEN wall_time_ns // 1000000000 * 1000000000 + 250000000 ELSE wall_time_ns END AS b FROM v_edges)""",
        ),
        "merged_nodes": with_(NODES, "SELECT * FROM v_merged"),
        "merge_counts": with_(
            NODES,
            """SELECT run_id, count(*) AS logical_nodes, count(*) FILTER (duplicate_count > 1) AS duplicate_logical_nodes,
            CAST(sum(duplicate_count) AS BIGINT) AS records, CAST(sum(duplicate_exact_count) AS BIGINT) AS exact,
            CAST(sum(duplicate_conflict_count) AS BIGINT) AS conflicting FROM v_merged GROUP BY 1""",
        ),
        "source_records": with_(
            NODES,
            """SELECT run_id, raw_node_id, CAST(line AS BIGINT) AS line_number, raw FROM v_raw
            QUALIFY count(*) OVER (PARTITION BY run_id, raw_node_id) > 1""",
        ),
        "placeholder_nodes": with_(
            HOLES,
            "SELECT run_id, raw_node_id, '<missing>' AS object_type, 'missing_edge_endpoint' AS reason, raw_type_hint FROM v_place",
        ),
        "placeholder_hints": with_(
            HOLES,
            """SELECT run_id, raw_node_id, hint, CAST(line AS BIGINT) AS line, CAST(side AS BIGINT) AS side FROM v_holes
            QUALIFY row_number() OVER (PARTITION BY run_id, raw_node_id, hint ORDER BY line, side) = 1""",
        ),
        "graph_integrity": with_(FLAGS + report("v_declared", "v_flags", "0"), REPORT),
        "raw_integrity": with_(RAW_GRAPH, REPORT),
        "integrity_anomalies": with_(
            RAW_GRAPH,
            """SELECT run_id, nodes, duplicate_node_records, edges, missing_src_edges, missing_dst_edges, true_dangling_edges,
            edges_missing_when_seen, parse_errors FROM by_run WHERE parse_errors > 0 OR duplicate_node_records > 0 OR true_dangling_edges > 0""",
        ),
        "missing_when_seen": with_(
            FLAGS,
            """SELECT run_id, line_number, CAST(src_missing AS INT) AS src_missing, CAST(dst_missing AS INT) AS dst_missing,
            CAST(late AS INT) AS missing_when_seen FROM v_flags""",
        ),
        "first_examples": with_(
            RAW,
            """SELECT run_id, record_class, min(line_number) AS line_number, arg_min(prov_type, line_number) AS type
            FROM v_records WHERE record_class IN ('node', 'edge') GROUP BY 1, 2""",
        ),
        "first_duplicate": with_(
            RAW,
            """SELECT run_id, raw_node_id, first_line, line_number AS duplicate_line FROM (
              SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_number) AS pick FROM (
                SELECT run_id, raw_node_id, line_number, row_number() OVER (PARTITION BY run_id, raw_node_id ORDER BY line_number) AS nth,
                  min(line_number) OVER (PARTITION BY run_id, raw_node_id) AS first_line
                FROM v_records WHERE record_class = 'node') WHERE nth = 2) WHERE pick = 1""",
        ),
        "first_dangling": with_(
            FLAGS,
            """SELECT run_id, line_number, src, dst, CAST(src_missing AS INT) AS src_missing, CAST(dst_missing AS INT) AS dst_missing
            FROM v_flags WHERE src_missing OR dst_missing QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_number) = 1""",
        ),
        "export_guards": with_(
            HOLES, "SELECT DISTINCT run_id, 'endpoint_without_node' AS \"check\", raw_node_id AS item FROM v_holes"
        ),
        "node_features": with_(
            FEATURES,
            """SELECT raw_node_id, path, process_name, command_line, working_directory, network_address, port, network_family,
            display_name FROM f_nodes""",
        ),
        "node_labels": with_(FEATURES, "SELECT raw_node_id, node_type, label FROM f_labels"),
        "node_paths": with_(
            FEATURES,
            """SELECT raw_node_id, coalesce(display_name, 'missing_endpoint') AS path, node_type AS type,
            CASE WHEN node_type IN ('process', 'task') THEN command_line END AS cmd FROM f_labels""",
        ),
        "node_dictionary": with_(
            FEATURES,
            "SELECT raw_node_id AS node, node_type, label, coalesce(display_name, 'missing_endpoint') AS path FROM f_labels",
        ),
        "edge_labels": with_(
            EDGES, "SELECT run_id, raw_edge_id, coalesce(prov_type, '<missing>') || ':' || relation AS edge_label FROM v_edges"
        ),
        "edge_annotations": with_(
            RAW,
            """SELECT run_id, raw_edge_id, CASE WHEN rt IS NOT NULL THEN 'relation_type' ELSE 'relation' END AS relation_field,
            coalesce(rt, rel) AS relation_value, coalesce(rt, rel) AS raw_relation_value, prov_type || ':' || coalesce(rt, rel) AS edge_label,
            coalesce(rt, rel) AS relation FROM v_records WHERE record_class = 'edge'""",
        ),
        "stable_node_ids": with_(
            DECLARED, "SELECT run_id, raw_node_id, 'node_' || sha1(run_id || '||' || raw_node_id) AS global_node_id FROM v_declared"
        ),
        "stable_edge_ids": with_(
            EDGES,
            """SELECT run_id, raw_edge_id, 'edge_' || sha1(concat_ws('||', run_id, raw_edge_id, src, dst,
            concat_ws('|', wall_time_ns, wall_time_precision_ns, wall_time_ns // 1000000000, 'seconds', 0, 'none'), line_number)) AS global_edge_id
            FROM v_edges""",
        ),
        "dense_ids": with_(
            EDGES,
            """SELECT tool, g AS global_node_id, CAST(row_number() OVER (PARTITION BY tool ORDER BY g) AS VARCHAR) AS export_id FROM (
            SELECT DISTINCT tool, 'node_' || sha1(run_id || '||' || node) AS g FROM (
            SELECT tool, run_id, src AS node FROM v_edges UNION SELECT tool, run_id, dst FROM v_edges))""",
        ),
        "export_edge_ids": with_(
            EDGES
            + """,
            ids AS (SELECT tool, g, CAST(row_number() OVER (PARTITION BY tool ORDER BY g) AS VARCHAR) AS export_id FROM (
              SELECT DISTINCT tool, sha1(run_id || '||' || node) AS g FROM (
              SELECT tool, run_id, src AS node FROM v_edges UNION SELECT tool, run_id, dst FROM v_edges)))""",
            """SELECT e.tool, e.raw_edge_id, s.export_id AS src_export_id, d.export_id AS dst_export_id FROM v_edges e
            JOIN ids s ON s.tool = e.tool AND s.g = sha1(e.run_id || '||' || e.src)
            JOIN ids d ON d.tool = e.tool AND d.g = sha1(e.run_id || '||' || e.dst)""",
        ),
        "event_timestamps": with_(
            EDGES
            + f""",
            stamped AS (
              SELECT *, CASE WHEN wall_time_precision_ns = 1000 THEN wall_time_ns ELSE wall_time_ns // 1000000000 * 1000000000 END AS w,
                tool = 'camflow' AND k % 2 = 0 AND event_id > 0 AS j FROM v_edges)""",
            f"""SELECT run_id, raw_edge_id, w AS wall_time_ns, wall_time_precision_ns,
            CASE WHEN tool = 'recap' THEN w WHEN j THEN event_id ELSE w // 1000000000 END AS model_time,
            CASE WHEN tool = 'recap' THEN 'ns' WHEN j THEN 'jiffies' ELSE 'seconds' END AS model_time_unit,
            CASE WHEN j THEN event_id ELSE 0 END AS "order",
            CASE WHEN tool = 'recap' THEN 'ts' WHEN j THEN 'cf:date+cf:jiffies' ELSE 'cf:date' END AS source,
            {label('w')} AS label, w + wall_time_precision_ns - 1 AS end_ns FROM stamped""",
        ),
        "run_names": with_(
            EDGES
            + """,
            stems AS (SELECT DISTINCT scenario, tool, kind, user_id % 9 = 0 AS other, CASE WHEN user_id % 2 = 0 THEN user_id END AS nth,
              scenario || '_' || CASE WHEN user_id % 9 = 0 THEN 'other' ELSE tool END
              || CASE WHEN user_id % 2 = 0 THEN '_run_' || user_id ELSE '' END AS stem FROM v_edges)""",
            """SELECT DISTINCT stem, CASE WHEN NOT other THEN scenario END AS scenario, CASE WHEN NOT other THEN tool END AS tool,
            CASE WHEN NOT other THEN kind END AS kind,
            CASE WHEN nth IS NOT NULL THEN CAST(nth AS VARCHAR) WHEN other THEN 'other' ELSE tool END AS loose_tool,
            CASE WHEN NOT other AND kind = 'cve' THEN split_part(scenario, '_', 1) END AS attack_name,
            CASE WHEN NOT other AND kind = 'cve' THEN split_part(scenario, '_', 2) END AS cve FROM stems""",
        ),
        "name_tokens": """SELECT p_partkey, replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '_') AS safe_name,
            'm' || replace(CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR), '.', 'p') AS token,
            CASE WHEN p_size % 7 <> 0 THEN p_size || '.0' ELSE '-' END AS number,
            left(p_name || ' ' || p_brand || ' ' || p_type, 12) || '...' AS short FROM part""",
        "split_scenarios": with_(SPLITS, "SELECT CAST(benign AS INT) AS benign, scenario, position, split FROM s_split"),
        "split_runs": with_(SPLITS, "SELECT run_id, tool, scenario, kind, split FROM v_split"),
        "split_runs_attack_validation": with_(SPLITS, "SELECT run_id, split_v AS split FROM v_split"),
        "split_summary": with_(
            SPLITS,
            """SELECT tool, split, count(run_id) AS run_count, count(DISTINCT scenario) AS scenario_count,
            count(*) FILTER (kind = 'benign') AS benign_runs, count(*) FILTER (kind = 'cve') AS attack_runs
            FROM (SELECT DISTINCT tool FROM v_runs) CROSS JOIN (SELECT unnest(['train', 'val', 'test']) AS split)
            LEFT JOIN v_split USING (tool, split) GROUP BY 1, 2""",
        ),
        "split_nodes": with_(
            SPLITS,
            """SELECT tool, split, src AS node FROM v_edges JOIN v_split USING (run_id, tool)
            UNION SELECT tool, split, dst FROM v_edges JOIN v_split USING (run_id, tool)""",
        ),
        "run_summary": with_(
            HOLES + RAW[len(EDGES):],
            """SELECT run_id, tool, records, nodes, edges, coalesce(placeholders, 0) AS placeholders FROM v_runs
            JOIN (SELECT run_id, count(record_class) AS records, count(*) FILTER (record_class = 'node') AS nodes,
                  count(*) FILTER (record_class = 'edge') AS edges FROM v_records GROUP BY 1) USING (run_id)
            LEFT JOIN (SELECT run_id, count(*) AS placeholders FROM v_place GROUP BY 1) USING (run_id)""",
        ),
        "runs_per_tool": with_(EDGES, "SELECT tool, count(DISTINCT run_id) AS runs, count(*) AS edges FROM v_edges GROUP BY 1"),
        "export_vocab": with_(
            DECLARED + KINDS,
            """SELECT tool, 'node_type' AS aspect, node_type AS value, count(*) AS n FROM kinds JOIN used USING (run_id, node) GROUP BY 1, 3
            UNION ALL SELECT tool, 'edge_label', coalesce(prov_type, '<missing>') || ':' || relation AS l, count(*) FROM v_edges GROUP BY 1, 3""",
        ),
        "export_index": with_(
            LABELLED + cut("v_y", ONE_DAY, "w24") + DECLARED[len(EDGES):] + KINDS,
            """SELECT tool, node_count, node_type_count, message_count, edge_label_count, window_count, edge_count, attack_edge_count FROM
            (SELECT tool, count(*) AS node_count FROM kinds GROUP BY 1)
            JOIN (SELECT tool, count(DISTINCT node_type) AS node_type_count, count(*) AS message_count
                  FROM kinds JOIN used USING (run_id, node) GROUP BY 1) USING (tool)
            JOIN (SELECT tool, count(DISTINCT coalesce(prov_type, '<missing>') || ':' || relation) AS edge_label_count,
                  count(DISTINCT (run_id, window_index)) AS window_count, count(*) AS edge_count, CAST(sum(y) AS BIGINT) AS attack_edge_count
                  FROM w24 GROUP BY 1) USING (tool)""",
        ),
        "export_complete": with_(
            SPLITS
            + cut("v_edges", ONE_DAY, "w24")
            + """,
            per AS (SELECT run_id, window_index, count(*) AS edges FROM w24 GROUP BY 1, 2),
            stored AS (SELECT run_id, count(*) AS windows, count(*) FILTER (edges < 15 OR window_index > 1) AS found FROM per GROUP BY 1)""",
            """SELECT tool, split, count(*) AS expected_runs, count(*) AS exported_runs,
            CAST(bool_and(windows = found) AS BIGINT) AS complete FROM v_split JOIN stored USING (run_id) GROUP BY 1, 2""",
        ),
        "name_collisions": with_(
            EDGES,
            f"""SELECT tool, file_name, count(*) AS n FROM (
            SELECT DISTINCT tool, run_id, {label('b')} || '~' || {label('(b + 3599999999999)')} AS file_name FROM (
            SELECT tool, run_id, wall_time_ns // 3600000000000 * 3600000000000 AS b FROM v_edges)) GROUP BY 1, 2 HAVING count(*) > 1""",
        ),
        "index_mismatch": with_(
            LABELLED
            + cut("v_y", ONE_DAY, "w24")
            + stats("w24", "s24")
            + ", kept AS (SELECT * REPLACE (CASE WHEN relation = 'error' AND k % 10 = 0 THEN 'lost' ELSE src END AS src, CASE WHEN relation = 'error' AND k % 10 = 0 THEN 0 ELSE y END AS y) FROM w24)"
            + stats("kept", "sk"),
            """SELECT run_id, window_index, a.node_count, a.edge_count, a.attack_edge_count, b.node_count AS index_node_count,
            b.edge_count AS index_edge_count, b.attack_edge_count AS index_attack_edge_count
            FROM s24 a JOIN sk b USING (run_id, window_index)
            WHERE a.node_count <> b.node_count OR a.edge_count <> b.edge_count OR a.attack_edge_count <> b.attack_edge_count""",
        ),
        "node_attr_conflicts": with_(
            EDGES, "SELECT run_id, dst AS node FROM v_edges GROUP BY 1, 2 HAVING count(DISTINCT to_type) > 1"
        ),
        "line_audit": with_(
            RAW,
            """SELECT run_id, tool, count(*) FILTER (tier = 'strict_ok') AS strict_ok, count(*) FILTER (tier = 'repairable_latin1') AS repairable_latin1,
            count(*) FILTER (tier = 'repairable_escape_quotes') AS repairable_escape_quotes, count(*) FILTER (tier = 'unrepaired') AS unrepaired,
            count(*) FILTER (tier <> 'strict_ok') AS total_problem_lines FROM v_audit GROUP BY 1, 2""",
        ),
        "line_audit_totals": with_(
            RAW,
            """SELECT coalesce(tool, '*') AS tool, coalesce(run_id, '*') AS run_id, count(*) FILTER (tier = 'strict_ok') AS strict_ok,
            count(*) FILTER (tier = 'repairable_latin1') AS repairable_latin1, count(*) FILTER (tier = 'repairable_escape_quotes') AS repairable_escape_quotes,
            count(*) FILTER (tier = 'unrepaired') AS unrepaired, count(*) FILTER (tier <> 'strict_ok') AS total_problem_lines
            FROM v_audit GROUP BY ROLLUP (tool, run_id)""",
        ),
        "problem_lines": with_(
            RAW, "SELECT run_id, tool, line_number, tier, left(line, 400) AS excerpt, line AS text FROM v_audit WHERE tier <> 'strict_ok'"
        ),
        "frequent_sizes": with_(RAW, frequent("tool", "size", 20)),
        "frequent_sources": with_(RAW, frequent("tool", "src", 10)),
        "frequent_relations_per_run": with_(RAW, frequent("run_id", "coalesce(rt, rel)", 3)),
        "written_numbers": with_(
            RAW, "SELECT tool, record_class, size, count(*) AS n FROM v_records WHERE record_class IS NOT NULL GROUP BY 1, 2, 3"
        ),
        "snapshot_rebuild": with_(
            EDGES,
            """SELECT run_id, count(*) AS old_rows, CAST(sum(CAST(raw_edge_id AS BIGINT)) AS BIGINT) AS old_ids,
            count(*) FILTER (tool <> 'recap' OR user_id % 2 = 0) AS new_rows,
            CAST(coalesce(sum(CAST(raw_edge_id AS BIGINT)) FILTER (tool <> 'recap'), 0)
              + coalesce(sum(CAST(raw_edge_id AS BIGINT) + 1) FILTER (tool = 'recap' AND user_id % 2 = 0), 0) AS BIGINT) AS new_ids
            FROM v_edges GROUP BY 1""",
        ),
        "signed_index": with_(
            EDGES,
            """, kept AS (SELECT * FROM v_edges WHERE tool <> 'camflow' AND (tool <> 'recap' OR (user_id % 2 = 0 AND relation <> 'click')))
            SELECT tool, 'edges' AS aspect, '' AS value, count(*) AS n FROM kept GROUP BY 1
            UNION ALL SELECT tool, 'relation', relation, count(*) FROM kept GROUP BY 1, 3""",
        ),
        "landed_edges": with_(
            EDGES,
            f""", batched AS (SELECT *, (line_number * 7919) % 4 AS batch FROM v_edges),
            reached AS (SELECT run_id, batch, max(wall_time_ns) AS m FROM batched GROUP BY 1, 2),
            before AS (SELECT a.run_id, a.batch, max(b.m) AS reached_ns FROM reached a LEFT JOIN reached b ON b.run_id = a.run_id AND b.batch < a.batch GROUP BY 1, 2)
            SELECT run_id, line_number, src, dst, CAST(coalesce(wall_time_ns < reached_ns - {LANDING_DELAY}, FALSE) AS INT) AS late,
              CASE WHEN wall_time_ns < reached_ns - {LANDING_DELAY} THEN reached_ns END AS reached_ns
            FROM batched JOIN before USING (run_id, batch)""",
        ),
        "parse_counters": with_(
            RAW,
            """SELECT run_id, count(*) FILTER (tier <> 'unrepaired' AND strlen(line) > length(line)) AS non_ascii_lines, count(*) FILTER (tier = 'unrepaired') AS skipped_lines
            FROM v_audit GROUP BY 1""",
        ),
        "record_profile": with_(
            FILES,
            """SELECT coalesce(tool, '*') AS tool, coalesce(run_id, '*') AS run_id, count(*) AS files, CAST(sum(records) AS BIGINT) AS records,
            CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(edges) AS BIGINT) AS edges, CAST(sum(other) AS BIGINT) AS other,
            CAST(sum(parse_errors) AS BIGINT) AS parse_errors, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
              SELECT tool, run_id, count(record_class) AS records, count(*) FILTER (record_class = 'node') AS nodes,
                count(*) FILTER (record_class = 'edge') AS edges, count(*) FILTER (record_class = 'other') AS other,
                count(*) FILTER (record_class IS NULL) AS parse_errors FROM v_records GROUP BY 1, 2)
            JOIN (SELECT run_id, bytes FROM v_files) USING (run_id) GROUP BY ROLLUP (tool, run_id)""",
        ),
        "coverage": with_(
            FILES,
            """SELECT coalesce(tool, '*') AS tool, coalesce(kind, '*') AS kind, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes,
            count(DISTINCT scenario) AS scenarios, round(count(*) * 100.0 / (SELECT count(*) FROM v_files), 2) AS files_pct,
            round(sum(bytes) * 100.0 / (SELECT sum(bytes) FROM v_files), 2) AS bytes_pct
            FROM v_files GROUP BY GROUPING SETS ((tool), (kind), ())""",
        ),
        "coverage_gaps": with_(
            EDGES,
            """SELECT scenario, concat_ws(',', CASE WHEN NOT list_contains(tools, 'camflow') THEN 'camflow' END, CASE WHEN NOT list_contains(tools, 'conprov') THEN 'conprov' END,
            CASE WHEN NOT list_contains(tools, 'provbpf') THEN 'provbpf' END, CASE WHEN NOT list_contains(tools, 'recap') THEN 'recap' END) AS missing, '' AS extra FROM (SELECT scenario, list(DISTINCT CASE WHEN value >= 250 THEN tool ELSE 'recap' END) AS tools FROM v_edges GROUP BY 1) WHERE len(tools) < 4""",
        ),
        "size_pivot": with_(
            FILES,
            "SELECT scenario, "
            + ", ".join(f"CAST(sum(bytes) FILTER (tool = '{t}') AS BIGINT) AS {t}" for t in ("camflow", "conprov", "provbpf", "recap"))
            + " FROM v_files GROUP BY 1",
        ),
        "relation_vocab": with_(
            VOCAB, "SELECT tool, aspect, value, n, first_line FROM v_vocab WHERE aspect IN ('relation', 'relation_field', 'prov_type', 'object_type')"
        ),
        "key_counts": with_(VOCAB, "SELECT tool, aspect, value, n FROM v_vocab WHERE aspect IN ('node_key', 'edge_key')"),
        "top_relations": with_(
            VOCAB,
            """SELECT tool, value, n, round(n * 100.0 / sum(n) OVER (PARTITION BY tool), 2) AS share,
            row_number() OVER (PARTITION BY tool ORDER BY n DESC, first_line, value) AS position
            FROM v_vocab WHERE aspect = 'relation' QUALIFY position <= 3""",
        ),
        "top_types_per_run": with_(
            RAW,
            """SELECT run_id, value, n, round(n * 100.0 / sum(n) OVER (PARTITION BY run_id), 2) AS share,
            row_number() OVER (PARTITION BY run_id ORDER BY n DESC, first_line) AS position FROM (
            SELECT run_id, prov_type AS value, count(*) AS n, min(line_number) AS first_line FROM v_records
            WHERE record_class IS NOT NULL GROUP BY 1, 2) QUALIFY position <= 3""",
        ),
        "leaderboard": with_(
            TRIALS,
            """SELECT method, rung, name, metric, row_number() OVER (PARTITION BY method, rung ORDER BY metric DESC NULLS LAST, o_orderkey) AS position FROM t""",
        ),
        "leaderboard_minimize": with_(
            TRIALS,
            """SELECT method, rung, name, row_number() OVER (PARTITION BY method, rung ORDER BY metric ASC NULLS LAST, o_orderkey) AS position FROM t""",
        ),
        "valid_counts": with_(
            TRIALS,
            """SELECT method, rung, count(*) AS planned, count(*) FILTER (o_orderstatus <> 'P') AS completed,
            count(*) FILTER (o_orderstatus <> 'P' AND exit_code = 0 AND NOT oom AND metric IS NOT NULL) AS valid FROM t GROUP BY 1, 2""",
        ),
        "halving_sync": with_(TRIALS, "SELECT * FROM sync"),
        "halving_async": with_(
            TRIALS,
            """SELECT method, rung, name, metric, position FROM (
              SELECT f.*, row_number() OVER (PARTITION BY method, rung ORDER BY metric DESC, o_orderkey) AS position FROM fin_ok f
              WHERE name NOT IN (SELECT name FROM before))
            JOIN (SELECT method, rung, least(CASE WHEN done = n AND done = 1 THEN 1 ELSE done // 2 END, greatest(1, n // 2)) - coalesce(already, 0) AS slots
              FROM sizes LEFT JOIN (SELECT method, rung, count(*) AS done FROM fin GROUP BY 1, 2) USING (method, rung)
              LEFT JOIN (SELECT method, rung, count(*) AS already FROM before GROUP BY 1, 2) USING (method, rung)) USING (method, rung)
            WHERE position <= slots""",
        ),
        "cutoff": with_(TRIALS, "SELECT method, rung, min(metric) AS cutoff, count(*) AS promoted FROM sync GROUP BY 1, 2"),
        "final_topk": with_(TRIALS, "SELECT method, name, metric, position FROM ranked WHERE rung = 'r5_e5' AND position <= 3"),
        "final_report": with_(
            TRIALS
            + """,
            plan AS (SELECT method, name, position FROM ranked WHERE rung = 'r5_e5' AND position <= 10),
            fin_r AS (SELECT method, name, m, row_number() OVER (PARTITION BY method ORDER BY m DESC, CAST(name AS BIGINT)) AS fr FROM (
              SELECT method, name, max(l_extendedprice) AS m FROM plan JOIN lineitem ON l_orderkey = CAST(name AS BIGINT) GROUP BY 1, 2)),
            src AS (SELECT method, name, metric, row_number() OVER (PARTITION BY method ORDER BY metric DESC NULLS LAST, o_orderkey) AS sr FROM t WHERE rung = 'r5_e5')""",
            """SELECT method, name, p.position AS planned_rank, m AS final_metric, fr AS final_rank, metric AS source_metric, sr AS source_rank,
            CASE WHEN fr IS NULL THEN 'missing' ELSE 'done' END AS status
            FROM plan p LEFT JOIN fin_r USING (method, name) LEFT JOIN src USING (method, name)""",
        ),
        "rung_status": with_(
            TRIALS,
            """SELECT method, rung, count(*) AS planned, count(*) FILTER (o_orderkey % 4 <> 0) AS submitted,
            count(*) FILTER (o_orderkey % 4 <> 0 AND o_orderstatus <> 'P') AS completed, count(*) FILTER (good) AS valid,
            count(*) FILTER (good_any AND metric > 450000) AS promoted, count(*) FILTER (o_orderkey % 4 = 0) AS cancelled,
            arg_min(name, (-metric, o_orderkey)) FILTER (good) AS best, max(metric) FILTER (good) AS best_metric
            FROM (SELECT *, o_orderkey % 4 <> 0 AND good_any AS good FROM (
              SELECT *, o_orderstatus <> 'P' AND exit_code = 0 AND NOT oom AND metric IS NOT NULL AS good_any FROM t)) GROUP BY 1, 2""",
        ),
        "final_status": with_(
            TRIALS,
            """SELECT method, count(*) AS planned, count(*) FILTER (sent) AS submitted, count(*) FILTER (sent AND done) AS completed,
            count(*) FILTER (good) AS valid, arg_min(name, (-metric, o_orderkey)) FILTER (good) AS best, max(metric) FILTER (good) AS best_metric
            FROM (SELECT *, o_orderkey % 4 <> 0 AS sent, o_orderstatus <> 'P' AS done,
              o_orderkey % 4 <> 0 AND o_orderstatus <> 'P' AND exit_code = 0 AND metric IS NOT NULL AS good FROM t WHERE rung = 'r5_e5') GROUP BY 1""",
        ),
        "cancellable_trials": with_(
            TRIALS,
            """SELECT method, rung, name FROM t JOIN sizes USING (method, rung)
            LEFT JOIN (SELECT method, rung, count(*) AS moved FROM before GROUP BY 1, 2) USING (method, rung)
            WHERE coalesce(moved, 0) >= greatest(1, n // 30) AND o_orderstatus = 'P' AND o_orderkey % 2 = 1""",
        ),
        "best_results": with_(
            TRIALS,
            """SELECT method, rung, name, metric FROM t WHERE exit_code = 0 AND metric IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY method, rung ORDER BY metric DESC, o_orderkey) = 1""",
        ),
        "method_summary": with_(
            TRIALS
            + """,
            good AS (SELECT *, row_number() OVER (PARTITION BY method, rung ORDER BY metric DESC, o_orderkey) AS position FROM fin
              WHERE exit_code = 0 AND metric IS NOT NULL),
            last AS (SELECT method, max(rung) AS deepest FROM t GROUP BY 1),
            tops AS (SELECT method, rung, count(*) AS done, count(*) FILTER (ckpt) AS checkpointed,
              count(*) FILTER (ckpt AND (rung = deepest OR position <= n // 2)) AS top_checkpointed, max(metric) AS best
              FROM good JOIN sizes USING (method, rung) JOIN last USING (method) GROUP BY 1, 2),
            per AS (SELECT method, rung, count(*) AS planned, count(*) FILTER (o_orderkey % 4 <> 0) AS submitted,
              count(*) FILTER (o_orderstatus <> 'P' AND NOT (exit_code = 0 AND metric IS NOT NULL)) AS failed,
              count(*) FILTER (o_orderstatus <> 'P' AND exit_code = 0 AND NOT oom AND metric > 450000) AS promoted FROM t GROUP BY 1, 2)""",
            """SELECT method, rung, planned, submitted, promoted, failed, coalesce(done, 0) AS done, coalesce(checkpointed, 0) AS checkpointed,
            coalesce(top_checkpointed, 0) AS top_checkpointed, planned - submitted AS waiting, coalesce(printf('%.3f', best), '-') AS best
            FROM per LEFT JOIN tops USING (method, rung)""",
        ),
        "deepest_rung": with_(TRIALS, "SELECT method, max(rung) AS rung FROM t GROUP BY 1"),
        "deepest_leaderboard": with_(
            TRIALS,
            """SELECT method, rung, name, metric, position FROM (
              SELECT *, row_number() OVER (PARTITION BY method ORDER BY metric DESC NULLS LAST, o_orderkey) AS position
              FROM t WHERE rung = (SELECT max(u.rung) FROM t u WHERE u.method = t.method)) WHERE position <= 5""",
        ),
        "pending_trials": with_(TRIALS, "SELECT method, rung, name FROM t WHERE o_orderstatus = 'P'"),
        "reusable_results": with_(TRIALS, "SELECT method, rung, name FROM ok WHERE ckpt"),
        "trials_to_run": with_(
            TRIALS, "SELECT method, rung, name FROM t WHERE NOT (exit_code = 0 AND metric IS NOT NULL AND ckpt)"
        ),
        "completion_override": with_(
            TRIALS,
            """SELECT name, CAST(CASE WHEN saved THEN 0 ELSE exit_code END AS BIGINT) AS exit_code,
            CAST(CASE WHEN saved THEN exit_code END AS BIGINT) AS original_exit_code, CAST(saved AS INT) AS completed_by_checkpoint
            FROM (SELECT *, exit_code <> 0 AND NOT oom AND metric IS NOT NULL AND o_custkey % 10 >= 5 AS saved FROM t)""",
        ),
        "last_results": """SELECT CAST(l_orderkey AS VARCHAR) AS name, max(printf('%04d-%09d-%06d-', l_linenumber, l_partkey, l_suppkey)
            || CAST(l_extendedprice AS VARCHAR)) AS file_name FROM lineitem GROUP BY l_orderkey""",
        "name_problems": """WITH n AS (SELECT replace(p_name, ' ', '_') AS name, p_size FROM part),
            g AS (SELECT CASE WHEN p_size < 5 THEN name ELSE name || '_moved' END AS name FROM n)
            SELECT DISTINCT name, 'not_in_grid' AS problem FROM n WHERE name NOT IN (SELECT name FROM g)
            UNION ALL SELECT name, 'duplicate' FROM g GROUP BY 1 HAVING count(*) > 1""",
        "log_metrics": with_(
            LOGS, "SELECT file, best_epoch, best_val_loss, test_epoch, test_loss, CAST(oom AS INT) AS oom, adp_score, tp FROM log_read"
        ),
        "log_exit_codes": with_(
            LOGS,
            """SELECT file, CAST(CASE WHEN top > 300 THEN 137 ELSE 0 END AS BIGINT) AS exit_code, CAST(oom = 1 OR top > 300 AS INT) AS oom
            FROM log_read JOIN (SELECT file, max(value) AS top FROM logs GROUP BY 1) USING (file)""",
        ),
        "int_ranges": """SELECT owner, min(task) AS first, max(task) AS last, count(*) AS length,
            CASE WHEN count(*) = 1 THEN CAST(min(task) AS VARCHAR) ELSE min(task) || '-' || max(task) END AS text
            FROM (SELECT owner, task, task - row_number() OVER (PARTITION BY owner ORDER BY task) AS island
              FROM (SELECT DISTINCT l_suppkey AS owner, l_partkey AS task FROM lineitem)) GROUP BY owner, island""",
        "ordered_union": with_(
            EDGES,
            """SELECT owner, item, row_number() OVER (PARTITION BY owner ORDER BY lst, pos) AS position FROM (
            SELECT user_id AS owner, CAST(k AS BIGINT) AS item, min(CASE WHEN relation = 'view' THEN 0 ELSE 1 END) AS lst,
              arg_min(event_id, (CASE WHEN relation = 'view' THEN 0 ELSE 1 END, event_id)) AS pos
            FROM v_edges GROUP BY 1, 2)""",
        ),
        "job_tally": with_(JOBS, "SELECT method, rung, state, account, CAST(sum(tasks) AS BIGINT) AS tasks FROM j GROUP BY 1, 2, 3, 4"),
        "account_slots": with_(
            JOBS,
            "SELECT account, CAST(sum(tasks) AS BIGINT) AS used, CAST(greatest(0, 10000 - sum(tasks)) AS BIGINT) AS free FROM j GROUP BY 1",
        ),
        "namespace_inventory": with_(
            TRIALS,
            """SELECT o_orderstatus AS suffix, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, count(DISTINCT method) AS states,
            count(DISTINCT method || rung) AS rungs, count(*) FILTER (rung = 'r5_e5') AS final_rows,
            lpad(CAST(max(o_orderkey) AS VARCHAR), 12, '0') AS updated_at FROM t GROUP BY 1""",
        ),
        "param_grid": with_(AXES, "SELECT index, name, flag, line, prio FROM grid"),
        "planned_runs": with_(
            AXES,
            """SELECT rung, CAST(epochs AS BIGINT) AS epochs, resume_from, index, name FROM grid CROSS JOIN (
            VALUES ('r0_e1', 1, NULL), ('r1_e2', 2, 'r0_e1'), ('r2_e4', 4, 'r1_e2'), ('r3_e9', 9, 'r2_e4')) AS rungs(rung, epochs, resume_from)""",
        ),
        "override_maps": """SELECT p_partkey, CAST(7 AS BIGINT) AS keys, CAST(p_size AS VARCHAR) AS batch, dim AS hidden, dim AS time_dim, '0' AS seed
            FROM (SELECT *, CASE WHEN p_retailprice < 950 THEN '64' WHEN p_retailprice < 1000 THEN '100' ELSE '128' END AS dim FROM part)""",
        "expanded_templates": """SELECT 'part' || p_partkey || '_seed' || s AS name, CAST(s AS BIGINT) AS seed,
            CAST(CASE WHEN p_size > 25 THEN 2 ELSE 3 END AS BIGINT) AS keys, CASE WHEN p_size > 25 THEN '9' ELSE CAST(s AS VARCHAR) END AS training_seed
            FROM part CROSS JOIN (SELECT unnest([0, 1, 2]) AS s)""",
        "incremental_plan": with_(PLAN, "SELECT run_id, status FROM p"),
        "build_tally": with_(PLAN, "SELECT status, count(*) AS runs FROM p GROUP BY 1"),
    }
