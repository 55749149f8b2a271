"""Detail pages: root blockers over time, statement details and uses of objects, table references, functions in parallel SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import locks
from ..plans import statements as ST
from ..plans import storage as SG
from ..plans.rules import apply_rule
from ..sources import fixture as _fx
from ..sources.fixtures import fixture_dealt
from .registry import query

FROM, TO = "2024-01-03 00:00:00", "2024-01-29 12:00:00"


def _n(expr: str, alias: str) -> str:
    return f"CASE WHEN count(DISTINCT {expr}) > 1 THEN '< ' || count(DISTINCT {expr}) || ' >' ELSE min(CAST({expr} AS VARCHAR)) END AS {alias}"


def _one(expr: str, alias: str) -> str:
    return f"CASE WHEN count(DISTINCT {expr}) = 1 THEN min({expr}) END AS {alias}"


def _borders(snaps: str, start: str, end: str) -> str:
    """Bracketing snapshots by (dbid, instance_number), as CTE body."""
    return f"""SELECT dbid, instance_number,
  coalesce(max(CASE WHEN begin_interval_time <= TIMESTAMP '{start}' THEN snap_id END), min(CASE WHEN begin_interval_time >= TIMESTAMP '{start}' THEN snap_id END)) AS a,
  coalesce(min(CASE WHEN end_interval_time >= TIMESTAMP '{end}' THEN snap_id END), max(CASE WHEN end_interval_time <= TIMESTAMP '{end}' THEN snap_id END)) AS b
  FROM {snaps} GROUP BY 1, 2"""


_CARRY = "snap_id, sample_id, sample_time, blocking_session, blocking_serial, blocking_session_status, blocking_inst_id, oname, otext, data_object_id, instance_number, sql_id, username, event"

_OBJECT_TEXT = """SELECT o.object_id, o.owner || o.object_name AS oname, o.data_object_id,
    lower(o.object_type) || ' ' || o.owner || '.' || o.object_name || CASE WHEN o.object_name LIKE 'SYS_LOB%' THEN ' (' || coalesce(m.object_name, '') || ')'
      WHEN o.subobject_name IS NOT NULL THEN ' (' || o.subobject_name || ')' ELSE '' END AS otext
  FROM fx_ash_object o LEFT JOIN fx_ash_object m ON o.object_name LIKE 'SYS_LOB%' AND m.object_id = CAST(CASE WHEN o.object_name LIKE 'SYS_LOB%' THEN substr(o.object_name, 8, 10) END AS BIGINT)"""


@query("b05_root_blockers_over_time", f"""
WITH RECURSIVE lim AS ({_borders('fx_ash_snapshot', FROM, TO)}),
rng AS (SELECT dbid, min(a) AS a, max(b) AS b FROM lim GROUP BY 1),
lv AS (SELECT instance_number, min(sample_time) AS m FROM fx_ash_rac_live GROUP BY 1),
obj AS ({_OBJECT_TEXT}),
seen AS (
  SELECT h.* FROM fx_ash_rac h JOIN rng ON rng.dbid = h.dbid AND h.snap_id BETWEEN rng.a AND rng.b
    LEFT JOIN lv ON lv.instance_number = h.instance_number WHERE (lv.m IS NULL OR h.sample_time < lv.m)
  UNION ALL SELECT * REPLACE (CAST(NULL AS INTEGER) AS snap_id) FROM fx_ash_rac_live),
waits AS (SELECT s.*, o.oname, o.otext, o.data_object_id, u.username FROM seen s
  LEFT JOIN obj o ON o.object_id = CASE WHEN s.p2text = 'object #' THEN s.p2 ELSE s.current_obj END LEFT JOIN fx_db_user u ON u.user_id = s.user_id
  WHERE s.sample_time BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}' AND s.blocking_session_status IN ('VALID', 'GLOBAL')),
walk AS (
  SELECT w.*, {', '.join(f'w.{c} AS r_{c}' for c in _CARRY.split(', '))}, 1 AS lvl, [w.session_serial] AS path FROM waits w
  WHERE NOT EXISTS (SELECT 1 FROM waits i WHERE i.sample_id = w.sample_id AND i.session_id = w.blocking_session AND i.session_serial = w.blocking_serial)
  UNION ALL
  SELECT c.*, {', '.join(f'p.r_{c}' for c in _CARRY.split(', '))}, p.lvl + 1, list_append(p.path, c.session_serial)
  FROM walk p JOIN waits c ON c.sample_id = p.sample_id AND c.blocking_session = p.session_id AND c.blocking_serial = p.session_serial
  WHERE NOT list_contains(p.path, c.session_serial)),
g AS (SELECT r_snap_id AS root_snap_id, r_sample_id AS root_sample_id, r_sample_time AS root_sample_time, r_blocking_session AS root_blocking_session,
    r_blocking_serial AS root_blocking_serial, r_blocking_session_status AS root_blocking_status, r_blocking_inst_id AS root_blocking_inst_id,
    {_one('current_file', 'current_file')}, {_one('current_block', 'current_block')}, {_one('current_row', 'current_row')},
    {_n('session_id', 'blocked_sessions_total')}, {_n('CASE WHEN lvl = 1 THEN session_id END', 'blocked_sessions_direct')}, {_n('instance_number', 'waiting_instance')},
    round(sum(wait_time + time_waited) / 1e6, 6) AS seconds_in_wait_total,
    CASE WHEN count(DISTINCT r_oname) > 1 THEN '< ' || count(DISTINCT r_oname) || ' >' ELSE min(r_otext) END AS root_blocking_object,
    {_one('r_data_object_id', 'data_object_id')}, {_n('r_instance_number', 'root_instance_number')}, {_n('r_sql_id', 'root_sql_id')},
    {_n('r_username', 'root_user_name')}, {_n('r_event', 'root_event')}, max(lvl) AS max_level
  FROM walk GROUP BY 1, 2, 3, 4, 5, 6, 7)
SELECT g.*, coalesce(h.event, h.session_state, v.event, v.session_state, 'INACTIVE') AS root_blocking_event,
  coalesce(h.module, v.module) AS root_blocking_module, coalesce(h.action, v.action) AS root_blocking_action,
  coalesce(h.program, v.program) AS root_blocking_program, coalesce(h.sql_id, v.sql_id) AS root_blocking_sql_id, u.username AS root_blocking_user_name
FROM g
LEFT JOIN fx_ash_rac h ON h.snap_id = g.root_snap_id AND h.instance_number = g.root_blocking_inst_id AND h.session_id = g.root_blocking_session
  AND date_trunc('second', h.sample_time) = date_trunc('second', g.root_sample_time)
LEFT JOIN fx_ash_rac_live v ON v.instance_number = g.root_blocking_inst_id AND v.session_id = g.root_blocking_session
  AND date_trunc('second', v.sample_time) = date_trunc('second', g.root_sample_time)
LEFT JOIN fx_db_user u ON u.user_id = coalesce(h.user_id, v.user_id)""")
def b05_over_time(spark, sf):
    return locks.root_blockers_over_time(*[_fx(spark, sf, n) for n in ("fx_ash_rac", "fx_ash_rac_live", "fx_ash_snapshot", "fx_ash_object", "fx_db_user")], FROM, TO)


_PER = "CASE WHEN {0} = 0 THEN 1 ELSE {0} END"
_EXECS = _PER.format("sum(executions_delta)")


def _sum(c: str) -> str:
    return f"CAST(sum({c}_delta) AS BIGINT) AS {c}"


def _last(c: str) -> str:
    return f"max(CASE WHEN snap_id = ls THEN {c} END)"


@query("d03_statement_detail", f"""
WITH s AS (SELECT * REPLACE (coalesce(parsing_schema_name, '[UNKNOWN]') AS parsing_schema_name) FROM fx_hist_stat WHERE snap_id BETWEEN 6 AND 40),
j AS (SELECT s.*, b.begin_interval_time, b.end_interval_time, max(s.snap_id) OVER (PARTITION BY s.dbid, s.instance_number, sql_id, parsing_schema_name) AS ls
  FROM s JOIN fx_hist_snapshot b ON b.dbid = s.dbid AND b.instance_number = s.instance_number AND b.snap_id = s.snap_id)
SELECT dbid, instance_number, sql_id, parsing_schema_name, {_last('plan_hash_value')} AS last_plan_hash_value,
  count(DISTINCT CASE WHEN plan_hash_value <> 0 THEN plan_hash_value END) AS plan_hash_values,
  {_last('optimizer_env_hash_value')} AS last_optimizer_env, count(DISTINCT optimizer_env_hash_value) AS optimizer_envs,
  {', '.join(_sum(c) for c in ('executions', 'fetches', 'parse_calls', 'sorts', 'loads', 'disk_reads', 'buffer_gets', 'rows_processed'))},
  100 * (sum(buffer_gets_delta) - sum(disk_reads_delta)) / greatest(sum(buffer_gets_delta), 1) AS hit_ratio,
  round(sum(elapsed_time_delta) / 1e6, 6) AS elapsed_secs, sum(elapsed_time_delta) / 1e6 / {_EXECS} AS elapsed_secs_per_exec,
  round(sum(cpu_time_delta) / 1e6, 6) AS cpu_secs, sum(disk_reads_delta) / {_EXECS} AS disk_reads_per_exec,
  sum(executions_delta) / {_PER.format('sum(disk_reads_delta)')} AS execs_per_disk, sum(buffer_gets_delta) / {_EXECS} AS buffer_gets_per_exec,
  sum(buffer_gets_delta) / {_PER.format('sum(rows_processed_delta)')} AS buffer_gets_per_row,
  {', '.join(f'round(sum({c}) / 1e6, 6) AS {a}' for c, a in ST.WAIT_SPLIT.items())},
  CAST(min(begin_interval_time) AS TIMESTAMP) AS first_occurrence, CAST(max(end_interval_time) AS TIMESTAMP) AS last_occurrence,
  {_last('module')} AS last_module, {_last('action')} AS last_action
FROM j GROUP BY 1, 2, 3, 4""")
def d03_detail(spark, sf):
    return ST.statement_detail(_fx(spark, sf, "fx_hist_stat"), _fx(spark, sf, "fx_hist_snapshot"), 6, 40)


_CUR = ("plan_hash_value", "object_status", "parsing_schema_name", "module", "action", "executions", "fetches", "parse_calls", "sorts", "loads", "elapsed_time",
        "cpu_time", "buffer_gets", "disk_reads", "rows_processed", "clwait", "apwait", "ccwait", "iowait", "plsexec_time")


@query("d03_current_detail_relaxed_filters", f"""
WITH w AS (SELECT DISTINCT inst_id, sql_id, 'VALID' AS st, 'A' AS sc FROM fx_cur_sql),
c AS (SELECT c.*, CASE WHEN coalesce(object_status = st AND parsing_schema_name = sc, FALSE) THEN 0 WHEN coalesce(parsing_schema_name = sc, FALSE) THEN 1 ELSE 2 END AS match_rank
  FROM fx_cur_sql c JOIN w ON w.inst_id = c.inst_id AND w.sql_id = c.sql_id),
r AS (SELECT *, row_number() OVER (PARTITION BY inst_id, sql_id ORDER BY match_rank, child_number) AS rn, count(*) OVER (PARTITION BY inst_id, sql_id) AS child_count FROM c)
SELECT inst_id, sql_id, child_count, match_rank, CASE match_rank WHEN 1 THEN 'object_status' WHEN 2 THEN 'object_status, parsing_schema_name' END AS suppressed,
  child_number, {', '.join(_CUR)}, 100 * (buffer_gets - disk_reads) / greatest(buffer_gets, 1) AS hit_ratio
FROM r WHERE rn = 1""")
def d03_current(spark, sf):
    c = fixture_dealt(spark, sf, "fx_cur_sql", "lineitem", ["CAST(l_suppkey % 2 + 1 AS INT)", "concat('s', CAST(l_partkey AS STRING))"])
    wanted = _fx(spark, sf, "fx_cur_sql").select("inst_id", "sql_id").distinct().withColumn("object_status", F.lit("VALID")).withColumn("parsing_schema_name", F.lit("A"))
    return ST.statement_detail_current(c, wanted)


D_FROM, D_TO = "1995-06-10 00:00:00", "1997-03-05 00:00:00"


@query("d08_statements_using_object", f"""
WITH lim AS ({_borders('fx_hist_snapshot', D_FROM, D_TO)}),
g AS (SELECT s.dbid, s.sql_id, s.instance_number, s.parsing_schema_name, p.operation, p.options, p.other_tag,
    CAST(min(b.begin_interval_time) AS TIMESTAMP) AS first_occurrence, CAST(max(b.end_interval_time) AS TIMESTAMP) AS last_occurrence,
    {', '.join(_sum(c) for c in ('executions', 'fetches', 'disk_reads', 'buffer_gets', 'rows_processed', 'parse_calls'))},
    round(sum(elapsed_time_delta) / 1e6, 6) AS elapsed_secs, round(sum(cpu_time_delta) / 1e6, 6) AS cpu_secs,
    sum(elapsed_time_delta) / 1e6 / {_EXECS} AS elapsed_secs_per_exec,
    {', '.join(f'sum({c}_delta) / {_EXECS} AS {c}_per_exec' for c in ('disk_reads', 'buffer_gets', 'rows_processed'))},
    min(s.snap_id) AS min_snap_id, max(s.snap_id) AS max_snap_id
  FROM fx_hist_plan p JOIN fx_hist_stat s ON s.dbid = p.dbid AND s.sql_id = p.sql_id AND s.plan_hash_value = p.plan_hash_value
  JOIN fx_hist_snapshot b ON b.dbid = s.dbid AND b.instance_number = s.instance_number AND b.snap_id = s.snap_id
  JOIN lim ON lim.dbid = s.dbid AND lim.instance_number = s.instance_number AND s.snap_id BETWEEN lim.a AND lim.b
  WHERE p.object_name LIKE 'T1%' AND p.object_owner = 'BRAND#1' GROUP BY 1, 2, 3, 4, 5, 6, 7)
SELECT g.*, substr(t.sql_text, 1, 100) AS sql_text FROM g LEFT JOIN fx_hist_text t ON t.dbid = g.dbid AND t.sql_id = g.sql_id""")
def d08(spark, sf):
    return ST.statements_using_object(*[_fx(spark, sf, n) for n in ("fx_hist_plan", "fx_hist_stat", "fx_hist_snapshot", "fx_hist_text")],
                                      D_FROM, D_TO, name="t1%", owner="brand#1")


@query("d08_statements_using_object_current", f"""
SELECT c.inst_id, c.sql_id, c.plan_hash_value, c.child_number, p.id AS line_id, p.operation, p.options, c.parsing_schema_name,
  executions, fetches, rows_processed, disk_reads, buffer_gets, round(elapsed_time / 1e6, 6) AS elapsed_secs,
  elapsed_time / 1e6 / {_PER.format('executions')} AS elapsed_secs_per_exec,
  {', '.join(f"{c} / {_PER.format('executions')} AS {c}_per_exec" for c in ('disk_reads', 'buffer_gets', 'rows_processed'))}
FROM fx_cur_sql c JOIN fx_cur_plan p ON p.inst_id = c.inst_id AND p.sql_id = c.sql_id AND p.plan_hash_value = c.plan_hash_value AND p.child_number = c.child_number
WHERE p.object_name LIKE 'I2%'""")
def d08_current(spark, sf):
    return ST.statements_using_object_current(_fx(spark, sf, "fx_cur_plan"), _fx(spark, sf, "fx_cur_sql"), "i2%")


@query("d09_object_in_last_plan", f"""
WITH s AS (SELECT s.*, max(s.snap_id) OVER (PARTITION BY s.dbid, sql_id, s.instance_number, parsing_schema_name) AS ls FROM fx_hist_stat s
  JOIN fx_hist_snapshot b ON b.dbid = s.dbid AND b.instance_number = s.instance_number AND b.snap_id = s.snap_id
  WHERE b.instance_number = 2 AND b.begin_interval_time > TIMESTAMP '{D_FROM}' AND b.begin_interval_time < TIMESTAMP '{D_TO}'),
g AS (SELECT dbid, sql_id, instance_number, parsing_schema_name, {_last('plan_hash_value')} AS last_plan_hash_value,
    {', '.join(_sum(c) for c in ('executions', 'disk_reads', 'buffer_gets', 'rows_processed'))},
    round(sum(elapsed_time_delta) / 1e6, 6) AS elapsed_secs, round(sum(cpu_time_delta) / 1e6, 6) AS cpu_secs,
    sum(elapsed_time_delta) / 1e6 / {_EXECS} AS elapsed_secs_per_exec, min(snap_id) AS min_snap_id, max(snap_id) AS max_snap_id
  FROM s GROUP BY 1, 2, 3, 4)
SELECT g.*, substr(t.sql_text, 1, 100) AS sql_text
FROM g JOIN fx_hist_plan p ON p.dbid = g.dbid AND p.sql_id = g.sql_id AND p.plan_hash_value = g.last_plan_hash_value
LEFT JOIN fx_hist_text t ON t.dbid = g.dbid AND t.sql_id = g.sql_id
WHERE p.object_owner = 'BRAND#2' AND p.object_name = 'T12'""")
def d09(spark, sf):
    return ST.statements_with_object_in_last_plan(*[_fx(spark, sf, n) for n in ("fx_hist_stat", "fx_hist_snapshot", "fx_hist_plan", "fx_hist_text")],
                                                  2, D_FROM, D_TO, "brand#2", "t12")


@query("r38_functions_not_parallel", """
WITH ref AS (SELECT max(begin_interval_time) AS m FROM fx_hist_snapshot),
h AS (SELECT s.dbid, s.sql_id, round(sum(s.elapsed_time_delta) / 1e6, 6) AS elapsed_secs FROM fx_hist_stat s JOIN fx_hist_snapshot b
    ON b.dbid = s.dbid AND b.instance_number = s.instance_number AND b.snap_id = s.snap_id WHERE b.begin_interval_time > (SELECT m FROM ref) - INTERVAL 200 DAY GROUP BY 1, 2),
txt AS (SELECT 'SGA' AS source, sql_id, upper(sql_text) AS u, round(elapsed_time / 1e6, 6) AS elapsed_secs FROM fx_par_cursor
  UNION ALL SELECT 'History', h.sql_id, upper(t.sql_text), h.elapsed_secs FROM h JOIN fx_par_text t ON t.dbid = h.dbid AND t.sql_id = h.sql_id)
SELECT source, sql_id, owner, object_name, procedure_name, object_type, elapsed_secs FROM txt JOIN fx_procedure p
ON p.parallel = 'NO' AND p.owner NOT IN ('SYS', 'WMSYS', 'PERFSTAT')
 AND ((p.object_type = 'FUNCTION' AND regexp_matches(u, '[^A-Z_]' || p.object_name || '[^A-Z_]'))
   OR (p.object_type = 'PACKAGE' AND regexp_matches(u, '[^A-Z_]' || p.object_name || '[.]' || p.procedure_name || '[^A-Z_]')))
WHERE contains(u, 'PARALLEL') AND NOT regexp_matches(u, '^\\s*(BEGIN|DECLARE|EXPLAIN)')""")
def r38(spark, sf):
    return apply_rule("R38", {role: _fx(spark, sf, n) for role, n in (("procedures", "fx_procedure"), ("sqlarea", "fx_par_cursor"), ("sqlstat", "fx_hist_stat"),
                                                                      ("snapshot", "fx_hist_snapshot"), ("hist_texts", "fx_par_text"))}, days=200)


def _refs_sql(where: str, rows_of: str) -> str:
    return f"""
WITH l AS (SELECT owner, constraint_name, list(column_name ORDER BY position) AS cols FROM fx_ref_column GROUP BY 1, 2)
SELECT c.owner, c.table_name, c.constraint_name, c.r_owner, r.table_name AS r_table_name, c.r_constraint_name, t.num_rows,
  array_to_string(a.cols, ', ') AS columns, array_to_string(b.cols, ', ') AS r_columns,
  array_to_string(list_transform(generate_series(1, greatest(len(a.cols), len(b.cols))), lambda i: coalesce(a.cols[i], '') || ' = ' || coalesce(b.cols[i], '')), ', ') AS pairs
FROM fx_cat_constraint c JOIN fx_cat_constraint r ON r.owner = c.r_owner AND r.constraint_name = c.r_constraint_name
JOIN l a ON a.owner = c.owner AND a.constraint_name = c.constraint_name JOIN l b ON b.owner = r.owner AND b.constraint_name = r.constraint_name
JOIN fx_cat_table t ON t.owner = {rows_of}.owner AND t.table_name = {rows_of}.table_name
WHERE c.constraint_type = 'R' AND {where}"""


def _owner(spark, sf, table):
    """The owner of a table of the catalog binding."""
    return _fx(spark, sf, "fx_cat_table").where(F.col("table_name") == table).select("owner").first()[0]


def _own(alias: str, table: str) -> str:
    return f"{alias}.table_name = '{table}' AND {alias}.owner = (SELECT owner FROM fx_cat_table WHERE table_name = '{table}')"


@query("f07_references_out", _refs_sql(_own("c", "T7"), "r"))
def f07_out(spark, sf):
    return SG.references(*[_fx(spark, sf, n) for n in ("fx_cat_constraint", "fx_ref_column", "fx_cat_table")], "T7", _owner(spark, sf, "T7"))


@query("f07_references_in", _refs_sql(_own("r", "T11"), "c"))
def f07_in(spark, sf):
    return SG.references(*[_fx(spark, sf, n) for n in ("fx_cat_constraint", "fx_ref_column", "fx_cat_table")], "T11", _owner(spark, sf, "T11"), incoming=True)


@query("f07_table_indexes", f"""
WITH ix AS (SELECT * FROM fx_cat_index i WHERE {_own('i', 'T7').replace('i.owner', 'i.table_owner')}),
c AS (SELECT k.index_owner, k.index_name, string_agg(coalesce(e.column_expression, k.column_name), ', ' ORDER BY k.column_position) AS column_names
  FROM fx_cat_ind_column k LEFT JOIN fx_cat_ind_expression e ON e.index_owner = k.index_owner AND e.index_name = k.index_name AND k.column_position = 1 GROUP BY 1, 2),
p AS (SELECT index_owner, index_name, count(*) AS partitions, CASE WHEN count(DISTINCT pct_free) = 1 THEN min(pct_free) END AS partition_pct_free,
  CASE WHEN count(DISTINCT partition_name) = 1 THEN min(partition_name) ELSE 'N/A' END AS partition_name, CAST(sum(num_rows) AS BIGINT) AS partition_rows FROM fx_cat_ind_partition GROUP BY 1, 2)
SELECT ix.owner AS index_owner, ix.index_name, uniqueness, num_rows, distinct_keys, partitioned, column_names, partitions, partition_pct_free, partition_name, partition_rows,
  CASE WHEN index_flags & 65536 = 0 THEN 'NO' ELSE 'YES' END AS monitoring, CASE WHEN usage_flags & 1 = 0 THEN 'NO' ELSE 'YES' END AS used
FROM ix LEFT JOIN c ON c.index_owner = ix.owner AND c.index_name = ix.index_name LEFT JOIN p ON p.index_owner = ix.owner AND p.index_name = ix.index_name
LEFT JOIN fx_cat_index_usage u ON u.owner = ix.owner AND u.index_name = ix.index_name""")
def f07_indexes(spark, sf):
    return SG.table_indexes(*[_fx(spark, sf, n) for n in ("fx_cat_index", "fx_cat_ind_column", "fx_cat_ind_expression", "fx_cat_ind_partition", "fx_cat_index_usage")],
                            "T7", _owner(spark, sf, "T7"))
