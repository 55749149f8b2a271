"""Rule-check queries (R-family) through ``apply_rule``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.rules import AUDIT_OPTIONS, PGA_BYTES, PGA_COUNTS, apply_rule
from ..sources import fixture
from .registry import query


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


def _t(spark, sf, **roles):
    return {role: (_fx(spark, sf, v) if isinstance(v, str) else v) for role, v in roles.items()}


RECENT = """recent AS (SELECT s.* FROM {src} s WHERE EXISTS (SELECT 1 FROM fx_snapshot ss WHERE ss.dbid = s.dbid
  AND ss.instance_number = s.instance_number AND ss.snap_id = s.snap_id
  AND ss.begin_interval_time > (SELECT max(begin_interval_time) FROM fx_snapshot) - INTERVAL {days} DAY))"""


def recent(days=400, src="fx_sqlstat"):
    return RECENT.format(days=days, src=src)


def _unused_sql(table, name, use, where=""):
    return f"""
WITH {recent(30)},
used AS (SELECT object_owner, object_name FROM {use} u WHERE origin = 'O' AND EXISTS (
           SELECT 1 FROM fx_sqlarea a WHERE a.sql_id = u.sql_id AND NOT contains(a.sql_text, 'dbms_stats cursor_sharing_exact'))
         UNION SELECT object_owner, object_name FROM {use} u WHERE origin = 'F'
           AND EXISTS (SELECT 1 FROM recent r WHERE r.sql_id = u.sql_id AND r.plan_hash_value = u.plan_hash_value)
           AND EXISTS (SELECT 1 FROM fx_sqltext t WHERE t.sql_id = u.sql_id AND NOT contains(t.sql_text, 'dbms_stats cursor_sharing_exact')))
SELECT * FROM {table} c WHERE owner NOT IN ('SYS', 'OUTLN', 'SYSTEM', 'WMSYS', 'SYSMAN', 'XDB') {where} AND NOT EXISTS (
  SELECT 1 FROM used WHERE used.object_owner = c.owner AND used.object_name = c.{name})"""


def _use(spark, sf, use):
    u = _fx(spark, sf, use)
    return dict(plan_lines=u.filter(F.col("origin") == "O"), plan_lines_hist=u.filter(F.col("origin") == "F"),
                **_t(spark, sf, sqlarea="fx_sqlarea", sqltext="fx_sqltext", sqlstat="fx_sqlstat", snapshot="fx_snapshot"))


@query("r08_unused_indexes", _unused_sql("fx_cat_index_wide", "index_name", "fx_index_use", "AND uniqueness <> 'UNIQUE'"))
def r08(spark, sf):
    return apply_rule("R08", {**_t(spark, sf, indexes="fx_cat_index_wide"), **_use(spark, sf, "fx_index_use")}, days=30)


@query("r16_unused_tables", _unused_sql("fx_cat_table_wide", "table_name", "fx_table_use"))
def r16(spark, sf):
    return apply_rule("R16", {**_t(spark, sf, tables="fx_cat_table_wide"), **_use(spark, sf, "fx_table_use")}, days=30)


@query("r17_missing_housekeeping", """
SELECT owner, table_name, CAST(sum(inserts) AS BIGINT) AS inserts, CAST(sum(deletes) AS BIGINT) AS deletes
FROM fx_tab_mod GROUP BY 1, 2 HAVING sum(inserts) >= 1 AND sum(deletes) = 0""")
def r17(spark, sf):
    return apply_rule("R17", _t(spark, sf, tab_modifications="fx_tab_mod"))


PLAN_STATS = """ps AS (SELECT dbid, sql_id, plan_hash_value, CAST(sum(executions_delta) AS BIGINT) AS executions,
  CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed FROM recent GROUP BY 1, 2, 3)"""


@query("r22_index_full_scans", f"""
WITH {recent()}, {PLAN_STATS},
p AS (SELECT DISTINCT sql_id, plan_hash_value, object_owner, object_name FROM fx_stmt_plan WHERE operation = 'INDEX' AND options = 'FULL SCAN')
SELECT ps.*, p.object_owner, p.object_name, o.num_rows
FROM ps JOIN p ON p.sql_id = ps.sql_id AND p.plan_hash_value = ps.plan_hash_value
LEFT JOIN fx_plan_object o ON o.owner = p.object_owner AND o.object_name = p.object_name""")
def r22(spark, sf):
    out = apply_rule("R22", _t(spark, sf, sqlstat="fx_sqlstat", snapshot="fx_snapshot", plan_lines="fx_stmt_plan",
                               objects="fx_plan_object"), days=400)
    return out.select("plan_hash_value", "dbid", "sql_id", "executions", "rows_processed", "object_owner", "object_name", "num_rows")


FULL_SQL = f"""{recent()}, {PLAN_STATS},
p AS (SELECT DISTINCT sql_id, plan_hash_value, object_owner, object_name FROM fx_stmt_plan
      WHERE operation = 'TABLE ACCESS' AND options LIKE '%FULL' AND object_owner <> 'SYS')"""


@query("r23_full_scans_by_executions", f"""WITH {FULL_SQL}
SELECT ps.*, p.object_owner, p.object_name FROM ps JOIN p ON p.sql_id = ps.sql_id AND p.plan_hash_value = ps.plan_hash_value
WHERE ps.executions > 100""")
def r23(spark, sf):
    out = apply_rule("R23", _t(spark, sf, sqlstat="fx_sqlstat", snapshot="fx_snapshot", plan_lines="fx_stmt_plan"), days=400)
    return out.select("dbid", "sql_id", "plan_hash_value", "executions", "rows_processed", "object_owner", "object_name")


@query("r24_full_scans_by_rows", f"""WITH {FULL_SQL},
g AS (SELECT ps.dbid, ps.sql_id, p.object_owner, p.object_name, CAST(sum(ps.executions) AS BIGINT) AS executions,
        CAST(sum(ps.rows_processed) AS BIGINT) AS rows_processed, min(o.num_rows) AS num_rows
      FROM ps JOIN p ON p.sql_id = ps.sql_id AND p.plan_hash_value = ps.plan_hash_value
      JOIN fx_plan_object o ON o.owner = p.object_owner AND o.object_name = p.object_name AND o.num_rows > 1000 GROUP BY 1, 2, 3, 4)
SELECT *, round(rows_processed / executions, 2) AS rows_per_exec,
  round(round(rows_processed / executions, 2) / num_rows / executions, 12) AS order_value FROM g
WHERE rows_processed > 0 AND executions > 100
  AND sql_id IN (SELECT sql_id FROM fx_sqltext WHERE NOT contains(sql_text, 'dbms_stats'))""")
def r24(spark, sf):
    return apply_rule("R24", _t(spark, sf, sqlstat="fx_sqlstat", snapshot="fx_snapshot", plan_lines="fx_stmt_plan",
                                objects="fx_plan_object", sqltext="fx_sqltext"), days=400, min_rows=1000)


@query("r26_excessive_buffer_access", f"""
WITH {recent()},
g AS (SELECT dbid, sql_id, instance_number, coalesce(min(parsing_schema_name), '[UNKNOWN]') AS username,
   max(buffer_gets_delta) AS max_buffer_gets, CAST(sum(executions_delta) AS BIGINT) AS executions,
   round(sum(elapsed_time_delta) / 1e6, 4) AS elapsed_secs, CAST(sum(disk_reads_delta) AS BIGINT) AS disk_reads,
   CAST(sum(buffer_gets_delta) AS BIGINT) AS buffer_gets, CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed,
   round((sum(elapsed_time_delta) / 1e6) / CASE WHEN sum(executions_delta) = 0 THEN 1 ELSE sum(executions_delta) END, 2) AS elapsed_per_exec
   FROM recent GROUP BY 1, 2, 3)
SELECT g.*, t.sql_text FROM g JOIN fx_sqltext t ON t.sql_id = g.sql_id WHERE max_buffer_gets IS NOT NULL
ORDER BY max_buffer_gets DESC NULLS LAST, sql_id, instance_number LIMIT 20""")
def r26(spark, sf):
    return apply_rule("R26", _t(spark, sf, sqlstat="fx_sqlstat", snapshot="fx_snapshot", sqltext="fx_sqltext"),
                      days=400, max_rows=20)


@query("r27_small_objects", f"""
WITH {recent()},
g AS (SELECT dbid, sql_id, plan_hash_value, instance_number, CAST(sum(executions_delta) AS BIGINT) AS executions FROM recent
      GROUP BY 1, 2, 3, 4 HAVING sum(executions_delta) > 100)
SELECT g.sql_id, g.plan_hash_value, g.instance_number, g.executions, o.owner, o.object_name, o.num_rows,
  round(g.executions / CASE WHEN o.num_rows = 0 THEN 1 ELSE o.num_rows END, 6) AS execs_per_row
FROM g JOIN fx_stmt_plan p ON p.sql_id = g.sql_id AND p.plan_hash_value = g.plan_hash_value AND p.object_owner <> 'SYS'
JOIN fx_plan_object o ON o.owner = p.object_owner AND o.object_name = p.object_name WHERE o.num_rows < 100000""")
def r27(spark, sf):
    out = apply_rule("R27", _t(spark, sf, sqlstat="fx_sqlstat", snapshot="fx_snapshot", plan_lines="fx_stmt_plan",
                               objects="fx_plan_object"), days=400)
    return out.select("sql_id", "plan_hash_value", "instance_number", "executions", "owner", "object_name", "num_rows",
                      "execs_per_row")


@query("r28_single_row_fetch_cur", """
SELECT sql_id, executions, fetches, rows_processed, round(rows_processed / executions, 2) AS rows_per_exec,
  round(fetches / executions, 2) AS fetches_per_exec, round(rows_processed / fetches, 2) AS rows_per_fetch,
  round(executions * (((rows_processed / executions) % 1000.0) / (rows_processed / fetches) - 1)) AS additional_fetches
FROM fx_sqlarea WHERE fetches > executions AND fetches > 1 AND executions > 0 AND rows_processed > 0
  AND round(fetches / executions, 2) > 100""")
def r28(spark, sf):
    out = apply_rule("R28", _t(spark, sf, sqlarea="fx_sqlarea"))
    return out.select("sql_id", "executions", "fetches", "rows_processed", "rows_per_exec", "fetches_per_exec",
                      "rows_per_fetch", "additional_fetches")


@query("r29_single_row_fetch_hist", f"""
WITH {recent(src='fx_sqlstat_ext')},
g AS (SELECT instance_number, dbid, parsing_schema_name, module, sql_id, CAST(sum(executions_delta) AS BIGINT) AS executions,
   CAST(sum(fetches_delta) AS BIGINT) AS fetches, CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed FROM recent GROUP BY 1, 2, 3, 4, 5)
SELECT *, round(fetches / executions, 2) AS fetches_per_exec, round(rows_processed / fetches, 2) AS rows_per_fetch FROM g
WHERE fetches > executions AND fetches > 1 AND executions > 0 AND rows_processed > 0 AND round(fetches / executions, 2) > 100""")
def r29(spark, sf):
    return apply_rule("R29", _t(spark, sf, sqlstat="fx_sqlstat_ext", snapshot="fx_snapshot"), days=400)


@query("r30_single_row_dml", f"""
WITH {recent()},
g AS (SELECT s.sql_id, s.instance_number, s.parsing_schema_name, CAST(sum(executions_delta) AS BIGINT) AS executions,
   CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed, min(t.sql_text) AS sql_text
   FROM recent s JOIN fx_sqltext t ON t.sql_id = s.sql_id AND t.command_type IN (2, 6, 7) GROUP BY 1, 2, 3)
SELECT *, round(rows_processed / executions, 2) AS rows_per_exec, round(executions * executions / rows_processed, 4) AS weight
FROM g WHERE executions > 100 AND rows_processed > 0""")
def r30(spark, sf):
    return apply_rule("R30", _t(spark, sf, sqlstat="fx_sqlstat", snapshot="fx_snapshot", sqltext="fx_sqltext"),
                      days=400, min_executions=100)


@query("r31_statements_without_hits", f"""
WITH {recent(40, 'fx_sqlstat_hits')},
g AS (SELECT dbid, sql_id, instance_number, max(buffer_gets_delta) AS max_buffer_gets, CAST(sum(executions_delta) AS BIGINT) AS executions,
   round(sum(elapsed_time_delta) / 1e6, 4) AS elapsed_secs, CAST(sum(disk_reads_delta) AS BIGINT) AS disk_reads,
   CAST(sum(buffer_gets_delta) AS BIGINT) AS buffer_gets, CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed FROM recent GROUP BY 1, 2, 3)
SELECT g.*, t.sql_text FROM g JOIN fx_sqltext t ON t.sql_id = g.sql_id
WHERE rows_processed = 0 AND executions > 5 AND regexp_matches(upper(t.sql_text), '^(UPDATE|DELETE|MERGE|SELECT|WITH)')""")
def r31(spark, sf):
    return apply_rule("R31", _t(spark, sf, sqlstat="fx_sqlstat_hits", snapshot="fx_snapshot", sqltext="fx_sqltext"), days=40, min_executions=5)


@query("r32_update_extra_filter_cur", """
SELECT *, round((elapsed_time / 1e6) / CASE WHEN rows_processed = 0 THEN 1 ELSE rows_processed END, 4) AS secs_per_row
FROM fx_sqlarea WHERE starts_with(upper(sql_text), 'UPDATE') AND instr(upper(sql_text), 'WHERE') > 0
  AND instr(substr(upper(sql_text), instr(upper(sql_text), 'WHERE')), 'AND') > 0 AND contains(sql_text, ':')""")
def r32(spark, sf):
    return apply_rule("R32", _t(spark, sf, sqlarea="fx_sqlarea"))


@query("r33_update_extra_filter_hist", f"""
WITH {recent()},
t AS (SELECT sql_id, sql_text FROM fx_sqltext WHERE starts_with(upper(sql_text), 'UPDATE') AND instr(upper(sql_text), 'WHERE') > 0
  AND instr(substr(upper(sql_text), instr(upper(sql_text), 'WHERE')), 'AND') > 0 AND contains(sql_text, ':')),
g AS (SELECT s.sql_id, s.instance_number, CAST(sum(executions_delta) AS BIGINT) AS executions,
   CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed, round(sum(elapsed_time_delta) / 1e6, 4) AS elapsed_secs
   FROM recent s JOIN t ON t.sql_id = s.sql_id GROUP BY 1, 2)
SELECT *, round(elapsed_secs / CASE WHEN rows_processed = 0 THEN 1 ELSE rows_processed END, 4) AS secs_per_row FROM g""")
def r33(spark, sf):
    return apply_rule("R33", _t(spark, sf, sqlstat="fx_sqlstat", snapshot="fx_snapshot", sqltext="fx_sqltext"), days=400)


@query("r40_changing_plans", f"""
WITH {recent()},
v AS (SELECT s.dbid, s.instance_number, s.sql_id, s.plan_hash_value,
   CAST(min(ss.begin_interval_time) AS TIMESTAMP) AS first_occurrence, CAST(max(ss.end_interval_time) AS TIMESTAMP) AS last_occurrence,
   round(sum(s.elapsed_time_delta) / 1e6, 6) AS elapsed_secs, CAST(sum(s.executions_delta) AS BIGINT) AS executions
  FROM recent s JOIN fx_snapshot ss ON ss.dbid = s.dbid AND ss.instance_number = s.instance_number AND ss.snap_id = s.snap_id
  GROUP BY 1, 2, 3, 4),
w AS (SELECT *, min(first_occurrence) OVER (PARTITION BY dbid, instance_number, sql_id) AS f,
                max(first_occurrence) OVER (PARTITION BY dbid, instance_number, sql_id) AS l FROM v),
c AS (SELECT dbid, instance_number, sql_id, count(*) AS variant_count,
  min(CASE WHEN first_occurrence = f THEN elapsed_secs END) AS elapsed_secs_first, max(CASE WHEN first_occurrence = l THEN elapsed_secs END) AS elapsed_secs_last,
  min(CASE WHEN first_occurrence = f THEN executions END) AS executions_first, max(CASE WHEN first_occurrence = l THEN executions END) AS executions_last,
  min(first_occurrence) AS first_occurrence_key, max(last_occurrence) AS last_occurrence_key,
  min(last_occurrence) AS last_occurrence_first_variant, max(first_occurrence) AS first_occurrence_last_variant
  FROM w GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT *, round(elapsed_secs_first / CASE WHEN executions_first = 0 THEN 1 ELSE executions_first END, 4) AS secs_per_exec_first,
  round(elapsed_secs_last / CASE WHEN executions_last = 0 THEN 1 ELSE executions_last END, 4) AS secs_per_exec_last FROM c""")
def r40(spark, sf):
    return apply_rule("R40", _t(spark, sf, sqlstat="fx_sqlstat", snapshot="fx_snapshot"), days=400)


SUBTREE_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY plan_hash_value, parent_id ORDER BY id) AS child_no FROM fx_plan_multi),
base AS (SELECT p.plan_hash_value, p.id AS p_id, p.operation AS p_operation, c2.id AS c2_id FROM r p
  JOIN r c1 ON c1.plan_hash_value = p.plan_hash_value AND c1.parent_id = p.id AND c1.child_no = 1
  JOIN r c2 ON c2.plan_hash_value = p.plan_hash_value AND c2.parent_id = p.id AND c2.child_no = 2),
d AS (SELECT b.*, 0 AS d_level, r.id AS d_id, r.operation AS d_operation, r.object_owner AS d_object_owner, r.object_name AS d_object_name
      FROM base b JOIN r ON r.plan_hash_value = b.plan_hash_value AND r.id = b.c2_id
  UNION ALL
  SELECT d.plan_hash_value, d.p_id, d.p_operation, d.c2_id, d.d_level + 1, r.id, r.operation, r.object_owner, r.object_name
  FROM d JOIN r ON r.plan_hash_value = d.plan_hash_value AND r.parent_id = d.d_id WHERE d.d_level < {depth})"""


@query("r41_nested_loop_large_objects", "WITH RECURSIVE " + SUBTREE_SQL.format(depth=1) + """
SELECT d.plan_hash_value, d.p_id, d.c2_id, d.d_level, d.d_id, d.d_object_owner, d.d_object_name, o.num_rows
FROM d JOIN fx_plan_object o ON o.owner = d.d_object_owner AND o.object_name = d.d_object_name
WHERE d.p_operation = 'LARGE' AND o.num_rows >= 20000""")
def r41(spark, sf):
    return apply_rule("R41", _t(spark, sf, plan_lines="fx_plan_multi", objects="fx_plan_object"),
                      join_operation="LARGE", depth=1, min_rows=20000)


@query("r42_nested_loop_full_scan", "WITH RECURSIVE " + SUBTREE_SQL.format(depth=5) + """
SELECT plan_hash_value, p_id, c2_id, d_level, d_id, d_object_name FROM d WHERE p_operation = 'LARGE' AND d_operation = 'PROMO'""")
def r42(spark, sf):
    return apply_rule("R42", _t(spark, sf, plan_lines="fx_plan_multi"), join_operation="LARGE", scan_operation="PROMO", depth=5)


@query("r47_hot_blocks_small_objects", """
WITH g AS (SELECT e.object_id, count(*) AS accesses, count(DISTINCT a.block_no) AS blocks_hit
  FROM fx_block_access a JOIN fx_extent e ON e.file_id = a.file_id AND a.block_no BETWEEN e.block_id AND e.block_id + e.blocks - 1 GROUP BY 1)
SELECT g.*, o.owner, o.object_name, o.num_rows, round(accesses / blocks_hit, 4) AS accesses_per_block
FROM g JOIN fx_object o ON o.object_id = g.object_id WHERE o.num_rows < 1000""")
def r47(spark, sf):
    return apply_rule("R47", _t(spark, sf, block_access="fx_block_access", extents="fx_extent", objects="fx_object"),
                      max_rows_object=1000, bucket=64)


SECTION_SQL = """s AS (SELECT sql_id, table_name, sql_text,
    CASE WHEN instr(upper(sql_text), ' SET ') > 0 THEN
      CASE WHEN instr(upper(substr(sql_text, instr(upper(sql_text), ' SET ') + 5)), ' WHERE ') > 0
           THEN substr(substr(sql_text, instr(upper(sql_text), ' SET ') + 5), 1, instr(upper(substr(sql_text, instr(upper(sql_text), ' SET ') + 5)), ' WHERE ') - 1)
           ELSE substr(sql_text, instr(upper(sql_text), ' SET ') + 5) END END AS section FROM fx_dml)"""


@query("r49_update_indexed_columns", f"""
WITH {SECTION_SQL}
SELECT s.sql_id, s.table_name, s.sql_text, c.column_name FROM s JOIN fx_ind_column c ON c.table_name = s.table_name
WHERE regexp_matches(upper(s.section), '\\b' || upper(c.column_name) || '\\b')""")
def r49(spark, sf):
    return apply_rule("R49", _t(spark, sf, dml_texts="fx_dml", index_columns="fx_ind_column")) \
        .select("sql_id", "table_name", "sql_text", "column_name")


@query("r72_update_pk_columns", f"""
WITH {SECTION_SQL}
SELECT s.sql_id, s.table_name, s.sql_text, c.column_name FROM s JOIN fx_pk_column c ON c.table_name = s.table_name
WHERE regexp_matches(upper(s.section), '\\b' || upper(c.column_name) || '\\b')""")
def r72(spark, sf):
    return apply_rule("R72", _t(spark, sf, dml_texts="fx_dml", pk_columns="fx_pk_column")) \
        .select("sql_id", "table_name", "sql_text", "column_name")


PGA_SQL = ", ".join([f"round(max(CASE WHEN name = '{n}' THEN value ELSE 0 END) / 1048576.0) AS {c}" for n, c in PGA_BYTES.items()]
                    + [f"max(CASE WHEN name = '{n}' THEN value ELSE 0 END) AS {c}" for n, c in PGA_COUNTS.items()])


@query("r52_memory_statistics_history", f"""
WITH g AS (SELECT dbid, instance_number, snap_id, {PGA_SQL} FROM fx_pgastat WHERE instance_number = 1 GROUP BY 1, 2, 3)
SELECT g.* REPLACE (g.over_allocation_count - p.value AS over_allocation_count), CAST(ss.begin_interval_time AS TIMESTAMP) AS begin_interval_time
FROM g LEFT JOIN fx_pgastat p ON p.dbid = g.dbid AND p.instance_number = g.instance_number AND p.snap_id + 1 = g.snap_id AND p.name = 'over allocation count'
JOIN fx_snapshot ss ON ss.dbid = g.dbid AND ss.instance_number = g.instance_number AND ss.snap_id = g.snap_id
WHERE ss.begin_interval_time > (SELECT max(begin_interval_time) FROM fx_snapshot) - INTERVAL 1000 DAY""")
def r52(spark, sf):
    return apply_rule("R52", _t(spark, sf, pgastat="fx_pgastat", snapshot="fx_snapshot"), days=1000)


@query("r55_active_sessions_per_sample", """
SELECT sample_time, instance_number, count(*) AS active_sessions FROM fx_ash GROUP BY 1, 2""")
def r55(spark, sf):
    return apply_rule("R55", _t(spark, sf, ash="fx_ash"))


@query("r56_parse_ratio", f"""
WITH {recent(src='fx_sqlstat_ext')},
g AS (SELECT sql_id, instance_number, parsing_schema_name, CAST(sum(executions_delta) AS BIGINT) AS executions,
   CAST(sum(parse_calls_delta) AS BIGINT) AS parses FROM recent GROUP BY 1, 2, 3)
SELECT *, round(executions / CASE WHEN parses = 0 THEN 1 ELSE parses END, 2) AS execs_per_parse FROM g""")
def r56(spark, sf):
    return apply_rule("R56", _t(spark, sf, sqlstat="fx_sqlstat_ext", snapshot="fx_snapshot"), days=400)


@query("r58_literals_instead_of_binds", """
SELECT substr(sql_text, 1, 25) AS prefix, count(*) AS variations, CAST(sum(executions) AS BIGINT) AS executions,
  CAST(sum(elapsed_time) AS BIGINT) AS elapsed_time, min(sql_id) AS example_sql_id
FROM fx_sqlarea GROUP BY 1 HAVING count(*) >= 2""")
def r58(spark, sf):
    return apply_rule("R58", _t(spark, sf, sqlarea="fx_sqlarea"), prefix_length=25)


@query("r59_open_cursors_per_sql", """
SELECT inst_id, sql_id, count(*) AS open_cursors, count(DISTINCT sid) AS sessions, min(sql_text) AS sql_text,
  round(count(*) / count(DISTINCT sid), 2) AS cursors_per_session
FROM fx_open_cursor GROUP BY 1, 2 HAVING count(*) / count(DISTINCT sid) > 1""")
def r59(spark, sf):
    return apply_rule("R59", _t(spark, sf, open_cursor="fx_open_cursor"))


@query("r60_open_cursors_per_session", """
WITH cu AS (SELECT inst_id, sid, sql_id, count(*) AS open_cursors, count(DISTINCT sql_id) AS statements, min(sql_text) AS sql_text
  FROM fx_open_cursor GROUP BY 1, 2, 3 HAVING count(*) > count(DISTINCT sql_id)),
sq AS (SELECT inst_id, sql_id, count(*) AS children, min(parsing_schema_name) AS parsing_schema_name FROM fx_cursor GROUP BY 1, 2)
SELECT cu.*, s.username, s.module, sq.children, sq.parsing_schema_name FROM cu JOIN fx_session s ON s.inst_id = cu.inst_id AND s.sid = cu.sid
JOIN sq ON sq.inst_id = cu.inst_id AND sq.sql_id = cu.sql_id WHERE sq.parsing_schema_name <> 'SYS'""")
def r60(spark, sf):
    return apply_rule("R60", _t(spark, sf, open_cursor="fx_open_cursor", sessions="fx_session", cursors="fx_cursor"))


@query("r62_child_cursor_reasons", """
SELECT inst_id, sql_id, count(*) AS child_count,
  CAST(sum(CASE WHEN bind_mismatch = 'Y' THEN 1 ELSE 0 END) AS BIGINT) AS bind_mismatch,
  CAST(sum(CASE WHEN optimizer_mismatch = 'Y' THEN 1 ELSE 0 END) AS BIGINT) AS optimizer_mismatch,
  CAST(sum(CASE WHEN auth_check_mismatch = 'Y' THEN 1 ELSE 0 END) AS BIGINT) AS auth_check_mismatch
FROM fx_shared_cursor GROUP BY 1, 2 HAVING count(*) > 500""")
def r62(spark, sf):
    return apply_rule("R62", _t(spark, sf, shared_cursor="fx_shared_cursor"), min_children=500)


@query("r65_commit_rollback_per_hour", """
WITH ss AS (SELECT dbid, instance_number, min(snap_id) AS min_snap, max(snap_id) AS max_snap FROM fx_snapshot
            WHERE begin_interval_time > (SELECT max(begin_interval_time) FROM fx_snapshot) - INTERVAL 400 DAY AND instance_number = 1 GROUP BY 1, 2),
d AS (SELECT snap.begin_interval_time, st.instance_number, n.stat_name,
        st.value - lag(st.value, 1, st.value) OVER (PARTITION BY st.instance_number, st.stat_id ORDER BY st.snap_id) AS value
      FROM ss JOIN fx_sysstat st ON st.dbid = ss.dbid AND st.instance_number = ss.instance_number
      JOIN fx_stat_name n ON n.stat_id = st.stat_id
      JOIN fx_snapshot snap ON snap.dbid = st.dbid AND snap.instance_number = st.instance_number AND snap.snap_id = st.snap_id
      WHERE st.snap_id BETWEEN ss.min_snap - 1 AND ss.max_snap
        AND n.stat_name IN ('user commits', 'user rollbacks', 'rollback changes - undo records applied')),
p AS (SELECT CAST(date_trunc('hour', begin_interval_time) AS TIMESTAMP) AS begin, instance_number,
        CAST(sum(CASE WHEN stat_name = 'user commits' THEN value ELSE 0 END) AS BIGINT) AS user_commits,
        CAST(sum(CASE WHEN stat_name = 'user rollbacks' THEN value ELSE 0 END) AS BIGINT) AS user_rollbacks,
        CAST(sum(CASE WHEN stat_name = 'rollback changes - undo records applied' THEN value ELSE 0 END) AS BIGINT) AS rollback_changes
      FROM d WHERE value > 0 GROUP BY 1, 2)
SELECT *, round(user_rollbacks / CASE WHEN user_commits + user_rollbacks = 0 THEN 1 ELSE user_commits + user_rollbacks END * 100) AS percent_rollback FROM p""")
def r65(spark, sf):
    return apply_rule("R65", _t(spark, sf, sysstat="fx_sysstat", stat_name="fx_stat_name", snapshot="fx_snapshot"))


@query("r67_module_runtime_outliers", """
WITH per AS (SELECT date_trunc('hour', sample_time) AS period, module, min(sample_time) AS first_occurrence,
   max(sample_time) AS last_occurrence, count(*) * 10 AS secs FROM fx_ash WHERE instance_number = 1 GROUP BY 1, 2),
w AS (SELECT *, min(secs) OVER (PARTITION BY module) AS mn, max(secs) OVER (PARTITION BY module) AS mx FROM per)
SELECT module, CAST(sum(secs) AS BIGINT) AS value_total, round(avg(secs), 0) AS value_avg, min(secs) AS value_min,
  min(CASE WHEN secs = mn THEN period END) AS period_of_min, max(secs) AS value_max,
  max(CASE WHEN secs = mx THEN period END) AS period_of_max, round(max(secs) - avg(secs), 4) AS max_minus_avg,
  min(first_occurrence) AS first_occurrence, max(last_occurrence) AS last_occurrence
FROM w GROUP BY 1""")
def r67(spark, sf):
    return apply_rule("R67", _t(spark, sf, ash="fx_ash"))


def _r69_sql():
    vals = ", ".join("('{}', '{}', '{}', {})".format(n, s, f, "NULL" if m is None else f"'{m}'") for n, s, f, m in AUDIT_OPTIONS)
    return f"""WITH a AS (SELECT * FROM (VALUES {vals}) AS v(name, success, failure, message))
SELECT '"AUDIT ' || coalesce(a.message, a.name) || '" suggested!' AS problem FROM a WHERE NOT EXISTS (
  SELECT 1 FROM fx_audit_opts d WHERE d.audit_option = a.name AND (d.success = a.success OR a.success = 'NOT SET')
    AND (d.failure = a.failure OR a.failure = 'NOT SET'))"""


@query("r69_missing_audit_options", _r69_sql())
def r69(spark, sf):
    return apply_rule("R69", _t(spark, sf, audit_opts="fx_audit_opts"))


def _long_tx_sql(src):
    return f"""
WITH i0 AS (SELECT *, min(sample_time) OVER (PARTITION BY xid, event) AS mn, max(sample_time) OVER (PARTITION BY xid, event) AS mx
            FROM {src} WHERE xid IS NOT NULL),
i AS (SELECT xid, event, min(sample_time) AS min_t, max(sample_time) AS max_t, count(*) AS samples,
        min(CASE WHEN sample_time = mn THEN sql_id END) AS min_sql, max(CASE WHEN sample_time = mx THEN sql_id END) AS max_sql,
        min(instance_number) AS inst, min(session_id) AS sid, min(module) AS module FROM i0 GROUP BY 1, 2),
w AS (SELECT *, min(min_t) OVER (PARTITION BY xid) AS f, max(max_t) OVER (PARTITION BY xid) AS l,
        max(samples) OVER (PARTITION BY xid) AS ms FROM i),
g AS (SELECT xid, min(min_t) AS tx_start, max(max_t) AS tx_end, CAST(sum(samples) AS BIGINT) AS samples,
        min(CASE WHEN min_t = f THEN min_sql END) AS first_sql_id, max(CASE WHEN max_t = l THEN max_sql END) AS last_sql_id,
        min(inst) AS instance, min(CAST(sid AS VARCHAR)) AS sid, min(module) AS module, max(CASE WHEN samples = ms THEN event END) AS main_event
      FROM w GROUP BY 1)
SELECT *, round((epoch_us(tx_end) - epoch_us(tx_start)) / 1000000.0) AS duration_secs FROM g
WHERE round((epoch_us(tx_end) - epoch_us(tx_start)) / 1000000.0) > 60"""


@query("r70_long_transactions_cur", _long_tx_sql("fx_ash_live"))
def r70(spark, sf):
    return apply_rule("R70", _t(spark, sf, ash="fx_ash_live"))


@query("r71_long_transactions_hist", _long_tx_sql("fx_ash"))
def r71(spark, sf):
    return apply_rule("R71", _t(spark, sf, ash_hist="fx_ash"))


@query("r73_nvl_expensive_argument", """
WITH chars AS (
  SELECT sql_id, upper(sql_text) AS u, i, substr(upper(sql_text), i, 1) AS ch
  FROM fx_nvl_sql, generate_series(1, length(sql_text)) g(i)),
calls AS (SELECT sql_id, u, i AS name_pos, row_number() OVER (PARTITION BY sql_id ORDER BY i) AS call_no FROM chars WHERE substr(u, i, 3) = 'NVL'),
scan AS (
  SELECT c.sql_id, c.u, c.call_no, c.name_pos, x.i - c.name_pos - 2 AS lvl, x.ch,
    sum(CASE WHEN x.ch = '(' THEN 1 WHEN x.ch = ')' THEN -1 ELSE 0 END) OVER (PARTITION BY c.sql_id, c.call_no ORDER BY x.i) AS d
  FROM calls c JOIN chars x ON x.sql_id = c.sql_id AND x.i >= c.name_pos + 3 AND x.ch IN ('(', ')', ',')),
marks AS (
  SELECT *, min(CASE WHEN d = 1 AND ch = ',' THEN lvl END) OVER (PARTITION BY sql_id, call_no) AS komma,
            min(CASE WHEN lvl > 3 AND d = 0 THEN lvl END) OVER (PARTITION BY sql_id, call_no) AS ende FROM scan)
SELECT sql_id, call_no, CAST(lvl AS BIGINT) AS open_bracket_position, substr(u, name_pos + 3, ende) AS call_parameter
FROM marks WHERE ch = '(' AND lvl BETWEEN komma AND ende""")
def r73(spark, sf):
    return apply_rule("R73", _t(spark, sf, nvl_texts="fx_nvl_sql"))


@query("r34_long_serial_statements_cur", """
WITH serial AS (SELECT sql_id FROM fx_stmt_plan GROUP BY 1 HAVING sum(CASE WHEN coalesce(other_tag LIKE 'PARALLEL%', false) THEN 1 ELSE 0 END) = 0)
SELECT a.*, round(elapsed_time / CASE WHEN executions = 0 THEN 1 ELSE executions END / 1e6, 2) AS elapsed_per_exec_secs
FROM fx_sqlarea a JOIN serial s ON s.sql_id = a.sql_id WHERE elapsed_time / CASE WHEN executions = 0 THEN 1 ELSE executions END > 0.001 * 1e6""")
def r34(spark, sf):
    return apply_rule("R34", _t(spark, sf, sql_plan="fx_stmt_plan", sqlarea="fx_sqlarea"), min_secs_per_exec=0.001)


@query("r35_long_serial_statements_hist", f"""
WITH {recent()},
px AS (SELECT sql_id, plan_hash_value FROM fx_stmt_plan GROUP BY 1, 2 HAVING sum(CASE WHEN coalesce(other_tag LIKE 'PARALLEL%', false) THEN 1 ELSE 0 END) = 0),
s AS (SELECT r.dbid, r.instance_number, r.sql_id, CAST(sum(executions_delta) AS BIGINT) AS executions, CAST(sum(elapsed_time_delta) AS BIGINT) AS elapsed_time,
        CAST(min(ss.begin_interval_time) AS TIMESTAMP) AS first_occurrence, CAST(max(ss.begin_interval_time) AS TIMESTAMP) AS last_occurrence
      FROM recent r JOIN px ON px.sql_id = r.sql_id AND px.plan_hash_value = r.plan_hash_value
      JOIN fx_snapshot ss ON ss.dbid = r.dbid AND ss.instance_number = r.instance_number AND ss.snap_id = r.snap_id GROUP BY 1, 2, 3)
SELECT s.*, round(elapsed_time / CASE WHEN executions = 0 THEN 1 ELSE executions END / 1e6, 2) AS elapsed_per_exec_secs
FROM s WHERE elapsed_time / CASE WHEN executions = 0 THEN 1 ELSE executions END > 0.001 * 1e6""")
def r35(spark, sf):
    return apply_rule("R35", _t(spark, sf, sql_plan="fx_stmt_plan", sqlstat="fx_sqlstat", snapshot="fx_snapshot"),
                      days=400, min_secs_per_exec=0.001)


@query("r36_parallel_with_serial_parts", """
WITH pp AS (SELECT DISTINCT sql_id FROM fx_sql_plan WHERE coalesce(other_tag LIKE 'PARALLEL%', false)),
ps AS (SELECT * FROM fx_sql_plan WHERE NOT coalesce(other_tag LIKE 'PARALLEL%', false)
       AND operation NOT IN ('PX COORDINATOR', 'SORT', 'VIEW', 'MERGE JOIN') AND operation NOT LIKE 'UPDATE%' AND operation NOT LIKE 'SELECT%')
SELECT ps.*, o.num_rows, a.executions, round(a.elapsed_time / 1e6, 6) AS elapsed_secs
FROM ps JOIN fx_sqlarea a ON a.sql_id = ps.sql_id
LEFT JOIN fx_plan_object o ON o.owner = ps.object_owner AND o.object_name = ps.object_name
WHERE ps.sql_id IN (SELECT sql_id FROM pp)""")
def r36(spark, sf):
    return apply_rule("R36", _t(spark, sf, sql_plan="fx_sql_plan", sqlarea="fx_sqlarea", objects="fx_plan_object"))


@query("r39_parallel_from_serial_subtree", f"""
WITH {recent()},
pf AS (SELECT sql_id, max(plan_hash_value) AS plan_hash_value FROM fx_stmt_plan WHERE other_tag = 'PARALLEL_FROM_SERIAL' GROUP BY 1),
pfs AS (SELECT pf.sql_id, pf.plan_hash_value, max(p.id) AS pfs_id FROM pf JOIN fx_stmt_plan p ON p.sql_id = pf.sql_id AND p.plan_hash_value = pf.plan_hash_value
        AND p.other_tag = 'PARALLEL_FROM_SERIAL' GROUP BY 1, 2),
j AS (SELECT pfs.sql_id, pfs.plan_hash_value,
        CASE WHEN coalesce(c1.options LIKE '%FULL%', false) THEN c1.operation ELSE c2.operation END AS operation,
        CASE WHEN coalesce(c1.options LIKE '%FULL%', false) THEN c1.object_owner ELSE c2.object_owner END AS object_owner,
        CASE WHEN coalesce(c1.options LIKE '%FULL%', false) THEN c1.object_name ELSE c2.object_name END AS object_name
      FROM pfs LEFT JOIN fx_stmt_plan c1 ON c1.sql_id = pfs.sql_id AND c1.plan_hash_value = pfs.plan_hash_value AND c1.parent_id = pfs.pfs_id
      LEFT JOIN fx_stmt_plan c2 ON c2.sql_id = c1.sql_id AND c2.plan_hash_value = c1.plan_hash_value AND c2.parent_id = c1.id
      WHERE coalesce(c1.options LIKE '%FULL%', false) OR coalesce(c2.options LIKE '%FULL%', false)),
g AS (SELECT sql_id, plan_hash_value, min(operation) AS operation, min(object_owner) AS object_owner, min(object_name) AS object_name FROM j GROUP BY 1, 2),
s AS (SELECT sql_id, plan_hash_value, round(sum(elapsed_time_delta) / 1e6, 6) AS elapsed_secs, CAST(sum(executions_delta) AS BIGINT) AS executions FROM recent GROUP BY 1, 2)
SELECT g.*, s.elapsed_secs, s.executions FROM g JOIN s ON s.sql_id = g.sql_id AND s.plan_hash_value = g.plan_hash_value""")
def r39(spark, sf):
    return apply_rule("R39", _t(spark, sf, sql_plan="fx_stmt_plan", sqlstat="fx_sqlstat", snapshot="fx_snapshot"), days=400)


@query("r43_implicit_conversion", """
SELECT p.sql_id, p.plan_hash_value, p.id, p.filter_predicates, a.executions, a.rows_processed, round(a.elapsed_time / 1e6, 6) AS elapsed_secs
FROM fx_sql_plan p JOIN fx_sqlarea a ON a.sql_id = p.sql_id WHERE p.filter_predicates LIKE '%INTERNAL_FUNCTION%'""")
def r43(spark, sf):
    return apply_rule("R43", _t(spark, sf, sql_plan="fx_sql_plan", sqlarea="fx_sqlarea"))


@query("r44_is_null_full_scans", """
SELECT p.sql_id, p.plan_hash_value, p.id, p.operation, p.options, p.object_owner, p.object_name, p.filter_predicates,
  min(h.sample_time) AS first_occurrence, max(h.sample_time) AS last_occurrence, count(*) AS wait_time_secs
FROM fx_sql_plan p JOIN fx_ash_plan h ON h.sql_id = p.sql_id AND h.sql_plan_hash_value = p.plan_hash_value AND h.sql_plan_line_id = p.id
WHERE upper(p.filter_predicates) LIKE '%IS NULL%' AND p.options LIKE '%FULL' GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""")
def r44(spark, sf):
    return apply_rule("R44", _t(spark, sf, sql_plan="fx_sql_plan", ash="fx_ash_plan"))


@query("r48_suboptimal_index_access", """
WITH p AS (SELECT sql_id, plan_hash_value, count(*) AS plan_lines,
    sum(CASE WHEN operation = 'INDEX' AND options IN ('RANGE SCAN', 'UNIQUE SCAN') THEN 1 ELSE 0 END) AS i,
    sum(CASE WHEN filter_predicates IS NOT NULL THEN 1 ELSE 0 END) AS f,
    sum(CASE WHEN id = 1 AND options IN ('GROUP BY', 'AGGREGATE') THEN 1 ELSE 0 END) AS g
  FROM fx_stmt_plan WHERE operation <> 'PARTITION HASH' AND options <> 'STOPKEY' GROUP BY 1, 2)
SELECT p.sql_id, p.plan_hash_value, p.plan_lines, a.executions, a.buffer_gets, a.rows_processed, round(a.buffer_gets / a.rows_processed) AS gets_per_row,
  a.sql_text, round(a.rows_processed / a.executions, 2) AS rows_per_exec
FROM p JOIN fx_sqlarea_plan a ON a.sql_id = p.sql_id AND a.plan_hash_value = p.plan_hash_value
WHERE i = 1 AND f = 0 AND g = 0 AND plan_lines < 5 AND a.rows_processed > 0 AND a.executions > 100 AND a.rows_processed > a.executions / 2
  AND length(a.sql_text) - length(replace(a.sql_text, ':', '')) < 5 AND round(a.buffer_gets / a.rows_processed) > 5""")
def r48(spark, sf):
    return apply_rule("R48", _t(spark, sf, sql_plan="fx_stmt_plan", sqlarea="fx_sqlarea_plan"))


@query("r63_write_statements_cur", """
SELECT *, round(rows_processed / executions, 2) AS rows_per_exec FROM fx_sqlarea_plan
WHERE command_type IN (2, 6, 7) AND executions > 0 AND rows_processed > 2000""")
def r63(spark, sf):
    return apply_rule("R63", _t(spark, sf, sqlarea="fx_sqlarea_plan"), min_rows=2000)


@query("r64_write_statements_hist", f"""
WITH {recent()},
g AS (SELECT dbid, instance_number, sql_id, CAST(sum(executions_delta) AS BIGINT) AS executions, CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed
      FROM recent WHERE sql_id IN (SELECT sql_id FROM fx_sqltext WHERE command_type IN (2, 6, 7)) GROUP BY 1, 2, 3)
SELECT *, round(rows_processed / executions, 2) AS rows_per_exec FROM g WHERE executions > 0 AND rows_processed > 50""")
def r64(spark, sf):
    return apply_rule("R64", _t(spark, sf, sqlstat="fx_sqlstat", snapshot="fx_snapshot", sqltext="fx_sqltext"), days=400, min_rows=50)


@query("r37_parallel_with_serial_parts_hist", f"""
WITH {recent()},
plans AS (SELECT sql_id, plan_hash_value FROM fx_sql_plan GROUP BY 1, 2
  HAVING sum(CASE WHEN coalesce(other_tag LIKE 'PARALLEL%', false) THEN 1 ELSE 0 END) > 0
     AND sum(CASE WHEN NOT coalesce(other_tag LIKE 'PARALLEL%', false) AND operation NOT IN ('PX COORDINATOR', 'SORT', 'VIEW', 'MERGE JOIN')
                   AND operation NOT LIKE 'UPDATE%' AND operation NOT LIKE 'SELECT%' THEN 1 ELSE 0 END) > 1),
x AS (SELECT s.sql_id, s.plan_hash_value, min(parsing_schema_name) AS parsing_schema_name, round(sum(elapsed_time_delta) / 1e6, 2) AS elapsed_secs,
   CAST(sum(executions_delta) AS BIGINT) AS executions,
   round((sum(elapsed_time_delta) / 1e6) / CASE WHEN sum(executions_delta) = 0 THEN 1 ELSE sum(executions_delta) END, 2) AS elapsed_secs_per_exec
   FROM recent s JOIN plans p ON p.sql_id = s.sql_id AND p.plan_hash_value = s.plan_hash_value GROUP BY 1, 2)
SELECT x.*, ps.operation, ps.options, ps.object_owner, ps.object_name, o.num_rows FROM x
JOIN fx_sql_plan ps ON ps.sql_id = x.sql_id AND ps.plan_hash_value = x.plan_hash_value AND NOT coalesce(ps.other_tag LIKE 'PARALLEL%', false)
  AND ps.operation NOT IN ('PX COORDINATOR', 'SORT', 'VIEW', 'MERGE JOIN') AND ps.operation NOT LIKE 'UPDATE%' AND ps.operation NOT LIKE 'SELECT%'
  AND ps.object_name IS NOT NULL
LEFT JOIN fx_plan_object o ON o.owner = ps.object_owner AND o.object_name = ps.object_name""")
def r37(spark, sf):
    return apply_rule("R37", _t(spark, sf, sql_plan="fx_sql_plan", sqlstat="fx_sqlstat", snapshot="fx_snapshot",
                                objects="fx_plan_object"), days=400)


# cartesian joins: in this binding lines tagged PARALLEL_FROM_SERIAL stand for cartesian joins, and lines
# without options (join/sort steps) carry no object
CART_PLAN_SQL = """cp AS (SELECT sql_id, plan_hash_value, id, parent_id, operation,
    CASE WHEN other_tag = 'PARALLEL_FROM_SERIAL' THEN 'CARTESIAN' ELSE options END AS options, object_owner,
    CASE WHEN options IS NULL OR other_tag = 'PARALLEL_FROM_SERIAL' THEN NULL ELSE object_name END AS object_name FROM fx_sql_plan),
walk AS (
  SELECT sql_id, plan_hash_value, id, parent_id, operation, options, object_owner, object_name, 1 AS lvl, [id] AS path FROM cp WHERE options = 'CARTESIAN'
  UNION ALL
  SELECT c.sql_id, c.plan_hash_value, c.id, c.parent_id, c.operation, c.options, c.object_owner, c.object_name, w.lvl + 1, list_append(w.path, c.id)
  FROM walk w JOIN cp c ON c.sql_id = w.sql_id AND c.plan_hash_value = w.plan_hash_value AND c.parent_id = w.id
  WHERE w.object_name IS NULL AND NOT list_contains(w.path, c.id))"""


def _cart_plan(spark, sf):
    p = _fx(spark, sf, "fx_sql_plan")
    pfs = F.col("other_tag") == "PARALLEL_FROM_SERIAL"
    return p.withColumn("object_name", F.when(F.col("options").isNull() | pfs, F.lit(None)).otherwise(F.col("object_name"))) \
            .withColumn("options", F.when(pfs, F.lit("CARTESIAN")).otherwise(F.col("options")))


@query("r45_cartesian_joins_cur", f"""
WITH RECURSIVE {CART_PLAN_SQL}
SELECT w.sql_id, w.plan_hash_value, w.operation, w.options, w.object_owner, w.object_name, o.num_rows, a.executions,
  round(a.elapsed_time / 1e6, 6) AS elapsed_secs, w.id AS line_id, w.parent_id, w.lvl AS level
FROM walk w JOIN fx_sqlarea a ON a.sql_id = w.sql_id
LEFT JOIN fx_plan_object o ON o.owner = w.object_owner AND o.object_name = w.object_name
WHERE w.object_name IS NOT NULL AND round(a.elapsed_time / 1e6, 6) > 100""")
def r45(spark, sf):
    return apply_rule("R45", {"sql_plan": _cart_plan(spark, sf), "sqlarea": _fx(spark, sf, "fx_sqlarea"),
                              "objects": _fx(spark, sf, "fx_plan_object")})


@query("r46_cartesian_joins_hist", f"""
WITH RECURSIVE {CART_PLAN_SQL}, {recent()}
SELECT s.instance_number, w.sql_id, w.plan_hash_value, w.operation, w.options, w.object_owner, w.object_name, w.id AS line_id, w.parent_id,
  CAST(sum(s.executions_delta) AS BIGINT) AS executions, round(sum(s.elapsed_time_delta) / 1e6, 6) AS elapsed_secs
FROM walk w JOIN recent s ON s.sql_id = w.sql_id AND s.plan_hash_value = w.plan_hash_value
WHERE w.object_name IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9 HAVING round(sum(s.elapsed_time_delta) / 1e6, 6) > 100""")
def r46(spark, sf):
    return apply_rule("R46", {"sql_plan": _cart_plan(spark, sf), "sqlstat": _fx(spark, sf, "fx_sqlstat"),
                              "snapshot": _fx(spark, sf, "fx_snapshot")}, days=400)


@query("a58_rule_with_row_filter", f"""
WITH {recent(src='fx_sqlstat_ext')},
g AS (SELECT sql_id, instance_number, parsing_schema_name, CAST(sum(executions_delta) AS BIGINT) AS executions,
   CAST(sum(parse_calls_delta) AS BIGINT) AS parses FROM recent GROUP BY 1, 2, 3)
SELECT *, round(executions / CASE WHEN parses = 0 THEN 1 ELSE parses END, 2) AS execs_per_parse FROM g WHERE instance_number = 2""")
def a58(spark, sf):
    return apply_rule("R56", _t(spark, sf, sqlstat="fx_sqlstat_ext", snapshot="fx_snapshot"), F.col("instance_number") == 2, days=400)
