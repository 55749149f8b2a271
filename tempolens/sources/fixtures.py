"""Fixture bindings: monitoring-shaped views over the driver's test tables.

Each view is one SELECT that runs unchanged in Spark SQL and in DuckDB, so
the Spark operators and the SQL oracle read identical inputs.  The first
group is the binding table documented in FIXTURES.md; the second group adds
shapes that reports need (several counters per series, a statement-text
table, a catalog of indexes and columns), derived the same way.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import register_tables

# Fixed binding definitions (FIXTURES.md section 2), in dependency order.
FIXTURE_SQL: dict[str, str] = {
    "fx_snapshot": "SELECT DISTINCT 1 AS dbid, CAST(o_custkey % 2 + 1 AS INT) AS instance_number, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS snap_id, date_trunc('month', o_orderdate) AS begin_interval_time, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS end_interval_time FROM orders",
    "fx_sqlstat": "SELECT 1 AS dbid, CAST(l_suppkey % 2 + 1 AS INT) AS instance_number, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS snap_id, concat('s', l_partkey % 50) AS sql_id, l_linenumber AS plan_hash_value, l_returnflag AS parsing_schema_name, l_linestatus AS module, CAST(floor(l_quantity) AS BIGINT) AS executions_delta, CAST(floor(l_extendedprice * 100) AS BIGINT) AS elapsed_time_delta, CAST(floor(l_extendedprice) AS BIGINT) AS buffer_gets_delta, CAST(round(l_discount * 100) AS BIGINT) AS disk_reads_delta, CAST(round(l_tax * 100) AS BIGINT) AS rows_processed_delta FROM lineitem",
    "fx_ash": "SELECT event_id, ts AS sample_time, CAST((month(ts) - 1) * 31 + day(ts) AS INT) AS sample_id, CAST(user_id % 2 + 1 AS INT) AS instance_number, user_id % 20 AS session_id, event_type AS event, CASE WHEN event_type = 'view' THEN NULL WHEN event_type IN ('error', 'signup') THEN 'Application' ELSE 'User I/O' END AS wait_class, CAST(round(value * 1000) AS BIGINT) AS time_waited, concat('s', user_id % 7) AS sql_id, concat('m', event_id % 5) AS module, CASE WHEN event_type <> 'view' THEN concat('t', user_id % 20, '-', day(ts)) END AS xid, CASE WHEN event_type = 'error' AND user_id % 20 = 0 AND day(ts) % 3 = 0 THEN 19 WHEN event_type = 'error' AND user_id % 20 <> 0 THEN CAST(floor((user_id % 20) / 2) AS BIGINT) END AS blocking_session FROM events",
    "fx_ash_live": "SELECT * FROM fx_ash WHERE sample_time >= TIMESTAMP '2024-01-26 00:00:00' AND instance_number = 1",
    "fx_counter": "SELECT user_id AS series_id, CAST(user_id % 2 + 1 AS INT) AS instance_number, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS snap_id, ts AS snap_time, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, floor((day(ts) - 1) / 10) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS counter_value FROM events",
    "fx_wait_edge": "SELECT DISTINCT sample_id, session_id, blocking_session, CAST(1 AS BIGINT) AS seconds_in_wait FROM fx_ash WHERE blocking_session IS NOT NULL",
    "fx_plan": "SELECT CAST(1 AS INT) AS plan_hash_value, p_partkey AS id, CASE WHEN p_partkey > 0 THEN CAST(floor((p_partkey - 1) / 3) AS BIGINT) END AS parent_id, p_type AS operation, p_brand AS object_owner, p_name AS object_name FROM part",
    "fx_object": "SELECT p_partkey AS object_id, p_brand AS owner, p_name AS object_name, CASE WHEN p_size % 3 = 0 THEN 'INDEX' ELSE 'TABLE' END AS object_type, CAST(floor(p_retailprice) AS BIGINT) AS num_rows, CAST(p_size AS BIGINT) * 1048576 AS bytes FROM part",
    "fx_seg_size": "SELECT date_trunc('month', o_orderdate) AS gather_date, o_orderpriority AS owner, concat('seg', o_custkey % 9) AS segment_name, o_orderstatus AS segment_type, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS size_units FROM orders GROUP BY 1, 2, 3, 4",
    "fx_audit": "SELECT ts AS audit_time, concat('host', user_id % 6) AS userhost, concat('os', user_id % 4) AS os_username, concat('u', user_id) AS username, event_type AS action_name FROM events",
    "fx_message": "SELECT o_orderkey AS id, o_custkey % 8 AS id_messagetype, o_orderdate AS creation_time, CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS erroneous, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 3 END AS id_bulkgroup, CAST(substr(o_orderpriority, 1, 1) AS INT) AS run_count FROM orders",
    "fx_aspect": "SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS minute, l_suppkey % 8 AS sub_key, CASE l_linenumber WHEN 1 THEN 4532 WHEN 2 THEN 6216 WHEN 3 THEN 6217 WHEN 4 THEN 6218 WHEN 5 THEN CASE l_suppkey % 3 WHEN 0 THEN 6281 WHEN 1 THEN 6279 ELSE 6280 END WHEN 6 THEN CASE l_suppkey % 4 WHEN 0 THEN 6282 WHEN 1 THEN 6283 WHEN 2 THEN 6284 ELSE 7862 END ELSE CASE l_suppkey % 4 WHEN 0 THEN 7251 WHEN 1 THEN 7402 WHEN 2 THEN 7403 ELSE 4160 END END AS code, CAST(floor(l_quantity) AS BIGINT) AS counter FROM lineitem",
    "fx_constraint": "SELECT * FROM (VALUES ('nation','region'),('customer','nation'),('supplier','nation'),('orders','customer'),('lineitem','orders'),('lineitem','part'),('lineitem','supplier')) AS t(child_table, parent_table)",
    "fx_usage_log": "SELECT concat('10.0.0.', user_id % 30, ' db', user_id % 3, ' ', year(ts), '/', month(ts), ' ', event_type, ' a', event_id % 11, ' ', event_id) AS line FROM events",
}

# Additional bindings of this library (same both-engine rule).
FIXTURE_SQL.update({
    # several cumulative counters per series (latch / file IO / event shape):
    # three counters derived from the same running sums, one of them resets.
    "fx_counter_multi": "SELECT series_id, instance_number, snap_id, snap_time, concat('n', series_id % 13) AS counter_name, counter_value AS gets, CAST(floor(counter_value / 7) AS BIGINT) AS misses, CAST(snap_id * 3 AS BIGINT) AS waits FROM fx_counter",
    # cumulative wait-event counters per (instance, event, snapshot), restart every 24 snapshots
    "fx_sysevent": "SELECT 1 AS dbid, instance_number, snap_id, event_id, CAST(sum(waits) OVER (PARTITION BY instance_number, event_id, floor(snap_id / 24) ORDER BY snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_waits, CAST(sum(timeouts) OVER (PARTITION BY instance_number, event_id, floor(snap_id / 24) ORDER BY snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_timeouts, CAST(sum(wait_micro) OVER (PARTITION BY instance_number, event_id, floor(snap_id / 24) ORDER BY snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS time_waited_micro FROM (SELECT CAST(l_suppkey % 2 + 1 AS INT) AS instance_number, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS snap_id, l_linenumber AS event_id, CAST(count(*) AS BIGINT) AS waits, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS timeouts, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS wait_micro FROM lineitem GROUP BY 1, 2, 3) t",
    "fx_event_name": "SELECT * FROM (VALUES (1, 'db file sequential read', 'User I/O'), (2, 'log file sync', 'Commit'), (3, 'SQL*Net message from client', 'Idle'), (4, 'latch free', 'Other'), (5, 'enq: TX - row lock contention', 'Application'), (6, 'resmgr:cpu quantum', 'Scheduler'), (7, 'direct path read', 'User I/O')) AS t(event_id, event_name, wait_class)",
    # cumulative system statistics per (instance, stat, snapshot), restart every 24 snapshots
    "fx_sysstat": "SELECT 1 AS dbid, instance_number, snap_id, stat_id, CAST(sum(v) OVER (PARTITION BY instance_number, stat_id, floor(snap_id / 24) ORDER BY snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS value FROM (SELECT CAST(o_custkey % 2 + 1 AS INT) AS instance_number, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS snap_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS stat_id, CAST(sum(round(o_totalprice)) AS BIGINT) AS v FROM orders GROUP BY 1, 2, 3) t",
    "fx_stat_name": "SELECT * FROM (VALUES (1, 'user commits', 1), (2, 'user rollbacks', 1), (3, 'physical reads', 8), (4, 'redo size', 2), (5, 'parse count (total)', 64)) AS t(stat_id, stat_name, class)",
    # several plan variants: ternary trees numbered per plan, coarse line attributes
    "fx_plan_multi": "SELECT plan_hash_value, id, CASE WHEN id > 1 THEN CAST(floor((id - 2) / 3) + 1 AS BIGINT) END AS parent_id, operation, object_owner, object_name, options, other_tag, filter_predicates FROM (SELECT CAST(p_size % 4 AS INT) AS plan_hash_value, CAST(row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) AS BIGINT) AS id, split_part(p_type, ' ', 1) AS operation, substr(p_brand, 1, 7) AS object_owner, CASE WHEN p_partkey % 10 = 0 THEN concat(':TQ', CAST(p_partkey AS STRING)) ELSE split_part(p_name, ' ', 1) END AS object_name, CASE WHEN p_partkey % 6 = 0 THEN 'FULL' WHEN p_partkey % 6 = 1 THEN 'RANGE SCAN' WHEN p_partkey % 6 = 2 THEN 'UNIQUE SCAN' END AS options, CASE WHEN p_partkey % 7 = 0 THEN 'PARALLEL_FROM_SERIAL' WHEN p_partkey % 7 = 1 THEN 'PARALLEL_COMBINED_WITH_PARENT' END AS other_tag, CASE WHEN p_partkey % 5 = 0 THEN concat('INTERNAL_FUNCTION(\"', split_part(p_name, ' ', 1), '\")=:1') WHEN p_partkey % 5 = 1 THEN concat('\"', upper(split_part(p_name, ' ', 2)), '\" IS NULL') END AS filter_predicates FROM part) t",
    # extents (file, first block, length) and block accesses for the point-in-interval lookup
    "fx_extent": "SELECT CAST(p_size % 5 AS INT) AS file_id, p_partkey * 8 AS block_id, CAST(8 AS BIGINT) AS blocks, p_partkey AS object_id FROM part",
    "fx_block_access": "SELECT CAST(l_suppkey % 5 AS INT) AS file_id, l_partkey * 8 + l_linenumber AS block_no, l_orderkey AS sample_id FROM lineitem",
    # UPDATE statements per table and indexed columns per table
    "fx_dml": "SELECT concat('u', CAST(p_partkey AS STRING)) AS sql_id, lower(p_type) AS table_name, concat('UPDATE ', lower(p_type), ' SET ', CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END, ' = 1, qty = 2 WHERE id = ', CAST(p_partkey AS STRING)) AS sql_text FROM part",
    "fx_ind_column": "SELECT DISTINCT lower(p_type) AS table_name, split_part(p_name, ' ', 2) AS column_name FROM part",
    # statement texts with NVL calls, some with a call or a nested NVL as second argument
    "fx_nvl_sql": "SELECT p_partkey AS sql_id, concat('SELECT NVL(', split_part(p_name, ' ', 1), ', ', CASE p_size % 3 WHEN 0 THEN concat('SUBSTR(', split_part(p_name, ' ', 2), ', 1, 5)') WHEN 1 THEN '0' ELSE concat('NVL(b, GET_', p_type, '(c, d))') END, ') AS v FROM ', lower(p_type), ' WHERE x = ', CAST(p_size AS STRING)) AS sql_text FROM part",
    # segment names with LOB / LOB-index forms that embed an object id
    "fx_segment": "SELECT p_partkey AS segment_id, p_brand AS owner, CASE WHEN p_size % 7 = 0 THEN concat('SYS_LOB', lpad(CAST(p_partkey % 50 + 1 AS STRING), 10, '0'), 'C00004$$') WHEN p_size % 7 = 1 THEN concat('SYS_IL', lpad(CAST(p_partkey % 50 + 1 AS STRING), 10, '0'), 'C00004$$') ELSE p_name END AS object_name, CASE WHEN p_size % 7 = 2 THEN concat('P', CAST(p_size AS STRING)) END AS subobject_name FROM part",
    # cumulative file IO counters per (instance, file, snapshot), restart every 24 snapshots
    "fx_file_io": "SELECT 1 AS dbid, instance_number, snap_id, file_id, concat('/u01/f', CAST(file_id AS STRING), '.dbf') AS file_name, concat('TS', CAST(file_id % 3 AS STRING)) AS ts_name, CASE WHEN file_id >= 10 THEN 'TEMP' ELSE 'DATA' END AS file_type, function_name, CAST(sum(rds) OVER (PARTITION BY instance_number, file_id, function_name, floor(snap_id / 24) ORDER BY snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS phyrds, CAST(sum(wrts) OVER (PARTITION BY instance_number, file_id, function_name, floor(snap_id / 24) ORDER BY snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS phywrts, CAST(sum(rtim) OVER (PARTITION BY instance_number, file_id, function_name, floor(snap_id / 24) ORDER BY snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS readtim, CAST(sum(blks) OVER (PARTITION BY instance_number, file_id, function_name, floor(snap_id / 24) ORDER BY snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS phyblkrd FROM (SELECT CAST(l_suppkey % 2 + 1 AS INT) AS instance_number, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS snap_id, CAST(l_partkey % 12 AS INT) AS file_id, CASE l_returnflag WHEN 'A' THEN 'Buffer Cache Reads' WHEN 'N' THEN 'Direct Reads' ELSE 'LGWR' END AS function_name, CAST(count(*) AS BIGINT) AS rds, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS wrts, CAST(sum(floor(l_extendedprice / 100)) AS BIGINT) AS rtim, CAST(sum(floor(l_quantity)) AS BIGINT) AS blks FROM lineitem GROUP BY 1, 2, 3, 4) t",
    # current locks and sessions derived from the activity samples
    "fx_lock": "SELECT instance_number AS inst_id, session_id AS sid, event_id AS lock_addr, CASE WHEN event = 'error' THEN 'TX' WHEN event = 'purchase' THEN 'TM' ELSE 'AE' END AS lock_type, CAST(event_id % 50 + 1 AS BIGINT) AS id1, CAST(sample_id % 4 AS BIGINT) AS id2, CASE WHEN blocking_session IS NULL THEN 6 ELSE 0 END AS lmode, CASE WHEN blocking_session IS NULL THEN 0 ELSE 6 END AS request, CAST(floor(time_waited / 1000) AS BIGINT) AS ctime, blocking_session FROM fx_ash WHERE event <> 'view'",
    "fx_session": "SELECT instance_number AS inst_id, session_id AS sid, concat('user', CAST(session_id % 5 AS STRING)) AS username, min(module) AS module, min(sql_id) AS sql_id, 'USER' AS session_type FROM fx_ash GROUP BY 1, 2, 3",
    # plan lines per statement (statement -> its plan variants) and samples pointing at plan lines
    "fx_sql_plan": "SELECT s.sql_id, p.* FROM (SELECT DISTINCT sql_id, plan_hash_value FROM fx_sqlstat) s JOIN fx_plan_multi p ON p.plan_hash_value = s.plan_hash_value",
    "fx_ash_plan": "SELECT sample_time, instance_number, session_id, sql_id, CAST(event_id % 3 + 1 AS INT) AS sql_plan_hash_value, CAST(event_id % 500 + 1 AS BIGINT) AS sql_plan_line_id, event FROM fx_ash",
    # catalog derived from the data: one table per part, one index per (part, line number), columns, constraints
    "fx_cat_table": "SELECT p.p_brand AS owner, concat('T', CAST(p.p_partkey AS STRING)) AS table_name, CAST(floor(p.p_retailprice) * p.p_size * 10 AS BIGINT) AS num_rows, CAST(p.p_size * 8 AS BIGINT) AS blocks, CAST(length(p.p_name) * 3 AS BIGINT) AS avg_row_len, CASE WHEN p.p_partkey % 9 = 0 THEN 'IOT' END AS iot_type, CASE WHEN p.p_partkey % 5 = 0 THEN 'YES' ELSE 'NO' END AS partitioned, CASE WHEN p.p_partkey % 4 = 0 THEN 'ENABLED' ELSE 'DISABLED' END AS compression, l.last_analyzed, CASE WHEN p.p_partkey % 17 = 0 THEN 'YES' ELSE 'NO' END AS dropped FROM part p LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last_analyzed FROM lineitem GROUP BY 1) l ON l.l_partkey = p.p_partkey",
    "fx_cat_index": "SELECT p.p_brand AS owner, concat('I', CAST(x.l_partkey AS STRING), '_', CAST(x.l_linenumber AS STRING)) AS index_name, p.p_brand AS table_owner, concat('T', CAST(x.l_partkey AS STRING)) AS table_name, x.l_linenumber AS ln, CASE WHEN x.l_linenumber = 1 THEN 'UNIQUE' ELSE 'NONUNIQUE' END AS uniqueness, CAST(x.n * 100 AS BIGINT) AS num_rows, CAST(x.d AS BIGINT) AS distinct_keys, CAST(x.l_linenumber * 2 AS INT) AS pct_free, CASE WHEN x.l_linenumber % 3 = 0 THEN 'ENABLED' ELSE 'DISABLED' END AS compression, CAST(x.n AS BIGINT) AS leaf_blocks, CASE WHEN x.l_linenumber = 7 THEN 'YES' ELSE 'NO' END AS partitioned, 'NORMAL' AS index_type, x.last_analyzed FROM (SELECT l_partkey, l_linenumber, count(*) AS n, count(DISTINCT l_suppkey) AS d, max(l_shipdate) AS last_analyzed FROM lineitem GROUP BY 1, 2) x JOIN part p ON p.p_partkey = x.l_partkey",
    "fx_cat_ind_column": "SELECT owner AS index_owner, index_name, table_owner, table_name, concat('C', CAST(ln % 3 AS STRING)) AS column_name, 1 AS column_position FROM fx_cat_index UNION ALL SELECT owner, index_name, table_owner, table_name, 'C9', 2 FROM fx_cat_index WHERE uniqueness = 'NONUNIQUE'",
    "fx_cat_tab_column": "SELECT owner, table_name, 'C0' AS column_name, CAST(0 AS BIGINT) AS num_nulls, CAST(num_rows AS BIGINT) AS num_distinct, 'N' AS nullable FROM fx_cat_table UNION ALL SELECT owner, table_name, 'C1', CAST(num_rows AS BIGINT), CAST(0 AS BIGINT), 'Y' FROM fx_cat_table UNION ALL SELECT owner, table_name, 'C2', CAST(0 AS BIGINT), CAST(1 AS BIGINT), 'N' FROM fx_cat_table UNION ALL SELECT owner, table_name, 'C9', CAST(blocks AS BIGINT), CAST(blocks * 7 AS BIGINT), 'Y' FROM fx_cat_table",
    "fx_cat_constraint": "SELECT owner, concat('PK_', table_name) AS constraint_name, 'P' AS constraint_type, table_name, CAST(NULL AS STRING) AS r_owner, CAST(NULL AS STRING) AS r_constraint_name, concat('I', substr(table_name, 2), '_1') AS index_name FROM fx_cat_table UNION ALL SELECT DISTINCT p.p_brand, concat('FK_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey % 50 + 1 AS STRING)), 'R', concat('T', CAST(l_partkey AS STRING)), q.p_brand, concat('PK_T', CAST(l_suppkey % 50 + 1 AS STRING)), CAST(NULL AS STRING) FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN part q ON q.p_partkey = l_suppkey % 50 + 1",
    "fx_cat_cons_column": "SELECT owner, constraint_name, table_name, CASE WHEN constraint_type = 'P' THEN 'C0' ELSE 'C2' END AS column_name, 1 AS position FROM fx_cat_constraint UNION ALL SELECT k.owner, k.constraint_name, k.table_name, 'C9', 2 FROM fx_cat_constraint k JOIN fx_cat_table t ON t.owner = k.owner AND t.table_name = k.table_name WHERE k.constraint_type = 'P' AND (t.iot_type IS NOT NULL OR t.partitioned = 'YES')",
    # index usage monitoring flags and function-based index expressions of the catalog binding
    "fx_cat_index_usage": "SELECT owner, index_name, table_name, CASE WHEN ln % 2 = 0 THEN 65536 ELSE 0 END AS index_flags, CASE WHEN ln % 3 = 1 THEN 1 ELSE 0 END AS usage_flags FROM fx_cat_index",
    "fx_cat_ind_expression": "SELECT owner AS index_owner, index_name, table_name, CASE WHEN ln = 5 THEN concat('UPPER(\"C', CAST(ln AS STRING), '\")') WHEN ln = 6 THEN concat('NVL(\"C1\",', CAST(ln AS STRING), ')') ELSE concat('TRUNC(\"C2\",''DD'')') END AS column_expression FROM fx_cat_index WHERE index_type = 'NORMAL'",
    # partitions of the partitioned indexes; PGA counters per (instance, snapshot), drawn from the orders of a month
    "fx_cat_ind_partition": "SELECT i.owner AS index_owner, i.index_name, concat('P', CAST(x.l_linestatus AS STRING)) AS partition_name, CASE WHEN x.l_linestatus = 'O' THEN 5 ELSE 10 END AS pct_free, CAST(x.n * 1000 AS BIGINT) AS num_rows FROM fx_cat_index i JOIN (SELECT l_partkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) x ON concat('T', CAST(x.l_partkey AS STRING)) = i.table_name WHERE i.partitioned = 'YES'",
    "fx_pgastat": "SELECT 1 AS dbid, o.instance_number, o.snap_id, n.name, CASE WHEN n.k > 9 THEN o.orders + n.k * o.snap_id ELSE o.total * n.k END AS value FROM (SELECT CAST(o_custkey % 2 + 1 AS INT) AS instance_number, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS snap_id, CAST(count(*) AS BIGINT) AS orders, CAST(sum(round(o_totalprice)) AS BIGINT) AS total FROM orders GROUP BY 1, 2) o CROSS JOIN (SELECT * FROM (VALUES (1, 'aggregate PGA target parameter'), (2, 'aggregate PGA auto target'), (3, 'global memory bound'), (4, 'total PGA inuse'), (5, 'total PGA allocated'), (6, 'total freeable PGA memory'), (7, 'PGA memory freed back to OS'), (8, 'total PGA used for auto workareas'), (9, 'total PGA used for manual workareas'), (10, 'process count'), (11, 'max processes count'), (12, 'over allocation count'), (13, 'cache hit percentage')) AS t(k, name)) n",
    "fx_cursor": "SELECT instance_number AS inst_id, sql_id, plan_hash_value, min(CASE WHEN parsing_schema_name = 'R' THEN 'SYS' ELSE parsing_schema_name END) AS parsing_schema_name FROM fx_sqlstat GROUP BY 1, 2, 3",
    # partitioned indexes with their partitioning and key columns
    "fx_cat_part_index": "SELECT owner, index_name, CASE WHEN length(index_name) % 2 = 0 THEN 'HASH' ELSE 'RANGE' END AS partitioning_type, CAST(ln * 4 AS BIGINT) AS partition_count, 'LOCAL' AS locality, 'C0' AS part_column, 1 AS column_position FROM fx_cat_index WHERE partitioned = 'YES'",
    # segment statistics deltas per (object, instance, snapshot) and objects named like the plan lines
    "fx_seg_stat": "SELECT 1 AS dbid, CAST(l_suppkey % 2 + 1 AS INT) AS instance_number, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS snap_id, l_partkey AS obj, CAST(count(*) AS BIGINT) AS logical_reads_delta, CAST(sum(floor(l_quantity)) AS BIGINT) AS physical_reads_delta, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS row_lock_waits_delta, CAST(max(floor(l_extendedprice)) AS BIGINT) AS space_allocated_total FROM lineitem GROUP BY 1, 2, 3, 4",
    "fx_object_multi": "SELECT p_partkey AS object_id, substr(p_brand, 1, 7) AS owner, split_part(p_name, ' ', 1) AS object_name, CASE WHEN p_size % 3 = 0 THEN 'INDEX' ELSE 'TABLE' END AS object_type FROM part",
    # cursors whose plans use a sequence (one per customer nation), with load and activity times
    "fx_seq_cursor": "SELECT concat('q', CAST(c.c_nationkey AS STRING), '_', o.o_orderpriority) AS sql_id, 1 AS inst_id, CAST(count(*) AS BIGINT) AS executions, CAST(sum(CAST(substr(o.o_orderpriority, 1, 1) AS INT)) AS BIGINT) AS rows_processed, min(o.o_orderdate) AS first_load_time, max(o.o_orderdate) AS last_active_time, r.r_name AS object_owner, concat('SEQ_', n.n_name) AS object_name, 'SEQUENCE' AS operation FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2, 7, 8",
    # table reference graph derived from the parts: each table references T<k/3>, some also T<k/5> (diamonds)
    "fx_table_ref": "SELECT concat('T', CAST(p_partkey AS STRING)) AS child_table, concat('T', CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING)) AS parent_table FROM part UNION SELECT concat('T', CAST(p_partkey AS STRING)), concat('T', CAST(CAST(floor(p_partkey / CASE WHEN p_partkey % 7 = 0 THEN 5 ELSE 3 END) AS BIGINT) AS STRING)) FROM part",
    # unused columns, sequences, instance parameters and recovery targets for the listing rules
    "fx_cat_unused_col": "SELECT owner, table_name, CAST(blocks % 3 AS BIGINT) AS count FROM fx_cat_table",
    "fx_cat_sequence": "SELECT r.r_name AS sequence_owner, concat('SEQ_', n.n_name) AS sequence_name, CAST(n.n_nationkey % 4 * 10 AS BIGINT) AS cache_size, CAST(count(*) AS BIGINT) AS last_number FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2, 3",
    "fx_parameter": "SELECT instance_number AS inst_id, 'session_cached_cursors' AS name, CAST(count(DISTINCT session_id) AS STRING) AS value FROM fx_ash GROUP BY 1 UNION ALL SELECT instance_number, 'cursor_sharing', CASE WHEN instance_number = 1 THEN 'FORCE' ELSE 'EXACT' END FROM fx_ash GROUP BY 1",
    "fx_instance_recovery": "SELECT dbid, instance_number, snap_id, CAST(value % 300 AS BIGINT) AS target_mttr, CAST(value % 200 AS BIGINT) AS estimated_mttr FROM fx_sysstat WHERE stat_id = 1",
    # statement texts keyed like fx_sqlstat
    "fx_sqltext": "SELECT concat('s', CAST(k AS STRING)) AS sql_id, CASE WHEN k % 3 = 0 THEN 6 ELSE 3 END AS command_type, min(CASE WHEN k % 3 = 0 THEN concat('UPDATE ', p_type, ' SET qty = :1 WHERE brand = ', p_brand, ' AND size = ', CAST(p_size AS STRING)) ELSE concat('SELECT * FROM ', p_type, ' WHERE ', p_brand, ' = ', CAST(p_size AS STRING)) END) AS sql_text FROM (SELECT p_partkey % 50 AS k, p_type, p_brand, p_size FROM part) t GROUP BY 1, 2",
    # rule inputs: statistics with fetch/parse counters, cursor cache, open cursors, child-cursor flags,
    # audit options in force, function catalog, table modifications, objects named like fx_plan_multi
    "fx_sqlstat_ext": "SELECT *, executions_delta * plan_hash_value * 40 AS fetches_delta, CAST(ceil(executions_delta / 3) AS BIGINT) AS parse_calls_delta FROM fx_sqlstat",
    "fx_sqlarea": "SELECT 1 AS inst_id, s.sql_id, min(parsing_schema_name) AS parsing_schema_name, min(module) AS module, CAST(sum(executions_delta) AS BIGINT) AS executions, CAST(sum(executions_delta * plan_hash_value * 40) AS BIGINT) AS fetches, CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed, CAST(sum(elapsed_time_delta) AS BIGINT) AS elapsed_time, min(t.sql_text) AS sql_text FROM fx_sqlstat s JOIN fx_sqltext t ON t.sql_id = s.sql_id GROUP BY 1, 2",
    "fx_open_cursor": "SELECT instance_number AS inst_id, session_id AS sid, sql_id, concat('SELECT /* ', sql_id, ' */ 1') AS sql_text FROM fx_ash WHERE event IN ('click', 'view')",
    "fx_shared_cursor": "SELECT instance_number AS inst_id, sql_id, CASE WHEN disk_reads_delta = 0 THEN 'Y' ELSE 'N' END AS bind_mismatch, CASE WHEN module = 'F' THEN 'Y' ELSE 'N' END AS optimizer_mismatch, CASE WHEN parsing_schema_name = 'A' THEN 'Y' ELSE 'N' END AS auth_check_mismatch FROM fx_sqlstat",
    "fx_audit_opts": "SELECT DISTINCT CASE event_type WHEN 'view' THEN 'VIEW' WHEN 'signup' THEN 'USER' WHEN 'purchase' THEN 'TABLE' WHEN 'click' THEN 'SELECT TABLE' ELSE 'CREATE SESSION' END AS audit_option, CASE WHEN event_type = 'click' THEN 'NOT SET' ELSE 'BY ACCESS' END AS success, 'BY ACCESS' AS failure FROM events",
    # one short plan per (statement, plan) with the operations and options of real plans, drawn from the parts
    "fx_stmt_base": "SELECT concat('s', CAST(p_partkey % 50 AS STRING)) AS sql_id, CAST(floor(p_partkey / 50) % 7 + 1 AS INT) AS plan_hash_value, max(p_size) AS s, min(substr(p_brand, 1, 7)) AS object_owner, min(split_part(p_name, ' ', 1)) AS object_name, min(p_name) AS n, CAST(count(*) AS BIGINT) AS parts FROM part GROUP BY 1, 2",
    "fx_stmt_plan": "SELECT sql_id, plan_hash_value, CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'SELECT STATEMENT' AS operation, CAST(NULL AS STRING) AS options, CAST(NULL AS STRING) AS object_owner, CAST(NULL AS STRING) AS object_name, CAST(NULL AS STRING) AS other_tag, CAST(NULL AS STRING) AS filter_predicates FROM fx_stmt_base UNION ALL SELECT sql_id, plan_hash_value, 1, 0, CASE WHEN plan_hash_value = 3 THEN 'INDEX' ELSE 'TABLE ACCESS' END, CASE plan_hash_value WHEN 1 THEN 'FULL' WHEN 2 THEN 'STORAGE FULL' WHEN 3 THEN 'FULL SCAN' ELSE 'BY INDEX ROWID' END, CASE WHEN s % 10 = 0 THEN 'SYS' ELSE object_owner END, object_name, CASE WHEN CAST(substr(sql_id, 2) AS INT) % 3 = 0 THEN NULL WHEN plan_hash_value = 2 THEN 'PARALLEL_TO_SERIAL' WHEN plan_hash_value = 4 THEN 'PARALLEL_FROM_SERIAL' END, CASE WHEN plan_hash_value = 6 THEN n END FROM fx_stmt_base UNION ALL SELECT sql_id, plan_hash_value, 2, 1, CASE WHEN plan_hash_value = 4 THEN 'TABLE ACCESS' ELSE 'INDEX' END, CASE WHEN plan_hash_value = 4 THEN 'FULL' WHEN s % 2 = 0 THEN 'RANGE SCAN' ELSE 'UNIQUE SCAN' END, object_owner, object_name, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM fx_stmt_base WHERE plan_hash_value >= 4 UNION ALL SELECT sql_id, plan_hash_value, 3, 0, 'COUNT', 'STOPKEY', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM fx_stmt_base WHERE plan_hash_value = 7",
    # the cursor cache per plan, with buffer gets and command types; statistics where every fifth statement finds nothing
    "fx_sqlarea_plan": "SELECT s.sql_id, s.plan_hash_value, CAST(sum(executions_delta) AS BIGINT) AS executions, CAST(sum(buffer_gets_delta) AS BIGINT) AS buffer_gets, CAST(sum(executions_delta * (plan_hash_value + 1)) AS BIGINT) AS rows_processed, min(t.command_type) AS command_type, min(t.sql_text) AS sql_text FROM fx_sqlstat s JOIN fx_sqltext t ON t.sql_id = s.sql_id GROUP BY 1, 2",
    "fx_sqlstat_hits": "SELECT dbid, instance_number, snap_id, sql_id, plan_hash_value, parsing_schema_name, module, executions_delta, elapsed_time_delta, buffer_gets_delta, disk_reads_delta, CASE WHEN CAST(substr(sql_id, 2) AS INT) % 5 = 0 THEN CAST(0 AS BIGINT) ELSE rows_processed_delta END AS rows_processed_delta FROM fx_sqlstat",
    # plan lines that name the catalog's indexes and tables: open shipments are the cursor cache, finished ones the history
    "fx_index_use": "SELECT DISTINCT concat('s', CAST(l_partkey % 50 AS STRING)) AS sql_id, l_linenumber AS plan_hash_value, l_linestatus AS origin, p_brand AS object_owner, concat('I', CAST(l_partkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS object_name FROM lineitem JOIN part ON p_partkey = l_partkey",
    "fx_table_use": "SELECT DISTINCT concat('s', CAST(l_partkey % 50 AS STRING)) AS sql_id, l_linenumber AS plan_hash_value, l_linestatus AS origin, p_brand AS object_owner, concat('T', CAST(l_partkey AS STRING)) AS object_name FROM lineitem JOIN part ON p_partkey = l_partkey",
    # the catalog with older copies of indexes and tables that no plan names
    "fx_cat_index_wide": "SELECT * FROM fx_cat_index UNION ALL SELECT owner, concat(index_name, '_OLD'), table_owner, table_name, ln, 'NONUNIQUE', num_rows, distinct_keys, pct_free, compression, leaf_blocks, partitioned, index_type, last_analyzed FROM fx_cat_index WHERE ln < 3",
    "fx_cat_table_wide": "SELECT * FROM fx_cat_table UNION ALL SELECT owner, concat(table_name, '_OLD'), num_rows, blocks, avg_row_len, iot_type, partitioned, compression, last_analyzed, dropped FROM fx_cat_table WHERE iot_type IS NULL",
    # system metrics in detail and as summaries; the live buffers start at different times per instance
    "fx_sysmetric": "SELECT 1 AS dbid, instance_number, sample_time AS begin_time, sample_time + INTERVAL 1 MINUTE AS end_time, CAST(event_id % 3 + 1 AS INT) AS group_id, CAST(event_id % 5 AS INT) AS metric_id, concat('metric ', CAST(event_id % 5 AS STRING)) AS metric_name, CASE WHEN event_id % 5 < 2 THEN 'Bytes' ELSE 'Per Second' END AS metric_unit, time_waited AS value, CAST(time_waited / 2 AS DOUBLE) AS average, CAST(floor(time_waited / 4) AS BIGINT) AS min_val, time_waited * 2 AS max_val FROM fx_ash",
    "fx_sysmetric_live": "SELECT * FROM fx_sysmetric WHERE begin_time >= CASE WHEN instance_number = 1 THEN TIMESTAMP '2024-01-20 00:00:00' ELSE TIMESTAMP '2024-01-12 00:00:00' END",
    # lock history: who waits, on what, and what the blocker does; rows without a blocker hold their lock
    "fx_lock_history": "SELECT sample_time AS snapshot_ts, instance_number, session_id AS sid, session_id % 3 + 1 AS serialno, sql_id, CAST(event_id % 2 AS INT) AS sql_child_number, module, CASE WHEN event_id % 11 = 0 THEN concat('SYS_LOB', lpad(CAST(event_id % 5000 + 1 AS STRING), 10, '0'), 'C00004$$') WHEN event_id % 13 = 0 THEN concat('SYS_IL', lpad(CAST(event_id % 50 + 1 AS STRING), 10, '0'), 'C00004$$') WHEN event <> 'view' THEN concat('T', CAST(event_id % 9 AS STRING)) END AS object_name, CASE WHEN event = 'error' THEN 'TX' WHEN event = 'purchase' THEN 'TM' ELSE 'UL' END AS lock_type, CAST(floor(time_waited / 1000) AS BIGINT) AS seconds_in_wait, CAST(event_id % 50 + 1 AS BIGINT) AS id1, CAST(sample_id % 4 AS BIGINT) AS id2, CASE WHEN blocking_session IS NULL THEN 0 ELSE 6 END AS request, CASE WHEN blocking_session IS NULL THEN 6 ELSE 0 END AS lock_mode, CASE WHEN blocking_session IS NOT NULL THEN concat('OWN', CAST(event_id % 2 AS STRING)) END AS blocking_object_schema, CASE WHEN blocking_session IS NOT NULL THEN CASE WHEN event_id % 7 = 0 THEN concat('SYS_LOB', lpad(CAST(event_id % 50 + 1 AS STRING), 10, '0'), 'C00007$$') ELSE concat('T', CAST(event_id % 4 AS STRING)) END END AS blocking_object_name, CASE WHEN event_id % 3 = 0 THEN concat('AAAR3s', CAST(event_id % 6 AS STRING)) END AS blocking_rowid, CASE WHEN blocking_session IS NOT NULL THEN CAST(blocking_session % 2 + 1 AS INT) END AS blocking_instance_number, blocking_session AS blocking_sid, blocking_session % 3 + 1 AS blocking_serialno, CASE WHEN blocking_session IS NOT NULL THEN concat('s', CAST(blocking_session % 7 AS STRING)) END AS blocking_sql_id, CAST(blocking_session % 2 AS INT) AS blocking_sql_child_number FROM fx_ash",
    "fx_functions": "SELECT DISTINCT concat('GET_', p_type) AS name, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'YES' ELSE 'NO' END AS parallel_enabled FROM part",
    "fx_tab_mod": "SELECT concat('o', CAST(l_suppkey % 3 AS STRING)) AS owner, concat('t', CAST(l_orderkey AS STRING)) AS table_name, CAST(floor(l_quantity) AS BIGINT) AS inserts, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS deletes FROM lineitem",
    "fx_plan_object": "SELECT substr(p_brand, 1, 7) AS owner, split_part(p_name, ' ', 1) AS object_name, max(CASE WHEN p_size % 3 = 0 THEN 'INDEX' ELSE 'TABLE' END) AS object_type, CAST(sum(floor(p_retailprice)) AS BIGINT) AS num_rows FROM part GROUP BY 1, 2",
    "fx_pk_column": "SELECT lower(p_type) AS table_name, min(split_part(p_name, ' ', 1)) AS column_name FROM part GROUP BY 1",
})

# statement history that grows with the parts: every part is a statement with up to four plans in two databases,
# statements share their plan hashes, and the objects of the plan lines are shared by some statements
_DELTAS = {
    "executions": "CAST(floor(l_quantity) AS BIGINT) % 9", "fetches": "CAST(floor(l_quantity) AS BIGINT) * 3", "parse_calls": "CAST(floor(l_quantity) AS BIGINT) % 4",
    "sorts": "l_suppkey % 3", "loads": "l_suppkey % 2", "elapsed_time": "CAST(floor(l_extendedprice * 100) AS BIGINT)", "cpu_time": "CAST(floor(l_extendedprice * 60) AS BIGINT)",
    "buffer_gets": "CAST(floor(l_extendedprice) AS BIGINT)", "disk_reads": "CAST(round(l_discount * 100) AS BIGINT)", "rows_processed": "CAST(round(l_tax * 100) AS BIGINT)",
    "clwait": "CAST(floor(l_extendedprice * 2) AS BIGINT)", "apwait": "CAST(floor(l_extendedprice * 3) AS BIGINT)", "ccwait": "CAST(floor(l_extendedprice * 4) AS BIGINT)",
    "iowait": "CAST(floor(l_extendedprice * 5) AS BIGINT)", "plsexec_time": "CAST(floor(l_extendedprice * 6) AS BIGINT)",
}
_MONTH = "CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT)"
FIXTURE_SQL.update({
    "fx_hist_stat": f"SELECT CASE WHEN l_suppkey % 10 = 0 THEN 2 ELSE 1 END AS dbid, CAST(l_suppkey % 2 + 1 AS INT) AS instance_number, {_MONTH} AS snap_id, concat('s', CAST(l_partkey AS STRING)) AS sql_id, CAST(l_linenumber % 5 AS BIGINT) AS plan_hash_value, l_orderkey % 3 AS optimizer_env_hash_value, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS parsing_schema_name, l_linestatus AS module, concat('act', CAST(l_suppkey % 4 AS STRING)) AS action, "
                    + ", ".join(f"{e} AS {c}_delta" for c, e in _DELTAS.items()) + " FROM lineitem",
    "fx_hist_snapshot": f"SELECT DISTINCT CASE WHEN l_suppkey % 10 = 0 THEN 2 ELSE 1 END AS dbid, CAST(l_suppkey % 2 + 1 AS INT) AS instance_number, {_MONTH} AS snap_id, date_trunc('month', l_shipdate) AS begin_interval_time, date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS end_interval_time FROM lineitem",
    "fx_hist_text": "SELECT d.dbid, concat('s', CAST(p_partkey AS STRING)) AS sql_id, concat('SELECT /* ', p_name, ' */ * FROM T', CAST(p_partkey % 97 AS STRING), ' WHERE kind = :', p_type) AS sql_text FROM part CROSS JOIN (VALUES (1), (2)) AS d(dbid)",
    "fx_hist_plan": "SELECT s.dbid, s.sql_id, s.plan_hash_value, x.id, x.operation, CASE WHEN x.id = 1 AND s.plan_hash_value % 2 = 0 THEN 'FULL' WHEN x.id = 2 THEN 'RANGE SCAN' END AS options, CASE WHEN s.plan_hash_value = 3 THEN 'PARALLEL_TO_SERIAL' END AS other_tag, CASE WHEN x.id > 0 THEN upper(substr(p.p_brand, 1, 7)) END AS object_owner, CASE x.id WHEN 1 THEN concat('T', CAST((p.p_partkey + s.plan_hash_value) % 97 AS STRING)) WHEN 2 THEN concat('I', CAST(p.p_partkey % 89 AS STRING)) WHEN 3 THEN concat('T', CAST(p.p_partkey % 97 AS STRING)) END AS object_name FROM (SELECT DISTINCT dbid, sql_id, plan_hash_value FROM fx_hist_stat WHERE plan_hash_value > 0) s JOIN part p ON concat('s', CAST(p.p_partkey AS STRING)) = s.sql_id CROSS JOIN (VALUES (CAST(0 AS BIGINT), 'SELECT STATEMENT'), (1, 'TABLE ACCESS'), (2, 'INDEX'), (3, 'TABLE ACCESS')) AS x(id, operation) WHERE x.id < 3 OR s.plan_hash_value = 4",
    "fx_cur_sql": "SELECT instance_number AS inst_id, sql_id, CAST(plan_hash_value AS INT) AS child_number, plan_hash_value, CASE WHEN max(snap_id) % 3 = 0 THEN 'INVALID_UNAUTH' ELSE 'VALID' END AS object_status, min(parsing_schema_name) AS parsing_schema_name, max(module) AS module, max(action) AS action, "
                  + ", ".join(f"CAST(sum({c}_delta) AS BIGINT) AS {c}" for c in _DELTAS) + " FROM fx_hist_stat WHERE dbid = 1 GROUP BY 1, 2, 3, 4",
    "fx_cur_plan": "SELECT c.inst_id, c.child_number, p.* FROM (SELECT DISTINCT inst_id, sql_id, child_number, plan_hash_value FROM fx_cur_sql) c JOIN fx_hist_plan p ON p.sql_id = c.sql_id AND p.plan_hash_value = c.plan_hash_value WHERE p.dbid = 1",
    # functions and package functions, and statement texts that use them: parallel and serial ones, blocks and explains
    "fx_procedure": "SELECT DISTINCT CASE WHEN p_size % 10 = 0 THEN 'SYS' ELSE 'APP' END AS owner, concat('GET_', upper(p_type)) AS object_name, CAST(NULL AS STRING) AS procedure_name, 'FUNCTION' AS object_type, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'YES' ELSE 'NO' END AS parallel FROM part UNION ALL SELECT DISTINCT 'APP', concat('PK_', upper(p_type)), concat('CALC_', upper(split_part(p_name, ' ', 1))), 'PACKAGE', CASE WHEN p_type = 'PROMO' THEN 'YES' ELSE 'NO' END FROM part",
    "fx_par_text": "SELECT d.dbid, concat('s', CAST(p_partkey AS STRING)) AS sql_id, concat(CASE p_size % 5 WHEN 0 THEN 'SELECT /*+ PARALLEL(t,4) */ ' WHEN 1 THEN 'select /*+ parallel */ ' WHEN 2 THEN 'SELECT ' WHEN 3 THEN ' BEGIN /* parallel */ ' ELSE 'EXPLAIN PLAN FOR SELECT /*+ PARALLEL */ ' END, CASE WHEN floor(p_partkey / 5) % 2 = 0 THEN concat('Get_', p_type) ELSE concat('pk_', p_type, '.calc_', split_part(p_name, ' ', 1)) END, CASE WHEN p_partkey % 7 = 0 THEN 'x(a)' ELSE '(a)' END, ' FROM t') AS sql_text FROM part CROSS JOIN (VALUES (1), (2)) AS d(dbid)",
    "fx_par_cursor": "SELECT c.inst_id, c.sql_id, t.sql_text, c.elapsed_time FROM (SELECT inst_id, sql_id, CAST(sum(elapsed_time) AS BIGINT) AS elapsed_time FROM fx_cur_sql GROUP BY 1, 2) c JOIN fx_par_text t ON t.sql_id = c.sql_id WHERE t.dbid = 1",
    # activity samples of two instances, one row a session and hour, with blockers by (session, serial, instance)
    "fx_ash_rac": "SELECT 1 AS dbid, CAST((month(ts) - 1) * 31 + day(ts) AS INT) AS snap_id, CAST(((month(ts) - 1) * 31 + day(ts)) * 24 + hour(ts) AS BIGINT) AS sample_id, date_trunc('hour', ts) AS sample_time, instance_number, session_id, session_id * 10 + instance_number AS session_serial, blocking_session, CASE WHEN blocking_session IS NOT NULL THEN blocking_session * 10 + blocking_session % 2 + 1 + CASE WHEN event_id % 17 = 0 THEN 5 ELSE 0 END END AS blocking_serial, CASE WHEN blocking_session IS NOT NULL THEN CAST(blocking_session % 2 + 1 AS INT) END AS blocking_inst_id, CASE WHEN blocking_session IS NULL THEN 'NO HOLDER' WHEN event_id % 5 = 0 THEN 'GLOBAL' WHEN event_id % 23 = 0 THEN 'UNKNOWN' ELSE 'VALID' END AS blocking_session_status, event_id % 6 AS current_file, event_id % 3 AS current_block, event_id % 2 AS current_row, CASE WHEN event_id % 4 = 0 THEN 'object #' ELSE 'id1' END AS p2text, event_id % 60 + 1 AS p2, event_id % 199 + 1 AS current_obj, CAST(floor(value * 100) AS BIGINT) AS wait_time, CAST(floor(value * 1000) AS BIGINT) AS time_waited, concat('s', CAST(user_id % 7 AS STRING)) AS sql_id, user_id % 31 AS user_id, CASE WHEN event_type <> 'view' THEN event_type END AS event, CASE WHEN event_type = 'view' THEN 'ON CPU' ELSE 'WAITING' END AS session_state, concat('m', CAST(event_id % 5 AS STRING)) AS module, CASE WHEN event_id % 3 = 0 THEN concat('a', CAST(event_id % 4 AS STRING)) END AS action, concat('p', CAST(user_id % 3 AS STRING)) AS program FROM (SELECT *, CAST(user_id % 2 + 1 AS INT) AS instance_number, user_id % 20 AS session_id, CASE WHEN event_id % 3 <> 0 AND user_id % 20 > 0 THEN CAST(floor((user_id % 20) / 2) AS BIGINT) WHEN event_id % 3 <> 0 AND day(ts) % 3 = 0 THEN CAST(19 AS BIGINT) END AS blocking_session, row_number() OVER (PARTITION BY date_trunc('hour', ts), user_id % 20 ORDER BY event_id) AS rn FROM events) t WHERE rn = 1",
    "fx_ash_rac_live": "SELECT * FROM fx_ash_rac WHERE sample_time >= TIMESTAMP '2024-01-26 00:00:00' AND instance_number = 1",
    "fx_ash_snapshot": "SELECT DISTINCT dbid, instance_number, snap_id, date_trunc('day', sample_time) AS begin_interval_time, date_trunc('day', sample_time) + INTERVAL 1 DAY AS end_interval_time FROM fx_ash_rac",
    "fx_ash_object": "SELECT p_partkey AS object_id, p_brand AS owner, CASE WHEN p_size % 7 = 0 THEN concat('SYS_LOB', lpad(CAST(p_partkey % 50 + 1 AS STRING), 10, '0'), 'C00004$$') ELSE p_name END AS object_name, CASE WHEN p_size % 7 = 2 THEN concat('P', CAST(p_size AS STRING)) END AS subobject_name, CASE WHEN p_size % 3 = 0 THEN 'INDEX' ELSE 'TABLE' END AS object_type, p_partkey % 150 AS data_object_id FROM part",
    "fx_db_user": "SELECT DISTINCT user_id % 31 AS user_id, concat('USER', CAST(user_id % 31 AS STRING)) AS username FROM events WHERE user_id % 31 <> 30",
    # columns of composite primary and foreign keys
    "fx_ref_column": "SELECT owner, constraint_name, table_name, CASE WHEN constraint_type = 'P' THEN 'C0' ELSE 'C2' END AS column_name, 1 AS position FROM fx_cat_constraint UNION ALL SELECT owner, constraint_name, table_name, CASE WHEN constraint_type = 'P' THEN 'C9' ELSE 'C1' END, 2 FROM fx_cat_constraint WHERE length(constraint_name) % 3 <> 0",
})

# sessions with their process, transaction and wait; groups of messages; segment statistics with all measures
FIXTURE_SQL.update({
    "fx_session_full": "SELECT instance_number AS inst_id, session_id AS sid, session_id * 10 + instance_number AS serial_no, CASE WHEN session_id % 9 = 8 THEN 'BACKGROUND' ELSE 'USER' END AS session_type, CASE WHEN session_id % 4 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, concat('user', CAST(session_id % 5 AS STRING)) AS username, concat('os', CAST(session_id % 4 AS STRING)) AS os_user, concat('host', CAST(session_id % 3 AS STRING)) AS machine, CAST(session_id * 3 AS STRING) AS process, concat('program of ', min(module)) AS program, min(module) AS module, min(sql_id) AS sql_id, session_id * 7 + instance_number AS process_addr, CASE WHEN session_id % 2 = 1 THEN session_id * 11 + instance_number END AS transaction_addr, CASE WHEN session_id % 3 <> 0 THEN session_id END AS lock_wait, CASE WHEN session_id % 2 = 0 THEN 'object #' ELSE 'id2' END AS p2text, session_id % 60 + 1 AS p2, CASE WHEN session_id % 5 = 0 THEN CAST(-1 AS BIGINT) ELSE session_id % 40 + 1 END AS row_wait_obj, CAST(floor(max(time_waited) / 1000) AS BIGINT) AS seconds_in_wait, CASE WHEN session_id % 3 = 1 THEN CAST(instance_number % 2 + 1 AS INT) END AS blocking_instance, CASE WHEN session_id % 3 = 1 THEN CAST(floor(session_id / 2) AS BIGINT) END AS blocking_session FROM fx_ash GROUP BY instance_number, session_id",
    "fx_process": "SELECT inst_id, process_addr AS addr, concat('pid', CAST(process_addr AS STRING)) AS spid FROM fx_session_full WHERE sid % 11 <> 10",
    "fx_transaction": "SELECT inst_id, transaction_addr AS addr, sid % 6 AS rollback_segment FROM fx_session_full WHERE transaction_addr IS NOT NULL AND sid % 4 = 1",
    "fx_msg_group": "SELECT o_custkey AS id, o_custkey % 8 AS id_messagetype, o_custkey % 25 AS id_domain, min(o_orderdate) AS creation_time, o_custkey % 10 AS priority, CASE WHEN o_custkey % 4 = 1 THEN max(o_orderdate) END AS process_start FROM orders GROUP BY o_custkey",
    "fx_group_message": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 AND o_custkey % 13 <> 0 THEN o_custkey END AS id_bulkgroup, o_custkey % 9 AS id_messagetype, o_orderdate AS creation_time FROM orders",
    "fx_cache_object": "SELECT l_shipdate AS snapshot_ts, CAST(l_suppkey % 2 + 1 AS INT) AS instance, concat('OWNER', CAST(l_partkey % 5 AS STRING)) AS owner, concat('TAB', CAST(l_partkey % 200 AS STRING)) AS name, CASE WHEN l_partkey % 3 = 0 THEN concat('P', CAST(l_linenumber AS STRING)) END AS partition_name, CAST(sum(floor(l_quantity)) AS BIGINT) AS blocks_total, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS blocks_dirty FROM lineitem GROUP BY 1, 2, 3, 4, 5",
    "fx_redo_log": "SELECT CAST(s_suppkey % 2 + 1 AS INT) AS inst_id, s_suppkey AS group_no, CAST(52428800 * (1 + s_nationkey % 3) AS BIGINT) AS bytes, CAST(1 + s_suppkey % 3 AS INT) AS members, CAST(512 AS INT) AS block_size FROM supplier",
    "fx_table_type": "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'OWN' ELSE 'SYS' END AS owner, concat('T', CAST(p_partkey AS STRING)) AS table_name, CASE WHEN p_size % 2 = 0 THEN 'M' ELSE 'T' END AS table_type, p_name AS documentation FROM part WHERE p_partkey % 11 <> 10",
    "fx_mutex_sleep": "SELECT CAST(user_id % 2 + 1 AS INT) AS inst_id, event_id AS mutex_identifier, ts AS sleep_timestamp, event_type AS mutex_type, event_id % 100 + 1 AS gets, CAST(round(value) AS BIGINT) AS sleeps, (user_id + event_id) % 20 AS requesting_session, user_id % 20 AS blocking_session, concat('loc', CAST(event_id % 8 AS STRING)) AS location FROM events",
    "fx_msg_type": "SELECT DISTINCT o_custkey % 8 AS id, concat('type', CAST(o_custkey % 8 AS STRING)) AS name FROM orders",
})
SEGMENT_MEASURES = {
    "logical_reads_delta": "count(*)", "buffer_busy_waits_delta": "sum(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END)",
    "db_block_changes_delta": "sum(l_linenumber)", "physical_reads_delta": "sum(floor(l_quantity))",
    "physical_writes_delta": "sum(CASE WHEN l_linestatus = 'O' THEN floor(l_quantity) ELSE 0 END)",
    "physical_reads_direct_delta": "sum(CASE WHEN l_linenumber = 2 THEN floor(l_quantity) ELSE 0 END)",
    "physical_writes_direct_delta": "sum(CASE WHEN l_linenumber = 3 THEN floor(l_quantity) ELSE 0 END)",
    "itl_waits_delta": "sum(CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END)", "row_lock_waits_delta": "sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)",
    "gc_buffer_busy_delta": "sum(CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END)",
    "gc_cr_blocks_received_delta": "sum(CASE WHEN l_partkey % 3 <> 0 AND l_returnflag = 'A' THEN l_linenumber ELSE 0 END)",
    "gc_cu_blocks_received_delta": "sum(CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE 0 END)",
    "space_used_delta": "sum(floor(l_extendedprice / 10))", "space_allocated_delta": "sum(floor(l_extendedprice / 8))",
    "table_scans_delta": "sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)",
}
FIXTURE_SQL["fx_seg_stat_full"] = "SELECT 1 AS dbid, CAST(l_suppkey % 2 + 1 AS INT) AS instance_number, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS snap_id, l_partkey AS obj, " + ", ".join(
    f"CAST({x} AS BIGINT) AS {n}" for n, x in SEGMENT_MEASURES.items()) + " FROM lineitem GROUP BY 1, 2, 3, 4"

# cumulative IO counters per (instance, file, function, file type, snapshot), restart every 24 snapshots
_IO_SUMS = {
    "phyrds": "count(*)", "phyblkrd": "sum(floor(l_quantity))", "readtim": "sum(floor(l_extendedprice / 100))",
    "phywrts": "sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)", "phyblkwrt": "sum(CASE WHEN l_linestatus = 'O' THEN floor(l_quantity) ELSE 0 END)",
    "writetim": "sum(round(l_tax * 100))", "singleblkrds": "sum(CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END)",
    "singleblkrdtim": "sum(CASE WHEN l_quantity < 25 THEN floor(l_extendedprice / 100) ELSE 0 END)",
    "small_read_megabytes": "sum(CASE WHEN l_linenumber = 1 THEN floor(l_quantity) ELSE 0 END)",
    "small_write_megabytes": "sum(CASE WHEN l_linenumber = 2 THEN floor(l_quantity) ELSE 0 END)",
    "large_read_megabytes": "sum(CASE WHEN l_linenumber = 3 THEN floor(l_quantity) * 8 ELSE 0 END)",
    "large_write_megabytes": "sum(CASE WHEN l_linenumber > 3 THEN floor(l_quantity) * 8 ELSE 0 END)",
    "small_read_reqs": "sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)", "small_write_reqs": "sum(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END)",
    "large_read_reqs": "sum(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END)", "large_write_reqs": "sum(CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END)",
    "number_of_waits": "sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)", "wait_time": "sum(CASE WHEN l_returnflag = 'R' THEN floor(l_extendedprice) ELSE 0 END)",
    "small_read_servicetime": "sum(CASE WHEN l_linenumber = 1 THEN floor(l_extendedprice) ELSE 0 END)",
    "small_write_servicetime": "sum(CASE WHEN l_linenumber = 2 THEN floor(l_extendedprice) ELSE 0 END)",
    "large_read_servicetime": "sum(CASE WHEN l_linenumber = 3 THEN floor(l_extendedprice) ELSE 0 END)",
    "large_write_servicetime": "sum(CASE WHEN l_linenumber > 3 THEN floor(l_extendedprice) ELSE 0 END)",
    "small_sync_read_reqs": "sum(CASE WHEN l_linenumber = 1 AND l_tax > 0.04 THEN 1 ELSE 0 END)",
    "small_sync_read_latency": "sum(CASE WHEN l_linenumber = 1 AND l_tax > 0.04 THEN floor(l_extendedprice) ELSE 0 END)",
    "retries_on_error": "sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END)",
}
_IO_KEYS = "instance_number, file_id, function_name, filetype_name"
FIXTURE_SQL["fx_io"] = (
    f"SELECT 1 AS dbid, snap_id, {_IO_KEYS}, concat('/u01/f', CAST(file_id AS STRING), '.dbf') AS file_name, concat('TS', CAST(file_id % 3 AS STRING)) AS ts_name, "
    + ", ".join(f"CAST(sum({c}) OVER (PARTITION BY {_IO_KEYS}, floor(snap_id / 24) ORDER BY snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS {c}" for c in _IO_SUMS)
    + " FROM (SELECT CAST(l_suppkey % 2 + 1 AS INT) AS instance_number, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS snap_id, CAST(l_partkey % 6 AS INT) AS file_id, CASE l_returnflag WHEN 'A' THEN 'Buffer Cache Reads' WHEN 'N' THEN 'Direct Reads' ELSE 'LGWR' END AS function_name, CASE WHEN l_partkey % 6 >= 5 THEN 'Temp File' ELSE 'Data File' END AS filetype_name, "
    + ", ".join(f"CAST({v} AS BIGINT) AS {c}" for c, v in _IO_SUMS.items()) + " FROM lineitem GROUP BY 1, 2, 3, 4, 5) t")

_DEPENDS = {name: [d for d in FIXTURE_SQL if d != name and re.search(rf"\b{d}\b", sql)]
            for name, sql in FIXTURE_SQL.items()}

_REGISTERED: dict[int, str] = {}


def register_fixtures(spark: SparkSession, sf_dir: str) -> None:
    """Register base tables and all fixture views for ``sf_dir`` (idempotent)."""
    register_tables(spark, sf_dir)
    if _REGISTERED.get(id(spark)) == sf_dir and spark.catalog.tableExists("fx_ash"):
        return
    for name, sql in FIXTURE_SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS {sql}")
    _REGISTERED[id(spark)] = sf_dir


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_fixtures(spark, sf_dir)
    return spark.table(name)


def _needed(sql: str) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPENDS[n]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in FIXTURE_SQL:
        if re.search(rf"\b{n}\b", sql):
            visit(n)
    return seen


def with_fixtures(sql: str) -> str:
    """Prefix an oracle query with the fixture views it mentions as CTEs."""
    names = _needed(sql)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in names)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def fixture_dealt(spark: SparkSession, sf_dir: str, name: str, table: str, keys: list[str]) -> DataFrame:
    """The rows of the view ``name``, with the base table under it dealt by ``keys``.

    If a view has these expressions as columns and groups by them (and others),
    the one shuffle, of the table's few columns, serves that group, and joins and
    groups by the ``keys`` alone that follow.
    """
    register_fixtures(spark, sf_dir)
    spark.table(table).repartition(*[F.expr(k) for k in keys]).createOrReplaceTempView(f"{table}_dealt")
    return spark.sql(re.sub(rf"\b{table}\b", f"{table}_dealt", with_fixtures(f"SELECT * FROM {name}")))
