"""Catalog rule queries over the catalog binding."""

from __future__ import annotations

from ..plans.rules import apply_rule
from ..sources import fixture
from .registry import query


def _cat(spark, sf):
    names = {"tables": "fx_cat_table", "indexes": "fx_cat_index", "ind_columns": "fx_cat_ind_column",
             "tab_columns": "fx_cat_tab_column", "constraints": "fx_cat_constraint", "cons_columns": "fx_cat_cons_column"}
    return {k: fixture(spark, sf, v) for k, v in names.items()}


@query("r01_index_pctfree", """
SELECT * FROM (SELECT owner, table_name, index_name, CAST(NULL AS VARCHAR) AS partition_name, pct_free, num_rows FROM fx_cat_index WHERE pct_free < 10
UNION ALL SELECT p.index_owner, i.table_name, p.index_name, p.partition_name, p.pct_free, p.num_rows FROM fx_cat_ind_partition p
  LEFT JOIN fx_cat_index i ON i.owner = p.index_owner AND i.index_name = p.index_name WHERE p.pct_free < 8)
WHERE num_rows > 1000 AND owner NOT IN ('SYS', 'SYSTEM', 'SYSMAN')""")
def r01(spark, sf):
    return apply_rule("R01", {**_cat(spark, sf), "ind_partitions": fixture(spark, sf, "fx_cat_ind_partition")}, min_rows=1000, max_pct_free_partition=8)


@query("r02_index_compression", """
SELECT i.owner, i.index_name, i.table_owner, i.table_name, t.iot_type, i.num_rows, i.distinct_keys, round(i.leaf_blocks * 8192 / 1048576.0, 1) AS mbytes,
  round(i.num_rows / i.distinct_keys) AS rows_per_key, 5 * i.num_rows * i.num_rows / i.distinct_keys AS weight
FROM fx_cat_index i JOIN fx_cat_table t ON t.owner = i.table_owner AND t.table_name = i.table_name
WHERE i.compression = 'DISABLED' AND i.distinct_keys > 0 AND i.num_rows / CASE WHEN i.distinct_keys = 0 THEN 1 ELSE i.distinct_keys END > 50
  AND i.index_type <> 'BITMAP' AND round(i.leaf_blocks * 8192 / 1048576.0, 1) > 0.0""")
def r02(spark, sf):
    return apply_rule("R02", _cat(spark, sf), min_rows_per_key=50)


@query("r03_leaf_blocks_per_key", """
SELECT i.owner, i.table_name, i.index_name, i.distinct_keys, round(CASE WHEN i.distinct_keys = 0 THEN NULL ELSE i.leaf_blocks / i.distinct_keys END, 4) AS avg_leaf_blocks_per_key,
  i.num_rows, t.iot_type FROM fx_cat_index i JOIN fx_cat_table t ON t.owner = i.table_owner AND t.table_name = i.table_name
WHERE round(CASE WHEN i.distinct_keys = 0 THEN NULL ELSE i.leaf_blocks / i.distinct_keys END, 4) > 1.5 AND i.compression = 'DISABLED'""")
def r03(spark, sf):
    return apply_rule("R03", _cat(spark, sf), min_leaf_blocks_per_key=1.5)


@query("r05_iot_candidates", """
WITH c AS (SELECT owner, table_name, count(*) AS columns FROM fx_cat_tab_column GROUP BY 1, 2),
i AS (SELECT table_owner AS owner, table_name, count(*) AS indexes, CAST(sum(CASE WHEN uniqueness = 'UNIQUE' THEN 1 ELSE 0 END) AS BIGINT) AS unique_indexes
      FROM fx_cat_index GROUP BY 1, 2),
p AS (SELECT k.owner, k.table_name, count(*) AS pkey_columns FROM fx_cat_constraint k
      JOIN fx_cat_ind_column ic ON ic.index_owner = k.owner AND ic.index_name = k.index_name WHERE k.constraint_type = 'P' GROUP BY 1, 2)
SELECT t.owner, t.table_name, t.num_rows, t.avg_row_len, coalesce(c.columns, 0) AS columns, coalesce(i.indexes, 0) AS indexes,
  coalesce(i.unique_indexes, 0) AS unique_indexes, coalesce(p.pkey_columns, 0) AS pkey_columns
FROM fx_cat_table t LEFT JOIN c ON c.owner = t.owner AND c.table_name = t.table_name
LEFT JOIN i ON i.owner = t.owner AND i.table_name = t.table_name LEFT JOIN p ON p.owner = t.owner AND p.table_name = t.table_name
WHERE t.iot_type IS NULL AND t.num_rows > 0 AND coalesce(c.columns, 0) < 6 AND coalesce(i.unique_indexes, 0) > 0 AND t.num_rows > 100000""")
def r05(spark, sf):
    return apply_rule("R05", _cat(spark, sf))


@query("r06_fk_without_index", """
SELECT r.r_owner, tg.table_name AS target_table, r.owner, r.table_name, r.r_constraint_name, r.constraint_name, rc.column_name, rc.position,
  ro.num_rows AS rows_org, tt.num_rows AS rows_target
FROM fx_cat_constraint r JOIN fx_cat_cons_column rc ON rc.owner = r.owner AND rc.constraint_name = r.constraint_name
JOIN fx_cat_constraint tg ON tg.owner = r.r_owner AND tg.constraint_name = r.r_constraint_name
JOIN fx_cat_table ro ON ro.owner = r.owner AND ro.table_name = r.table_name
JOIN fx_cat_table tt ON tt.owner = r.r_owner AND tt.table_name = tg.table_name
WHERE r.constraint_type = 'R' AND tt.num_rows > 300000 AND NOT EXISTS (SELECT 1 FROM fx_cat_ind_column i WHERE i.table_owner = r.owner
  AND i.table_name = r.table_name AND i.column_name = rc.column_name AND i.column_position = rc.position)""")
def r06(spark, sf):
    return apply_rule("R06", _cat(spark, sf), min_rows_target=300000)


@query("r09_indexes_with_few_keys", """
WITH nn AS (SELECT ic.index_owner AS owner, ic.index_name,
   CASE WHEN sum(CASE WHEN tc.nullable = 'N' THEN 1 ELSE 0 END) = count(*) THEN 'NOT NULL' ELSE 'NULLABLE' END AS nullable
   FROM fx_cat_ind_column ic JOIN fx_cat_tab_column tc ON tc.owner = ic.table_owner AND tc.table_name = ic.table_name AND tc.column_name = ic.column_name
   GROUP BY 1, 2)
SELECT i.owner, i.table_name, i.index_name, i.distinct_keys, round(i.num_rows / CASE WHEN i.distinct_keys = 0 THEN 1 ELSE i.distinct_keys END) AS rows_per_key,
  i.num_rows AS rows_index, t.num_rows AS rows_table, t.num_rows - i.num_rows AS possible_nulls, t.iot_type,
  round(i.leaf_blocks * 8192 / 1048576.0, 1) AS mbytes, nn.nullable
FROM fx_cat_index i JOIN fx_cat_table t ON t.owner = i.table_owner AND t.table_name = i.table_name
LEFT JOIN nn ON nn.owner = i.owner AND nn.index_name = i.index_name WHERE i.num_rows > 200 AND i.distinct_keys <= 3""")
def r09(spark, sf):
    return apply_rule("R09", _cat(spark, sf), min_rows=200, max_distinct_keys=3)


@query("r10_column_indexed_twice", """
WITH d AS (SELECT table_owner, table_name, column_name FROM fx_cat_ind_column WHERE column_position = 1 GROUP BY 1, 2, 3 HAVING count(*) > 1),
s AS (SELECT * FROM fx_cat_ind_column i WHERE column_position = 1 AND NOT EXISTS (SELECT 1 FROM fx_cat_ind_column ii
      WHERE ii.table_owner = i.table_owner AND ii.table_name = i.table_name AND ii.index_name = i.index_name AND ii.column_position = 2))
SELECT d.table_owner, d.table_name, d.column_name, s.index_name, ix.num_rows, pk.constraint_name AS used_for_pkey
FROM d JOIN s ON s.table_owner = d.table_owner AND s.table_name = d.table_name AND s.column_name = d.column_name
JOIN fx_cat_index ix ON ix.table_owner = d.table_owner AND ix.table_name = d.table_name AND ix.index_name = s.index_name
LEFT JOIN fx_cat_constraint pk ON pk.constraint_type = 'P' AND pk.owner = ix.owner AND pk.table_name = d.table_name AND pk.index_name = ix.index_name
WHERE ix.num_rows > 1000""")
def r10(spark, sf):
    return apply_rule("R10", _cat(spark, sf), min_rows=1000)


@query("r13_local_partition_candidates", """
SELECT i.owner, i.table_name, i.index_name, i.num_rows, i.distinct_keys FROM fx_cat_index i
JOIN fx_cat_table t ON t.owner = i.table_owner AND t.table_name = i.table_name
WHERE i.partitioned = 'NO' AND t.partitioned = 'YES' AND i.uniqueness = 'NONUNIQUE' AND NOT EXISTS (
  SELECT 1 FROM fx_cat_constraint r WHERE r.owner = t.owner AND r.table_name = t.table_name AND r.constraint_type = 'U' AND r.index_name = i.index_name)""")
def r13(spark, sf):
    return apply_rule("R13", _cat(spark, sf))


@query("r18_all_null_columns", """
SELECT c.*, t.num_rows FROM fx_cat_tab_column c JOIN fx_cat_table t ON t.owner = c.owner AND t.table_name = c.table_name
WHERE t.num_rows > 0 AND c.num_nulls = t.num_rows""")
def r18(spark, sf):
    return apply_rule("R18", _cat(spark, sf))


@query("r19_single_value_columns", """
SELECT c.*, t.num_rows FROM fx_cat_tab_column c JOIN fx_cat_table t ON t.owner = c.owner AND t.table_name = c.table_name
WHERE t.num_rows > 300000 AND c.num_distinct = 1""")
def r19(spark, sf):
    return apply_rule("R19", _cat(spark, sf), min_rows=300000)


@query("r50_stale_table_statistics", """
SELECT owner, table_name, num_rows, last_analyzed, CAST(date_diff('day', CAST(last_analyzed AS DATE), CAST((SELECT max(last_analyzed) FROM fx_cat_table) AS DATE)) AS INTEGER) AS days_since_analyzed
FROM fx_cat_table WHERE last_analyzed < (SELECT max(last_analyzed) FROM fx_cat_table) - INTERVAL 30 DAY AND num_rows > 300000""")
def r50(spark, sf):
    return apply_rule("R50", _cat(spark, sf), min_rows=300000)


@query("r51_stale_index_statistics", """
SELECT owner, index_name, table_name, num_rows, last_analyzed, CAST(date_diff('day', CAST(last_analyzed AS DATE), CAST((SELECT max(last_analyzed) FROM fx_cat_index) AS DATE)) AS INTEGER) AS days_since_analyzed
FROM fx_cat_index WHERE last_analyzed < (SELECT max(last_analyzed) FROM fx_cat_index) - INTERVAL 60 DAY AND num_rows > 1000""")
def r51(spark, sf):
    return apply_rule("R51", _cat(spark, sf), days=60, min_rows=1000)


@query("r68_multi_column_reference_targets", """
WITH k AS (SELECT owner, constraint_name, table_name FROM fx_cat_constraint WHERE constraint_type IN ('P', 'U')),
n AS (SELECT owner, constraint_name, count(*) AS key_columns FROM fx_cat_cons_column GROUP BY 1, 2),
r AS (SELECT r_owner AS owner, r_constraint_name AS constraint_name, count(*) AS references FROM fx_cat_constraint WHERE constraint_type = 'R' GROUP BY 1, 2)
SELECT k.owner, k.constraint_name, k.table_name, n.key_columns, r.references FROM k
JOIN n ON n.owner = k.owner AND n.constraint_name = k.constraint_name JOIN r ON r.owner = k.owner AND r.constraint_name = k.constraint_name
WHERE n.key_columns >= 2""")
def r68(spark, sf):
    return apply_rule("R68", _cat(spark, sf))


@query("r04_compression_by_single_block_reads", """
WITH h AS (SELECT event_id % 2000 + 1 AS current_obj, count(*) AS samples FROM fx_ash WHERE event = 'click' GROUP BY 1 HAVING count(*) > 2),
o AS (SELECT h.*, x.owner, x.object_name, x.object_type FROM h LEFT JOIN (
        SELECT CAST(substr(table_name, 2) AS BIGINT) AS object_id, owner, table_name AS object_name, 'TABLE' AS object_type FROM fx_cat_table) x ON x.object_id = h.current_obj),
d AS (SELECT 'TABLE' AS kind, owner, table_name AS name, max(compression) AS compression FROM fx_cat_table GROUP BY 1, 2, 3
      UNION ALL SELECT 'INDEX', owner, index_name, max(compression) FROM fx_cat_index GROUP BY 1, 2, 3)
SELECT o.owner, o.object_name, o.object_type, d.compression, CAST(sum(samples) AS BIGINT) AS samples FROM o
LEFT JOIN d ON d.kind = o.object_type AND d.owner = o.owner AND d.name = o.object_name GROUP BY 1, 2, 3, 4""")
def r04(spark, sf):
    from pyspark.sql import functions as F
    c = _cat(spark, sf)
    ash = fixture(spark, sf, "fx_ash").withColumn("current_obj", F.pmod("event_id", F.lit(2000)) + 1)
    objs = c["tables"].select(F.substring("table_name", 2, 20).cast("bigint").alias("object_id"), "owner",
                              F.col("table_name").alias("object_name"), F.lit("TABLE").alias("object_type"))
    return apply_rule("R04", {**c, "ash": ash, "objects": objs}, event="click", min_samples=2)


@query("r11_monitored_unused_indexes", """
SELECT u.owner, u.index_name, u.table_name, u.index_flags, u.usage_flags, i.num_rows, i.distinct_keys, i.uniqueness
FROM fx_cat_index_usage u JOIN fx_cat_index i ON i.owner = u.owner AND i.index_name = u.index_name AND i.table_name = u.table_name
WHERE (u.index_flags & 65536) = 65536 AND NOT ((u.usage_flags & 1) = 1) AND i.num_rows > 300""")
def r11(spark, sf):
    return apply_rule("R11", {**_cat(spark, sf), "index_usage": fixture(spark, sf, "fx_cat_index_usage")}, min_rows=300)


@query("r14_unique_index_local_candidates", """
WITH pk AS (SELECT owner, table_name, 'C0' AS column_name, 1 AS column_position FROM fx_cat_table WHERE partitioned = 'YES')
SELECT t.owner, t.table_name, pk.column_name AS partition_key1, i.index_name, t.num_rows
FROM fx_cat_table t JOIN pk ON pk.owner = t.owner AND pk.table_name = t.table_name AND pk.column_position = 1
JOIN fx_cat_ind_column ic ON ic.table_owner = t.owner AND ic.table_name = t.table_name AND ic.column_name = pk.column_name AND ic.column_position = 1
JOIN fx_cat_index i ON i.owner = ic.index_owner AND i.index_name = ic.index_name WHERE t.partitioned = 'YES' AND i.partitioned = 'NO'""")
def r14(spark, sf):
    from pyspark.sql import functions as F
    c = _cat(spark, sf)
    pk = c["tables"].filter(F.col("partitioned") == "YES").select("owner", "table_name", F.lit("C0").alias("column_name"),
                                                                 F.lit(1).alias("column_position"))
    return apply_rule("R14", {**c, "part_key_columns": pk})


@query("r61_function_index_literals", """
SELECT * FROM fx_cat_ind_expression WHERE regexp_matches(column_expression, '[''0-9]')""")
def r61(spark, sf):
    return apply_rule("R61", {"ind_expressions": fixture(spark, sf, "fx_cat_ind_expression")})


@query("r20_unused_columns", """
SELECT cs.owner, cs.table_name, cs.count, t.num_rows, t.num_rows * cs.count AS weight FROM fx_cat_unused_col cs
JOIN fx_cat_table t ON t.owner = cs.owner AND t.table_name = cs.table_name WHERE cs.count > 0""")
def r20(spark, sf):
    return apply_rule("R20", {**_cat(spark, sf), "unused_columns": fixture(spark, sf, "fx_cat_unused_col")})


@query("r21_dropped_tables", "SELECT * FROM fx_cat_table WHERE dropped = 'YES'")
def r21(spark, sf):
    return apply_rule("R21", _cat(spark, sf))


@query("r25_fk_checks_on_delete", """
WITH recent AS (SELECT s.* FROM fx_sqlstat s WHERE EXISTS (SELECT 1 FROM fx_snapshot ss WHERE ss.dbid = s.dbid
  AND ss.instance_number = s.instance_number AND ss.snap_id = s.snap_id
  AND ss.begin_interval_time > (SELECT max(begin_interval_time) FROM fx_snapshot) - INTERVAL 400 DAY)),
g AS (SELECT dbid, sql_id, instance_number, CAST(sum(executions_delta) AS BIGINT) AS executions, round(sum(elapsed_time_delta) / 1e6, 6) AS elapsed_secs,
   round((sum(elapsed_time_delta) / 1e6) / CASE WHEN sum(executions_delta) = 0 THEN 1 ELSE sum(executions_delta) END, 5) AS elapsed_per_exec,
   CAST(sum(buffer_gets_delta) AS BIGINT) AS buffer_gets, max(snap_id) AS max_snap_id FROM recent WHERE parsing_schema_name = 'R' GROUP BY 1, 2, 3)
SELECT g.*, t.sql_text, substr(t.sql_text, 1, 40) AS short_text FROM g JOIN fx_sqltext t ON t.sql_id = g.sql_id
WHERE upper(t.sql_text) LIKE '%UPDATE%WHERE%AND%'""")
def r25(spark, sf):
    return apply_rule("R25", {"sqlstat": fixture(spark, sf, "fx_sqlstat"), "snapshot": fixture(spark, sf, "fx_snapshot"),
                              "sqltext": fixture(spark, sf, "fx_sqltext")}, days=400, schema="R", text_pattern="%UPDATE%WHERE%AND%")


@query("r53_sequence_cache", """
SELECT *, round(last_number / CASE WHEN cache_size = 0 THEN 1 ELSE cache_size END, 4) AS numbers_per_cache FROM fx_cat_sequence""")
def r53(spark, sf):
    return apply_rule("R53", {"sequences": fixture(spark, sf, "fx_cat_sequence")})


@query("r57_contradictory_parameters", """
SELECT p.*, 'session_cached_cursors should be 0 when cursor_sharing is not EXACT' AS problem FROM fx_parameter p
WHERE p.name = 'session_cached_cursors' AND p.value <> '0'
  AND EXISTS (SELECT 1 FROM fx_parameter i WHERE i.inst_id = p.inst_id AND i.name = 'cursor_sharing' AND i.value <> 'EXACT')""")
def r57(spark, sf):
    return apply_rule("R57", {"parameters": fixture(spark, sf, "fx_parameter")})


@query("r66_recovery_target_history", """
SELECT r.*, CAST(ss.begin_interval_time AS TIMESTAMP) AS begin_interval_time FROM fx_instance_recovery r
JOIN fx_snapshot ss ON ss.dbid = r.dbid AND ss.instance_number = r.instance_number AND ss.snap_id = r.snap_id
WHERE r.instance_number = 1 AND ss.begin_interval_time > (SELECT max(begin_interval_time) FROM fx_snapshot) - INTERVAL 400 DAY""")
def r66(spark, sf):
    return apply_rule("R66", {"recovery": fixture(spark, sf, "fx_instance_recovery"), "snapshot": fixture(spark, sf, "fx_snapshot")},
                      days=400)


@query("r07_unneeded_fk_index", """
WITH ri AS (SELECT r.owner, r.table_name, r.constraint_name, rc.column_name, rc.position, ric.index_name, r.r_owner, r.r_constraint_name, ix.num_rows AS rows_origin
  FROM fx_cat_constraint r JOIN fx_cat_cons_column rc ON rc.owner = r.owner AND rc.constraint_name = r.constraint_name
  JOIN fx_cat_ind_column ric ON ric.table_owner = r.owner AND ric.table_name = r.table_name AND ric.column_name = rc.column_name AND ric.column_position = rc.position
  JOIN fx_cat_index ix ON ix.owner = ric.index_owner AND ix.index_name = ric.index_name WHERE r.constraint_type = 'R')
SELECT ri.rows_origin, ri.owner, ri.table_name, ri.index_name, p.constraint_name, ri.column_name, pi.num_rows AS rows_target, ri.position,
  pi.table_name AS target_table, pi.index_name AS target_index
FROM ri JOIN fx_cat_constraint p ON p.owner = ri.r_owner AND p.constraint_name = ri.r_constraint_name
JOIN fx_cat_index pi ON pi.owner = p.owner AND pi.index_name = p.index_name
WHERE pi.num_rows < 1000 AND ri.rows_origin > 200
  AND (SELECT count(*) FROM fx_cat_constraint x WHERE x.constraint_type = 'R' AND x.r_owner = p.owner AND x.r_constraint_name = p.constraint_name) < 2000""")
def r07(spark, sf):
    return apply_rule("R07", _cat(spark, sf), max_rows_target=1000, min_rows_origin=200, max_references=2000)


@query("r15_partitioned_index_overhead", """
WITH use AS (SELECT p.object_owner AS owner, p.object_name AS index_name, CAST(sum(a.executions) AS BIGINT) AS executions,
   CAST(sum(a.rows_processed) AS BIGINT) AS rows_processed FROM fx_sql_plan p JOIN fx_sqlarea a ON a.sql_id = p.sql_id
   WHERE p.options IN ('UNIQUE SCAN', 'RANGE SCAN', 'RANGE SCAN (MIN/MAX)') GROUP BY 1, 2)
SELECT i.owner, i.index_name, i.index_type, i.table_name, u.executions, u.rows_processed, i.num_rows, p.partitioning_type, ic.column_position,
  p.part_column AS part_col, ic.column_name AS ind_col, i.uniqueness, i.distinct_keys, p.partition_count, p.locality
FROM fx_cat_index i JOIN fx_cat_part_index p ON p.owner = i.owner AND p.index_name = i.index_name
JOIN fx_cat_ind_column ic ON ic.index_owner = i.owner AND ic.index_name = i.index_name AND ic.column_position = p.column_position
LEFT JOIN use u ON u.owner = i.owner AND u.index_name = i.index_name
WHERE p.partitioning_type = 'HASH' AND p.part_column <> ic.column_name""")
def r15(spark, sf):
    c = _cat(spark, sf)
    return apply_rule("R15", {**c, "part_indexes": fixture(spark, sf, "fx_cat_part_index"),
                              "sql_plan": fixture(spark, sf, "fx_sql_plan"), "sqlarea": fixture(spark, sf, "fx_sqlarea")})


@query("r12_low_selectivity_index_columns", """
WITH cols AS (SELECT ic.index_owner, ic.index_name, ic.column_name, tc.num_distinct FROM fx_cat_ind_column ic
   JOIN fx_cat_tab_column tc ON tc.owner = ic.table_owner AND tc.table_name = ic.table_name AND tc.column_name = ic.column_name),
mx AS (SELECT index_owner, index_name, max(num_distinct) AS max_num_distinct FROM cols GROUP BY 1, 2),
ms AS (SELECT mx.index_owner, mx.index_name, mx.max_num_distinct, max(c.column_name) AS max_column FROM mx
   JOIN cols c ON c.index_owner = mx.index_owner AND c.index_name = mx.index_name AND c.num_distinct = mx.max_num_distinct GROUP BY 1, 2, 3),
i AS (SELECT owner AS index_owner, index_name, table_owner, table_name, num_rows FROM fx_cat_index WHERE num_rows > 0 AND uniqueness = 'NONUNIQUE'),
ixonly AS (SELECT DISTINCT a.object_owner AS index_owner, a.object_name AS index_name FROM fx_sql_plan a JOIN i ON i.index_owner = a.object_owner AND i.index_name = a.object_name
   WHERE NOT EXISTS (SELECT 1 FROM fx_sql_plan b WHERE b.sql_id = a.sql_id AND b.plan_hash_value = a.plan_hash_value AND b.object_owner = i.table_owner AND b.object_name = i.table_name))
SELECT i.index_owner AS owner, i.table_name, i.index_name, i.num_rows, ms.max_column, ms.max_num_distinct,
  round(ms.max_num_distinct / i.num_rows, 4) AS max_selectivity, c.column_name AS min_column, c.num_distinct AS min_num_distinct
FROM i JOIN ms ON ms.index_owner = i.index_owner AND ms.index_name = i.index_name
JOIN cols c ON c.index_owner = i.index_owner AND c.index_name = i.index_name
WHERE ms.max_num_distinct > i.num_rows / 4 AND c.column_name <> ms.max_column AND i.num_rows > 100
  AND NOT EXISTS (SELECT 1 FROM ixonly o WHERE o.index_owner = i.index_owner AND o.index_name = i.index_name)""")
def r12(spark, sf):
    return apply_rule("R12", {**_cat(spark, sf), "sql_plan": fixture(spark, sf, "fx_sql_plan")}, min_rows=100)


@query("r54_sequence_use_per_day", """
WITH x AS (SELECT c.object_owner, c.object_name, c.inst_id, c.sql_id, c.executions, c.rows_processed, c.first_load_time, c.last_active_time, s.cache_size,
   CASE WHEN (epoch_us(c.last_active_time) - epoch_us(c.first_load_time)) / 1000000.0 / 86400.0 < 1 THEN 1.0
        ELSE (epoch_us(c.last_active_time) - epoch_us(c.first_load_time)) / 1000000.0 / 86400.0 END AS days
   FROM fx_seq_cursor c JOIN fx_cat_sequence s ON s.sequence_owner = c.object_owner AND s.sequence_name = c.object_name
   WHERE c.operation = 'SEQUENCE' AND c.executions > 0)
SELECT object_owner, object_name, inst_id, sql_id, executions, rows_processed, first_load_time, last_active_time, cache_size,
  round(executions / days) AS executions_per_day, round(rows_processed / days) AS rows_per_day, round(rows_processed / executions, 2) AS rows_per_exec
FROM x""")
def r54(spark, sf):
    cur = fixture(spark, sf, "fx_seq_cursor")
    return apply_rule("R54", {"sql_plan": cur, "cursors": cur, "sequences": fixture(spark, sf, "fx_cat_sequence")})
