"""Statement-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import statements as ST
from ..sources import fixture
from .q_hierarchy import _norm_name, _norm_name_sql
from .registry import query


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


D01_RANGE = ("1996-03-15 10:00:00", "1997-09-10 00:00:00")

BORDERS_SQL = f"""b AS (
  SELECT dbid, instance_number,
    coalesce(max(CASE WHEN begin_interval_time <= TIMESTAMP '{D01_RANGE[0]}' THEN snap_id END),
             min(CASE WHEN begin_interval_time >= TIMESTAMP '{D01_RANGE[0]}' THEN snap_id END)) AS lo,
    coalesce(min(CASE WHEN end_interval_time >= TIMESTAMP '{D01_RANGE[1]}' THEN snap_id END),
             max(CASE WHEN end_interval_time <= TIMESTAMP '{D01_RANGE[1]}' THEN snap_id END)) AS hi
  FROM fx_snapshot GROUP BY 1, 2)"""


@query("d01_top_statements_history", f"""
WITH {BORDERS_SQL},
g AS (SELECT s.dbid, s.sql_id, s.instance_number, coalesce(s.parsing_schema_name, '[UNKNOWN]') AS parsing_schema_name,
    CAST(sum(executions_delta) AS BIGINT) AS executions, round(sum(elapsed_time_delta) / 1000000.0, 6) AS elapsed_time_secs,
    CAST(NULL AS BIGINT) AS cpu_time, CAST(sum(disk_reads_delta) AS BIGINT) AS disk_reads, CAST(sum(buffer_gets_delta) AS BIGINT) AS buffer_gets,
    CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed, CAST(NULL AS BIGINT) AS parse_calls, CAST(NULL AS BIGINT) AS cluster_wait_time,
    min(s.snap_id) AS min_snap_id, max(s.snap_id) AS max_snap_id
  FROM fx_sqlstat s JOIN b ON b.dbid = s.dbid AND b.instance_number = s.instance_number
  WHERE s.snap_id BETWEEN b.lo AND b.hi GROUP BY 1, 2, 3, 4)
SELECT g.*, t.sql_text, substr(t.sql_text, 1, 40) AS short_text,
  round(elapsed_time_secs / CASE WHEN executions = 0 THEN 1 ELSE executions END, 6) AS sort_value
FROM g JOIN fx_sqltext t ON t.sql_id = g.sql_id
WHERE contains(upper(t.sql_text), 'ECONOMY')
ORDER BY sort_value DESC NULLS LAST, sql_id, instance_number, parsing_schema_name LIMIT 15""")
def d01(spark, sf):
    return ST.top_statements_history(_fx(spark, sf, "fx_sqlstat"), _fx(spark, sf, "fx_snapshot"),
                                     _fx(spark, sf, "fx_sqltext"), *D01_RANGE, sort="ElapsedTimePerExecute",
                                     n=15, text_filter="economy")


@query("d02_top_statements_current", """
WITH area AS (SELECT sql_id, CAST(sum(executions_delta) AS BIGINT) AS executions, CAST(sum(elapsed_time_delta) AS BIGINT) AS elapsed_time,
   CAST(sum(buffer_gets_delta) AS BIGINT) AS buffer_gets, CAST(sum(disk_reads_delta) AS BIGINT) AS disk_reads,
   CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed FROM fx_sqlstat GROUP BY 1),
ch AS (SELECT sql_id, count(*) AS child_count, count(DISTINCT plan_hash_value) AS plan_count
   FROM (SELECT DISTINCT sql_id, plan_hash_value, instance_number FROM fx_sqlstat) c GROUP BY 1)
SELECT area.*, ch.child_count, ch.plan_count FROM area LEFT JOIN ch ON ch.sql_id = area.sql_id
ORDER BY buffer_gets / CASE WHEN executions = 0 THEN 1 ELSE executions END DESC, area.sql_id LIMIT 12""")
def d02(spark, sf):
    s = _fx(spark, sf, "fx_sqlstat")
    area = s.groupBy("sql_id").agg(F.sum("executions_delta").alias("executions"),
                                   F.sum("elapsed_time_delta").alias("elapsed_time"),
                                   F.sum("buffer_gets_delta").alias("buffer_gets"),
                                   F.sum("disk_reads_delta").alias("disk_reads"),
                                   F.sum("rows_processed_delta").alias("rows_processed"))
    children = s.select("sql_id", "plan_hash_value", "instance_number").distinct()
    return ST.top_statements_current(area, children, "BufferGetsPerExec", 12)


@query("d03_statement_summary", """
WITH last AS (SELECT dbid, sql_id, max(snap_id) AS ls FROM fx_sqlstat GROUP BY 1, 2),
lp AS (SELECT s.dbid, s.sql_id, max(plan_hash_value) AS last_plan_hash_value, max(module) AS last_module
       FROM fx_sqlstat s JOIN last l ON l.dbid = s.dbid AND l.sql_id = s.sql_id AND s.snap_id = l.ls GROUP BY 1, 2),
g AS (SELECT dbid, sql_id, count(DISTINCT plan_hash_value) AS plan_count, CAST(sum(executions_delta) AS BIGINT) AS executions,
       CAST(sum(elapsed_time_delta) AS BIGINT) AS elapsed_time, CAST(sum(buffer_gets_delta) AS BIGINT) AS buffer_gets,
       CAST(sum(disk_reads_delta) AS BIGINT) AS disk_reads, min(snap_id) AS min_snap_id, max(snap_id) AS max_snap_id
      FROM fx_sqlstat GROUP BY 1, 2)
SELECT g.*, lp.last_plan_hash_value, lp.last_module,
  round(100.0 * (buffer_gets - disk_reads) / greatest(buffer_gets, 1), 4) AS hit_ratio,
  round(elapsed_time / CASE WHEN executions = 0 THEN 1 ELSE executions END, 6) AS elapsed_per_exec
FROM g JOIN lp ON lp.dbid = g.dbid AND lp.sql_id = g.sql_id""")
def d03(spark, sf):
    return ST.statement_summary(_fx(spark, sf, "fx_sqlstat"))


@query("d04_statement_per_month", """
SELECT s.sql_id, CAST(date_trunc('month', ss.begin_interval_time) AS TIMESTAMP) AS period,
  CAST(sum(executions_delta) AS BIGINT) AS executions, CAST(sum(elapsed_time_delta) AS BIGINT) AS elapsed_time,
  CAST(sum(buffer_gets_delta) AS BIGINT) AS buffer_gets, CAST(sum(disk_reads_delta) AS BIGINT) AS disk_reads
FROM fx_sqlstat s JOIN fx_snapshot ss ON ss.dbid = s.dbid AND ss.instance_number = s.instance_number AND ss.snap_id = s.snap_id
GROUP BY 1, 2""")
def d04(spark, sf):
    return ST.statement_per_period(_fx(spark, sf, "fx_sqlstat"), _fx(spark, sf, "fx_snapshot"), "MM")


@query("d05_plan_lines_order_marks", f"""
WITH RECURSIVE walk AS (
  SELECT plan_hash_value, id, parent_id, operation, object_owner, object_name, 1 AS lvl, [id] AS path FROM fx_plan_multi p
  WHERE NOT EXISTS (SELECT 1 FROM fx_plan_multi q WHERE q.plan_hash_value = p.plan_hash_value AND q.id = p.parent_id)
  UNION ALL
  SELECT c.plan_hash_value, c.id, c.parent_id, c.operation, c.object_owner, c.object_name, w.lvl + 1, list_append(w.path, c.id)
  FROM walk w JOIN fx_plan_multi c ON c.plan_hash_value = w.plan_hash_value AND c.parent_id = w.id
  WHERE NOT list_contains(w.path, c.id)),
o AS (SELECT *, row_number() OVER (PARTITION BY plan_hash_value ORDER BY list_append(path, CAST(4611686018427387904 AS BIGINT))) AS exec_order,
  count(*) OVER (PARTITION BY parent_id, operation, object_owner, {_norm_name_sql()}) AS strict_count,
  count(*) OVER (PARTITION BY parent_id, operation, object_owner) AS loose_count FROM walk),
per AS (SELECT id, count(DISTINCT coalesce(CAST(parent_id AS VARCHAR), '~') || '|' || operation || '|' || object_owner || '|' || {_norm_name_sql()}) AS variants,
  count(*) AS n FROM o GROUP BY 1)
SELECT o.plan_hash_value, o.id, o.lvl AS level, o.exec_order, o.strict_count, o.loose_count,
  (per.variants > 1 OR per.n < (SELECT count(DISTINCT plan_hash_value) FROM o)) AS plan_different
FROM o JOIN per ON per.id = o.id""")
def d05(spark, sf):
    strict = ["parent_id", "operation", "object_owner", _norm_name()]
    out = ST.plan_lines_marked(_fx(spark, sf, "fx_plan_multi"), strict=strict,
                               loose=["parent_id", "operation", "object_owner"])
    return out.select("plan_hash_value", "id", "level", "exec_order", "strict_count", "loose_count", "plan_different")


@query("b10_d06_time_per_plan_line", """
WITH smp AS (SELECT 1 AS plan_hash_value, event_id % 2000 + 1 AS id, wait_class, 10 AS sample_cycle FROM fx_ash),
t AS (SELECT plan_hash_value, id, CAST(sum(sample_cycle) AS BIGINT) AS db_secs,
   CAST(sum(CASE WHEN wait_class IS NULL THEN sample_cycle ELSE 0 END) AS BIGINT) AS cpu_secs,
   CAST(sum(CASE WHEN wait_class IS NOT NULL THEN sample_cycle ELSE 0 END) AS BIGINT) AS wait_secs, count(*) AS samples
   FROM smp GROUP BY 1, 2),
n AS (SELECT owner, object_name, max(num_rows) AS num_rows FROM fx_object GROUP BY 1, 2)
SELECT p.plan_hash_value, p.id, p.operation, t.db_secs, t.cpu_secs, t.wait_secs, t.samples, n.num_rows
FROM fx_plan p LEFT JOIN t ON t.plan_hash_value = p.plan_hash_value AND t.id = p.id
LEFT JOIN n ON n.owner = p.object_owner AND n.object_name = p.object_name""")
def b10(spark, sf):
    from ..operators.lookup import enrich_lookup
    smp = _fx(spark, sf, "fx_ash").select(F.lit(1).alias("plan_hash_value"),
                                          (F.pmod("event_id", F.lit(2000)) + 1).alias("id"), "wait_class",
                                          F.lit(10).alias("sample_cycle"))
    plan = _fx(spark, sf, "fx_plan")
    t = ST.time_per_plan_line(smp, plan)
    obj = _fx(spark, sf, "fx_object").withColumnRenamed("owner", "object_owner")
    out = enrich_lookup(t, obj, ["object_owner", "object_name"], {"num_rows": F.max("num_rows")})
    return out.select("plan_hash_value", "id", "operation", "db_secs", "cpu_secs", "wait_secs", "samples", "num_rows")


@query("d11_best_source", """
WITH h AS (SELECT sql_id, sum(CASE WHEN parsing_schema_name = 'R' THEN 1 ELSE 0 END) AS hits_h, min(parsing_schema_name) AS schema_h,
             count(DISTINCT parsing_schema_name) AS schemas_h FROM fx_sqlstat WHERE snap_id <= 24 GROUP BY 1),
c AS (SELECT sql_id, sum(CASE WHEN parsing_schema_name = 'R' THEN 1 ELSE 0 END) AS hits_c, min(parsing_schema_name) AS schema_c,
             count(DISTINCT parsing_schema_name) AS schemas_c FROM fx_sqlstat WHERE snap_id > 24 GROUP BY 1),
j AS (SELECT coalesce(h.sql_id, c.sql_id) AS sql_id, h.*, c.* EXCLUDE (sql_id) FROM h FULL OUTER JOIN c ON c.sql_id = h.sql_id)
SELECT sql_id,
  CASE WHEN hits_h > 0 OR schemas_h = 1 THEN 'history' WHEN hits_c > 0 OR schemas_c = 1 THEN 'current' ELSE 'text' END AS source,
  CASE WHEN hits_h > 0 OR schemas_h = 1 THEN CASE WHEN hits_h > 0 THEN 'R' ELSE schema_h END
       WHEN hits_c > 0 OR schemas_c = 1 THEN CASE WHEN hits_c > 0 THEN 'R' ELSE schema_c END END AS parsing_schema_name
FROM j""")
def d11(spark, sf):
    s = _fx(spark, sf, "fx_sqlstat")
    return ST.best_source(s.filter(F.col("snap_id") <= 24), s.filter(F.col("snap_id") > 24), "R")


@query("d10_two_period_comparison", """
SELECT t1.sql_id, t1.parsing_schema_name,
  t1.executions AS executions_t1, t1.elapsed_time AS elapsed_time_t1, t1.rows_processed AS rows_processed_t1, t1.instance_count AS instance_count_t1,
  t2.executions AS executions_t2, t2.elapsed_time AS elapsed_time_t2, t2.rows_processed AS rows_processed_t2, t2.instance_count AS instance_count_t2,
  round(t1.elapsed_time / t1.executions, 6) AS elapsed_per_exec_t1, round(t2.elapsed_time / t2.executions, 6) AS elapsed_per_exec_t2,
  round((t2.elapsed_time / t2.executions - t1.elapsed_time / t1.executions) * t2.executions, 4) AS weighted_growth,
  t1.plans + t2.plans - CASE WHEN t1.max_plan = t2.max_plan AND t1.plans <> 0 AND t2.plans <> 0 THEN 1 ELSE 0 END AS execution_plan_count,
  x.sql_text
FROM (SELECT sql_id, parsing_schema_name, CAST(sum(executions_delta) AS BIGINT) AS executions,
  CAST(sum(elapsed_time_delta) AS BIGINT) AS elapsed_time, CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed,
  max(plan_hash_value) AS max_plan, count(DISTINCT CASE WHEN plan_hash_value = 0 THEN NULL ELSE plan_hash_value END) AS plans,
  count(DISTINCT instance_number) AS instance_count
  FROM fx_sqlstat WHERE snap_id BETWEEN 25 AND 36 GROUP BY 1, 2 HAVING sum(executions_delta) > 0) t1 JOIN (SELECT sql_id, parsing_schema_name, CAST(sum(executions_delta) AS BIGINT) AS executions,
  CAST(sum(elapsed_time_delta) AS BIGINT) AS elapsed_time, CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed,
  max(plan_hash_value) AS max_plan, count(DISTINCT CASE WHEN plan_hash_value = 0 THEN NULL ELSE plan_hash_value END) AS plans,
  count(DISTINCT instance_number) AS instance_count
  FROM fx_sqlstat WHERE snap_id BETWEEN 37 AND 48 GROUP BY 1, 2 HAVING sum(executions_delta) > 0) t2 ON t1.sql_id = t2.sql_id AND t1.parsing_schema_name = t2.parsing_schema_name
JOIN fx_sqltext x ON x.sql_id = t1.sql_id
WHERE t2.elapsed_time / t2.executions > t1.elapsed_time / t1.executions * 1.05""")
def d10(spark, sf):
    s = _fx(spark, sf, "fx_sqlstat")
    return ST.two_period_comparison(s, _fx(spark, sf, "fx_sqltext"), F.col("snap_id").between(25, 36),
                                    F.col("snap_id").between(37, 48), 5.0)


@query("d14_shared_cursor_reasons", """
SELECT concat_ws(', ', CASE WHEN disk_reads_delta = 0 THEN 'BIND_MISMATCH' END, CASE WHEN module = 'F' THEN 'OPTIMIZER_MISMATCH' END,
   CASE WHEN parsing_schema_name = 'A' THEN 'AUTH_CHECK_MISMATCH' END) AS reasons, count(*) AS children
FROM fx_sqlstat GROUP BY 1""")
def d14(spark, sf):
    s = _fx(spark, sf, "fx_sqlstat").select(
        "sql_id", F.col("plan_hash_value").alias("child_number"),
        F.when(F.col("disk_reads_delta") == 0, "Y").otherwise("N").alias("bind_mismatch"),
        F.when(F.col("module") == "F", "Y").otherwise("N").alias("optimizer_mismatch"),
        F.when(F.col("parsing_schema_name") == "A", "Y").otherwise("N").alias("auth_check_mismatch"))
    r = ST.shared_cursor_reasons(s, {"bind_mismatch": "BIND_MISMATCH", "optimizer_mismatch": "OPTIMIZER_MISMATCH",
                                     "auth_check_mismatch": "AUTH_CHECK_MISMATCH"})
    return r.groupBy("reasons").agg(F.count(F.lit(1)).alias("children"))


@query("d15_cached_blocks", """
WITH b AS (SELECT e.object_id, CASE a.sample_id % 3 WHEN 0 THEN 'xcur' WHEN 1 THEN 'cr' ELSE 'free' END AS status
  FROM fx_block_access a JOIN fx_extent e ON e.file_id = a.file_id AND a.block_no BETWEEN e.block_id AND e.block_id + e.blocks - 1)
SELECT object_id, count(*) AS blocks, CAST(sum(CASE WHEN status = 'xcur' THEN 1 ELSE 0 END) AS BIGINT) AS blocks_xcur,
  CAST(sum(CASE WHEN status = 'cr' THEN 1 ELSE 0 END) AS BIGINT) AS blocks_cr, CAST(sum(CASE WHEN status = 'free' THEN 1 ELSE 0 END) AS BIGINT) AS blocks_free,
  round(count(*) * 100.0 / (SELECT count(*) FROM b), 4) AS pct_of_cache
FROM b GROUP BY 1""")
def d15(spark, sf):
    from ..operators.lookup import resolve_by_range
    st = F.pmod("sample_id", F.lit(3))
    a = _fx(spark, sf, "fx_block_access").select(
        "file_id", "block_no", F.when(st == 0, "xcur").when(st == 1, "cr").otherwise("free").alias("status"))
    # counted per block and status before the range join
    a = a.groupBy("file_id", "block_no", "status").agg(F.count(F.lit(1)).alias("n"))
    r = resolve_by_range(a, _fx(spark, sf, "fx_extent"), ["file_id"], "block_no", "block_id", "blocks", bucket=64)
    out = ST.cached_blocks(r.select("object_id", "status", "n"), weight="n")
    return out.withColumn("blocks_xcur", F.col("blocks_xcur").cast("bigint")) \
              .withColumn("blocks_cr", F.col("blocks_cr").cast("bigint")).withColumn("blocks_free", F.col("blocks_free").cast("bigint"))


@query("d16_result_cache_usage", """
WITH o AS (SELECT o_orderpriority AS name, o_orderdate AS creation_time, o_custkey AS creator_uid,
    CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS row_count, round(o_totalprice) AS row_size_avg FROM orders),
w AS (SELECT *, min(creation_time) OVER (PARTITION BY name) AS f, max(creation_time) OVER (PARTITION BY name) AS l FROM o)
SELECT name, min(creation_time) AS min_creation_time, max(creation_time) AS max_creation_time,
  min(CASE WHEN creation_time = f THEN creator_uid END) AS first_creator, max(CASE WHEN creation_time = l THEN creator_uid END) AS last_creator,
  CAST(sum(row_count) AS BIGINT) AS row_count, round(sum(row_size_avg * row_count) / sum(row_count), 4) AS row_size_avg
FROM w GROUP BY 1""")
def d16(spark, sf):
    o = _fx(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("creation_time"),
                                        F.col("o_custkey").alias("creator_uid"),
                                        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("row_count"),
                                        F.round("o_totalprice").alias("row_size_avg"))
    return ST.result_cache_usage(o)


@query("d17_memory_components", """
SELECT coalesce(CASE WHEN p_size < 20 THEN p_type END, p_name) AS pool, CAST(sum(p_size * 1024) AS BIGINT) AS bytes, count(*) AS components
FROM part GROUP BY 1""")
def d17(spark, sf):
    p = _fx(spark, sf, "part").select(F.when(F.col("p_size") < 20, F.col("p_type")).alias("pool"),
                                      F.col("p_name").alias("name"),
                                      (F.col("p_size").cast("bigint") * 1024).alias("bytes"))
    return ST.memory_components(p)


D12_RANGE = ("1996-03-15 10:00:00", "1996-11-10 00:00:00")


@query("d12_segment_statistics_totals", f"""
WITH b AS (
  SELECT dbid, instance_number,
    coalesce(max(CASE WHEN begin_interval_time <= TIMESTAMP '{D12_RANGE[0]}' THEN snap_id END),
             min(CASE WHEN begin_interval_time >= TIMESTAMP '{D12_RANGE[0]}' THEN snap_id END)) AS lo,
    coalesce(min(CASE WHEN end_interval_time >= TIMESTAMP '{D12_RANGE[1]}' THEN snap_id END),
             max(CASE WHEN end_interval_time <= TIMESTAMP '{D12_RANGE[1]}' THEN snap_id END)) AS hi
  FROM fx_snapshot GROUP BY 1, 2),
inside AS (SELECT s.dbid, s.instance_number, s.snap_id FROM fx_snapshot s JOIN b ON b.dbid = s.dbid AND b.instance_number = s.instance_number
           WHERE s.snap_id BETWEEN b.lo AND b.hi),
s AS (SELECT * FROM fx_seg_stat WHERE (dbid, snap_id, instance_number) IN (SELECT dbid, snap_id, instance_number FROM inside)),
fl AS (SELECT obj, instance_number, min(snap_id) AS f, max(snap_id) AS l FROM s GROUP BY 1, 2),
per AS (SELECT s.obj, s.instance_number, min(s.snap_id) AS min_snap_id, max(s.snap_id) AS max_snap_id,
   sum(logical_reads_delta) AS logical_reads_delta, sum(physical_reads_delta) AS physical_reads_delta, sum(row_lock_waits_delta) AS row_lock_waits_delta,
   max(space_allocated_total) AS max_space_allocated,
   max(CASE WHEN s.snap_id = fl.l THEN space_allocated_total END) - min(CASE WHEN s.snap_id = fl.f THEN space_allocated_total END) AS space_allocated_delta
   FROM s JOIN fl ON fl.obj = s.obj AND fl.instance_number = s.instance_number GROUP BY 1, 2),
w AS (SELECT instance_number, event_id % 2000 + 1 AS obj, count(*) * 10 AS time_waited_secs FROM fx_ash GROUP BY 1, 2),
po AS (SELECT object_owner AS owner, object_name, count(DISTINCT sql_id) AS sql_ids FROM fx_sql_plan GROUP BY 1, 2)
SELECT per.instance_number, o.object_type, o.owner, o.object_name,
  CAST(sum(logical_reads_delta) AS BIGINT) AS logical_reads_delta, CAST(sum(physical_reads_delta) AS BIGINT) AS physical_reads_delta,
  CAST(sum(row_lock_waits_delta) AS BIGINT) AS row_lock_waits_delta, max(max_space_allocated) AS max_space_allocated,
  CAST(sum(space_allocated_delta) AS BIGINT) AS space_allocated_delta, CAST(sum(w.time_waited_secs) AS BIGINT) AS time_waited_secs,
  max(po.sql_ids) AS sql_ids, min(min_snap_id) AS min_snap_id, max(max_snap_id) AS max_snap_id
FROM per LEFT JOIN fx_object_multi o ON o.object_id = per.obj
LEFT JOIN w ON w.instance_number = per.instance_number AND w.obj = per.obj
LEFT JOIN po ON po.owner = o.owner AND po.object_name = o.object_name
GROUP BY 1, 2, 3, 4""")
def d12(spark, sf):
    waits = _fx(spark, sf, "fx_ash").withColumn("current_obj", F.pmod("event_id", F.lit(2000)) + 1)
    return ST.segment_statistics_totals(_fx(spark, sf, "fx_seg_stat"), _fx(spark, sf, "fx_snapshot"),
                                        _fx(spark, sf, "fx_object_multi"), waits, _fx(spark, sf, "fx_sql_plan"), *D12_RANGE) \
        .withColumn("time_waited_secs", F.col("time_waited_secs").cast("bigint"))
