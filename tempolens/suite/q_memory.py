"""Memory, redo, undo, segment and cursor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import counter_reports as CR
from ..plans import statements as ST
from ..sources import fixture
from .registry import query


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


PGA_NAMES = {"user commits": "processed", "user rollbacks": "extra", "physical reads": "allocated", "redo size": "freed"}


@query("c17_memory_history", """
WITH w AS (SELECT st.dbid, st.instance_number, st.snap_id,
    CAST(sum(CASE WHEN n.stat_name = 'user commits' THEN st.value END) AS BIGINT) AS processed,
    CAST(sum(CASE WHEN n.stat_name = 'user rollbacks' THEN st.value END) AS BIGINT) AS extra,
    CAST(sum(CASE WHEN n.stat_name = 'physical reads' THEN st.value END) AS BIGINT) AS allocated,
    CAST(sum(CASE WHEN n.stat_name = 'redo size' THEN st.value END) AS BIGINT) AS freed
  FROM fx_sysstat st JOIN fx_stat_name n ON n.stat_id = st.stat_id GROUP BY 1, 2, 3),
d AS (SELECT *, processed - lag(processed, 1, processed) OVER (PARTITION BY dbid, instance_number ORDER BY snap_id) AS processed_delta,
        freed - lag(freed, 1, freed) OVER (PARTITION BY dbid, instance_number ORDER BY snap_id) AS freed_delta FROM w)
SELECT d.*, round(CASE WHEN processed + extra = 0 THEN NULL ELSE processed * 100.0 / (processed + extra) END, 4) AS hit_pct,
  CAST(s.begin_interval_time AS TIMESTAMP) AS begin_interval_time
FROM d JOIN fx_snapshot s ON s.dbid = d.dbid AND s.instance_number = d.instance_number AND s.snap_id = d.snap_id""")
def c17(spark, sf):
    eav = _fx(spark, sf, "fx_sysstat").join(_fx(spark, sf, "fx_stat_name"), "stat_id") \
        .select("dbid", "instance_number", "snap_id", F.col("stat_name").alias("name"), "value")
    return CR.memory_history(eav, _fx(spark, sf, "fx_snapshot"), PGA_NAMES, ["processed", "freed"], hit=("processed", "extra"))


@query("c18_memory_per_instance", """
SELECT instance_number AS inst_id, CAST(sum(time_waited) AS BIGINT) AS total, round(avg(time_waited), 4) AS avg_per_process, count(*) AS processes
FROM fx_ash GROUP BY 1""")
def c18(spark, sf):
    m = _fx(spark, sf, "fx_ash").select(F.col("instance_number").alias("inst_id"), F.col("time_waited").alias("allocated"))
    return CR.memory_per_instance(m)


FACTORS = [1, 2, 3]


@query("c19_cache_advice", """
WITH a AS (SELECT dbid, instance_number, snap_id, event_id AS size_factor, total_waits AS physical_reads FROM fx_sysevent WHERE event_id IN (1, 2, 3)),
d AS (SELECT *, physical_reads - lag(physical_reads, 1, physical_reads) OVER (PARTITION BY dbid, instance_number, size_factor ORDER BY snap_id) AS delta FROM a)
SELECT dbid, instance_number, snap_id, """ + ", ".join(f"CAST(sum(CASE WHEN size_factor = {f} THEN delta END) AS BIGINT) AS factor_{f}" for f in FACTORS)
       + " FROM d WHERE delta >= 0 GROUP BY 1, 2, 3")
def c19(spark, sf):
    a = _fx(spark, sf, "fx_sysevent").filter(F.col("event_id").isin(*FACTORS)).select(
        "dbid", "instance_number", "snap_id", F.col("event_id").alias("size_factor"), F.col("total_waits").alias("physical_reads"))
    return CR.cache_advice(a, FACTORS)


@query("c20_redo_history", """
WITH l AS (SELECT 1 AS dbid, CAST(id_messagetype % 2 + 1 AS INT) AS instance_number, CAST((year(creation_time) - 1995) * 12 + month(creation_time) AS INT) AS snap_id,
   CASE run_count WHEN 1 THEN 'CURRENT' WHEN 2 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status FROM fx_message)
SELECT l.dbid, l.instance_number, l.snap_id, count(*) AS logs, CAST(sum(CASE WHEN status = 'CURRENT' THEN 1 ELSE 0 END) AS BIGINT) AS current,
  CAST(sum(CASE WHEN status = 'ACTIVE' THEN 1 ELSE 0 END) AS BIGINT) AS active, CAST(sum(CASE WHEN status = 'INACTIVE' THEN 1 ELSE 0 END) AS BIGINT) AS inactive,
  CAST(s.begin_interval_time AS TIMESTAMP) AS begin_interval_time
FROM l JOIN fx_snapshot s ON s.dbid = l.dbid AND s.instance_number = l.instance_number AND s.snap_id = l.snap_id GROUP BY 1, 2, 3, 8""")
def c20(spark, sf):
    m = _fx(spark, sf, "fx_message")
    logs = m.select(F.lit(1).alias("dbid"), (F.pmod("id_messagetype", F.lit(2)) + 1).cast("int").alias("instance_number"),
                    ((F.year("creation_time") - 1995) * 12 + F.month("creation_time")).cast("int").alias("snap_id"),
                    F.when(F.col("run_count") == 1, "CURRENT").when(F.col("run_count") == 2, "ACTIVE").otherwise("INACTIVE").alias("status"))
    out = CR.redo_history(logs, _fx(spark, sf, "fx_snapshot"))
    return out.select("dbid", "instance_number", "snap_id", "logs", *[F.col(c).cast("bigint").alias(c) for c in ("current", "active", "inactive")],
                      "begin_interval_time")


@query("c21_undo_history", """
SELECT ts AS begin_time, user_id, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""")
def c21(spark, sf):
    u = _fx(spark, sf, "events").select(F.col("ts").alias("begin_time"), "user_id", "event_type", "value")
    return CR.undo_history(u, "2024-01-10 00:00:00", "2024-01-12 00:00:00")


@query("d13_segment_stats_per_snapshot", """
SELECT s.owner, s.segment_name, CAST(s.gather_date AS TIMESTAMP) AS gather_date, CAST(sum(size_units) AS BIGINT) AS size_units, count(*) AS segments
FROM fx_seg_size s WHERE (s.owner, s.segment_name) IN (SELECT owner, segment_name FROM fx_seg_size WHERE segment_type = 'P')
GROUP BY 1, 2, 3""")
def d13(spark, sf):
    s = _fx(spark, sf, "fx_seg_size").withColumn("gather_date", F.col("gather_date").cast("timestamp_ntz"))
    return ST.segment_stats_per_snapshot(s, s.filter(F.col("segment_type") == "P"))


@query("d18_open_cursors_with_workareas", """
WITH c AS (SELECT sql_id, count(*) AS open_cursors, count(DISTINCT sid) AS sessions FROM fx_open_cursor GROUP BY 1),
w AS (SELECT sql_id, CAST(sum(time_waited) AS BIGINT) AS work_area_bytes FROM fx_ash WHERE event = 'purchase' GROUP BY 1)
SELECT c.*, w.work_area_bytes FROM c LEFT JOIN w ON w.sql_id = c.sql_id""")
def d18(spark, sf):
    oc = _fx(spark, sf, "fx_open_cursor").withColumnRenamed("sid", "session_id")
    wa = _fx(spark, sf, "fx_ash").filter(F.col("event") == "purchase").select("sql_id", F.col("time_waited").alias("actual_mem_used"))
    return ST.open_cursors(oc, wa)
