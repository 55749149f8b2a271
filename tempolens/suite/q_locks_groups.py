"""Locks with all their joins (E01), block receive latency by object and now (C16), cache history (F12), work groups and the external queue (G08),
and further forms of C10, C11, F01, F13, G09 and G12."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import counter_reports as CR
from ..plans import locks as LK
from ..plans import queue_reports as Q
from ..plans import sessions as SS
from ..plans import storage as SG
from ..sources import fixture as _fx
from ..sources.fixtures import SEGMENT_MEASURES
from .q_hierarchy import _closure_sql
from .q_queue import RUNS_SQL, USAGE_SQL, _jobs, _runs
from .q_sessions import _modes_sql
from .q_storage import TS_SQL, _ts_inputs
from .registry import query

AS_OF = "1998-08-03 00:00:00"


def _locks_sql(where: str) -> str:
    return f"""
SELECT l.inst_id, l.sid, s.serial_no, s.status, s.module, s.sql_id, lower(lo.owner) AS locked_object_owner, lo.object_name AS locked_object_name,
  lo.object_type AS locked_object_type, x.rollback_segment, l.inst_id || ':' || p.spid || ':' || s.username AS inst_pid_user,
  s.machine || '(' || s.os_user || '):' || s.process || ':' || s.program AS client, l.lock_type,
  CASE WHEN s.lock_wait IS NOT NULL AND l.request <> 0 THEN o.owner || '.' || o.object_name END AS waiting_for_object,
  s.seconds_in_wait AS waiting_secs, l.ctime AS lock_held_secs, l.id1 || ':' || l.id2 AS id1_id2, {_modes_sql('l.request')} AS request,
  {_modes_sql('l.lmode')} AS lock_mode, bs.inst_id AS blocking_inst_id, bs.sid AS blocking_sid, bs.serial_no AS blocking_serial_no
FROM fx_lock l JOIN fx_session_full s ON s.inst_id = l.inst_id AND s.sid = l.sid
JOIN fx_process p ON p.inst_id = s.inst_id AND p.addr = s.process_addr
LEFT JOIN fx_session_full bs ON bs.inst_id = s.blocking_instance AND bs.sid = s.blocking_session
LEFT JOIN fx_object lo ON lo.object_id = l.id1
LEFT JOIN fx_transaction x ON x.inst_id = s.inst_id AND x.addr = s.transaction_addr
LEFT JOIN fx_object o ON o.object_id = CASE WHEN s.p2text = 'object #' THEN s.p2 WHEN s.row_wait_obj = -1 THEN NULL ELSE s.row_wait_obj END
WHERE s.session_type = 'USER' AND {where}"""


def _locks(spark, sf, **options):
    return SS.lock_details(*[_fx(spark, sf, n) for n in ("fx_lock", "fx_session_full", "fx_process", "fx_transaction", "fx_object")], **options)


@query("e01_lock_details", _locks_sql("l.lock_type NOT IN ('AE', 'PS')"))
def e01_details(spark, sf):
    return _locks(spark, sf)


@query("e01_locks_of_a_session", _locks_sql("l.inst_id = 2 AND l.sid = 13"))
def e01_session(spark, sf):
    return _locks(spark, sf, instance=2, sid=13, skip_types=())


@query("c16_latency_now", """
WITH n AS (SELECT f.instance_number, s.stat_name, arg_max(f.value, f.snap_id) AS value
  FROM fx_sysstat f JOIN fx_stat_name s ON s.stat_id = f.stat_id GROUP BY 1, 2)
SELECT t.instance_number AS inst_id, round(t.value / (CASE WHEN b.value = 0 THEN 1 ELSE b.value END) * 10, 6) AS avg_receive_time_ms
FROM n t JOIN n b ON b.instance_number = t.instance_number WHERE t.stat_name = 'redo size' AND b.stat_name = 'physical reads'""")
def c16_now(spark, sf):
    last = _fx(spark, sf, "fx_sysstat").groupBy(F.col("instance_number").alias("inst_id"), "stat_id").agg(F.max_by("value", "snap_id").alias("value"))
    return CR.latency_now(last.join(_fx(spark, sf, "fx_stat_name"), "stat_id"), "redo size", "physical reads")


@query("c16_latency_objects", f"""
SELECT o.owner, o.object_name, CAST(NULL AS VARCHAR) AS subobject_name, {', '.join(f'CAST(sum(s.{m}) AS BIGINT) AS {m}' for m in SEGMENT_MEASURES)}
FROM fx_seg_stat_full s JOIN fx_object_multi o ON o.object_id = s.obj
WHERE s.dbid = 1 AND s.instance_number = 1 AND s.snap_id BETWEEN -20 AND 20
GROUP BY o.owner, o.object_name HAVING sum(s.gc_cr_blocks_received_delta) > 0""")
def c16_objects(spark, sf):
    objects = _fx(spark, sf, "fx_object_multi").withColumn("subobject_name", F.lit(None).cast("string"))
    return CR.latency_objects(_fx(spark, sf, "fx_seg_stat_full"), objects, 1, 1, -20, 20, list(SEGMENT_MEASURES))


def _groups_sql(by: str, other: str = "") -> str:
    return f"""
SELECT {by}, {other}count(*) AS total, CAST(sum(CASE WHEN process_start IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS waiting,
  CAST(sum(CASE WHEN process_start IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS working, min(creation_time) AS min_creation, max(creation_time) AS max_creation,
  max(priority) AS min_prio, min(priority) AS max_prio, round(max((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(creation_time)) / 1000000.0), 3) AS max_age_secs
FROM fx_msg_group GROUP BY {by}"""


@query("g08_groups_by_type", _groups_sql("id_messagetype", "min(id_domain) AS id_domain, "))
def g08_types(spark, sf):
    return Q.group_overview(_fx(spark, sf, "fx_msg_group"), AS_OF)


@query("g08_groups_by_domain", _groups_sql("id_domain"))
def g08_domains(spark, sf):
    return Q.group_overview(_fx(spark, sf, "fx_msg_group"), AS_OF, by="id_domain")


@query("g08_running_groups", f"""
SELECT g.id, g.creation_time, g.id_messagetype, g.priority, (SELECT count(*) FROM fx_group_message m WHERE m.id_bulkgroup = g.id) AS messages,
  round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(g.creation_time)) / 1000000.0, 3) AS age_secs, g.process_start,
  round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(g.process_start)) / 1000000.0, 3) AS in_process_secs
FROM fx_msg_group g WHERE g.process_start IS NOT NULL""")
def g08_running(spark, sf):
    return Q.running_groups(_fx(spark, sf, "fx_msg_group"), _fx(spark, sf, "fx_group_message"), AS_OF)


@query("g08_external_queue", """
SELECT m.id_messagetype, min(m.creation_time) AS min_ts, max(m.creation_time) AS max_ts, count(*) AS messages, min(t.name) AS name
FROM fx_group_message m LEFT JOIN fx_msg_type t ON t.id = m.id_messagetype GROUP BY m.id_messagetype""")
def g08_external(spark, sf):
    return Q.external_queue(_fx(spark, sf, "fx_group_message"), _fx(spark, sf, "fx_msg_type"))


CACHE_FROM, CACHE_TO = "1996-03-01 00:00:00", "1997-06-15 00:00:00"


def _cache_sql(partition: str, where: str) -> str:
    return f"""
WITH s AS (SELECT instance, owner, name, {partition} AS partition_name, CAST(sum(blocks_total) AS BIGINT) AS t, CAST(sum(blocks_dirty) AS BIGINT) AS d
  FROM fx_cache_object WHERE snapshot_ts BETWEEN TIMESTAMP '{CACHE_FROM}' AND TIMESTAMP '{CACHE_TO}' AND {where} GROUP BY snapshot_ts, instance, owner, name, {partition})
SELECT instance, owner, name, partition_name, round(avg(t), 6) AS avg_blocks_total, min(t) AS min_blocks_total, max(t) AS max_blocks_total,
  CAST(sum(t) AS BIGINT) AS sum_blocks_total, round(avg(d), 6) AS avg_blocks_dirty, min(d) AS min_blocks_dirty, max(d) AS max_blocks_dirty, count(*) AS samples
FROM s GROUP BY instance, owner, name, partition_name"""


@query("f12_cache_history_objects", _cache_sql("CAST(NULL AS VARCHAR)", "instance = 1"))
def f12_objects(spark, sf):
    return SG.cache_history(_fx(spark, sf, "fx_cache_object"), CACHE_FROM, CACHE_TO, instance=1)


@query("f12_cache_history_partitions", _cache_sql("partition_name", "1 = 1")
       + " ORDER BY sum_blocks_total DESC, instance, owner, name, partition_name NULLS FIRST LIMIT 100")
def f12_partitions(spark, sf):
    return SG.cache_history(_fx(spark, sf, "fx_cache_object"), CACHE_FROM, CACHE_TO, partitions=True, limit=100)


@query("f12_cache_history_detail", f"""
SELECT snapshot_ts, CAST(sum(blocks_total) AS BIGINT) AS blocks_total, CAST(sum(blocks_dirty) AS BIGINT) AS blocks_dirty FROM fx_cache_object
WHERE snapshot_ts BETWEEN TIMESTAMP '{CACHE_FROM}' AND TIMESTAMP '{CACHE_TO}' AND owner = 'OWNER3' AND name = 'TAB3' AND instance = 1 GROUP BY snapshot_ts""")
def f12_detail(spark, sf):
    return SG.cache_history_detail(_fx(spark, sf, "fx_cache_object"), CACHE_FROM, CACHE_TO, "OWNER3", "TAB3", 1)


@query("f12_cache_history_snapshot", """
SELECT owner, name, partition_name, CAST(sum(blocks_total) AS BIGINT) AS blocks_total, CAST(sum(blocks_dirty) AS BIGINT) AS blocks_dirty
FROM fx_cache_object WHERE snapshot_ts = (SELECT min(snapshot_ts) FROM fx_cache_object WHERE instance = 2) AND instance = 2 GROUP BY 1, 2, 3""")
def f12_snapshot(spark, sf):
    cache = _fx(spark, sf, "fx_cache_object")
    first = cache.where("instance = 2").agg(F.min("snapshot_ts")).scalar()
    return SG.cache_snapshot(cache, first, 2, partitions=True)


@query("c10_mutex_samples", """
SELECT * FROM fx_mutex_sleep WHERE sleep_timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND sleep_timestamp < TIMESTAMP '2024-01-20 12:00:00'
AND inst_id = 1 AND mutex_type = 'click' AND blocking_session = 4""")
def c10_samples(spark, sf):
    return CR.mutex_samples(_fx(spark, sf, "fx_mutex_sleep"), "2024-01-03 00:00:00", "2024-01-20 12:00:00", 1, "click", {"blocking_session": 4})


@query("c11_enqueue_per_snapshot", """
SELECT begin_interval_time, snap_id, total_waits, total_timeouts FROM (
  SELECT s.begin_interval_time, h.snap_id, h.total_waits - lag(h.total_waits, 1, h.total_waits) OVER (ORDER BY h.snap_id) AS total_waits,
    h.total_timeouts - lag(h.total_timeouts, 1, h.total_timeouts) OVER (ORDER BY h.snap_id) AS total_timeouts
  FROM fx_sysevent h JOIN fx_snapshot s ON s.dbid = h.dbid AND s.instance_number = h.instance_number AND s.snap_id = h.snap_id
  WHERE h.dbid = 1 AND h.instance_number = 2 AND h.event_id = 3 AND h.snap_id + 1 >= 1 AND h.snap_id <= 40) t WHERE snap_id >= 1""")
def c11_snapshots(spark, sf):
    snaps = _fx(spark, sf, "fx_snapshot").withColumn("begin_interval_time", F.col("begin_interval_time").cast("timestamp_ntz"))
    return CR.enqueue_per_snapshot(_fx(spark, sf, "fx_sysevent"), snaps, 1, 2, 3, 1, 40)


@query("f01_tablespace_usage_with_redo", f"""
WITH {TS_SQL}
SELECT *, round(CASE WHEN mb_total = 0 THEN NULL ELSE mb_used * 100.0 / mb_total END, 4) AS pct_used FROM (
  SELECT tablespace_name, contents, block_size, mb_total, mb_free, mb_used, autoextensible FROM u UNION ALL
  SELECT 'Redo Inst=' || inst_id, 'Redo-Logfile', min(block_size), round(sum(bytes * members) / 1048576.0, 4), 0, round(sum(bytes * members) / 1048576.0, 4), NULL
  FROM fx_redo_log GROUP BY inst_id) t""")
def f01_redo(spark, sf):
    return SG.tablespace_usage(*_ts_inputs(spark, sf), redo=_fx(spark, sf, "fx_redo_log"))


@query("f13_master_data_tables", f"""
SELECT c.child_table, c.level, t.owner, t.table_type, t.documentation FROM ({_closure_sql("fx_table_ref", "T1")}) c
JOIN fx_table_type t ON t.table_name = c.child_table WHERE t.table_type = 'M' AND t.owner = 'OWN'""")
def f13_master(spark, sf):
    return LK.dependent_tables(_fx(spark, sf, "fx_table_ref"), _fx(spark, sf, "fx_table_type"), "T1", owner="OWN", table_type="M")


@query("g09_history_of_a_job", f"""
WITH {RUNS_SQL}
SELECT runs.job_id, batch_date, start_time, end_time, status, job_name, round((epoch_us(end_time) - epoch_us(start_time)) / 1000000.0, 3) AS runtime_secs
FROM runs JOIN jobs ON jobs.job_id = runs.job_id WHERE runs.job_id = 7 AND start_time > TIMESTAMP '1998-08-03 00:00:00' - INTERVAL 300 DAY""")
def g09_history(spark, sf):
    return Q.job_history(_runs(spark, sf), _jobs(spark, sf), 7, AS_OF)


@query("g12_usage_records", f"""
WITH {USAGE_SQL}
SELECT * FROM p WHERE db = 'db1' AND action = 'a3'""")
def g12_records(spark, sf):
    return Q.usage_records(_fx(spark, sf, "fx_usage_log"), {"db": "db1", "action": "a3"})
