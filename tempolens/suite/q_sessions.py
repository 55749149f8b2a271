"""Lock and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import sessions as SS
from ..plans.ash import ash_dimensions, object_choice
from ..sources import fixture
from .registry import query


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


def _modes_sql(col):
    return "CASE " + col + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in SS.LOCK_MODES.items()) + f" ELSE CAST({col} AS VARCHAR) END"


@query("e01_lock_list", f"""
SELECT l.id1, l.inst_id, l.blocking_session, l.sid, l.lock_addr, l.lock_type, l.id2, l.lmode, l.request, l.ctime,
  s.username, s.module, s.sql_id, bs.username AS blocking_username,
  CASE WHEN l.lock_type = 'TM' THEN lower(o.owner) END AS locked_object_owner, CASE WHEN l.lock_type = 'TM' THEN o.object_name END AS locked_object_name,
  {_modes_sql('l.lmode')} AS lock_mode, {_modes_sql('l.request')} AS request_mode
FROM fx_lock l JOIN fx_session s ON s.inst_id = l.inst_id AND s.sid = l.sid AND s.session_type = 'USER'
LEFT JOIN fx_session bs ON bs.inst_id = l.inst_id AND bs.sid = l.blocking_session
LEFT JOIN fx_object o ON o.object_id = l.id1
WHERE l.lock_type NOT IN ('AE', 'PS')""")
def e01(spark, sf):
    return SS.lock_list(_fx(spark, sf, "fx_lock"), _fx(spark, sf, "fx_session"), _fx(spark, sf, "fx_object"))


@query("e03_holder_waiter_pairs", f"""
SELECT w.inst_id, w.lock_type, w.id1, w.id2, w.sid AS waiter_sid, w.request, w.ctime, h.sid AS holder_sid, h.lmode AS holder_mode,
  {_modes_sql('h.lmode')} AS holder_mode_name, {_modes_sql('w.request')} AS request_mode_name
FROM fx_lock w JOIN fx_lock h ON h.inst_id = w.inst_id AND h.lock_type = w.lock_type AND h.id1 = w.id1 AND h.id2 = w.id2
WHERE h.lmode NOT IN (0, 1) AND h.request IN (0, 1) AND w.lmode IN (0, 1) AND w.request NOT IN (0, 1)""")
def e03(spark, sf):
    return SS.holder_waiter(_fx(spark, sf, "fx_lock"))


@query("e04_lock_history_slices", """
WITH h AS (SELECT *, CAST((day(sample_time) - 1) * 1440 + hour(sample_time) * 60 + minute(sample_time) AS BIGINT) AS minute_no FROM fx_ash)
SELECT minute_no - (minute_no % 60 + 60) % 60 AS slice, instance_number, count(*) AS records, CAST(sum(time_waited) AS BIGINT) AS wait_total,
  CASE WHEN count(DISTINCT CAST(blocking_session AS VARCHAR)) = 1 THEN CAST(min(blocking_session) AS VARCHAR) ELSE '< ' || count(DISTINCT CAST(blocking_session AS VARCHAR)) || ' >' END AS blocking_session,
  CASE WHEN count(DISTINCT sql_id) = 1 THEN min(sql_id) ELSE '< ' || count(DISTINCT sql_id) || ' >' END AS sql_id
FROM h GROUP BY 1, 2""")
def e04(spark, sf):
    h = _fx(spark, sf, "fx_ash").withColumn(
        "minute_no", ((F.dayofmonth("sample_time") - 1) * 1440 + F.hour("sample_time") * 60 + F.minute("sample_time")).cast("bigint"))
    return SS.lock_history_slices(h, "minute_no", 60)


@query("e09_session_list", """
WITH io AS (SELECT instance_number AS inst_id, session_id AS sid, CAST(sum(time_waited) AS BIGINT) AS io_wait, count(*) AS samples FROM fx_ash GROUP BY 1, 2),
tmp AS (SELECT inst_id, sid, CAST(sum(ctime) AS BIGINT) AS lock_seconds FROM fx_lock GROUP BY 1, 2),
lo AS (SELECT DISTINCT instance_number AS inst_id, session_id AS sid FROM fx_ash WHERE event = 'purchase' AND time_waited > 250000)
SELECT s.*, io.io_wait, io.samples, tmp.lock_seconds FROM fx_session s
LEFT JOIN io ON io.inst_id = s.inst_id AND io.sid = s.sid LEFT JOIN tmp ON tmp.inst_id = s.inst_id AND tmp.sid = s.sid
WHERE (coalesce(contains(upper(s.username), 'USER1'), false) OR coalesce(contains(upper(s.module), 'USER1'), false))
  AND NOT EXISTS (SELECT 1 FROM lo WHERE lo.inst_id = s.inst_id AND lo.sid = s.sid)""")
def e09(spark, sf):
    a = _fx(spark, sf, "fx_ash")
    extras = [(a, ["instance_number", "session_id"], {"io_wait": F.sum("time_waited"), "samples": F.count(F.lit(1))}),
              (_fx(spark, sf, "fx_lock"), ["inst_id", "sid"], {"lock_seconds": F.sum("ctime")})]
    long_ops = a.filter((F.col("event") == "purchase") & (F.col("time_waited") > 250000)) \
        .select(F.col("instance_number").alias("inst_id"), F.col("session_id").alias("sid"))
    return SS.session_list(_fx(spark, sf, "fx_session"), extras, "user1", long_ops=long_ops)


@query("e10_session_memory_with_workers", """
WITH p AS (SELECT instance_number AS inst_id, session_id AS sid, coalesce(wait_class, 'CPU') AS category, time_waited AS allocated FROM fx_ash),
w AS (SELECT DISTINCT instance_number AS inst_id, session_id AS sid, session_id % 5 AS qcsid FROM fx_ash WHERE session_id >= 5),
b AS (SELECT inst_id, sid, sid AS qcsid, category, allocated FROM p
      UNION ALL SELECT w.inst_id, w.sid, w.qcsid, p.category, p.allocated FROM w JOIN p ON p.inst_id = w.inst_id AND p.sid = w.sid)
SELECT inst_id, qcsid, category, CAST(sum(allocated) AS BIGINT) AS allocated, count(DISTINCT sid) AS processes FROM b GROUP BY 1, 2, 3""")
def e10(spark, sf):
    a = _fx(spark, sf, "fx_ash")
    proc = a.select(F.col("instance_number").alias("inst_id"), F.col("session_id").alias("sid"),
                    F.coalesce("wait_class", F.lit("CPU")).alias("category"), F.col("time_waited").alias("allocated"))
    workers = a.filter(F.col("session_id") >= 5).select(F.col("instance_number").alias("inst_id"), F.col("session_id").alias("sid"),
                                                        F.pmod("session_id", F.lit(5)).alias("qcsid")).distinct()
    return SS.session_memory(proc, workers)


@query("e11_temp_usage_by_statement", """
SELECT sql_id, CAST(sum(time_waited % 1000) AS BIGINT) AS temp_blocks, count(*) AS segments FROM fx_ash GROUP BY 1""")
def e11(spark, sf):
    u = _fx(spark, sf, "fx_ash").select("sql_id", F.pmod("time_waited", F.lit(1000)).alias("blocks"))
    return SS.temp_usage(u, "sql_id")


@query("e12_enqueue_waits", """
SELECT w.event_id, w.dbid, w.instance_number, w.snap_id, w.total_waits, w.total_timeouts, w.time_waited_micro,
  n.event_name, n.wait_class, substr(n.event_name, 6, 2) AS lock_type
FROM fx_sysevent w JOIN fx_event_name n ON n.event_id = w.event_id WHERE n.event_name LIKE 'enq:%'""")
def e12(spark, sf):
    return SS.enqueue_waits(_fx(spark, sf, "fx_sysevent"), _fx(spark, sf, "fx_event_name"))


# Statement command codes and their names.
OPCODES = {1: "CREATE TABLE", 2: "INSERT", 3: "SELECT", 6: "UPDATE", 7: "DELETE"}


@query("b03_b07_single_samples", "SELECT a.*, s.username, o.object_name, CASE a.event_id % 8 " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in OPCODES.items()) + """ ELSE 'UNKNOWN' END AS operation
FROM (SELECT *, CASE WHEN event = 'purchase' THEN event_id % 2000 + 1 ELSE session_id + 1 END AS object_no FROM fx_ash) a
LEFT JOIN (SELECT inst_id AS instance_number, sid AS session_id, username FROM fx_session) s ON s.instance_number = a.instance_number AND s.session_id = a.session_id
LEFT JOIN (SELECT object_id AS object_no, object_name FROM fx_object) o ON o.object_no = a.object_no
WHERE a.event = 'error' AND a.instance_number = 1""")
def b03(spark, sf):
    a = _fx(spark, sf, "fx_ash").withColumn("p2text", F.when(F.col("event") == "purchase", F.lit("object #")).otherwise(F.lit("x"))) \
        .withColumn("p2", F.pmod("event_id", F.lit(2000)) + 1).withColumn("current_obj", F.col("session_id") + 1)
    a = a.withColumn("object_no", object_choice()).drop("p2text", "p2", "current_obj")
    users = _fx(spark, sf, "fx_session").select(F.col("inst_id").alias("instance_number"), F.col("sid").alias("session_id"), "username")
    objs = _fx(spark, sf, "fx_object").select(F.col("object_id").alias("object_no"), "object_name")
    out = SS.single_samples(a.withColumn("_op", F.pmod("event_id", F.lit(8))), ash_dimensions(a.columns),
                            {"event": "error", "instance": 1},
                            [(users, ["instance_number", "session_id"]), (objs, ["object_no"])], "_op", OPCODES)
    return out.drop("_op")
