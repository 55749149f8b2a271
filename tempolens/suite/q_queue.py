"""Queue, batch job and usage-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import queue_reports as Q
from ..sources import fixture
from .registry import query


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


def _limits(m):
    return m.select("id_messagetype").distinct().select(
        "id_messagetype",
        (F.lit(86400 * 30) * (1 + F.pmod("id_messagetype", F.lit(3)))).cast("bigint").alias("warning_secs"),
        (F.lit(86400 * 60) * (1 + F.pmod("id_messagetype", F.lit(3)))).cast("bigint").alias("alert_secs"))


LIMITS_SQL = """lim AS (SELECT DISTINCT id_messagetype, CAST(86400 * 30 * (1 + id_messagetype % 3) AS BIGINT) AS warning_secs,
                    CAST(86400 * 60 * (1 + id_messagetype % 3) AS BIGINT) AS alert_secs FROM fx_message)"""


@query("g01_queue_overview", """
WITH m AS (SELECT id_messagetype, count(*) AS messages, CAST(sum(CASE WHEN erroneous = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS working,
   CAST(sum(CASE WHEN erroneous = 'Y' THEN 1 ELSE 0 END) AS BIGINT) AS erroneous, count(DISTINCT run_count) AS priorities,
   count(DISTINCT id_bulkgroup) AS groups FROM fx_message GROUP BY 1),
c AS (SELECT sub_key AS id_messagetype, CAST(sum(CASE WHEN code = 4532 THEN counter ELSE 0 END) AS BIGINT) AS incoming FROM fx_aspect GROUP BY 1)
SELECT coalesce(m.id_messagetype, c.id_messagetype) AS id_messagetype, messages, working, erroneous, priorities, groups, incoming
FROM m FULL OUTER JOIN c ON c.id_messagetype = m.id_messagetype""")
def g01(spark, sf):
    return Q.queue_overview(_fx(spark, sf, "fx_message"), _fx(spark, sf, "fx_aspect"))


@query("g02_queue_sla", f"""
WITH {LIMITS_SQL}
SELECT m.id_messagetype, count(*) AS open_messages,
  CAST(sum(CASE WHEN (epoch_us(TIMESTAMP '1998-08-03 00:00:00') - epoch_us(creation_time)) / 1000000.0 > warning_secs THEN 1 ELSE 0 END) AS BIGINT) AS warnings,
  CAST(sum(CASE WHEN (epoch_us(TIMESTAMP '1998-08-03 00:00:00') - epoch_us(creation_time)) / 1000000.0 > alert_secs THEN 1 ELSE 0 END) AS BIGINT) AS alerts,
  min(creation_time) AS oldest
FROM fx_message m LEFT JOIN lim l ON l.id_messagetype = m.id_messagetype WHERE erroneous = 'N' GROUP BY 1""")
def g02(spark, sf):
    m = _fx(spark, sf, "fx_message")
    return Q.queue_sla(m, _limits(m), "1998-08-03 00:00:00")


@query("g03_limits_exceeded", """
SELECT id_messagetype, count(*) AS errors FROM fx_message WHERE erroneous = 'Y' GROUP BY 1 HAVING count(*) > 620""")
def g03(spark, sf):
    return Q.limits_exceeded(_fx(spark, sf, "fx_message"), 620)


@query("g03_recent_events", """
SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE""")
def g03b(spark, sf):
    return Q.recent_events(_fx(spark, sf, "events"), "ts", 60)


def _g04_sql():
    cols = ", ".join(f"CAST(sum(CASE WHEN code = {c} THEN counter ELSE 0 END) AS BIGINT) AS {n}" for n, c in Q.ASPECT_CODES.items())
    return f"""
WITH p AS (SELECT sub_key, minute - (minute % 6 + 6) % 6 AS slice, {cols} FROM fx_aspect GROUP BY 1, 2),
cur AS (SELECT id_messagetype AS sub_key, count(*) AS current_length FROM fx_message WHERE erroneous = 'N' GROUP BY 1)
SELECT p.*, incoming AS inflow, first_try_success + retry_success + final_error AS outflow, cur.current_length,
  CAST(coalesce(cur.current_length, 0) - sum(incoming - (first_try_success + retry_success + final_error))
       OVER (PARTITION BY p.sub_key ORDER BY slice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS queue_length_before
FROM p LEFT JOIN cur ON cur.sub_key = p.sub_key"""


@query("g04_type_history", _g04_sql())
def g04(spark, sf):
    return Q.type_history(_fx(spark, sf, "fx_aspect"), _fx(spark, sf, "fx_message"), 6)


@query("g05_slice_details_by_type", "SELECT sub_key, " + ", ".join(
    f"CAST(sum(CASE WHEN code = {c} THEN counter ELSE 0 END) AS BIGINT) AS {n}" for n, c in Q.ASPECT_CODES.items())
    + " FROM fx_aspect WHERE sub_key IN (SELECT DISTINCT id_messagetype FROM fx_message WHERE run_count <= 2) GROUP BY 1")
def g05(spark, sf):
    domain = _fx(spark, sf, "fx_message").filter(F.col("run_count") <= 2).select(F.col("id_messagetype").alias("sub_key")).distinct()
    return Q.slice_details(_fx(spark, sf, "fx_aspect"), "sub_key", domain)


@query("g06_derived_queue_measures", """
SELECT id_messagetype, CAST(sum(run_count) AS BIGINT) AS elapsed, count(*) AS messages, count(DISTINCT id_bulkgroup) AS groups,
  round(CASE WHEN count(*) = 0 THEN NULL ELSE sum(run_count) / count(*) END, 4) AS elapsed_per_message,
  round(CASE WHEN count(DISTINCT id_bulkgroup) = 0 THEN NULL ELSE count(*) / count(DISTINCT id_bulkgroup) END, 4) AS messages_per_group,
  round(CASE WHEN count(DISTINCT id_bulkgroup) = 0 THEN NULL ELSE sum(run_count) / count(DISTINCT id_bulkgroup) END, 4) AS elapsed_per_group
FROM fx_message GROUP BY 1""")
def g06(spark, sf):
    g = _fx(spark, sf, "fx_message").groupBy("id_messagetype").agg(
        F.sum("run_count").alias("elapsed"), F.count(F.lit(1)).alias("messages"), F.count_distinct("id_bulkgroup").alias("groups"))
    return Q.derived_queue_measures(g, "elapsed", "messages", "groups")


@query("g07_error_messages_top", """
SELECT m.id_messagetype, m.id % 4 AS id_exception, m.id, m.creation_time, m.erroneous, m.id_bulkgroup, m.run_count,
  'type' || CAST(m.id_messagetype AS VARCHAR) AS type_name, e.exception_name
FROM fx_message m LEFT JOIN (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS id_exception, n_name AS exception_name FROM nation) e ON e.id_exception = m.id % 4
WHERE erroneous = 'Y' ORDER BY creation_time DESC, id DESC LIMIT 25""")
def g07(spark, sf):
    m = _fx(spark, sf, "fx_message").withColumn("id_exception", F.pmod("id", F.lit(4)))
    types = m.select("id_messagetype").distinct().withColumn("type_name", F.concat(F.lit("type"), F.col("id_messagetype").cast("string")))
    exc = _fx(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id_exception"),
                                          F.col("n_name").alias("exception_name")).distinct()
    return Q.error_messages(m, types, exc, 25)


@query("g08_work_groups", """
WITH g AS (SELECT id_messagetype, id_bulkgroup, count(*) AS messages, min(creation_time) AS first_created,
   max(CASE WHEN erroneous = 'N' THEN 1 ELSE 0 END) AS w FROM fx_message WHERE id_bulkgroup IS NOT NULL GROUP BY 1, 2)
SELECT id_messagetype, count(*) AS groups, CAST(sum(w) AS BIGINT) AS working_groups, CAST(sum(1 - w) AS BIGINT) AS waiting_groups,
  CAST(sum(messages) AS BIGINT) AS messages,
  round(max((epoch_us(TIMESTAMP '1998-08-03 00:00:00') - epoch_us(first_created)) / 1000000.0), 3) AS max_age_secs
FROM g GROUP BY 1""")
def g08(spark, sf):
    return Q.work_groups(_fx(spark, sf, "fx_message"), "1998-08-03 00:00:00")


def _runs(spark, sf):
    o = _fx(spark, sf, "orders")
    start = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.pmod("o_orderkey", F.lit(24)).cast("int"))
    end = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(F.floor("o_totalprice"), F.lit(7200)).cast("decimal(18,6)"))
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    return o.select(F.pmod("o_custkey", F.lit(50)).alias("job_id"), F.col("o_orderdate").alias("batch_date"),
                    start.alias("start_time"), F.when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise(end)
                    .cast("timestamp_ntz").alias("end_time"), status.alias("status"))


RUNS_SQL = """runs AS (SELECT o_custkey % 50 AS job_id, o_orderdate AS batch_date, o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS start_time,
   CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) + to_seconds(CAST(floor(o_totalprice) % 7200 AS BIGINT)) END AS end_time,
   CASE WHEN o_orderstatus = 'F' THEN 'SUCCESS' WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status FROM orders),
jobs AS (SELECT DISTINCT o_custkey % 50 AS job_id, 'job' || CAST(o_custkey % 50 AS VARCHAR) AS job_name FROM orders)"""


def _jobs(spark, sf):
    return _fx(spark, sf, "orders").select(F.pmod("o_custkey", F.lit(50)).alias("job_id")).distinct() \
        .withColumn("job_name", F.concat(F.lit("job"), F.col("job_id").cast("string")))


@query("g09_job_runs_of_batch_date", f"""
WITH {RUNS_SQL},
r AS (SELECT runs.job_id, batch_date, start_time, end_time, status, job_name,
        round((epoch_us(end_time) - epoch_us(start_time)) / 1000000.0, 3) AS runtime_secs
      FROM runs LEFT JOIN jobs ON jobs.job_id = runs.job_id WHERE batch_date = TIMESTAMP '1995-03-15 00:00:00')
SELECT *, round((SELECT sum(epoch_us(end_time) - epoch_us(start_time)) FROM r WHERE job_id NOT IN (1, 2)) / 1e6, 3) AS total_runtime_secs FROM r""")
def g09(spark, sf):
    return Q.job_runs(_runs(spark, sf), _jobs(spark, sf), "1995-03-15 00:00:00", exclude=[1, 2])


@query("g10_daily_runtime", f"""
WITH {RUNS_SQL}
SELECT batch_date, round(sum(epoch_us(end_time) - epoch_us(start_time)) / 3.6e9, 4) AS hours_total,
  round(sum(CASE WHEN hour(start_time) >= 20 OR hour(start_time) < 6 THEN epoch_us(end_time) - epoch_us(start_time) ELSE 0 END) / 3.6e9, 4) AS hours_night,
  round(sum(CASE WHEN NOT (hour(start_time) >= 20 OR hour(start_time) < 6) THEN epoch_us(end_time) - epoch_us(start_time) ELSE 0 END) / 3.6e9, 4) AS hours_day,
  count(DISTINCT job_id) AS jobs, strftime(batch_date, '%A') AS weekday
FROM runs WHERE end_time IS NOT NULL GROUP BY 1""")
def g10(spark, sf):
    return Q.daily_runtime(_runs(spark, sf))


@query("g11_running_jobs", f"""
WITH {RUNS_SQL}
SELECT runs.*, jobs.job_name FROM runs LEFT JOIN jobs ON jobs.job_id = runs.job_id
WHERE end_time IS NULL AND status <> 'SUCCESS' AND start_time >= (SELECT max(start_time) FROM runs) - INTERVAL 30 DAY""")
def g11(spark, sf):
    out = Q.running_jobs(_runs(spark, sf), _jobs(spark, sf), 30)
    return out.select("job_id", "batch_date", "start_time", "end_time", "status", "job_name")


USAGE_SQL = """p AS (SELECT split_part(line, ' ', 1) AS ip, split_part(line, ' ', 2) AS db, split_part(line, ' ', 3) AS month,
   split_part(line, ' ', 4) AS controller, split_part(line, ' ', 5) AS action, split_part(line, ' ', 6) AS request_id FROM fx_usage_log)"""


@query("g12_usage_by_month", f"""
WITH {USAGE_SQL}
SELECT month, count(*) AS requests, count(DISTINCT db) AS databases, count(DISTINCT ip) AS clients,
  count(DISTINCT controller) AS controllers, count(DISTINCT action) AS actions FROM p GROUP BY 1""")
def g12(spark, sf):
    return Q.usage_by_month(_fx(spark, sf, "fx_usage_log"))


@query("g12_usage_by_key_filtered", f"""
WITH {USAGE_SQL}
SELECT controller, count(*) AS requests FROM p WHERE db = 'db1' AND action = 'a3' GROUP BY 1""")
def g12b(spark, sf):
    return Q.usage_by_key(_fx(spark, sf, "fx_usage_log"), "controller", {"db": "db1", "action": "a3"})


@query("g13_application_label", """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Application = ' || CAST(o_custkey % 7 AS VARCHAR)
                                   WHEN 1 THEN 'ID_WSMethod = ' || CAST(o_custkey % 30 AS VARCHAR)
                                   ELSE 'ID_OFMsgType = ' || CAST(o_custkey % 9 AS VARCHAR) END AS info FROM orders),
x AS (SELECT t.*, CAST(regexp_extract(info, '(\\d+)$', 1) AS BIGINT) AS n FROM t)
SELECT coalesce(CASE WHEN info LIKE 'Application = %' THEN coalesce(r.r_name, 'Application not found for ' || info)
                     WHEN info LIKE 'ID_WSMethod = %' THEN coalesce(na.n_name, 'WSMethod not found for ' || info)
                     ELSE coalesce(mt.name, 'OFMessagetype not found for ' || info) END, '') AS short_info, count(*) AS texts
FROM x LEFT JOIN region r ON info LIKE 'Application = %' AND r.r_regionkey = x.n
LEFT JOIN nation na ON info LIKE 'ID_WSMethod = %' AND na.n_nationkey = x.n
LEFT JOIN (SELECT DISTINCT id_messagetype AS id, 'type' || CAST(id_messagetype AS VARCHAR) AS name FROM fx_message) mt ON info LIKE 'ID_OFMsgType = %' AND mt.id = x.n
GROUP BY 1""")
def g13(spark, sf):
    o = _fx(spark, sf, "orders")
    k = F.pmod("o_orderkey", F.lit(3))
    info = F.when(k == 0, F.concat(F.lit("Application = "), F.pmod("o_custkey", F.lit(7)).cast("string"))) \
        .when(k == 1, F.concat(F.lit("ID_WSMethod = "), F.pmod("o_custkey", F.lit(30)).cast("string"))) \
        .otherwise(F.concat(F.lit("ID_OFMsgType = "), F.pmod("o_custkey", F.lit(9)).cast("string")))
    t = o.select("o_orderkey", info.alias("info"))
    apps = _fx(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))
    ws = _fx(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    types = _fx(spark, sf, "fx_message").select(F.col("id_messagetype").alias("id")).distinct() \
        .withColumn("name", F.concat(F.lit("type"), F.col("id").cast("string")))
    lab = Q.application_label(t, "info", apps, ws, types)
    return lab.groupBy(F.coalesce("short_info", F.lit("")).alias("short_info")).agg(F.count(F.lit(1)).alias("texts"))
