"""Counter family queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import minute_slice, overlaps, round_time, time_bucket, trunc_time
from ..operators import counters as C
from ..operators import history as H
from ..plans import counter_reports as R
from ..sources import fixture
from .registry import query

LAG = "counter_value - lag(counter_value, 1, counter_value) OVER (PARTITION BY series_id ORDER BY snap_id)"


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


@query("a01_counter_delta_drop", f"""
SELECT series_id, snap_id, counter_value FROM (
  SELECT series_id, snap_id, instance_number, snap_time, {LAG} AS counter_value FROM fx_counter) t
WHERE counter_value >= 0""")
def a01_drop(spark, sf):
    d = C.counter_delta(_fx(spark, sf, "fx_counter"), ["series_id"], "snap_id", ["counter_value"], "drop")
    return d.select("series_id", "snap_id", "counter_value")


@query("a01_counter_delta_positive_chunked", f"""
SELECT series_id, snap_id, counter_value FROM (
  SELECT series_id, snap_id, {LAG} AS counter_value FROM fx_counter) t
WHERE counter_value > 0""")
def a01_positive(spark, sf):
    d = C.counter_delta(_fx(spark, sf, "fx_counter"), ["series_id"], "snap_id", ["counter_value"],
                        "positive", chunk=F.to_date("snap_time"))
    return d.select("series_id", "snap_id", "counter_value")


@query("a01_counter_delta_keep", f"""
SELECT series_id, snap_id, {LAG} AS counter_value FROM fx_counter""")
def a01_keep(spark, sf):
    d = C.counter_delta(_fx(spark, sf, "fx_counter"), ["series_id"], "snap_id", ["counter_value"], "keep")
    return d.select("series_id", "snap_id", "counter_value")


@query("a03_drop_first_snapshot", """
SELECT series_id, instance_number, snap_id, counter_value FROM fx_counter c
WHERE snap_id <> (SELECT min(snap_id) FROM fx_counter m WHERE m.instance_number = c.instance_number)""")
def a03(spark, sf):
    d = C.drop_first_snapshot(_fx(spark, sf, "fx_counter"), ["instance_number"], "snap_id")
    return d.select("series_id", "instance_number", "snap_id", "counter_value")


@query("a04_first_last_delta", """
SELECT g.counter_name, CAST(l.gets - f.gets AS BIGINT) AS gets, CAST(l.misses - f.misses AS BIGINT) AS misses,
       f.snap_id AS first_snap_id, l.snap_id AS last_snap_id
FROM (SELECT counter_name, min(snap_id) AS a, max(snap_id) AS b FROM fx_counter_multi GROUP BY 1) g
JOIN (SELECT counter_name, snap_id, max(gets) AS gets, max(misses) AS misses FROM fx_counter_multi GROUP BY 1, 2) f ON f.counter_name = g.counter_name AND f.snap_id = g.a
JOIN (SELECT counter_name, snap_id, max(gets) AS gets, max(misses) AS misses FROM fx_counter_multi GROUP BY 1, 2) l ON l.counter_name = g.counter_name AND l.snap_id = g.b""")
def a04(spark, sf):
    # ties on the order key: the struct order takes the largest counters of the tied rows,
    # as MAX() KEEP (DENSE_RANK LAST) does for the last and ... FIRST with max for the first
    d = _fx(spark, sf, "fx_counter_multi")
    g = d.groupBy("counter_name", "snap_id").agg(F.max("gets").alias("gets"), F.max("misses").alias("misses"))
    return C.first_last_delta(g, ["counter_name"], "snap_id", ["gets", "misses"]).withColumnRenamed(
        "first_snap_id", "first_snap_id")


@query("a07_time_bucket_15min", """
SELECT (date_trunc('day', ts) + to_seconds(CAST(floor(date_diff('second', date_trunc('day', ts), ts) / 900) * 900 AS BIGINT))) AS slot,
       CAST(count(*) AS BIGINT) AS n, CAST(sum(round(value * 100)) AS BIGINT) AS value_cents
FROM events GROUP BY 1""")
def a07(spark, sf):
    e = _fx(spark, sf, "events")
    return e.groupBy(time_bucket("ts", 900).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("value_cents"))


@query("a07_time_bucket_7min_day_aligned", """
SELECT (date_trunc('day', ts) + to_seconds(CAST(floor(date_diff('second', date_trunc('day', ts), ts) / 420) * 420 AS BIGINT))) AS slot,
       CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1""")
def a07b(spark, sf):
    return _fx(spark, sf, "events").groupBy(time_bucket("ts", 420).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("a08_trunc_time_units", """
SELECT 'MI' AS unit, date_trunc('minute', ts) AS t, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2
UNION ALL SELECT 'HH24', date_trunc('hour', ts), count(*) FROM events GROUP BY 1, 2
UNION ALL SELECT 'DD', date_trunc('day', ts), count(*) FROM events GROUP BY 1, 2
UNION ALL SELECT 'WW', date_trunc('week', ts), count(*) FROM events GROUP BY 1, 2
UNION ALL SELECT 'MM', date_trunc('month', ts), count(*) FROM events GROUP BY 1, 2""")
def a08(spark, sf):
    e = _fx(spark, sf, "events")
    out = None
    for u in ["MI", "HH24", "DD", "WW", "MM"]:
        part = e.groupBy(trunc_time("ts", u).alias("t")).agg(F.count(F.lit(1)).alias("n")) \
                .select(F.lit(u).alias("unit"), "t", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("a09_minute_slice", """
SELECT sub_key, minute - (minute % 5 + 5) % 5 AS slice, CAST(sum(counter) AS BIGINT) AS counter
FROM fx_aspect GROUP BY 1, 2""")
def a09(spark, sf):
    a = _fx(spark, sf, "fx_aspect")
    return a.groupBy("sub_key", minute_slice("minute", 5).alias("slice")).agg(F.sum("counter").alias("counter"))


@query("a10_round_time_minute", """
SELECT date_trunc('minute', ts + INTERVAL 30 SECOND) AS t, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def a10(spark, sf):
    return _fx(spark, sf, "events").groupBy(round_time("ts", "MI").alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query("a11_overlap_filter", """
SELECT instance_number, CAST(count(*) AS BIGINT) AS n FROM fx_snapshot
WHERE begin_interval_time < TIMESTAMP '1996-06-15 00:00:00' AND end_interval_time >= TIMESTAMP '1996-02-10 00:00:00'
GROUP BY 1""")
def a11(spark, sf):
    s = _fx(spark, sf, "fx_snapshot")
    return (s.filter(overlaps("begin_interval_time", "end_interval_time",
                              F.lit("1996-02-10 00:00:00").cast("timestamp_ntz"),
                              F.lit("1996-06-15 00:00:00").cast("timestamp_ntz")))
            .groupBy("instance_number").agg(F.count(F.lit(1)).alias("n")))


SNAP_RANGE = ("1996-01-01 00:00:00", "1997-12-31 00:00:00")


@query("a12_snapshot_bounds", f"""
SELECT dbid, instance_number, min(snap_id) AS min_snap_id, max(snap_id) AS max_snap_id FROM fx_snapshot
WHERE begin_interval_time >= TIMESTAMP '{SNAP_RANGE[0]}' AND begin_interval_time <= TIMESTAMP '{SNAP_RANGE[1]}'
GROUP BY 1, 2""")
def a12(spark, sf):
    return H.snapshot_bounds(_fx(spark, sf, "fx_snapshot"), *SNAP_RANGE)


BORDER_RANGE = ("1996-03-15 10:00:00", "1996-09-10 00:00:00")


@query("a13_snapshot_borders", f"""
WITH b AS (
  SELECT dbid, instance_number,
    coalesce(max(CASE WHEN begin_interval_time <= TIMESTAMP '{BORDER_RANGE[0]}' THEN snap_id END),
             min(CASE WHEN begin_interval_time >= TIMESTAMP '{BORDER_RANGE[0]}' THEN snap_id END)) AS start_snap_id,
    coalesce(min(CASE WHEN end_interval_time >= TIMESTAMP '{BORDER_RANGE[1]}' THEN snap_id END),
             max(CASE WHEN end_interval_time <= TIMESTAMP '{BORDER_RANGE[1]}' THEN snap_id END)) AS end_snap_id
  FROM fx_snapshot GROUP BY 1, 2)
SELECT b.dbid, b.instance_number, b.start_snap_id, b.end_snap_id,
       CAST(s.begin_interval_time AS TIMESTAMP) AS start_time, CAST(e.end_interval_time AS TIMESTAMP) AS end_time
FROM b LEFT JOIN fx_snapshot s ON s.dbid = b.dbid AND s.instance_number = b.instance_number AND s.snap_id = b.start_snap_id
LEFT JOIN fx_snapshot e ON e.dbid = b.dbid AND e.instance_number = b.instance_number AND e.snap_id = b.end_snap_id""")
def a13(spark, sf):
    b = H.snapshot_borders(_fx(spark, sf, "fx_snapshot"), *BORDER_RANGE)
    return b.withColumn("start_time", F.col("start_time").cast("timestamp_ntz")) \
            .withColumn("end_time", F.col("end_time").cast("timestamp_ntz"))


@query("a14_range_join_snaps", f"""
WITH b AS (
  SELECT dbid, instance_number,
    coalesce(max(CASE WHEN begin_interval_time <= TIMESTAMP '{BORDER_RANGE[0]}' THEN snap_id END),
             min(CASE WHEN begin_interval_time >= TIMESTAMP '{BORDER_RANGE[0]}' THEN snap_id END)) AS lo,
    coalesce(min(CASE WHEN end_interval_time >= TIMESTAMP '{BORDER_RANGE[1]}' THEN snap_id END),
             max(CASE WHEN end_interval_time <= TIMESTAMP '{BORDER_RANGE[1]}' THEN snap_id END)) AS hi
  FROM fx_snapshot GROUP BY 1, 2)
SELECT s.instance_number, s.sql_id, CAST(sum(s.executions_delta) AS BIGINT) AS executions,
       CAST(sum(s.elapsed_time_delta) AS BIGINT) AS elapsed_time
FROM fx_sqlstat s JOIN b ON b.dbid = s.dbid AND b.instance_number = s.instance_number
WHERE s.snap_id BETWEEN b.lo AND b.hi GROUP BY 1, 2""")
def a14(spark, sf):
    b = H.snapshot_borders(_fx(spark, sf, "fx_snapshot"), *BORDER_RANGE)
    f = H.range_join_snaps(_fx(spark, sf, "fx_sqlstat"), b)
    return f.groupBy("instance_number", "sql_id").agg(F.sum("executions_delta").alias("executions"),
                                                      F.sum("elapsed_time_delta").alias("elapsed_time"))


EV_DELTA = """
WITH ss AS (SELECT dbid, instance_number, min(snap_id) AS min_snap_id, max(snap_id) AS max_snap_id FROM fx_snapshot
            WHERE begin_interval_time >= TIMESTAMP '1996-01-01 00:00:00' AND begin_interval_time <= TIMESTAMP '1997-12-31 00:00:00' GROUP BY 1, 2),
hist AS (
  SELECT ev.dbid, ev.instance_number, ev.snap_id, ev.event_id, ss.min_snap_id,
    total_waits - lag(total_waits, 1, total_waits) OVER (PARTITION BY ev.instance_number, ev.event_id ORDER BY ev.snap_id) AS waits,
    total_timeouts - lag(total_timeouts, 1, total_timeouts) OVER (PARTITION BY ev.instance_number, ev.event_id ORDER BY ev.snap_id) AS timeouts,
    time_waited_micro - lag(time_waited_micro, 1, time_waited_micro) OVER (PARTITION BY ev.instance_number, ev.event_id ORDER BY ev.snap_id) AS micro
  FROM ss JOIN fx_sysevent ev ON ev.dbid = ss.dbid AND ev.instance_number = ss.instance_number
  WHERE ev.snap_id BETWEEN ss.min_snap_id - 1 AND ss.max_snap_id)"""


@query("c01_system_events_total", EV_DELTA + """
SELECT h.dbid, h.instance_number, h.event_id, n.event_name, n.wait_class,
       CAST(sum(waits) AS BIGINT) AS waits, CAST(sum(timeouts) AS BIGINT) AS timeouts,
       round(CAST(sum(micro) AS DOUBLE) / 1e6, 6) AS time_waited_secs,
       min(h.min_snap_id) AS min_snap_id, max(h.snap_id) AS max_snap_id
FROM hist h JOIN fx_event_name n ON n.event_id = h.event_id
WHERE waits >= 0 AND h.snap_id >= h.min_snap_id AND n.wait_class <> 'Idle'
GROUP BY 1, 2, 3, 4, 5""")
def c01(spark, sf):
    return R.system_events_total(_fx(spark, sf, "fx_sysevent"), _fx(spark, sf, "fx_snapshot"),
                                 _fx(spark, sf, "fx_event_name"), *SNAP_RANGE)


@query("a02_delta_in_range_chunked", EV_DELTA + """
SELECT dbid, instance_number, event_id, snap_id, waits AS total_waits, timeouts AS total_timeouts, micro AS time_waited_micro
FROM hist WHERE waits >= 0 AND snap_id >= min_snap_id""")
def a02(spark, sf):
    b = H.snapshot_bounds(_fx(spark, sf, "fx_snapshot"), *SNAP_RANGE)
    d = C.delta_in_range(_fx(spark, sf, "fx_sysevent"), b, ["dbid", "instance_number", "event_id"], "snap_id",
                         ["total_waits", "total_timeouts", "time_waited_micro"],
                         chunk=F.floor(F.col("snap_id") / 6))
    return d.select("dbid", "instance_number", "event_id", "snap_id", "total_waits", "total_timeouts",
                    "time_waited_micro")


@query("c02_system_events_per_snapshot", """
WITH hist AS (
  SELECT dbid, instance_number, snap_id,
    total_waits - lag(total_waits, 1, total_waits) OVER (PARTITION BY instance_number ORDER BY snap_id) AS waits,
    total_timeouts - lag(total_timeouts, 1, total_timeouts) OVER (PARTITION BY instance_number ORDER BY snap_id) AS timeouts,
    time_waited_micro - lag(time_waited_micro, 1, time_waited_micro) OVER (PARTITION BY instance_number ORDER BY snap_id) AS micro
  FROM fx_sysevent WHERE event_id = 2 AND snap_id BETWEEN 12 - 1 AND 30)
SELECT h.instance_number, h.snap_id, CAST(s.begin_interval_time AS TIMESTAMP) AS begin_interval_time,
       waits, timeouts, round(CAST(micro AS DOUBLE) / 1e6, 6) AS time_waited_secs
FROM hist h JOIN fx_snapshot s ON s.dbid = h.dbid AND s.instance_number = h.instance_number AND s.snap_id = h.snap_id
WHERE waits >= 0 AND h.snap_id BETWEEN 12 AND 30""")
def c02(spark, sf):
    return R.system_events_per_snapshot(_fx(spark, sf, "fx_sysevent"), _fx(spark, sf, "fx_snapshot"), 2, 12, 30)


ST_DELTA = """
WITH ss AS (SELECT dbid, instance_number, min(snap_id) AS min_snap_id, max(snap_id) AS max_snap_id FROM fx_snapshot
            WHERE begin_interval_time >= TIMESTAMP '1996-01-01 00:00:00' AND begin_interval_time <= TIMESTAMP '1997-12-31 00:00:00' GROUP BY 1, 2),
hist AS (
  SELECT st.dbid, st.instance_number, st.snap_id, st.stat_id, ss.min_snap_id,
    value - lag(value, 1, value) OVER (PARTITION BY st.instance_number, st.stat_id ORDER BY st.snap_id) AS value
  FROM ss JOIN fx_sysstat st ON st.dbid = ss.dbid AND st.instance_number = ss.instance_number
  WHERE st.snap_id BETWEEN ss.min_snap_id - 1 AND ss.max_snap_id),
d AS (SELECT h.*, n.stat_name, n.class FROM hist h JOIN fx_stat_name n ON n.stat_id = h.stat_id
      WHERE h.value >= 0 AND h.snap_id >= h.min_snap_id)"""


@query("c03_sysstat_wide_by_month_class1", ST_DELTA + """
SELECT CAST(date_trunc('month', s.begin_interval_time) AS TIMESTAMP) AS period,
       CAST(sum(CASE WHEN stat_name = 'user commits' THEN value END) AS BIGINT) AS user_commits,
       CAST(sum(CASE WHEN stat_name = 'user rollbacks' THEN value END) AS BIGINT) AS user_rollbacks
FROM d JOIN fx_snapshot s ON s.dbid = d.dbid AND s.instance_number = d.instance_number AND s.snap_id = d.snap_id
WHERE (d.class & 1) = 1 GROUP BY 1""")
def c03(spark, sf):
    return R.sysstat_wide(_fx(spark, sf, "fx_sysstat"), _fx(spark, sf, "fx_snapshot"),
                          _fx(spark, sf, "fx_stat_name"), *SNAP_RANGE, unit="MM", class_bit=1)


@query("c04_sysstat_totals", ST_DELTA + """
SELECT instance_number, stat_id, stat_name, CAST(sum(value) AS BIGINT) AS total_value FROM d GROUP BY 1, 2, 3""")
def c04(spark, sf):
    return R.sysstat_totals(_fx(spark, sf, "fx_sysstat"), _fx(spark, sf, "fx_snapshot"),
                            _fx(spark, sf, "fx_stat_name"), *SNAP_RANGE)


@query("c05_one_stat_per_snapshot", """
WITH h AS (SELECT dbid, instance_number, snap_id,
   value - lag(value, 1, value) OVER (PARTITION BY instance_number ORDER BY snap_id) AS value
   FROM fx_sysstat WHERE stat_id = 3)
SELECT h.instance_number, h.snap_id, CAST(s.begin_interval_time AS TIMESTAMP) AS begin_interval_time, h.value
FROM h JOIN fx_snapshot s ON s.dbid = h.dbid AND s.instance_number = h.instance_number AND s.snap_id = h.snap_id
WHERE h.value >= 0""")
def c05(spark, sf):
    return R.one_stat_per_snapshot(_fx(spark, sf, "fx_sysstat"), _fx(spark, sf, "fx_snapshot"), 3)


@query("c07_latch_totals", """
WITH g AS (SELECT series_id, counter_name, min(snap_id) AS a, max(snap_id) AS b FROM fx_counter_multi GROUP BY 1, 2)
SELECT g.series_id, g.counter_name, l.gets - f.gets AS gets, l.misses - f.misses AS misses,
       l.waits - f.waits AS waits, g.a AS first_snap_id, g.b AS last_snap_id,
       round(CASE WHEN l.gets - f.gets = 0 THEN NULL ELSE (l.misses - f.misses) * 100.0 / (l.gets - f.gets) END, 4) AS miss_pct,
       round((l.waits - f.waits) / CASE WHEN l.misses - f.misses = 0 THEN 1 ELSE l.misses - f.misses END, 4) AS sleeps_per_miss
FROM g JOIN fx_counter_multi f ON f.series_id = g.series_id AND f.snap_id = g.a
JOIN fx_counter_multi l ON l.series_id = g.series_id AND l.snap_id = g.b""")
def c07(spark, sf):
    return R.latch_totals(_fx(spark, sf, "fx_counter_multi"), ["series_id", "counter_name"], "snap_id",
                          "gets", "misses", sleeps="waits")


@query("c08_latch_per_snapshot", """
SELECT * FROM (
  SELECT series_id, snap_id,
    gets - lag(gets, 1, gets) OVER (PARTITION BY series_id ORDER BY snap_id) AS gets,
    misses - lag(misses, 1, misses) OVER (PARTITION BY series_id ORDER BY snap_id) AS misses
  FROM fx_counter_multi) t
WHERE gets >= 0""")
def c08(spark, sf):
    d = R.latch_per_snapshot(_fx(spark, sf, "fx_counter_multi"), ["series_id"], "snap_id", ("gets", "misses"))
    return d.select("series_id", "snap_id", "gets", "misses")
