"""IO history and sampled-counter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import counter_reports as CR
from ..plans import io
from ..sources import fixture
from .registry import query


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


def _deltas(spark, sf, keys):
    f = _fx(spark, sf, "fx_file_io")
    return io.io_deltas(f.filter(F.col("file_type") == "DATA"), f.filter(F.col("file_type") == "TEMP"), keys)


def _delta_sql(keys: str) -> str:
    lag = ", ".join(f"{c} - lag({c}, 1, {c}) OVER (PARTITION BY dbid, instance_number, {keys} ORDER BY snap_id) AS {c}"
                    for c in io.IO_COUNTERS)
    return f"""u AS (SELECT * FROM fx_file_io WHERE file_type = 'DATA' UNION ALL SELECT * FROM fx_file_io WHERE file_type = 'TEMP'),
d0 AS (SELECT dbid, instance_number, snap_id, file_id, file_name, ts_name, file_type, function_name, {lag} FROM u),
d AS (SELECT * FROM d0 WHERE snap_id <> (SELECT min(snap_id) FROM d0 m WHERE m.dbid = d0.dbid AND m.instance_number = d0.instance_number))"""


MEASURES_SQL = """round(CASE WHEN phyrds = 0 THEN NULL ELSE readtim * 10 / phyrds END, 4) AS ms_per_read,
  round(CASE WHEN phyrds = 0 THEN NULL ELSE phyblkrd / phyrds END, 4) AS blocks_per_read,
  round(CASE WHEN phywrts = 0 THEN NULL ELSE phyrds / phywrts END, 4) AS reads_per_write,
  round(CASE WHEN phyrds + phywrts = 0 THEN NULL ELSE phyrds * 100.0 / (phyrds + phywrts) END, 4) AS read_share_pct"""


def _grouping_sql(keys, by):
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in io.IO_COUNTERS)
    return f"""WITH {_delta_sql(keys)},
g AS (SELECT {by}, {sums}, count(DISTINCT snap_id) AS snapshots FROM d GROUP BY 1)
SELECT *, {MEASURES_SQL} FROM g"""


@query("c12_file_io_grouping_by_tablespace", _grouping_sql("file_id, function_name", "ts_name"))
def c12(spark, sf):
    return io.io_grouping(_deltas(spark, sf, ["file_id", "function_name"]), "ts_name")


@query("c13_io_by_function_grouping", _grouping_sql("file_id, function_name", "function_name"))
def c13(spark, sf):
    return io.io_grouping(_deltas(spark, sf, ["file_id", "function_name"]), "function_name")


@query("c14_io_by_file_type_grouping", _grouping_sql("file_id, function_name", "file_type"))
def c14(spark, sf):
    return io.io_grouping(_deltas(spark, sf, ["file_id", "function_name"]), "file_type")


@query("c12_file_io_samples", f"""
WITH {_delta_sql('file_id, function_name')},
j AS (SELECT d.*, CAST(s.begin_interval_time AS TIMESTAMP) AS begin_interval_time, CAST(s.end_interval_time AS TIMESTAMP) AS end_interval_time,
        (epoch_us(s.end_interval_time) - epoch_us(s.begin_interval_time)) / 1000000.0 AS interval_secs
      FROM d JOIN fx_snapshot s ON s.dbid = d.dbid AND s.instance_number = d.instance_number AND s.snap_id = d.snap_id)
SELECT *, {MEASURES_SQL}, round(phyrds / interval_secs, 4) AS reads_per_sec, round(phywrts / interval_secs, 4) AS writes_per_sec FROM j""")
def c12s(spark, sf):
    return io.io_samples(_deltas(spark, sf, ["file_id", "function_name"]), _fx(spark, sf, "fx_snapshot"))


@query("c12_file_io_timeline_top5_files", f"""
WITH {_delta_sql('file_id, function_name')},
c0 AS (SELECT date_trunc('minute', CAST(s.end_interval_time AS TIMESTAMP) + INTERVAL 30 SECOND) AS rounded_time, CAST(d.file_id AS VARCHAR) AS curve,
        CAST(sum(phyrds) AS DOUBLE) AS value
      FROM d JOIN fx_snapshot s ON s.dbid = d.dbid AND s.instance_number = d.instance_number AND s.snap_id = d.snap_id GROUP BY 1, 2),
top AS (SELECT curve FROM c0 GROUP BY 1 ORDER BY round(sum(value), 6) DESC, curve LIMIT 5),
times AS (SELECT DISTINCT rounded_time FROM c0)
SELECT t.rounded_time, p.curve, round(coalesce(c0.value, 0), 6) AS value FROM times t CROSS JOIN top p
LEFT JOIN c0 ON c0.rounded_time = t.rounded_time AND c0.curve = p.curve""")
def c12t(spark, sf):
    return io.io_timeline(_deltas(spark, sf, ["file_id", "function_name"]), _fx(spark, sf, "fx_snapshot"), "file_id",
                          "phyrds", 5)


IO_KEYS = ["file_id", "function_name", "filetype_name"]
#: The measures in SQL, over summed counters and the period's seconds (sample_secs).
RATES = {f"{z}_mb_per_sec": (f"{z}_megabytes", "sample_secs") for z in io.SIZES} | {f"{z}_reqs_per_sec": (f"{z}_reqs", "sample_secs") for z in io.SIZES}
IO_SQL = {
    "file": {"ms_per_read": ("readtim * 10", "phyrds"), "blocks_per_read": ("phyblkrd", "phyrds"), "ms_per_write": ("writetim * 10", "phywrts"),
             "blocks_per_write": ("phyblkwrt", "phywrts"), "ms_per_single_read": ("singleblkrdtim * 10", "singleblkrds"),
             "blocks_per_multi_read": ("phyblkrd - singleblkrds", "phyrds - singleblkrds"), "io_per_sec": ("phyrds + phywrts", "sample_secs"),
             "reads_per_sec": ("phyrds", "sample_secs"), "writes_per_sec": ("phywrts", "sample_secs")},
    "function": RATES | {"waits_per_sec": ("number_of_waits", "sample_secs"), "waiting_sessions": ("wait_time / 1000.0", "sample_secs")},
    "filetype": RATES | {"small_sync_read_reqs_per_sec": ("small_sync_read_reqs", "sample_secs")}
    | {f"{z}_load": (f"{z}_servicetime / 1000.0", "sample_secs") for z in io.SIZES}
    | {f"{z}_latency_ms": (f"{z}_servicetime", f"{z}_reqs") for z in io.SIZES}
    | {"small_sync_read_latency_ms": ("small_sync_read_latency", "small_sync_read_reqs")},
}


def _ratio(up, down):
    return f"CASE WHEN {down} = 0 THEN NULL ELSE CAST({up} AS DOUBLE) / ({down}) END"


def _io_sql(source, by, secs, extra=""):
    """Deltas with times (j) and their sums per ``by`` (g)."""
    counters = io.IO_SOURCES[source][0]
    lag = ", ".join(f"{c} - lag({c}, 1, {c}) OVER (PARTITION BY dbid, instance_number, {', '.join(IO_KEYS)} ORDER BY snap_id) AS {c}" for c in counters)
    return f"""WITH d0 AS (SELECT dbid, instance_number, snap_id, {', '.join(IO_KEYS)}, file_name, ts_name, {lag} FROM fx_io),
j AS (SELECT d0.*, CAST(s.begin_interval_time AS TIMESTAMP) AS b, CAST(s.end_interval_time AS TIMESTAMP) AS e FROM d0
      JOIN fx_snapshot s ON s.dbid = d0.dbid AND s.instance_number = d0.instance_number AND s.snap_id = d0.snap_id
      WHERE d0.snap_id <> (SELECT min(snap_id) FROM fx_io m WHERE m.dbid = d0.dbid AND m.instance_number = d0.instance_number)),
g AS (SELECT {by}, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in counters)}, {extra}
        {secs} AS sample_secs FROM j GROUP BY {by.split(' AS ')[0]})"""


PERIOD = "(epoch_us(max(e)) - epoch_us(min(b))) / 1000000.0"
SAMPLE = "(epoch_us(min(e)) - epoch_us(min(b))) / 1000000.0"
MINUTE = "date_trunc('minute', b + INTERVAL 30 SECOND)"


def _measures_sql(source):
    return ", ".join(f"round({_ratio(u, d)}, 4) AS {k}" for k, (u, d) in IO_SQL[source].items())


def _io(spark, sf, source):
    return io.io_deltas(_fx(spark, sf, "fx_io"), None, IO_KEYS, io.IO_SOURCES[source][0]), _fx(spark, sf, "fx_snapshot")


def _register_io():
    for cid, source, by, measure in (("c12", "file", "file_name", "io_per_sec"), ("c13", "function", "function_name", "waiting_sessions"),
                                     ("c14", "filetype", "filetype_name", "large_read_latency_ms")):
        up, down = IO_SQL[source][measure]

        @query(f"{cid}_io_report_by_{by}", _io_sql(source, by, PERIOD, "count(DISTINCT snap_id) AS samples,")
               + f" SELECT *, {_measures_sql(source)} FROM g")
        def report(spark, sf, source=source, by=by):
            return io.io_report(*_io(spark, sf, source), source, by)

        @query(f"{cid}_io_report_samples", _io_sql(source, f"{MINUTE} AS rounded_begin", SAMPLE) + f" SELECT *, {_measures_sql(source)} FROM g")
        def samples(spark, sf, source=source):
            return io.io_report_samples(*_io(spark, sf, source), source)

        cells = _io_sql(source, f"{MINUTE}, {by}", SAMPLE).replace(f"g AS (SELECT {MINUTE}, {by},", f"g AS (SELECT {MINUTE} AS rounded_time, {by} AS curve,")

        @query(f"{cid}_io_report_timeline_{measure}", cells + f""",
c AS (SELECT rounded_time, curve, coalesce(round({_ratio(up, down)}, 6), 0) AS value FROM g),
top AS (SELECT curve FROM c GROUP BY 1 ORDER BY round(sum(value), 6) DESC, curve LIMIT 3)
SELECT t.rounded_time, top.curve, round(coalesce(c.value, 0), 6) AS value FROM (SELECT DISTINCT rounded_time FROM c) t CROSS JOIN top
LEFT JOIN c ON c.rounded_time = t.rounded_time AND c.curve = top.curve""")
        def timeline(spark, sf, source=source, by=by, measure=measure):
            return io.io_report_timeline(*_io(spark, sf, source), source, by, measure, 3)


_register_io()


def _metric_sql(unit: str, avg: str, low: str, high: str, where: str = "") -> str:
    c = f"instance_number, begin_time, end_time, group_id, metric_id, metric_name, metric_unit, {avg} AS a, {low} AS l, {high} AS h"
    return f"""
WITH m AS (SELECT instance_number, min(begin_time) AS t FROM fx_sysmetric_live GROUP BY 1),
merged AS (SELECT {c} FROM fx_sysmetric JOIN m USING (instance_number) WHERE begin_time < m.t AND dbid = 1
           UNION ALL SELECT {c} FROM fx_sysmetric_live),
report AS (SELECT date_trunc('{unit}', begin_time) AS period, metric_id, metric_name, metric_unit, avg(a) AS value, min(l) AS min_value, max(h) AS max_value
  FROM merged WHERE group_id = 2 AND begin_time >= TIMESTAMP '2024-01-05' AND begin_time < TIMESTAMP '2024-01-25' AND end_time <= TIMESTAMP '2024-01-25' {where}
  GROUP BY 1, 2, 3, 4)"""


def _metrics(spark, sf, **kw):
    return CR.metric_history(_fx(spark, sf, "fx_sysmetric"), _fx(spark, sf, "fx_sysmetric_live"), "2024-01-05", "2024-01-25", **kw)


@query("c06_metrics_live_and_history", _metric_sql("hour", "value", "value", "value")
       + " SELECT period, metric_id, metric_name, metric_unit, round(value, 4) AS value, min_value, max_value FROM report")
def c06_detail(spark, sf):
    return _metrics(spark, sf, unit="HH24").withColumn("value", F.round("value", 4))


@query("c06_metric_summaries_wide", _metric_sql("day", "average", "min_val", "max_val", "AND instance_number = 1") + """
SELECT period, """ + ", ".join(f"round(coalesce(max(CASE WHEN metric_id = {i} THEN value END), 0), 4) AS m{i}" for i in range(5)) + " FROM report GROUP BY 1")
def c06_wide(spark, sf):
    w = CR.metric_wide(_metrics(spark, sf, unit="DD", summary=True, instance=1), {i: f"m{i}" for i in range(5)})
    return w.select("period", *[F.round(f"m{i}", 4).alias(f"m{i}") for i in range(5)])


@query("c06_metric_summary_hourly", """
SELECT date_trunc('hour', ts) AS period, event_type AS metric_name, round(avg(CAST(round(value * 100) AS BIGINT)), 4) AS avg_value,
  min(CAST(round(value * 100) AS BIGINT)) AS min_value, max(CAST(round(value * 100) AS BIGINT)) AS max_value, count(*) AS samples
FROM events GROUP BY 1, 2""")
def c06(spark, sf):
    # metric values in hundredths as integers, so averages do not depend on summation order
    m = _fx(spark, sf, "events").select(F.col("ts").alias("begin_time"), F.col("event_type").alias("metric_name"),
                                        F.round(F.col("value") * 100).cast("bigint").alias("value"))
    return CR.metric_summary(m, "HH24")


def _mutex(spark, sf):
    e = _fx(spark, sf, "events")
    return e.select(F.col("event_type").alias("mutex_type"), F.pmod("user_id", F.lit(20)).alias("blocking_session"),
                    F.pmod(F.col("user_id") + F.col("event_id"), F.lit(20)).alias("requesting_session"),
                    F.round("value").cast("bigint").alias("sleeps"), (F.pmod("event_id", F.lit(100)) + 1).alias("gets"),
                    F.col("ts").alias("sleep_timestamp"))


MUTEX_SQL = """m AS (SELECT event_type AS mutex_type, user_id % 20 AS blocking_session, (user_id + event_id) % 20 AS requesting_session,
  CAST(round(value) AS BIGINT) AS sleeps, event_id % 100 + 1 AS gets, ts AS sleep_timestamp FROM events)"""


@query("c09_mutex_sleeps_by_blocker", f"""
WITH {MUTEX_SQL}
SELECT blocking_session, mutex_type, CAST(sum(sleeps) AS BIGINT) AS sleeps, CAST(sum(gets) AS BIGINT) AS gets, count(*) AS samples,
  round(CASE WHEN sum(gets) = 0 THEN NULL ELSE sum(sleeps) / sum(gets) END, 6) AS sleep_ratio FROM m GROUP BY 1, 2""")
def c09(spark, sf):
    return CR.mutex_sleeps(_mutex(spark, sf), "blocking_session")


@query("c10_mutex_timeline", f"""
WITH {MUTEX_SQL}
SELECT date_trunc('minute', sleep_timestamp) AS period, mutex_type, CAST(sum(sleeps) AS BIGINT) AS sleeps, count(*) AS samples FROM m GROUP BY 1, 2""")
def c10(spark, sf):
    return CR.mutex_timeline(_mutex(spark, sf))


@query("c11_enqueue_totals", """
WITH g AS (SELECT instance_number, event_id, min(snap_id) AS a, max(snap_id) AS b FROM fx_sysevent GROUP BY 1, 2)
SELECT g.event_id, g.instance_number, l.total_waits - f.total_waits AS total_waits, l.total_timeouts - f.total_timeouts AS total_timeouts,
  g.a AS first_snap_id, g.b AS last_snap_id, n.event_name, n.wait_class
FROM g JOIN fx_sysevent f ON f.instance_number = g.instance_number AND f.event_id = g.event_id AND f.snap_id = g.a
JOIN fx_sysevent l ON l.instance_number = g.instance_number AND l.event_id = g.event_id AND l.snap_id = g.b
LEFT JOIN fx_event_name n ON n.event_id = g.event_id""")
def c11(spark, sf):
    return CR.enqueue_totals(_fx(spark, sf, "fx_sysevent"), _fx(spark, sf, "fx_event_name"))


@query("c16_interconnect_latency", """
WITH d AS (SELECT instance_number, snap_id, stat_id, value - lag(value, 1, value) OVER (PARTITION BY instance_number, stat_id ORDER BY snap_id) AS value
           FROM fx_sysstat WHERE stat_id IN (3, 4)),
g AS (SELECT instance_number, snap_id, CAST(sum(CASE WHEN stat_id = 3 THEN value ELSE 0 END) AS BIGINT) AS blocks,
        CAST(sum(CASE WHEN stat_id = 4 THEN value ELSE 0 END) AS BIGINT) AS receive_time FROM d WHERE value >= 0 GROUP BY 1, 2)
SELECT CASE WHEN GROUPING(instance_number) = 1 THEN 'TOTAL' ELSE CAST(instance_number AS VARCHAR) END AS instance_number,
  CASE WHEN GROUPING(snap_id) = 1 THEN 'TOTAL' ELSE CAST(snap_id AS VARCHAR) END AS snap_id,
  CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(receive_time) AS BIGINT) AS receive_time,
  CAST(GROUPING(instance_number) + GROUPING(snap_id) AS INTEGER) AS level,
  round(CASE WHEN sum(blocks) = 0 THEN NULL ELSE sum(receive_time) * 10.0 / sum(blocks) END, 4) AS ms_per_block
FROM g GROUP BY ROLLUP (instance_number, snap_id)""")
def c16(spark, sf):
    from ..operators.counters import counter_delta
    d = counter_delta(_fx(spark, sf, "fx_sysstat").filter(F.col("stat_id").isin(3, 4)), ["instance_number", "stat_id"],
                      "snap_id", ["value"], reset="drop")
    return CR.interconnect_latency(d, 3, 4)


@query("c22_sampled_system_events", """
WITH b AS (SELECT event_id, sum(total_waits) AS tw, sum(time_waited_micro) AS tm FROM fx_sysevent WHERE snap_id = 12 GROUP BY 1),
a AS (SELECT event_id, sum(total_waits) AS tw, sum(time_waited_micro) AS tm FROM fx_sysevent WHERE snap_id = 13 GROUP BY 1)
SELECT coalesce(b.event_id, a.event_id) AS event_id, CAST(coalesce(a.tw, 0) - coalesce(b.tw, 0) AS BIGINT) AS total_waits_delta,
  CAST(coalesce(a.tm, 0) - coalesce(b.tm, 0) AS BIGINT) AS time_waited_micro_delta, CAST(coalesce(a.tw, 0) AS BIGINT) AS total_waits_total,
  CAST(coalesce(a.tm, 0) AS BIGINT) AS time_waited_micro_total,
  round(CASE WHEN coalesce(a.tw, 0) - coalesce(b.tw, 0) = 0 THEN NULL ELSE (coalesce(a.tm, 0) - coalesce(b.tm, 0)) / 1000.0 / (coalesce(a.tw, 0) - coalesce(b.tw, 0)) END, 4) AS avg_ms_per_wait
FROM b FULL OUTER JOIN a ON a.event_id = b.event_id""")
def c22(spark, sf):
    s = _fx(spark, sf, "fx_sysevent")

    def sample(snap):
        return s.filter(F.col("snap_id") == snap).groupBy("event_id").agg(
            F.sum("total_waits").alias("total_waits"), F.sum("time_waited_micro").alias("time_waited_micro"))
    return CR.sampled_events(sample(12), sample(13))


@query("c23_sampled_segment_statistics", """
WITH b AS (SELECT owner, segment_name, segment_type, size_units FROM fx_seg_size WHERE gather_date = TIMESTAMP '1996-01-01 00:00:00'),
a AS (SELECT owner, segment_name, segment_type, size_units FROM fx_seg_size WHERE gather_date = TIMESTAMP '1996-02-01 00:00:00')
SELECT a.owner, a.segment_name, a.segment_type, a.size_units - b.size_units AS size_units_delta, a.size_units AS size_units_total
FROM b JOIN a ON a.owner IS NOT DISTINCT FROM b.owner AND a.segment_name IS NOT DISTINCT FROM b.segment_name
  AND a.segment_type IS NOT DISTINCT FROM b.segment_type WHERE a.size_units - b.size_units <> 0""")
def c23(spark, sf):
    s = _fx(spark, sf, "fx_seg_size")

    def sample(day):
        return s.filter(F.col("gather_date") == F.lit(day).cast("timestamp")).select("owner", "segment_name", "segment_type", "size_units")
    return CR.sampled_segments(sample("1996-01-01 00:00:00"), sample("1996-02-01 00:00:00"),
                               ["owner", "segment_name", "segment_type"], ["size_units"])


STAT_CLASSES = {1: "User", 2: "Redo", 4: "Enqueue", 8: "Cache", 16: "OS", 32: "Real Application Clusters", 64: "SQL", 128: "Debug"}


@query("c24_session_statistics_nonzero", "SELECT s.stat_id, s.dbid, s.instance_number, s.snap_id, s.value, n.stat_name, n.class, concat_ws(', ', "
       + ", ".join(f"CASE WHEN (n.class & {b}) = {b} THEN '{v}' END" for b, v in STAT_CLASSES.items())
       + ") AS class_names FROM fx_sysstat s JOIN fx_stat_name n ON n.stat_id = s.stat_id WHERE s.value <> 0 AND s.snap_id = 20")
def c24(spark, sf):
    st = _fx(spark, sf, "fx_sysstat").filter(F.col("snap_id") == 20)
    return CR.session_statistics(st, _fx(spark, sf, "fx_stat_name"), STAT_CLASSES)


@query("c15_io_measures_by_instance", _io_sql("filetype", "instance_number", PERIOD) + f" SELECT *, {_measures_sql('filetype')} FROM g")
def c15(spark, sf):
    deltas, snaps = _io(spark, sf, "filetype")
    return io.io_report(deltas, snaps, "filetype", "instance_number").drop("samples")
