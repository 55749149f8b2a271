"""Streaming queries.

Each callable stages its input, derived from the test tables, in ranges of
event time (one partitioned write below the shared checkpoint folder), lets
the ranges arrive one after the other, runs the streaming query with
``availableNow`` after each and returns the sink read back as a DataFrame.
All must equal the batch SQL; S03 uses approximate distinct counts, which are
exact at the bindings' cardinalities, and S04 closes its last sessions by an
end marker.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixture
from ..streaming import (ROCKSDB, deliver, end_marker, latest_versions, run_available_now, scratch_dir, stage_files, stream_counter_delta,
                         stream_counter_delta_stateful,
                         stream_load_timeline, stream_long_transactions, stream_sla_breaches, stream_usage_counts)
from .registry import query


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


def _stream(spark, src_df, path, fmt="parquet"):
    """The stream of a source folder that ``_run`` fills."""
    if fmt == "text":
        return spark.readStream.text(path)
    return spark.readStream.schema(src_df.schema).parquet(path)


def _run(spark, src_df, folder, run, order_col=None, chunks=4, fmt="parquet", last=()):
    """Stage ``src_df`` below ``folder`` and run the query after each chunk that arrives (one micro-batch each)."""
    parts = stage_files(src_df, folder + "/staged", order_col, chunks, fmt)
    for k, df in enumerate(last):
        parts += stage_files(df, f"{folder}/last{k}", fmt=fmt)
    for part in parts:
        if deliver(spark, part, folder + "/src"):
            run()


@query("s01_stream_load_timeline", """
SELECT date_trunc('hour', sample_time) AS start_sample, coalesce(CAST(event AS VARCHAR), 'NULL') AS criteria,
  round(sum(10) / greatest(max(10), 3600), 6) AS diagram_value FROM fx_ash GROUP BY 1, 2""")
def s01(spark, sf):
    d = scratch_dir(spark, "s01")
    src = _fx(spark, sf, "fx_ash").select("sample_time", "event", F.lit(10).alias("sample_cycle"))
    deliver(spark, d + "/none", d + "/src")
    cells = stream_load_timeline(_stream(spark, src, d + "/src"), "event", 3600, watermark="31 days")
    _run(spark, src, d, lambda: run_available_now(cells, d + "/out", d + "/cp", "update"), "sample_time")
    return latest_versions(spark, d + "/out", ["start_sample", "criteria"])


@query("s02_stream_counter_delta", """
SELECT series_id, snap_id, counter_value FROM (
  SELECT series_id, snap_id, counter_value - lag(counter_value, 1, counter_value) OVER (PARTITION BY series_id ORDER BY snap_id) AS counter_value
  FROM fx_counter) t WHERE counter_value >= 0""")
def s02(spark, sf):
    d = scratch_dir(spark, "s02")
    src = _fx(spark, sf, "fx_counter").select("series_id", "snap_id", "snap_time", "counter_value")
    deliver(spark, d + "/none", d + "/src")
    stream = _stream(spark, src, d + "/src")
    _run(spark, src, d, lambda: stream_counter_delta(stream, ["series_id"], "snap_id", ["counter_value"], d + "/out",
                                                     d + "/state", d + "/cp", reset="drop", compact_every=2).awaitTermination(), "snap_time")
    return spark.read.parquet(d + "/out").select("series_id", "snap_id", "counter_value")


# HyperLogLog++ at rsd 0.01 counts the few distinct clients and databases of the
# bindings exactly (checked at sf0.001, sf0.01 and sf0.1), so exact SQL can serve as oracle.
@query("s03_stream_usage_counts", """
SELECT split_part(line, ' ', 3) AS month, count(*) AS requests, count(DISTINCT split_part(line, ' ', 1)) AS users,
  count(DISTINCT split_part(line, ' ', 2)) AS databases FROM fx_usage_log GROUP BY 1""")
def s03(spark, sf):
    d = scratch_dir(spark, "s03")
    src = _fx(spark, sf, "fx_usage_log").select("line")
    deliver(spark, d + "/none", d + "/src")
    counts = stream_usage_counts(_stream(spark, src, d + "/src", "text"))
    _run(spark, src, d, lambda: run_available_now(counts, d + "/out", d + "/cp", "complete"), fmt="text")
    return spark.read.parquet(d + "/out")


@query("s04_stream_long_transactions", """
WITH a AS (SELECT xid, sample_time, lag(sample_time) OVER (PARTITION BY xid ORDER BY sample_time) AS p FROM fx_ash WHERE xid IS NOT NULL),
b AS (SELECT xid, sample_time, sum(CASE WHEN p IS NULL OR sample_time > p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
        OVER (PARTITION BY xid ORDER BY sample_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM a)
SELECT xid, CAST(min(sample_time) AS TIMESTAMP) AS session_start, CAST(max(sample_time) + INTERVAL 30 MINUTE AS TIMESTAMP) AS session_end,
  count(*) AS samples, round((epoch_us(max(sample_time)) - epoch_us(min(sample_time))) / 1000000.0, 3) AS duration_secs
FROM b GROUP BY xid, n""")
def s04(spark, sf):
    d = scratch_dir(spark, "s04")
    src = _fx(spark, sf, "fx_ash").select("xid", "sample_time")
    deliver(spark, d + "/none", d + "/src")
    tx = stream_long_transactions(_stream(spark, src, d + "/src"), "xid", "sample_time", gap="30 minutes", watermark="1 hour")
    _run(spark, src, d, lambda: run_available_now(tx, d + "/out", d + "/cp", "append"), "sample_time", last=[end_marker(src, days=2), end_marker(src, days=3)])
    return spark.read.parquet(d + "/out")


SLA_AS_OF = "1998-08-03 00:00:00"


@query("s05_stream_sla_breaches", f"""
WITH lim AS (SELECT DISTINCT id_messagetype, CAST(86400 * 30 * (1 + id_messagetype % 3) AS BIGINT) AS warning_secs,
                    CAST(86400 * 60 * (1 + id_messagetype % 3) AS BIGINT) AS alert_secs FROM fx_message),
j AS (SELECT m.*, l.warning_secs, l.alert_secs,
        round((epoch_us(TIMESTAMP '{SLA_AS_OF}') - epoch_us(m.creation_time)) / 1000000.0, 3) AS age_secs
      FROM fx_message m JOIN lim l ON l.id_messagetype = m.id_messagetype WHERE m.erroneous = 'N')
SELECT id, id_messagetype, creation_time, erroneous, id_bulkgroup, run_count, warning_secs, alert_secs, age_secs,
  CASE WHEN age_secs > alert_secs THEN 'ALERT' WHEN age_secs > warning_secs THEN 'WARNING' END AS level
FROM j WHERE age_secs > warning_secs""")
def s05(spark, sf):
    d = scratch_dir(spark, "s05")
    m = _fx(spark, sf, "fx_message")
    limits = m.select("id_messagetype").distinct().select(
        "id_messagetype",
        (F.lit(86400 * 30) * (1 + F.pmod("id_messagetype", F.lit(3)))).cast("bigint").alias("warning_secs"),
        (F.lit(86400 * 60) * (1 + F.pmod("id_messagetype", F.lit(3)))).cast("bigint").alias("alert_secs"))
    deliver(spark, d + "/none", d + "/src")
    open_msgs = _stream(spark, m, d + "/src").filter(F.col("erroneous") == "N")
    breaches = stream_sla_breaches(open_msgs, limits, SLA_AS_OF)
    _run(spark, m, d, lambda: run_available_now(breaches, d + "/out", d + "/cp", "append"), "creation_time")
    return spark.read.parquet(d + "/out").select("id", "id_messagetype", "creation_time", "erroneous", "id_bulkgroup",
                                                 "run_count", "warning_secs", "alert_secs", "age_secs", "level")


@query("s02_stream_counter_delta_keyed_state", """
SELECT series_id, snap_id, counter_value FROM (
  SELECT series_id, snap_id, counter_value - lag(counter_value, 1, counter_value) OVER (PARTITION BY series_id ORDER BY snap_id) AS counter_value
  FROM fx_counter) t WHERE counter_value >= 0""")
def s02_state(spark, sf):
    d = scratch_dir(spark, "s02k")
    src = _fx(spark, sf, "fx_counter").select("series_id", "snap_id", "snap_time", "counter_value")
    deliver(spark, d + "/none", d + "/src")
    deltas = stream_counter_delta_stateful(_stream(spark, src, d + "/src"), ["series_id"], "snap_id", ["counter_value"], reset="drop")
    _run(spark, src, d, lambda: run_available_now(deltas.select("series_id", "snap_id", "counter_value"), d + "/out", d + "/cp", "append",
                                                  state_store=ROCKSDB), "snap_time")
    return spark.read.parquet(d + "/out")
