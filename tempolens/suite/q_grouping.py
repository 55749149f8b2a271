"""Aggregation family queries (A05, A06, A16, A17, A20-A26, A40-A47, A51, A52; B01, B04, B09, B11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import first_value_by, last_value_by, per_unit, trunc_time
from ..operators import grouping as G
from ..plans import ash
from ..sources import fixture
from .q_ash import MERGED_SQL
from .registry import query


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


def _merged(spark, sf):
    return ash.weighted_samples(_fx(spark, sf, "fx_ash"), _fx(spark, sf, "fx_ash_live"))


def _soc(expr: str, alias: str) -> str:
    n = f"count(DISTINCT coalesce(CAST({expr} AS VARCHAR), ' '))"
    return f"CASE WHEN {n} = 1 THEN CAST(min({expr}) AS VARCHAR) ELSE '< ' || {n} || ' >' END AS {alias}"


ASH_DIMS_SQL = {"instance": "instance_number", "session": "session_id", "transaction": "xid", "sql_id": "sql_id",
                "module": "module", "event": "event", "wait_class": "coalesce(wait_class, 'CPU')"}
ASH_MEASURES_SQL = """CAST(sum(sample_cycle) AS BIGINT) AS time_waited_secs,
  round(avg(time_waited) / 1000.0, 4) AS time_waited_avg_ms, count(*) AS count_samples,
  min(sample_time) AS first_occurrence, max(sample_time) AS last_occurrence,
  round((epoch_us(max(sample_time)) - epoch_us(min(sample_time))) / 1000000.0, 3) AS sample_duration_secs"""


def _b01_sql(by: str, where: str = "") -> str:
    others = ",\n  ".join(_soc(e, d) for d, e in ASH_DIMS_SQL.items() if d != by)
    return f"""WITH {MERGED_SQL}
SELECT {ASH_DIMS_SQL[by]} AS {by}, {ASH_MEASURES_SQL},
  {others}
FROM merged {where} GROUP BY 1"""


@query("b01_ash_grouping_by_event", _b01_sql("event"))
def b01_event(spark, sf):
    return ash.grouping(_merged(spark, sf), "event")


@query("b01_ash_grouping_by_wait_class", _b01_sql("wait_class"))
def b01_wait_class(spark, sf):
    return ash.grouping(_merged(spark, sf), "wait_class")


@query("a16_group_filter_drilldown_null_xid", _b01_sql("sql_id", "WHERE instance_number = 1 AND xid IS NULL"))
def a16(spark, sf):
    return ash.grouping(_merged(spark, sf), "sql_id", {"instance": 1, "transaction": ""})


@query("a17_drilldown_module_filtered", _b01_sql("module", "WHERE event = 'error' AND coalesce(wait_class, 'CPU') = 'Application'"))
def a17(spark, sf):
    return ash.grouping(_merged(spark, sf), "module", {"event": "error", "wait_class": "Application"})


@query("a05_first_last_value_ties", """
WITH g AS (SELECT owner, min(gather_date) AS f, max(gather_date) AS l FROM fx_seg_size GROUP BY 1)
SELECT g.owner,
  (SELECT min(size_units) FROM fx_seg_size s WHERE s.owner = g.owner AND s.gather_date = g.f) AS size_first,
  (SELECT max(size_units) FROM fx_seg_size s WHERE s.owner = g.owner AND s.gather_date = g.l) AS size_last,
  (SELECT max(size_units) FROM fx_seg_size s WHERE s.owner = g.owner AND s.gather_date = g.f) AS max_first
FROM g""")
def a05(spark, sf):
    s = _fx(spark, sf, "fx_seg_size")
    # MAX(x) KEEP FIRST: negate for the struct order, then negate back
    return s.groupBy("owner").agg(first_value_by("size_units", "gather_date").alias("size_first"),
                                  last_value_by("size_units", "gather_date").alias("size_last"),
                                  (-first_value_by(-F.col("size_units"), "gather_date")).alias("max_first"))


CODES = [4532, 6216, 6217, 6218, 6281, 6282, 7251]


@query("a20_pivot_stats_codes", "SELECT minute, " + ", ".join(
    f"CAST(sum(CASE WHEN code = {c} AND counter <> 0 THEN counter END) AS BIGINT) AS c{c}" for c in CODES)
    + ", CAST(" + " + ".join(f"coalesce(sum(CASE WHEN code = {c} AND counter <> 0 THEN counter END), 0)" for c in CODES)
    + " AS BIGINT) AS row_total FROM fx_aspect GROUP BY minute")
def a20(spark, sf):
    return G.pivot_stats(_fx(spark, sf, "fx_aspect"), "minute", "code", "counter", CODES,
                         row_total=True, alias=lambda c: f"c{c}")


@query("a21_conditional_pivot", "SELECT sub_key, " + ", ".join(
    f"CAST(sum(CASE WHEN code = {c} THEN counter ELSE 0 END) AS BIGINT) AS n{c}" for c in CODES[:4])
    + " FROM fx_aspect GROUP BY sub_key")
def a21(spark, sf):
    return G.conditional_pivot(_fx(spark, sf, "fx_aspect"), ["sub_key"], "code",
                               {c: f"n{c}" for c in CODES[:4]}, "counter")


@query("a22_pct_of_column_sum", """
SELECT owner, CAST(sum(bytes) AS BIGINT) AS bytes,
  round(sum(bytes) * 100.0 / (SELECT sum(bytes) FROM fx_object), 4) AS bytes_pct
FROM fx_object GROUP BY 1""")
def a22(spark, sf):
    g = _fx(spark, sf, "fx_object").groupBy("owner").agg(F.sum("bytes").alias("bytes"))
    return G.pct_of_column_sum(g, "bytes")


def sql_sort_modes():
    return {
        "elapsed_time": F.col("elapsed_time"),
        "executions": F.col("executions"),
        "elapsed_per_exec": per_unit("elapsed_time", "executions"),
        "buffer_gets": F.col("buffer_gets"),
        "disk_reads": F.col("disk_reads"),
        "rows_processed": F.col("rows_processed"),
        "gets_per_exec": per_unit("buffer_gets", "executions"),
        "reads_per_exec": per_unit("disk_reads", "executions"),
        "rows_per_exec": per_unit("rows_processed", "executions"),
    }


def _sql_totals(df):
    return df.groupBy("sql_id").agg(F.sum("executions_delta").alias("executions"),
                                    F.sum("elapsed_time_delta").alias("elapsed_time"),
                                    F.sum("buffer_gets_delta").alias("buffer_gets"),
                                    F.sum("disk_reads_delta").alias("disk_reads"),
                                    F.sum("rows_processed_delta").alias("rows_processed"))


SQL_TOTALS = """SELECT sql_id, CAST(sum(executions_delta) AS BIGINT) AS executions, CAST(sum(elapsed_time_delta) AS BIGINT) AS elapsed_time,
  CAST(sum(buffer_gets_delta) AS BIGINT) AS buffer_gets, CAST(sum(disk_reads_delta) AS BIGINT) AS disk_reads,
  CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed FROM fx_sqlstat GROUP BY 1"""


@query("a24_top_sort_reads_per_exec", f"""
SELECT * FROM ({SQL_TOTALS}) t
ORDER BY disk_reads / CASE WHEN executions = 0 THEN 1 ELSE executions END DESC NULLS LAST, sql_id LIMIT 7""")
def a24(spark, sf):
    return G.top_sort(_sql_totals(_fx(spark, sf, "fx_sqlstat")), sql_sort_modes(), "reads_per_exec", 7, ["sql_id"])


def _pc_side(lo, hi):
    return f"""SELECT sql_id, parsing_schema_name, CAST(sum(executions_delta) AS BIGINT) AS executions,
  CAST(sum(elapsed_time_delta) AS BIGINT) AS elapsed_time, CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed,
  max(plan_hash_value) AS max_plan, count(DISTINCT CASE WHEN plan_hash_value = 0 THEN NULL ELSE plan_hash_value END) AS plans,
  count(DISTINCT instance_number) AS instance_count
  FROM fx_sqlstat WHERE snap_id BETWEEN {lo} AND {hi} GROUP BY 1, 2 HAVING sum(executions_delta) > 0"""


@query("a25_period_compare", f"""
SELECT t1.sql_id, t1.parsing_schema_name,
  t1.executions AS executions_t1, t1.elapsed_time AS elapsed_time_t1, t1.rows_processed AS rows_processed_t1, t1.instance_count AS instance_count_t1,
  t2.executions AS executions_t2, t2.elapsed_time AS elapsed_time_t2, t2.rows_processed AS rows_processed_t2, t2.instance_count AS instance_count_t2,
  round(t1.elapsed_time / t1.executions, 6) AS elapsed_per_exec_t1, round(t2.elapsed_time / t2.executions, 6) AS elapsed_per_exec_t2,
  round((t2.elapsed_time / t2.executions - t1.elapsed_time / t1.executions) * t2.executions, 4) AS weighted_growth,
  t1.plans + t2.plans - CASE WHEN t1.max_plan = t2.max_plan AND t1.plans <> 0 AND t2.plans <> 0 THEN 1 ELSE 0 END AS execution_plan_count
FROM ({_pc_side(1, 12)}) t1 JOIN ({_pc_side(13, 24)}) t2 ON t1.sql_id = t2.sql_id AND t1.parsing_schema_name = t2.parsing_schema_name
WHERE t2.elapsed_time / t2.executions > t1.elapsed_time / t1.executions * 1.02""")
def a25(spark, sf):
    s = _fx(spark, sf, "fx_sqlstat")
    return G.period_compare(s, ["sql_id", "parsing_schema_name"], F.col("snap_id").between(1, 12),
                            F.col("snap_id").between(13, 24), "executions_delta", "elapsed_time_delta",
                            rows="rows_processed_delta", plan="plan_hash_value", instance="instance_number",
                            min_pct=2.0)


def _cum(hi):
    return f"""SELECT sql_id, module, CAST(sum(executions_delta) AS BIGINT) AS executions,
  CAST(sum(elapsed_time_delta) AS BIGINT) AS elapsed_time FROM fx_sqlstat WHERE snap_id <= {hi} GROUP BY 1, 2"""


@query("a26_snapshot_diff", f"""
SELECT a.sql_id, a.module, a.executions - b.executions AS executions_delta, a.elapsed_time - b.elapsed_time AS elapsed_time_delta,
  a.executions AS executions_total, a.elapsed_time AS elapsed_time_total
FROM ({_cum(12)}) b JOIN ({_cum(24)}) a ON a.sql_id IS NOT DISTINCT FROM b.sql_id AND a.module IS NOT DISTINCT FROM b.module""")
def a26(spark, sf):
    s = _fx(spark, sf, "fx_sqlstat")

    def cum(hi):
        return s.filter(F.col("snap_id") <= hi).groupBy("sql_id", "module").agg(
            F.sum("executions_delta").alias("executions"), F.sum("elapsed_time_delta").alias("elapsed_time"))
    return G.snapshot_diff(cum(12), cum(24), ["sql_id", "module"], ["executions", "elapsed_time"])


@query("a40_keyed_full_outer", """
SELECT coalesce(a.session_id, b.session_id) AS session_id, a.history_samples, b.live_samples
FROM (SELECT session_id, count(*) AS history_samples FROM fx_ash WHERE event = 'error' GROUP BY 1) a
FULL OUTER JOIN (SELECT session_id, count(*) AS live_samples FROM fx_ash_live GROUP BY 1) b ON a.session_id = b.session_id""")
def a40(spark, sf):
    a = _fx(spark, sf, "fx_ash").filter(F.col("event") == "error").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("history_samples"))
    b = _fx(spark, sf, "fx_ash_live").groupBy("session_id").agg(F.count(F.lit(1)).alias("live_samples"))
    return G.keyed_full_outer(a, b, ["session_id"])


@query("a41_rollup_total", """
SELECT CASE WHEN GROUPING(owner) = 1 THEN 'TOTAL' ELSE owner END AS owner,
       CASE WHEN GROUPING(object_type) = 1 THEN 'TOTAL' ELSE object_type END AS object_type,
       CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS objects,
       CAST(GROUPING(owner) + GROUPING(object_type) AS INTEGER) AS level
FROM fx_object GROUP BY ROLLUP (owner, object_type)""")
def a41(spark, sf):
    return G.rollup_total(_fx(spark, sf, "fx_object"), ["owner", "object_type"],
                          {"bytes": F.sum("bytes"), "objects": F.count(F.lit(1))})


def _a42_sql(col):
    return f"""SELECT '{col}' AS column_name, date_trunc('day', audit_time) AS period,
  CASE WHEN {col} IN (SELECT v FROM (SELECT {col} AS v, count(*) AS n FROM fx_audit WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3) t)
       THEN CAST({col} AS VARCHAR) ELSE '<others>' END AS value, count(*) AS n
FROM fx_audit GROUP BY 1, 2, 3"""


@query("a42_top_x_by_group_counts", "\nUNION ALL\n".join(_a42_sql(c) for c in ["username", "userhost", "action_name"]))
def a42(spark, sf):
    a = _fx(spark, sf, "fx_audit")
    return G.top_x_by_group_counts(a, trunc_time("audit_time", "DD"), ["username", "userhost", "action_name"], 3)


@query("a43_distinct_counts_by_group", """
SELECT action_name, count(*) AS requests, count(DISTINCT userhost) AS distinct_userhost,
  count(DISTINCT os_username) AS distinct_os_username, count(DISTINCT username) AS distinct_username
FROM fx_audit GROUP BY 1""")
def a43(spark, sf):
    return G.distinct_counts_by_group(_fx(spark, sf, "fx_audit"), "action_name",
                                      ["userhost", "os_username", "username"])


MODULE_HOURS_SQL = """per AS (SELECT date_trunc('hour', sample_time) AS period, module, min(sample_time) AS first_occurrence,
   max(sample_time) AS last_occurrence, count(*) * 10 AS secs FROM fx_ash WHERE instance_number = 1 GROUP BY 1, 2),
w AS (SELECT *, min(secs) OVER (PARTITION BY module) AS mn, max(secs) OVER (PARTITION BY module) AS mx FROM per)"""


@query("a45_outlier_vs_average", f"""
WITH {MODULE_HOURS_SQL}
SELECT module, CAST(sum(secs) AS BIGINT) AS value_total, round(avg(secs), 0) AS value_avg, min(secs) AS value_min,
  min(CASE WHEN secs = mn THEN period END) AS period_of_min, max(secs) AS value_max,
  max(CASE WHEN secs = mx THEN period END) AS period_of_max, round(max(secs) - avg(secs), 4) AS max_minus_avg,
  min(first_occurrence) AS first_occurrence, max(last_occurrence) AS last_occurrence
FROM w GROUP BY 1""")
def a45(spark, sf):
    a = _fx(spark, sf, "fx_ash").filter(F.col("instance_number") == 1)
    per = a.groupBy(trunc_time("sample_time", "HH24").alias("period"), "module").agg(
        F.min("sample_time").alias("first_occurrence"), F.max("sample_time").alias("last_occurrence"),
        (F.count(F.lit(1)) * 10).alias("secs"))
    return G.outlier_vs_average(per, "module", "period", "secs", "first_occurrence", "last_occurrence")


PLAN_VARIANTS_SQL = """v AS (SELECT s.dbid, s.instance_number, s.sql_id, s.plan_hash_value,
   CAST(min(ss.begin_interval_time) AS TIMESTAMP) AS first_occurrence, CAST(max(ss.end_interval_time) AS TIMESTAMP) AS last_occurrence,
   round(sum(s.elapsed_time_delta) / 1000000.0, 6) AS elapsed_secs, CAST(sum(s.executions_delta) AS BIGINT) AS executions
  FROM fx_sqlstat s JOIN fx_snapshot ss ON ss.dbid = s.dbid AND ss.instance_number = s.instance_number AND ss.snap_id = s.snap_id
  GROUP BY 1, 2, 3, 4),
w AS (SELECT *, min(first_occurrence) OVER (PARTITION BY dbid, instance_number, sql_id) AS f,
                max(first_occurrence) OVER (PARTITION BY dbid, instance_number, sql_id) AS l FROM v)"""


def plan_variants(spark, sf):
    s = _fx(spark, sf, "fx_sqlstat")
    ss = _fx(spark, sf, "fx_snapshot")
    return (s.join(ss, ["dbid", "instance_number", "snap_id"], "inner")
            .groupBy("dbid", "instance_number", "sql_id", "plan_hash_value")
            .agg(F.min("begin_interval_time").cast("timestamp_ntz").alias("first_occurrence"),
                 F.max("end_interval_time").cast("timestamp_ntz").alias("last_occurrence"),
                 F.round(F.sum("elapsed_time_delta") / F.lit(1e6), 6).alias("elapsed_secs"),
                 F.sum("executions_delta").alias("executions")))


@query("a46_change_detection", f"""
WITH {PLAN_VARIANTS_SQL}
SELECT dbid, instance_number, sql_id, count(*) AS variant_count,
  min(CASE WHEN first_occurrence = f THEN elapsed_secs END) AS elapsed_secs_first,
  max(CASE WHEN first_occurrence = l THEN elapsed_secs END) AS elapsed_secs_last,
  min(CASE WHEN first_occurrence = f THEN executions END) AS executions_first,
  max(CASE WHEN first_occurrence = l THEN executions END) AS executions_last,
  min(first_occurrence) AS first_occurrence_key, max(last_occurrence) AS last_occurrence_key,
  min(last_occurrence) AS last_occurrence_first_variant, max(first_occurrence) AS first_occurrence_last_variant
FROM w GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def a46(spark, sf):
    return G.change_detection(plan_variants(spark, sf), ["dbid", "instance_number", "sql_id"], "first_occurrence",
                              ["elapsed_secs", "executions"])


@query("a47_prefix_similarity", """
SELECT substr(text, 1, 12) AS prefix, count(*) AS variations, CAST(sum(n_chars) AS BIGINT) AS total_chars, min(doc_id) AS example_doc_id
FROM documents GROUP BY 1 HAVING count(*) >= 2""")
def a47(spark, sf):
    return G.prefix_similarity(_fx(spark, sf, "documents"), "text", 12, 2, "doc_id",
                               {"total_chars": F.sum("n_chars")})


@query("a51_hist_level_stats", """
WITH per AS (SELECT owner, gather_date, sum(size_units) AS v FROM fx_seg_size GROUP BY 1, 2)
SELECT owner, count(*) AS snapshots, CAST(sum(v) AS BIGINT) AS value_sum, round(avg(v), 4) AS value_avg,
  CAST(min(v) AS BIGINT) AS value_min, CAST(max(v) AS BIGINT) AS value_max FROM per GROUP BY 1""")
def a51(spark, sf):
    return G.hist_level_stats(_fx(spark, sf, "fx_seg_size"), ["owner"], ["gather_date"], "size_units")


@query("a52_growth", """
WITH g AS (SELECT owner, segment_name, segment_type, min(gather_date) AS f, max(gather_date) AS l FROM fx_seg_size GROUP BY 1, 2, 3),
x AS (SELECT g.owner, g.segment_name, g.segment_type, a.size_units AS size_first, b.size_units AS size_last,
             CAST(g.f AS TIMESTAMP) AS first_gather_date, CAST(g.l AS TIMESTAMP) AS last_gather_date
      FROM g JOIN fx_seg_size a ON a.owner = g.owner AND a.segment_name = g.segment_name AND a.segment_type = g.segment_type AND a.gather_date = g.f
             JOIN fx_seg_size b ON b.owner = g.owner AND b.segment_name = g.segment_name AND b.segment_type = g.segment_type AND b.gather_date = g.l)
SELECT *, size_last - size_first AS growth_abs,
  round(CASE WHEN size_first = 0 THEN NULL ELSE (size_last - size_first) * 100.0 / size_first END, 4) AS growth_pct
FROM x WHERE size_last <> size_first""")
def a52(spark, sf):
    s = _fx(spark, sf, "fx_seg_size").withColumn("gather_date", F.col("gather_date").cast("timestamp_ntz"))
    return G.growth(s, ["owner", "segment_name", "segment_type"], "gather_date", "size_units")


@query("b04_statement_breakdown", f"""
WITH {MERGED_SQL}
SELECT sql_id, instance_number, CAST(sum(sample_cycle) AS BIGINT) AS time_waited_secs, count(*) AS count_samples
FROM merged GROUP BY 1, 2""")
def b04(spark, sf):
    return ash.statement_breakdown(_merged(spark, sf))


@query("b09_active_sessions_per_sample", """
SELECT sample_id AS sample_time, count(*) AS active_sessions FROM fx_ash GROUP BY 1""")
def b09(spark, sf):
    a = _fx(spark, sf, "fx_ash").withColumnRenamed("sample_time", "ts").withColumnRenamed("sample_id", "sample_time")
    return ash.active_sessions_per_sample(a)


@query("b11_wait_summary", """
SELECT coalesce(event, 'ON CPU') AS event, count(*) AS sessions, max(time_waited) AS max_wait,
  CAST(sum(time_waited) AS BIGINT) AS total_wait FROM fx_ash GROUP BY 1""")
def b11(spark, sf):
    return ash.wait_summary(_fx(spark, sf, "fx_ash"))
