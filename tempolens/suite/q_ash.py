"""Activity-sample queries (A07, A15, A18, A44, B-family)."""

from __future__ import annotations

from ..plans import ash
from ..sources import fixture
from .registry import query

# Oracle helper: A07 slot start in DuckDB
def _bucket_sql(col: str, n: int) -> str:
    return (f"(date_trunc('day', {col}) + to_seconds(CAST(floor(date_diff('second', "
            f"date_trunc('day', {col}), {col}) / {n}) * {n} AS BIGINT)))")


MERGED_SQL = """live_min AS (SELECT instance_number, min(sample_time) AS m FROM fx_ash_live GROUP BY 1),
merged AS (
  SELECT h.*, 10 AS sample_cycle FROM fx_ash h
  WHERE NOT EXISTS (SELECT 1 FROM live_min l WHERE l.instance_number = h.instance_number AND h.sample_time >= l.m)
  UNION ALL SELECT *, 1 AS sample_cycle FROM fx_ash_live)"""


@query("b02_load_timeline_top3_events", f"""
WITH {MERGED_SQL},
cells AS (
  SELECT {_bucket_sql('sample_time', 3600)} AS start_sample,
         coalesce(CAST(event AS VARCHAR), 'NULL') AS criteria,
         sum(sample_cycle) / greatest(max(sample_cycle), 3600) AS v
  FROM merged GROUP BY 1, 2),
top AS (SELECT criteria FROM cells GROUP BY 1 ORDER BY round(sum(v), 6) DESC, criteria LIMIT 3),
times AS (SELECT DISTINCT start_sample FROM cells)
SELECT t.start_sample, p.criteria, round(coalesce(c.v, 0), 6) AS diagram_value
FROM times t CROSS JOIN top p
LEFT JOIN cells c ON c.start_sample = t.start_sample AND c.criteria = p.criteria
""")
def b02_load_timeline(spark, sf_dir):
    samples = ash.weighted_samples(fixture(spark, sf_dir, "fx_ash"), fixture(spark, sf_dir, "fx_ash_live"))
    return ash.load_timeline(samples, "event", bucket_seconds=3600, top_x=3)


@query("a15_merge_live_history", f"""
WITH {MERGED_SQL}
SELECT instance_number, sample_cycle, count(*) AS samples, min(sample_time) AS first_sample, max(sample_time) AS last_sample
FROM merged GROUP BY 1, 2""")
def a15(spark, sf):
    from pyspark.sql import functions as F
    m = ash.weighted_samples(fixture(spark, sf, "fx_ash"), fixture(spark, sf, "fx_ash_live"))
    return m.groupBy("instance_number", "sample_cycle").agg(F.count(F.lit(1)).alias("samples"),
                                                            F.min("sample_time").alias("first_sample"),
                                                            F.max("sample_time").alias("last_sample"))


@query("a15_merge_live_history_inner", """
WITH live_min AS (SELECT instance_number, min(sample_time) AS m FROM fx_ash_live GROUP BY 1),
merged AS (
  SELECT h.instance_number, 10 AS sample_cycle FROM fx_ash h JOIN live_min l ON l.instance_number = h.instance_number AND h.sample_time < l.m
  UNION ALL SELECT instance_number, 1 FROM fx_ash_live)
SELECT instance_number, sample_cycle, count(*) AS samples FROM merged GROUP BY 1, 2""")
def a15_inner(spark, sf):
    from pyspark.sql import functions as F
    m = ash.weighted_samples(fixture(spark, sf, "fx_ash"), fixture(spark, sf, "fx_ash_live"), how="inner")
    return m.groupBy("instance_number", "sample_cycle").agg(F.count(F.lit(1)).alias("samples"))


@query("a06_single_or_count_flavours", """
SELECT session_id,
  CASE WHEN count(DISTINCT coalesce(wait_class, ' ')) = 1 THEN min(wait_class) ELSE '< ' || count(DISTINCT coalesce(wait_class, ' ')) || ' >' END AS null_counted,
  CASE WHEN count(DISTINCT xid) = 1 THEN min(xid) ELSE '< ' || count(DISTINCT xid) || ' >' END AS null_ignored,
  CASE WHEN count(DISTINCT coalesce(sql_id, ' ')) = 1 THEN min(sql_id) ELSE 'Partial' END AS fixed_text,
  CASE WHEN count(DISTINCT coalesce(module, ' ')) = 1 THEN min(module) END AS else_null FROM fx_ash GROUP BY 1""")
def a06(spark, sf_dir):
    from ..functions import single_or_count
    return fixture(spark, sf_dir, "fx_ash").groupBy("session_id").agg(
        single_or_count("wait_class").alias("null_counted"), single_or_count("xid", null_counts=False).alias("null_ignored"),
        single_or_count("sql_id", else_="Partial").alias("fixed_text"), single_or_count("module", else_=None).alias("else_null"))


@query("a44_load_average", f"""
WITH {MERGED_SQL}
SELECT {_bucket_sql('sample_time', 600)} AS slot, round(sum(sample_cycle) / greatest(max(sample_cycle), 600), 6) AS load FROM merged GROUP BY 1""")
def a44(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..functions import load_average, time_bucket
    s = ash.weighted_samples(fixture(spark, sf_dir, "fx_ash"), fixture(spark, sf_dir, "fx_ash_live"))
    return s.groupBy(time_bucket("sample_time", 600).alias("slot")).agg(F.round(load_average("sample_cycle", 600), 6).alias("load"))


ASH_DIMS = {"instance": "instance_number", "session": "session_id", "transaction": "xid", "sql_id": "sql_id", "module": "module", "event": "event",
            "wait_class": "coalesce(wait_class, 'CPU')"}


@query("b08_every_dimension", " UNION ALL ".join(
    f"SELECT '{k}' AS dimension, CAST({v} AS VARCHAR) AS value, count(*) AS samples FROM fx_ash GROUP BY 2" for k, v in ASH_DIMS.items()))
def b08(spark, sf_dir):
    from pyspark.sql import functions as F
    a = fixture(spark, sf_dir, "fx_ash")
    dims = {k: v for k, v in ash.ash_dimensions(a.columns).items() if k in ASH_DIMS}
    if set(dims) != set(ASH_DIMS):
        raise ValueError(f"dimensions without a source: {sorted(set(ASH_DIMS) - set(dims))}")
    # one pass: every sample gives one row per dimension, combined before the shuffle
    each = a.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.cast("string").alias("value")) for k, v in dims.items()])).alias("d"))
    return each.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("samples"))
