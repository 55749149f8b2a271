"""Storage, catalog and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import storage as SG
from ..sources import fixture
from .registry import query


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


def _ts_inputs(spark, sf):
    part = _fx(spark, sf, "part")
    ts = part.select(F.col("p_type").alias("tablespace_name")).distinct() \
        .select("tablespace_name", F.lit("PERMANENT").alias("contents"), F.lit(8192).alias("block_size")) \
        .unionByName(_fx(spark, sf, "supplier").select(F.concat(F.lit("TEMP"), F.pmod("s_nationkey", F.lit(2)).cast("string"))
                                                       .alias("tablespace_name")).distinct()
                     .select("tablespace_name", F.lit("TEMPORARY").alias("contents"), F.lit(8192).alias("block_size")))
    files = part.select(F.col("p_type").alias("tablespace_name"), (F.col("p_size").cast("bigint") * 1048576).alias("bytes"),
                        F.when(F.col("p_size") > 25, "YES").otherwise("NO").alias("autoextensible"))
    free = part.select(F.col("p_type").alias("tablespace_name"), (F.floor("p_retailprice") * 1024).alias("bytes"))
    sup = _fx(spark, sf, "supplier")
    temp = sup.select(F.concat(F.lit("TEMP"), F.pmod("s_nationkey", F.lit(2)).cast("string")).alias("tablespace_name"),
                      (F.col("s_suppkey") * 1048576).alias("bytes"),
                      F.lit("YES").alias("autoextensible"))
    sort = _fx(spark, sf, "orders").filter(F.col("o_orderstatus") == "O").select(
        F.concat(F.lit("TEMP"), F.pmod("o_custkey", F.lit(2)).cast("string")).alias("tablespace_name"), F.lit(1).alias("used_blocks"))
    return ts, files, free, temp, sort


TS_SQL = """ts AS (SELECT DISTINCT p_type AS tablespace_name, 'PERMANENT' AS contents, 8192 AS block_size FROM part
          UNION ALL SELECT DISTINCT 'TEMP' || CAST(s_nationkey % 2 AS VARCHAR), 'TEMPORARY', 8192 FROM supplier),
f AS (SELECT p_type AS tablespace_name, sum(CAST(p_size AS BIGINT) * 1048576) AS b,
        CASE WHEN count(DISTINCT CASE WHEN p_size > 25 THEN 'YES' ELSE 'NO' END) = 1 THEN min(CASE WHEN p_size > 25 THEN 'YES' ELSE 'NO' END) ELSE 'Partial' END AS autoextensible
      FROM part GROUP BY 1),
fr AS (SELECT p_type AS tablespace_name, sum(floor(p_retailprice) * 1024) AS fb FROM part GROUP BY 1),
tf AS (SELECT 'TEMP' || CAST(s_nationkey % 2 AS VARCHAR) AS tablespace_name, sum(s_suppkey * 1048576) AS b, 'YES' AS autoextensible FROM supplier GROUP BY 1),
su AS (SELECT 'TEMP' || CAST(o_custkey % 2 AS VARCHAR) AS tablespace_name, count(*) AS used FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
u AS (
  SELECT ts.tablespace_name, contents, block_size, round(f.b / 1048576.0, 4) AS mb_total, round(coalesce(fr.fb, 0) / 1048576.0, 4) AS mb_free,
    round((f.b - coalesce(fr.fb, 0)) / 1048576.0, 4) AS mb_used, f.autoextensible
  FROM ts LEFT JOIN fr ON fr.tablespace_name = ts.tablespace_name LEFT JOIN f ON f.tablespace_name = ts.tablespace_name WHERE contents <> 'TEMPORARY'
  UNION ALL
  SELECT ts.tablespace_name, contents, block_size, round(coalesce(tf.b, 0) / 1048576.0, 4),
    round(coalesce(tf.b, 0) / 1048576.0 - coalesce(su.used, 0) * block_size / 1048576.0, 4), round(coalesce(su.used, 0) * block_size / 1048576.0, 4), tf.autoextensible
  FROM ts LEFT JOIN tf ON tf.tablespace_name = ts.tablespace_name LEFT JOIN su ON su.tablespace_name = ts.tablespace_name WHERE contents = 'TEMPORARY')"""


@query("f01_tablespace_usage", f"""
WITH {TS_SQL}
SELECT *, round(CASE WHEN mb_total = 0 THEN NULL ELSE mb_used * 100.0 / mb_total END, 4) AS pct_used FROM u""")
def f01(spark, sf):
    return SG.tablespace_usage(*_ts_inputs(spark, sf))


@query("f01_tablespace_totals", f"""
WITH {TS_SQL}
SELECT CASE WHEN GROUPING(contents) = 1 THEN 'TOTAL' ELSE contents END AS contents, round(sum(mb_total), 4) AS mb_total,
  round(sum(mb_free), 4) AS mb_free, round(sum(mb_used), 4) AS mb_used, CAST(GROUPING(contents) AS INTEGER) AS level
FROM u GROUP BY ROLLUP (contents)""")
def f01t(spark, sf):
    return SG.tablespace_totals(SG.tablespace_usage(*_ts_inputs(spark, sf)))


@query("f02_size_by_schema_and_type", """
SELECT owner, CASE WHEN object_type = 'INDEX' THEN 'INDEX' ELSE 'TABLE' END AS segment_type,
  round(sum(bytes) / 1048576.0, 4) AS mbytes, count(*) AS segments FROM fx_object GROUP BY 1, 2 HAVING sum(bytes) / 1048576.0 > 100""")
def f02(spark, sf):
    return SG.size_by_schema_and_type(_fx(spark, sf, "fx_object"), {"INDEX PARTITION": "INDEX", "TABLE PARTITION": "TABLE"},
                                      min_mb=100.0)


@query("f03_datafile_usage", """
WITH files AS (SELECT CAST(p_size % 5 AS INT) AS file_id, concat('/data/f', CAST(p_size % 5 AS STRING), '.dbf') AS file_name, 'DATA' AS file_type
               FROM part GROUP BY 1, 2
               UNION ALL SELECT CAST(5 + s_nationkey % 2 AS INT), concat('/temp/t', CAST(s_nationkey % 2 AS STRING), '.dbf'), 'TEMP' FROM supplier GROUP BY 1, 2)
SELECT f.*, io.io_requests FROM files f LEFT JOIN (SELECT file_id, count(*) AS io_requests FROM fx_block_access GROUP BY 1) io ON io.file_id = f.file_id""")
def f03(spark, sf):
    p = _fx(spark, sf, "part")
    data = p.select(F.pmod("p_size", F.lit(5)).cast("int").alias("file_id"),
                    F.concat(F.lit("/data/f"), F.pmod("p_size", F.lit(5)).cast("string"), F.lit(".dbf")).alias("file_name")).distinct()
    s = _fx(spark, sf, "supplier")
    temp = s.select((5 + F.pmod("s_nationkey", F.lit(2))).cast("int").alias("file_id"),
                    F.concat(F.lit("/temp/t"), F.pmod("s_nationkey", F.lit(2)).cast("string"), F.lit(".dbf")).alias("file_name")).distinct()
    return SG.datafile_usage(data, temp, _fx(spark, sf, "fx_block_access"))


@query("f04_undo_usage", """
SELECT concat('UNDO', CAST(l_suppkey % 2 AS STRING)) AS tablespace_name, round(sum(l_quantity * 8192) / 1048576.0, 4) AS mb_total,
  round(sum(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN l_quantity * 8192 ELSE 0 END) / 1048576.0, 4) AS mb_active,
  round(sum(CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'N' THEN l_quantity * 8192 ELSE 0 END) / 1048576.0, 4) AS mb_unexpired,
  round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity * 8192 ELSE 0 END) / 1048576.0, 4) AS mb_expired
FROM lineitem GROUP BY 1""")
def f04(spark, sf):
    l = _fx(spark, sf, "lineitem")
    st = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "ACTIVE") \
        .when(F.col("l_linestatus") == "O", "UNEXPIRED").otherwise("EXPIRED")
    ext = l.select(F.concat(F.lit("UNDO"), F.pmod("l_suppkey", F.lit(2)).cast("string")).alias("tablespace_name"),
                   st.alias("status"), (F.col("l_quantity") * 8192).alias("bytes"))
    return SG.undo_usage(ext, ["tablespace_name"])


@query("f05_mview_overview", """
WITH mv AS (SELECT DISTINCT n_name AS owner, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey),
lg AS (SELECT n.n_name AS owner, r.r_name AS name, count(*) AS logs FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2),
rg AS (SELECT n.n_name AS owner, r.r_name AS name, count(*) AS registrations FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2)
SELECT mv.owner, mv.name, coalesce(lg.logs, 0) AS logs, coalesce(rg.registrations, 0) AS registrations
FROM mv LEFT JOIN lg ON lg.owner = mv.owner AND lg.name = mv.name LEFT JOIN rg ON rg.owner = mv.owner AND rg.name = mv.name""")
def f05(spark, sf):
    n = _fx(spark, sf, "nation")
    r = _fx(spark, sf, "region")
    nr = n.join(r, r.r_regionkey == n.n_regionkey).select(F.col("n_nationkey"), F.col("n_name").alias("owner"), F.col("r_name").alias("name"))
    mv = nr.select("owner", "name").distinct()
    logs = _fx(spark, sf, "supplier").join(nr, F.col("s_nationkey") == F.col("n_nationkey")).select("owner", "name")
    reg = _fx(spark, sf, "customer").join(nr, F.col("c_nationkey") == F.col("n_nationkey")).select("owner", "name")
    return SG.mview_overview(mv, logs, reg)


@query("f06_objects_by_size", """
WITH seg AS (SELECT owner, object_name, count(*) AS partitions, sum(bytes) AS bytes FROM fx_object GROUP BY 1, 2),
obj AS (SELECT owner, object_name, max(num_rows) AS num_rows,
   CASE WHEN count(DISTINCT object_type) = 1 THEN min(object_type) ELSE 'N/A' END AS object_type FROM fx_object GROUP BY 1, 2)
SELECT seg.owner, seg.object_name, seg.partitions, CAST(seg.bytes AS BIGINT) AS bytes, obj.num_rows, obj.object_type,
  round(seg.bytes / 1048576.0, 4) AS mbytes, round(CASE WHEN obj.num_rows = 0 THEN NULL ELSE seg.bytes / obj.num_rows END, 2) AS avg_row_len
FROM seg LEFT JOIN obj ON obj.owner = seg.owner AND obj.object_name = seg.object_name""")
def f06(spark, sf):
    o = _fx(spark, sf, "fx_object")
    return SG.objects_by_size(o, o)


@query("f07_index_column_lists", """
SELECT table_name, string_agg(column_name, ', ' ORDER BY column_name) AS column_list, count(*) AS columns FROM fx_ind_column GROUP BY 1""")
def f07(spark, sf):
    return SG.index_column_lists(_fx(spark, sf, "fx_ind_column"), ["table_name"])


@query("f08_partitions_with_sizes", """
SELECT s.segment_id, s.object_name, s.subobject_name, o.bytes FROM fx_segment s LEFT JOIN fx_object o ON o.object_id = s.segment_id
WHERE s.subobject_name IS NOT NULL""")
def f08(spark, sf):
    s = _fx(spark, sf, "fx_segment").filter(F.col("subobject_name").isNotNull())
    o = _fx(spark, sf, "fx_object").select(F.col("object_id").alias("segment_id"), "bytes")
    return s.join(o, "segment_id", "left").select("segment_id", "object_name", "subobject_name", "bytes")


@query("f09_audit_list_filtered", """
SELECT * FROM fx_audit WHERE contains(upper(username), 'U1') AND contains(upper(action_name), 'ERR')
  AND audit_time >= TIMESTAMP '2024-01-05 00:00:00' AND audit_time <= TIMESTAMP '2024-01-20 00:00:00'""")
def f09(spark, sf):
    return SG.audit_list(_fx(spark, sf, "fx_audit"), {"username": "u1", "action_name": "err", "userhost": None},
                         start="2024-01-05 00:00:00", end="2024-01-20 00:00:00")


def _f10_sql(col):
    return f"""SELECT '{col}' AS column_name, date_trunc('hour', audit_time) AS period,
  CASE WHEN {col} IN (SELECT v FROM (SELECT {col} AS v, count(*) AS n FROM fx_audit WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5) t)
       THEN CAST({col} AS VARCHAR) ELSE '<others>' END AS value, count(*) AS n
FROM fx_audit GROUP BY 1, 2, 3"""


@query("f10_audit_by_hour_top5", "\nUNION ALL\n".join(_f10_sql(c) for c in ["username", "userhost", "action_name"]))
def f10(spark, sf):
    return SG.audit_by_period(_fx(spark, sf, "fx_audit"), "HH24", ["username", "userhost", "action_name"], 5)


TYPES = ["F", "O", "P"]


@query("f11_growth_timeline", "SELECT CAST(gather_date AS TIMESTAMP) AS gather_date, " + ", ".join(
    f"CAST(sum(CASE WHEN segment_type = '{t}' THEN size_units END) AS BIGINT) AS size_{t}" for t in TYPES)
    + ", CAST(" + " + ".join(f"coalesce(sum(CASE WHEN segment_type = '{t}' THEN size_units END), 0)" for t in TYPES)
    + " AS BIGINT) AS row_total FROM fx_seg_size GROUP BY 1")
def f11(spark, sf):
    s = _fx(spark, sf, "fx_seg_size").withColumn("gather_date", F.col("gather_date").cast("timestamp_ntz"))
    return SG.growth_timeline(s, "gather_date", "segment_type", "size_units", TYPES)


@query("f12_cache_top_timeline", """
WITH per AS (SELECT gather_date, segment_name, sum(size_units) AS t FROM fx_seg_size GROUP BY 1, 2),
topk AS (SELECT segment_name FROM per GROUP BY 1 ORDER BY max(t) DESC, segment_name LIMIT 3),
cells AS (SELECT CAST(gather_date AS TIMESTAMP) AS gather_date, segment_name, sum(size_units) AS size_units FROM fx_seg_size
          WHERE segment_name IN (SELECT segment_name FROM topk) GROUP BY 1, 2),
top AS (SELECT segment_name FROM cells GROUP BY 1 ORDER BY round(sum(size_units), 6) DESC, segment_name LIMIT 3),
times AS (SELECT DISTINCT gather_date FROM cells)
SELECT t.gather_date, p.segment_name, CAST(coalesce(c.size_units, 0) AS BIGINT) AS size_units
FROM times t CROSS JOIN top p LEFT JOIN cells c ON c.gather_date = t.gather_date AND c.segment_name = p.segment_name""")
def f12(spark, sf):
    s = _fx(spark, sf, "fx_seg_size").withColumn("gather_date", F.col("gather_date").cast("timestamp_ntz"))
    return SG.cache_top_timeline(s, "gather_date", "segment_name", "size_units", 3)
