"""Series, lookup, text, queue and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (bit_set, bitmask_decode, block_class, code_label, contains_ci, flags_to_list,
                         format_number_locale, hit_ratio, parse_time, per_unit, safe_div, short_text,
                         split_word, trunc_time)
from ..operators import lookup as L
from ..operators import series as S
from ..operators import textscan as T
from ..operators.queue import queue_balance
from ..sources import fixture
from .registry import query


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


@query("a18_top_x_series_segments", """
WITH cells AS (SELECT CAST(gather_date AS TIMESTAMP) AS gather_date, segment_name, sum(size_units) AS size_units FROM fx_seg_size GROUP BY 1, 2),
top AS (SELECT segment_name FROM cells GROUP BY 1 ORDER BY round(sum(size_units), 6) DESC, segment_name LIMIT 4),
times AS (SELECT DISTINCT gather_date FROM cells)
SELECT t.gather_date, p.segment_name, CAST(coalesce(c.size_units, 0) AS BIGINT) AS size_units
FROM times t CROSS JOIN top p LEFT JOIN cells c ON c.gather_date = t.gather_date AND c.segment_name = p.segment_name""")
def a18(spark, sf):
    s = _fx(spark, sf, "fx_seg_size").withColumn("gather_date", F.col("gather_date").cast("timestamp_ntz"))
    return S.top_x_series(s, "gather_date", "segment_name", "size_units", 4, scale=None)


@query("a19_top_k_series_inner", """
WITH per AS (SELECT gather_date, owner, segment_name, sum(size_units) AS t FROM fx_seg_size GROUP BY 1, 2, 3),
top AS (SELECT owner, segment_name FROM per GROUP BY 1, 2 ORDER BY max(t) DESC, owner, segment_name LIMIT 6)
SELECT CAST(s.gather_date AS TIMESTAMP) AS gather_date, s.owner, s.segment_name, s.segment_type, s.size_units
FROM fx_seg_size s WHERE (s.owner, s.segment_name) IN (SELECT owner, segment_name FROM top)""")
def a19(spark, sf):
    s = _fx(spark, sf, "fx_seg_size")
    out = S.top_k_series_inner(s, "gather_date", ["owner", "segment_name"], "size_units", 6)
    return out.withColumn("gather_date", F.col("gather_date").cast("timestamp_ntz"))


@query("a23_ratios_per_unit_safe_div_hit", """
SELECT sql_id, snap_id, round(sum(buffer_gets_delta) / CASE WHEN sum(executions_delta) = 0 THEN 1 ELSE sum(executions_delta) END, 4) AS gets_per_exec,
  round(CASE WHEN sum(disk_reads_delta) = 0 THEN NULL ELSE sum(rows_processed_delta) / sum(disk_reads_delta) END, 4) AS rows_per_read,
  round(100.0 * (sum(buffer_gets_delta) - sum(disk_reads_delta)) / greatest(sum(buffer_gets_delta), 1), 4) AS hit_ratio
FROM fx_sqlstat GROUP BY 1, 2""")
def a23(spark, sf):
    # per statement and snapshot: some cells have no disk reads, which exercises the zero-divisor rules
    s = _fx(spark, sf, "fx_sqlstat")
    g = s.groupBy("sql_id", "snap_id").agg(F.sum("buffer_gets_delta").alias("g"), F.sum("executions_delta").alias("e"),
                                F.sum("disk_reads_delta").alias("r"), F.sum("rows_processed_delta").alias("p"))
    return g.select("sql_id", "snap_id", F.round(per_unit("g", "e"), 4).alias("gets_per_exec"),
                    F.round(safe_div("p", "r"), 4).alias("rows_per_read"),
                    F.round(hit_ratio("g", "r"), 4).alias("hit_ratio"))


@query("a35_unused_anti", """
SELECT owner, index_name, table_name FROM fx_cat_index_wide o WHERE NOT EXISTS (
  SELECT 1 FROM fx_index_use u WHERE u.object_owner = o.owner AND u.object_name = o.index_name)""")
def a35(spark, sf):
    # open and finished uses are the two sources; together they are the whole table
    u = _fx(spark, sf, "fx_index_use").select(F.col("object_owner").alias("owner"), F.col("object_name").alias("index_name"), "origin")
    o = _fx(spark, sf, "fx_cat_index_wide").select("owner", "index_name", "table_name")
    return L.unused_anti(o, ["owner", "index_name"], u.filter(F.col("origin") == "O"), u.filter(F.col("origin") == "F"))


@query("a36_enrich_lookup", """
SELECT s.sql_id, CAST(sum(executions_delta) AS BIGINT) AS executions, max(t.sql_text) AS sql_text
FROM fx_sqlstat s LEFT JOIN (SELECT sql_id, max(sql_text) AS sql_text FROM fx_sqltext GROUP BY 1) t ON t.sql_id = s.sql_id GROUP BY 1""")
def a36(spark, sf):
    g = _fx(spark, sf, "fx_sqlstat").groupBy("sql_id").agg(F.sum("executions_delta").alias("executions"))
    return L.enrich_lookup(g, _fx(spark, sf, "fx_sqltext"), ["sql_id"], {"sql_text": F.max("sql_text")})


@query("a37_typed_lookup", """
SELECT o.object_id, o.object_type, CASE o.object_type WHEN 'TABLE' THEN t.n WHEN 'INDEX' THEN i.n END AS num_rows
FROM fx_object o
LEFT JOIN (SELECT p_brand AS owner, p_name AS object_name, max(CAST(p_size AS BIGINT) * 1000) AS n FROM part GROUP BY 1, 2) t ON t.owner = o.owner AND t.object_name = o.object_name
LEFT JOIN (SELECT p_brand AS owner, p_name AS object_name, max(CAST(p_size AS BIGINT) * 10) AS n FROM part GROUP BY 1, 2) i ON i.owner = o.owner AND i.object_name = o.object_name""")
def a37(spark, sf):
    part = _fx(spark, sf, "part")
    tables = part.select(F.col("p_brand").alias("owner"), F.col("p_name").alias("object_name"),
                         (F.col("p_size").cast("bigint") * 1000).alias("num_rows"))
    indexes = part.select(F.col("p_brand").alias("owner"), F.col("p_name").alias("object_name"),
                          (F.col("p_size").cast("bigint") * 10).alias("num_rows"))
    o = _fx(spark, sf, "fx_object").select("object_id", "object_type", "owner", "object_name")
    out = L.typed_lookup(o, "object_type", {"TABLE": (tables, ["owner", "object_name"]),
                                            "INDEX": (indexes, ["owner", "object_name"])},
                         ["owner", "object_name"], ["num_rows"])
    return out.select("object_id", "object_type", "num_rows")


@query("a38_object_display_name", """
SELECT s.segment_id, s.object_name || coalesce(CASE WHEN b.object_name IS NOT NULL THEN ' (' || b.object_name || ')'
                                          WHEN s.subobject_name IS NOT NULL THEN ' (' || s.subobject_name || ')' END, '') AS display_name
FROM fx_segment s LEFT JOIN fx_object b ON b.object_id = TRY_CAST(CASE WHEN s.object_name LIKE 'SYS_LOB%' THEN substr(s.object_name, 8, 10)
                                                                     WHEN s.object_name LIKE 'SYS_IL%' THEN substr(s.object_name, 7, 10) END AS BIGINT)""")
def a38(spark, sf):
    out = L.object_display_name(_fx(spark, sf, "fx_segment"), _fx(spark, sf, "fx_object"))
    return out.select("segment_id", "display_name")


@query("a39_resolve_object_by_block", """
SELECT e.object_id, count(*) AS accesses, count(DISTINCT a.sample_id) AS samples
FROM fx_block_access a JOIN fx_extent e ON e.file_id = a.file_id AND a.block_no BETWEEN e.block_id AND e.block_id + e.blocks - 1
GROUP BY 1""")
def a39(spark, sf):
    r = L.resolve_by_range(_fx(spark, sf, "fx_block_access"), _fx(spark, sf, "fx_extent"), ["file_id"],
                           "block_no", "block_id", "blocks", bucket=64)
    return r.groupBy("object_id").agg(F.count(F.lit(1)).alias("accesses"),
                                      F.count_distinct("sample_id").alias("samples"))


@query("a48_regex_column_use", """
WITH s AS (SELECT sql_id, table_name, sql_text,
    CASE WHEN instr(upper(sql_text), ' SET ') > 0 THEN
      CASE WHEN instr(upper(substr(sql_text, instr(upper(sql_text), ' SET ') + 5)), ' WHERE ') > 0
           THEN substr(substr(sql_text, instr(upper(sql_text), ' SET ') + 5), 1, instr(upper(substr(sql_text, instr(upper(sql_text), ' SET ') + 5)), ' WHERE ') - 1)
           ELSE substr(sql_text, instr(upper(sql_text), ' SET ') + 5) END END AS section FROM fx_dml)
SELECT s.sql_id, s.table_name, s.sql_text, c.column_name FROM s JOIN fx_ind_column c ON c.table_name = s.table_name
WHERE regexp_matches(upper(s.section), '\\b' || upper(c.column_name) || '\\b')""")
def a48(spark, sf):
    out = T.regex_column_use(_fx(spark, sf, "fx_dml"), _fx(spark, sf, "fx_ind_column"), "table_name", "table_name",
                             "sql_text", "column_name")
    return out.select("sql_id", "table_name", "sql_text", "column_name")


@query("a49_call_argument_scan", """
WITH RECURSIVE chars AS (
  SELECT sql_id, upper(sql_text) AS u, i, substr(upper(sql_text), i, 1) AS ch
  FROM fx_nvl_sql, generate_series(1, length(sql_text)) g(i)),
calls AS (
  SELECT sql_id, u, i AS name_pos, row_number() OVER (PARTITION BY sql_id ORDER BY i) AS call_no
  FROM chars WHERE substr(u, i, 3) = 'NVL'),
scan AS (
  SELECT c.sql_id, c.u, c.call_no, c.name_pos, x.i - c.name_pos - 2 AS lvl, x.ch,
    sum(CASE WHEN x.ch = '(' THEN 1 WHEN x.ch = ')' THEN -1 ELSE 0 END) OVER (PARTITION BY c.sql_id, c.call_no ORDER BY x.i) AS d
  FROM calls c JOIN chars x ON x.sql_id = c.sql_id AND x.i >= c.name_pos + 3 AND x.ch IN ('(', ')', ',')),
marks AS (
  SELECT *, min(CASE WHEN d = 1 AND ch = ',' THEN lvl END) OVER (PARTITION BY sql_id, call_no) AS komma,
            min(CASE WHEN lvl > 3 AND d = 0 THEN lvl END) OVER (PARTITION BY sql_id, call_no) AS ende FROM scan)
SELECT sql_id, call_no, CAST(lvl AS BIGINT) AS open_bracket_position, substr(u, name_pos + 3, ende) AS call_parameter
FROM marks WHERE ch = '(' AND lvl BETWEEN komma AND ende""")
def a49(spark, sf):
    return T.call_argument_scan(_fx(spark, sf, "fx_nvl_sql"), "sql_id", "sql_text", "NVL")


A49_SQL = """
WITH RECURSIVE chars AS (
  SELECT sql_id, upper(sql_text) AS u, i, substr(upper(sql_text), i, 1) AS ch
  FROM fx_nvl_sql, generate_series(1, length(sql_text)) g(i)),
calls AS (
  SELECT sql_id, u, i AS name_pos, row_number() OVER (PARTITION BY sql_id ORDER BY i) AS call_no
  FROM chars WHERE substr(u, i, 3) = 'NVL'),
scan AS (
  SELECT c.sql_id, c.u, c.call_no, c.name_pos, x.i - c.name_pos - 2 AS lvl, x.ch,
    sum(CASE WHEN x.ch = '(' THEN 1 WHEN x.ch = ')' THEN -1 ELSE 0 END) OVER (PARTITION BY c.sql_id, c.call_no ORDER BY x.i) AS d
  FROM calls c JOIN chars x ON x.sql_id = c.sql_id AND x.i >= c.name_pos + 3 AND x.ch IN ('(', ')', ',')),
marks AS (
  SELECT *, min(CASE WHEN d = 1 AND ch = ',' THEN lvl END) OVER (PARTITION BY sql_id, call_no) AS komma,
            min(CASE WHEN lvl > 3 AND d = 0 THEN lvl END) OVER (PARTITION BY sql_id, call_no) AS ende FROM scan)
SELECT sql_id, call_no, CAST(lvl AS BIGINT) AS open_bracket_position, substr(u, name_pos + 3, ende) AS call_parameter
FROM marks WHERE ch = '(' AND lvl BETWEEN komma AND ende"""


@query("a49_call_argument_scan_chunked", A49_SQL)
def a49_chunked(spark, sf):
    # two-level prefix sums over chunks of 16 positions: every statement spans several chunks
    return T.call_argument_scan(_fx(spark, sf, "fx_nvl_sql"), "sql_id", "sql_text", "NVL", chunk=16)


@query("a50_queue_balance", """
WITH cur AS (SELECT id_messagetype AS sub_key, count(*) AS current_length FROM fx_message WHERE erroneous = 'N' GROUP BY 1),
fl AS (SELECT sub_key, minute, CAST(sum(CASE WHEN code = 4532 THEN counter ELSE 0 END) AS BIGINT) AS inflow,
        CAST(sum(CASE WHEN code IN (6216, 6217, 6218) THEN counter ELSE 0 END) AS BIGINT) AS outflow FROM fx_aspect GROUP BY 1, 2)
SELECT fl.sub_key, fl.minute, fl.inflow, fl.outflow, cur.current_length,
  CAST(coalesce(cur.current_length, 0) - sum(inflow - outflow) OVER (PARTITION BY fl.sub_key ORDER BY fl.minute DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS queue_length_before
FROM fl LEFT JOIN cur ON cur.sub_key = fl.sub_key""")
def a50(spark, sf):
    m = _fx(spark, sf, "fx_message")
    cur = m.filter(F.col("erroneous") == "N").groupBy(F.col("id_messagetype").alias("sub_key")) \
        .agg(F.count(F.lit(1)).alias("current_length"))
    a = _fx(spark, sf, "fx_aspect")
    fl = a.groupBy("sub_key", "minute").agg(
        F.sum(F.when(F.col("code") == 4532, F.col("counter")).otherwise(0)).alias("inflow"),
        F.sum(F.when(F.col("code").isin(6216, 6217, 6218), F.col("counter")).otherwise(0)).alias("outflow"))
    return queue_balance(cur, fl, "sub_key", "minute")


BITS = {1: "b1", 2: "b2", 4: "b4", 8: "b8", 16: "b16", 32: "b32"}


@query("a53_bitmask_filter_decode", "SELECT concat_ws(', ', " + ", ".join(
    f"CASE WHEN (p_size & {b}) = {b} THEN '{n}' END" for b, n in BITS.items())
    + ") AS classes, count(*) AS parts FROM part WHERE (p_size & 4) = 4 GROUP BY 1")
def a53(spark, sf):
    p = _fx(spark, sf, "part").filter(bit_set("p_size", 4))
    return p.groupBy(bitmask_decode("p_size", BITS).alias("classes")).agg(F.count(F.lit(1)).alias("parts"))


# Counter codes of the message-queue statistics and their names.
ASPECT_NAMES = {4532: "Incoming", 6216: "FirstTrySuccess", 6217: "RetrySuccess", 6218: "FinalError",
                6281: "Retry", 6282: "RetryWait", 7251: "Expired"}


@query("a54_code_label", "SELECT CASE code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ASPECT_NAMES.items() if k != 7251)
       + " ELSE 'other' END AS label, CAST(sum(counter) AS BIGINT) AS counter FROM fx_aspect GROUP BY 1")
def a54(spark, sf):
    names = {k: v for k, v in ASPECT_NAMES.items() if k != 7251}
    a = _fx(spark, sf, "fx_aspect")
    return a.groupBy(code_label("code", names, "other").alias("label")).agg(F.sum("counter").alias("counter"))


@query("a55_flags_to_list", """
SELECT concat_ws(', ', CASE WHEN f1 = 'Y' THEN 'small' END, CASE WHEN f2 = 'Y' THEN 'cheap' END, CASE WHEN f3 = 'Y' THEN 'promo' END) AS flags, count(*) AS parts
FROM (SELECT CASE WHEN p_size < 10 THEN 'Y' ELSE 'N' END AS f1, CASE WHEN p_retailprice < 1000 THEN 'Y' ELSE 'N' END AS f2,
             CASE WHEN p_type LIKE 'PROMO%' THEN 'Y' ELSE 'N' END AS f3 FROM part) t GROUP BY 1""")
def a55(spark, sf):
    p = _fx(spark, sf, "part").select(F.when(F.col("p_size") < 10, "Y").otherwise("N").alias("f1"),
                                      F.when(F.col("p_retailprice") < 1000, "Y").otherwise("N").alias("f2"),
                                      F.when(F.col("p_type").like("PROMO%"), "Y").otherwise("N").alias("f3"))
    return p.groupBy(flags_to_list({"f1": "small", "f2": "cheap", "f3": "promo"}).alias("flags")) \
        .agg(F.count(F.lit(1)).alias("parts"))


@query("a56_contains_ci", """
SELECT source, count(*) AS docs FROM documents
WHERE coalesce(contains(upper(text), 'LICENSE'), false) OR coalesce(contains(upper(source), 'LICENSE'), false) GROUP BY 1""")
def a56(spark, sf):
    d = _fx(spark, sf, "documents")
    return d.filter(contains_ci(["text", "source"], "License")).groupBy("source").agg(F.count(F.lit(1)).alias("docs"))


@query("a57_short_text", """
SELECT substr(sql_text, 1, 20) AS short_text, count(*) AS statements FROM fx_dml GROUP BY 1""")
def a57(spark, sf):
    return _fx(spark, sf, "fx_dml").groupBy(short_text("sql_text", 20).alias("short_text")) \
        .agg(F.count(F.lit(1)).alias("statements"))


@query("a59_format_number_locale", """
SELECT owner, format('{:,}', sum(bytes)) AS bytes_en, translate(format('{:,}', sum(bytes)), ',.', '.,') AS bytes_de
FROM fx_object GROUP BY 1""")
def a59(spark, sf):
    g = _fx(spark, sf, "fx_object").groupBy("owner").agg(F.sum("bytes").alias("b"))
    return g.select("owner", format_number_locale("b", 0, "en").alias("bytes_en"),
                    format_number_locale("b", 0, "de").alias("bytes_de"))


@query("a60_parse_time_selection", """
SELECT event_id, try_strptime(strftime(ts, '%d.%m.%Y %H:%M'), '%d.%m.%Y %H:%M') AS parsed_de,
  try_strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') AS parsed_en, try_strptime(event_type, '%Y-%m-%d') AS parsed_bad
FROM events""")
def a60(spark, sf):
    e = _fx(spark, sf, "events")
    return e.select("event_id", parse_time(F.date_format("ts", "dd.MM.yyyy HH:mm"), "de").alias("parsed_de"),
                    parse_time(F.date_format("ts", "yyyy-MM-dd"), "en").alias("parsed_en"),
                    parse_time("event_type", "en").alias("parsed_bad"))


@query("a61_decode_packed", """
SELECT event_id, (event_id * 4294967296 + user_id) // 4294967296 AS blocking_sid, (event_id * 4294967296 + user_id) % 4294967296 AS shared_refs,
  CASE WHEN c > 19 THEN c - (CAST(floor((c - 15) / 2) AS BIGINT) - 1) * 2 ELSE c END AS class_id,
  CASE WHEN c > 19 THEN CAST(floor((c - 15) / 2) AS BIGINT) END AS undo_segment
FROM (SELECT event_id, user_id, (event_id * 65536 + user_id % 40) % 65536 AS c FROM events) t""")
def a61(spark, sf):
    e = _fx(spark, sf, "events")
    hi, lo = split_word(F.col("event_id") * F.lit(4294967296) + F.col("user_id"), 8)
    cid, undo = block_class(F.col("event_id") * 65536 + F.pmod("user_id", F.lit(40)), F.lit("id#"))
    return e.select("event_id", hi.alias("blocking_sid"), lo.alias("shared_refs"),
                    cid.cast("bigint").alias("class_id"), undo.cast("bigint").alias("undo_segment"))
