"""Hand-made cases of the detail pages."""

import datetime as dt

from pyspark.sql import functions as F

from tempolens.plans import locks
from tempolens.plans import statements as ST
from tempolens.plans import storage as SG
from tempolens.plans.rules import apply_rule
from tempolens.sources import fixture

from conftest import SF01


def test_roots_over_time_are_active_and_inactive(spark):
    from tempolens.suite.q_details import FROM, TO
    out = locks.root_blockers_over_time(*[fixture(spark, SF01, n) for n in ("fx_ash_rac", "fx_ash_rac_live", "fx_ash_snapshot", "fx_ash_object", "fx_db_user")], FROM, TO)
    rows = out.collect()
    did = {r.root_blocking_event for r in rows}
    assert {"INACTIVE", "ON CPU", "click"} <= did and max(r.max_level for r in rows) > 1
    assert all((r.root_blocking_module is None) == (r.root_blocking_event == "INACTIVE") for r in rows)
    assert any(r.root_snap_id is None for r in rows) and all(r.root_sample_time >= dt.datetime(2024, 1, 3) for r in rows)


def test_same_plan_hash_of_another_statement_is_not_reported(spark):
    stat = spark.createDataFrame([(1, 1, n, sid, 7, "A") for n in (1, 2) for sid in ("a", "b")], "dbid int, instance_number int, snap_id int, sql_id string, plan_hash_value long, parsing_schema_name string")
    for c in ("executions", "fetches", "disk_reads", "buffer_gets", "rows_processed", "parse_calls", "elapsed_time", "cpu_time"):
        stat = stat.withColumn(f"{c}_delta", F.lit(2).cast("long"))
    day = dt.datetime(2024, 1, 1)
    snaps = spark.createDataFrame([(1, 1, n, day + dt.timedelta(days=n), day + dt.timedelta(days=n + 1)) for n in (1, 2)],
                                  "dbid int, instance_number int, snap_id int, begin_interval_time timestamp_ntz, end_interval_time timestamp_ntz")
    lines = spark.createDataFrame([(1, "a", 7, 1, "O", "T", "x"), (1, "b", 7, 1, "O", "U", "x"), (2, "b", 7, 1, "O", "T", "x")],
                                  "dbid int, sql_id string, plan_hash_value long, id long, object_owner string, object_name string, operation string")
    lines = lines.withColumn("options", F.lit(None).cast("string")).withColumn("other_tag", F.lit(None).cast("string"))
    texts = spark.createDataFrame([(1, "a", "select 1")], "dbid int, sql_id string, sql_text string")
    used = ST.statements_using_object(lines, stat, snaps, texts, "2024-01-02 00:00:00", "2024-01-04 00:00:00", "t")
    assert [(r.sql_id, r.executions, r.sql_text) for r in used.collect()] == [("a", 4, "select 1")]
    last = ST.statements_with_object_in_last_plan(stat, snaps, lines, texts, 1, "2024-01-01 00:00:00", "2024-01-09 00:00:00", "o", "t")
    assert [r.sql_id for r in last.collect()] == ["a"]


def test_filters_relax_in_turn(spark):
    rows = [(1, "a", 0, "VALID", "S"), (1, "a", 1, "VALID", "T"), (1, "b", 3, "OLD", "S"), (1, "b", 1, "VALID", "T"), (1, "c", 5, "OLD", "T"), (1, "c", 2, None, None), (2, "a", 9, "OLD", "T")]
    cur = spark.createDataFrame(rows, "inst_id int, sql_id string, child_number int, object_status string, parsing_schema_name string")
    cur = cur.withColumn("buffer_gets", F.lit(10)).withColumn("disk_reads", F.lit(1))
    wish = spark.createDataFrame([(1, "a", "VALID", "T"), (1, "b", "VALID", "S"), (1, "c", "VALID", "S"), (1, "none", "VALID", "S"), (2, "a", None, None)],
                                 "inst_id int, sql_id string, object_status string, parsing_schema_name string")
    got = {(r.inst_id, r.sql_id): (r.child_number, r.match_rank, r.suppressed, r.hit_ratio) for r in ST.statement_detail_current(cur, wish).collect()}
    assert got == {(1, "a"): (1, 0, None, 90.0), (1, "b"): (3, 1, "object_status", 90.0), (1, "c"): (2, 2, "object_status, parsing_schema_name", 90.0), (2, "a"): (9, 0, None, 90.0)}
    from tempolens.suite.q_details import d03_current
    assert {r.match_rank for r in d03_current(spark, SF01).select("match_rank").distinct().collect()} == {0, 1, 2}


def test_composite_references_in_both_directions(spark):
    cons = spark.createDataFrame([("o", "PK_P", "P", "P", None, None), ("o", "FK_1", "R", "C", "o", "PK_P"), ("o", "FK_2", "R", "D", "o", "PK_P")],
                                 "owner string, constraint_name string, constraint_type string, table_name string, r_owner string, r_constraint_name string")
    cols = spark.createDataFrame([("o", "PK_P", "Z", 1), ("o", "PK_P", "A", 2), ("o", "FK_1", "P_A", 2), ("o", "FK_1", "P_Z", 1), ("o", "FK_2", "ONLY", 1)],
                                 "owner string, constraint_name string, column_name string, position int")
    tabs = spark.createDataFrame([("o", t, n) for n, t in enumerate("PCD")], "owner string, table_name string, num_rows int")
    assert [(r.r_table_name, r.pairs, r.num_rows) for r in SG.references(cons, cols, tabs, "C", "o").collect()] == [("P", "P_Z = Z, P_A = A", 0)]
    into = {r.table_name: (r.columns, r.r_columns, r.pairs, r.num_rows) for r in SG.references(cons, cols, tabs, "P", "o", incoming=True).collect()}
    assert into == {"C": ("P_Z, P_A", "Z, A", "P_Z = Z, P_A = A", 1), "D": ("ONLY", "Z, A", "ONLY = Z,  = A", 2)}
    assert SG.references(cons, cols, tabs, "P", "o").count() == 0


def test_functions_in_parallel_texts_only(spark):
    proc = spark.createDataFrame([("A", "F_X", None, "FUNCTION", "NO"), ("A", "PK", "RUN", "PACKAGE", "NO"), ("A", "PK", None, "PACKAGE", "NO"), ("SYS", "F_S", None, "FUNCTION", "NO"),
                                  ("A", "F_P", None, "FUNCTION", "YES"), ("A", "F9", None, "FUNCTION", "NO")], "owner string, object_name string, procedure_name string, object_type string, parallel string")
    texts = {"1": "select /*+ parallel */ f_x(a), pk.run(b) from t", "2": "select f_x(a) from t", "3": " begin /* parallel */ f_x(1); end;", "4": "/*+ parallel */ xf_x(a), f_xy(b), pk . run(c), pk.runs(d)",
             "5": "/*+ parallel */ f_s(1), f_p(2), f9(3)", "6": "explain /*+ parallel */ f_x(a)", "7": "f_x parallel f_x", "8": None, "9": "parallel a=f_x9(1) pk2.run(1)"}
    area = spark.createDataFrame([(i, t, 1_000_000) for i, t in texts.items()], "sql_id string, sql_text string, elapsed_time long")
    none = {n: fixture(spark, SF01, v).where("false") for n, v in (("sqlstat", "fx_hist_stat"), ("hist_texts", "fx_par_text"))}
    got = {(r.sql_id, r.object_name, r.procedure_name) for r in apply_rule("R38", {"procedures": proc, "sqlarea": area, "snapshot": fixture(spark, SF01, "fx_hist_snapshot"), **none}).collect()}
    assert got == {("1", "F_X", None), ("1", "PK", "RUN"), ("5", "F9", None), ("9", "F_X", None)}


def test_value_or_counts_needs_no_expand(spark):
    """Nulls, blanks, an all-null group and a null group; the plan holds no Expand."""
    from tempolens.operators.grouping import value_or_counts
    df = spark.createDataFrame([("a", "x", None, 1), ("a", "y", None, 2), ("a", None, None, 3), (None, "z", " ", 4), (None, "z", None, 5)],
                               "g string, p string, q string, m int")
    by, dims, ms = {"g": F.col("g")}, {"p": F.col("p"), "q": F.col("q")}, {"m": F.sum("m")}
    counted = value_or_counts(df, by, dims, ms, null_counts=True)
    assert sorted(map(tuple, counted.collect()), key=str) == [("a", 6, "< 3 >", None), (None, 9, "z", " ")]
    ignored = value_or_counts(df, by, dims, ms, null_counts=False)
    assert sorted(map(tuple, ignored.collect()), key=str) == [("a", 6, "< 2 >", "< 0 >"), (None, 9, "z", " ")]
    assert value_or_counts(df.limit(0), by, dims, ms).collect() == []
    assert "Expand" not in counted._jdf.queryExecution().executedPlan().toString()
