"""Joins whose sides grow with the input are merged; those with one row per instance are broadcast."""

from pyspark.sql import functions as F

from tempolens.operators.history import range_join_snaps
from tempolens.operators.textscan import call_argument_scan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunked_scan_broadcasts_nothing(spark, tmp_path):
    """A small file may hold many texts, and their pieces are more still."""
    spark.createDataFrame([(1, "select nvl(a, f(b)) from t")], "id int, txt string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = call_argument_scan(df, "id", "txt", chunk=4)
    assert "Broadcast" not in _plan(got)
    assert [(r.call_no, r.call_parameter) for r in got.collect()] == [(1, "(A, F(B))")]


def test_range_join_does_not_deal_facts_by_instance(spark):
    facts = spark.range(1000).select(F.lit(1).alias("dbid"), (F.col("id") % 2 + 1).cast("int").alias("instance_number"), F.col("id").alias("snap_id"))
    borders = spark.range(2).select(F.lit(1).alias("dbid"), (F.col("id") + 1).cast("int").alias("instance_number"),
                                    F.lit(10).alias("start_snap_id"), F.lit(19).alias("end_snap_id"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:  # as if the size of the borders were not known to be small
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = range_join_snaps(facts, borders)
        assert "hashpartitioning" not in _plan(got)
        assert sorted(r.snap_id for r in got.collect()) == list(range(10, 20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def _cartesian_plan(spark):
    return spark.createDataFrame([
        ("s", 1, 0, None, "SELECT", None, None, None), ("s", 1, 1, 0, "MERGE JOIN", "CARTESIAN", None, None),
        ("s", 1, 2, 1, "MERGE JOIN", "CARTESIAN", None, None), ("s", 1, 3, 2, "TABLE ACCESS", "FULL", "o", "t"), ("s", 1, 4, 1, "SORT", None, "o", "u")],
        "sql_id string, plan_hash_value int, id long, parent_id long, operation string, options string, object_owner string, object_name string")


def test_marked_lines_are_merged(spark):
    from tempolens.operators.trees import marked_above
    got = marked_above(_cartesian_plan(spark), ["sql_id", "plan_hash_value"], F.col("options") == "CARTESIAN", F.col("object_name").isNull())
    assert "Broadcast" not in _plan(got)
    assert sorted((r.id, r.level) for r in got.collect()) == [(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 2)]


def test_cartesian_history_is_summed_before_the_join(spark):
    """Lines and history rows of a plan do not meet one by one, and lines below two joins count twice."""
    from tempolens.plans.rules import apply_rule
    stat = spark.createDataFrame([(1, 1, 1, "s", 1, 2, 60_000_000), (1, 1, 1, "s", 1, 3, 50_000_000), (1, 2, 1, "s", 1, 1, 40_000_000)],
                                 "dbid int, instance_number int, snap_id int, sql_id string, plan_hash_value int, executions_delta long, elapsed_time_delta long")
    snaps = spark.sql("SELECT 1 AS dbid, CAST(id + 1 AS INT) AS instance_number, 1 AS snap_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS begin_interval_time FROM range(2)")
    got = apply_rule("R46", {"sql_plan": _cartesian_plan(spark), "sqlstat": stat, "snapshot": snaps}, days=8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
    assert sorted((r.instance_number, r.line_id, r.executions, r.elapsed_secs) for r in got.collect()) == [(1, 3, 10, 220.0), (1, 4, 5, 110.0)]


def test_few_keys_joins_columns_of_found_indexes_only(spark):
    """Columns of indexes that are not in the result do not meet the table columns."""
    from tempolens.plans.rules import apply_rule
    tables = spark.createDataFrame([("o", "t", 900, None)], "owner string, table_name string, num_rows long, iot_type string")
    indexes = spark.createDataFrame([("o", f"i{k}", "o", "t", 800, 2 if k < 2 else 500, 10) for k in range(6)],
                                    "owner string, index_name string, table_owner string, table_name string, num_rows long, distinct_keys long, leaf_blocks long")
    ind = spark.createDataFrame([("o", f"i{k}", "o", "t", "a" if k else "b", 1) for k in range(6)],
                                "index_owner string, index_name string, table_owner string, table_name string, column_name string, column_position int")
    cols = spark.createDataFrame([("o", "t", "a", "N"), ("o", "t", "b", "Y")], "owner string, table_name string, column_name string, nullable string")
    got = apply_rule("R09", {"tables": tables, "indexes": indexes, "ind_columns": ind, "tab_columns": cols}, min_rows=200, max_distinct_keys=3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    assert sorted((r.index_name, r.rows_per_key, r.possible_nulls, r.nullable) for r in got.collect()) == [("i0", 400.0, 100, "NULLABLE"), ("i1", 400.0, 100, "NOT NULL")]


def test_statement_detail_has_no_expand_and_is_not_dealt_by_snapshot(spark):
    from tempolens.plans.statements import WAIT_SPLIT, statement_detail
    deltas = [f"{c}_delta" for c in ("executions", "fetches", "parse_calls", "sorts", "loads", "disk_reads", "buffer_gets", "rows_processed", "elapsed_time", "cpu_time")]
    stat = spark.createDataFrame([(1, 1, 6, "s", 3, 0, None), (1, 1, 7, "s", 4, 1, None), (1, 1, 7, "s", 0, 1, None), (1, 1, 9, "s", 5, 2, None)],
                                 "dbid int, instance_number int, snap_id int, sql_id string, plan_hash_value long, optimizer_env_hash_value long, parsing_schema_name string")
    stat = stat.select("*", *[F.lit(1).cast("long").alias(c) for c in {*deltas, *WAIT_SPLIT}], F.lit("m").alias("module"), F.lit("a").alias("action"))
    snaps = spark.sql("SELECT 1 AS dbid, 1 AS instance_number, CAST(id AS INT) AS snap_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS begin_interval_time,"
                      " TIMESTAMP_NTZ '2024-01-02 00:00:00' AS end_interval_time FROM range(5, 10)")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:  # as if the size of the snapshots were not known to be small
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = statement_detail(stat, snaps, 6, 8)
        assert "Expand" not in _plan(got) and "SortMergeJoin" not in _plan(got)
        assert [(r.plan_hash_values, r.optimizer_envs, r.last_plan_hash_value, r.executions, r.parsing_schema_name) for r in got.collect()] == [(2, 2, 4, 3, "[UNKNOWN]")]
        assert dict(got.dtypes)["plan_hash_values"] == "bigint"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_index_only_lines_are_dealt_by_object(spark):
    """Plan lines that come dealt by their plan do not stay in as many tasks as there are plans."""
    from tempolens.plans.rules import apply_rule
    table = "owner string, table_name string, column_name string, num_distinct long"
    cols = spark.createDataFrame([("o", "t", "a", 90), ("o", "t", "b", 2)], table)
    ind = spark.createDataFrame([("o", i, "o", "t", c) for i in ("i", "j") for c in "ab"], "index_owner string, index_name string, table_owner string, table_name string, column_name string")
    indexes = spark.createDataFrame([("o", i, "o", "t", 200, "NONUNIQUE") for i in ("i", "j")],
                                    "owner string, index_name string, table_owner string, table_name string, num_rows long, uniqueness string")
    lines = spark.createDataFrame([("s", 1, "o", "i"), ("s", 1, "o", "t"), ("s", 2, "o", "j"), ("s", 2, "o", "j"), ("s", 2, None, None)],
                                  "sql_id string, plan_hash_value int, object_owner string, object_name string").repartition(2, "plan_hash_value")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = apply_rule("R12", {"tab_columns": cols, "ind_columns": ind, "indexes": indexes, "sql_plan": lines}, min_rows=100)
        assert "hashpartitioning(plan_hash_value" not in _plan(got)
        assert [(r.index_name, r.max_column, r.min_column) for r in got.collect()] == [("i", "a", "b")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_current_details_shuffle_the_facts_once(spark):
    """Before, the grouped cursors were dealt a second time for the join with the wishes."""
    from tempolens.plans.statements import statement_detail_current
    from tempolens.sources import fixture
    from tempolens.suite.q_details import d03_current
    sf = "/root/testdata/sf0.001"
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = d03_current(spark, sf)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_COL") == 1 and plan.count("ENSURE_REQUIREMENTS") == 1  # the facts; the wishes
        c = fixture(spark, sf, "fx_cur_sql")
        wish = c.select("inst_id", "sql_id").distinct().selectExpr("*", "'VALID' AS object_status", "'A' AS parsing_schema_name")
        want = statement_detail_current(c, wish)
        assert got.schema == want.schema and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
