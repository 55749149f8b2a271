"""Statement-history reports (D01-D18), SURVEY 2.D.

Facts: per-snapshot statement statistics with ``*_delta`` columns, keyed by
(dbid, instance_number, snap_id, sql_id, plan_hash_value).  Texts, plan
lines and catalog tables are joined after aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contains_ci, first_value_by, flags_to_list, hit_ratio, last_value_by, per_unit, trunc_time
from ..operators.grouping import period_compare, top_sort
from ..operators.history import range_join_snaps, snapshot_borders
from ..operators.hierarchy import positional_compare, variant_compare
from ..operators.trees import tree_numbers

INST = ["dbid", "instance_number"]

# The reference's sort modes of the top-statement list.
HISTORY_SORT_MODES = ("ElapsedTimePerExecute", "ElapsedTimeTotal", "ExecutionCount", "RowsProcessed",
                      "ExecsPerDisk", "BufferGetsPerRow", "CPUTime", "BufferGets", "ClusterWaits")


def _opt_sum(df: DataFrame, col: str, alias: str):
    return F.sum(col).alias(alias) if col in df.columns else F.lit(None).cast("bigint").alias(alias)


def history_measures(df: DataFrame) -> list:
    return [F.sum("executions_delta").alias("executions"),
            F.round(F.sum("elapsed_time_delta") / F.lit(1e6), 6).alias("elapsed_time_secs"),
            _opt_sum(df, "cpu_time_delta", "cpu_time"),
            F.sum("disk_reads_delta").alias("disk_reads"),
            F.sum("buffer_gets_delta").alias("buffer_gets"),
            F.sum("rows_processed_delta").alias("rows_processed"),
            _opt_sum(df, "parse_calls_delta", "parse_calls"),
            _opt_sum(df, "clwait_delta", "cluster_wait_time"),
            F.min("snap_id").alias("min_snap_id"), F.max("snap_id").alias("max_snap_id")]


def history_sort_modes() -> dict:
    return {
        "ElapsedTimePerExecute": F.round(per_unit("elapsed_time_secs", "executions"), 6),
        "ElapsedTimeTotal": F.col("elapsed_time_secs"),
        "ExecutionCount": F.col("executions"),
        "RowsProcessed": F.col("rows_processed"),
        "ExecsPerDisk": F.round(per_unit("executions", "disk_reads"), 6),
        "BufferGetsPerRow": F.round(per_unit("buffer_gets", "rows_processed"), 6),
        "CPUTime": F.col("cpu_time"),
        "BufferGets": F.col("buffer_gets"),
        "ClusterWaits": F.col("cluster_wait_time"),
    }


def top_statements_history(sqlstat: DataFrame, snaps: DataFrame, texts: DataFrame, start, end,
                           sort: str = "ElapsedTimeTotal", n: int = 100, text_filter: str | None = None,
                           instance: int | None = None, sql_id: str | None = None) -> DataFrame:
    """Top statements of a time range by one of nine sort modes.

    Bracketing snapshots per instance (A13) -> range join of the facts (A14)
    -> aggregate per statement -> text join and optional text filter ->
    distributed top-n (A24).
    """
    s = snaps if instance is None else snaps.filter(F.col("instance_number") == instance)
    f = sqlstat if sql_id is None else sqlstat.filter(F.col("sql_id") == sql_id)
    borders = snapshot_borders(s, start, end)
    facts = range_join_snaps(f, borders)
    keys = ["dbid", "sql_id", "instance_number", "parsing_schema_name"]
    facts = facts.withColumn("parsing_schema_name", F.coalesce("parsing_schema_name", F.lit("[UNKNOWN]")))
    g = facts.groupBy(*keys).agg(*history_measures(facts))
    t = texts.select("sql_id", "sql_text")
    out = g.join(t, "sql_id", "inner").withColumn("short_text", F.substring("sql_text", 1, 40))
    if text_filter:
        out = out.filter(contains_ci("sql_text", text_filter))
    modes = history_sort_modes()
    return top_sort(out.withColumn("sort_value", modes[sort]), {sort: F.col("sort_value")}, sort, n,
                    ["sql_id", "instance_number", "parsing_schema_name"])


def top_statements_current(area: DataFrame, children: DataFrame, sort: str, n: int) -> DataFrame:
    """Top statements of the cursor cache with child and plan counts."""
    ch = children.groupBy("sql_id").agg(F.count(F.lit(1)).alias("child_count"),
                                        F.count_distinct("plan_hash_value").alias("plan_count"))
    out = area.join(ch, "sql_id", "left")
    modes = {"ElapsedTimeTotal": F.col("elapsed_time"), "ExecutionCount": F.col("executions"),
             "ElapsedTimePerExecute": per_unit("elapsed_time", "executions"),
             "BufferGets": F.col("buffer_gets"), "BufferGetsPerExec": per_unit("buffer_gets", "executions"),
             "DiskReads": F.col("disk_reads"), "DiskReadsPerExec": per_unit("disk_reads", "executions"),
             "RowsProcessed": F.col("rows_processed"), "ChildCount": F.col("child_count"),
             "PlanCount": F.col("plan_count")}
    return top_sort(out, modes, sort, n, ["sql_id"])


def statement_summary(sqlstat: DataFrame, keys=("dbid", "sql_id")) -> DataFrame:
    """One row per statement: last plan, plan count, totals, hit ratio, last module."""
    k = list(keys)
    g = sqlstat.groupBy(*k).agg(
        last_value_by("plan_hash_value", "snap_id").alias("last_plan_hash_value"),
        F.count_distinct("plan_hash_value").alias("plan_count"),
        F.sum("executions_delta").alias("executions"),
        F.sum("elapsed_time_delta").alias("elapsed_time"),
        F.sum("buffer_gets_delta").alias("buffer_gets"),
        F.sum("disk_reads_delta").alias("disk_reads"),
        last_value_by("module", "snap_id").alias("last_module"),
        F.min("snap_id").alias("min_snap_id"), F.max("snap_id").alias("max_snap_id"))
    return g.withColumn("hit_ratio", F.round(hit_ratio("buffer_gets", "disk_reads"), 4)) \
            .withColumn("elapsed_per_exec", F.round(per_unit("elapsed_time", "executions"), 6))


WAIT_SPLIT = {"clwait_delta": "cluster_wait_secs", "apwait_delta": "application_wait_secs", "ccwait_delta": "concurrency_wait_secs",
              "iowait_delta": "user_io_wait_secs", "plsexec_time_delta": "plsql_exec_secs"}


def _distinct(col):
    """Number of distinct non-null values, as the size of their set."""
    return F.size(F.collect_set(col)).cast("long")


def statement_detail(sqlstat: DataFrame, snaps: DataFrame, min_snap: int, max_snap: int, unknown: str = "[UNKNOWN]") -> DataFrame:
    """Full history summary of every (dbid, instance, statement, schema) of a snapshot range.

    Last plan, environment, module and action are those of the last snapshot; plan
    hash 0 is no plan; a null schema is ``unknown``, like in the filter of the
    detail page.  Ratios divide by 1 where the divisor is 0.

    The snapshots have one row per instance and interval and are broadcast: dealt
    by them, the facts would lie in as many tasks.  Plans and environments are few
    per statement; their sets need no Expand of the rows.
    """
    s = sqlstat.where(F.col("snap_id").between(min_snap, max_snap)).withColumn("parsing_schema_name", F.coalesce("parsing_schema_name", F.lit(unknown)))
    b = snaps.where(F.col("snap_id").between(min_snap, max_snap)).select(*INST, "snap_id", "begin_interval_time", "end_interval_time")
    j = s.join(F.broadcast(b), INST + ["snap_id"])
    execs, gets, disk = F.sum("executions_delta"), F.sum("buffer_gets_delta"), F.sum("disk_reads_delta")
    plan = F.col("plan_hash_value")
    return j.groupBy(*INST, "sql_id", "parsing_schema_name").agg(
        last_value_by("plan_hash_value", "snap_id").alias("last_plan_hash_value"),
        _distinct(F.when(plan != 0, plan)).alias("plan_hash_values"),
        last_value_by("optimizer_env_hash_value", "snap_id").alias("last_optimizer_env"),
        _distinct("optimizer_env_hash_value").alias("optimizer_envs"),
        *[F.sum(f"{c}_delta").alias(c) for c in ("executions", "fetches", "parse_calls", "sorts", "loads", "disk_reads", "buffer_gets", "rows_processed")],
        ((gets - disk) * 100 / F.greatest(gets, F.lit(1))).alias("hit_ratio"),
        F.round(F.sum("elapsed_time_delta") / 1e6, 6).alias("elapsed_secs"),
        per_unit(F.sum("elapsed_time_delta") / 1e6, execs).alias("elapsed_secs_per_exec"),
        F.round(F.sum("cpu_time_delta") / 1e6, 6).alias("cpu_secs"),
        per_unit(disk, execs).alias("disk_reads_per_exec"), per_unit(execs, disk).alias("execs_per_disk"),
        per_unit(gets, execs).alias("buffer_gets_per_exec"),
        per_unit(gets, F.sum("rows_processed_delta")).alias("buffer_gets_per_row"),
        *[F.round(F.sum(c) / 1e6, 6).alias(a) for c, a in WAIT_SPLIT.items()],
        F.min("begin_interval_time").cast("timestamp_ntz").alias("first_occurrence"), F.max("end_interval_time").cast("timestamp_ntz").alias("last_occurrence"),
        last_value_by("module", "snap_id").alias("last_module"), last_value_by("action", "snap_id").alias("last_action"))


def statement_detail_current(cursors: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cursor that best meets each wanted (inst_id, sql_id, object_status, parsing_schema_name).

    Filters relax in turn: first the status goes, then the schema too, and
    ``suppressed`` names what was left out.  All ranks are tried in one pass: each
    candidate carries the rank it meets, and a statement keeps the least (rank,
    child) as a struct minimum, so nothing is looked up again.  A null wish is no
    filter.  Statements without any cursor give no row.
    """
    wish = wanted.select("inst_id", "sql_id", F.col("object_status").alias("_status"), F.col("parsing_schema_name").alias("_schema"))
    status = F.col("_status").isNull() | F.coalesce(F.col("object_status") == F.col("_status"), F.lit(False))
    schema = F.col("_schema").isNull() | F.coalesce(F.col("parsing_schema_name") == F.col("_schema"), F.lit(False))
    rank = F.when(status & schema, 0).when(schema, 1).otherwise(2)
    rest = [c for c in cursors.columns if c not in ("inst_id", "sql_id", "child_number")]
    best = (cursors.join(wish, ["inst_id", "sql_id"]).groupBy("inst_id", "sql_id", "_status", "_schema").agg(
        F.min(F.struct(rank.alias("rank"), "child_number", *rest)).alias("b"), F.count_distinct("child_number").alias("child_count")))
    said = F.when(F.col("b.rank") == 1, F.lit("object_status")).when(
        F.col("b.rank") == 2, F.when(F.col("_status").isNull(), F.lit("parsing_schema_name")).otherwise(F.lit("object_status, parsing_schema_name")))
    gets, disk = F.col("b.buffer_gets"), F.col("b.disk_reads")
    return best.select("inst_id", "sql_id", "child_count", F.col("b.rank").alias("match_rank"), said.alias("suppressed"), "b.child_number",
                       *[F.col(f"b.{c}") for c in rest], ((gets - disk) * 100 / F.greatest(gets, F.lit(1))).alias("hit_ratio"))


def statement_per_period(sqlstat: DataFrame, snaps: DataFrame, unit: str | None = "DD") -> DataFrame:
    """Statement statistics per snapshot (unit None) or per truncated day/month."""
    j = sqlstat.join(snaps.select(*INST, "snap_id", "begin_interval_time"), INST + ["snap_id"], "inner")
    period = F.col("snap_id") if unit is None else trunc_time("begin_interval_time", unit)
    return j.groupBy("sql_id", period.alias("period")).agg(
        F.sum("executions_delta").alias("executions"), F.sum("elapsed_time_delta").alias("elapsed_time"),
        F.sum("buffer_gets_delta").alias("buffer_gets"), F.sum("disk_reads_delta").alias("disk_reads"))


def plan_lines_marked(lines: DataFrame, plan: str = "plan_hash_value", strict=None, loose=None,
                      compare=None) -> DataFrame:
    """Plan lines of all variants with execution order and difference marks.

    A31 levels and post-order by doubling, A32 strict/loose counts, A33
    positional difference.
    """
    ordered = tree_numbers(lines, [plan]).drop("subtree_lines")
    counted = variant_compare(ordered, strict, loose)
    return positional_compare(counted, plan, "id", compare or strict)


def time_per_plan_line(samples: DataFrame, plan: DataFrame, keys=("plan_hash_value", "id"),
                       weight: str = "sample_cycle", state: str = "wait_class") -> DataFrame:
    """DB, CPU and wait seconds per plan line."""
    k = list(keys)
    on_cpu = F.col(state).isNull()
    t = samples.groupBy(*k).agg(F.sum(weight).alias("db_secs"),
                                F.sum(F.when(on_cpu, F.col(weight)).otherwise(0)).alias("cpu_secs"),
                                F.sum(F.when(~on_cpu, F.col(weight)).otherwise(0)).alias("wait_secs"),
                                F.count(F.lit(1)).alias("samples"))
    return plan.join(t, k, "left")


PLAN = ["dbid", "sql_id", "plan_hash_value"]


def _object_lines(lines: DataFrame, name: str, owner: str | None, like: bool = True) -> DataFrame:
    """Plan lines on an object; names are compared in upper case, the name as a pattern."""
    hit = F.col("object_name").like(name.upper()) if like else F.col("object_name") == name.upper()
    return lines.where(hit if owner is None else hit & (F.col("object_owner") == owner.upper()))


def statements_using_object(lines: DataFrame, sqlstat: DataFrame, snaps: DataFrame, texts: DataFrame, start, end,
                            name: str, owner: str | None = None, instance: int | None = None) -> DataFrame:
    """Statements of the history whose plans touch an object, within bracketing snapshots.

    Lines meet statistics by database, statement and plan, so a statement that only
    shares a plan hash with another one is not reported.  The lines of an object are
    few and go first; a plan with the object in several lines of one kind counts its
    statistics once for each, as the lines are listed.
    """
    borders = snapshot_borders(snaps, start, end).select(*INST, "start_snap_id", "end_snap_id")
    inside = snaps.join(borders, INST).where(F.col("snap_id").between(F.col("start_snap_id"), F.col("end_snap_id")))
    inside = inside.select(*INST, "snap_id", "begin_interval_time", "end_interval_time")
    hit = _object_lines(lines, name, owner).select(*PLAN, "operation", "options", "other_tag")
    s = sqlstat if instance is None else sqlstat.where(F.col("instance_number") == instance)
    j = s.join(hit, PLAN).join(inside, INST + ["snap_id"])
    execs = F.sum("executions_delta")
    out = j.groupBy("dbid", "sql_id", "instance_number", "parsing_schema_name", "operation", "options", "other_tag").agg(
        F.min("begin_interval_time").cast("timestamp_ntz").alias("first_occurrence"), F.max("end_interval_time").cast("timestamp_ntz").alias("last_occurrence"),
        *[F.sum(f"{c}_delta").alias(c) for c in ("executions", "fetches", "disk_reads", "buffer_gets", "rows_processed", "parse_calls")],
        F.round(F.sum("elapsed_time_delta") / 1e6, 6).alias("elapsed_secs"), F.round(F.sum("cpu_time_delta") / 1e6, 6).alias("cpu_secs"),
        per_unit(F.sum("elapsed_time_delta") / 1e6, execs).alias("elapsed_secs_per_exec"),
        *[per_unit(F.sum(f"{c}_delta"), execs).alias(f"{c}_per_exec") for c in ("disk_reads", "buffer_gets", "rows_processed")],
        F.min("snap_id").alias("min_snap_id"), F.max("snap_id").alias("max_snap_id"))
    return out.join(texts.select("dbid", "sql_id", F.substring("sql_text", 1, 100).alias("sql_text")), ["dbid", "sql_id"], "left")


def statements_using_object_current(lines: DataFrame, cursors: DataFrame, name: str, owner: str | None = None, instance: int | None = None) -> DataFrame:
    """Cursors whose plans touch an object, one row for each line (D08, current)."""
    key = ["inst_id", "sql_id", "plan_hash_value", "child_number"]
    hit = _object_lines(lines if instance is None else lines.where(F.col("inst_id") == instance), name, owner)
    j = cursors.join(hit.select(*key, F.col("id").alias("line_id"), "operation", "options"), key)
    return j.select(*key, "line_id", "operation", "options", "parsing_schema_name", "executions", "fetches", "rows_processed", "disk_reads", "buffer_gets",
                    F.round(F.col("elapsed_time") / 1e6, 6).alias("elapsed_secs"),
                    per_unit(F.col("elapsed_time") / 1e6, "executions").alias("elapsed_secs_per_exec"),
                    *[per_unit(c, "executions").alias(f"{c}_per_exec") for c in ("disk_reads", "buffer_gets", "rows_processed")])


def statements_with_object_in_last_plan(sqlstat: DataFrame, snaps: DataFrame, lines: DataFrame, texts: DataFrame, instance: int, start, end,
                                        owner: str, name: str) -> DataFrame:
    """Statements of an instance and time range whose *last* plan there touches an object.

    The last plan is taken for each database, statement, instance and schema, and
    must itself be the plan of this statement that has a line on the object.
    """
    begin = F.col("begin_interval_time")
    inside = snaps.where((F.col("instance_number") == instance) & (begin > F.lit(start).cast("timestamp_ntz")) & (begin < F.lit(end).cast("timestamp_ntz")))
    s = sqlstat.join(inside.select(*INST, "snap_id"), INST + ["snap_id"], "left_semi")
    execs = F.sum("executions_delta")
    last = s.groupBy("dbid", "sql_id", "instance_number", "parsing_schema_name").agg(
        last_value_by("plan_hash_value", "snap_id").alias("plan_hash_value"),
        *[F.sum(f"{c}_delta").alias(c) for c in ("executions", "disk_reads", "buffer_gets", "rows_processed")],
        F.round(F.sum("elapsed_time_delta") / 1e6, 6).alias("elapsed_secs"), F.round(F.sum("cpu_time_delta") / 1e6, 6).alias("cpu_secs"),
        per_unit(F.sum("elapsed_time_delta") / 1e6, execs).alias("elapsed_secs_per_exec"),
        F.min("snap_id").alias("min_snap_id"), F.max("snap_id").alias("max_snap_id"))
    out = last.join(_object_lines(lines, name, owner, like=False).select(*PLAN), PLAN)
    return out.join(texts.select("dbid", "sql_id", F.substring("sql_text", 1, 100).alias("sql_text")), ["dbid", "sql_id"], "left") \
        .withColumnRenamed("plan_hash_value", "last_plan_hash_value")


def two_period_comparison(sqlstat: DataFrame, texts: DataFrame, first, second, min_pct: float) -> DataFrame:
    """Statements that got slower per execution from period 1 to period 2, with text."""
    pc = period_compare(sqlstat, ["sql_id", "parsing_schema_name"], first, second, "executions_delta",
                        "elapsed_time_delta", rows="rows_processed_delta", plan="plan_hash_value",
                        instance="instance_number", min_pct=min_pct)
    return pc.join(texts.select("sql_id", "sql_text"), "sql_id", "inner")


def best_source(history: DataFrame, current: DataFrame, schema: str) -> DataFrame:
    """Per statement, where to read its details: history, cursor cache or text only.

    History wins when it has rows of the wanted schema or exactly one
    schema; else the cursor cache under the same rule; else text only.
    The chosen schema is the wanted one or the single one found.
    """
    def probe(df, sfx):
        return df.groupBy("sql_id").agg(
            F.sum(F.when(F.col("parsing_schema_name") == schema, 1).otherwise(0)).alias(f"hits_{sfx}"),
            F.min("parsing_schema_name").alias(f"schema_{sfx}"),
            F.count_distinct("parsing_schema_name").alias(f"schemas_{sfx}"))
    j = probe(history, "h").join(probe(current, "c"), "sql_id", "full")
    ok_h = (F.col("hits_h") > 0) | (F.col("schemas_h") == 1)
    ok_c = (F.col("hits_c") > 0) | (F.col("schemas_c") == 1)
    src = F.when(ok_h, F.lit("history")).when(ok_c, F.lit("current")).otherwise(F.lit("text"))
    sch = F.when(ok_h, F.when(F.col("hits_h") > 0, F.lit(schema)).otherwise(F.col("schema_h"))) \
        .when(ok_c, F.when(F.col("hits_c") > 0, F.lit(schema)).otherwise(F.col("schema_c")))
    return j.select("sql_id", src.alias("source"), sch.alias("parsing_schema_name"))


def shared_cursor_reasons(children: DataFrame, flags: dict[str, str], keys=("sql_id", "child_number")) -> DataFrame:
    """Reasons why a child cursor was not shared, as a list of names."""
    return children.select(*keys, flags_to_list(flags).alias("reasons"))


def result_cache_usage(objs: DataFrame, name: str = "name", created: str = "creation_time",
                       creator: str = "creator_uid", rows: str = "row_count", row_size: str = "row_size_avg") -> DataFrame:
    """Result-cache usage by name: first/last creator, weighted average row size."""
    return objs.groupBy(name).agg(
        F.min(created).alias("min_creation_time"), F.max(created).alias("max_creation_time"),
        first_value_by(creator, created).alias("first_creator"), last_value_by(creator, created).alias("last_creator"),
        F.sum(rows).alias("row_count"),
        F.round(F.try_divide(F.sum(F.col(row_size) * F.col(rows)), F.sum(rows)), 4).alias("row_size_avg"))


def memory_components(comps: DataFrame, pool: str = "pool", name: str = "name", size: str = "bytes") -> DataFrame:
    """Memory components by pool; components outside a pool are listed by their own name."""
    return comps.groupBy(F.coalesce(F.col(pool), F.col(name)).alias("pool")).agg(
        F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("components"))


def cached_blocks(blocks: DataFrame, obj: str = "object_id", status: str = "status", weight: str | None = None) -> DataFrame:
    """Cached blocks per object split by status, with the share of the whole cache.

    weight: column with the number of blocks a row stands for (pre-aggregated input).
    """
    n = F.col(weight) if weight else F.lit(1)
    g = blocks.groupBy(obj).agg(F.sum(n).alias("blocks"),
                                F.sum(F.when(F.col(status) == "xcur", n).otherwise(0)).alias("blocks_xcur"),
                                F.sum(F.when(F.col(status) == "cr", n).otherwise(0)).alias("blocks_cr"),
                                F.sum(F.when(F.col(status) == "free", n).otherwise(0)).alias("blocks_free"))
    total = g.select(F.sum("blocks")).scalar()
    return g.withColumn("pct_of_cache", F.round(F.try_divide(F.col("blocks") * F.lit(100.0), total), 4))


def open_cursors(cursors: DataFrame, workareas: DataFrame | None = None, by: str = "sql_id") -> DataFrame:
    """Open cursors per statement (or per session) with work-area memory sums."""
    g = cursors.groupBy(by).agg(F.count(F.lit(1)).alias("open_cursors"),
                                F.count_distinct("session_id").alias("sessions"))
    if workareas is not None:
        w = workareas.groupBy(by).agg(F.sum("actual_mem_used").alias("work_area_bytes"))
        g = g.join(w, by, "left")
    return g


def segment_stats_per_snapshot(segstats: DataFrame, objects: DataFrame, keys=("owner", "segment_name"),
                               ts: str = "gather_date", measure: str = "size_units") -> DataFrame:
    """Segment statistics per snapshot for the objects of a selection (D13): semi join, then aggregate."""
    k = list(keys)
    s = segstats.join(objects.select(*k).distinct(), k, "left_semi")
    return s.groupBy(*k, ts).agg(F.sum(measure).alias(measure), F.count(F.lit(1)).alias("segments"))


def segment_statistics_totals(segstat: DataFrame, snaps: DataFrame, objects: DataFrame, waits: DataFrame,
                              plan_lines: DataFrame, start, end, counters=("logical_reads_delta", "physical_reads_delta",
                                                                           "row_lock_waits_delta")) -> DataFrame:
    """Segment statistics of a time range per object with waits and statement counts.

    Snapshots inside the bracketing borders (A13) select the statistics rows
    by a semi join on (dbid, snap_id, instance_number); per object the deltas
    are summed and the allocated space's last minus first value taken
    (A04); object names, sampled wait seconds per object and the number of
    statements whose plans use it are left-joined after aggregation.
    """
    from ..operators.history import snapshot_borders
    b = snapshot_borders(snaps, start, end).select("dbid", "instance_number", "start_snap_id", "end_snap_id")
    inside = snaps.join(b, ["dbid", "instance_number"], "inner") \
        .filter(F.col("snap_id").between(F.col("start_snap_id"), F.col("end_snap_id"))).select("dbid", "instance_number", "snap_id")
    s = segstat.join(inside, ["dbid", "instance_number", "snap_id"], "left_semi")
    per = s.groupBy("obj", "instance_number").agg(
        F.min("snap_id").alias("min_snap_id"), F.max("snap_id").alias("max_snap_id"), *[F.sum(c).alias(c) for c in counters],
        F.max("space_allocated_total").alias("max_space_allocated"),
        (last_value_by("space_allocated_total", "snap_id") - first_value_by("space_allocated_total", "snap_id")).alias("space_allocated_delta"))
    o = objects.select(F.col("object_id").alias("obj"), "owner", "object_name", "object_type")
    w = waits.groupBy("instance_number", F.col("current_obj").alias("obj")).agg(
        (F.count(F.lit(1)) * 10).alias("time_waited_secs"), F.round(F.avg("time_waited") / 1000.0, 4).alias("time_waited_avg_ms"))
    po = plan_lines.groupBy(F.col("object_owner").alias("owner"), "object_name").agg(F.count_distinct("sql_id").alias("sql_ids"))
    j = per.join(o, "obj", "left").join(w, ["instance_number", "obj"], "left").join(po, ["owner", "object_name"], "left")
    return j.groupBy("instance_number", "object_type", "owner", "object_name").agg(
        *[F.sum(c).alias(c) for c in counters], F.max("max_space_allocated").alias("max_space_allocated"),
        F.sum("space_allocated_delta").alias("space_allocated_delta"), F.sum("time_waited_secs").alias("time_waited_secs"),
        F.max("sql_ids").alias("sql_ids"), F.min("min_snap_id").alias("min_snap_id"), F.max("max_snap_id").alias("max_snap_id"))
