"""Rule checks, SURVEY 2.H, and ``apply_rule``.

A rule is a function ``fn(t, **params) -> DataFrame`` over named input
tables ``t`` (a ``Tables`` mapping role -> DataFrame), registered with its
group, a short description and default parameters.  ``apply_rule`` runs one
rule by id with overrides and an optional row filter.

History rules look back ``days`` from ``as_of``; ``as_of`` defaults to the
newest snapshot (a scalar subquery), so results do not depend on the wall
clock.  Table roles and the columns they need:

  snapshot      dbid, instance_number, snap_id, begin_interval_time, end_interval_time
  sqlstat       dbid, instance_number, snap_id, sql_id, plan_hash_value, parsing_schema_name,
                module, executions_delta, elapsed_time_delta, buffer_gets_delta,
                disk_reads_delta, rows_processed_delta [, fetches_delta, parse_calls_delta]
  sqltext       sql_id, sql_text, command_type
  sqlarea       inst_id, sql_id, parsing_schema_name, module, executions, fetches,
                rows_processed, elapsed_time, sql_text
  plan_lines    plan_hash_value, id, parent_id, operation, object_owner, object_name
  objects       owner, object_name, object_type, num_rows
  ash           sample_time, instance_number, session_id, sql_id, event, xid, module
  open_cursor   inst_id, sid, sql_id, sql_text
  shared_cursor inst_id, sql_id, <flag columns 'Y'/'N'>
  sysstat / stat_name   cumulative statistics and their names
  audit_opts    audit_option, success, failure
  dml_texts     sql_id, table_name, sql_text;  index_columns / pk_columns  table_name, column_name
  nvl_texts     sql_id, sql_text;  hist_texts  dbid, sql_id, sql_text
  procedures    owner, object_name, procedure_name, object_type, parallel
  tab_modifications  owner, table_name, inserts, deletes
  block_access / extents   see A39
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (first_value_by, last_value_by, per_unit, seconds_between, trunc_time)
from ..operators.counters import counter_delta
from ..operators.grouping import change_detection, conditional_pivot, outlier_vs_average, prefix_similarity
from ..operators.hierarchy import subtree_self_join
from ..operators.lookup import resolve_by_range, unused_anti
from ..operators.textscan import call_argument_scan, regex_column_use
from ..session import written

# The seven rule groups.
GROUPS = ("Potential in DB-structures", "Detection of SQL with problematic execution plan",
          "Tuning of / load rejection from SGA, PGA", "Redundant cursors / usage of bind variables",
          "Logwriter load / redo impact", "Conclusions on application behaviour", "PL/SQL-usage hints")


class Tables(dict):
    """Role name -> DataFrame; attribute access for convenience."""

    def __getattr__(self, item):
        try:
            return self[item]
        except KeyError as e:
            raise AttributeError(f"rule needs table role {item!r}") from e


@dataclass
class Rule:
    id: str
    name: str
    group: str
    fn: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)


RULES: dict[str, Rule] = {}


def rule(rid: str, name: str, group: int, **params):
    def deco(fn):
        RULES[rid] = Rule(rid, name, GROUPS[group], fn, params)
        return fn
    return deco


def apply_rule(rid: str, tables: Mapping[str, DataFrame], row_filter: Column | None = None, **params) -> DataFrame:
    """Run one rule with its defaults overridden by ``params``; optional row filter."""
    r = RULES[rid]
    unknown = set(params) - set(r.params)
    if unknown:
        raise TypeError(f"{rid}: unknown parameters {sorted(unknown)}")
    out = r.fn(Tables(tables), **{**r.params, **params})
    return out.filter(row_filter) if row_filter is not None else out


# ----------------------------------------------------------------------------------------------
# helpers
def recent_sqlstat(t: Tables, days: int, as_of=None) -> DataFrame:
    """Statement statistics of snapshots that began within ``days`` before ``as_of``."""
    snaps = t.snapshot
    ref = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else \
        snaps.select(F.max("begin_interval_time").cast("timestamp_ntz")).scalar()
    keep = snaps.filter(F.col("begin_interval_time").cast("timestamp_ntz") > ref - F.make_dt_interval(F.lit(days))) \
        .select("dbid", "instance_number", "snap_id")
    return t.sqlstat.join(keep, ["dbid", "instance_number", "snap_id"], "left_semi")


def stat_measures() -> list[Column]:
    return [F.max("buffer_gets_delta").alias("max_buffer_gets"),
            F.sum("executions_delta").alias("executions"),
            F.round(F.sum("elapsed_time_delta") / 1e6, 4).alias("elapsed_secs"),
            F.sum("disk_reads_delta").alias("disk_reads"),
            F.sum("buffer_gets_delta").alias("buffer_gets"),
            F.sum("rows_processed_delta").alias("rows_processed")]


# ----------------------------------------------------------------------------------------------
# Potential in DB structures
# Schemas of the database system itself, and the mark of its own statistics statements.
SYSTEM_OWNERS = ("SYS", "OUTLN", "SYSTEM", "WMSYS", "SYSMAN", "XDB")
STATISTICS_MARK = "dbms_stats cursor_sharing_exact"


def _used_objects(t: Tables, days: int) -> list[DataFrame]:
    """Objects in plans of the cursor cache, and in plans of statements that ran in the last ``days``.

    The statements that gather statistics are not a use.
    """
    own = ~F.col("sql_text").contains(STATISTICS_MARK)
    names = [F.col("object_owner").alias("owner"), F.col("object_name")]
    current = t.plan_lines.join(t.sqlarea.filter(own).select("sql_id"), "sql_id", "left_semi").select(*names)
    ran = recent_sqlstat(t, days).select("sql_id", "plan_hash_value").distinct() \
        .join(t.sqltext.filter(own).select("sql_id"), "sql_id", "left_semi")
    return [current, t.plan_lines_hist.join(ran, ["sql_id", "plan_hash_value"], "left_semi").select(*names)]


@rule("R08", "Indexes not used in current or historic execution plans", 0, days=8)
def r08_unused_indexes(t: Tables, days: int):
    idx = t.indexes.filter((F.col("uniqueness") != "UNIQUE") & ~F.col("owner").isin(*SYSTEM_OWNERS)) \
        .withColumn("object_name", F.col("index_name"))
    return unused_anti(idx, ["owner", "object_name"], *_used_objects(t, days)).drop("object_name")


@rule("R16", "Tables not used in current or historic execution plans", 0, days=8)
def r16_unused_tables(t: Tables, days: int):
    tab = t.tables.filter(~F.col("owner").isin(*SYSTEM_OWNERS)).withColumn("object_name", F.col("table_name"))
    return unused_anti(tab, ["owner", "object_name"], *_used_objects(t, days)).drop("object_name")


@rule("R17", "Tables with inserts but no deletes (missing housekeeping)", 0, min_inserts=1)
def r17_missing_housekeeping(t: Tables, min_inserts: int):
    m = t.tab_modifications.groupBy("owner", "table_name").agg(F.sum("inserts").alias("inserts"),
                                                                F.sum("deletes").alias("deletes"))
    return m.filter((F.col("inserts") >= min_inserts) & (F.col("deletes") == 0))


# ----------------------------------------------------------------------------------------------
# Problematic execution plans
def _plan_stats(t: Tables, days: int):
    s = recent_sqlstat(t, days)
    return s.groupBy("dbid", "sql_id", "plan_hash_value").agg(F.sum("executions_delta").alias("executions"),
                                                              F.sum("rows_processed_delta").alias("rows_processed"))


STMT = ["sql_id", "plan_hash_value"]


@rule("R22", "Index full scans in execution plans", 1, days=8, operation="INDEX", options="FULL SCAN")
def r22_index_full_scans(t: Tables, days: int, operation: str, options: str):
    p = t.plan_lines.filter((F.col("operation") == operation) & (F.col("options") == options)) \
        .select(*STMT, "object_owner", "object_name").distinct()
    return _plan_stats(t, days).join(p, STMT, "inner") \
        .join(t.objects.select(F.col("owner").alias("object_owner"), "object_name", "num_rows"),
              ["object_owner", "object_name"], "left")


def _full_scans(t: Tables, operation: str, options: str) -> DataFrame:
    """Objects that a statement's plan reads in full (any kind of full access), one row per plan and object."""
    return t.plan_lines.filter((F.col("operation") == operation) & F.col("options").like(options) &
                               (F.col("object_owner") != "SYS")).select(*STMT, "object_owner", "object_name").distinct()


@rule("R23", "Full table scans by executions", 1, days=8, operation="TABLE ACCESS", options="%FULL", min_executions=100)
def r23_full_scans_by_executions(t: Tables, days: int, operation: str, options: str, min_executions: int):
    s = _plan_stats(t, days).filter(F.col("executions") > min_executions)
    return s.join(_full_scans(t, operation, options), STMT, "inner")


@rule("R24", "Full table scans by executions and table rows", 1, days=8, operation="TABLE ACCESS", options="%FULL",
      min_rows=100, min_executions=100)
def r24_full_scans_by_rows(t: Tables, days: int, operation: str, options: str, min_rows: int, min_executions: int):
    o = t.objects.filter(F.col("num_rows") > min_rows).groupBy(F.col("owner").alias("object_owner"), "object_name") \
        .agg(F.min("num_rows").alias("num_rows"))
    j = _plan_stats(t, days).join(_full_scans(t, operation, options), STMT, "inner").join(o, ["object_owner", "object_name"], "inner")
    g = j.groupBy("dbid", "sql_id", "object_owner", "object_name").agg(
        F.sum("executions").alias("executions"), F.sum("rows_processed").alias("rows_processed"), F.min("num_rows").alias("num_rows"))
    g = g.filter((F.col("rows_processed") > 0) & (F.col("executions") > min_executions)) \
        .join(t.sqltext.filter(~F.col("sql_text").contains("dbms_stats")).select("sql_id"), "sql_id", "left_semi")
    per_exec = F.round(F.col("rows_processed") / F.col("executions"), 2)
    # the smaller the part of the table that an execution returns, and the more executions, the lower the order value
    return g.withColumn("rows_per_exec", per_exec) \
        .withColumn("order_value", F.round(per_exec / F.col("num_rows") / F.col("executions"), 12))


@rule("R40", "Statements with changing execution plans", 1, days=8)
def r40_changing_plans(t: Tables, days: int):
    s = recent_sqlstat(t, days).join(t.snapshot, ["dbid", "instance_number", "snap_id"], "inner")
    v = s.groupBy("dbid", "instance_number", "sql_id", "plan_hash_value").agg(
        F.min("begin_interval_time").cast("timestamp_ntz").alias("first_occurrence"),
        F.max("end_interval_time").cast("timestamp_ntz").alias("last_occurrence"),
        F.round(F.sum("elapsed_time_delta") / 1e6, 6).alias("elapsed_secs"),
        F.sum("executions_delta").alias("executions"))
    out = change_detection(v, ["dbid", "instance_number", "sql_id"], "first_occurrence", ["elapsed_secs", "executions"])
    return out.withColumn("secs_per_exec_first", F.round(per_unit("elapsed_secs_first", "executions_first"), 4)) \
              .withColumn("secs_per_exec_last", F.round(per_unit("elapsed_secs_last", "executions_last"), 4))


@rule("R41", "Nested loops over large objects", 1, join_operation="NESTED LOOPS", depth=1, min_rows=100000)
def r41_nested_loop_large(t: Tables, join_operation: str, depth: int, min_rows: int):
    sub = subtree_self_join(t.plan_lines, ["plan_hash_value"], depth, cols=["operation", "object_owner", "object_name"])
    sub = sub.filter(F.col("p_operation") == join_operation)
    o = t.objects.filter(F.col("num_rows") >= min_rows).select(F.col("owner").alias("d_object_owner"),
                                                                F.col("object_name").alias("d_object_name"), "num_rows")
    return sub.join(o, ["d_object_owner", "d_object_name"], "inner") \
        .select("plan_hash_value", "p_id", "c2_id", "d_level", "d_id", "d_object_owner", "d_object_name", "num_rows")


@rule("R42", "Nested loops iterating over a full scan", 1, join_operation="NESTED LOOPS", scan_operation="TABLE ACCESS", depth=5)
def r42_nested_loop_full_scan(t: Tables, join_operation: str, scan_operation: str, depth: int):
    sub = subtree_self_join(t.plan_lines, ["plan_hash_value"], depth, cols=["operation", "object_name"])
    return sub.filter((F.col("p_operation") == join_operation) & (F.col("d_operation") == scan_operation)) \
        .select("plan_hash_value", "p_id", "c2_id", "d_level", "d_id", "d_object_name")


# ----------------------------------------------------------------------------------------------
# SGA / PGA
@rule("R26", "Excessive buffer access: top statements by peak gets between snapshots", 2, days=8, max_rows=100)
def r26_excessive_buffer_access(t: Tables, days: int, max_rows: int):
    s = recent_sqlstat(t, days).groupBy("dbid", "sql_id", "instance_number").agg(
        F.coalesce(F.min("parsing_schema_name"), F.lit("[UNKNOWN]")).alias("username"), *stat_measures(),
        F.round(per_unit(F.sum("elapsed_time_delta") / 1e6, F.sum("executions_delta")), 2).alias("elapsed_per_exec"))
    s = s.filter(F.col("max_buffer_gets").isNotNull()).join(t.sqltext.select("sql_id", "sql_text"), "sql_id", "inner")
    return s.orderBy(F.desc_nulls_last("max_buffer_gets"), "sql_id", "instance_number").limit(max_rows)


@rule("R27", "Many executions on small objects", 2, days=8, min_executions=100, max_rows_object=100000)
def r27_small_objects(t: Tables, days: int, min_executions: int, max_rows_object: int):
    s = recent_sqlstat(t, days).groupBy("dbid", "sql_id", "plan_hash_value", "instance_number").agg(*stat_measures()) \
        .filter(F.col("executions") > min_executions)
    p = t.plan_lines.filter(F.col("object_owner") != "SYS").select(*STMT, F.col("object_owner").alias("owner"), "object_name")
    o = t.objects.filter(F.col("num_rows") < max_rows_object).select("owner", "object_name", "num_rows")
    return s.join(p, STMT, "inner").join(o, ["owner", "object_name"], "inner") \
        .withColumn("execs_per_row", F.round(per_unit("executions", "num_rows"), 6))


@rule("R28", "Single-row fetches without array use (cursor cache)", 2, min_fetches_per_exec=100)
def r28_single_row_fetch_cur(t: Tables, min_fetches_per_exec: float):
    a = t.sqlarea.filter((F.col("fetches") > F.col("executions")) & (F.col("fetches") > 1) &
                         (F.col("executions") > 0) & (F.col("rows_processed") > 0))
    a = a.withColumn("rows_per_exec", F.round(F.col("rows_processed") / F.col("executions"), 2)) \
         .withColumn("fetches_per_exec", F.round(F.col("fetches") / F.col("executions"), 2)) \
         .withColumn("rows_per_fetch", F.round(F.col("rows_processed") / F.col("fetches"), 2)) \
         .withColumn("additional_fetches", F.round(F.col("executions") * (
             F.pmod(F.col("rows_processed") / F.col("executions"), F.lit(1000.0)) /
             (F.col("rows_processed") / F.col("fetches")) - 1)))
    return a.filter(F.col("fetches_per_exec") > min_fetches_per_exec)


@rule("R29", "Single-row fetches without array use (history)", 2, days=8, min_fetches_per_exec=100)
def r29_single_row_fetch_hist(t: Tables, days: int, min_fetches_per_exec: float):
    s = recent_sqlstat(t, days).groupBy("instance_number", "dbid", "parsing_schema_name", "module", "sql_id").agg(
        F.sum("executions_delta").alias("executions"), F.sum("fetches_delta").alias("fetches"),
        F.sum("rows_processed_delta").alias("rows_processed"))
    s = s.filter((F.col("fetches") > F.col("executions")) & (F.col("fetches") > 1) &
                 (F.col("executions") > 0) & (F.col("rows_processed") > 0))
    s = s.withColumn("fetches_per_exec", F.round(F.col("fetches") / F.col("executions"), 2)) \
         .withColumn("rows_per_fetch", F.round(F.col("rows_processed") / F.col("fetches"), 2))
    return s.filter(F.col("fetches_per_exec") > min_fetches_per_exec)


@rule("R56", "Parse activity per statement", 2, days=8)
def r56_parse_ratio(t: Tables, days: int):
    s = recent_sqlstat(t, days).groupBy("sql_id", "instance_number", "parsing_schema_name").agg(
        F.sum("executions_delta").alias("executions"), F.sum("parse_calls_delta").alias("parses"))
    return s.withColumn("execs_per_parse", F.round(per_unit("executions", "parses"), 2))


# Names of the PGA counters, in bytes and as counts, and their columns.
PGA_BYTES = {"aggregate PGA target parameter": "aggregate_target_mb", "aggregate PGA auto target": "auto_target_mb",
             "global memory bound": "global_memory_bound_mb", "total PGA inuse": "inuse_mb", "total PGA allocated": "allocated_mb",
             "total freeable PGA memory": "freeable_mb", "PGA memory freed back to OS": "freed_back_mb",
             "total PGA used for auto workareas": "used_auto_mb", "total PGA used for manual workareas": "used_manual_mb"}
PGA_COUNTS = {"process count": "process_count", "max processes count": "max_processes_count",
              "over allocation count": "over_allocation_count", "cache hit percentage": "cache_hit_pct"}


@rule("R52", "Memory statistics history with delta of the over-allocation counter", 2, days=8, instance=1)
def r52_memory_history(t: Tables, days: int, instance: int):
    """The PGA counters of each snapshot (MB where they are bytes), over-allocations since the snapshot before."""
    last = t.snapshot.select(F.max("begin_interval_time").cast("timestamp_ntz")).scalar()
    s = t.pgastat.filter(F.col("instance_number") == instance)
    value = {n: F.max(F.when(F.col("name") == n, F.col("value")).otherwise(0)) for n in (*PGA_BYTES, *PGA_COUNTS)}
    g = s.groupBy("dbid", "instance_number", "snap_id").agg(
        *[F.round(value[n] / 1048576.0).alias(c) for n, c in PGA_BYTES.items()], *[value[n].alias(c) for n, c in PGA_COUNTS.items()])
    prev = s.filter(F.col("name") == "over allocation count").select(
        "dbid", "instance_number", (F.col("snap_id") + 1).alias("snap_id"), F.col("value").alias("_prev"))
    g = g.join(prev, ["dbid", "instance_number", "snap_id"], "left") \
         .withColumn("over_allocation_count", F.col("over_allocation_count") - F.col("_prev")).drop("_prev")
    snaps = t.snapshot.select("dbid", "instance_number", "snap_id", F.col("begin_interval_time").cast("timestamp_ntz").alias("begin_interval_time"))
    return g.join(snaps.filter(F.col("begin_interval_time") > last - F.make_dt_interval(F.lit(days))), ["dbid", "instance_number", "snap_id"], "inner")


@rule("R47", "Hot blocks on small objects", 2, min_accesses=1, max_rows_object=100000, bucket=1024)
def r47_hot_blocks_small_objects(t: Tables, min_accesses: int, max_rows_object: int, bucket: int):
    # counted per block first: a hot block is one row of the range join
    hits = t.block_access.groupBy("file_id", "block_no").agg(F.count(F.lit(1)).alias("n"))
    r = resolve_by_range(hits, t.extents, ["file_id"], "block_no", "block_id", "blocks", bucket)
    g = r.groupBy("object_id").agg(F.sum("n").alias("accesses"), F.count_distinct("block_no").alias("blocks_hit"))
    o = t.objects.filter(F.col("num_rows") < max_rows_object).select("object_id", "owner", "object_name", "num_rows")
    return g.filter(F.col("accesses") >= min_accesses).join(o, "object_id", "inner") \
        .withColumn("accesses_per_block", F.round(F.col("accesses") / F.col("blocks_hit"), 4))


# ----------------------------------------------------------------------------------------------
# Redundant cursors / bind variables
@rule("R58", "Literals instead of bind variables: similar statements by text prefix", 3, prefix_length=60, min_count=2)
def r58_literals(t: Tables, prefix_length: int, min_count: int):
    return prefix_similarity(t.sqlarea, "sql_text", prefix_length, min_count, "sql_id",
                             {"executions": F.sum("executions"), "elapsed_time": F.sum("elapsed_time")})


@rule("R59", "Cursors opened several times per statement", 3)
def r59_open_cursor_per_sql(t: Tables):
    g = t.open_cursor.groupBy("inst_id", "sql_id").agg(F.count(F.lit(1)).alias("open_cursors"),
                                                       F.count_distinct("sid").alias("sessions"),
                                                       F.min("sql_text").alias("sql_text"))
    g = g.withColumn("cursors_per_session", F.round(F.col("open_cursors") / F.col("sessions"), 2))
    return g.filter(F.col("open_cursors") / F.col("sessions") > 1)


@rule("R60", "Statements opened several times within one session", 3)
def r60_open_cursor_per_session(t: Tables):
    """With the session that holds them and the number of child cursors; statements of SYS aside."""
    cu = t.open_cursor.groupBy("inst_id", "sid", "sql_id").agg(
        F.count(F.lit(1)).alias("open_cursors"), F.count_distinct("sql_id").alias("statements"),
        F.min("sql_text").alias("sql_text")).filter(F.col("open_cursors") > F.col("statements"))
    sq = t.cursors.groupBy("inst_id", "sql_id").agg(F.count(F.lit(1)).alias("children"), F.min("parsing_schema_name").alias("parsing_schema_name"))
    return cu.join(t.sessions.select("inst_id", "sid", "username", "module"), ["inst_id", "sid"], "inner") \
        .join(sq.filter(F.col("parsing_schema_name") != "SYS"), ["inst_id", "sql_id"], "inner")


@rule("R62", "Many child cursors per statement, counted per reason", 3, min_children=1)
def r62_child_cursors(t: Tables, min_children: int):
    sc = t.shared_cursor
    flags = [c for c, ty in sc.dtypes if ty == "string" and c not in ("inst_id", "sql_id")]
    aggs = [F.count(F.lit(1)).alias("child_count")] + \
           [F.sum(F.when(F.col(c) == "Y", 1).otherwise(0)).alias(c) for c in flags]
    return sc.groupBy("inst_id", "sql_id").agg(*aggs).filter(F.col("child_count") > min_children)


# ----------------------------------------------------------------------------------------------
# Log writer / redo
@rule("R65", "Commits and rollbacks per hour with rollback percentage", 4, days=400, instance=1)
def r65_commit_rollback(t: Tables, days: int, instance: int):
    ref = t.snapshot.select(F.max("begin_interval_time").cast("timestamp_ntz")).scalar()
    snaps = t.snapshot.filter((F.col("instance_number") == instance) &
                              (F.col("begin_interval_time").cast("timestamp_ntz") > ref - F.make_dt_interval(F.lit(days))))
    b = snaps.groupBy("dbid", "instance_number").agg(F.min("snap_id").alias("min_snap"), F.max("snap_id").alias("max_snap"))
    names = t.stat_name.filter(F.col("stat_name").isin("user commits", "user rollbacks", "rollback changes - undo records applied"))
    st = t.sysstat.join(b, ["dbid", "instance_number"], "inner") \
        .filter(F.col("snap_id").between(F.col("min_snap") - 1, F.col("max_snap"))).join(names, "stat_id", "inner")
    d = counter_delta(st, ["instance_number", "stat_id"], "snap_id", ["value"], reset="positive")
    d = d.join(t.snapshot.select("dbid", "instance_number", "snap_id", "begin_interval_time"),
               ["dbid", "instance_number", "snap_id"], "inner")
    piv = conditional_pivot(d.withColumn("begin", trunc_time("begin_interval_time", "HH24")), ["begin", "instance_number"],
                            "stat_name", {"user commits": "user_commits", "user rollbacks": "user_rollbacks",
                                          "rollback changes - undo records applied": "rollback_changes"}, "value")
    tot = F.col("user_commits") + F.col("user_rollbacks")
    return piv.withColumn("percent_rollback", F.round(F.col("user_rollbacks") / F.when(tot == 0, 1).otherwise(tot) * 100))


# ----------------------------------------------------------------------------------------------
# Conclusions on application behaviour
@rule("R30", "Single-row DML executed often (candidates for array processing)", 5, days=8, min_executions=100000)
def r30_single_row_dml(t: Tables, days: int, min_executions: int):
    txt = t.sqltext.filter(F.col("command_type").isin(2, 6, 7)).select("sql_id", "sql_text")
    s = recent_sqlstat(t, days).join(txt, "sql_id", "inner").groupBy("sql_id", "instance_number", "parsing_schema_name").agg(
        F.sum("executions_delta").alias("executions"), F.sum("rows_processed_delta").alias("rows_processed"),
        F.min("sql_text").alias("sql_text"))
    s = s.filter((F.col("executions") > min_executions) & (F.col("rows_processed") > 0))
    return s.withColumn("rows_per_exec", F.round(F.col("rows_processed") / F.col("executions"), 2)) \
            .withColumn("weight", F.round(F.col("executions") * F.col("executions") / F.col("rows_processed"), 4))


@rule("R31", "Statements without any hit", 5, days=8, min_executions=100)
def r31_no_hits(t: Tables, days: int, min_executions: int):
    s = recent_sqlstat(t, days).groupBy("dbid", "sql_id", "instance_number").agg(*stat_measures())
    s = s.filter((F.col("rows_processed") == 0) & (F.col("executions") > min_executions))
    txt = t.sqltext.filter(F.upper("sql_text").rlike("^(UPDATE|DELETE|MERGE|SELECT|WITH)")).select("sql_id", "sql_text")
    return s.join(txt, "sql_id", "inner")


def _update_with_filter(texts: DataFrame) -> DataFrame:
    u = F.upper(F.col("sql_text"))
    where = F.instr(u, "WHERE")
    return texts.filter(u.startswith("UPDATE") & (where > 0) &
                        (F.instr(F.substring(u, where, 1 << 30), "AND") > 0) & F.col("sql_text").contains(":"))


@rule("R32", "Updates with several filter conditions and host variables (cursor cache)", 5)
def r32_update_extra_filter_cur(t: Tables):
    a = _update_with_filter(t.sqlarea)
    return a.withColumn("secs_per_row", F.round(per_unit(F.col("elapsed_time") / 1e6, "rows_processed"), 4))


@rule("R33", "Updates with several filter conditions and host variables (history)", 5, days=8)
def r33_update_extra_filter_hist(t: Tables, days: int):
    txt = _update_with_filter(t.sqltext).select("sql_id", "sql_text")
    s = recent_sqlstat(t, days).join(txt, "sql_id", "inner").groupBy("sql_id", "instance_number").agg(
        F.sum("executions_delta").alias("executions"), F.sum("rows_processed_delta").alias("rows_processed"),
        F.round(F.sum("elapsed_time_delta") / 1e6, 4).alias("elapsed_secs"))
    return s.withColumn("secs_per_row", F.round(per_unit("elapsed_secs", "rows_processed"), 4))


@rule("R49", "Updates that set indexed columns", 5)
def r49_update_indexed_columns(t: Tables):
    return regex_column_use(t.dml_texts, t.index_columns, "table_name", "table_name", "sql_text", "column_name")


@rule("R72", "Updates that set primary-key columns", 5)
def r72_update_pk_columns(t: Tables):
    return regex_column_use(t.dml_texts, t.pk_columns, "table_name", "table_name", "sql_text", "column_name")


@rule("R55", "Active sessions per sample time", 5)
def r55_active_sessions(t: Tables):
    return t.ash.groupBy("sample_time", "instance_number").agg(F.count(F.lit(1)).alias("active_sessions"))


@rule("R67", "Module runtime outliers", 5, unit="HH24", instance=1, sample_secs=10)
def r67_module_outliers(t: Tables, unit: str, instance: int, sample_secs: int):
    a = t.ash.filter(F.col("instance_number") == instance)
    per = a.groupBy(trunc_time("sample_time", unit).alias("period"), "module").agg(
        F.min("sample_time").alias("first_occurrence"), F.max("sample_time").alias("last_occurrence"),
        (F.count(F.lit(1)) * sample_secs).alias("secs"))
    return outlier_vs_average(per, "module", "period", "secs", "first_occurrence", "last_occurrence")


def _long_transactions(samples: DataFrame, min_secs: float) -> DataFrame:
    ev = F.col("event") if "session_state" not in samples.columns else F.coalesce("event", "session_state")
    inner = samples.filter(F.col("xid").isNotNull()).groupBy("xid", ev.alias("event")).agg(
        F.min("sample_time").alias("min_t"), F.max("sample_time").alias("max_t"), F.count(F.lit(1)).alias("samples"),
        first_value_by("sql_id", "sample_time").alias("min_sql"), last_value_by("sql_id", "sample_time").alias("max_sql"),
        F.min("instance_number").alias("inst"), F.min("session_id").alias("sid"), F.min("module").alias("module"))
    g = inner.groupBy("xid").agg(
        F.min("min_t").alias("tx_start"), F.max("max_t").alias("tx_end"), F.sum("samples").alias("samples"),
        first_value_by("min_sql", "min_t").alias("first_sql_id"), last_value_by("max_sql", "max_t").alias("last_sql_id"),
        F.min("inst").alias("instance"), F.min(F.col("sid").cast("string")).alias("sid"), F.min("module").alias("module"),
        last_value_by("event", "samples").alias("main_event"))
    g = g.withColumn("duration_secs", F.round(seconds_between("tx_start", "tx_end")))
    return g.filter(F.col("duration_secs") > min_secs)


@rule("R70", "Long transactions (current samples)", 5, min_secs=60)
def r70_long_tx_cur(t: Tables, min_secs: float):
    return _long_transactions(t.ash, min_secs)


@rule("R71", "Long transactions (history samples)", 5, min_secs=60)
def r71_long_tx_hist(t: Tables, min_secs: float):
    return _long_transactions(t.ash_hist, min_secs)


# Statement audit options suggested by the rule (name, success, failure, message).
AUDIT_OPTIONS = [
    ("CLUSTER", "BY ACCESS", "BY ACCESS", None), ("DATABASE LINK", "BY ACCESS", "BY ACCESS", None),
    ("DIRECTORY", "BY ACCESS", "BY ACCESS", None), ("INDEX", "BY ACCESS", "BY ACCESS", None),
    ("MATERIALIZED VIEW", "BY ACCESS", "BY ACCESS", None), ("OUTLINE", "BY ACCESS", "BY ACCESS", None),
    ("PROCEDURE", "BY ACCESS", "BY ACCESS", None), ("PROFILE", "BY ACCESS", "BY ACCESS", None),
    ("PUBLIC DATABASE LINK", "BY ACCESS", "BY ACCESS", None), ("PUBLIC SYNONYM", "BY ACCESS", "BY ACCESS", None),
    ("ROLE", "BY ACCESS", "BY ACCESS", None), ("ROLLBACK SEGMENT", "BY ACCESS", "BY ACCESS", None),
    ("SEQUENCE", "BY ACCESS", "BY ACCESS", None), ("CREATE SESSION", "BY ACCESS", "BY ACCESS", None),
    ("SYNONYM", "BY ACCESS", "BY ACCESS", None), ("SYSTEM AUDIT", "BY ACCESS", "BY ACCESS", None),
    ("SYSTEM GRANT", "BY ACCESS", "BY ACCESS", None), ("TABLE", "BY ACCESS", "BY ACCESS", None),
    ("ALTER SYSTEM", "BY ACCESS", "BY ACCESS", None), ("TABLESPACE", "BY ACCESS", "BY ACCESS", None),
    ("TRIGGER", "BY ACCESS", "BY ACCESS", None), ("TYPE", "BY ACCESS", "BY ACCESS", None),
    ("USER", "BY ACCESS", "BY ACCESS", None), ("VIEW", "BY ACCESS", "BY ACCESS", None),
    ("SELECT TABLE", "NOT SET", "BY ACCESS", "SELECT TABLE BY ACCESS WHENEVER NOT SUCCESSFUL"),
    ("INSERT TABLE", "NOT SET", "BY ACCESS", "INSERT TABLE BY ACCESS WHENEVER NOT SUCCESSFUL"),
    ("UPDATE TABLE", "NOT SET", "BY ACCESS", "UPDATE TABLE BY ACCESS WHENEVER NOT SUCCESSFUL"),
    ("DELETE TABLE", "NOT SET", "BY ACCESS", "DELETE TABLE BY ACCESS WHENEVER NOT SUCCESSFUL"),
]


@rule("R69", "Missing statement audit options", 5)
def r69_missing_audit(t: Tables):
    spark = t.audit_opts.sparkSession
    want = spark.createDataFrame(AUDIT_OPTIONS, "name string, success string, failure string, message string")
    d = t.audit_opts
    cond = (F.col("_w.name") == F.col("_d.audit_option")) & \
           ((F.col("_d.success") == F.col("_w.success")) | (F.col("_w.success") == "NOT SET")) & \
           ((F.col("_d.failure") == F.col("_w.failure")) | (F.col("_w.failure") == "NOT SET"))
    missing = want.alias("_w").join(d.alias("_d"), cond, "left_anti")
    return missing.select(F.concat(F.lit('"AUDIT '), F.coalesce("message", "name"), F.lit('" suggested!')).alias("problem"))


# ----------------------------------------------------------------------------------------------
# PL/SQL usage
_NAMES = (r"(?<=[^A-Z_])[A-Z_]+(?=[^A-Z_])", r"(?<=[^A-Z_])[A-Z_][A-Z0-9_$#]*(?=[^A-Z_])")
_PAIRS = (r"(?<=[^A-Z_])(?=([A-Z_]+[.][A-Z_]+)[^A-Z_])", r"(?<=[^A-Z_])(?=([A-Z_][A-Z0-9_$#]*[.][A-Z_][A-Z0-9_$#]*)[^A-Z_])")


def _phrases(texts: DataFrame, text: str, cols: list[str]) -> DataFrame:
    """(cols, phrase): every word of the texts, and every two words joined by a dot, once a text.

    A character that is neither letter nor underscore must stand on both sides, as
    in the reference's test; words are taken as runs of letters, and as names with
    digits, $ and #.
    """
    up = F.upper(text)
    found = [F.regexp_extract_all(up, F.lit(p), F.lit(0)) for p in _NAMES] + [F.regexp_extract_all(up, F.lit(p), F.lit(1)) for p in _PAIRS]
    return texts.select(*cols, F.explode(F.array_distinct(F.concat(*found))).alias("phrase"))


@rule("R38", "Functions without PARALLEL_ENABLE used in parallel statements", 6, days=8, skip_owners=("SYS", "WMSYS", "PERFSTAT"))
def r38_functions_not_parallel(t: Tables, days: int, skip_owners: tuple[str, ...]):
    """Functions and package functions that serialize a parallel statement of the cursor cache or the recent history.

    Names are a dictionary of phrases (a function, or package.function) that the
    words and dotted word pairs of the texts are equi-joined with.  Only texts that
    name PARALLEL count, and no PL/SQL blocks or EXPLAINs.
    """
    fn = t.procedures.filter(F.col("object_type").isin("FUNCTION", "PACKAGE") & (F.col("parallel") == "NO") & ~F.col("owner").isin(*skip_owners)
                             & ((F.col("object_type") != "PACKAGE") | F.col("procedure_name").isNotNull()))
    fn = fn.withColumn("phrase", F.when(F.col("object_type") == "PACKAGE", F.upper(F.concat("object_name", F.lit("."), "procedure_name"))).otherwise(F.upper("object_name")))
    cur = t.sqlarea.select("sql_id", "sql_text", F.round(F.col("elapsed_time") / 1e6, 6).alias("elapsed_secs"), F.lit("SGA").alias("source"))
    hist = (recent_sqlstat(t, days).groupBy("dbid", "sql_id").agg(F.round(F.sum("elapsed_time_delta") / 1e6, 6).alias("elapsed_secs"))
            .join(t.hist_texts.select("dbid", "sql_id", "sql_text"), ["dbid", "sql_id"]).select("sql_id", "sql_text", "elapsed_secs", F.lit("History").alias("source")))
    texts = cur.unionByName(hist).filter(F.upper("sql_text").contains("PARALLEL") & ~F.upper("sql_text").rlike(r"^\s*(BEGIN|DECLARE|EXPLAIN)"))
    return _phrases(texts, "sql_text", ["sql_id", "elapsed_secs", "source"]).join(fn, "phrase").select(
        "source", "sql_id", "owner", "object_name", "procedure_name", "object_type", "elapsed_secs")


@rule("R73", "NVL with a function call as second argument", 6, function="NVL")
def r73_nvl_expensive(t: Tables, function: str):
    return call_argument_scan(t.nvl_texts, "sql_id", "sql_text", function)


# ----------------------------------------------------------------------------------------------
# Parallel query and plan-line rules (plan_lines keyed by sql_id here: role ``sql_plan``)
def _parallel(c: Column) -> Column:
    return F.coalesce(c.like("PARALLEL%"), F.lit(False))


@rule("R34", "Long-running statements without parallel query (cursor cache)", 1, min_secs_per_exec=10.0)
def r34_long_serial_cur(t: Tables, min_secs_per_exec: float):
    serial = t.sql_plan.groupBy("sql_id").agg(F.sum(F.when(_parallel(F.col("other_tag")), 1).otherwise(0)).alias("_px")) \
        .filter(F.col("_px") == 0).select("sql_id")
    a = t.sqlarea.join(serial, "sql_id", "inner")
    per_exec = F.col("elapsed_time") / F.when(F.col("executions") == 0, 1).otherwise(F.col("executions"))
    return a.filter(per_exec > min_secs_per_exec * 1e6).withColumn("elapsed_per_exec_secs", F.round(per_exec / 1e6, 2))


@rule("R35", "Long-running statements without parallel query (history)", 1, days=8, min_secs_per_exec=20.0)
def r35_long_serial_hist(t: Tables, days: int, min_secs_per_exec: float):
    """Statements per instance, over all their plans without a parallel line."""
    serial = t.sql_plan.groupBy(*STMT).agg(F.sum(F.when(_parallel(F.col("other_tag")), 1).otherwise(0)).alias("_px")) \
        .filter(F.col("_px") == 0).select(*STMT)
    s = recent_sqlstat(t, days).join(serial, STMT, "left_semi").join(
        t.snapshot.select("dbid", "instance_number", "snap_id", "begin_interval_time"), ["dbid", "instance_number", "snap_id"], "inner")
    s = s.groupBy("dbid", "instance_number", "sql_id").agg(
        F.sum("executions_delta").alias("executions"), F.sum("elapsed_time_delta").alias("elapsed_time"),
        F.min("begin_interval_time").cast("timestamp_ntz").alias("first_occurrence"),
        F.max("begin_interval_time").cast("timestamp_ntz").alias("last_occurrence"))
    per_exec = F.col("elapsed_time") / F.when(F.col("executions") == 0, 1).otherwise(F.col("executions"))
    return s.filter(per_exec > min_secs_per_exec * 1e6).withColumn("elapsed_per_exec_secs", F.round(per_exec / 1e6, 2))


# Plan operations that are not counted as serial work inside a parallel plan.
PX_NEUTRAL_OPERATIONS = ("PX COORDINATOR", "SORT", "VIEW", "MERGE JOIN")


@rule("R36", "Parallel statements with serial plan lines (cursor cache)", 1)
def r36_parallel_with_serial_parts(t: Tables):
    p = t.sql_plan
    pp = p.filter(_parallel(F.col("other_tag"))).select("sql_id").distinct()
    ps = p.filter(~_parallel(F.col("other_tag")) & ~F.col("operation").isin(*PX_NEUTRAL_OPERATIONS) &
                  ~F.col("operation").like("UPDATE%") & ~F.col("operation").like("SELECT%"))
    o = t.objects.select(F.col("owner").alias("object_owner"), "object_name", "num_rows")
    out = ps.join(pp, "sql_id", "left_semi").join(o, ["object_owner", "object_name"], "left")
    return out.join(t.sqlarea.select("sql_id", "executions", F.round(F.col("elapsed_time") / 1e6, 6).alias("elapsed_secs")),
                    "sql_id", "inner")


@rule("R39", "Parallel statements with serial sub-processing after a full scan (latest plan, two levels)", 1, days=8, full_option="FULL")
def r39_parallel_from_serial(t: Tables, days: int, full_option: str):
    p = t.sql_plan
    pfs = p.filter(F.col("other_tag") == "PARALLEL_FROM_SERIAL").groupBy("sql_id").agg(
        F.max("plan_hash_value").alias("plan_hash_value"),
        last_value_by("id", "plan_hash_value").alias("pfs_id"))
    c1 = p.select("sql_id", "plan_hash_value", F.col("parent_id").alias("pfs_id"), F.col("id").alias("c1_id"),
                  F.col("options").alias("c1_options"), F.col("operation").alias("c1_operation"),
                  F.col("object_owner").alias("c1_owner"), F.col("object_name").alias("c1_name"))
    c2 = p.select("sql_id", "plan_hash_value", F.col("parent_id").alias("c1_id"), F.col("options").alias("c2_options"),
                  F.col("operation").alias("c2_operation"), F.col("object_owner").alias("c2_owner"), F.col("object_name").alias("c2_name"))
    j = pfs.join(c1, ["sql_id", "plan_hash_value", "pfs_id"], "left").join(c2, ["sql_id", "plan_hash_value", "c1_id"], "left")
    full1 = F.coalesce(F.col("c1_options").like(f"%{full_option}%"), F.lit(False))
    full2 = F.coalesce(F.col("c2_options").like(f"%{full_option}%"), F.lit(False))
    j = j.filter(full1 | full2).select("sql_id", "plan_hash_value",
                                       F.when(full1, F.col("c1_operation")).otherwise(F.col("c2_operation")).alias("operation"),
                                       F.when(full1, F.col("c1_owner")).otherwise(F.col("c2_owner")).alias("object_owner"),
                                       F.when(full1, F.col("c1_name")).otherwise(F.col("c2_name")).alias("object_name"))
    g = j.groupBy("sql_id", "plan_hash_value").agg(F.min("operation").alias("operation"), F.min("object_owner").alias("object_owner"),
                                                   F.min("object_name").alias("object_name"))
    s = recent_sqlstat(t, days).groupBy("sql_id", "plan_hash_value").agg(
        F.round(F.sum("elapsed_time_delta") / 1e6, 6).alias("elapsed_secs"), F.sum("executions_delta").alias("executions"))
    return g.join(s, ["sql_id", "plan_hash_value"], "inner")


@rule("R43", "Implicit conversions (INTERNAL_FUNCTION) in filter predicates", 1)
def r43_implicit_conversion(t: Tables):
    p = t.sql_plan.filter(F.col("filter_predicates").like("%INTERNAL_FUNCTION%")) \
        .select("sql_id", "plan_hash_value", "id", "filter_predicates")
    return p.join(t.sqlarea.select("sql_id", "executions", "rows_processed",
                                   F.round(F.col("elapsed_time") / 1e6, 6).alias("elapsed_secs")), "sql_id", "inner")


@rule("R44", "Full scans caused by IS NULL predicates, with sampled time", 1, full_option="FULL")
def r44_is_null_full_scans(t: Tables, full_option: str):
    p = t.sql_plan.filter(F.upper("filter_predicates").like("%IS NULL%") & F.col("options").like(f"%{full_option}"))
    h = t.ash.select("sql_id", F.col("sql_plan_hash_value").alias("plan_hash_value"), F.col("sql_plan_line_id").alias("id"),
                     "sample_time")
    j = p.join(h, ["sql_id", "plan_hash_value", "id"], "inner")
    return j.groupBy("sql_id", "plan_hash_value", "id", "operation", "options", "object_owner", "object_name",
                     "filter_predicates").agg(F.min("sample_time").alias("first_occurrence"),
                                              F.max("sample_time").alias("last_occurrence"),
                                              F.count(F.lit(1)).alias("wait_time_secs"))


@rule("R48", "Suboptimal indexes: one index scan without a filter, yet many buffer gets per row", 1, index_operation="INDEX",
      max_lines=5, min_executions=100, max_binds=5, executions_per_row=2, min_gets_per_row=5)
def r48_suboptimal_index(t: Tables, index_operation: str, max_lines: int, min_executions: int, max_binds: int,
                         executions_per_row: int, min_gets_per_row: int):
    """Plans of fewer than ``max_lines`` lines with options (row limits and hash partitions aside)."""
    lines = t.sql_plan.filter((F.col("operation") != "PARTITION HASH") & (F.col("options") != "STOPKEY"))
    p = lines.groupBy(*STMT).agg(
        F.sum(F.when((F.col("operation") == index_operation) & F.col("options").isin("RANGE SCAN", "UNIQUE SCAN"), 1).otherwise(0)).alias("_idx"),
        F.sum(F.when(F.col("filter_predicates").isNotNull(), 1).otherwise(0)).alias("_flt"),
        F.sum(F.when((F.col("id") == 1) & F.col("options").isin("GROUP BY", "AGGREGATE"), 1).otherwise(0)).alias("_grp"),
        F.count(F.lit(1)).alias("plan_lines"))
    p = p.filter((F.col("_idx") == 1) & (F.col("_flt") == 0) & (F.col("_grp") == 0) & (F.col("plan_lines") < max_lines))
    a = t.sqlarea.filter((F.col("rows_processed") > 0) & (F.col("executions") > min_executions) &
                         (F.col("rows_processed") > F.col("executions") / executions_per_row) &
                         (F.length("sql_text") - F.length(F.replace(F.col("sql_text"), F.lit(":"), F.lit(""))) < max_binds)) \
        .withColumn("gets_per_row", F.round(F.col("buffer_gets") / F.col("rows_processed"))) \
        .filter(F.col("gets_per_row") > min_gets_per_row)
    return p.drop("_idx", "_flt", "_grp").join(
        a.select(*STMT, "executions", "buffer_gets", "rows_processed", "gets_per_row", "sql_text"), STMT, "inner") \
        .withColumn("rows_per_exec", F.round(F.col("rows_processed") / F.col("executions"), 2))


# Command types of INSERT, UPDATE and DELETE.
WRITE_COMMANDS = (2, 6, 7)


@rule("R63", "Write statements by executions (cursor cache)", 5, min_rows=100000)
def r63_write_statements_cur(t: Tables, min_rows: int):
    a = t.sqlarea.filter(F.col("command_type").isin(*WRITE_COMMANDS) & (F.col("executions") > 0) & (F.col("rows_processed") > min_rows))
    return a.withColumn("rows_per_exec", F.round(F.col("rows_processed") / F.col("executions"), 2))


@rule("R64", "Write statements by executions (history)", 5, days=8, min_rows=100000)
def r64_write_statements_hist(t: Tables, days: int, min_rows: int):
    txt = t.sqltext.filter(F.col("command_type").isin(*WRITE_COMMANDS)).select("sql_id")
    s = recent_sqlstat(t, days).join(txt, "sql_id", "left_semi").groupBy("dbid", "instance_number", "sql_id").agg(
        F.sum("executions_delta").alias("executions"), F.sum("rows_processed_delta").alias("rows_processed"))
    return s.filter((F.col("executions") > 0) & (F.col("rows_processed") > min_rows)) \
        .withColumn("rows_per_exec", F.round(F.col("rows_processed") / F.col("executions"), 2))


# ----------------------------------------------------------------------------------------------
# Catalog rules.  Roles: tables (owner, table_name, num_rows, blocks, iot_type, partitioned,
# compression, last_analyzed), indexes (owner, index_name, table_owner, table_name, uniqueness,
# num_rows, distinct_keys, pct_free, compression, leaf_blocks, partitioned, index_type,
# last_analyzed), ind_columns, tab_columns, constraints, cons_columns.
MB = 1048576.0


@rule("R01", "Indexes and index partitions with PCTFREE below a threshold", 0, max_pct_free=10, max_pct_free_partition=10, min_rows=100000)
def r01_index_pctfree(t: Tables, max_pct_free: int, max_pct_free_partition: int, min_rows: int):
    cols = ["owner", "table_name", "index_name", "partition_name", "pct_free", "num_rows"]
    i = t.indexes.filter(F.col("pct_free") < max_pct_free).withColumn("partition_name", F.lit(None).cast("string"))
    p = t.ind_partitions.filter(F.col("pct_free") < max_pct_free_partition).withColumnRenamed("index_owner", "owner") \
        .join(t.indexes.select("owner", "index_name", "table_name"), ["owner", "index_name"], "left")
    return i.select(*cols).unionByName(p.select(*cols)).filter((F.col("num_rows") > min_rows) & ~F.col("owner").isin("SYS", "SYSTEM", "SYSMAN"))


def _index_mb() -> Column:
    return F.round(F.col("leaf_blocks") * 8192 / MB, 1)


@rule("R02", "Index compression candidates by rows per key and size", 0, min_rows_per_key=5, min_mb=0.0)
def r02_index_compression(t: Tables, min_rows_per_key: float, min_mb: float):
    i = t.indexes.filter((F.col("compression") == "DISABLED") & (F.col("distinct_keys") > 0) &
                         (F.col("num_rows") / per_unit_den("distinct_keys") > min_rows_per_key) & (F.col("index_type") != "BITMAP"))
    tb = t.tables.select(F.col("owner").alias("table_owner"), "table_name", "iot_type")
    out = i.join(tb, ["table_owner", "table_name"], "inner").withColumn("mbytes", _index_mb()).filter(F.col("mbytes") > min_mb)
    return out.select("owner", "index_name", "table_owner", "table_name", "iot_type", "num_rows", "distinct_keys", "mbytes",
                      F.round(F.col("num_rows") / F.col("distinct_keys")).alias("rows_per_key"),
                      (F.lit(5) * F.col("num_rows") * F.col("num_rows") / F.col("distinct_keys")).alias("weight"))


def per_unit_den(c: str) -> Column:
    return F.when(F.col(c) == 0, F.lit(1)).otherwise(F.col(c))


@rule("R03", "Index compression candidates by leaf blocks per key", 0, min_leaf_blocks_per_key=5)
def r03_leaf_blocks_per_key(t: Tables, min_leaf_blocks_per_key: float):
    i = t.indexes.withColumn("avg_leaf_blocks_per_key", F.round(F.try_divide(F.col("leaf_blocks"), F.col("distinct_keys")), 4))
    i = i.filter((F.col("avg_leaf_blocks_per_key") > min_leaf_blocks_per_key) & (F.col("compression") == "DISABLED"))
    tb = t.tables.select(F.col("owner").alias("table_owner"), "table_name", "iot_type")
    return i.join(tb, ["table_owner", "table_name"], "inner").select(
        "owner", "table_name", "index_name", "distinct_keys", "avg_leaf_blocks_per_key", "num_rows", "iot_type")


@rule("R05", "Index-organised table candidates", 0, max_columns=6, min_rows=100000)
def r05_iot_candidates(t: Tables, max_columns: int, min_rows: int):
    k = ["owner", "table_name"]
    cols = t.tab_columns.groupBy(*k).agg(F.count(F.lit(1)).alias("columns"))
    idx = t.indexes.groupBy(F.col("table_owner").alias("owner"), "table_name").agg(
        F.count(F.lit(1)).alias("indexes"), F.sum(F.when(F.col("uniqueness") == "UNIQUE", 1).otherwise(0)).alias("unique_indexes"))
    pk = t.constraints.filter(F.col("constraint_type") == "P").join(
        t.ind_columns.select(F.col("index_owner").alias("owner"), "index_name", "column_name"), ["owner", "index_name"], "inner") \
        .groupBy(*k).agg(F.count(F.lit(1)).alias("pkey_columns"))
    tb = t.tables.filter(F.col("iot_type").isNull() & (F.col("num_rows") > 0)).select(*k, "num_rows", "avg_row_len")
    out = tb.join(cols, k, "left").join(idx, k, "left").join(pk, k, "left").fillna(0, ["columns", "indexes", "unique_indexes", "pkey_columns"])
    return out.filter((F.col("columns") < max_columns) & (F.col("unique_indexes") > 0) & (F.col("num_rows") > min_rows))


@rule("R06", "Foreign keys without an index on the referencing columns", 0, min_rows_target=100000)
def r06_fk_without_index(t: Tables, min_rows_target: int):
    ref = t.constraints.filter(F.col("constraint_type") == "R").select("owner", "constraint_name", "table_name", "r_owner", "r_constraint_name")
    refcol = t.cons_columns.select("owner", "constraint_name", "column_name", "position")
    target = t.constraints.select(F.col("owner").alias("r_owner"), F.col("constraint_name").alias("r_constraint_name"),
                                  F.col("table_name").alias("target_table"))
    tabs = t.tables.select("owner", "table_name", F.col("num_rows").alias("rows_org"))
    ttabs = t.tables.select(F.col("owner").alias("r_owner"), F.col("table_name").alias("target_table"), F.col("num_rows").alias("rows_target"))
    j = ref.join(refcol, ["owner", "constraint_name"], "inner").join(target, ["r_owner", "r_constraint_name"], "inner") \
        .join(tabs, ["owner", "table_name"], "inner").join(ttabs, ["r_owner", "target_table"], "inner")
    idx = t.ind_columns.select(F.col("table_owner").alias("owner"), "table_name", "column_name",
                               F.col("column_position").alias("position")).distinct()
    return j.join(idx, ["owner", "table_name", "column_name", "position"], "left_anti").filter(F.col("rows_target") > min_rows_target)


@rule("R09", "Indexes with few key values", 0, min_rows=100000, max_distinct_keys=10)
def r09_few_keys(t: Tables, min_rows: int, max_distinct_keys: int):
    """The found indexes are written once; columns of other indexes are left out before they meet the table columns."""
    i = written(t.indexes.filter((F.col("num_rows") > min_rows) & (F.col("distinct_keys") <= max_distinct_keys)), "r09-indexes")
    tb = t.tables.select(F.col("owner").alias("table_owner"), "table_name", F.col("num_rows").alias("rows_table"), "iot_type")
    nn = t.ind_columns.join(i.select(F.col("owner").alias("index_owner"), "index_name"), ["index_owner", "index_name"], "left_semi") \
        .join(t.tab_columns.select(F.col("owner").alias("table_owner"), "table_name", "column_name", "nullable"),
              ["table_owner", "table_name", "column_name"], "inner") \
        .groupBy(F.col("index_owner").alias("owner"), "index_name").agg(
            F.when(F.sum(F.when(F.col("nullable") == "N", 1).otherwise(0)) == F.count(F.lit(1)), F.lit("NOT NULL"))
            .otherwise(F.lit("NULLABLE")).alias("nullable"))
    out = i.join(tb, ["table_owner", "table_name"], "inner").join(nn, ["owner", "index_name"], "left")
    return out.select("owner", "table_name", "index_name", "distinct_keys", F.round(F.col("num_rows") / per_unit_den("distinct_keys")).alias("rows_per_key"),
                      F.col("num_rows").alias("rows_index"), "rows_table", (F.col("rows_table") - F.col("num_rows")).alias("possible_nulls"),
                      "iot_type", F.round(F.col("leaf_blocks") * 8192 / MB, 1).alias("mbytes"), "nullable")


@rule("R10", "Columns indexed more than once as leading single column", 0, min_rows=100000)
def r10_column_indexed_twice(t: Tables, min_rows: int):
    ic = t.ind_columns
    first = ic.filter(F.col("column_position") == 1)
    d = first.groupBy("table_owner", "table_name", "column_name").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    single = first.join(ic.filter(F.col("column_position") == 2).select("table_owner", "table_name", "index_name"),
                        ["table_owner", "table_name", "index_name"], "left_anti")
    j = d.join(single, ["table_owner", "table_name", "column_name"], "inner")
    ix = t.indexes.filter(F.col("num_rows") > min_rows).select("table_owner", "table_name", "index_name", F.col("owner").alias("ix_owner"), "num_rows")
    pk = t.constraints.filter(F.col("constraint_type") == "P").select(F.col("owner").alias("ix_owner"), "table_name", "index_name",
                                                                      F.col("constraint_name").alias("used_for_pkey"))
    return j.join(ix, ["table_owner", "table_name", "index_name"], "inner").join(pk, ["ix_owner", "table_name", "index_name"], "left") \
        .select("table_owner", "table_name", "column_name", "index_name", "num_rows", "used_for_pkey")


@rule("R13", "Local partitioning candidates: global non-unique indexes of partitioned tables", 0)
def r13_local_partition_candidates(t: Tables):
    tb = t.tables.filter(F.col("partitioned") == "YES").select(F.col("owner").alias("table_owner"), "table_name")
    i = t.indexes.filter((F.col("partitioned") == "NO") & (F.col("uniqueness") == "NONUNIQUE")).join(tb, ["table_owner", "table_name"], "inner")
    u = t.constraints.filter(F.col("constraint_type") == "U").select(F.col("owner").alias("table_owner"), "table_name", "index_name")
    return i.join(u, ["table_owner", "table_name", "index_name"], "left_anti").select("owner", "table_name", "index_name", "num_rows", "distinct_keys")


def _columns_with_rows(t: Tables):
    return t.tab_columns.join(t.tables.select("owner", "table_name", "num_rows"), ["owner", "table_name"], "inner")


@rule("R18", "Columns that are NULL in every row", 0, min_rows=0)
def r18_all_null_columns(t: Tables, min_rows: int):
    c = _columns_with_rows(t)
    return c.filter((F.col("num_rows") > min_rows) & (F.col("num_nulls") == F.col("num_rows")))


@rule("R19", "Columns with a single value (low information)", 0, min_rows=100000)
def r19_single_value_columns(t: Tables, min_rows: int):
    c = _columns_with_rows(t)
    return c.filter((F.col("num_rows") > min_rows) & (F.col("num_distinct") == 1))


def _stale(df: DataFrame, days: int, min_rows: int, as_of=None) -> DataFrame:
    ref = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else \
        df.select(F.max("last_analyzed").cast("timestamp_ntz")).scalar()
    return df.filter((F.col("last_analyzed") < ref - F.make_dt_interval(F.lit(days))) & (F.col("num_rows") > min_rows)) \
        .withColumn("days_since_analyzed", F.datediff(ref, F.col("last_analyzed")))


@rule("R50", "Tables with stale optimizer statistics", 0, days=30, min_rows=100000)
def r50_stale_table_stats(t: Tables, days: int, min_rows: int):
    return _stale(t.tables, days, min_rows).select("owner", "table_name", "num_rows", "last_analyzed", "days_since_analyzed")


@rule("R51", "Indexes with stale optimizer statistics", 0, days=30, min_rows=100000)
def r51_stale_index_stats(t: Tables, days: int, min_rows: int):
    return _stale(t.indexes, days, min_rows).select("owner", "index_name", "table_name", "num_rows", "last_analyzed", "days_since_analyzed")


@rule("R68", "Multi-column primary/unique keys used as reference target", 0, min_columns=2)
def r68_multi_column_targets(t: Tables, min_columns: int):
    keys = t.constraints.filter(F.col("constraint_type").isin("P", "U")).select("owner", "constraint_name", "table_name")
    ncol = t.cons_columns.groupBy("owner", "constraint_name").agg(F.count(F.lit(1)).alias("key_columns"))
    refs = t.constraints.filter(F.col("constraint_type") == "R").groupBy(
        F.col("r_owner").alias("owner"), F.col("r_constraint_name").alias("constraint_name")).agg(F.count(F.lit(1)).alias("references"))
    return keys.join(ncol, ["owner", "constraint_name"], "inner").filter(F.col("key_columns") >= min_columns) \
        .join(refs, ["owner", "constraint_name"], "inner")


@rule("R04", "Table and index compression by single-block-read samples", 0, days=8, event="db file sequential read", min_samples=100)
def r04_compression_by_reads(t: Tables, days: int, event: str, min_samples: int):
    """Objects often read block by block, with their compression looked up by object type."""
    from ..operators.lookup import typed_lookup
    h = t.ash.filter(F.col("event") == event).groupBy("current_obj").agg(F.count(F.lit(1)).alias("samples")) \
        .filter(F.col("samples") > min_samples)
    o = h.join(t.objects.select(F.col("object_id").alias("current_obj"), "owner", "object_name", "object_type"), "current_obj", "left")
    dims = {"TABLE": (t.tables, ["owner", "table_name"]), "INDEX": (t.indexes, ["owner", "index_name"])}
    out = typed_lookup(o, "object_type", dims, ["owner", "object_name"], ["compression"])
    return out.groupBy("owner", "object_name", "object_type", "compression").agg(F.sum("samples").alias("samples"))


@rule("R11", "Monitored indexes that were never used", 0, min_rows=100000)
def r11_monitored_unused(t: Tables, min_rows: int):
    from ..functions import bit_set
    u = t.index_usage.filter(bit_set("index_flags", 65536) & ~bit_set("usage_flags", 1))
    return u.join(t.indexes.select("owner", "index_name", "table_name", "num_rows", "distinct_keys", "uniqueness"),
                  ["owner", "index_name", "table_name"], "inner").filter(F.col("num_rows") > min_rows)


@rule("R14", "Unique indexes of partitioned tables that could be local (partition key leads the index)", 0)
def r14_unique_local_candidates(t: Tables):
    tb = t.tables.filter(F.col("partitioned") == "YES").select("owner", "table_name", "num_rows")
    pk = t.part_key_columns.filter(F.col("column_position") == 1).select("owner", "table_name", F.col("column_name").alias("partition_key1"))
    ic = t.ind_columns.filter(F.col("column_position") == 1).select(F.col("table_owner").alias("owner"), "table_name",
                                                                    F.col("column_name").alias("partition_key1"), "index_owner", "index_name")
    ix = t.indexes.filter(F.col("partitioned") == "NO").select(F.col("owner").alias("index_owner"), "index_name")
    return tb.join(pk, ["owner", "table_name"], "inner").join(ic, ["owner", "table_name", "partition_key1"], "inner") \
        .join(ix, ["index_owner", "index_name"], "inner").select("owner", "table_name", "partition_key1", "index_name", "num_rows")


@rule("R61", "Function-based indexes with literals in the expression", 0)
def r61_function_index_literals(t: Tables):
    return t.ind_expressions.filter(F.col("column_expression").rlike("['0-9]"))


@rule("R37", "Parallel statements with serial plan lines (history)", 1, days=8)
def r37_parallel_with_serial_parts_hist(t: Tables, days: int):
    p = t.sql_plan
    serial_line = ~_parallel(F.col("other_tag")) & ~F.col("operation").isin(*PX_NEUTRAL_OPERATIONS) & \
        ~F.col("operation").like("UPDATE%") & ~F.col("operation").like("SELECT%")
    plans = p.groupBy("sql_id", "plan_hash_value").agg(
        F.sum(F.when(_parallel(F.col("other_tag")), 1).otherwise(0)).alias("_px"),
        F.sum(F.when(serial_line, 1).otherwise(0)).alias("_serial")) \
        .filter((F.col("_px") > 0) & (F.col("_serial") > 1)).select("sql_id", "plan_hash_value")
    s = recent_sqlstat(t, days).join(plans, ["sql_id", "plan_hash_value"], "inner").groupBy("sql_id", "plan_hash_value").agg(
        F.min("parsing_schema_name").alias("parsing_schema_name"), F.round(F.sum("elapsed_time_delta") / 1e6, 2).alias("elapsed_secs"),
        F.sum("executions_delta").alias("executions"),
        F.round(per_unit(F.sum("elapsed_time_delta") / 1e6, F.sum("executions_delta")), 2).alias("elapsed_secs_per_exec"))
    lines = p.filter(serial_line & F.col("object_name").isNotNull()).select(
        "sql_id", "plan_hash_value", "operation", "options", "object_owner", "object_name")
    o = t.objects.select(F.col("owner").alias("object_owner"), "object_name", "num_rows")
    return s.join(lines, ["sql_id", "plan_hash_value"], "inner").join(o, ["object_owner", "object_name"], "left")


def _cartesian_walk(plan: DataFrame, marker: str) -> DataFrame:
    """Lines below each cartesian join, descending through lines without an object, keeping the first lines with one."""
    from ..operators.trees import marked_above
    # written, so that the joins below know their sizes: dealt by statement and plan, the lines would lie in a few tasks
    plan = written(plan.select(*STMT, "id", "parent_id", "operation", "options", "object_owner", "object_name"), "plan")
    marked = written(plan.filter(F.col("options") == marker).select(*STMT).distinct(), "marked")
    return marked_above(plan.join(marked, STMT, "left_semi"), ["sql_id", "plan_hash_value"], F.col("options") == marker,
                        F.col("object_name").isNull()).filter(F.col("object_name").isNotNull())


@rule("R45", "Cartesian joins and the objects they combine (cursor cache)", 1, marker="CARTESIAN", min_elapsed_secs=100.0)
def r45_cartesian_cur(t: Tables, marker: str, min_elapsed_secs: float):
    w = _cartesian_walk(t.sql_plan, marker)
    a = written(t.sqlarea.select("sql_id", "executions", F.round(F.col("elapsed_time") / 1e6, 6).alias("elapsed_secs"))
                .filter(F.col("elapsed_secs") > min_elapsed_secs), "area")
    o = written(t.objects.select(F.col("owner").alias("object_owner"), "object_name", "num_rows"), "objects")
    out = w.join(a, "sql_id", "inner").join(o, ["object_owner", "object_name"], "left")
    return out.select("sql_id", "plan_hash_value", "operation", "options", "object_owner", "object_name", "num_rows",
                      "executions", "elapsed_secs", F.col("id").alias("line_id"), "parent_id", "level")


@rule("R46", "Cartesian joins and the objects they combine (history)", 1, marker="CARTESIAN", days=8, min_elapsed_secs=100.0)
def r46_cartesian_hist(t: Tables, marker: str, days: int, min_elapsed_secs: float):
    """Both sides are summed before they meet: the history per plan, the walk as its rows per line."""
    line = ["sql_id", "plan_hash_value", "operation", "options", "object_owner", "object_name", "line_id", "parent_id"]
    w = _cartesian_walk(t.sql_plan, marker).withColumnRenamed("id", "line_id").groupBy(*line).agg(F.count(F.lit(1)).alias("_n"))
    s = written(recent_sqlstat(t, days).groupBy("instance_number", "sql_id", "plan_hash_value").agg(
        F.sum("executions_delta").alias("_e"), F.sum("elapsed_time_delta").alias("_t")), "stat")
    g = w.join(s, ["sql_id", "plan_hash_value"], "inner").select(
        "instance_number", *line, (F.col("_n") * F.col("_e")).alias("executions"), F.round(F.col("_n") * F.col("_t") / 1e6, 6).alias("elapsed_secs"))
    return g.filter(F.col("elapsed_secs") > min_elapsed_secs)


@rule("R20", "Columns set unused but not dropped", 0)
def r20_unused_columns(t: Tables):
    return t.unused_columns.filter(F.col("count") > 0).join(t.tables.select("owner", "table_name", "num_rows"),
                                                            ["owner", "table_name"], "inner") \
        .withColumn("weight", F.col("num_rows") * F.col("count"))


@rule("R21", "Dropped tables still in the recycle bin", 0)
def r21_dropped_tables(t: Tables):
    return t.tables.filter(F.col("dropped") == "YES")


@rule("R25", "Long-running foreign-key checks of deletes (recursive statements)", 1, days=8, schema="SYS",
      text_pattern="%SELECT%ALL_ROWS%COUNT(1)%")
def r25_fk_checks_on_delete(t: Tables, days: int, schema: str, text_pattern: str):
    s = recent_sqlstat(t, days).filter(F.col("parsing_schema_name") == schema).groupBy("dbid", "sql_id", "instance_number").agg(
        F.sum("executions_delta").alias("executions"), F.round(F.sum("elapsed_time_delta") / 1e6, 6).alias("elapsed_secs"),
        F.round(per_unit(F.sum("elapsed_time_delta") / 1e6, F.sum("executions_delta")), 5).alias("elapsed_per_exec"),
        F.sum("buffer_gets_delta").alias("buffer_gets"), F.max("snap_id").alias("max_snap_id"))
    txt = t.sqltext.filter(F.upper("sql_text").like(text_pattern)).select("sql_id", "sql_text")
    return s.join(txt, "sql_id", "inner").withColumn("short_text", F.substring("sql_text", 1, 40))


@rule("R53", "Sequences with a small cache for their use", 2)
def r53_sequence_cache(t: Tables):
    return t.sequences.withColumn("numbers_per_cache", F.round(F.col("last_number") / per_unit_den("cache_size"), 4))


@rule("R57", "Contradictory parameters: session cached cursors with cursor sharing", 5)
def r57_contradictory_parameters(t: Tables):
    p = t.parameters
    cs = p.filter((F.col("name") == "cursor_sharing") & (F.col("value") != "EXACT")).select("inst_id")
    return p.filter((F.col("name") == "session_cached_cursors") & (F.col("value") != "0")).join(cs, "inst_id", "left_semi") \
        .withColumn("problem", F.lit("session_cached_cursors should be 0 when cursor_sharing is not EXACT"))


@rule("R66", "Recovery-time target history", 4, instance=1, days=8)
def r66_recovery_target(t: Tables, instance: int, days: int):
    ref = t.snapshot.select(F.max("begin_interval_time").cast("timestamp_ntz")).scalar()
    ss = t.snapshot.filter(F.col("begin_interval_time").cast("timestamp_ntz") > ref - F.make_dt_interval(F.lit(days))) \
        .select("dbid", "instance_number", "snap_id", F.col("begin_interval_time").cast("timestamp_ntz").alias("begin_interval_time"))
    return t.recovery.filter(F.col("instance_number") == instance).join(ss, ["dbid", "instance_number", "snap_id"], "inner")


@rule("R07", "Possibly unnecessary indexes on foreign keys to small tables", 0, max_rows_target=100000,
      min_rows_origin=100000, max_references=10)
def r07_unneeded_fk_index(t: Tables, max_rows_target: int, min_rows_origin: int, max_references: int):
    r = t.constraints.filter(F.col("constraint_type") == "R").select("owner", "table_name", "constraint_name", "r_owner", "r_constraint_name")
    rc = t.cons_columns.select("owner", "constraint_name", "column_name", "position")
    ric = t.ind_columns.select(F.col("table_owner").alias("owner"), "table_name", "column_name",
                               F.col("column_position").alias("position"), "index_owner", "index_name")
    ri = t.indexes.select(F.col("owner").alias("index_owner"), "index_name", F.col("num_rows").alias("rows_origin"))
    fk = r.join(rc, ["owner", "constraint_name"], "inner").join(ric, ["owner", "table_name", "column_name", "position"], "inner") \
        .join(ri, ["index_owner", "index_name"], "inner")
    pcons = t.constraints.select(F.col("owner").alias("r_owner"), F.col("constraint_name").alias("r_constraint_name"),
                                 F.col("index_name").alias("target_index"))
    pidx = t.indexes.select(F.col("owner").alias("r_owner"), F.col("index_name").alias("target_index"),
                            F.col("num_rows").alias("rows_target"), F.col("table_name").alias("target_table"))
    nref = t.constraints.filter(F.col("constraint_type") == "R").groupBy("r_owner", "r_constraint_name").agg(
        F.count(F.lit(1)).alias("_refs"))
    out = fk.join(pcons, ["r_owner", "r_constraint_name"], "inner").join(pidx, ["r_owner", "target_index"], "inner") \
        .join(nref, ["r_owner", "r_constraint_name"], "inner")
    out = out.filter((F.col("rows_target") < max_rows_target) & (F.col("rows_origin") > min_rows_origin) &
                     (F.col("_refs") < max_references))
    return out.select("rows_origin", "owner", "table_name", "index_name", F.col("r_constraint_name").alias("constraint_name"),
                      "column_name", "rows_target", "position", "target_table", "target_index")


@rule("R15", "Hash-partitioned indexes whose partition key is not the indexed column", 0)
def r15_partitioned_index_overhead(t: Tables):
    i = t.indexes.select("owner", "index_name", "index_type", "table_name", "num_rows", "uniqueness", "distinct_keys")
    p = t.part_indexes.filter(F.col("partitioning_type") == "HASH")
    ic = t.ind_columns.select(F.col("index_owner").alias("owner"), "index_name", "column_position", F.col("column_name").alias("ind_col"))
    use = t.sql_plan.filter(F.col("options").isin("UNIQUE SCAN", "RANGE SCAN", "RANGE SCAN (MIN/MAX)")) \
        .join(t.sqlarea.select("sql_id", "executions", "rows_processed"), "sql_id", "inner") \
        .groupBy(F.col("object_owner").alias("owner"), F.col("object_name").alias("index_name")) \
        .agg(F.sum("executions").alias("executions"), F.sum("rows_processed").alias("rows_processed"))
    out = i.join(p, ["owner", "index_name"], "inner").join(ic, ["owner", "index_name", "column_position"], "inner") \
        .filter(F.col("part_column") != F.col("ind_col")).join(use, ["owner", "index_name"], "left")
    return out.select("owner", "index_name", "index_type", "table_name", "executions", "rows_processed", "num_rows",
                      "partitioning_type", "column_position", F.col("part_column").alias("part_col"), "ind_col",
                      "uniqueness", "distinct_keys", "partition_count", "locality")


@rule("R12", "Index columns of low selectivity next to a highly selective column", 0, selectivity_divisor=4, min_rows=100000)
def r12_low_selectivity_columns(t: Tables, selectivity_divisor: float, min_rows: int):
    """Non-unique indexes whose most selective column (MAX ... KEEP LAST by distinct values, A05) already
    separates the rows, listed with each less selective column; indexes used for index-only access in a
    plan (the index without its table in the same plan) are left out (anti join on a plan self-join)."""
    ic = t.ind_columns.select("index_owner", "index_name", "table_owner", "table_name", "column_name")
    tc = t.tab_columns.select(F.col("owner").alias("table_owner"), "table_name", "column_name", "num_distinct")
    cols = ic.join(tc, ["table_owner", "table_name", "column_name"], "inner")
    ms = cols.groupBy("index_owner", "index_name").agg(F.max("num_distinct").alias("max_num_distinct"),
                                                       last_value_by("column_name", "num_distinct").alias("max_column"))
    i = t.indexes.filter(F.col("num_rows").isNotNull() & (F.col("num_rows") > 0) & (F.col("uniqueness") == "NONUNIQUE")) \
        .select(F.col("owner").alias("index_owner"), "index_name", "table_owner", "table_name", "num_rows")
    # written, as in R45: dealt by plan, the lines would lie in a few tasks, and the joins below would leave them there
    p = written(t.sql_plan.select("sql_id", "plan_hash_value", "object_owner", "object_name"), "plan").distinct()
    idx_lines = p.select("sql_id", "plan_hash_value", F.col("object_owner").alias("index_owner"), F.col("object_name").alias("index_name"))
    tab_lines = p.select("sql_id", "plan_hash_value", F.col("object_owner").alias("table_owner"), F.col("object_name").alias("table_name"))
    only = idx_lines.join(i.select("index_owner", "index_name", "table_owner", "table_name"), ["index_owner", "index_name"], "inner") \
        .join(tab_lines, ["sql_id", "plan_hash_value", "table_owner", "table_name"], "left_anti").select("index_owner", "index_name").distinct()
    out = i.join(ms, ["index_owner", "index_name"], "inner").join(cols.drop("table_owner", "table_name"), ["index_owner", "index_name"], "inner") \
        .filter((F.col("max_num_distinct") > F.col("num_rows") / selectivity_divisor) & (F.col("column_name") != F.col("max_column")) &
                (F.col("num_rows") > min_rows)) \
        .join(only, ["index_owner", "index_name"], "left_anti")
    return out.select(F.col("index_owner").alias("owner"), "table_name", "index_name", "num_rows", "max_column", "max_num_distinct",
                      F.round(F.col("max_num_distinct") / F.col("num_rows"), 4).alias("max_selectivity"),
                      F.col("column_name").alias("min_column"), F.col("num_distinct").alias("min_num_distinct"))


@rule("R54", "Sequence use per day by the statements that call them", 2)
def r54_sequence_use_per_day(t: Tables):
    """Statements whose plans have a SEQUENCE step, with executions and rows per day of activity
    (at least one day) and the sequence's cache size."""
    p = t.sql_plan.filter(F.col("operation") == "SEQUENCE").select("inst_id", "sql_id", "object_owner", "object_name").distinct()
    a = t.cursors.filter(F.col("executions") > 0).select("inst_id", "sql_id", "executions", "rows_processed",
                                                         "first_load_time", "last_active_time")
    s = t.sequences.select(F.col("sequence_owner").alias("object_owner"), F.col("sequence_name").alias("object_name"), "cache_size")
    x = p.join(a, ["inst_id", "sql_id"], "inner").join(s, ["object_owner", "object_name"], "inner")
    days = seconds_between("first_load_time", "last_active_time") / 86400.0
    days = F.when(days < 1, F.lit(1.0)).otherwise(days)
    return x.withColumn("executions_per_day", F.round(F.col("executions") / days)) \
            .withColumn("rows_per_day", F.round(F.col("rows_processed") / days)) \
            .withColumn("rows_per_exec", F.round(F.col("rows_processed") / F.col("executions"), 2))
