"""Blocking chains and lock trees (B05, B06, E02, E05-E08), SURVEY 2.B/2.E.

Input is a wait-for edge table: one row per waiting session and sample
with the session it waits for.  Roots are found first (anti join), so the
walk only starts where the reference's final NOT EXISTS would keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grouping import drilldown, group_filter, value_or_counts
from ..operators.hierarchy import hierarchy_walk, root_only, tree_rollup
from ..operators.history import merge_live_history, snapshot_borders
from ..operators.lookup import segment_base_id
from ..operators.trees import deepest_levels

EDGE = dict(session="session_id", blocker="blocking_session", sample="sample_id")


def blocking_walk(edges: DataFrame, start=None, session: str = "session_id", blocker: str = "blocking_session",
                  sample: str = "sample_id", root_cols=None, max_depth: int | None = None) -> DataFrame:
    """Walk down from blockers to everyone waiting on them (A27 on wait-for edges)."""
    return hierarchy_walk(edges, connect=[(session, blocker)], same=[sample], start=start,
                          node=[session], root_cols=root_cols or [sample, blocker], max_depth=max_depth)


def root_blockers(edges: DataFrame, session: str = "session_id", blocker: str = "blocking_session",
                  sample: str = "sample_id", wait: str = "seconds_in_wait") -> DataFrame:
    """Root blockers per sample with blocked totals, direct waiters and wait."""
    roots = root_only(edges, [blocker], [session], [sample])
    walk = blocking_walk(edges, roots, session, blocker, sample)
    return tree_rollup(walk, [f"root_{sample}", f"root_{blocker}"], session, wait=wait)


def root_blockers_overall(edges: DataFrame, session: str = "session_id", blocker: str = "blocking_session",
                          sample: str = "sample_id", wait: str = "seconds_in_wait") -> DataFrame:
    """Root blockers over the whole period: samples blocked, blocked sessions, wait."""
    roots = root_only(edges, [blocker], [session], [sample])
    walk = blocking_walk(edges, roots, session, blocker, sample)
    return (walk.groupBy(f"root_{blocker}")
            .agg(F.count_distinct(f"root_{sample}").alias("samples"),
                 F.count_distinct(session).alias("blocked_sessions"),
                 F.sum(wait).alias("seconds_in_wait_total"), F.max("level").alias("max_level")))


def blocked_by(edges: DataFrame, blocker_value, session: str = "session_id", blocker: str = "blocking_session",
               sample: str = "sample_id", wait: str = "seconds_in_wait") -> DataFrame:
    """Sessions blocked directly and indirectly by one blocker."""
    walk = blocking_walk(edges, F.col(blocker) == F.lit(blocker_value), session, blocker, sample)
    return walk.groupBy(session).agg(F.min("level").alias("min_level"), F.max("level").alias("max_level"),
                                     F.count_distinct(sample).alias("samples"), F.sum(wait).alias("seconds_in_wait"))


def second_level(edges: DataFrame, root_blocker, session: str = "session_id", blocker: str = "blocking_session",
                 sample: str = "sample_id", wait: str = "seconds_in_wait") -> DataFrame:
    """Sessions waiting directly on a root blocker, each with its own subtree."""
    walk = blocking_walk(edges, F.col(blocker) == F.lit(root_blocker), session, blocker, sample,
                         root_cols=[session])
    return tree_rollup(walk, [f"root_{session}"], session, wait=wait)


def lock_tree(edges: DataFrame, session: str = "session_id", blocker: str = "blocking_session",
              sample: str = "sample_id") -> DataFrame:
    """Blocking tree of the locks: every session at its deepest level below a root."""
    waiting = edges.select(F.col(sample), F.col(session).alias(blocker)).distinct().withColumn("_waits", F.lit(True))
    marked = edges.join(waiting, [sample, blocker], "left")
    deep = deepest_levels(marked, blocker, session, [sample], start=F.col("_waits").isNull())
    return deep.withColumnRenamed("root", f"root_{blocker}")


def chain_of_causes(edges: DataFrame, session_value, session: str = "session_id", blocker: str = "blocking_session",
                    sample: str = "sample_id") -> DataFrame:
    """Upward walk from one waiting session to the sessions it waits for, with level."""
    walk = hierarchy_walk(edges, connect=[(blocker, session)], same=[sample],
                          start=F.col(session) == F.lit(session_value), node=[session],
                          root_cols=[sample])
    return walk.select(f"root_{sample}", session, blocker, "level")


def lock_drilldown(rows: DataFrame, registry: dict, by: str, filters: dict | None = None,
                   wait: str = "seconds_in_wait") -> DataFrame:
    """Lock-history drill-down by any key with filters."""
    return drilldown(rows, registry, by, filters, {"records": F.count(F.lit(1)), "wait_total": F.sum(wait)})


def lock_history_keys(time: str = "snapshot_ts") -> dict:
    """The 18 keys of the lock history (E07): 14 to group by and four that only filter (a time, its bounds, rows with a blocker)."""
    name = F.concat(F.lower(F.coalesce("blocking_object_schema", F.lit(""))), F.lit("."), F.coalesce("blocking_object_name", F.lit("")))
    ts = lambda v: F.lit(v).cast("timestamp_ntz")
    return {
        "snapshot": lambda v: F.col(time) == ts(v), "from": lambda v: F.col(time) >= ts(v), "to": lambda v: F.col(time) <= ts(v),
        "hide_non_blocking": lambda v: F.coalesce(F.col("blocking_sid").cast("string"), F.lit("0")) != F.lit(str(v)),
        "instance": F.col("instance_number"), "sid": F.col("sid"), "serialno": F.col("serialno"), "blocking_object": name, "sql_id": F.col("sql_id"),
        "module": F.col("module"), "object_name": F.col("object_name"), "lock_type": F.col("lock_type"), "request": F.col("request"),
        "lock_mode": F.col("lock_mode"), "blocking_rowid": F.col("blocking_rowid"), "blocking_instance": F.col("blocking_instance_number"),
        "blocking_sid": F.col("blocking_sid"), "blocking_sql_id": F.col("blocking_sql_id")}


def lock_history_grouping(rows: DataFrame, by: str, filters: dict | None = None, time: str = "snapshot_ts") -> DataFrame:
    """Lock history by one key: first and last time, waiting seconds, samples and 17 attributes as their value or '< n >' (E07).

    Nulls are not counted (an attribute without a value shows '< 0 >'); a null or
    empty filter value asks for rows without a value.
    """
    keys = lock_history_keys(time)
    shown = {k: c for k, c in keys.items() if isinstance(c, Column)}
    more = {k: F.col(k) for k in ("sql_child_number", "blocking_serialno", "blocking_sql_child_number")}
    return value_or_counts(rows.where(group_filter(filters or {}, keys)), {"group_value": shown[by]}, {**shown, **more},
                           {"first_time": F.min(time), "last_time": F.max(time), "seconds_in_wait": F.sum("seconds_in_wait"), "samples": F.count(F.lit(1))},
                           null_counts=False)


def lock_history_records(rows: DataFrame, objects: DataFrame, filters: dict | None = None, time: str = "snapshot_ts") -> DataFrame:
    """Single records of the lock history (E07); LOB and LOB index segments name the object they belong to."""
    out = rows.where(group_filter(filters or {}, lock_history_keys(time))).withColumn("blocking_object_schema", F.lower("blocking_object_schema"))
    names = objects.select(F.col("object_id").alias("_base"), F.col("object_name").alias("_name"))
    for c in ("object_name", "blocking_object_name"):
        out = out.withColumn("_base", segment_base_id(c)).join(names, "_base", "left")
        lob = F.col(c).startswith("SYS_LOB") | F.col(c).startswith("SYS_IL")
        out = out.withColumn(c, F.when(lob, F.concat(c, F.lit(" ("), F.coalesce("_name", F.lit("")), F.lit(")"))).otherwise(F.col(c))).drop("_base", "_name")
    return out


def table_closure(edges: DataFrame, start_table: str, child: str = "child_table", parent: str = "parent_table") -> DataFrame:
    """Tables depending (transitively) on ``start_table``, each at its deepest level."""
    e = edges.filter(F.col(child) != F.col(parent)).distinct()
    return deepest_levels(e, parent, child, start=F.col(parent) == F.lit(start_table)).select(child, "level").distinct()


def dependent_tables(edges: DataFrame, types: DataFrame, start_table: str, owner: str | None = None, table_type: str | None = None) -> DataFrame:
    """Tables that depend on ``start_table``, with their type and documentation.

    ``types`` holds (owner, table_name, table_type, documentation); tables without
    an entry are left out.  ``owner`` and ``table_type`` ('M' for master data)
    choose among the found tables; ways through others still count.
    """
    t = types.select(F.col("table_name").alias("child_table"), "owner", "table_type", "documentation")
    for c, v in (("owner", owner), ("table_type", table_type)):
        if v is not None:
            t = t.filter(F.col(c) == v)
    return table_closure(edges, start_table).join(t, "child_table")


def _count_text(c) -> Column:
    """The value of a group if it has one, else '< n >' (nulls not counted).

    Made from a set: its size is bounded by the sessions waiting in one sample, and
    unlike several exact distinct counts it needs no Expand of the rows.
    """
    seen = F.collect_set(c.cast("string"))
    return F.when(F.size(seen) > 1, F.concat(F.lit("< "), F.size(seen).cast("string"), F.lit(" >"))).otherwise(F.array_min(seen))


def _only(c) -> Column:
    return F.when(F.size(F.collect_set(c)) == 1, F.min(c))


def _object_text(objects: DataFrame) -> DataFrame:
    """(_obj, _name, _text, _data): objects with their shown text; LOB and LOB index segments name their table."""
    base = objects.select(F.col("object_id").alias("_base"), F.col("object_name").alias("_base_name"))
    o = objects.withColumn("_base", segment_base_id("object_name")).join(base, "_base", "left")
    more = F.when(F.col("_base").isNotNull(), F.concat(F.lit(" ("), F.coalesce("_base_name", F.lit("")), F.lit(")"))) \
        .when(F.col("subobject_name").isNotNull(), F.concat(F.lit(" ("), "subobject_name", F.lit(")"))).otherwise(F.lit(""))
    name = F.concat(F.col("owner"), F.col("object_name"))
    return o.select(F.col("object_id").alias("_obj"), name.alias("_name"), F.col("data_object_id").alias("_data"),
                    F.concat(F.lower("object_type"), F.lit(" "), "owner", F.lit("."), "object_name", more).alias("_text"))


def root_blockers_over_time(history: DataFrame, live: DataFrame, snaps: DataFrame, objects: DataFrame, users: DataFrame, start, end) -> DataFrame:
    """Root blockers of every sample of a time range with what waits for them and what they did themselves.

    1. History between the bracketing snapshots and older than the live buffer,
       and the live buffer (A13, A15); rows that wait for a known blocker.
    2. Down from the rows whose blocker does not wait in the same sample (A28, A27);
       sessions are (session, serial).  Per root: blocked sessions in total and
       directly, waiting time, object, file, block and row where there is one (A30).
    3. The root's own sample of the same second, by an equi join on (instance,
       second, session): history of the root's snapshot first, the live buffer
       second, INACTIVE without either.  The samples are first reduced to the
       roots' keys, so no other second is carried; of several samples of a session
       in a second the first by sample_id counts.

    Defined cases: rows with a null sample, session or blocker wait for nothing
    known; unknown objects and users are null; an empty range gives no rows.
    """
    time, ts = F.col("sample_time"), "timestamp_ntz"
    inside = (time >= F.lit(start).cast(ts)) & (time <= F.lit(end).cast(ts))
    bounds = snapshot_borders(snaps, start, end).groupBy("dbid").agg(F.min("start_snap_id").alias("_first"), F.max("end_snap_id").alias("_last"))
    old = history.join(bounds, "dbid").where(F.col("snap_id").between(F.col("_first"), F.col("_last"))).drop("_first", "_last")
    now = live.withColumn("snap_id", F.lit(None).cast(history.schema["snap_id"].dataType)).select(*history.columns)
    seen = merge_live_history(old.select(*history.columns), now).where(inside)
    waits = seen.where(F.col("blocking_session_status").isin("VALID", "GLOBAL")).withColumn(
        "_obj", F.when(F.col("p2text") == "object #", F.col("p2")).otherwise(F.col("current_obj")))
    waits = waits.join(_object_text(objects), "_obj", "left").join(users.select("user_id", F.col("username").alias("_user")), "user_id", "left")
    roots = root_only(waits, ["blocking_session", "blocking_serial"], ["session_id", "session_serial"], ["sample_id"])
    key = {"snap_id": "root_snap_id", "sample_id": "root_sample_id", "sample_time": "root_sample_time", "blocking_session": "root_blocking_session",
           "blocking_serial": "root_blocking_serial", "blocking_session_status": "root_blocking_status", "blocking_inst_id": "root_blocking_inst_id"}
    carried = [*key, "_name", "_text", "_data", "instance_number", "sql_id", "_user", "event"]
    walk = hierarchy_walk(waits, connect=[("session_id", "blocking_session"), ("session_serial", "blocking_serial")], same=["sample_id"],
                          start=roots, node=["session_id", "session_serial"], root_cols=carried)
    root = lambda c: F.col(f"root_{c}")
    names = F.collect_set(root("_name"))
    g = walk.groupBy(*[root(c).alias(a) for c, a in key.items()]).agg(
        _only(F.col("current_file")).alias("current_file"), _only(F.col("current_block")).alias("current_block"), _only(F.col("current_row")).alias("current_row"),
        _count_text(F.col("session_id")).alias("blocked_sessions_total"),
        _count_text(F.when(F.col("level") == 1, F.col("session_id"))).alias("blocked_sessions_direct"),
        _count_text(F.col("instance_number")).alias("waiting_instance"),
        F.round(F.sum(F.col("wait_time") + F.col("time_waited")) / 1e6, 6).alias("seconds_in_wait_total"),
        F.when(F.size(names) > 1, F.concat(F.lit("< "), F.size(names).cast("string"), F.lit(" >"))).otherwise(F.min(root("_text"))).alias("root_blocking_object"),
        _only(root("_data")).alias("data_object_id"), _count_text(root("instance_number")).alias("root_instance_number"),
        _count_text(root("sql_id")).alias("root_sql_id"), _count_text(root("_user")).alias("root_user_name"), _count_text(root("event")).alias("root_event"),
        F.max("level").alias("max_level"))
    did = ["event", "session_state", "module", "action", "program", "sql_id", "user_id"]

    def at(samples: DataFrame, keys: list[str], tag: str) -> tuple[DataFrame, list[Column]]:
        asked = g.select(F.col("root_blocking_inst_id").alias("instance_number"), F.date_trunc("second", "root_sample_time").alias("_sec"),
                         F.col("root_blocking_session").alias("session_id"), F.col("root_snap_id").alias("snap_id")).select(*keys).distinct()
        found = (samples.where(inside).withColumn("_sec", F.date_trunc("second", "sample_time")).join(asked, keys, "left_semi")
                 .groupBy(*keys).agg(F.min(F.struct("sample_id", *did)).alias(tag)))
        to = {"instance_number": F.col("root_blocking_inst_id"), "_sec": F.date_trunc("second", "root_sample_time"),
              "session_id": F.col("root_blocking_session"), "snap_id": F.col("root_snap_id")}
        right = found.select(*[F.col(k).alias(f"_{tag}{k}") for k in keys], tag)
        return right, [to[k] == F.col(f"_{tag}{k}") for k in keys]

    h, on_h = at(history, ["instance_number", "_sec", "session_id", "snap_id"], "_h")
    v, on_v = at(live, ["instance_number", "_sec", "session_id"], "_v")
    both = g.join(h, on_h, "left").join(v, on_v, "left")
    pick = lambda c: F.coalesce(F.col(f"_h.{c}"), F.col(f"_v.{c}"))
    who = users.select(F.col("user_id").alias("_uid"), F.col("username").alias("root_blocking_user_name"))
    out = both.withColumn("_uid", pick("user_id")).join(who, "_uid", "left")
    return out.select(
        *[c for c in g.columns if c != "root_sample_time"], F.col("root_sample_time").cast("timestamp_ntz").alias("root_sample_time"),
        F.coalesce("_h.event", "_h.session_state", "_v.event", "_v.session_state", F.lit("INACTIVE")).alias("root_blocking_event"),
        *[pick(c).alias(f"root_blocking_{c}") for c in ("module", "action", "program", "sql_id")], "root_blocking_user_name")
