"""Locks and sessions as exported snapshot tables (E01, E03, E04, E09-E12) and single samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code_label, contains_ci, minute_slice
from ..operators.grouping import group_filter, value_or_counts

# Lock mode numbers and their names.
LOCK_MODES = {0: "none", 1: "null (NULL)", 2: "row-S (SS)", 3: "row-X (SX)", 4: "share (S)",
              5: "S/Row-X (SSX)", 6: "exclusive (X)"}


def lock_list(locks: DataFrame, sessions: DataFrame, objects: DataFrame, skip_types=("AE", "PS")) -> DataFrame:
    """Locks with their session, blocking session and locked object.

    Sessions are joined inner (user sessions only), the blocking session and
    the object left outer; DML (TM) locks name their object through ID1.
    """
    s = sessions.filter(F.col("session_type") == "USER").select("inst_id", "sid", "username", "module", "sql_id")
    bs = sessions.select(F.col("inst_id"), F.col("sid").alias("blocking_session"), F.col("username").alias("blocking_username"))
    lo = objects.select(F.col("object_id").alias("id1"), F.col("owner").alias("locked_object_owner"),
                        F.col("object_name").alias("locked_object_name"))
    out = locks.filter(~F.col("lock_type").isin(*skip_types)).join(s, ["inst_id", "sid"], "inner") \
        .join(bs, ["inst_id", "blocking_session"], "left")
    out = out.join(lo.withColumn("_tm", F.lit(True)), "id1", "left") \
        .withColumn("locked_object_name", F.when(F.col("lock_type") == "TM", F.col("locked_object_name"))) \
        .withColumn("locked_object_owner", F.when(F.col("lock_type") == "TM", F.lower("locked_object_owner"))).drop("_tm")
    return out.withColumn("lock_mode", code_label("lmode", LOCK_MODES)).withColumn("request_mode", code_label("request", LOCK_MODES))


def lock_details(locks: DataFrame, sessions: DataFrame, processes: DataFrame, transactions: DataFrame, objects: DataFrame,
                 instance: int | None = None, sid: int | None = None, skip_types=("AE", "PS")) -> DataFrame:
    """Locks with session, process, transaction, blocking session, locked object and the object waited for.

    User sessions that have a process; the rest is joined outer.  The object
    waited for is named by the wait's second parameter where that is an object,
    else by the session's row wait, and shown where the session waits and the
    lock is requested.  ``instance`` and ``sid`` give the locks of one session,
    ``skip_types=()`` all lock types.
    """
    for column, value in (("inst_id", instance), ("sid", sid)):
        if value is not None:
            locks = locks.filter(F.col(column) == value)
    if skip_types:
        locks = locks.filter(~F.col("lock_type").isin(*skip_types))
    kept = ["inst_id", "sid", "lock_type", "id1", "id2", "lmode", "request", "ctime"]
    where = F.concat_ws("", "machine", F.lit("("), "os_user", F.lit("):"), "process", F.lit(":"), "program")
    row_wait = F.when(F.col("row_wait_obj") != -1, F.col("row_wait_obj"))
    s = sessions.filter(F.col("session_type") == "USER").select(
        "inst_id", "sid", "serial_no", "status", "username", "module", "sql_id", "process_addr", "transaction_addr", "lock_wait",
        "seconds_in_wait", "blocking_instance", "blocking_session", where.alias("client"),
        F.when(F.col("p2text") == "object #", F.col("p2")).otherwise(row_wait).alias("wait_object_id"))
    p = processes.select("inst_id", F.col("addr").alias("process_addr"), "spid")
    x = transactions.select("inst_id", F.col("addr").alias("transaction_addr"), "rollback_segment")
    bs = sessions.select(F.col("inst_id").alias("blocking_instance"), F.col("sid").alias("blocking_session"), F.col("inst_id").alias("blocking_inst_id"),
                         F.col("sid").alias("blocking_sid"), F.col("serial_no").alias("blocking_serial_no"))
    lo = objects.select(F.col("object_id").alias("id1"), F.lower("owner").alias("locked_object_owner"),
                        F.col("object_name").alias("locked_object_name"), F.col("object_type").alias("locked_object_type"))
    o = objects.select(F.col("object_id").alias("wait_object_id"), F.concat("owner", F.lit("."), "object_name").alias("_waits_for"))
    # one row per session first: the locks join it once
    s = (s.join(p, ["inst_id", "process_addr"]).join(x, ["inst_id", "transaction_addr"], "left")
         .join(bs, ["blocking_instance", "blocking_session"], "left").join(o, "wait_object_id", "left"))
    out = locks.select(*kept).join(s, ["inst_id", "sid"]).join(lo, "id1", "left")
    waits = F.col("lock_wait").isNotNull() & (F.col("request") != 0)
    return out.select(
        "inst_id", "sid", "serial_no", "status", "module", "sql_id", "locked_object_owner", "locked_object_name", "locked_object_type",
        "rollback_segment", F.concat_ws(":", F.col("inst_id").cast("string"), "spid", "username").alias("inst_pid_user"), "client", "lock_type",
        F.when(waits, F.col("_waits_for")).alias("waiting_for_object"), F.col("seconds_in_wait").alias("waiting_secs"),
        F.col("ctime").alias("lock_held_secs"), F.concat_ws(":", F.col("id1").cast("string"), F.col("id2").cast("string")).alias("id1_id2"),
        code_label("request", LOCK_MODES).alias("request"), code_label("lmode", LOCK_MODES).alias("lock_mode"),
        "blocking_inst_id", "blocking_sid", "blocking_serial_no")


def holder_waiter(locks: DataFrame, handle=("inst_id", "lock_type", "id1", "id2")) -> DataFrame:
    """Pairs of a lock's holder and a session that waits for it, on the same handle.

    A holder has a mode other than none and null and requests none or null; a
    waiter the other way round.  An equi-join on the handle: the output is one
    row for each pair, as asked, and no other pair is formed.
    """
    h = list(handle)
    idle = (0, 1)
    holders = locks.filter(~F.col("lmode").isin(*idle) & F.col("request").isin(*idle)) \
        .select(*h, F.col("sid").alias("holder_sid"), F.col("lmode").alias("holder_mode"))
    waiters = locks.filter(F.col("lmode").isin(*idle) & ~F.col("request").isin(*idle)) \
        .select(*h, F.col("sid").alias("waiter_sid"), "request", "ctime")
    return waiters.join(holders, h, "inner").withColumn("holder_mode_name", code_label("holder_mode", LOCK_MODES)) \
                  .withColumn("request_mode_name", code_label("request", LOCK_MODES))


def lock_history_slices(history: DataFrame, minute_col: str, width: int, by=("instance_number",)) -> DataFrame:
    """Lock history per time slice: records, wait and the blocker/statement as value or '< n >' (E04)."""
    return value_or_counts(history, {"slice": minute_slice(minute_col, width), **{b: F.col(b) for b in by}},
                           {"blocking_session": F.col("blocking_session"), "sql_id": F.col("sql_id")},
                           {"records": F.count(F.lit(1)), "wait_total": F.sum("time_waited")}, null_counts=False)


def session_list(sessions: DataFrame, extras: list[tuple[DataFrame, list[str], dict]], search: str | None = None,
                 search_cols=("username", "module"), long_ops: DataFrame | None = None,
                 keys=("inst_id", "sid")) -> DataFrame:
    """Sessions with pre-aggregated IO / memory / parallel / temp figures and filters.

    Each extra source is aggregated per session before the join (one row
    per session per source); sessions with a running long operation are
    removed with an anti join.
    """
    k = list(keys)
    out = sessions
    for df, dkeys, aggs in extras:
        g = df.groupBy(*[F.col(a).alias(b) for a, b in zip(dkeys, k)]).agg(*[v.alias(n) for n, v in aggs.items()])
        out = out.join(g, k, "left")
    if search:
        out = out.filter(contains_ci(list(search_cols), search))
    if long_ops is not None:
        out = out.join(long_ops.select(*k).distinct(), k, "left_anti")
    return out


def session_memory(processes: DataFrame, workers: DataFrame, keys=("inst_id", "sid")) -> DataFrame:
    """Memory per category of a session together with its parallel workers."""
    k = list(keys)
    own = processes.select(*k, F.col("sid").alias("qcsid"), "category", "allocated")
    w = workers.select(*k, "qcsid").join(processes, k, "inner").select(*k, "qcsid", "category", "allocated")
    both = own.unionByName(w)
    return both.groupBy("inst_id", "qcsid", "category").agg(F.sum("allocated").alias("allocated"),
                                                            F.count_distinct("sid").alias("processes"))


def temp_usage(usage: DataFrame, by: str) -> DataFrame:
    """Temp blocks per session or per statement."""
    return usage.groupBy(by).agg(F.sum("blocks").alias("temp_blocks"), F.count(F.lit(1)).alias("segments"))


def enqueue_waits(waits: DataFrame, names: DataFrame, key: str = "event_id") -> DataFrame:
    """Waits on enqueues with the lock type cut out of the event name 'enq: XX - ...' (E12)."""
    n = names.filter(F.col("event_name").like("enq:%")).withColumn("lock_type", F.substring("event_name", 6, 2))
    return waits.join(n, key, "inner")


def single_samples(samples: DataFrame, registry: dict, filters: dict, lookups: list[tuple[DataFrame, list[str]]],
                   opcode: str | None = None, opcode_names: dict | None = None) -> DataFrame:
    """Single activity samples matching a drill-down filter, with lookups and a code label."""
    out = samples.filter(group_filter(filters, registry))
    out = reduce(lambda a, lk: a.join(lk[0], lk[1], "left"), lookups, out)
    if opcode and opcode_names:
        out = out.withColumn("operation", code_label(opcode, opcode_names, "UNKNOWN"))
    return out
