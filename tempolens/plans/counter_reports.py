"""Counter-history reports, SURVEY 2.C.

Fact tables hold cumulative counters per (dbid, instance, key, snap_id);
the snapshot table maps snap ids to intervals.  All reports are deltas
(A01/A02) followed by aggregation; name tables are joined after the
aggregation, when the data is already small.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bit_set, per_unit, pct, trunc_time
from ..operators.counters import counter_delta, delta_in_range, first_last_delta
from ..operators.history import merge_live_history, snapshot_bounds

INST = ["dbid", "instance_number"]


def system_events_total(fact: DataFrame, snaps: DataFrame, names: DataFrame, start, end,
                        exclude_idle: bool = True, chunk="auto") -> DataFrame:
    """Waits, timeouts and wait seconds per event in a time range."""
    bounds = snapshot_bounds(snaps, start, end)
    d = delta_in_range(fact, bounds, INST + ["event_id"], "snap_id",
                       ["total_waits", "total_timeouts", "time_waited_micro"], chunk=chunk)
    agg = d.groupBy(*INST, "event_id").agg(
        F.sum("total_waits").alias("waits"), F.sum("total_timeouts").alias("timeouts"),
        F.round(F.sum("time_waited_micro") / F.lit(1e6), 6).alias("time_waited_secs"),
        F.min("min_snap_id").alias("min_snap_id"), F.max("snap_id").alias("max_snap_id"))
    out = agg.join(names, "event_id", "inner")
    if exclude_idle:
        out = out.filter(F.col("wait_class") != "Idle")
    return out


def system_events_per_snapshot(fact: DataFrame, snaps: DataFrame, event_id: int,
                               min_snap: int, max_snap: int) -> DataFrame:
    """Deltas of one event per snapshot and instance."""
    f = fact.filter((F.col("event_id") == event_id) &
                    F.col("snap_id").between(min_snap - 1, max_snap))
    d = counter_delta(f, INST + ["event_id"], "snap_id",
                      ["total_waits", "total_timeouts", "time_waited_micro"])
    d = d.filter(F.col("snap_id").between(min_snap, max_snap))
    return (d.join(snaps, INST + ["snap_id"], "inner")
            .select("instance_number", "snap_id",
                    F.col("begin_interval_time").cast("timestamp_ntz").alias("begin_interval_time"),
                    F.col("total_waits").alias("waits"), F.col("total_timeouts").alias("timeouts"),
                    F.round(F.col("time_waited_micro") / F.lit(1e6), 6).alias("time_waited_secs")))


def _safe_name(s: str) -> str:
    return re.sub(r"[^0-9a-zA-Z]+", "_", s).strip("_").lower()


def sysstat_deltas(fact: DataFrame, snaps: DataFrame, names: DataFrame, start, end,
                   class_bit: int | None = None) -> DataFrame:
    """Per-snapshot deltas of system statistics in a range, optional class filter."""
    bounds = snapshot_bounds(snaps, start, end)
    d = delta_in_range(fact, bounds, INST + ["stat_id"], "snap_id", ["value"])
    n = names if class_bit is None else names.filter(bit_set("class", class_bit))
    return d.join(n, "stat_id", "inner")


def sysstat_wide(fact: DataFrame, snaps: DataFrame, names: DataFrame, start, end,
                 unit: str = "DD", class_bit: int | None = None, stat_names: list[str] | None = None,
                 max_columns: int = 2000) -> DataFrame:
    """System statistics as one column per statistic, per period.

    The pivot columns are ``stat_names`` or, when not given, read from the
    statistic-name dimension (a catalog of a few hundred names, filtered by
    class), so no pass over the facts is needed to find them; more than
    ``max_columns`` names are an error.
    """
    d = sysstat_deltas(fact, snaps, names, start, end, class_bit)
    d = d.join(snaps.select(*INST, "snap_id", "begin_interval_time"), INST + ["snap_id"], "inner")
    n = names if class_bit is None else names.filter(bit_set("class", class_bit))
    if stat_names is None:
        stat_names = [r[0] for r in n.select("stat_name").distinct().orderBy("stat_name").limit(max_columns + 1).collect()]
        if len(stat_names) > max_columns:
            raise ValueError(f"more than {max_columns} statistics: give stat_names")
    period = trunc_time("begin_interval_time", unit).alias("period")
    cols = [F.sum(F.when(F.col("stat_name") == s, F.col("value"))).alias(_safe_name(s)) for s in stat_names]
    return d.groupBy(period).agg(*cols)


def sysstat_totals(fact, snaps, names, start, end, class_bit=None) -> DataFrame:
    """Total of each statistic over the range."""
    d = sysstat_deltas(fact, snaps, names, start, end, class_bit)
    return d.groupBy("instance_number", "stat_id", "stat_name").agg(F.sum("value").alias("total_value"))


def one_stat_per_snapshot(fact, snaps, stat_id: int) -> DataFrame:
    """One statistic per snapshot."""
    d = counter_delta(fact.filter(F.col("stat_id") == stat_id), INST + ["stat_id"], "snap_id", ["value"])
    return (d.join(snaps, INST + ["snap_id"], "inner")
            .select("instance_number", "snap_id",
                    F.col("begin_interval_time").cast("timestamp_ntz").alias("begin_interval_time"),
                    "value"))


def latch_totals(fact: DataFrame, keys, order: str = "snap_id", gets: str = "gets",
                 misses: str = "misses", sleeps: str | None = None) -> DataFrame:
    """Gets, misses and miss % per latch between first and last snapshot."""
    cnt = [gets, misses] + ([sleeps] if sleeps else [])
    d = first_last_delta(fact, keys, order, cnt)
    out = d.withColumn("miss_pct", F.round(pct(misses, gets), 4))
    if sleeps:
        out = out.withColumn("sleeps_per_miss", F.round(per_unit(sleeps, misses), 4))
    return out


def latch_per_snapshot(fact: DataFrame, keys, order: str = "snap_id",
                       counters=("gets", "misses")) -> DataFrame:
    """Latch deltas per snapshot."""
    d = counter_delta(fact, keys, order, list(counters))
    return d.withColumn("miss_pct", F.round(pct(counters[1], counters[0]), 4))


def sampled_events(before: DataFrame, after: DataFrame, key: str = "event_id",
                   counters=("total_waits", "time_waited_micro")) -> DataFrame:
    """Two samples of cumulative event counters: delta and average ms per wait (C22, A40 + A26).

    Full outer match on the key (an event may appear in one sample only,
    then it counts from zero), deltas and totals, then the average wait.
    """
    from ..operators.grouping import keyed_full_outer
    b = before.select(key, *[F.col(c).alias(f"{c}_before") for c in counters])
    a = after.select(key, *[F.col(c).alias(f"{c}_after") for c in counters])
    j = keyed_full_outer(b, a, [key])
    out = j.select(key, *[(F.coalesce(F.col(f"{c}_after"), F.lit(0)) - F.coalesce(F.col(f"{c}_before"), F.lit(0))).alias(f"{c}_delta")
                          for c in counters],
                   *[F.coalesce(F.col(f"{c}_after"), F.lit(0)).alias(f"{c}_total") for c in counters])
    return out.withColumn("avg_ms_per_wait", F.round(F.try_divide(F.col(f"{counters[1]}_delta") / 1000.0,
                                                                  F.col(f"{counters[0]}_delta")), 4))


def sampled_segments(before: DataFrame, after: DataFrame, keys: list[str], counters: list[str],
                     only_changed: bool = True) -> DataFrame:
    """Segment statistics of two samples: delta and total on null-safe keys."""
    from ..operators.grouping import snapshot_diff
    return snapshot_diff(before, after, keys, counters, only_changed=only_changed)


def session_statistics(stats: DataFrame, names: DataFrame, classes: dict[int, str]) -> DataFrame:
    """Non-zero statistics with their decoded class names."""
    from ..functions import bitmask_decode
    return stats.filter(F.col("value") != 0).join(names, "stat_id", "inner") \
        .withColumn("class_names", bitmask_decode("class", classes))


def interconnect_latency(deltas: DataFrame, blocks_stat: int, time_stat: int) -> DataFrame:
    """Receive latency per instance and snapshot from two statistics, plus totals per instance."""
    from ..operators.grouping import rollup_total
    g = deltas.groupBy("instance_number", "snap_id").agg(
        F.sum(F.when(F.col("stat_id") == blocks_stat, F.col("value")).otherwise(0)).alias("blocks"),
        F.sum(F.when(F.col("stat_id") == time_stat, F.col("value")).otherwise(0)).alias("receive_time"))
    r = rollup_total(g, ["instance_number", "snap_id"], {"blocks": F.sum("blocks"), "receive_time": F.sum("receive_time")})
    return r.withColumn("ms_per_block", F.round(F.try_divide(F.col("receive_time") * 10.0, F.col("blocks")), 4))


def latency_now(stats: DataFrame, time_name: str = "gc cr block receive time", blocks_name: str = "gc cr blocks received",
                name: str = "stat_name") -> DataFrame:
    """Average receive time of a block per instance from the current statistics (C16, current form).

    Both statistics in one grouped pass; an instance that lacks one of them is
    left out, no blocks count as one block.
    """
    def value(which: str):
        return F.max(F.when(F.col(name) == which, F.col("value")))
    g = stats.filter(F.col(name).isin(time_name, blocks_name)).groupBy("inst_id").agg(value(time_name).alias("t"), value(blocks_name).alias("b"))
    b = F.when(F.col("b") == 0, F.lit(1)).otherwise(F.col("b"))
    return g.where(F.col("t").isNotNull() & F.col("b").isNotNull()).select("inst_id", F.round(F.col("t") / b * 10, 6).alias("avg_receive_time_ms"))


def latency_objects(segments: DataFrame, objects: DataFrame, dbid: int, instance: int, first_snap: int, last_snap: int,
                    measures: list[str], received: str = "gc_cr_blocks_received_delta") -> DataFrame:
    """Segment statistics between two snapshots of the objects that received blocks of other instances (C16, objects).

    Sums per object id come before the join with the objects, so the join sees
    one row for each object; objects of one name (owner, name, part) are one row.
    """
    here = (F.col("dbid") == dbid) & (F.col("instance_number") == instance) & F.col("snap_id").between(first_snap, last_snap)
    per = segments.filter(here).groupBy("obj").agg(*[F.sum(m).alias(m) for m in measures])
    names = objects.select(F.col("object_id").alias("obj"), "owner", "object_name", "subobject_name")
    g = per.join(names, "obj").groupBy("owner", "object_name", "subobject_name").agg(*[F.sum(m).alias(m) for m in measures])
    return g.where(F.col(received) > 0)


def metric_summary(metrics: DataFrame, unit: str, ts: str = "begin_time", name: str = "metric_name",
                   value: str = "value") -> DataFrame:
    """Average, minimum and maximum of each metric per truncated period."""
    return metrics.groupBy(trunc_time(ts, unit).alias("period"), name).agg(
        F.round(F.avg(value), 4).alias("avg_value"), F.min(value).alias("min_value"),
        F.max(value).alias("max_value"), F.count(F.lit(1)).alias("samples"))


def metric_history(hist: DataFrame, live: DataFrame, start, end, unit: str = "MI", summary: bool = False, instance: int | None = None,
                   dbid: int = 1, group: int = 2) -> DataFrame:
    """System metrics of a time range from the live buffer and the history older than it.

    Detail rows hold ``value``; summary rows ``average``, ``min_val`` and ``max_val``,
    of which the mean, the least and the greatest are taken.  Intervals that begin in the
    range and end in it count; unit 'SS' keeps each begin.  History of an instance
    without live rows is left out, as in the reference; nulls are ignored.
    """
    avg, low, high = ("average", "min_val", "max_val") if summary else ("value", "value", "value")
    cols = ["instance_number", "begin_time", "end_time", "group_id", "metric_id", "metric_name", "metric_unit", *dict.fromkeys((avg, low, high))]
    rows = merge_live_history(hist.filter(F.col("dbid") == dbid).select(*cols), live.select(*cols), ts="begin_time", how="inner")
    at = lambda v: F.lit(v).cast("timestamp_ntz")
    rows = rows.filter((F.col("group_id") == group) & (F.col("begin_time") >= at(start)) & (F.col("begin_time") < at(end)) & (F.col("end_time") <= at(end)))
    if instance is not None:
        rows = rows.filter(F.col("instance_number") == instance)
    period = F.col("begin_time") if unit == "SS" else trunc_time("begin_time", unit)
    return rows.groupBy(period.alias("period"), "metric_id", "metric_name", "metric_unit").agg(
        F.avg(avg).alias("value"), F.min(low).alias("min_value"), F.max(high).alias("max_value"))


def metric_wide(report: DataFrame, metrics: dict[int, str]) -> DataFrame:
    """One row per period with a column per metric asked for ({metric_id: column}); 0 where a metric has no value."""
    at = lambda i: F.max(F.when(F.col("metric_id") == i, F.col("value")))
    return report.groupBy("period").agg(*[F.coalesce(at(i), F.lit(0.0)).alias(c) for i, c in metrics.items()])


def mutex_sleeps(mutex: DataFrame, by: str) -> DataFrame:
    """Mutex sleeps by blocker or requester (chosen column) with sleeps per get."""
    return mutex.groupBy(by, "mutex_type").agg(F.sum("sleeps").alias("sleeps"), F.sum("gets").alias("gets"),
                                               F.count(F.lit(1)).alias("samples")) \
        .withColumn("sleep_ratio", F.round(F.try_divide(F.col("sleeps"), F.col("gets")), 6))


def mutex_timeline(mutex: DataFrame, unit: str = "MI", ts: str = "sleep_timestamp") -> DataFrame:
    """Mutex sleeps per truncated minute and type."""
    return mutex.groupBy(trunc_time(ts, unit).alias("period"), "mutex_type").agg(
        F.sum("sleeps").alias("sleeps"), F.count(F.lit(1)).alias("samples"))


def mutex_samples(mutex: DataFrame, start, end, instance: int | None = None, mutex_type: str | None = None,
                  filters: dict[str, object] | None = None, ts: str = "sleep_timestamp") -> DataFrame:
    """Single mutex sleeps of a time range (end exclusive), of one instance, type and any columns' values."""
    at = lambda v: F.lit(v).cast("timestamp_ntz")
    out = mutex.filter((F.col(ts) >= at(start)) & (F.col(ts) < at(end)))
    for c, v in {"inst_id": instance, "mutex_type": mutex_type, **(filters or {})}.items():
        if v is not None:
            out = out.filter(F.col(c) == v)
    return out


def enqueue_per_snapshot(fact: DataFrame, snaps: DataFrame, dbid: int, instance: int, event_id: int, first_snap: int, last_snap: int,
                         counters=("total_waits", "total_timeouts")) -> DataFrame:
    """Enqueue requests of one type between one snapshot and the one before it.

    The snapshot before the range is read too, so that the first one has a
    difference; the first of all has zeros, a counter that was reset a negative one.
    """
    one = fact.filter((F.col("dbid") == dbid) & (F.col("instance_number") == instance) & (F.col("event_id") == event_id)
                      & F.col("snap_id").between(first_snap - 1, last_snap))
    one = one.join(snaps.select("dbid", "instance_number", "snap_id", "begin_interval_time"), ["dbid", "instance_number", "snap_id"])
    d = counter_delta(one, ["dbid", "instance_number", "event_id"], "snap_id", list(counters), reset="keep")
    return d.filter(F.col("snap_id") >= first_snap).select("begin_interval_time", "snap_id", *counters)


def enqueue_totals(fact: DataFrame, names: DataFrame, key: str = "event_id",
                   counters=("total_waits", "total_timeouts")) -> DataFrame:
    """Enqueue requests between first and last snapshot per type, with names."""
    d = first_last_delta(fact, ["instance_number", key], "snap_id", list(counters))
    return d.join(names, key, "left")


def memory_history(eav: DataFrame, snaps: DataFrame, names: dict[str, str], cumulative: list[str],
                   hit: tuple[str, str] | None = None) -> DataFrame:
    """Memory (PGA) statistics per snapshot: name/value rows pivoted to columns, cumulative ones
    turned into deltas, hit percent recomputed from two of them (C17).

    ``eav`` is the union of the sources with (dbid, instance_number,
    snap_id, name, value); ``names`` maps source names to output columns.
    """
    from ..operators.grouping import pivot_stats
    wide = pivot_stats(eav, INST + ["snap_id"], "name", "value", list(names), keep_zero=True, alias=lambda n: names[n])
    d = counter_delta(wide, INST, "snap_id", cumulative, reset="keep", suffix="_delta")
    if hit:
        p, x = hit
        d = d.withColumn("hit_pct", F.round(F.try_divide(F.col(p) * 100.0, F.col(p) + F.col(x)), 4))
    return d.join(snaps.select(*INST, "snap_id", F.col("begin_interval_time").cast("timestamp_ntz").alias("begin_interval_time")),
                  INST + ["snap_id"], "inner")


def memory_per_instance(mem: DataFrame, value: str = "allocated", inst: str = "inst_id") -> DataFrame:
    """Current memory per instance: total and average per process."""
    return mem.groupBy(inst).agg(F.sum(value).alias("total"), F.round(F.avg(value), 4).alias("avg_per_process"),
                                 F.count(F.lit(1)).alias("processes"))


def cache_advice(advice: DataFrame, factors: list, order: str = "snap_id", key: str = "size_factor",
                 reads: str = "physical_reads") -> DataFrame:
    """Physical reads delta per cache size factor, one column per factor."""
    from ..operators.grouping import pivot_stats
    d = counter_delta(advice, INST + [key], order, [reads], reset="drop")
    return pivot_stats(d, INST + [order], key, reads, factors, keep_zero=True, alias=lambda f: f"factor_{str(f).replace('.', '_')}")


def redo_history(logs: DataFrame, snaps: DataFrame, status: str = "status", statuses=("CURRENT", "ACTIVE", "INACTIVE")) -> DataFrame:
    """Redo log groups per snapshot counted by status (C20)."""
    aggs = [F.sum(F.when(F.col(status) == s, 1).otherwise(0)).alias(s.lower()) for s in statuses]
    g = logs.groupBy(*INST, "snap_id").agg(F.count(F.lit(1)).alias("logs"), *aggs)
    return g.join(snaps.select(*INST, "snap_id", F.col("begin_interval_time").cast("timestamp_ntz").alias("begin_interval_time")),
                  INST + ["snap_id"], "inner")


def undo_history(undo: DataFrame, start, end, ts: str = "begin_time") -> DataFrame:
    """Undo statistics rows of a time range."""
    return undo.filter(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
