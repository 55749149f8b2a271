"""Snapshot axis and live/history merge.

The snapshot table is small (one row per instance and interval); the fact
tables are large.  Bounds are computed as aggregates and joined by the
instance key; AQE broadcasts them when they turn out small and falls back to
a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_bounds(snaps: DataFrame, start, end, by=("dbid", "instance_number"),
                    snap="snap_id", begin="begin_interval_time",
                    end_col="end_interval_time") -> DataFrame:
    """min/max snapshot id whose interval begins inside [start, end] per ``by``."""
    inside = (F.col(begin) >= F.lit(start).cast("timestamp_ntz")) & \
             (F.col(begin) <= F.lit(end).cast("timestamp_ntz"))
    return (snaps.filter(inside).groupBy(*by)
            .agg(F.min(snap).alias("min_snap_id"), F.max(snap).alias("max_snap_id")))


def snapshot_borders(snaps: DataFrame, start, end, by=("dbid", "instance_number"),
                     snap="snap_id", begin="begin_interval_time",
                     end_col="end_interval_time") -> DataFrame:
    """Bracketing snapshots of a time range per ``by``.

    start snapshot: the last one beginning at or before ``start``, else the
    first beginning at or after it; end snapshot: the first one ending at or
    after ``end``, else the last one ending at or before it.  Conditional
    aggregates do it in one pass over the (small) snapshot table.
    """
    s = F.lit(start).cast("timestamp_ntz")
    e = F.lit(end).cast("timestamp_ntz")
    b, en, sn = F.col(begin), F.col(end_col), F.col(snap)
    agg = snaps.groupBy(*by).agg(
        F.max(F.when(b <= s, sn)).alias("_start_le"),
        F.min(F.when(b >= s, sn)).alias("_start_ge"),
        F.min(F.when(en >= e, sn)).alias("_end_ge"),
        F.max(F.when(en <= e, sn)).alias("_end_le"),
    )
    borders = agg.select(*by,
                         F.coalesce("_start_le", "_start_ge").alias("start_snap_id"),
                         F.coalesce("_end_ge", "_end_le").alias("end_snap_id"))
    # times of the chosen snapshots
    st = snaps.select(*by, F.col(snap).alias("start_snap_id"), b.alias("start_time"))
    et = snaps.select(*by, F.col(snap).alias("end_snap_id"), en.alias("end_time"))
    return (borders.join(st, [*by, "start_snap_id"], "left")
            .join(et, [*by, "end_snap_id"], "left")
            .select(*by, "start_snap_id", "end_snap_id", "start_time", "end_time"))


def range_join_snaps(fact: DataFrame, borders: DataFrame, by=("dbid", "instance_number"),
                     snap="snap_id", lo="start_snap_id", hi="end_snap_id",
                     lo_exclusive: bool = False) -> DataFrame:
    """Fact rows with ``lo <= snap <= hi`` of their instance.

    Equi join on the instance key plus a range condition.  The border table has
    one row per instance and is broadcast: dealt by the instance, the facts
    would lie in as many tasks as there are instances.
    """
    bd = F.broadcast(borders.select(*by, F.col(lo).alias("_lo"), F.col(hi).alias("_hi")))
    low = (F.col(snap) > F.col("_lo")) if lo_exclusive else (F.col(snap) >= F.col("_lo"))
    return (fact.join(bd, list(by), "inner")
            .filter(low & (F.col(snap) <= F.col("_hi")))
            .drop("_lo", "_hi"))


def merge_live_history(hist: DataFrame, live: DataFrame, key="instance_number",
                       ts="sample_time", weight="sample_cycle", hist_weight: int = 10,
                       live_weight: int = 1, how: str = "left") -> DataFrame:
    """Union of the live buffer with the history older than it.

    The live buffer is complete; history rows are kept only where they are
    older than the oldest live row of their instance.  ``how='left'`` keeps
    history of instances without live rows; ``'inner'`` drops them (the
    reference's second variant).  Implemented as an anti join with a range
    condition on the per-instance minimum, so history is read once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    live_min = live.groupBy(*keys).agg(F.min(ts).alias("_live_min"))
    h = hist.alias("_h")
    cond = [F.col(f"_h.{k}") == F.col(f"_l.{k}") for k in keys]
    newer = F.col(f"_h.{ts}") >= F.col("_l._live_min")
    if how == "left":
        kept = h.join(live_min.alias("_l"), cond + [newer], "left_anti")
    else:
        kept = h.join(live_min.alias("_l"), cond + [~newer], "left_semi")
    return (kept.withColumn(weight, F.lit(hist_weight))
            .unionByName(live.withColumn(weight, F.lit(live_weight))))
