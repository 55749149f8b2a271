"""Top-x curves of a time series.

Zero filling the kept curves over all time slots is done without a cross
join: the kept curve names (at most ``x``, a proven bound) are computed once
as an array-valued scalar subquery; every time slot then gathers the values
of those curves into a map of at most ``x`` entries and explodes the array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_curves(cells: DataFrame, curve: str, value: str, x: int, total_scale: int = 6):
    """Array Column (scalar subquery) with the ``x`` curves of largest total.

    Ties on the (rounded) total are broken by curve name so the choice is
    deterministic.  ``orderBy().limit()`` runs as a distributed top-k
    (TakeOrderedAndProject): only x rows per partition reach the final merge.
    """
    ranked = (cells.groupBy(curve)
              .agg(F.round(F.sum(value), total_scale).alias("_total"))
              .orderBy(F.desc("_total"), F.asc(curve))
              .limit(x))
    return ranked.select(F.collect_list(curve)).scalar()


def top_x_series(df: DataFrame, ts: str, curve: str, value: str, x: int = 10,
                 scale: int | None = 6) -> DataFrame:
    """Long-form series (ts, curve, value) of the ``x`` largest curves, missing cells 0.

    ``curve`` must not be NULL (map the NULL group to a marker first, e.g.
    ``nvl_text``).  The time axis is every slot that has any value, as in
    the reference's chart data.
    """
    cells = df.groupBy(ts, curve).agg(F.sum(value).alias(value))
    top = top_curves(cells, curve, value, x)
    kept = F.when(F.array_contains(top, F.col(curve)), F.struct(F.col(curve), F.col(value)))
    per_slot = cells.groupBy(ts).agg(F.map_from_entries(F.collect_list(kept)).alias("_cells"))
    out = per_slot.select(ts, "_cells", F.explode(top).alias(curve))
    v = F.coalesce(F.col("_cells")[F.col(curve)], F.lit(0).cast(cells.schema[value].dataType))
    if scale is not None:
        v = F.round(v, scale)
    return out.select(ts, curve, v.alias(value))


def top_x_wide(df: DataFrame, ts: str, curve: str, value: str, x: int = 10) -> DataFrame:
    """Wide form: one column per kept curve (pivot with the x names as values)."""
    cells = df.groupBy(ts, curve).agg(F.sum(value).alias(value))
    names = [r[0] for r in cells.groupBy(curve).agg(F.sum(value).alias("_t"))
             .orderBy(F.desc("_t"), F.asc(curve)).limit(x).collect()]  # <= x rows
    return cells.groupBy(ts).pivot(curve, names).agg(F.sum(value)).fillna(0)


def top_k_series_inner(df: DataFrame, snapshot: str, keys: list[str], metric: str,
                       k: int = 10) -> DataFrame:
    """Samples of the ``k`` keys with the largest per-snapshot total.

    Pre-aggregate per (snapshot, key), take the max over snapshots per key,
    keep the top k, and semi-join the original rows back.  The kept key set
    has at most k rows, so it is broadcast.
    """
    per_snap = df.groupBy(snapshot, *keys).agg(F.sum(metric).alias("_snap_total"))
    top = (per_snap.groupBy(*keys).agg(F.max("_snap_total").alias("_peak"))
           .orderBy(F.desc("_peak"), *[F.asc(c) for c in keys]).limit(k))
    return df.join(F.broadcast(top.select(*keys)), on=keys, how="left_semi")
