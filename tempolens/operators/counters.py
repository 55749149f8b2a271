"""Cumulative-counter operators.

Counters such as total waits grow monotonically per series and restart at
zero when the instance restarts.  A delta is the value minus the previous
value of the same series; the first row of a series gets its own value as
the default, so its delta is 0.

Scale: a plain ``lag`` window puts each series into one task, so one hot
series (a third of all rows) would be one task.  By default the lag runs
per (series, chunk), where the chunk is a coarse key monotone in ``order``
(ranges of snapshot ids or days); the first row of every chunk takes the
last row of the previous non-empty chunk, found by a second, small window
over one row per chunk.  Those last rows come from the windowed rows
themselves, so the facts are read and shuffled once.  NULL is a key and an
order like any other.  The result is identical to the single window (tested).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESETS = ("drop", "positive", "keep")


def _as_list(x):
    return [x] if isinstance(x, str) else list(x)


def _reset_filter(df: DataFrame, test: str, reset: str) -> DataFrame:
    if reset == "drop":        # first snapshot after a restart is negative: discard
        return df.filter(F.col(test) >= 0)
    if reset == "positive":    # only rows with a real increase
        return df.filter(F.col(test) > 0)
    if reset == "keep":
        return df
    raise ValueError(f"reset must be one of {RESETS}")


AUTO_CHUNK_WIDTH = 1024


def auto_chunk(df: DataFrame, order: str) -> Column | None:
    """Coarse key monotone in ``order``: ranges of 1024 for numeric orders, days for time orders.

    Other types have no such key; the caller passes ``chunk`` (None for one window per series).
    """
    t = df.schema[order].dataType.typeName()
    if t in ("integer", "long", "short", "byte", "double", "float") or t.startswith("decimal"):
        return F.floor(F.col(order) / F.lit(AUTO_CHUNK_WIDTH))
    if t.startswith("timestamp") or t == "date":
        return F.to_date(F.col(order))
    raise ValueError(f"no chunks for order column {order} of type {t}: pass chunk=<column> or chunk=None")


def counter_delta(df: DataFrame, keys, order: str, counters, reset: str = "drop",
                  test: str | None = None, chunk: "Column | str | None" = "auto",
                  suffix: str = "") -> DataFrame:
    """Replace each counter by its delta to the previous row of the series.

    keys: series key columns; order: ordering column (snapshot id);
    counters: counter columns; reset: 'drop' keeps rows whose ``test``
    delta is >= 0, 'positive' keeps > 0, 'keep' keeps all; test defaults to
    the first counter.  Output columns keep their names (plus ``suffix``).
    chunk: 'auto' (default) splits each series into coarse ranges of the
    order (see ``auto_chunk``); a Column gives the chunk key; None uses one
    window per series.
    """
    keys, counters = _as_list(keys), _as_list(counters)
    test = (test or counters[0]) + suffix
    if isinstance(chunk, str) and chunk == "auto":
        chunk = auto_chunk(df, order)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(order)
        out = df.select("*", *[(F.col(c) - F.lag(c, 1, None).over(w)).alias(f"__cd_d_{c}") for c in counters],
                        F.lag(F.lit(1)).over(w).isNull().alias("__cd_first"))
        deltas = [F.when(F.col("__cd_first"), F.col(c) - F.col(c))
                  .otherwise(F.col(f"__cd_d_{c}")).alias(c + suffix) for c in counters]
    else:
        dc = df.withColumn("__cd_chunk", chunk)
        w1 = Window.partitionBy(*keys, "__cd_chunk").orderBy(order)
        d = dc.select("*", *[F.lag(c).over(w1).alias(f"__cd_p_{c}") for c in counters],
                      F.lag(F.lit(1)).over(w1).isNull().alias("__cd_first"),
                      F.lead(F.lit(1)).over(w1).isNull().alias("__cd_end"))
        # the last row of each chunk, of the same shuffled rows, carried to the next chunk of the series
        last = d.filter("__cd_end").select(*keys, "__cd_chunk", F.struct(*[F.col(c) for c in counters]).alias("__cd_last"))
        w2 = Window.partitionBy(*keys).orderBy("__cd_chunk")
        carry = last.select(*[F.col(k).alias(f"__cd_k{i}") for i, k in enumerate(keys)], F.col("__cd_chunk").alias("__cd_c"),
                            F.lag("__cd_last").over(w2).alias("__cd_carry"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__cd_k{i}")) for i, k in enumerate(keys)],
                      F.col("__cd_chunk").eqNullSafe(F.col("__cd_c")))
        d = d.join(carry, same, "left")
        deltas = []
        for c in counters:
            prev = F.when(F.col("__cd_first"),
                          F.when(F.col("__cd_carry").isNull(), F.col(c)).otherwise(F.col("__cd_carry")[c])) \
                    .otherwise(F.col(f"__cd_p_{c}"))
            deltas.append((F.col(c) - prev).alias(c + suffix))
        out = d
    keep = [c for c in df.columns if c not in counters or suffix]
    res = out.select(*keep, *deltas)
    return _reset_filter(res, test, reset)


def drop_first_snapshot(df: DataFrame, by, order: str) -> DataFrame:
    """Remove the rows of the first snapshot per ``by`` (they have no predecessor).

    The per-group minimum is an aggregate (one row per group, broadcast by
    AQE when small) and the removal an anti join, so no window over the big
    table is needed.
    """
    by = _as_list(by)
    first = df.groupBy(*by).agg(F.min(order).alias("_first_order"))
    cond = [F.col(f"_a.{b}") == F.col(f"_f.{b}") for b in by] + \
           [F.col(f"_a.{order}") == F.col("_f._first_order")]
    return df.alias("_a").join(first.alias("_f"), cond, "left_anti")


def delta_in_range(fact: DataFrame, bounds: DataFrame, keys, order: str, counters,
                   by=("dbid", "instance_number"), reset: str = "drop",
                   chunk: "Column | str | None" = "auto") -> DataFrame:
    """Deltas of the snapshots inside [min_snap_id, max_snap_id] per instance.

    The predecessor of the first snapshot is read as well so that the first
    in-range snapshot gets a real delta, and removed again afterwards.
    """
    by = list(by)
    b = bounds.select(*by, "min_snap_id", "max_snap_id")
    rng = (fact.join(b, by, "inner")
           .filter((F.col(order) >= F.col("min_snap_id") - 1) & (F.col(order) <= F.col("max_snap_id"))))
    d = counter_delta(rng, keys, order, counters, reset=reset, chunk=chunk)
    return d.filter(F.col(order) >= F.col("min_snap_id")).drop("max_snap_id")


def first_last_delta(df: DataFrame, keys, order: str, counters, suffix: str = "") -> DataFrame:
    """Last value minus first value of each counter per group, no window.

    ``max(struct(order, c))`` / ``min(struct(order, c))`` are plain
    aggregates with map-side partial aggregation, so a hot group does not
    end up in one task.
    """
    keys, counters = _as_list(keys), _as_list(counters)
    firsts = F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in counters])).alias("_f")
    lasts = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in counters])).alias("_l")
    g = df.groupBy(*keys).agg(firsts, lasts, F.count(F.lit(1)).alias("_n"))
    return g.select(*keys, *[(F.col("_l")[c] - F.col("_f")[c]).alias(c + suffix) for c in counters],
                    F.col("_f._o").alias(f"first_{order}"), F.col("_l._o").alias(f"last_{order}"))


def sum_columns(cols) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols])
