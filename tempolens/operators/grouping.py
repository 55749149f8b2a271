"""Grouping, pivot, ranking and comparison operators.

A16 group_filter, A17 drilldown, A20 pivot_stats, A21 conditional_pivot,
A22 pct_of_column_sum, A24 top_sort, A25 period_compare, A26 snapshot_diff,
A40 keyed_full_outer, A41 rollup_total, A42 top_x_by_group_counts,
A43 distinct_counts_by_group, A45 outlier_vs_average, A46 change_detection,
A47 prefix_similarity, A51 hist_level_stats, A52 growth.

Every aggregation is a plain ``groupBy().agg()``: Spark combines partial
aggregates map-side, so hot groups are reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import first_value_by, last_value_by, single_or_count
from ..functions._util import as_col

# A registry maps a dimension name to a Column (or a column name).  An entry
# may also be a callable value -> Column for ready-made conditions.
Registry = Mapping[str, "Column | str | Callable[[object], Column]"]


def _expr(registry: Registry, name: str) -> Column:
    e = registry[name]
    if callable(e) and not isinstance(e, Column):
        raise TypeError(f"{name} is a condition, not a dimension")
    return as_col(e)


def group_filter(filters: Mapping[str, object], registry: Registry) -> Column:
    """Conjunction of the drill-down filters.

    A value of None or '' means IS NULL (the reference carries the NULL
    group of a drill-down as an empty value).  Callable registry entries
    build their own condition from the value.  Unknown keys raise.
    """
    preds = []
    for k, v in filters.items():
        if k not in registry:
            raise KeyError(f"unknown filter dimension {k!r}")
        e = registry[k]
        if callable(e) and not isinstance(e, Column):
            preds.append(e(v))
        elif v is None or v == "":
            preds.append(as_col(e).isNull())
        else:
            preds.append(as_col(e) == F.lit(v))
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def value_cells(df: DataFrame, by: Mapping[str, Column], dims: Mapping[str, Column], null_counts: bool = False,
                null_text: str = " ") -> DataFrame:
    """One row per group, dimension and distinct value: (by..., _dim, _value, _shown).

    Every row becomes one narrow (dimension number, value) row per dimension, which
    the map side combines before the shuffle, so what is shuffled are distinct
    values, not rows.  NULL counts as ``null_text`` with null_counts, else not at
    all; ``_shown`` is the value, NULL if only NULL stood for it.
    """
    parts = [F.struct(F.lit(i).alias("_dim"), c.cast("string").alias("_v")) for i, c in enumerate(dims.values())]
    e = df.select(*[c.alias(f"_by_{n}") for n, c in by.items()], F.explode(F.array(*parts)).alias("_c"))
    e = e.select(*[f"_by_{n}" for n in by], "_c._dim", "_c._v")
    e = e.withColumn("_value", F.coalesce("_v", F.lit(null_text))) if null_counts else e.filter(F.col("_v").isNotNull()).withColumn("_value", F.col("_v"))
    cells = e.groupBy(*[f"_by_{n}" for n in by], "_dim", "_value").agg(F.max(F.col("_v").isNotNull()).alias("_real"))
    return cells.select(*[F.col(f"_by_{n}").alias(n) for n in by], "_dim", "_value", F.when(F.col("_real"), F.col("_value")).alias("_shown"))


def _dims_per_group(df: DataFrame, by: Mapping[str, Column], dims: Mapping[str, Column], measures: Mapping[str, Column],
                    show: Callable[[Column, Column], Column], null_counts: bool) -> DataFrame:
    """Measures per group, and for every dimension show(number of distinct values, smallest value).

    Measures and values are aggregated apart (two reads, neither widens the rows of
    the other) and meet in one aggregate over the groups, so a NULL group needs no
    null-safe join.
    """
    m = df.groupBy(*[c.alias(n) for n, c in by.items()]).agg(*[c.alias(f"_m_{n}") for n, c in measures.items()], F.lit(True).alias("_here"))
    n = (value_cells(df, by, dims, null_counts).groupBy(*by, "_dim")
         .agg(F.count(F.lit(1)).alias("_n"), F.min("_shown").alias("_min")))
    both = m.unionByName(n, allowMissingColumns=True)
    at = lambda i, c: F.max(F.when(F.col("_dim") == i, F.col(c)))
    g = both.groupBy(*by).agg(
        *[F.first(F.when(F.col("_here"), F.col(f"_m_{k}")), ignorenulls=True).alias(f"_m_{k}") for k in measures],
        *[F.coalesce(at(i, "_n"), F.lit(0)).alias(f"_n_{i}") for i in range(len(dims))],
        *[at(i, "_min").alias(f"_v_{i}") for i in range(len(dims))])
    return g.select(*by, *[F.col(f"_m_{k}").alias(k) for k in measures],
                    *[show(F.col(f"_n_{i}"), F.col(f"_v_{i}")).alias(d) for i, d in enumerate(dims)])


def value_or_counts(df: DataFrame, by: Mapping[str, Column], dims: Mapping[str, Column], measures: Mapping[str, Column] | None = None,
                    null_counts: bool = True) -> DataFrame:
    """Groups with their measures and every dimension as its one value or '< n >', exactly and without an Expand."""
    show = lambda n, v: F.when(n == 1, v).otherwise(F.concat(F.lit("< "), n.cast("string"), F.lit(" >")))
    return _dims_per_group(df, by, dims, measures or {}, show, null_counts)


def drilldown(df: DataFrame, registry: Registry, by: str, filters: Mapping[str, object] | None = None,
              measures: Mapping[str, Column] | None = None, others: list[str] | None = None,
              null_counts: bool = True, approx: bool = False) -> DataFrame:
    """Group by one dimension; every other dimension shown as value or '< n >' (A17).

    Values are counted by ``value_or_counts``.  approx=True shows the number of
    values as a HyperLogLog++ estimate in the same aggregate as the measures.
    """
    f = df.filter(group_filter(filters or {}, registry)) if filters else df
    dims = [d for d in (others if others is not None else registry)
            if d != by and not (callable(registry[d]) and not isinstance(registry[d], Column))]
    ms = measures or {"count_samples": F.count(F.lit(1))}
    if dims and not approx:
        return value_or_counts(f, {by: _expr(registry, by)}, {d: _expr(registry, d) for d in dims}, ms, null_counts)
    aggs = [m.alias(n) for n, m in ms.items()]
    aggs += [single_or_count(_expr(registry, d), null_counts=null_counts, approx=approx).alias(d) for d in dims]
    return f.groupBy(_expr(registry, by).alias(by)).agg(*aggs)


def pivot_stats(df: DataFrame, ts, name: str, value: str, values: list, keep_zero: bool = False,
                row_total: bool = False, alias: Callable[[object], str] = str) -> DataFrame:
    """EAV rows (ts, name, value) to one column per name.

    ``values`` is the list of names (from the name dimension), so no extra
    pass discovers them.  Zero cells become NULL unless ``keep_zero``.
    """
    keys = [ts] if isinstance(ts, str) else list(ts)
    v = F.col(value) if keep_zero else F.when(F.col(value) != 0, F.col(value))
    cols = [F.sum(F.when(F.col(name) == F.lit(n), v)).alias(alias(n)) for n in values]
    out = df.groupBy(*keys).agg(*cols)
    if row_total:
        out = out.withColumn("row_total", reduce(lambda a, b: a + b,
                                                 [F.coalesce(F.col(alias(n)), F.lit(0)) for n in values]))
    return out


def conditional_pivot(df: DataFrame, keys, code_col: str, mapping: Mapping[object, str],
                      counter: str) -> DataFrame:
    """Fixed pivot SUM(DECODE(code, k, counter, 0)) per key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = [F.sum(F.when(F.col(code_col) == F.lit(k), F.col(counter)).otherwise(F.lit(0))).alias(n)
            for k, n in mapping.items()]
    return df.groupBy(*keys).agg(*cols)


def pct_of_column_sum(df: DataFrame, col: str, out: str | None = None, scale: int | None = 4) -> DataFrame:
    """Each row's share of the column total in percent.

    The total is a scalar subquery: Spark runs the one-row aggregate once
    and uses the value as a literal, instead of a window over all rows in
    one partition.
    """
    total = df.select(F.sum(col)).scalar()
    share = F.try_divide(F.col(col) * F.lit(100.0), total)
    return df.withColumn(out or f"{col}_pct", F.round(share, scale) if scale is not None else share)


def top_sort(df: DataFrame, modes: Mapping[str, Column], mode: str, n: int, tiebreak: list[str]) -> DataFrame:
    """Top-n rows by a named sort mode.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: a per-partition
    top-n followed by one small merge, no global sort.  Ties are broken by
    ``tiebreak`` so the chosen rows are deterministic.
    """
    if mode not in modes:
        raise KeyError(f"unknown sort mode {mode!r}; known: {sorted(modes)}")
    return df.orderBy(modes[mode].desc_nulls_last(), *[F.asc(c) for c in tiebreak]).limit(n)


def period_compare(df: DataFrame, keys: list[str], first: Column, second: Column,
                   executions: str, elapsed: str, rows: str | None = None,
                   plan: str | None = None, instance: str | None = None,
                   min_pct: float = 0.0) -> DataFrame:
    """Keys whose elapsed time per execution grew from period 1 to 2 by > min_pct %.

    Both periods are aggregated in a single pass with conditional
    aggregates (one shuffle instead of two aggregates and a join).
    """
    def side(pred: Column, sfx: str) -> list[Column]:
        out = [F.sum(F.when(pred, F.col(executions))).alias(f"executions_{sfx}"),
               F.sum(F.when(pred, F.col(elapsed))).alias(f"elapsed_time_{sfx}")]
        if rows:
            out.append(F.sum(F.when(pred, F.col(rows))).alias(f"rows_processed_{sfx}"))
        if plan:
            out.append(F.max(F.when(pred, F.col(plan))).alias(f"_max_plan_{sfx}"))
            out.append(F.count_distinct(F.when(pred & (F.col(plan) != 0), F.col(plan))).alias(f"_plans_{sfx}"))
        if instance:
            out.append(F.count_distinct(F.when(pred, F.col(instance))).alias(f"instance_count_{sfx}"))
        return out

    g = df.filter(first | second).groupBy(*keys).agg(*side(first, "t1"), *side(second, "t2"))
    g = g.filter((F.col("executions_t1") > 0) & (F.col("executions_t2") > 0))
    e1 = F.col("elapsed_time_t1") / F.col("executions_t1")
    e2 = F.col("elapsed_time_t2") / F.col("executions_t2")
    g = g.filter(e2 > e1 * F.lit((100.0 + min_pct) / 100.0))
    g = g.withColumn("elapsed_per_exec_t1", F.round(e1, 6)).withColumn("elapsed_per_exec_t2", F.round(e2, 6)) \
         .withColumn("weighted_growth", F.round((e2 - e1) * F.col("executions_t2"), 4))
    if plan:
        same = (F.col("_max_plan_t1") == F.col("_max_plan_t2")) & (F.col("_plans_t1") != 0) & (F.col("_plans_t2") != 0)
        g = g.withColumn("execution_plan_count",
                         F.col("_plans_t1") + F.col("_plans_t2") - F.when(same, 1).otherwise(0)) \
             .drop("_max_plan_t1", "_max_plan_t2", "_plans_t1", "_plans_t2")
    return g


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], counters: list[str],
                  only_changed: bool = False) -> DataFrame:
    """Two samples of the same view matched on null-safe keys: delta and total.

    Keys present in one sample only are dropped (inner match), as in the
    reference's sorted merge.
    """
    b, a = before.alias("_b"), after.alias("_a")
    cond = [F.col(f"_b.{k}").eqNullSafe(F.col(f"_a.{k}")) for k in keys]
    out = b.join(a, cond, "inner").select(
        *[F.col(f"_a.{k}").alias(k) for k in keys],
        *[(F.col(f"_a.{c}") - F.col(f"_b.{c}")).alias(f"{c}_delta") for c in counters],
        *[F.col(f"_a.{c}").alias(f"{c}_total") for c in counters])
    if only_changed:
        out = out.filter(reduce(lambda x, y: x | y, [F.col(f"{c}_delta") != 0 for c in counters]))
    return out


def keyed_full_outer(a: DataFrame, b: DataFrame, keys: list[str], fill: Mapping[str, object] | None = None) -> DataFrame:
    """Full outer join on keys with the keys coalesced from both sides."""
    out = a.join(b, keys, "full")
    return out.fillna(dict(fill)) if fill else out


def rollup_total(df: DataFrame, by: list[str], measures: Mapping[str, Column], total_label: str = "TOTAL") -> DataFrame:
    """Subtotals per prefix of ``by`` plus a grand total row.

    ``rollup`` runs as one Expand + aggregate.  Rolled-up key columns carry
    ``total_label``; ``level`` is the number of rolled-up keys.
    """
    aggs = [m.alias(n) for n, m in measures.items()]
    out = df.rollup(*by).agg(*aggs, F.grouping_id().alias("_gid"))
    for i, c in enumerate(by):
        bit = 1 << (len(by) - 1 - i)
        out = out.withColumn(c, F.when((F.col("_gid").bitwiseAND(F.lit(bit))) != 0, F.lit(total_label))
                             .otherwise(F.col(c).cast("string")))
    return out.withColumn("level", F.bit_count(F.col("_gid")).cast("int")).drop("_gid")


def top_values(df: DataFrame, col: str, x: int) -> Column:
    """Array (scalar subquery) of the x most frequent values of ``col``, ties by value."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.desc("_n"), F.asc(col)).limit(x).select(F.collect_list(col)).scalar())


def top_x_by_group_counts(df: DataFrame, period: Column, cols: list[str], x: int = 5,
                          others: str = "<others>") -> DataFrame:
    """Per period, counts of the globally most frequent x values of each column.

    Long form (column_name, period, value, n).  Each column is read once:
    counts per (period, value) are aggregated from the data (map-side
    partial aggregation); the global top x values (at most x, ties by value)
    come from those counts as an array-valued scalar subquery, and the
    remaining values are folded into ``others`` by re-aggregating the small
    count table.  Nothing per period is collected into one task.
    """
    out = None
    for c in cols:
        cells = (df.select(period.alias("period"), F.col(c).alias("_v"))
                 .groupBy("period", "_v").agg(F.count(F.lit(1)).alias("_n")))
        top = (cells.filter(F.col("_v").isNotNull()).groupBy("_v").agg(F.sum("_n").alias("_t"))
               .orderBy(F.desc("_t"), F.asc("_v")).limit(x).select(F.collect_list("_v")).scalar())
        v = F.when(F.array_contains(top, F.col("_v")), F.col("_v").cast("string")).otherwise(F.lit(others))
        g = (cells.groupBy("period", v.alias("value")).agg(F.sum("_n").alias("n"))
             .select(F.lit(c).alias("column_name"), "period", "value", "n"))
        out = g if out is None else out.unionByName(g)
    return out


def distinct_counts_by_group(df: DataFrame, by, cols: list[str], approx: bool = False,
                             rsd: float = 0.02) -> DataFrame:
    """Requests and number of distinct values of several fields per group.

    Distinct values are counted by ``value_cells`` (a hot group is split by its
    values); with ``approx`` HyperLogLog++ sketches merge map-side instead.
    """
    by = [by] if isinstance(by, (str, Column)) else list(by)
    requests = F.count(F.lit(1)).alias("requests")
    if approx or not all(isinstance(b, str) for b in by):
        fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
        return df.groupBy(*by).agg(requests, *[fn(F.col(c)).alias(f"distinct_{c}") for c in cols])
    return _dims_per_group(df, {b: F.col(b) for b in by}, {f"distinct_{c}": F.col(c) for c in cols}, {"requests": F.count(F.lit(1))},
                           lambda n, v: n, null_counts=False)


def outlier_vs_average(per_period: DataFrame, key: str, period: str, value: str,
                       first: str | None = None, last: str | None = None) -> DataFrame:
    """Per key: total, avg, min and max of a per-period value with the periods of min and max."""
    aggs = [F.sum(value).alias("value_total"), F.round(F.avg(value), 0).alias("value_avg"),
            F.min(value).alias("value_min"), first_value_by(period, value).alias("period_of_min"),
            F.max(value).alias("value_max"), last_value_by(period, value).alias("period_of_max"),
            F.round(F.max(value) - F.avg(value), 4).alias("max_minus_avg")]
    if first:
        aggs.append(F.min(first).alias("first_occurrence"))
    if last:
        aggs.append(F.max(last).alias("last_occurrence"))
    return per_period.groupBy(key).agg(*aggs)


def change_detection(variants: DataFrame, keys: list[str], order: str, metrics: list[str],
                     first_col: str = "first_occurrence", last_col: str = "last_occurrence") -> DataFrame:
    """Keys with more than one variant; metrics of the first and of the last variant.

    ``variants`` has one row per (key, variant).  First = MIN(x) KEEP FIRST
    by ``order``, last = MAX(x) KEEP LAST, both as struct aggregates.
    """
    aggs = [F.count(F.lit(1)).alias("variant_count")]
    for m in metrics:
        aggs += [first_value_by(m, order).alias(f"{m}_first"), last_value_by(m, order).alias(f"{m}_last")]
    aggs += [F.min(first_col).alias("first_occurrence_key"), F.max(last_col).alias("last_occurrence_key"),
             F.min(last_col).alias("last_occurrence_first_variant"),
             F.max(first_col).alias("first_occurrence_last_variant")]
    return variants.groupBy(*keys).agg(*aggs).filter(F.col("variant_count") > 1)


def prefix_similarity(df: DataFrame, text: str, n: int, min_count: int, id_col: str,
                      measures: Mapping[str, Column] | None = None) -> DataFrame:
    """Group texts by their first n characters; groups with >= min_count members.

    One example per group is the text of the smallest id, carried by a
    ``min(struct(id, text))`` aggregate (no join back).
    """
    aggs = [F.count(F.lit(1)).alias("variations"),
            F.min(F.struct(F.col(id_col).alias("_id"), F.col(text).alias("_t"))).alias("_ex")]
    aggs += [m.alias(k) for k, m in (measures or {}).items()]
    g = df.groupBy(F.substring(text, 1, n).alias("prefix")).agg(*aggs)
    return (g.filter(F.col("variations") >= min_count)
            .select("prefix", "variations", *(measures or {}).keys(),
                    F.col("_ex._id").alias(f"example_{id_col}")))


def hist_level_stats(df: DataFrame, group: list[str], inner: list[str], value: str) -> DataFrame:
    """Aggregate inside each snapshot first, then avg/min/max/sum over snapshots."""
    per = df.groupBy(*group, *inner).agg(F.sum(value).alias("_v"))
    return per.groupBy(*group).agg(F.count(F.lit(1)).alias("snapshots"), F.sum("_v").alias("value_sum"),
                                   F.round(F.avg("_v"), 4).alias("value_avg"),
                                   F.min("_v").alias("value_min"), F.max("_v").alias("value_max"))


def growth(df: DataFrame, keys: list[str], order: str, size: str, only_changed: bool = True) -> DataFrame:
    """First and last size per key, absolute and percent growth."""
    g = df.groupBy(*keys).agg(first_value_by(size, order).alias("size_first"),
                              last_value_by(size, order).alias("size_last"),
                              F.min(order).alias(f"first_{order}"), F.max(order).alias(f"last_{order}"))
    g = g.withColumn("growth_abs", F.col("size_last") - F.col("size_first")) \
         .withColumn("growth_pct", F.round(F.try_divide((F.col("size_last") - F.col("size_first")) * F.lit(100.0),
                                                          F.col("size_first")), 4))
    return g.filter(F.col("size_last") != F.col("size_first")) if only_changed else g
