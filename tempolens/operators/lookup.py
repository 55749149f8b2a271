"""Lookup operators (A35-A39): anti joins, enrichment, typed lookups, range lookups."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused_anti(objs: DataFrame, keys: list[str], *usage: DataFrame) -> DataFrame:
    """Objects with no match in any usage source.

    The usage keys of all sources are unioned and de-duplicated first, so
    the objects are anti-joined once (one shuffle) instead of once per source.
    """
    used = reduce(lambda a, b: a.unionByName(b), [u.select(*keys) for u in usage]).distinct()
    return objs.join(used, keys, "left_anti")


def enrich_lookup(df: DataFrame, dim: DataFrame, keys: list[str], cols: Mapping[str, Column]) -> DataFrame:
    """Correlated scalar lookups as one left join to a de-duplicated dimension.

    ``cols``: output name -> aggregate over the dimension rows of a key
    (e.g. ``F.max('num_rows')``), which also makes the lookup unique.
    """
    d = dim.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()])
    return df.join(d, keys, "left")


def typed_lookup(df: DataFrame, type_col: Column | str, dims: Mapping[str, tuple[DataFrame, list[str]]],
                 keys: list[str], value_cols: list[str]) -> DataFrame:
    """Choose the lookup table by object type with a single join.

    dims: kind -> (dimension DataFrame, its key columns in the order of
    ``keys``).  The dimensions are unioned into one table keyed by
    (kind, keys) and joined once, instead of one CASE + scalar subquery per
    type.  Like a scalar lookup it yields one value per key (the maximum
    when a dimension repeats a key).
    """
    parts = []
    for kind, (dim, dkeys) in dims.items():
        parts.append(dim.select(F.lit(kind).alias("_kind"), *[F.col(a).alias(k) for a, k in zip(dkeys, keys)],
                                *[F.col(v) for v in value_cols]))
    u = reduce(lambda a, b: a.unionByName(b), parts).groupBy("_kind", *keys) \
        .agg(*[F.max(v).alias(v) for v in value_cols])
    tc = F.col(type_col) if isinstance(type_col, str) else type_col
    return df.withColumn("_kind", tc).join(u, ["_kind", *keys], "left").drop("_kind")


def segment_base_id(name: Column | str) -> Column:
    """Numeric object id inside a LOB / LOB-index segment name, else NULL."""
    n = F.col(name) if isinstance(name, str) else name
    digits = F.when(n.like("SYS_LOB%"), F.substring(n, 8, 10)).when(n.like("SYS_IL%"), F.substring(n, 7, 10))
    return digits.try_cast("bigint")


def object_display_name(objs: DataFrame, names: DataFrame, name: str = "object_name", sub: str = "subobject_name",
                        id_col: str = "object_id", label: str = "display_name") -> DataFrame:
    """Display name of a segment: LOB segments show their table's name, partitions their suffix.

    The numeric id is cut out of the segment name and looked up with a
    left join against the object table (one row per id).
    """
    lk = names.select(F.col(id_col).alias("_base_id"), F.col(name).alias("_base_name"))
    o = objs.withColumn("_base_id", segment_base_id(name)).join(lk, "_base_id", "left")
    suffix = F.when(F.col("_base_id").isNotNull(), F.concat(F.lit(" ("), F.col("_base_name"), F.lit(")")))
    if sub in objs.columns:
        suffix = suffix.when(F.col(sub).isNotNull(), F.concat(F.lit(" ("), F.col(sub), F.lit(")")))
    return o.withColumn(label, F.concat(F.col(name), F.coalesce(suffix, F.lit("")))).drop("_base_id", "_base_name")


def resolve_by_range(points: DataFrame, ranges: DataFrame, eq: list[str], point: str, start: str,
                     length: str, bucket: int = 1024) -> DataFrame:
    """Point-in-interval lookup: ``start <= point <= start + length - 1`` with equal ``eq`` keys.

    A plain range join would compare every point with every interval of
    the key.  Intervals are put into buckets and joined on (eq keys, level,
    bucket): an equi join Spark can hash-partition, followed by the exact range
    test.  Bucket widths grow by 8 from level to level, and an interval goes to
    the first level whose buckets are as wide as itself, so it covers two of
    them at most, however long it is.  A point looks into one bucket of every
    level that has intervals (a small scalar subquery), so no pair is produced
    twice.
    """
    def width(level):
        return F.lit(bucket) * F.pow(F.lit(8.0), level)

    level = F.greatest(F.lit(0), F.ceil(F.log(F.col(length) / F.lit(float(bucket))) / F.log(F.lit(8.0)) - 1e-9)).cast("int")
    r = ranges.filter(F.col(length) > 0).withColumn("_end", F.col(start) + F.col(length) - 1).withColumn("_level", level)
    levels = r.select(F.collect_set("_level")).scalar()
    r = r.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width(F.col("_level"))), F.floor(F.col("_end") / width(F.col("_level"))))))
    p = points.withColumn("_level", F.explode(levels)).withColumn("_bucket", F.floor(F.col(point) / width(F.col("_level"))))
    p, r = p.alias("_p"), r.alias("_r")
    cond = [F.col(f"_p.{k}") == F.col(f"_r.{k}") for k in (*eq, "_level", "_bucket")] + [
        F.col(f"_p.{point}") >= F.col(f"_r.{start}"), F.col(f"_p.{point}") <= F.col("_r._end")]
    out = p.join(r, cond, "inner")
    keep = [F.col(f"_p.{c}") for c in points.columns] + [F.col(f"_r.{c}") for c in ranges.columns if c not in eq and c not in points.columns]
    return out.select(*keep)
