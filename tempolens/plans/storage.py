"""Storage, catalog and audit reports (F01-F12), SURVEY 2.F."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contains_ci, single_or_count, trunc_time
from ..operators.grouping import growth, hist_level_stats, pivot_stats, rollup_total, top_x_by_group_counts
from ..operators.series import top_k_series_inner, top_x_series

MB = 1048576.0


def tablespace_usage(tablespaces: DataFrame, data_files: DataFrame, free: DataFrame, temp_files: DataFrame,
                     sort_usage: DataFrame, redo: DataFrame | None = None) -> DataFrame:
    """Size, free and used MB per tablespace over permanent and temporary tablespaces, and redo logs.

    Permanent: data files minus free extents.  Temporary: temp files minus
    the blocks used by sort segments.  Autoextensible is shown through
    A06 with 'Partial' when the files disagree.  Redo: one row per instance,
    all members of its log groups, fully used.
    """
    f = data_files.groupBy("tablespace_name").agg(F.sum("bytes").alias("_bytes"),
                                                  single_or_count("autoextensible", else_="Partial").alias("autoextensible"))
    fr = free.groupBy("tablespace_name").agg(F.sum("bytes").alias("_free"))
    perm = (tablespaces.filter(F.col("contents") != "TEMPORARY").join(fr, "tablespace_name", "left")
            .join(f, "tablespace_name", "left")
            .select("tablespace_name", "contents", "block_size",
                    F.round(F.col("_bytes") / MB, 4).alias("mb_total"),
                    F.round(F.coalesce(F.col("_free"), F.lit(0)) / MB, 4).alias("mb_free"),
                    F.round((F.col("_bytes") - F.coalesce(F.col("_free"), F.lit(0))) / MB, 4).alias("mb_used"),
                    "autoextensible"))
    tf = temp_files.groupBy("tablespace_name").agg(F.sum("bytes").alias("_bytes"),
                                                   single_or_count("autoextensible", else_="Partial").alias("autoextensible"))
    su = sort_usage.groupBy("tablespace_name").agg(F.sum("used_blocks").alias("_used"))
    t = tablespaces.filter(F.col("contents") == "TEMPORARY").join(tf, "tablespace_name", "left").join(su, "tablespace_name", "left")
    used = F.coalesce(F.col("_used"), F.lit(0)) * F.col("block_size") / MB
    total = F.coalesce(F.col("_bytes"), F.lit(0)) / MB
    temp = t.select("tablespace_name", "contents", "block_size", F.round(total, 4).alias("mb_total"),
                    F.round(total - used, 4).alias("mb_free"), F.round(used, 4).alias("mb_used"), "autoextensible")
    out = perm.unionByName(temp)
    if redo is not None:
        size = F.round(F.sum(F.col("bytes") * F.col("members")) / MB, 4)
        out = out.unionByName(redo.groupBy("inst_id").agg(F.min("block_size").alias("block_size"), size.alias("mb_total")).select(
            F.concat(F.lit("Redo Inst="), F.col("inst_id").cast("string")).alias("tablespace_name"), F.lit("Redo-Logfile").alias("contents"),
            F.col("block_size").cast(out.schema["block_size"].dataType), "mb_total", F.lit(0.0).alias("mb_free"), F.col("mb_total").alias("mb_used"),
            F.lit(None).cast("string").alias("autoextensible")))
    return out.withColumn("pct_used", F.round(F.try_divide(F.col("mb_used") * 100.0, F.col("mb_total")), 4))


def tablespace_totals(usage: DataFrame) -> DataFrame:
    """Totals per contents type and overall (F01 totals, A41)."""
    return rollup_total(usage, ["contents"], {"mb_total": F.round(F.sum("mb_total"), 4),
                                              "mb_free": F.round(F.sum("mb_free"), 4),
                                              "mb_used": F.round(F.sum("mb_used"), 4)})


def size_by_schema_and_type(segments: DataFrame, type_map: dict[str, str] | None = None, min_mb: float = 1.0,
                            owner: str = "owner", seg_type: str = "object_type", size: str = "bytes") -> DataFrame:
    """MB per schema and segment type (partition types folded to their base type), above ``min_mb``."""
    t = F.col(seg_type)
    for k, v in (type_map or {}).items():
        t = F.when(F.col(seg_type) == k, F.lit(v)).otherwise(t)
    g = segments.groupBy(F.col(owner).alias("owner"), t.alias("segment_type")).agg(
        F.round(F.sum(size) / MB, 4).alias("mbytes"), F.count(F.lit(1)).alias("segments"))
    return g.filter(F.col("mbytes") > min_mb)


def datafile_usage(data_files: DataFrame, temp_files: DataFrame, io: DataFrame, key: str = "file_id") -> DataFrame:
    """Data and temp files with their IO counts."""
    files = data_files.withColumn("file_type", F.lit("DATA")).unionByName(temp_files.withColumn("file_type", F.lit("TEMP")))
    io_agg = io.groupBy(key).agg(F.count(F.lit(1)).alias("io_requests"))
    return files.join(io_agg, key, "left")


def undo_usage(extents: DataFrame, by: list[str], status: str = "status", size: str = "bytes") -> DataFrame:
    """Undo MB split by extent state (active / unexpired / expired) per tablespace or segment."""
    def mb(state):
        return F.round(F.sum(F.when(F.col(status) == state, F.col(size)).otherwise(0)) / MB, 4)
    return extents.groupBy(*by).agg(F.round(F.sum(size) / MB, 4).alias("mb_total"), mb("ACTIVE").alias("mb_active"),
                                    mb("UNEXPIRED").alias("mb_unexpired"), mb("EXPIRED").alias("mb_expired"))


def mview_overview(mviews: DataFrame, logs: DataFrame, registered: DataFrame, keys=("owner", "name")) -> DataFrame:
    """Materialized views with their log and registration counts, pre-aggregated before the joins."""
    k = list(keys)
    lg = logs.groupBy(*k).agg(F.count(F.lit(1)).alias("logs"))
    rg = registered.groupBy(*k).agg(F.count(F.lit(1)).alias("registrations"))
    return mviews.join(lg, k, "left").join(rg, k, "left").fillna(0, ["logs", "registrations"])


def objects_by_size(segments: DataFrame, objects: DataFrame, keys=("owner", "object_name")) -> DataFrame:
    """Objects by size with partition roll-up, rows and estimated row length."""
    k = list(keys)
    seg = segments.groupBy(*k).agg(F.count(F.lit(1)).alias("partitions"), F.sum("bytes").alias("bytes"))
    obj = objects.groupBy(*k).agg(F.max("num_rows").alias("num_rows"), single_or_count("object_type", else_="N/A").alias("object_type"))
    out = seg.join(obj, k, "left")
    return out.withColumn("mbytes", F.round(F.col("bytes") / MB, 4)) \
              .withColumn("avg_row_len", F.round(F.try_divide(F.col("bytes"), F.col("num_rows")), 2))


def index_column_lists(ind_columns: DataFrame, by: list[str], col: str = "column_name", pos: str | None = None,
                       sep: str = ", ") -> DataFrame:
    """Ordered column list per index / constraint (F07): sort_array of (position, name) structs, then join."""
    order = F.col(pos) if pos else F.col(col)
    g = ind_columns.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order.alias("_o"), F.col(col).alias("_c")))).alias("_l"),
                                     F.count(F.lit(1)).alias("columns"))
    return g.select(*by, F.array_join(F.transform("_l", lambda s: s["_c"]), sep).alias("column_list"), "columns")


def references(constraints: DataFrame, columns: DataFrame, tables: DataFrame, table: str, owner: str, incoming: bool = False) -> DataFrame:
    """Foreign keys of a table, or (``incoming``) those of other tables that point at it, with their columns side by side.

    Composite keys: both constraints' columns are sorted structs of (position,
    name), aligned by position with a zip, so the pairs hold for any number of
    columns; a column without a partner shows an empty side.  Only the constraints
    of the asked table are joined, the lists come from one grouped pass.
    """
    mine = (F.col("owner") == owner) & (F.col("table_name") == table)
    fk = constraints.where(F.col("constraint_type") == "R").select("owner", "table_name", "constraint_name", "r_owner", "r_constraint_name")
    target = constraints.select(F.col("owner").alias("r_owner"), F.col("constraint_name").alias("r_constraint_name"), F.col("table_name").alias("r_table_name"))
    if incoming:
        j = fk.join(target.where((F.col("r_owner") == owner) & (F.col("r_table_name") == table)), ["r_owner", "r_constraint_name"])
    else:
        j = fk.where(mine).join(target, ["r_owner", "r_constraint_name"])
    used = j.select("owner", "constraint_name").unionByName(j.select(F.col("r_owner").alias("owner"), F.col("r_constraint_name").alias("constraint_name"))).distinct()
    lists = columns.join(used, ["owner", "constraint_name"], "left_semi").groupBy("owner", "constraint_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"]).alias("list"))
    left = lists.select("owner", "constraint_name", F.col("list").alias("_from"))
    right = lists.select(F.col("owner").alias("r_owner"), F.col("constraint_name").alias("r_constraint_name"), F.col("list").alias("_to"))
    rows = tables.select(F.col("owner").alias("_o"), F.col("table_name").alias("_t"), "num_rows")
    side = ("owner", "table_name") if incoming else ("r_owner", "r_table_name")
    pair = F.zip_with("_from", "_to", lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.lit(" = "), F.coalesce(b, F.lit(""))))
    return (j.join(left, ["owner", "constraint_name"], "left").join(right, ["r_owner", "r_constraint_name"], "left")
            .join(rows, (F.col(side[0]) == F.col("_o")) & (F.col(side[1]) == F.col("_t")))
            .select("owner", "table_name", "constraint_name", "r_owner", "r_table_name", "r_constraint_name", "num_rows",
                    F.array_join("_from", ", ").alias("columns"), F.array_join("_to", ", ").alias("r_columns"), F.array_join(pair, ", ").alias("pairs")))


def table_indexes(indexes: DataFrame, ind_columns: DataFrame, expressions: DataFrame, partitions: DataFrame, usage: DataFrame, table: str, owner: str) -> DataFrame:
    """Indexes of a table with their columns or expressions in order, partition roll-up and usage flags.

    Of a partitioned index pct_free shows the one value of its partitions, else
    null, and the partition names '< n >' or the one there is.
    """
    ix = indexes.where((F.col("table_owner") == owner) & (F.col("table_name") == table))
    keys = ix.select(F.col("owner").alias("index_owner"), "index_name")
    exprs = expressions.select("index_owner", "index_name", F.lit(1).alias("column_position"), "column_expression")
    cols = (ind_columns.join(keys, ["index_owner", "index_name"], "left_semi").join(exprs, ["index_owner", "index_name", "column_position"], "left")
            .groupBy("index_owner", "index_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
                "column_position", F.coalesce("column_expression", "column_name").alias("c")))), lambda x: x["c"]), ", ").alias("column_names")))
    parts = partitions.join(keys, ["index_owner", "index_name"], "left_semi").groupBy("index_owner", "index_name").agg(
        F.count(F.lit(1)).alias("partitions"), F.when(F.min("pct_free") == F.max("pct_free"), F.min("pct_free")).alias("partition_pct_free"),
        F.when(F.min("partition_name") == F.max("partition_name"), F.min("partition_name")).otherwise(F.lit("N/A")).alias("partition_name"),
        F.sum("num_rows").alias("partition_rows"))
    use = usage.select(F.col("owner").alias("index_owner"), "index_name",
                       F.when(F.col("index_flags").bitwiseAND(65536) == 0, "NO").otherwise("YES").alias("monitoring"),
                       F.when(F.col("usage_flags").bitwiseAND(1) == 0, "NO").otherwise("YES").alias("used"))
    on = ["index_owner", "index_name"]
    return (ix.withColumnRenamed("owner", "index_owner").join(cols, on, "left").join(parts, on, "left").join(use, on, "left")
            .select(*on, "uniqueness", "num_rows", "distinct_keys", "partitioned", "column_names", "partitions", "partition_pct_free", "partition_name",
                    "partition_rows", "monitoring", "used"))


def audit_list(audit: DataFrame, filters: dict[str, object], time_col: str = "audit_time",
               start=None, end=None) -> DataFrame:
    """Audit records with optional filters: substring (case-insensitive) per column and a time range."""
    out = audit
    for c, v in filters.items():
        if v not in (None, ""):
            out = out.filter(contains_ci(c, str(v)))
    if start is not None:
        out = out.filter(F.col(time_col) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col(time_col) <= F.lit(end).cast("timestamp_ntz"))
    return out


def audit_by_period(audit: DataFrame, unit: str, cols: list[str], x: int = 5, time_col: str = "audit_time") -> DataFrame:
    """Audit counts per period for the top x values of each column."""
    return top_x_by_group_counts(audit, trunc_time(time_col, unit), cols, x)


def object_growth(sizes: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """Objects whose size changed between their first and last record (F11 detail, A52)."""
    return growth(sizes, keys, order, size)


def growth_timeline(sizes: DataFrame, ts: str, attribute: str, size: str, values: list) -> DataFrame:
    """Total size per time and attribute value, one column per value plus a row total (F11 timeline)."""
    return pivot_stats(sizes, ts, attribute, size, values, keep_zero=True, row_total=True,
                       alias=lambda v: f"size_{v}")


def cache_history_summary(cache: DataFrame, obj: list[str], snapshot: str, blocks: str) -> DataFrame:
    """Per object: blocks per snapshot first, then avg/min/max over snapshots (F12 summary, A51)."""
    return hist_level_stats(cache, obj, [snapshot], blocks)


CACHE_BLOCKS = ("blocks_total", "blocks_dirty")


def cache_history(cache: DataFrame, start, end, instance: int | None = None, partitions: bool = False, limit: int | None = None) -> DataFrame:
    """Cached blocks of each object over the snapshots of a time range.

    Blocks are summed per snapshot and object first (over its partitions, unless
    they are ``partitions`` of their own), then averaged; dirty blocks beside.
    ``limit`` keeps the objects with the most blocks (ties by instance and name).
    """
    rows = cache.where(F.col("snapshot_ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    if instance is not None:
        rows = rows.where(F.col("instance") == instance)
    if not partitions:
        rows = rows.withColumn("partition_name", F.lit(None).cast("string"))
    keys = ["instance", "owner", "name", "partition_name"]
    per = rows.groupBy("snapshot_ts", *keys).agg(*[F.sum(c).alias(c) for c in CACHE_BLOCKS])
    total, dirty = CACHE_BLOCKS
    g = per.groupBy(*keys).agg(
        F.round(F.avg(total), 6).alias("avg_blocks_total"), F.min(total).alias("min_blocks_total"), F.max(total).alias("max_blocks_total"),
        F.sum(total).alias("sum_blocks_total"), F.round(F.avg(dirty), 6).alias("avg_blocks_dirty"), F.min(dirty).alias("min_blocks_dirty"),
        F.max(dirty).alias("max_blocks_dirty"), F.count(F.lit(1)).alias("samples"))
    return g if limit is None else g.orderBy(F.desc("sum_blocks_total"), *keys).limit(limit)


def cache_history_detail(cache: DataFrame, start, end, owner: str, name: str, instance: int, partition: str | None = None) -> DataFrame:
    """Cached blocks of one object (or one of its partitions) by snapshot."""
    rows = cache.where(F.col("snapshot_ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
                       & (F.col("owner") == owner) & (F.col("name") == name) & (F.col("instance") == instance))
    if partition is not None:
        rows = rows.where(F.col("partition_name") == partition)
    return rows.groupBy("snapshot_ts").agg(*[F.sum(c).alias(c) for c in CACHE_BLOCKS])


def cache_snapshot(cache: DataFrame, snapshot, instance: int, partitions: bool = False) -> DataFrame:
    """Cached blocks of all objects in one snapshot (a time or a scalar subquery) of one instance."""
    at = snapshot if isinstance(snapshot, Column) else F.lit(snapshot).cast("timestamp_ntz")
    rows = cache.where((F.col("snapshot_ts") == at) & (F.col("instance") == instance))
    if not partitions:
        rows = rows.withColumn("partition_name", F.lit(None).cast("string"))
    return rows.groupBy("owner", "name", "partition_name").agg(*[F.sum(c).alias(c) for c in CACHE_BLOCKS])


def cache_top_timeline(cache: DataFrame, snapshot: str, obj: str, blocks: str, k: int = 10) -> DataFrame:
    """Top-k objects by peak blocks, as a zero-filled time series (F12 timeline, A19 + A18)."""
    top = top_k_series_inner(cache, snapshot, [obj], blocks, k)
    return top_x_series(top, snapshot, obj, blocks, k, scale=None)
