"""Hierarchy operators: CONNECT BY walks and plan trees.

``hierarchy_walk`` replaces ``CONNECT BY NOCYCLE PRIOR``: a frontier of
rows is joined with all rows level by level.  Each level is written to the
shared checkpoint folder (``spark.checkpoint.dir``), so the lineage stays
one level deep and a lost executor only recomputes one join; the loop
stops on an empty frontier; a walk that goes on below a given ``max_depth``
is an error, never a shorter result.  A path array of node keys
carries the NOCYCLE rule: a child already on its path is not entered.
The frontier join is an equi join on the connect keys, so Spark/AQE
broadcast a small frontier or split a hot key with skew-join handling.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import single_or_count
from ..session import checkpoint_dir


def _node(prefix: str, cols: list[str]) -> Column:
    if len(cols) == 1:
        return F.col(f"{prefix}.{cols[0]}")
    return F.struct(*[F.col(f"{prefix}.{c}").alias(c) for c in cols])


ROWS_PER_PARTITION = 1_000_000


def _materialize(df: DataFrame) -> tuple[DataFrame, int]:
    """Reliable checkpoint computed once; returns the checkpointed level and its row count.

    The level is cached and counted, narrowed (coalesce, no shuffle) to about
    one partition per million rows, written to the checkpoint folder from
    the cache, and the cache is released.  The count doubles as the
    emptiness test of the walk.
    """
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    n = cached.count()
    if n == 0:
        cached.unpersist()
        return cached, 0
    parts = max(1, min(cached.rdd.getNumPartitions(), -(-n // ROWS_PER_PARTITION)))
    out = cached.coalesce(parts).checkpoint(eager=True)
    cached.unpersist()
    return out, n


def hierarchy_walk(rows: DataFrame, connect: list[tuple[str, str]], same: list[str] = (),
                   start: "Column | DataFrame | None" = None, node: list[str] | None = None,
                   root_cols: list[str] = (), max_depth: int | None = None,
                   level_col: str = "level", path_col: str = "path",
                   expand_if: Column | None = None) -> DataFrame:
    """All rows reachable from the start rows with level, root columns and path.

    connect: pairs (prior_col, col): row c is a child of row p when
      c[col] == p[prior_col] for every pair and c[s] == p[s] for s in same.
    start: START WITH predicate or DataFrame of start rows; None means every row is a root.
    node: columns that identify a node on the path (default the prior cols).
    root_cols: columns of the root row carried as root_<col> (CONNECT_BY_ROOT).
    expand_if: condition on a row for its children to be visited
      (CONNECT BY ... AND PRIOR <condition>).
    max_depth: None (the path keeps cycles out, so a walk ends by itself), or
      a level below which rows are an error.

    Every level is computed once (persisted while it is written) and cut
    from its lineage by a reliable checkpoint in the shared checkpoint
    folder; the emptiness test then reads the written level.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    node = list(node or [p for p, _ in connect])
    same = list(same)
    base = rows.persist(StorageLevel.MEMORY_AND_DISK)
    cols = base.columns
    if isinstance(start, DataFrame):
        roots = start.select(*cols)
    else:
        roots = base.filter(start) if start is not None else base
    frontier, _ = _materialize(roots.alias("r").select(
        *[F.col(f"r.{c}") for c in cols], *[F.col(f"r.{c}").alias(f"root_{c}") for c in root_cols],
        F.lit(1).alias(level_col), F.array(_node("r", node)).alias(path_col)))
    parts = [frontier]
    level = 1
    while True:
        parents = frontier.filter(expand_if) if expand_if is not None else frontier
        p, c = parents.alias("p"), base.alias("c")
        cond = [F.col(f"c.{col}") == F.col(f"p.{prior}") for prior, col in connect] + \
               [F.col(f"c.{s}") == F.col(f"p.{s}") for s in same]
        nxt, n = _materialize(p.join(c, cond, "inner")
                           .filter(~F.array_contains(F.col(f"p.{path_col}"), _node("c", node)))
                           .select(*[F.col(f"c.{x}") for x in cols], *[F.col(f"p.root_{x}") for x in root_cols],
                                   (F.col(f"p.{level_col}") + 1).alias(level_col),
                                   F.concat(F.col(f"p.{path_col}"), F.array(_node("c", node))).alias(path_col)))
        if n == 0:
            break
        if max_depth is not None and level >= max_depth:
            base.unpersist()
            raise ValueError(f"the hierarchy goes on below level {max_depth} ({n} rows)")
        parts.append(nxt)
        frontier = nxt
        level += 1
    base.unpersist()
    return reduce(lambda a, b: a.unionByName(b), parts)


def root_only(rows: DataFrame, blocker: list[str], waiter: list[str], same: list[str] = ()) -> DataFrame:
    """Rows whose blocker is not itself waiting (NOT EXISTS as anti join).

    blocker: columns of a row naming the blocker; waiter: the matching
    columns of a waiting row; same: columns that must be equal (sample).
    """
    i = rows.select(*[F.col(w).alias(f"_w{k}") for k, w in enumerate(waiter)],
                    *[F.col(s).alias(f"_s_{s}") for s in same]).distinct()
    cond = [F.col(f"_r.{b}") == F.col(f"_i._w{k}") for k, b in enumerate(blocker)] + \
           [F.col(f"_r.{s}") == F.col(f"_i._s_{s}") for s in same]
    return rows.alias("_r").join(i.alias("_i"), cond, "left_anti")


def deepest_occurrence(walk: DataFrame, node: list[str], level_col: str = "level") -> DataFrame:
    """Keep each node only at its deepest level (A29): aggregate + semi join, no window."""
    deep = walk.groupBy(*node).agg(F.max(level_col).alias("_deep"))
    cond = [F.col(f"_w.{n}").eqNullSafe(F.col(f"_d.{n}")) for n in node] + \
           [F.col(f"_w.{level_col}") == F.col("_d._deep")]
    return walk.alias("_w").join(deep.alias("_d"), cond, "left_semi")


def tree_rollup(walk: DataFrame, root: list[str], node: str, level_col: str = "level",
                wait: str | None = None, extra: dict | None = None) -> DataFrame:
    """Per root: blocked nodes total and direct, summed wait, depth.

    Totals follow the reference's '>1' flavour: the value when one,
    '< n >' otherwise.
    """
    def gt1(c: Column) -> Column:
        n = F.count_distinct(c)
        return F.when(n > 1, F.concat(F.lit("< "), n.cast("string"), F.lit(" >"))).otherwise(F.min(c.cast("string")))

    aggs = [gt1(F.col(node)).alias("blocked_total"),
            gt1(F.when(F.col(level_col) == 1, F.col(node))).alias("blocked_direct"),
            F.count_distinct(node).alias("blocked_count"),
            F.max(level_col).alias("max_level")]
    if wait:
        aggs.append(F.sum(wait).alias("seconds_in_wait_total"))
    aggs += [v.alias(k) for k, v in (extra or {}).items()]
    return walk.groupBy(*root).agg(*aggs)


SENTINEL = 2 ** 62


def post_order_number(walk: DataFrame, plan: list[str], id_col: str = "id", path_col: str = "path",
                      out: str = "exec_order") -> DataFrame:
    """Execution order of plan lines: children before parents, siblings by id.

    ``path`` holds the ids from the root to the line (from ``hierarchy_walk``);
    appending a high sentinel makes an element-wise array order put every
    child before its parent.  One window per plan (plans are small).
    """
    key = F.concat(F.col(path_col), F.array(F.lit(SENTINEL).cast("bigint")))
    return walk.withColumn(out, F.row_number().over(Window.partitionBy(*plan).orderBy(key)).cast("bigint"))


def variant_compare(lines: DataFrame, strict: list, loose: list, out_strict: str = "strict_count",
                    out_loose: str = "loose_count") -> DataFrame:
    """How many lines over all plan variants share the strict / loose key.

    Counts are aggregates joined back on the (null-safe) key instead of
    windows, so one very common key does not end up in a single task.
    """
    def add(df, cols, name):
        keyed = df.select("*", *[c.alias(f"_k{i}") if isinstance(c, Column) else F.col(c).alias(f"_k{i}")
                                 for i, c in enumerate(cols)])
        ks = [f"_k{i}" for i in range(len(cols))]
        cnt = keyed.groupBy(*ks).agg(F.count(F.lit(1)).alias(name))
        cond = [F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in ks]
        j = keyed.alias("_a").join(cnt.alias("_b"), cond, "inner")
        return j.select(*[F.col(f"_a.{c}") for c in df.columns], F.col(f"_b.{name}"))
    return add(add(lines, strict, out_strict), loose, out_loose)


def positional_compare(lines: DataFrame, plan: str, position: str, cols: list, n_plans: int | Column | None = None,
                       out: str = "plan_different") -> DataFrame:
    """Mark line positions where plan variants differ.

    Each line is hashed (xxhash64 over the compared fields); per position
    the variants differ when min and max hash differ or a variant has no
    line there.  Aggregate per position, then join back.
    """
    h = lines.withColumn("_h", F.xxhash64(*[c if isinstance(c, Column) else F.col(c) for c in cols]))
    total = n_plans if n_plans is not None else h.select(F.count_distinct(plan)).scalar()
    per = h.groupBy(position).agg(F.min("_h").alias("_mn"), F.max("_h").alias("_mx"),
                                  F.count(F.lit(1)).alias("_n"))
    per = per.select(position, ((F.col("_mn") != F.col("_mx")) |
                                (F.col("_n") < (total if isinstance(total, Column) else F.lit(total)))).alias(out))
    return h.drop("_h").join(per, position, "inner")


def child_rank(plan_lines: DataFrame, plan: list[str], id_col: str = "id", parent: str = "parent_id",
               out: str = "child_no") -> DataFrame:
    """Position of a line among its siblings (1 = first child)."""
    w = Window.partitionBy(*plan, parent).orderBy(id_col)
    return plan_lines.withColumn(out, F.row_number().over(w))


def subtree_self_join(plan_lines: DataFrame, plan: list[str], depth: int = 5, id_col: str = "id",
                      parent: str = "parent_id", cols: list[str] = ("operation",)) -> DataFrame:
    """Parent with its first and second child, plus the lines up to ``depth`` levels under the second child.

    Chained equi self-joins on (plan, parent_id = id), no recursion needed
    for a fixed depth.  Output: one row per (parent, second-child descendant).
    """
    r = child_rank(plan_lines, plan, id_col, parent)
    sel = lambda p, df: df.select(*plan, *[F.col(c).alias(f"{p}_{c}") for c in [id_col, parent, "child_no", *cols]])
    par = sel("p", r)
    c1 = sel("c1", r.filter(F.col("child_no") == 1))
    c2 = sel("c2", r.filter(F.col("child_no") == 2))
    base = (par.join(c1, [*plan], "inner").filter(F.col("c1_" + parent) == F.col("p_" + id_col))
            .join(c2, [*plan], "inner").filter(F.col("c2_" + parent) == F.col("p_" + id_col)))
    out = base.withColumn("d_level", F.lit(0)).withColumn("d_" + id_col, F.col("c2_" + id_col))
    for c in cols:
        out = out.withColumn(f"d_{c}", F.col(f"c2_{c}"))
    parts = [out]
    cur = out
    lines = r.select(*plan, F.col(id_col).alias("_nid"), F.col(parent).alias("_npar"),
                     *[F.col(c).alias(f"_n_{c}") for c in cols])
    for lvl in range(1, depth + 1):
        cur = (cur.join(lines, [*plan], "inner").filter(F.col("_npar") == F.col("d_" + id_col))
               .withColumn("d_level", F.lit(lvl)).withColumn("d_" + id_col, F.col("_nid")))
        for c in cols:
            cur = cur.withColumn(f"d_{c}", F.col(f"_n_{c}"))
        cur = cur.drop("_nid", "_npar", *[f"_n_{c}" for c in cols])
        parts.append(cur)
    return reduce(lambda a, b: a.unionByName(b), parts)
