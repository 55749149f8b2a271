"""Trees and graphs in few rounds: ancestor doubling (A27, A31) and deepest levels without paths.

``hierarchy_walk`` goes one level a round and carries every path.  Here a round
doubles the distance that a row's pointer spans, so a tree of depth d takes
log2(d) joins, and deepest levels keep one row for each node and root instead of
one for each path.  Every round is written to the shared folder, its lineage ends
there, and tables that are not needed any more are removed.  Rows are merged with
rows, never broadcast: a written table's files are much smaller than its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_written, written
from .hierarchy import hierarchy_walk


def _pointers(lines: DataFrame, plan: list[str], id_col: str, parent: str, cols: list[Column], passes: Column | None = None) -> DataFrame:
    """(plan, _id, _jump): each row points at its parent, or at nothing if that is not there or may not be passed."""
    up = lines.select(*plan, F.col(id_col).alias("_jump"), (F.coalesce(passes, F.lit(False)) if passes is not None else F.lit(True)).alias("_there"))
    return (lines.select(*plan, F.col(id_col).alias("_id"), F.col(parent).alias("_jump"), *cols)
            .join(up.hint("merge"), [*plan, "_jump"], "left").withColumn("_jump", F.when(F.coalesce("_there", F.lit(False)), F.col("_jump"))).drop("_there"))


def tree_numbers(lines: DataFrame, plan: list[str], id_col: str = "id", parent: str = "parent_id",
                 level: str = "level", size: str = "subtree_lines", number: str = "exec_order") -> DataFrame:
    """Level, subtree size and execution order (children before parents, siblings by id) of plan lines.

    A line's number is its subtree size plus the sizes of the earlier siblings of
    itself and of all its ancestors.  Sizes grow by doubling (what is nearer than
    2**k, plus that of the rows 2**k below), and so do the sums over ancestors; no
    step holds a whole plan, only the children of one line are ordered together.

    Lines are identified by (plan, id); a line whose parent is not there is a root;
    lines on a cycle, or below one, have no root and are left out; rows with a null
    plan or id are left out.
    """
    keys = list(plan)
    cur = written(_pointers(lines, keys, id_col, parent, []).select(
        *keys, "_id", F.col("_jump").alias("_up"), F.col("_jump").alias("_j0"), F.lit(1).cast("long").alias("_size"), F.lit(1).alias("_level")), "tree")
    n, k = cur.count(), 0
    while 2 ** k <= n and not cur.where(F.col(f"_j{k}").isNotNull()).isEmpty():
        here = f"_j{k}"
        up = cur.select(*keys, F.col("_id").alias(here), F.col(here).alias(f"_j{k + 1}"), F.col("_level").alias("_l2"))
        below = cur.where(F.col(here).isNotNull()).groupBy(*keys, F.col(here).alias("_id")).agg(F.sum("_size").alias("_more"))
        new = written(cur.join(up.hint("merge"), [*keys, here], "left").join(below.hint("merge"), [*keys, "_id"], "left").select(
            *keys, "_id", "_up", *[f"_j{i}" for i in range(k + 2)],
            (F.col("_size") + F.coalesce("_more", F.lit(0))).alias("_size"), (F.col("_level") + F.coalesce("_l2", F.lit(0))).alias("_level")), "tree")
        drop_written(cur)
        cur, k = new, k + 1
    siblings = Window.partitionBy(*keys, "_up").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    off = written(cur.where(F.col(f"_j{k}").isNull()).withColumn("_off", F.coalesce(F.sum("_size").over(siblings), F.lit(0))), "tree")
    drop_written(cur)
    for i in range(k):
        up = off.select(*keys, F.col("_id").alias(f"_j{i}"), F.col("_off").alias("_o2"))
        new = written(off.join(up.hint("merge"), [*keys, f"_j{i}"], "left").withColumn("_off", F.col("_off") + F.coalesce("_o2", F.lit(0))).drop("_o2"), "tree")
        drop_written(off)
        off = new
    numbers = off.select(*keys, F.col("_id").alias(id_col), F.col("_level").alias(level), F.col("_size").alias(size), (F.col("_off") + F.col("_size")).alias(number))
    return lines.join(numbers, [*keys, id_col], "inner")


def marked_above(lines: DataFrame, plan: list[str], marked: Column, passes: Column, id_col: str = "id", parent: str = "parent_id",
                 level: str = "level") -> DataFrame:
    """``lines`` once for each marked line that reaches them, itself included, with the level below it.

    The same rows as a walk down from the marked lines that goes on only below
    lines with ``passes``, but by doubling from the other end: each line gathers
    the distances of the marked lines above it in log2(depth) joins.
    """
    keys = list(plan)
    mark = F.coalesce(marked, F.lit(False))
    first = _pointers(lines, keys, id_col, parent, [mark.alias("_mark")], passes)
    up = lines.select(*keys, F.col(id_col).alias("_jump"), mark.alias("_m2"))
    cur = written(first.join(up.hint("merge"), [*keys, "_jump"], "left").select(
        *keys, "_id", "_jump", "_mark", F.when(F.coalesce("_m2", F.lit(False)), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("_far"))
        .where("_jump is not null or _mark"), "marks")  # other lines are reached by nothing
    n, span = cur.count(), 1
    while span <= n and not cur.where("_jump is not null").isEmpty():
        up = cur.select(*keys, F.col("_id").alias("_jump"), F.col("_jump").alias("_j2"), F.col("_far").alias("_f2"))
        more = F.transform(F.coalesce("_f2", F.array().cast("array<int>")), lambda d: d + span)
        on = cur.where("_jump is not null").join(up.hint("merge"), [*keys, "_jump"], "left").select(
            *keys, "_id", F.col("_j2").alias("_jump"), "_mark", F.concat("_far", more).alias("_far"))
        new = written(on.unionByName(cur.where("_jump is null")), "marks")  # rows without a way up lie in no task together
        drop_written(cur)
        cur, span = new, 2 * span
    own = F.when(F.col("_mark"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    levels = cur.select(*keys, F.col("_id").alias(id_col), F.explode(F.concat(own, "_far")).alias("_d")).select(*keys, id_col, (F.col("_d") + 1).alias(level))
    return lines.join(levels.hint("merge"), [*keys, id_col], "inner")


def cyclic_nodes(steps: DataFrame, same: list[str]) -> DataFrame | None:
    """(same, _n, _scc): the nodes that lie on a cycle of the edges (same, _p, _c), named by its smallest node; None without cycles.

    Edges that start at a source or end at a sink cannot be on a cycle and are
    trimmed away first; only what is left is closed under reachability, by
    squaring.  Cycles of a wait-for or reference graph are small.
    """
    s = list(same)
    core, n = steps, -1
    while True:
        kept = core.join(core.select(*s, F.col("_c").alias("_p")).distinct(), [*s, "_p"], "left_semi").join(
            core.select(*s, F.col("_p").alias("_c")).distinct(), [*s, "_c"], "left_semi")
        new = written(kept.select(*s, "_p", "_c"), "core")
        m = new.count()
        if core is not steps:
            drop_written(core)
        core = new
        if m == 0:
            drop_written(core)
            return None
        if m == n:
            break
        n = m
    reach, n = core, -1
    while reach.count() != n:
        n = reach.count()
        far = reach.join(reach.select(*s, F.col("_p").alias("_c"), F.col("_c").alias("_c2")), [*s, "_c"]).select(*s, "_p", F.col("_c2").alias("_c"))
        new = written(reach.unionByName(far).distinct(), "reach")
        drop_written(reach)
        reach = new
    both = reach.join(reach.select(*s, F.col("_c").alias("_p"), F.col("_p").alias("_c")), [*s, "_p", "_c"], "left_semi")
    return both.groupBy(*s, F.col("_p").alias("_n")).agg(F.min("_c").alias("_scc"))


def deepest_levels(edges: DataFrame, parent: str, child: str, same: list[str] = (), start: Column | None = None) -> DataFrame:
    """(same, child, parent, root, level): how the nodes are reached at their deepest level.

    Equal to the rows of a ``hierarchy_walk`` (one level for each child of a child,
    no node twice on a path) that are at the deepest level of their node, without
    its paths: a round holds one row for each node, parent and root.  ``start``
    picks the edges that begin a path; root is their parent.  Cycles are condensed:
    their longest ways are found by a walk that stays inside them, and the rest has
    none, so the rounds end.  Rows with a null end, or a null in ``same``, begin
    paths as they do in the walk, but lead nowhere.
    """
    s = list(same)
    cols = [*s, F.col(parent).alias("_p"), F.col(child).alias("_c")]
    rows = written(edges.select(*cols).distinct(), "edges")
    steps = rows.where(F.col("_p") != F.col("_c"))
    begin = rows if start is None else edges.where(start).select(*cols).distinct()
    front = written(begin.select(*s, "_c", F.col("_p").alias("_from"), F.col("_p").alias("_root"), F.lit(1).alias("_lvl")), "front")
    loops, hops = cyclic_nodes(steps, s), None
    if loops is not None:
        loops = written(loops, "loops")
        at = lambda end: loops.select(*s, F.col("_n").alias(end), F.col("_scc").alias(f"_s{end}"))
        marked = steps.join(at("_p"), [*s, "_p"], "left").join(at("_c"), [*s, "_c"], "left")
        one = F.coalesce(F.col("_s_p") == F.col("_s_c"), F.lit(False))
        inside = marked.where(one).select(*s, "_p", "_c", F.col("_s_c").alias("_scc"))
        steps = written(marked.where(~one).select(*s, "_p", "_c"), "steps")
        enter = loops.select(*s, F.lit(None).cast(inside.schema["_p"].dataType).alias("_p"), F.col("_n").alias("_c"), "_scc")
        ways = hierarchy_walk(inside, connect=[("_c", "_p")], same=[*s, "_scc"], start=enter, node=["_c"], root_cols=["_c"]).where("level > 1")
        longest = ways.groupBy(*s, "root__c", "_c").agg(F.max("level").alias("level"))
        hops = written(ways.select(*s, "root__c", "_c", "_p", "level").distinct().join(longest, [*s, "root__c", "_c", "level"], "left_semi").select(
            *s, F.col("root__c").alias("_c"), F.col("_c").alias("_to"), F.col("_p").alias("_via"), (F.col("level") - 1).alias("_len")), "hops")
    parts = []
    while not front.isEmpty():
        seen = front
        if hops is not None:
            best = front.groupBy(*s, "_c", "_root").agg(F.max("_lvl").alias("_lvl"))
            seen = written(front.unionByName(best.join(hops, [*s, "_c"]).select(
                *s, F.col("_to").alias("_c"), F.col("_via").alias("_from"), "_root", (F.col("_lvl") + F.col("_len")).alias("_lvl"))).distinct(), "front")
        parts.append(seen)
        out = seen.groupBy(*s, F.col("_c").alias("_p"), "_root").agg(F.max("_lvl").alias("_lvl"))
        front = written(out.join(steps, [*s, "_p"]).select(*s, "_c", F.col("_p").alias("_from"), "_root", (F.col("_lvl") + 1).alias("_lvl")).distinct(), "front")
    if not parts:
        parts = [front]
    reached = reduce(DataFrame.unionByName, parts)
    deep = reached.groupBy(*s, "_c").agg(F.max("_lvl").alias("_deep"))
    cond = [F.col(f"w.{x}").eqNullSafe(F.col(f"d.{x}")) for x in [*s, "_c"]] + [F.col("w._lvl") == F.col("d._deep")]
    return reached.alias("w").join(deep.alias("d"), cond, "left_semi").select(
        *s, F.col("_c").alias(child), F.col("_from").alias(parent), F.col("_root").alias("root"), F.col("_lvl").alias("level")).distinct()
