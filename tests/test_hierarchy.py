"""Walk semantics: NOCYCLE stops before a node on the path, roots, depth, post-order."""

import pytest
from pyspark.sql import functions as F

from tempolens.operators.hierarchy import (deepest_occurrence, hierarchy_walk, post_order_number, root_only,
                                           tree_rollup)


def test_nocycle_and_roots(spark):
    # sample 1: 9 <- 4 <- 2 <- 1 <- 0 <- 9 is a cycle; sample 2: 5 waits on 3 (3 not waiting)
    edges = spark.createDataFrame([(1, 4, 9), (1, 2, 4), (1, 1, 2), (1, 0, 1), (1, 9, 0), (2, 5, 3), (2, 6, 5)],
                                  "sample int, session int, blocker int")
    walk = hierarchy_walk(edges, [("session", "blocker")], ["sample"], node=["session"],
                          root_cols=["sample", "blocker"])
    # every row is a root without START WITH; a cycle of 5 rows gives paths of length 5 at most
    assert walk.agg(F.max("level")).first()[0] == 5
    roots = root_only(edges, ["blocker"], ["session"], ["sample"])
    assert {(r.sample, r.session) for r in roots.collect()} == {(2, 5)}
    tree = hierarchy_walk(edges, [("session", "blocker")], ["sample"], start=roots, node=["session"],
                          root_cols=["sample", "blocker"])
    r = tree_rollup(tree, ["root_sample", "root_blocker"], "session").first()
    assert (r.root_blocker, r.blocked_total, r.blocked_direct, r.max_level) == (3, "< 2 >", "5", 2)


def test_diamond_deepest_and_post_order(spark):
    # 1 -> 2, 1 -> 3, 2 -> 4, 3 -> 4 (diamond); 4 -> 5
    lines = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 4, 3), (1, 5, 4)],
                                  "plan int, id int, parent_id int")
    walk = hierarchy_walk(lines, [("id", "parent_id")], ["plan"], start=F.col("parent_id").isNull(), node=["id"])
    deep = {r.id: r.level for r in deepest_occurrence(walk, ["id"]).select("id", "level").distinct().collect()}
    assert deep == {1: 1, 2: 2, 3: 2, 4: 3, 5: 4}
    tree = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 2)], "plan int, id int, parent_id int")
    w = hierarchy_walk(tree, [("id", "parent_id")], ["plan"], start=F.col("parent_id").isNull(), node=["id"])
    order = [r.id for r in post_order_number(w, ["plan"]).orderBy("exec_order").collect()]
    assert order == [4, 5, 2, 3, 1]


def test_constraint_closure_on_fixture_graph(spark):
    from tempolens.plans.locks import table_closure
    from tempolens.sources import fixture
    from conftest import SF001
    out = {r.child_table: r.level for r in table_closure(fixture(spark, SF001, "fx_constraint"), "region").collect()}
    # lineitem is reached via supplier (level 3) and via customer-orders (level 4): the deepest level is kept
    assert out == {"nation": 1, "customer": 2, "supplier": 2, "orders": 3, "lineitem": 4}


def test_walk_max_depth_and_parent_condition(spark):
    # chain 1 <- 2 <- 3 <- 4 <- 5; node 3 carries a mark
    lines = spark.createDataFrame([(1, 1, None, None), (1, 2, 1, None), (1, 3, 2, "x"), (1, 4, 3, None), (1, 5, 4, None)],
                                  "plan int, id int, parent_id int, mark string")
    start = F.col("parent_id").isNull()
    assert hierarchy_walk(lines, [("id", "parent_id")], ["plan"], start=start, node=["id"]).count() == 5
    with pytest.raises(ValueError):  # rows below the limit are an error, not left out
        hierarchy_walk(lines, [("id", "parent_id")], ["plan"], start=start, node=["id"], max_depth=2)
    # descend only through rows without a mark: stops below node 3 (3 is reached, its children are not)
    w = hierarchy_walk(lines, [("id", "parent_id")], ["plan"], start=start, node=["id"], expand_if=F.col("mark").isNull())
    assert sorted(r.id for r in w.collect()) == [1, 2, 3]


def test_a_depth_limit_never_shortens_a_walk(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)], "id long, parent long")
    walk = hierarchy_walk(chain, connect=[("id", "parent")], start=F.col("parent").isNull(), node=["id"])
    assert walk.count() == 12
    with pytest.raises(ValueError):
        hierarchy_walk(chain, connect=[("id", "parent")], start=F.col("parent").isNull(), node=["id"], max_depth=5)
    assert hierarchy_walk(chain, connect=[("id", "parent")], start=F.col("parent").isNull(), node=["id"], max_depth=12).count() == 12
