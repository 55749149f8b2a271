"""Doubling and condensed levels equal the walks, and end where walks would not."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempolens.operators.hierarchy import deepest_occurrence, hierarchy_walk, post_order_number, root_only
from tempolens.operators.trees import cyclic_nodes, deepest_levels, marked_above, tree_numbers

LINES = "plan int, id int, parent_id int, mark boolean, obj string"


def random_lines(seed, n=40):
    rnd = random.Random(seed)
    rows = [(p, i, rnd.choice([i - 1, rnd.randrange(i), None, 99]) if i else None, rnd.random() < 0.3, rnd.choice([None, None, "o"]))
            for p in (1, 2) for i in range(n)]
    return rows + [(3, 1, 2, True, None), (3, 2, 1, False, None), (3, 3, 2, True, "o"), (4, 7, 7, True, "o"), (None, 1, None, True, "o"), (4, 1, None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_numbers_equal_the_window_over_paths(spark, seed):
    lines = spark.createDataFrame(random_lines(seed), LINES).where("plan is not null").repartition(3)
    got = {(r.plan, r.id): (r.level, r.exec_order) for r in tree_numbers(lines, ["plan"]).collect()}
    roots = root_only(lines, ["parent_id"], ["id"], ["plan"])
    walk = hierarchy_walk(lines, [("id", "parent_id")], ["plan"], start=roots, node=["id"])
    assert got == {(r.plan, r.id): (r.level, r.exec_order) for r in post_order_number(walk, ["plan"]).collect()}
    assert (3, 1) not in got and (3, 3) not in got and (4, 7) not in got  # on or below a cycle


def test_numbers_of_a_long_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(300)], "plan int, id int, parent_id int")
    rows = {r.id: (r.level, r.subtree_lines, r.exec_order) for r in tree_numbers(chain, ["plan"]).collect()}
    assert rows == {i: (i + 1, 300 - i, 300 - i) for i in range(300)}
    assert tree_numbers(chain.where("id < 0"), ["plan"]).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_marked_lines_above_equal_the_walk(spark, seed):
    lines = spark.createDataFrame(random_lines(seed), LINES).where("plan < 3").repartition(3)
    walk = hierarchy_walk(lines, [("id", "parent_id")], ["plan"], start=F.col("mark"), node=["id"], expand_if=F.col("obj").isNull())
    want = sorted((r.plan, r.id, r.level) for r in walk.collect())
    assert sorted((r.plan, r.id, r.level) for r in marked_above(lines, ["plan"], F.col("mark"), F.col("obj").isNull()).collect()) == want


def by_walk(spark, edges, start):
    walk = hierarchy_walk(edges, [("c", "p")], ["s"], start=start, node=["c"], root_cols=["p"])
    deep = deepest_occurrence(walk, ["s", "c"])
    return {(r.s, r.c, r.p, r.root_p, r.level) for r in deep.collect()}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=14))
def test_deepest_levels_equal_the_walk(spark, pairs):
    edges = spark.createDataFrame(pairs, "s int, p int, c int").distinct()
    for start in (None, F.col("p") == 0):
        assert {tuple(r) for r in deepest_levels(edges, "p", "c", ["s"], start).select("s", "c", "p", "root", "level").collect()} == by_walk(spark, edges, start)


def test_diamonds_and_cycles_end(spark):
    # 30 layers of two nodes, each joined to both of the next: 2**30 paths
    layers = [(2 * k + a, 2 * k + 2 + b) for k in range(30) for a in (0, 1) for b in (0, 1)]
    edges = spark.createDataFrame(layers, "p int, c int")
    got = {r.c: r.level for r in deepest_levels(edges, "p", "c", start=F.col("p") < 2).select("c", "level").distinct().collect()}
    assert got == {v: v // 2 for v in range(2, 62)}
    steps = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 2, 3), (1, 3, 4), (1, 4, 3), (1, 5, 0), (2, 0, 1)], "s int, _p int, _c int")
    assert {tuple(r) for r in cyclic_nodes(steps, ["s"]).collect()} == {(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 3), (1, 4, 3)}
    assert cyclic_nodes(steps.where("s = 2"), ["s"]) is None
