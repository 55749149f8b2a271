"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ._common import drop_table, materialize


def _state(edges: DataFrame) -> Row:
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its smallest node.

    Large-star and small-star steps in turn until the edges are stars around the
    smallest nodes.  Minima are combined before the shuffle, a hub's edges meet
    its minimum in a join that splits, and every round ends in a written table.
    Edges with a null end are left out.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        # large star: the larger end of each edge goes to the least neighbour of the smaller end
        large = e.join(least, "v").select("u", F.col("m").alias("v"))
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: all smaller neighbours of a node go to its least one, and so does the node
        small = (large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        new = materialize(small, "edges")
        after = _state(new)
        drop_table(e)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
