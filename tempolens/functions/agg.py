"""Aggregate expressions with Oracle semantics.

All of them are plain aggregate Columns: Spark computes them with partial
(map-side) aggregation, so a hot group is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col


def _order_fields(order) -> list[Column]:
    cols = [as_col(o) for o in (order if isinstance(order, (list, tuple)) else [order])]
    out = []
    for i, o in enumerate(cols):
        # NULL order keys sort last (Oracle ascending default)
        out += [o.isNull().alias(f"_n{i}"), o.alias(f"_o{i}")]
    return out


def first_value_by(x, order) -> Column:
    """MIN(x) KEEP (DENSE_RANK FIRST ORDER BY order).

    ``min(struct(order..., x is null, x))``: the first order key wins, ties
    go to the smallest non-NULL x (Oracle MIN ignores NULL).
    """
    v = as_col(x)
    s = F.struct(*_order_fields(order), v.isNull().alias("_xn"), v.alias("_x"))
    return F.min(s)["_x"]


def last_value_by(x, order) -> Column:
    """MAX(x) KEEP (DENSE_RANK LAST ORDER BY order); ties -> largest non-NULL x."""
    v = as_col(x)
    s = F.struct(*_order_fields(order), v.isNotNull().alias("_xn"), v.alias("_x"))
    return F.max(s)["_x"]


def single_or_count(col, null_counts: bool = True, else_: str = "count",
                    null_text: str = " ", approx: bool = False) -> Column:
    """The one value of a group, or '< n >' when it has n distinct values.

    null_counts=True: NULL is a value of its own (NVL(x, ' ') counted);
    False: NULL ignored, an all-NULL group shows '< 0 >'.
    else_: 'count' -> '< n >', or a fixed text such as 'Partial'/'N/A',
    or None for NULL.
    approx: whether a group has one value is still decided exactly (min =
    max), but n is a HyperLogLog++ estimate shown as '< ~n >'; this needs no
    Expand of the rows, so many such columns stay cheap on large inputs.
    """
    c = as_col(col).cast("string")
    counted = F.coalesce(c, F.lit(null_text)) if null_counts else c
    if approx:
        single = (F.min(counted) == F.max(counted)) & F.max(counted).isNotNull()
        n = F.approx_count_distinct(counted)
        text = F.concat(F.lit("< ~"), n.cast("string"), F.lit(" >"))
    else:
        n = F.count_distinct(counted)
        single = n == 1
        text = F.concat(F.lit("< "), n.cast("string"), F.lit(" >"))
    other = text if else_ == "count" else F.lit(else_).cast("string")
    return F.when(single, F.min(c)).otherwise(other)


def load_average(weight, bucket_seconds: int) -> Column:
    """Active sessions in a slot: weighted seconds / greatest(max weight, slot width)."""
    w = as_col(weight)
    return F.sum(w) / F.greatest(F.max(w), F.lit(bucket_seconds)).cast("double")
