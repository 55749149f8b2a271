"""Queue balance (A50): queue length at earlier times from the current length and the flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def queue_balance(current: DataFrame, flows: DataFrame, key: str, slot: str, inflow: str = "inflow",
                  outflow: str = "outflow", current_col: str = "current_length") -> DataFrame:
    """Queue length at the start of every slot.

    length_before(s) = current - sum over slots t >= s of (inflow - outflow).
    ``flows`` is one row per (key, slot), already aggregated, so the
    suffix-sum window per key holds one row per slot only.
    """
    w = Window.partitionBy(key).orderBy(F.col(slot).desc()).rowsBetween(Window.unboundedPreceding, 0)
    f = flows.withColumn("_net_after", F.sum(F.col(inflow) - F.col(outflow)).over(w))
    return (f.join(current, key, "left")
            .withColumn("queue_length_before", F.coalesce(F.col(current_col), F.lit(0)) - F.col("_net_after"))
            .drop("_net_after"))
