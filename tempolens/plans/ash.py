"""Activity-sample (ASH) reports, SURVEY 2.B."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import load_average, nvl_text, time_bucket
from ..operators.history import merge_live_history
from ..operators.series import top_x_series


def load_timeline(samples: DataFrame, dim, bucket_seconds: int = 3600, top_x: int = 10,
                  ts: str = "sample_time", weight: str = "sample_cycle") -> DataFrame:
    """Active sessions per time slot for the top-x values of a dimension.

    samples: weighted samples (see ``merge_live_history``); dim: column or
    Column of the dimension.  Output (start_sample, criteria, diagram_value).
    """
    rows = samples.select(time_bucket(ts, bucket_seconds).alias("start_sample"),
                          nvl_text(F.col(dim) if isinstance(dim, str) else dim).alias("criteria"),
                          F.col(weight))
    cells = (rows.groupBy("start_sample", "criteria")
             .agg(load_average(weight, bucket_seconds).alias("diagram_value")))
    return top_x_series(cells, "start_sample", "criteria", "diagram_value", top_x)


def weighted_samples(hist: DataFrame, live: DataFrame, **kw) -> DataFrame:
    """History (10 s) and live (1 s) samples merged with their weights."""
    return merge_live_history(hist, live, **kw)


# ---------------------------------------------------------------------------
# Dimension registry (B08) over activity-sample columns.  The NVL rules of
# the reference are kept: a sample without wait class is on CPU.
# ---------------------------------------------------------------------------
def ash_dimensions(cols=None) -> dict:
    """Dimension name -> Column for the activity samples.

    Only dimensions whose source columns exist in ``cols`` are returned,
    so the registry works on any export that has a subset of the columns.
    """
    reg = {
        "instance": F.col("instance_number"),
        "session": F.col("session_id"),
        "transaction": F.col("xid"),
        "sql_id": F.col("sql_id"),
        "module": F.col("module"),
        "action": F.col("action"),
        "event": F.coalesce(F.col("event"), F.col("session_state")) if cols and "session_state" in cols else F.col("event"),
        "wait_class": F.coalesce(F.col("wait_class"), F.lit("CPU")),
        "program": F.col("program"),
        "machine": F.col("machine"),
        "user": F.col("user_id"),
        "service": F.col("service_hash"),
        "db_object": F.col("current_obj"),
        "data_file": F.col("current_file"),
        "sql_exec_id": F.col("sql_exec_id"),
        "operation": F.col("sql_opname"),
        "entry_plsql": F.col("plsql_entry_object_id"),
        "plsql": F.col("plsql_object_id"),
        "db_sub_object": F.col("current_sub_obj"),
    }
    source = {"instance": "instance_number", "session": "session_id", "transaction": "xid", "sql_id": "sql_id",
              "module": "module", "action": "action", "event": "event", "wait_class": "wait_class",
              "program": "program", "machine": "machine", "user": "user_id", "service": "service_hash",
              "db_object": "current_obj", "data_file": "current_file", "sql_exec_id": "sql_exec_id",
              "operation": "sql_opname", "entry_plsql": "plsql_entry_object_id", "plsql": "plsql_object_id",
              "db_sub_object": "current_sub_obj"}
    if cols is None:
        return reg
    return {k: v for k, v in reg.items() if source[k] in cols}


def ash_measures(ts: str = "sample_time", weight: str = "sample_cycle") -> dict:
    from ..functions import seconds_between
    return {
        "time_waited_secs": F.sum(weight),
        "time_waited_avg_ms": F.round(F.avg("time_waited") / F.lit(1000.0), 4),
        "count_samples": F.count(F.lit(1)),
        "first_occurrence": F.min(ts),
        "last_occurrence": F.max(ts),
        "sample_duration_secs": F.round(seconds_between(F.min(ts), F.max(ts)), 3),
    }


def grouping(samples: DataFrame, by: str, filters: dict | None = None) -> DataFrame:
    """Drill-down of weighted samples by one dimension."""
    from ..operators.grouping import drilldown
    reg = ash_dimensions(samples.columns)
    return drilldown(samples, reg, by, filters, ash_measures())


def statement_breakdown(samples: DataFrame, weight: str = "sample_cycle") -> DataFrame:
    """Weighted seconds per statement, instance and user."""
    keys = [c for c in ("sql_id", "instance_number", "user_id") if c in samples.columns]
    return samples.groupBy(*keys).agg(F.sum(weight).alias("time_waited_secs"),
                                      F.count(F.lit(1)).alias("count_samples"))


def active_sessions_per_sample(samples: DataFrame, ts: str = "sample_time") -> DataFrame:
    """Number of active sessions per sample time (B09, rule R55)."""
    return samples.groupBy(ts).agg(F.count(F.lit(1)).alias("active_sessions"))


def object_choice(p2text: str = "p2text", p2: str = "p2", current_obj: str = "current_obj"):
    """Object of a sample: the wait's object parameter when it names one, else the current object."""
    return F.when(F.col(p2text) == F.lit("object #"), F.col(p2)).otherwise(F.col(current_obj))


def wait_summary(samples: DataFrame, event: str = "event", state: str = "session_state",
                 seconds: str = "time_waited") -> DataFrame:
    """Current waits per event: count, max and total wait (B11); no event means ON CPU."""
    ev = F.coalesce(F.col(event), F.lit("ON CPU")) if state not in samples.columns else \
        F.when(F.col(state) == "ON CPU", F.lit("ON CPU")).otherwise(F.col(event))
    return samples.groupBy(ev.alias("event")).agg(F.count(F.lit(1)).alias("sessions"),
                                                  F.max(seconds).alias("max_wait"),
                                                  F.sum(seconds).alias("total_wait"))


# Single samples with lookups (B03) and time per plan line (B10) are in
# plans.sessions.single_samples and plans.statements.time_per_plan_line.
