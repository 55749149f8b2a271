"""Message queue, batch job and usage-log reports (G01-G13), SURVEY 2.G."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import minute_slice, safe_div, seconds_between
from ..operators.grouping import conditional_pivot, distinct_counts_by_group, group_filter
from ..operators.queue import queue_balance
from ..streaming.operators import parse_usage_line

# Counter codes of the queue statistics (name -> code).
ASPECT_CODES = {"incoming": 4532, "first_try_success": 6216, "retry_success": 6217, "final_error": 6218,
                "divide_and_conquer": 6279, "retry_tx": 6280, "first_try": 6281, "retries": 6282, "first_try_error": 6283,
                "retry_error": 6284, "elapsed_ms": 7251, "bulk_groups": 7862, "sla_warnings": 7402, "sla_alerts": 7403,
                "compressions": 4160}


def queue_overview(messages: DataFrame, counters: DataFrame, key: str = "id_messagetype",
                   counter_key: str = "sub_key") -> DataFrame:
    """Per message type: messages, working, erroneous, priorities, groups; merged with counter totals."""
    m = messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.when(F.col("erroneous") == "N", 1).otherwise(0)).alias("working"),
        F.sum(F.when(F.col("erroneous") == "Y", 1).otherwise(0)).alias("erroneous"),
        F.count_distinct("run_count").alias("priorities"),
        F.count_distinct("id_bulkgroup").alias("groups"))
    c = counters.groupBy(F.col(counter_key).alias(key)).agg(
        F.sum(F.when(F.col("code") == ASPECT_CODES["incoming"], F.col("counter")).otherwise(0)).alias("incoming"))
    return m.join(c, key, "full")


def queue_sla(messages: DataFrame, limits: DataFrame, as_of, key: str = "id_messagetype",
              created: str = "creation_time") -> DataFrame:
    """Open messages per type with the number above the warning and the alert age at ``as_of``."""
    age = seconds_between(F.col(created), F.lit(as_of).cast("timestamp_ntz"))
    j = messages.filter(F.col("erroneous") == "N").join(limits, key, "left")
    g = j.groupBy(key).agg(F.count(F.lit(1)).alias("open_messages"),
                           F.sum(F.when(age > F.col("warning_secs"), 1).otherwise(0)).alias("warnings"),
                           F.sum(F.when(age > F.col("alert_secs"), 1).otherwise(0)).alias("alerts"),
                           F.min(created).alias("oldest"))
    return g


def limits_exceeded(messages: DataFrame, max_errors: int, key: str = "id_messagetype") -> DataFrame:
    """Message types with more erroneous messages than allowed."""
    return (messages.filter(F.col("erroneous") == "Y").groupBy(key).agg(F.count(F.lit(1)).alias("errors"))
            .filter(F.col("errors") > max_errors))


def recent_events(events: DataFrame, ts: str, minutes: int = 60) -> DataFrame:
    """Events of the last ``minutes`` before the newest event (G03); the newest time is a scalar subquery."""
    last = events.select(F.max(ts)).scalar()
    return events.filter(F.col(ts) >= last - F.expr(f"INTERVAL {minutes} MINUTES"))


def type_history(counters: DataFrame, messages: DataFrame, width: int, key: str = "sub_key") -> DataFrame:
    """Counter history per type and time slice with the queue length at the start of each slice."""
    sliced = counters.withColumn("slice", minute_slice("minute", width))
    piv = conditional_pivot(sliced, [key, "slice"], "code", {v: k for k, v in ASPECT_CODES.items()}, "counter")
    flows = piv.withColumn("inflow", F.col("incoming")) \
               .withColumn("outflow", F.col("first_try_success") + F.col("retry_success") + F.col("final_error"))
    cur = messages.filter(F.col("erroneous") == "N").groupBy(F.col("id_messagetype").alias(key)) \
        .agg(F.count(F.lit(1)).alias("current_length"))
    return queue_balance(cur, flows, key, "slice")


def slice_details(counters: DataFrame, by: str, domain: DataFrame | None = None, key: str = "sub_key") -> DataFrame:
    """Counter columns per chosen key (type or slice), optionally restricted to a domain's types."""
    c = counters if domain is None else counters.join(domain, key, "left_semi")
    return conditional_pivot(c, [by], "code", {v: k for k, v in ASPECT_CODES.items()}, "counter")


def derived_queue_measures(df: DataFrame, elapsed: str, messages: str, groups: str) -> DataFrame:
    """Elapsed per message, messages per group, elapsed per group."""
    return df.withColumn("elapsed_per_message", F.round(safe_div(elapsed, messages), 4)) \
             .withColumn("messages_per_group", F.round(safe_div(messages, groups), 4)) \
             .withColumn("elapsed_per_group", F.round(safe_div(elapsed, groups), 4))


def error_messages(messages: DataFrame, types: DataFrame, exceptions: DataFrame, n: int,
                   key: str = "id_messagetype", exc_key: str = "id_exception") -> DataFrame:
    """Newest erroneous messages with type and exception names, top n."""
    e = messages.filter(F.col("erroneous") == "Y").join(types, key, "left").join(exceptions, exc_key, "left")
    return e.orderBy(F.desc("creation_time"), F.desc("id")).limit(n)


def work_groups(messages: DataFrame, as_of, by: str = "id_messagetype", group: str = "id_bulkgroup") -> DataFrame:
    """Work groups per type: waiting, working, their age and messages per group."""
    g = messages.filter(F.col(group).isNotNull()).groupBy(by, group).agg(
        F.count(F.lit(1)).alias("messages"), F.min("creation_time").alias("first_created"),
        F.max(F.when(F.col("erroneous") == "N", 1).otherwise(0)).alias("_working"))
    age = seconds_between(F.col("first_created"), F.lit(as_of).cast("timestamp_ntz"))
    return g.groupBy(by).agg(F.count(F.lit(1)).alias("groups"),
                             F.sum("_working").alias("working_groups"),
                             F.sum(1 - F.col("_working")).alias("waiting_groups"),
                             F.sum("messages").alias("messages"),
                             F.round(F.max(age), 3).alias("max_age_secs"))


def group_overview(groups: DataFrame, as_of, by: str = "id_messagetype") -> DataFrame:
    """Work groups by type or domain: waiting and working, creation, priorities and greatest age.

    A group without a process start waits.  As in the pages this rebuilds, the
    least priority is the greatest number and the other way round.
    """
    age = seconds_between(F.col("creation_time"), F.lit(as_of).cast("timestamp_ntz"))
    other = [F.min("id_domain").alias("id_domain")] if by != "id_domain" else []
    return groups.groupBy(by).agg(
        *other, F.count(F.lit(1)).alias("total"), F.count_if(F.col("process_start").isNull()).alias("waiting"),
        F.count_if(F.col("process_start").isNotNull()).alias("working"), F.min("creation_time").alias("min_creation"),
        F.max("creation_time").alias("max_creation"), F.max("priority").alias("min_prio"), F.min("priority").alias("max_prio"),
        F.round(F.max(age), 3).alias("max_age_secs"))


def running_groups(groups: DataFrame, messages: DataFrame, as_of, group: str = "id_bulkgroup") -> DataFrame:
    """Groups in work with their number of messages, age and time in work (G08); a group without messages has 0.

    Messages are counted per group before the join, so a group of many messages is combined map-side.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    counts = messages.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("id")).agg(F.count(F.lit(1)).alias("messages"))
    run = groups.where(F.col("process_start").isNotNull()).join(counts, "id", "left")
    return run.select("id", "creation_time", "id_messagetype", "priority", F.coalesce("messages", F.lit(0)).alias("messages"),
                      F.round(seconds_between(F.col("creation_time"), now), 3).alias("age_secs"), "process_start",
                      F.round(seconds_between(F.col("process_start"), now), 3).alias("in_process_secs"))


def external_queue(messages: DataFrame, types: DataFrame) -> DataFrame:
    """Messages that wait for external services by type: first, last, number, and the type's name where it has one."""
    g = messages.groupBy("id_messagetype").agg(F.min("creation_time").alias("min_ts"), F.max("creation_time").alias("max_ts"),
                                               F.count(F.lit(1)).alias("messages"))
    return g.join(types.select(F.col("id").alias("id_messagetype"), "name"), "id_messagetype", "left")


def job_runs(runs: DataFrame, jobs: DataFrame, batch_date, exclude: list = ()) -> DataFrame:
    """Runs of one batch date with job names and runtime; total runtime without excluded jobs."""
    r = runs.filter(F.col("batch_date") == F.lit(batch_date).cast("timestamp_ntz")).join(jobs, "job_id", "left")
    micros = F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))
    r = r.withColumn("runtime_secs", F.round(micros / 1e6, 3))
    # total over integer microseconds: exact, independent of summation order
    total = r.filter(~F.col("job_id").isin(list(exclude)) if exclude else F.lit(True)) \
        .select(F.sum(micros)).scalar()
    return r.withColumn("total_runtime_secs", F.round(total / 1e6, 3))


def job_history(runs: DataFrame, jobs: DataFrame, job_id: int, as_of, days: int = 300) -> DataFrame:
    """Runs of one job that started within the ``days`` before ``as_of``, with its name and their runtime."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    r = runs.filter((F.col("job_id") == job_id) & (F.col("start_time") > since)).join(jobs, "job_id")
    return r.withColumn("runtime_secs", F.round(seconds_between("start_time", "end_time"), 3))


def daily_runtime(runs: DataFrame, night_from: int = 20, night_to: int = 6) -> DataFrame:
    """Runtime hours per batch date split into night window and day, job count and weekday."""
    micros = F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))
    h = F.hour("start_time")
    night = (h >= night_from) | (h < night_to)
    per_hour = F.lit(3.6e9)
    return runs.filter(F.col("end_time").isNotNull()).groupBy("batch_date").agg(
        F.round(F.sum(micros) / per_hour, 4).alias("hours_total"),
        F.round(F.sum(F.when(night, micros).otherwise(0)) / per_hour, 4).alias("hours_night"),
        F.round(F.sum(F.when(~night, micros).otherwise(0)) / per_hour, 4).alias("hours_day"),
        F.count_distinct("job_id").alias("jobs")).withColumn("weekday", F.date_format("batch_date", "EEEE"))


def running_jobs(runs: DataFrame, jobs: DataFrame, days: int = 2) -> DataFrame:
    """Jobs without end and not successful, started within ``days`` of the newest start."""
    newest = runs.select(F.max("start_time")).scalar()
    r = runs.filter(F.col("end_time").isNull() & (F.col("status") != "SUCCESS") &
                    (F.col("start_time") >= newest - F.expr(f"INTERVAL {days} DAYS")))
    return r.join(jobs, "job_id", "left")


def usage_by_month(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Requests and distinct databases, clients, controllers, actions per month."""
    p = lines.select(*parse_usage_line(line_col))
    out = distinct_counts_by_group(p, "month", ["db", "ip", "controller", "action"])
    return out.withColumnRenamed("distinct_db", "databases").withColumnRenamed("distinct_ip", "clients") \
              .withColumnRenamed("distinct_controller", "controllers").withColumnRenamed("distinct_action", "actions")


def usage_by_key(lines: DataFrame, by: str, filters: dict | None = None, line_col: str = "line") -> DataFrame:
    """Usage grouped by any field, with filters on the others."""
    p = lines.select(*parse_usage_line(line_col))
    reg = {c: F.col(c) for c in p.columns}
    if filters:
        p = p.filter(group_filter(filters, reg))
    return p.groupBy(by).agg(F.count(F.lit(1)).alias("requests"))


def usage_records(lines: DataFrame, filters: dict[str, str], line_col: str = "line") -> DataFrame:
    """The fields of the single log lines in which all given fields have the given values."""
    p = lines.select(*parse_usage_line(line_col))
    return p.filter(group_filter(filters, {c: F.col(c) for c in p.columns})) if filters else p


# Tag texts that name an application, web-service method or message type.
LABEL_TAGS = ("Application = ", "ID_WSMethod = ", "ID_OFMsgType = ")


def application_label(texts: DataFrame, text: str, apps: DataFrame, ws: DataFrame, types: DataFrame) -> DataFrame:
    """Short label for a text tagged 'Application = n', 'ID_WSMethod = n' or 'ID_OFMsgType = n' (G13).

    The id is the number after the tag; each kind is looked up in its own
    small dimension (id, name).  A later tag in the list wins, as in the
    reference; unknown ids give '<kind> not found for <text>'.
    """
    out = texts
    label = F.lit(None).cast("string")
    for tag, dim, kind in zip(LABEL_TAGS, (apps, ws, types), ("Application", "WSMethod", "OFMessagetype")):
        idc = f"_id_{kind}"
        out = out.withColumn(idc, F.when(F.col(text).contains(tag), F.regexp_extract(text, tag.replace(" ", "\\s") + r"(\d+)", 1)
                                         .try_cast("bigint")))
        d = dim.select(F.col("id").alias(idc), F.col("name").alias(f"_n_{kind}"))
        out = out.join(d, idc, "left")
        label = F.when(F.col(idc).isNotNull() | F.col(text).contains(tag),
                       F.coalesce(F.col(f"_n_{kind}"), F.concat(F.lit(f"{kind} not found for "), F.col(text)))).otherwise(label)
    drop = [c for c in out.columns if c.startswith("_id_") or c.startswith("_n_")]
    return out.withColumn("short_info", label).drop(*drop)
