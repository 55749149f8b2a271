"""Streaming operators S01-S05.

Each one keeps the batch operator's result on data that keeps arriving:

S01 tumbling load per dimension    watermark + window() + groupBy, update mode
S02 counter delta across batches   foreachBatch with a log of last values; or transformWithState
S03 usage log counts               text source, groupBy month, approx distinct users
S04 long transactions              watermark + session_window(), append mode
S05 SLA breaches                   stream-static join with the limit table + filter
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import nvl_text, seconds_between
from ..operators.counters import _reset_filter, counter_delta
from .runner import folder_numbers, remove_folder


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    # watermarks need TIMESTAMP (with time zone); the session runs in UTC
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_load_timeline(samples: DataFrame, dim: str, bucket_seconds: int = 3600, ts: str = "sample_time",
                         weight: str = "sample_cycle", watermark: str = "2 hours") -> DataFrame:
    """Active sessions per tumbling window and dimension value (S01, from B02).

    Same cells as ``load_timeline`` before the top-x cut (the ranking needs
    the whole range; run ``top_x_series`` on the sink).  Use update mode.
    """
    s = _event_time(samples, ts).withWatermark(ts, watermark)
    g = s.groupBy(F.window(ts, f"{bucket_seconds} seconds").alias("w"), nvl_text(F.col(dim)).alias("criteria")) \
        .agg(F.sum(weight).alias("_w"), F.max(weight).alias("_m"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start_sample"), "criteria",
                    F.round(F.col("_w") / F.greatest(F.col("_m"), F.lit(bucket_seconds)).cast("double"), 6)
                    .alias("diagram_value"))


def stream_counter_delta(stream: DataFrame, keys: list[str], order: str, counters: list[str], out_path: str,
                         state_path: str, cp_path: str, reset: str = "drop", compact_every: int = 16,
                         ts: str | None = None, ttl: str | None = None):
    """Counter deltas of a stream of cumulative samples (S02, from A01).

    Each micro-batch is unioned with the last rows of its own series from the
    state log, the batch operator computes the deltas, the carried rows are
    dropped and the reset rule applied.  A batch adds the last rows of the
    series it holds to the log (``state_log``); every ``compact_every`` batches
    the log becomes one table, without the series whose last row is older
    than ``ttl`` (an interval such as "30 days", measured on column ``ts``
    against the newest row); such a series starts anew if it comes back.
    Output and log are written under the batch id (overwrite), so a retried
    batch reproduces the same files.  Assumes every series arrives in order
    across batches; a missing part of the log is an error.
    """
    if ttl is not None and ts is None:
        raise ValueError("ttl needs the column ts")
    kept = list(dict.fromkeys([order, *counters, *([ts] if ts else [])]))

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, *kept).withColumn("_carry", F.lit(False)).persist()
        try:
            own, before = rows, state_log(spark, state_path, batch_id, keys, kept)
            if before is not None:
                here = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
                same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
                own = rows.unionByName(before.join(here, same, "left_semi").withColumn("_carry", F.lit(True)))
            d = counter_delta(own, keys, order, counters, reset="keep")
            out = _reset_filter(d.filter(~F.col("_carry")).select(*keys, order, *counters), counters[0], reset)
            out.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            _last_rows(rows, keys, kept).write.mode("overwrite").parquet(f"{state_path}/v={batch_id}")
        finally:
            rows.unpersist()
        if (batch_id + 1) % compact_every == 0:
            compact_log(spark, state_path, batch_id, keys, kept, ts, ttl)

    q = (stream.writeStream.option("checkpointLocation", cp_path).trigger(availableNow=True)
         .foreachBatch(process).start())
    return q


def _last_rows(rows: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """The row of the greatest first column of ``kept`` for each series."""
    g = rows.groupBy(*keys).agg(F.max(F.struct(*kept)).alias("_l"))
    return g.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in kept])


def state_log(spark: SparkSession, path: str, batch_id: int, keys: list[str], kept: list[str]) -> DataFrame | None:
    """The last row of every series before a batch: the newest whole table and the batches written after it."""
    full = max((n for n in folder_numbers(spark, path, "full") if n < batch_id), default=-1)
    parts = set(folder_numbers(spark, path, "v"))
    missing = [n for n in range(full + 1, batch_id) if n not in parts]
    if missing:
        raise FileNotFoundError(f"the state of batch {missing[0]} is missing below {path}")
    folders = [f"{path}/full={full}"] * (full >= 0) + [f"{path}/v={n}" for n in range(full + 1, batch_id)]
    if not folders:
        return None
    rows = spark.read.parquet(*folders).select(*keys, *kept)
    return rows if len(folders) == 1 else _last_rows(rows, keys, kept)


def compact_log(spark: SparkSession, path: str, batch_id: int, keys: list[str], kept: list[str],
                ts: str | None = None, ttl: str | None = None) -> None:
    """Write the log up to a batch as one table; what is older than the previous table goes (a retry needs the rest)."""
    rows = state_log(spark, path, batch_id + 1, keys, kept)
    previous = max((n for n in folder_numbers(spark, path, "full") if n < batch_id), default=-1)
    if ttl is not None:
        newest = rows.agg(F.max(ts)).first()[0]
        rows = rows.where(F.col(ts).isNull() | (F.col(ts) >= F.lit(newest) - F.expr(f"INTERVAL {ttl}")))
    rows.write.mode("overwrite").parquet(f"{path}/full={batch_id}")
    for kind, last in (("full", previous - 1), ("v", previous)):
        for n in folder_numbers(spark, path, kind):
            if n <= last:
                remove_folder(spark, f"{path}/{kind}={n}")


def parse_usage_line(line: Column | str) -> list[Column]:
    """Fields of a blank-separated usage log line: ip, database, month, controller, action, id."""
    parts = F.split(F.col(line) if isinstance(line, str) else line, " ")
    names = ["ip", "db", "month", "controller", "action", "request_id"]
    return [parts[i].alias(n) for i, n in enumerate(names)]


def stream_usage_counts(lines: DataFrame, line_col: str = "value", rsd: float = 0.01) -> DataFrame:
    """Requests and approximate distinct users per month from log lines (S03, from G12).

    Exact distinct counts are not supported on streams; HyperLogLog++
    sketches are.  Use complete mode (one row per month).
    """
    p = lines.select(*parse_usage_line(line_col))
    return p.groupBy("month").agg(F.count(F.lit(1)).alias("requests"),
                                  F.approx_count_distinct("ip", rsd).alias("users"),
                                  F.approx_count_distinct("db", rsd).alias("databases"))


def stream_long_transactions(samples: DataFrame, key: str = "xid", ts: str = "sample_time",
                             gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Activity of a transaction grouped until it is idle for ``gap`` (S04, from R70).

    Append mode: a transaction is emitted once the watermark passes its end.
    When the input is over, ``end_marker`` rows push the watermark past all of it.
    """
    s = _event_time(samples.filter(F.col(key).isNotNull()), ts).withWatermark(ts, watermark)
    g = s.groupBy(F.session_window(ts, gap).alias("sw"), key).agg(
        F.count(F.lit(1)).alias("samples"), F.min(ts).alias("first_sample"), F.max(ts).alias("last_sample"),
        F.max(F.col(key) == END_OF_INPUT).alias("marker"))
    # tested on the aggregate: a filter on the key would be pushed below the watermark, which must see the marker
    g = g.filter(~F.col("marker"))
    return g.select(key, F.col("sw.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("sw.end").cast("timestamp_ntz").alias("session_end"), "samples",
                    F.round(seconds_between("first_sample", "last_sample"), 3).alias("duration_secs"))


END_OF_INPUT = "(end of input)"


def end_marker(samples: DataFrame, key: str = "xid", ts: str = "sample_time", days: int = 2) -> DataFrame:
    """One row, ``days`` after the newest sample, that moves a session stream's watermark past all sessions.

    The watermark of one micro-batch closes sessions in the next, so a finite
    input ends with two markers, one later than the other, in chunks of their
    own; their key is left out of the result.
    """
    row = samples.agg((F.max(ts) + F.expr(f"INTERVAL {days} DAYS")).cast(samples.schema[ts].dataType).alias(ts))
    return row.where(F.col(ts).isNotNull()).select(*[F.lit(END_OF_INPUT).alias(c) if c == key else F.col(ts) if c == ts
                                                    else F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in samples.columns])


def stream_sla_breaches(messages: DataFrame, limits: DataFrame, as_of, key: str = "id_messagetype",
                        created: str = "creation_time", warning: str = "warning_secs",
                        alert: str = "alert_secs") -> DataFrame:
    """Open messages older than their type's warning / alert limit at ``as_of`` (S05, from G02/G03).

    Stream-static inner join on the message type (the limit table is a
    small dimension); stateless, append mode.
    """
    age = seconds_between(F.col(created), F.lit(as_of).cast("timestamp_ntz"))
    j = messages.join(limits, key, "inner").withColumn("age_secs", F.round(age, 3))
    level = F.when(F.col("age_secs") > F.col(alert), F.lit("ALERT")) \
        .when(F.col("age_secs") > F.col(warning), F.lit("WARNING"))
    return j.withColumn("level", level).filter(F.col("level").isNotNull())


class _SeriesDelta(StatefulProcessor):
    """The last row of a series in the state store; new rows become differences to the row before."""

    def __init__(self, keys: list[str], order: str, counters: list[str], state_schema: StructType, ttl_ms: int | None):
        self.order, self.counters, self.schema, self.ttl_ms = order, counters, state_schema, ttl_ms
        self.row = Row(*keys, order, *counters)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        before = self.last.get() if self.last.exists() else None
        now = sorted(([r[self.order], *[r[c] for c in self.counters]] for r in rows), key=lambda r: (r[0] is not None, r[0]))
        old = before[1:] if before is not None else now[0][1:]
        for r in now:
            yield self.row(*key, r[0], *[None if v is None or o is None else v - o for v, o in zip(r[1:], old)])
            old = r[1:]
        self.last.update(tuple(now[-1]))

    def close(self) -> None:
        pass


def stream_counter_delta_stateful(stream: DataFrame, keys: list[str], order: str, counters: list[str],
                                  reset: str = "drop", ttl_hours: float | None = 24 * 31) -> DataFrame:
    """Counter deltas of a stream with the last value per series kept in the state store (S02, per-key state).

    Streaming has no ``lag``; ``transformWithState`` keeps, per series, the
    (order, counters) of the last row seen.  A series without new rows for
    ``ttl_hours`` of processing time (None: never) is removed from the store,
    so ended series do not stay; one that comes back later starts anew.  Each
    micro-batch hands over the new rows of one series, which arrive in order
    across batches.  Null counters give null differences.  Run it with the
    RocksDB state store (``run_available_now(..., state_store=ROCKSDB)``).
    """
    fields = {f.name: f.dataType for f in stream.schema}
    out_schema = StructType([StructField(k, fields[k]) for k in keys] + [StructField(order, fields[order])] +
                            [StructField(c, LongType()) for c in counters])
    state_schema = StructType([StructField("last_order", fields[order])] + [StructField(f"last_{c}", LongType()) for c in counters])
    ttl_ms = None if ttl_hours is None else int(ttl_hours * 3_600_000)
    src = stream.select(*keys, order, *[F.col(c).cast("long").alias(c) for c in counters])
    res = src.groupBy(*keys).transformWithState(_SeriesDelta(keys, order, counters, state_schema, ttl_ms), out_schema, "append",
                                                "None" if ttl_ms is None else "ProcessingTime")
    return _reset_filter(res, counters[0], reset)
