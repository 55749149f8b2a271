"""IO history reports (C12-C15): file IO, IO by function, IO by file type.

Cumulative IO counters per (instance, key, snapshot) become deltas (A01),
the first snapshot of every instance is dropped (A03), and the deltas are
grouped by a chosen dimension (A17), listed per snapshot, or turned into a
top-x timeline on minute-rounded snapshot times (A10, A18).  Derived
measures come from a registry of Column definitions with guarded division
(C15).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import round_time, safe_div, seconds_between
from ..operators.counters import counter_delta, drop_first_snapshot
from ..operators.series import top_x_series

INST = ["dbid", "instance_number"]
IO_COUNTERS = ["phyrds", "phywrts", "readtim", "phyblkrd"]


def io_measures(interval_secs: Column | None = None) -> dict[str, Column]:
    """Derived IO measures over summed deltas (C15); read time in centiseconds."""
    m = {
        "ms_per_read": F.round(safe_div(F.col("readtim") * 10, "phyrds"), 4),
        "blocks_per_read": F.round(safe_div("phyblkrd", "phyrds"), 4),
        "reads_per_write": F.round(safe_div("phyrds", "phywrts"), 4),
        "read_share_pct": F.round(safe_div(F.col("phyrds") * 100.0, F.col("phyrds") + F.col("phywrts")), 4),
    }
    if interval_secs is not None:
        m["reads_per_sec"] = F.round(safe_div("phyrds", interval_secs), 4)
        m["writes_per_sec"] = F.round(safe_div("phywrts", interval_secs), 4)
    return m


def io_deltas(data: DataFrame, temp: DataFrame | None, keys: list[str], counters=IO_COUNTERS,
              reset: str = "keep") -> DataFrame:
    """Data-file and temp-file counters unioned, turned into deltas, first snapshot dropped.

    Deltas after a restart stay as they are (negative) unless ``reset`` says otherwise.
    """
    f = data if temp is None else data.unionByName(temp)
    d = counter_delta(f, INST + keys, "snap_id", list(counters), reset=reset)
    return drop_first_snapshot(d, INST, "snap_id")


def io_grouping(deltas: DataFrame, by: str) -> DataFrame:
    """Summed deltas and derived measures per value of one dimension (C12-C14 grouping)."""
    g = deltas.groupBy(by).agg(*[F.sum(c).alias(c) for c in IO_COUNTERS],
                               F.count_distinct("snap_id").alias("snapshots"))
    return g.select("*", *[v.alias(k) for k, v in io_measures().items()])


def io_samples(deltas: DataFrame, snaps: DataFrame) -> DataFrame:
    """Deltas per snapshot with interval times and per-second rates (C12-C14 samples)."""
    j = deltas.join(snaps.select(*INST, "snap_id", "begin_interval_time", "end_interval_time"), INST + ["snap_id"], "inner")
    secs = seconds_between("begin_interval_time", "end_interval_time")
    j = j.withColumn("interval_secs", secs)
    return j.select("*", *[v.alias(k) for k, v in io_measures(F.col("interval_secs")).items()]) \
            .withColumn("begin_interval_time", F.col("begin_interval_time").cast("timestamp_ntz")) \
            .withColumn("end_interval_time", F.col("end_interval_time").cast("timestamp_ntz"))


def io_timeline(deltas: DataFrame, snaps: DataFrame, by: str, measure: str = "phyrds", top_x: int = 20) -> DataFrame:
    """Top-x curves of one measure by a dimension over minute-rounded snapshot times (C12-C14 timeline)."""
    j = deltas.join(snaps.select(*INST, "snap_id", "end_interval_time"), INST + ["snap_id"], "inner")
    cells = j.groupBy(round_time("end_interval_time", "MI").alias("rounded_time"), F.col(by).cast("string").alias("curve")) \
        .agg(*[F.sum(c).alias(c) for c in IO_COUNTERS])
    reg = io_measures()
    value = reg[measure] if measure in reg else F.col(measure)
    cells = cells.select("rounded_time", "curve", value.cast("double").alias("value"))
    return top_x_series(cells.na.fill(0.0, ["value"]), "rounded_time", "curve", "value", top_x)


# ----------------------------------------------------------------------------------------------
# Full reports of the three sources: files, functions, file types.
FILE_COUNTERS = ["phyrds", "phyblkrd", "readtim", "phywrts", "phyblkwrt", "writetim", "singleblkrds", "singleblkrdtim"]
SIZES = [f"{size}_{way}" for size in ("small", "large") for way in ("read", "write")]
FUNCTION_COUNTERS = [f"{s}_{what}" for what in ("megabytes", "reqs") for s in SIZES] + ["number_of_waits", "wait_time"]
FILETYPE_COUNTERS = [f"{s}_{what}" for what in ("megabytes", "reqs", "servicetime") for s in SIZES] + [
    "small_sync_read_reqs", "small_sync_read_latency", "retries_on_error"]


def file_measures(secs: Column) -> dict[str, Column]:
    """The measures of file IO; times are centiseconds, ``secs`` is the length of the period."""
    reads, writes, single = F.col("phyrds"), F.col("phywrts"), F.col("singleblkrds")
    return {
        "ms_per_read": safe_div(F.col("readtim") * 10, reads), "blocks_per_read": safe_div("phyblkrd", reads),
        "ms_per_write": safe_div(F.col("writetim") * 10, writes), "blocks_per_write": safe_div("phyblkwrt", writes),
        "ms_per_single_read": safe_div(F.col("singleblkrdtim") * 10, single),
        "blocks_per_multi_read": safe_div(F.col("phyblkrd") - single, reads - single),
        "io_per_sec": safe_div(reads + writes, secs), "reads_per_sec": safe_div(reads, secs), "writes_per_sec": safe_div(writes, secs),
    }


def function_measures(secs: Column) -> dict[str, Column]:
    """The measures of IO by function: rates, and the load of waiting sessions (wait time in ms)."""
    return {**{f"{s}_mb_per_sec": safe_div(f"{s}_megabytes", secs) for s in SIZES},
            **{f"{s}_reqs_per_sec": safe_div(f"{s}_reqs", secs) for s in SIZES},
            "waits_per_sec": safe_div("number_of_waits", secs), "waiting_sessions": safe_div(F.col("wait_time") / 1000, secs)}


def filetype_measures(secs: Column) -> dict[str, Column]:
    """The measures of IO by file type: rates, load of sessions and latency (service times in ms)."""
    return {**{f"{s}_mb_per_sec": safe_div(f"{s}_megabytes", secs) for s in SIZES},
            **{f"{s}_reqs_per_sec": safe_div(f"{s}_reqs", secs) for s in SIZES},
            "small_sync_read_reqs_per_sec": safe_div("small_sync_read_reqs", secs),
            **{f"{s}_load": safe_div(F.col(f"{s}_servicetime") / 1000, secs) for s in SIZES},
            **{f"{s}_latency_ms": safe_div(f"{s}_servicetime", f"{s}_reqs") for s in SIZES},
            "small_sync_read_latency_ms": safe_div("small_sync_read_latency", "small_sync_read_reqs")}


IO_SOURCES = {"file": (FILE_COUNTERS, file_measures), "function": (FUNCTION_COUNTERS, function_measures),
              "filetype": (FILETYPE_COUNTERS, filetype_measures)}


def _with_times(deltas: DataFrame, snaps: DataFrame) -> DataFrame:
    s = snaps.select(*INST, "snap_id", F.col("begin_interval_time").cast("timestamp_ntz").alias("begin_interval_time"),
                     F.col("end_interval_time").cast("timestamp_ntz").alias("end_interval_time"))
    return deltas.join(s, [*INST, "snap_id"], "inner")


def _report(deltas: DataFrame, snaps: DataFrame, source: str, by: list[str], extra: list[Column], secs: Column) -> DataFrame:
    counters, measures = IO_SOURCES[source]
    g = _with_times(deltas, snaps).groupBy(*by).agg(*[F.sum(c).alias(c) for c in counters], *extra, secs.alias("sample_secs"))
    return g.select("*", *[F.round(v, 4).alias(k) for k, v in measures(F.col("sample_secs")).items()])


def io_report(deltas: DataFrame, snaps: DataFrame, source: str, by: str) -> DataFrame:
    """All measures of a source per value of one dimension, over the whole period (C12-C15 grouping)."""
    return _report(deltas, snaps, source, [by], [F.count_distinct("snap_id").alias("samples")],
                   seconds_between(F.min("begin_interval_time"), F.max("end_interval_time")))


def io_report_samples(deltas: DataFrame, snaps: DataFrame, source: str) -> DataFrame:
    """All measures of a source per minute-rounded sample (C12-C15 samples)."""
    timed = snaps.withColumn("rounded_begin", round_time(F.col("begin_interval_time").cast("timestamp_ntz"), "MI"))
    counters, measures = IO_SOURCES[source]
    s = timed.select(*INST, "snap_id", "rounded_begin", F.col("begin_interval_time").cast("timestamp_ntz").alias("begin_interval_time"),
                     F.col("end_interval_time").cast("timestamp_ntz").alias("end_interval_time"))
    g = deltas.join(s, [*INST, "snap_id"], "inner").groupBy("rounded_begin").agg(
        *[F.sum(c).alias(c) for c in counters],
        seconds_between(F.min("begin_interval_time"), F.min("end_interval_time")).alias("sample_secs"))
    return g.select("*", *[F.round(v, 4).alias(k) for k, v in measures(F.col("sample_secs")).items()])


def io_report_timeline(deltas: DataFrame, snaps: DataFrame, source: str, by: str, measure: str, top_x: int = 20) -> DataFrame:
    """Top-x curves of any counter or measure of a source by a dimension (C12-C15 timeline)."""
    counters, measures = IO_SOURCES[source]
    j = _with_times(deltas, snaps)
    cells = j.groupBy(round_time("begin_interval_time", "MI").alias("rounded_time"), F.col(by).cast("string").alias("curve")).agg(
        *[F.sum(c).alias(c) for c in counters],
        seconds_between(F.min("begin_interval_time"), F.min("end_interval_time")).alias("sample_secs"))
    value = measures(F.col("sample_secs")).get(measure)
    value = F.col(measure) if value is None else value
    cells = cells.select("rounded_time", "curve", F.round(value.cast("double"), 6).alias("value"))
    return top_x_series(cells.na.fill(0.0, ["value"]), "rounded_time", "curve", "value", top_x)
