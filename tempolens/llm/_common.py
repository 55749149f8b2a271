"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session without that setting (tests, notebooks) gets a folder
    of its own; on a cluster the setting is required.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tempolens-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark context; Arrow batches are cut by bytes as well as rows."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_BYTES).lower().rstrip("b") == str(2**63 - 1):  # no limit is set: texts may be long
        spark.conf.set(_BATCH_BYTES, "8m")
    if not getattr(sc, "_tempolens_shipped", False):
        top = Path(__file__).resolve().parent.parent
        name = Path(tempfile.mkdtemp(prefix="tempolens-ship-")) / f"{top.name}.zip"
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(name))
        sc._tempolens_shipped = True


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tempolens-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The lineage ends at the files, so executors lost later cost no recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` made."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/tempolens-" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(*cols: str) -> Column:
    """Names a row by its content: equal rows share it, a null counts as a value.

    Derived from the row alone, so that recomputed tasks give the same key.
    """
    return F.xxhash64(*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols])


_KEPT: dict[str, object] = {}
#: malloc.h of glibc
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3


def kept(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task under ``name``.

    Workers serve one operator after another; the caches of others are let go,
    so their memory doesn't add up; blocks of a megabyte or more, Arrow's too,
    go back to the system as they are freed.
    """
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()
        if sys.platform == "linux":
            libc = ctypes.CDLL(None)
            libc.mallopt(_M_MMAP_THRESHOLD, 1 << 20)
            libc.mallopt(_M_TRIM_THRESHOLD, 1 << 20)
            libc.malloc_trim(0)
            pa.set_memory_pool(pa.system_memory_pool())
        _KEPT[name] = make()
    return _KEPT[name]


def utf8(arr: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(arr.type) else pa.binary()
    return arr.cast(kind).to_pylist()


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; the keys appear once (from the left)."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])
