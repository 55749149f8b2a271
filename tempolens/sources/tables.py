"""Loading the parquet tables and registering them as temp views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare_session

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# session id -> sf_dir currently registered
_REGISTERED: dict[int, str] = {}


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    """Register every base table of ``sf_dir`` as a temp view (idempotent).

    Views are lazy: nothing is scanned here, only the parquet footers are
    listed.  Column pruning and filters of later queries reach the scan.
    """
    key = id(spark)
    if _REGISTERED.get(key) == sf_dir and spark.catalog.tableExists("lineitem"):
        return
    prepare_session(spark)
    for name in TABLES:
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").createOrReplaceTempView(name)
    _REGISTERED[key] = sf_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_tables(spark, sf_dir)
    return spark.table(name)
