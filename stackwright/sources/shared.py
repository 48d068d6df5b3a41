"""Folders that the driver and all executors share, and tables stored there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse on a cluster without one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and (sc.master == "local" or sc.master.startswith("local[")):
        base = "file://" + tempfile.mkdtemp(prefix="stackwright-")
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stackwright"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet and read again: it is made once, and plans that use it several times stay small."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
