"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names.  Where that is unset, a local session gets a temporary
    folder and a cluster a folder below the warehouse, never one of a single machine.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return str(held.get())
        if sc.master.startswith("local[") or sc.master == "local":
            where = "file://" + tempfile.mkdtemp(prefix="stackwright-")
        else:
            where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stackwright"
        sc.setCheckpointDir(where)
        return where
    return where


def scratch(spark: SparkSession, what: str) -> str:
    """A new, not yet existing folder for one run of one operator, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a shared path and the path within it."""
    if "://" not in uri:
        uri = ("" if uri.startswith("file:") else "file:") + uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of an operator's own that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no frame refers to any more, before more are written, and gives the driver's
    garbage back: its heap else grows to its limit over the many small queries of an operator that works in rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go as soon as it ends, where Spark can do that; frames that are written then
    and read back lose nothing by it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if before is not None:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(key, before)


def stored(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there."""
    path = path or scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
