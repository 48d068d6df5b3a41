"""Writers: JSON lines, sorted ids, CSV, and a manifest of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_gz(rows: DataFrame, path: str) -> int:
    """Gzip JSON lines; returns the number of rows written."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)
    return rows.sparkSession.read.text(path).count()


def sorted_ids(rows: DataFrame, key: str, path: str) -> None:
    """Distinct ids in order, a line each, ranged over files."""
    rows.select(key).distinct().orderBy(key).select(F.col(key).cast("string").alias("value")).write.mode("overwrite").text(path)


def csv_catalog(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def manifest(rows: DataFrame, counts: dict[str, str]) -> DataFrame:
    """One row of named counts: SQL conditions to their numbers of rows."""
    return rows.agg(*(F.count_if(F.expr(c)).alias(k) for k, c in counts.items()))
