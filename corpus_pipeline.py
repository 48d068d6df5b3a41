"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the stage before
it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm import decontaminate, jaccard_join, pieces, pii, toxicity
from stackwright.llm.common import dropped, scratch, table

# Near duplicates in the pipeline: five words and a similarity of 0.8.
WORDS, NUM, DEN = 5, 80, 100

#: The network and the sentence pieces have no SQL form; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold.  Labels teach from rows of ``docs`` that are not held out."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies; rows without a doc_id stay.

    Rows that share a doc_id are one document here: they stay or go together.
    """
    groups = jaccard_join.jaccard_components(docs, WORDS, NUM, DEN)
    gone = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone_")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_"], "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into which no benchmark item leaks."""
    return decontaminate.drop_leaks(docs, decontaminate.prepare(docs, table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in the text masked by its kind; n_chars follows the text."""
    return pii.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the text's pieces, with their count and checksum."""
    return pieces.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next; a stage's rows go with its last reader."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"pipeline-{name}")
        out.write.option("compression", "zstd").parquet(path)
        if last:
            dropped(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
