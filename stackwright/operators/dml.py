"""Table changes as frames: what an update, insert or delete would leave; counts of what it would touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_column_if_absent(table: DataFrame, name: str, kind: str) -> DataFrame:
    """ALTER TABLE ADD COLUMN, once."""
    return table if name in table.columns else table.withColumn(name, F.lit(None).cast(kind))


def set_from(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """UPDATE ... SET column = value WHERE key matches; other rows keep theirs."""
    new = values.select(key, F.col(column).alias("new_"), F.lit(True).alias("hit_"))
    out = table.join(new, key, "left")
    return out.select(*(F.when(F.col("hit_"), F.col("new_")).otherwise(F.col(column)).alias(column) if c == column else F.col(c) for c in table.columns))


def language_set(codes: Column) -> Column:
    """Distinct codes in order, without a path before them, in lower case; blanks drop out."""
    one = lambda c: F.substring_index(F.lower(F.trim(c)), "/", -1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(codes, one), lambda c: c != "")))


def pruned(books: DataFrame, isbns: DataFrame, languages: str, allowed: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Books in an allowed language (a comma-joined column), and the numbers of books that are left."""
    kept = books.filter(F.arrays_overlap(F.split(languages, ","), F.array(*map(F.lit, allowed))))
    return kept, isbns.join(kept.select(key).distinct(), key, "left_semi")


def gap_filled(books: DataFrame, unmatched: DataFrame, least: int, rank: int, key: str) -> DataFrame:
    """Books and a row for each unmatched one with enough ratings: a key of its own, a placeholder rank, no editions."""
    popular = unmatched.filter(F.col("ratings") >= least)
    new = popular.select(F.concat(F.lit("gap:"), F.col("book_id").cast("string")).alias(key), "title", "author", F.lit(rank).alias("popularity_rank"), F.lit(0).alias("editions"))
    return books.select(key, "title", "author", "popularity_rank", "editions").unionByName(new)


def enriched(output: DataFrame, full: DataFrame, key: str, guard: str) -> DataFrame:
    """popularity_rank and editions of ``output`` from the least and most of ``full``; keys with a guarded prefix stay."""
    best = full.groupBy(key).agg(F.min("popularity_rank").alias("rank_"), F.max("editions").alias("editions_"))
    own = ~F.col(key).startswith(guard)
    out = output.join(best, key, "left")
    pick = {"popularity_rank": F.when(own, F.col("rank_")).otherwise(F.col("popularity_rank")), "editions": F.when(own, F.coalesce("editions_", "editions")).otherwise(F.col("editions"))}
    return out.select(*(pick.get(c, F.col(c)).alias(c) for c in output.columns))


def touched(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: rows before and after, keys that went and that came."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    gone, new = a.join(b, key, "left_anti").agg(F.count("*").alias("deleted")), b.join(a, key, "left_anti").agg(F.count("*").alias("inserted"))
    return before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after"))).crossJoin(gone).crossJoin(new)
