"""Linking outside records to a catalog: by number, by blocked names, with a score and a margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackwright.sources.shared import stored


def block_join(left: DataFrame, right: DataFrame, keys: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs that share a blocking key, once each; ``keys`` is an array column on both sides."""
    a = left.withColumn("key_", F.explode(F.array_distinct(keys))).drop(keys)
    b = right.withColumn("key_", F.explode(F.array_distinct(keys))).drop(keys)
    return a.join(b, "key_").dropDuplicates([left_id, right_id]).drop("key_")


def overlay(base: DataFrame, sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """The first non-null value along a cascade of sources."""
    out = base
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col(value).alias(f"v{i}_")), key, "left")
    tried = [F.col(f"v{i}_") for i in range(len(sources))]
    return out.select(*base.columns, F.coalesce(*tried).alias(value))


def consolidate(left: DataFrame, right: DataFrame, key: str, left_flag: str, right_flag: str, numbers: list[str]) -> DataFrame:
    """Full outer join with a flag for either side; missing numbers become 0."""
    a, b = left.withColumn("in_a_", F.lit(True)), right.withColumn("in_b_", F.lit(True))
    out = a.join(b, key, "full")
    cols = [F.coalesce(c, F.lit(0)).alias(c) if c in numbers else F.col(c) for c in out.columns if c not in ("in_a_", "in_b_")]
    return out.select(*cols, F.col("in_a_").isNotNull().alias(left_flag), F.col("in_b_").isNotNull().alias(right_flag))


def decide(scores: DataFrame, query: str, candidate: str, score: str, threshold: float = 90, margin: float = 8, many: str | None = None) -> DataFrame:
    """query, best candidate, its score, the gap to the next candidate and a decision.

    A candidate's best row counts.  Without a second candidate the gap is null and passes.  With ``many`` a row stands
    for so many candidates of that score, the first of which it names.
    """
    best = scores.groupBy(query, candidate).agg(F.max(score).alias("score"), *([F.max_by(many, score).alias("many_")] if many else []))
    w = Window.partitionBy(query).orderBy(F.desc("score"), candidate)
    after = F.lead("score").over(w)
    top = best.withColumn("n_", F.row_number().over(w)).withColumn("next_", F.when(F.col("many_") > 1, F.col("score")).otherwise(after) if many else after).filter("n_ = 1")
    gap = F.col("score") - F.col("next_")
    decision = F.when(F.col("score") < threshold, "rejected").when(gap.isNull() | (gap >= margin), "accepted").otherwise("ambiguous")
    return top.select(query, candidate, "score", gap.alias("margin"), decision.alias("decision"))


def shelf_score(rating: Column, ratings: Column, lists: Column, editions: Column) -> Column:
    """0.05 rating/5 + 0.60 log10(ratings + 1)/6 (uncapped) + 0.20 and 0.15 of two shares capped at 1."""
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    cap = lambda x: F.least(F.lit(1.0), x)
    return 0.05 * cap(zero(rating) / 5) + 0.60 * F.log10(zero(ratings) + 1) / 6 + 0.20 * cap(zero(lists) / 10) + 0.15 * cap(zero(editions) / 50)


def rerank(rows: DataFrame, blend: Column, old_rank: str, key: str, rank: str = "new_rank") -> DataFrame:
    """Rows by falling blend, then old rank, then key, numbered from 1.

    The blend is stored first: sums of doubles can differ in their last bits each time they are made, and the
    ranks read it several times.
    """
    from .etl import ranked

    scored = stored(rows.withColumn("blend", blend), "blended")
    order = scored.withColumn("order_", F.struct((-F.col("blend")).alias("b"), F.col(old_rank).alias("o"), F.col(key).alias("k"))).withColumn("zero_", F.lit(0))
    return ranked(order, "order_", "zero_", rank).drop("order_", "zero_")
