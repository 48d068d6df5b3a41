"""Evaluation: rank correlation, overlaps, confusion, distributions, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(rows: DataFrame, value: str, rank: str, key: str) -> DataFrame:
    """(key, rank): ranks by rising value, ties at their mean; distinct values are ranked, not rows."""
    from .etl import running_totals

    per = rows.groupBy(value).agg(F.count("*").alias("n_"))
    # A value's first rank is one more than the rows below it: prefix sums over the distinct values.
    first = running_totals(per, [value], F.col("n_"), "below_")
    return rows.join(first, value).select(key, (F.col("below_") + (F.col("n_") + 1) / 2).alias(rank))


def spearman(rows: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """n and rho; 0 below two rows or without variance."""
    ra, rb = average_ranks(rows, a, "ra_", key), average_ranks(rows, b, "rb_", key)
    rho = F.coalesce(F.nanvl(F.corr("ra_", "rb_"), F.lit(0.0)), F.lit(0.0))
    return ra.join(rb, key).agg(F.count("*").alias("n"), F.round(rho, 6).alias("rho"))


def top_overlap(rows: DataFrame, a: str, b: str, key: str, k: int) -> DataFrame:
    """The share of the k best by b that are among the k best by a."""
    top = lambda c: rows.orderBy(F.desc(c), key).limit(k).select(key)
    both = top(a).join(top(b), key).agg(F.count("*").alias("both"))
    size = top(b).agg(F.count("*").alias("size"))
    return both.crossJoin(size).select("both", "size", F.round(F.col("both") / F.greatest("size", F.lit(1)), 6).alias("overlap"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall; both columns boolean, null as false."""
    t, p = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(predicted), F.lit(False))
    n = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0)), 6)
    return n.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def distribution_delta(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, a, b, delta): group counts side by side; null is a key."""
    x = a.groupBy(key).agg(F.count("*").alias("a"))
    y = b.groupBy(F.col(key).alias("key_b")).agg(F.count("*").alias("b"))
    out = x.join(y, F.col(key).eqNullSafe(F.col("key_b")), "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(F.coalesce(key, "key_b").alias(key), zero("a").alias("a"), zero("b").alias("b"), (zero("b") - zero("a")).alias("delta"))


def deciles(rows: DataFrame, order: list, key: str) -> DataFrame:
    """Decile by chunks of ceil(n / 10) rows, so that there can be fewer than ten."""
    total = rows.agg(F.ceil(F.count("*") / 10).alias("chunk_"))
    from .etl import ranked

    keyed = rows.withColumn("order_", F.struct(*order)).withColumn("zero_", F.lit(0))
    return ranked(keyed, "order_", "zero_", "place").crossJoin(F.broadcast(total)).withColumn("decile", F.floor((F.col("place") - 1) / F.col("chunk_")).cast("int")).drop("order_", "zero_", "chunk_")


def gate(baseline: DataFrame, candidate: DataFrame, not_down: list[str], not_up: list[str]) -> DataFrame:
    """passed and all reasons, from two one-row tables of metrics."""
    both = baseline.select(*(F.col(c).alias(f"b_{c}") for c in not_down + not_up)).crossJoin(candidate.select(*(F.col(c).alias(f"c_{c}") for c in not_down + not_up)))
    why = [F.when(F.col(f"c_{c}") < F.col(f"b_{c}") - 1e-9, F.lit(f"{c} fell")) for c in not_down] + [F.when(F.col(f"c_{c}") > F.col(f"b_{c}") + 1e-9, F.lit(f"{c} rose")) for c in not_up]
    reasons = F.array_compact(F.array(*why))
    return both.select((F.size(reasons) == 0).alias("passed"), F.array_join(reasons, "; ").alias("reasons"))
