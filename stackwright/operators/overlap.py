"""Overlaps between lists of items: shares, containment, own contributions, greedy cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwright.sources.shared import stored


def pair_overlaps(members: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, both, jaccard, a_in_b, b_in_a) for groups a < b that share an item.

    Pairs come from shared items; the groups of an item are few, so no pair of all groups is formed.
    """
    m = members.select(group, item).distinct()
    size = m.groupBy(group).agg(F.count("*").alias("n"))
    a, b = m.select(F.col(group).alias("a"), item), m.select(F.col(group).alias("b"), item)
    both = a.join(b, item).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = both.join(size.select(F.col(group).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(group).alias("b"), F.col("n").alias("nb")), "b")
    r = lambda x: F.round(x, 6)
    return out.select("a", "b", "both", r(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"), r(F.col("both") / F.col("na")).alias("a_in_b"), r(F.col("both") / F.col("nb")).alias("b_in_a"))


def own_contributions(members: DataFrame, target: DataFrame, group: str, item: str) -> DataFrame:
    """Per group: items of the target set that no other group has; groups without any have 0."""
    m = members.select(group, item).distinct()
    single = m.groupBy(item).agg(F.count("*").alias("n"), F.min(group).alias(group)).filter("n = 1").join(target.select(item).distinct(), item, "left_semi")
    own = single.groupBy(group).agg(F.count("*").alias("own"))
    return m.select(group).distinct().join(own, group, "left").select(group, F.coalesce("own", F.lit(0)).alias("own"))


def greedy_cover(members: DataFrame, group: str, item: str, steps: int) -> DataFrame:
    """(place, group, gain): groups in the order of most new items (ties by name); stops without gain.

    A step is one small aggregate; what is left after it is written to the shared folder, so that no plan grows.
    """
    spark = members.sparkSession
    left, out = stored(members.select(group, item).distinct(), "cover"), []
    for place in range(1, steps + 1):
        best = left.groupBy(group).agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), group).first()
        if best is None:
            break
        out.append((place, best[group], best.gain))
        left = stored(left.join(left.filter(F.col(group) == best[group]).select(item), item, "left_anti").select(group, item), "cover")
    kind = dict(members.dtypes)[group]
    return spark.createDataFrame(out, f"place int, {group} {kind}, gain long")
