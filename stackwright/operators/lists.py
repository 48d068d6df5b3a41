"""Popularity from list pages, and reports on lists that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackwright.functions import text as tx

from .overlap import pair_overlaps

#: The parallel arrays of a page, and those that popularity needs.
ARRAYS = ["book_urls", "titles", "authors", "rating_texts", "score_texts", "vote_texts"]
SHORT_ARRAYS = ["book_urls", "rating_texts", "score_texts", "vote_texts"]


def rating(text: Column) -> Column:
    """struct(average, ratings) of ``4.55 avg rating — 745,415 ratings``; null where absent."""
    mean = F.regexp_extract(text, r"([\d.]+) avg rating", 1).try_cast("double")
    return F.struct(mean.alias("average"), tx.number_in(text, r"([\d,]+) ratings?\b").alias("ratings"))


def entries(rows: DataFrame, *keep: str) -> DataFrame:
    """book_id, average, ratings, score, votes of zipped rows; rows without a book id drop out."""
    known = rows.withColumn("book_id", tx.path_id("book_urls")).withColumn("r_", rating(F.col("rating_texts")))
    return known.filter("book_id is not null").select(*keep, "book_id", "r_.average", "r_.ratings", tx.number_in("score_texts", r"score: ([\d,]+)").alias("score"), tx.number_in("vote_texts", r"([\d,]+) (?:people|person) voted").alias("votes"))


def merged_books(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A book over all lists: appearances, sums, all genres, and the first rating that is not null, by ``order``."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return rows.groupBy(key).agg(F.count("*").alias("appearances"), zero("score").alias("score"), zero("votes").alias("votes"), F.array_sort(F.collect_set("genre")).alias("genres"), first("average"), first("ratings"))


def popularity(rows: DataFrame, key: str) -> DataFrame:
    """Most ratings, appearances, sums of scores and votes; absent numbers count 0."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy(key).agg(F.max(n("ratings")).alias("ratings"), F.count("*").alias("appearances"), F.sum(n("score")).alias("score"), F.sum(n("votes")).alias("votes"))


def popularity_order(key: str) -> list[Column]:
    return [F.desc("ratings"), F.desc("appearances"), F.desc("score"), F.asc(key)]


def corpus_report(members: DataFrame, top: DataFrame, group: str, item: str) -> DataFrame:
    """One row: lists, distinct items, and how many of the top items some list holds."""
    seen = members.select(item).distinct()
    covered = top.select(item).distinct().join(seen, item, "left_semi").agg(F.count("*").alias("top_covered"))
    return members.agg(F.countDistinct(group).alias("lists"), F.countDistinct(item).alias("items")).crossJoin(F.broadcast(covered))


def advice(members: DataFrame, own: DataFrame, anchors: list[str], group: str, item: str, inside: float = 0.7, alike: float = 0.35, gain: int = 50) -> DataFrame:
    """(list, advice): keep anchors; drop what is mostly inside another list, or much like one and adds little.

    ``own``: (group, own), the items that only this list adds.
    """
    p = pair_overlaps(members, group, item)
    both = p.select(F.col("a").alias(group), F.col("a_in_b").alias("inside"), "jaccard").unionByName(p.select(F.col("b").alias(group), F.col("b_in_a").alias("inside"), "jaccard"))
    most = both.groupBy(group).agg(F.max("inside").alias("inside"), F.max("jaccard").alias("jaccard"))
    out = members.select(group).distinct().join(most, group, "left").join(own, group, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    rule = F.when(F.col(group).isin(anchors), "anchor").when(n("inside") > inside, "subset").when((n("jaccard") > alike) & (n("own") < gain), "redundant").otherwise("keep")
    return out.select(group, F.round(n("inside"), 6).alias("inside"), F.round(n("jaccard"), 6).alias("jaccard"), n("own").alias("own"), rule.alias("advice"))


def genre_tags(lists: DataFrame, genre: str, list_id: str, label: str) -> DataFrame:
    """The first list of each genre, with its label or the genre in title case."""
    w = Window.partitionBy(genre).orderBy(list_id)
    first = lists.withColumn("n_", F.row_number().over(w)).filter("n_ = 1")
    return first.select(genre, list_id, F.coalesce(label, F.initcap(F.replace(genre, F.lit("_"), F.lit(" ")))).alias(label))
