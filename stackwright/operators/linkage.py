"""Linking records by title and author: blocks, an author gate, identity, scores per title, a margin.

Pairs are formed of what rows have in common, not of rows: people meet once a block, a title's score is made once a
pair of cores, and a core's best row is chosen before titles meet.  Each step has at most a row a pair of distinct
(core, people, keys) of the two sides, so that copies of a record cost no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackwright.functions import names as na
from stackwright.functions import text as tx
from stackwright.operators.etl import running_totals
from stackwright.sources.shared import stored

#: Least score of a title, and least distance to the next one.
ACCEPT, MARGIN = 90.0, 5.0


def described(rows: DataFrame, key: str, title: str, author: str, *more: str) -> DataFrame:
    """A row's key, core, people, number words, volume numbers, sorted words and block keys, with ``more`` columns.

    All that a pair is compared by is made once a row here, and stored: the two sides are read several times.
    """
    one = rows.select(key, F.col(author).alias("author_"), tx.title_core(title).alias("core"), na.people(author).alias("people"), *more)
    two = one.withColumn("spelled", tx.spelled(F.col("core")))
    numbers, words = tx.nu.volume_numbers(tx.tokens("core")), F.array_join(F.array_sort(tx.tokens("core")), " ")
    keys = na.keys_of(F.col("core"), F.col("spelled"), F.col("people"), F.col("author_"))
    return stored(two.select(key, "core", "people", "spelled", numbers.alias("numbers"), words.alias("sorted"), keys.alias("keys"), *more), "described")


def _people(side: DataFrame) -> DataFrame:
    """``side`` with who: what the gate reads of the people."""
    return side.withColumn("who", F.transform("people", lambda p: F.struct(p["tokens"].alias("tokens"), p["family"].alias("family"))))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Distinct rows with a number each, stored: joins by numbers shuffle no text."""
    return stored(rows.distinct().withColumn(name, F.monotonically_increasing_id()), "numbers")


def _places(right: DataFrame, right_key: str) -> DataFrame:
    """For each (core, who) of the right side its rows with most editions, the one with the largest key and the one with
    the smallest: core, who, large_key and small_key, and their places large (more is better) and small (less is better).

    Places are whole numbers, so that the best of many pairs is a plain maximum or minimum.
    """
    up = F.max(F.struct("editions", F.col(right_key).alias("key"))).alias("up")
    down = F.min(F.struct(F.col("editions").isNull().alias("none"), (-F.col("editions")).alias("less"), F.col(right_key).alias("key"))).alias("down")
    each = stored(right.groupBy("core", "who").agg(up, down), "places")
    placed = running_totals(each, [F.col("up.editions"), F.col("up.key")], F.lit(1), "large")
    placed = running_totals(stored(placed, "places"), [F.col("down.none"), F.col("down.less"), F.col("down.key")], F.lit(1), "small")
    return stored(placed.select("core", "who", "large", "small", F.col("up.key").alias("large_key"), F.col("down.key").alias("small_key")), "places")


def scored_titles(left: DataFrame, right: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each (core, who) of the left side, by its number ``asked``, the cores of the right one that share a block
    with it and whose people may be the same: asked, core_b (a number), same, raw, and the best places of that core's
    rows.  With it the numbers of the left side: core, who and asked.  Both sides as ``described`` and ``_people``,
    ``places`` as ``_places``; a row without a core has no pair.

    ``raw`` is 100 for the same title, 0 where both hold volume numbers and share none, else the ratio of the
    sorted words.  All rows of a core have the same ``raw``.
    """
    x, y = left, right
    block, shared = F.explode("keys").alias("block"), ["core", "spelled", "numbers", "sorted"]
    best = [F.max("large").alias("large"), F.min("small").alias("small")]
    cores = {s: _numbered(side.select(*shared), f"core_{s}") for s, side in (("a", x), ("b", y))}
    people = _numbered(x.select("who").union(y.select("who")), "person")
    asked = _numbered(x.select("core", "who"), "asked")
    blocks = _numbered(x.select(block).distinct().join(y.select(block).distinct(), "block"), "block_")

    a = x.select("core", "who", block).distinct().join(blocks, "block").join(asked, ["core", "who"]).join(people, "who").join(cores["a"].select("core", "core_a"), "core")
    a = stored(a.select("block_", "person", "core_a", "asked"), "blocks")
    b = y.select("core", "who", block).distinct().join(blocks, "block").join(places, ["core", "who"]).join(people, "who").join(cores["b"].select("core", "core_b"), "core")
    b = stored(b.select("block_", F.col("person").alias("person_b"), "core_b", "large", "small"), "blocks")

    met = stored(a.select("block_", "person").distinct().join(b.select("block_", "person_b").distinct(), "block_"), "people")
    gate = met.select("person", "person_b").distinct().join(people, "person").join(people.select(F.col("person").alias("person_b"), F.col("who").alias("who_b")), "person_b")
    allowed = met.join(gate.filter(na.same_people(F.col("who"), F.col("who_b"))).select("person", "person_b"), ["person", "person_b"])
    near = allowed.join(b, ["block_", "person_b"]).groupBy("block_", "person", "core_b").agg(*best)
    found = stored(a.join(near, ["block_", "person"]).groupBy("asked", "core_a", "core_b").agg(*best), "titles")

    one = lambda s: cores[s].select(f"core_{s}", *(F.col(c).alias(f"{c}_of_{s}") for c in shared))
    pairs = found.select("core_a", "core_b").distinct().join(one("a"), "core_a").join(one("b"), "core_b")
    no, col = F.lit(False), F.col
    same = (col("core_of_a") == col("core_of_b")) | F.coalesce(col("spelled_of_a") == col("core_of_b"), no) | F.coalesce(col("spelled_of_b") == col("core_of_a"), no)
    apart = (F.size("numbers_of_a") > 0) & (F.size("numbers_of_b") > 0) & ~F.arrays_overlap("numbers_of_a", "numbers_of_b")
    raw = F.when(col("same"), 100.0).when(apart, 0.0).otherwise(tx.ratio_udf("sorted_of_a", "sorted_of_b"))
    scored = found.join(pairs.withColumn("same", same).select("core_a", "core_b", "same", raw.alias("raw")), ["core_a", "core_b"])
    return scored.drop("core_a"), asked


def decided(titles: DataFrame) -> DataFrame:
    """asked, method, score and margin from ``scored_titles``, and the linked row's place, large or small.

    Of rows with the same title the one with most editions wins, then the largest key; no margin counts
    there.  Else each title keeps its row with most editions (then the smallest key);
    the best title must reach ``ACCEPT`` and lead the next by ``MARGIN``; a single title leads.
    """
    none = F.lit(None).cast("long")
    same = titles.filter("same").groupBy("asked").agg(F.max("large").alias("large"))
    same = same.select("asked", "large", none.alias("small"), F.lit("title_author").alias("method"), F.lit(100.0).alias("score"), F.lit(None).cast("double").alias("margin"))
    rest = titles.join(same.select("asked"), "asked", "left_anti")
    order = Window.partitionBy("asked").orderBy(F.desc("raw"), "small")
    top = rest.withColumn("p_", F.row_number().over(order)).withColumn("next_", F.lead("raw").over(order)).filter("p_ = 1")
    gap = F.col("raw") - F.col("next_")
    good = (F.col("raw") >= ACCEPT) & (gap.isNull() | (gap >= MARGIN))
    scored = top.select("asked", none.alias("large"), F.when(good, F.col("small")).alias("small"), F.when(good, "title_author").otherwise("ambiguous").alias("method"), F.when(good, 0.7 * F.col("raw") + 30.0).otherwise(F.col("raw")).alias("score"), gap.alias("margin"))
    return same.unionByName(scored)


def match_title_author(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """A row for each left key: the right key it is linked to, if any, with method, score and margin."""
    x, y = _people(left), _people(right)
    places = _places(y, right_key)
    titles, asked = scored_titles(x, y, places)
    found = decided(titles).join(places.select("large", "large_key"), "large", "left").join(places.select("small", "small_key"), "small", "left")
    found = asked.join(found, "asked").select("core", "who", F.coalesce("large_key", "small_key").alias(right_key), "method", "score", "margin")
    each = x.select(left_key, "core", "who").join(stored(found, "links"), ["core", "who"], "left")
    return each.select(left_key, right_key, F.coalesce("method", F.lit("unmatched")).alias("method"), "score", "margin")


def match_cascade(left: DataFrame, isbns: DataFrame, by_title: DataFrame, left_key: str, isbn: str, right_key: str) -> DataFrame:
    """Links by book number first (the smallest key among hits, score 100), else those of ``by_title``."""
    hits = left.select(left_key, isbn).join(isbns.select(isbn, right_key), isbn).groupBy(left_key).agg(F.min(right_key).alias("hit_"))
    out = by_title.join(hits, left_key, "left")
    num = F.col("hit_").isNotNull()
    return out.select(left_key, F.coalesce("hit_", right_key).alias(right_key), F.when(num, "isbn").otherwise(F.col("method")).alias("method"), F.when(num, 100.0).otherwise(F.col("score")).alias("score"), F.when(~num, F.col("margin")).alias("margin"))


def gold_evaluation(found: DataFrame, gold: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: pairs with a gold key (the smallest), exact, conflicting and missing links, and recall."""
    truth = gold.groupBy(left_key).agg(F.min(right_key).alias("truth_"))
    both = truth.join(found.select(left_key, F.col(right_key).alias("found_")), left_key, "left")
    hit, none = F.col("found_") == F.col("truth_"), F.col("found_").isNull()
    out = both.agg(F.count("*").alias("gold_pairs"), F.count_if(hit).alias("exact"), F.count_if(~none & ~hit).alias("conflict"), F.count_if(none).alias("missing"))
    return out.withColumn("recall", F.round(F.coalesce(F.try_divide("exact", "gold_pairs"), F.lit(0.0)), 6))


def label_evaluation(labels: DataFrame, found: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: reviewed labels, those with a truth, and how many links agree; an absent link equals an absent truth."""
    both = labels.join(found.select(left_key, F.col(right_key).alias("found_")), left_key, "left")
    known = F.col("truth").isNotNull()
    return both.agg(F.count("*").alias("reviewed"), F.count_if(known).alias("checkable"), F.count_if(known & F.col("found_").eqNullSafe(F.col("truth"))).alias("agree"), F.count_if(~known & F.col("found_").isNull()).alias("rightly_none"))


def false_merges(pairs: DataFrame, found: DataFrame, a: str, b: str, left_key: str, right_key: str) -> DataFrame:
    """Pairs known to differ whose two sides are linked to the same key."""
    x = found.select(F.col(left_key).alias(a), F.col(right_key).alias("one_"))
    y = found.select(F.col(left_key).alias(b), F.col(right_key).alias("two_"))
    return pairs.join(x, a).join(y, b).filter("one_ = two_").select(a, b, F.col("one_").alias(right_key))


def suspicious_works(found: DataFrame, left: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys with two links by title or more, the number of distinct cores, and whether all their people go together.

    People go together if one family name or word is common to all of a key's rows: each pair is then compatible.
    """
    rows = found.filter("method = 'title_author'").join(left.select(left_key, "core", "people"), left_key)
    words = F.array_distinct(F.flatten(F.transform("people", lambda p: p["tokens"])))
    n = rows.groupBy(right_key).agg(F.count("*").alias("n"), F.countDistinct("core").alias("cores")).filter("n >= 2")
    shared = rows.select(right_key, F.explode(words).alias("w")).groupBy(right_key, "w").agg(F.count("*").alias("k")).groupBy(right_key).agg(F.max("k").alias("most"))
    return n.join(shared, right_key, "left").select(right_key, "n", "cores", ((F.col("cores") > 1) | (F.coalesce("most", F.lit(0)) < F.col("n"))).alias("suspicious"))


def field_score(title: Column, author: Column, blob: Column, author_query: Column, popularity: Column) -> Column:
    """0.95 of the blended field ratios and 0.05 of popularity; without an author the title and the whole text count."""
    blended = F.when(F.trim(author_query) == "", 0.66 * title + 0.34 * blob).otherwise(0.52 * title + 0.28 * author + 0.20 * blob)
    return 0.95 * blended + 0.05 * popularity


def canonical_rows(rows: DataFrame, query: str, match_key: str, work: str, popularity: str, rank: str, cap: int) -> DataFrame:
    """Of the works of one match key the most popular one (nulls last, then the best rank) keeps its rows; capped a query."""
    w = Window.partitionBy(query, match_key).orderBy(F.asc_nulls_last(popularity), rank, work)
    kept = rows.withColumn("first_", F.first(work).over(w)).filter(F.col(work) == F.col("first_")).drop("first_")
    place = Window.partitionBy(query).orderBy(rank, work)
    return kept.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= cap)


def scored_by_all(pairs: DataFrame, query: str, candidate: str, scorers: dict[str, Column]) -> DataFrame:
    """query, scorer, best candidate and its score, for each named scorer; ties go to the smaller candidate."""
    named = F.array(*(F.struct(F.lit(k).alias("scorer"), c.cast("double").alias("score")) for k, c in sorted(scorers.items())))
    each = pairs.select(query, candidate, F.explode(named).alias("s")).select(query, candidate, "s.scorer", "s.score")
    w = Window.partitionBy(query, "scorer").orderBy(F.desc("score"), candidate)
    return each.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")
