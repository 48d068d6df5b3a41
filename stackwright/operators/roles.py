"""Queries from the lines of a spine: which lines are the title and the author, and weighted words to look up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackwright.functions import roles as ro
from stackwright.functions import text as tx

# Least shares of title and author lines, sizes of the word pools, the budget of added spellings.
TITLE_LEAST, AUTHOR_LEAST = 0.35, 0.40
POOLS = {"title": 8, "author": 6, "general": 8, "fallback": 12}
BUDGET = 24
SURE, LEAD, AUTHOR_FLOOR = 0.60, 0.15, 0.35


def scored_lines(lines: DataFrame, spine: str) -> DataFrame:
    """Lines (spine, line, text, confidence, quad, crop) with place, and title, author and other shares."""
    sized = lines.withColumn("height_", ro.relative_height(F.col("quad"), F.col("crop"))).withColumn("place", ro.place(F.col("quad"), F.col("crop")))
    role = sized.withColumn("role_", ro.role_scores(F.col("height_"), F.col("place"), F.col("text")))
    return role.select(spine, "line", "text", "confidence", "place", "role_.title", "role_.author", "role_.other")


def _joined(hit: Column) -> Column:
    """The texts of some lines in order of place, normalised."""
    rows = F.array_sort(F.collect_list(F.when(hit, F.struct("place", "line", "text"))))
    return tx.normalize(F.array_join(F.transform(rows, lambda r: r["text"]), " "))


def canonical_queries(scored: DataFrame, spine: str) -> DataFrame:
    """title_query, author_query, whether the title fell back, and whether the roles are unsure, for each spine.

    Title lines reach ``TITLE_LEAST``; without one, those that lean to title, or else the best one.  Author lines
    reach ``AUTHOR_LEAST`` and are more author than title.
    """
    title = F.col("title") >= TITLE_LEAST
    author = (F.col("author") >= AUTHOR_LEAST) & (F.col("author") > F.col("title"))
    lean = (F.col("title") >= F.col("author")) & (F.col("title") >= F.col("other"))
    best = F.max_by(F.struct("title", "author", "other", "text"), F.struct("title", -F.col("line")))
    writer = F.max_by(F.struct("title", "author", "other"), F.struct("author", -F.col("line")))
    every = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"])
    per = scored.groupBy(spine).agg(_joined(title).alias("by_share"), _joined(lean).alias("by_lean"), _joined(author).alias("author_query"), F.max(title).alias("some"), F.max(lean).alias("leaning"), best.alias("b"), writer.alias("w"), tx.normalize(F.array_join(every, " ")).alias("all_text"))
    unsure = lambda r, own, x, y: (r[own] < SURE) | (r[own] - F.greatest(r[x], r[y]) < LEAD)
    b, w = F.col("b"), F.col("w")
    ambiguous = unsure(b, "title", "author", "other") | ((w["author"] >= AUTHOR_FLOOR) & unsure(w, "author", "title", "other"))
    query = F.when(F.col("some"), F.col("by_share")).when(F.col("leaning"), F.col("by_lean")).otherwise(tx.normalize(b["text"]))
    return per.select(spine, query.alias("title_query"), "author_query", "all_text", (~F.col("some")).alias("fell_back"), ambiguous.alias("ambiguous"))


def _words(scored: DataFrame, spine: str) -> DataFrame:
    """Words of three characters or more, in reading order."""
    w = scored.select(spine, "line", "confidence", "title", "author", F.posexplode(tx.tokens(tx.normalize("text"))).alias("at", "token"))
    return w.filter(F.length("token") >= 3)


def added_spellings(scored: DataFrame, spine: str) -> DataFrame:
    """The first ``BUDGET`` confused spellings of a spine's words that none of its lines holds, in reading order."""
    w = _words(scored, spine)
    tried = w.select(spine, "line", "at", "title", "author", F.posexplode(tx.ocr_variants("token", F.col("confidence"))).alias("no", "variant"))
    new = tried.join(w.select(spine, F.col("token").alias("variant")).distinct(), [spine, "variant"], "left_anti")
    first = new.groupBy(spine, "variant").agg(F.min(F.struct("line", "at", "no", "title", "author")).alias("f"))
    place = F.row_number().over(Window.partitionBy(spine).orderBy("f.line", "f.at", "f.no"))
    return first.withColumn("place", place).filter(F.col("place") <= BUDGET).select(spine, F.col("variant").alias("token"), "f.title", "f.author", "place")


def token_pools(scored: DataFrame, spine: str) -> DataFrame:
    """(spine, pool, place, token, priority): the heaviest words for each role; ties by the word."""
    every = _words(scored, spine).select(spine, "token", "title", "author").unionByName(added_spellings(scored, spine).select(spine, "token", "title", "author"))
    general = F.greatest("title", "author")
    best = every.groupBy(spine, "token").agg(F.max("title").alias("title"), F.max("author").alias("author"), F.max(general).alias("general"))
    pools = F.array(*(F.struct(F.lit(k).alias("pool"), F.col("general" if k == "fallback" else k).alias("share"), F.lit(n).alias("most")) for k, n in POOLS.items()))
    each = best.select(spine, "token", F.explode(pools).alias("p")).select(spine, "token", "p.*").withColumn("priority", ro.priority(F.col("token"), F.col("share")))
    place = F.row_number().over(Window.partitionBy(spine, "pool").orderBy(F.desc(F.round("priority", 9)), "token"))
    return each.withColumn("place", place).filter(F.col("place") <= F.col("most")).select(spine, "pool", "place", "token", "priority")


def escalated(spines: DataFrame, key: str, quality: str, low: float = 0.35, high: float = 0.65, share: float = 0.05) -> DataFrame:
    """The lowest of the hard cases (quality within the range), as many as a share of all rows, one at least."""
    budget = spines.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * share)).alias("budget_"))
    hard = spines.filter(F.col(quality).between(low, high)).withColumn("order_", F.struct(quality, key))
    from .etl import running_totals

    return running_totals(hard, ["order_"], F.lit(1), "before_").crossJoin(F.broadcast(budget)).filter(F.col("before_") < F.col("budget_")).drop("order_", "before_", "budget_")


def winning_pass(passes: DataFrame, key: str, order: str, confidences: str) -> DataFrame:
    """Per key the pass with the largest sum of confidences (then the earlier one), its mean, and its lead over the next."""
    total = F.aggregate(confidences, F.lit(0.0), lambda a, c: a + c)
    mean = F.when(F.size(confidences) > 0, total / F.size(confidences)).otherwise(0.0)
    w = Window.partitionBy(key).orderBy(F.desc("sum"), order)
    ranked = passes.select(key, order, total.alias("sum"), mean.alias("mean")).withColumn("n_", F.row_number().over(w)).withColumn("next_", F.lead("sum").over(w))
    both = F.col("sum") + F.col("next_")
    agreement = F.when(F.col("next_").isNull(), 1.0).when(both > 0, (F.col("sum") - F.col("next_")) / both).otherwise(0.0)
    return ranked.filter("n_ = 1").select(key, order, "sum", "mean", agreement.alias("agreement"))
