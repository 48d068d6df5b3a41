"""Smaller operators over the driver's tables: sets, budgets, rules, number words, fits, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackwright.functions import numbers as nu
from stackwright.operators import etl

from .tables import register, sql_in_words, t

QUERIES, SQL, query = register()


@query("WITH a AS (SELECT DISTINCT l_orderkey AS u FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey AS u FROM lineitem WHERE l_returnflag = 'R') SELECT 'union' AS op, u FROM (SELECT u FROM a UNION SELECT u FROM b) UNION ALL SELECT 'both', u FROM (SELECT u FROM a INTERSECT SELECT u FROM b) UNION ALL SELECT 'less', u FROM (SELECT u FROM a EXCEPT SELECT u FROM b)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem")
    a, b = (x.filter(F.col("l_returnflag") == k).select(F.col("l_orderkey").alias("u")).distinct() for k in ("A", "R"))
    named = lambda k, x: x.select(F.lit(k).alias("op"), "u")
    return named("union", a.union(b).distinct()).union(named("both", a.intersect(b))).union(named("less", a.subtract(b)))


@query("""WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS ws FROM conversations), x AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT conv_id, word, min((turn, i)) AS pos FROM x WHERE word <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS place FROM f) SELECT conv_id, word, place::BIGINT AS place FROM r WHERE place <= 24""")
def running_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first 24 distinct words of a conversation, in reading order."""
    x = t(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), " ")).alias("i", "word")).filter("word <> ''")
    first = x.groupBy("conv_id", "word").agg(F.min(F.struct("turn", "i")).alias("at"))
    w = Window.partitionBy("conv_id").orderBy("at")
    return first.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 24").select("conv_id", "word", "place")


@query("""SELECT doc_id, CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN n_chars > 10000 THEN 'huge' WHEN contains(text, '@') THEN 'mail' WHEN regexp_matches(text, '\\d{4,}') THEN 'digits' WHEN contains(lower(text), 'license') THEN 'licence' WHEN n_chars < 200 THEN 'short' ELSE 'plain' END AS class FROM documents""")
def first_rule(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    rule = F.when(text.isNull() | (F.length(text) == 0), "empty").when(F.col("n_chars") > 10000, "huge").when(F.contains(text, F.lit("@")), "mail").when(text.rlike(r"\d{4,}"), "digits").when(F.contains(F.lower(text), F.lit("license")), "licence").when(F.col("n_chars") < 200, "short").otherwise("plain")
    return t(spark, d, "documents").select("doc_id", rule.alias("class"))


@query(f"SELECT p_partkey, p_size, {sql_in_words('p_size')} AS words FROM part")
def number_words(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", "p_size", nu.in_words(F.col("p_size")).alias("words"))


@query("WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r, count(*) OVER () AS n FROM customer) SELECT c_custkey, round(greatest(0, least(100, 100 * (1 - ln(r) / ln(n)))), 6) AS score FROM r")
def popularity_score(spark: SparkSession, d: str) -> DataFrame:
    c = etl.ranked(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", "r")
    return c.crossJoin(F.broadcast(c.agg(F.count("*").alias("n")))).select("c_custkey", F.round(nu.rank_score(F.col("r"), F.col("n")), 6).alias("score"))


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(median(l_quantity), 4) AS middle FROM lineitem GROUP BY l_suppkey")
def line_fits(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "lineitem").groupBy("l_suppkey")
    return g.agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), F.round(F.percentile("l_quantity", 0.5), 4).alias("middle"))


@query("WITH u AS (SELECT user_id, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1), r AS (SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id) AS a, row_number() OVER (ORDER BY v DESC, user_id) AS b FROM u) SELECT user_id, a::BIGINT AS a, b::BIGINT AS b, abs(a - b)::BIGINT AS moved FROM r ORDER BY moved DESC, user_id DESC LIMIT 20")
def rank_displacement(spark: SparkSession, d: str) -> DataFrame:
    u = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    a, b = etl.ranked(u, "user_id", "n", "a").select("user_id", F.col("a").cast("long").alias("a")), etl.ranked(u, "user_id", "v", "b").select("user_id", F.col("b").cast("long").alias("b"))
    return a.join(b, "user_id").withColumn("moved", F.abs(F.col("a") - F.col("b"))).orderBy(F.desc("moved"), F.desc("user_id")).limit(20)


@query("SELECT doc_id FROM documents ORDER BY sha256('seed-7:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2(F.concat(F.lit("seed-7:"), F.col("doc_id").cast("string")), 256)
    return t(spark, d, "documents").select("doc_id").orderBy(key, "doc_id").limit(50)


@query("SELECT coalesce(event_type, 'all') AS event_type, coalesce(user_id % 5, -1) AS slot, grouping(event_type, user_id % 5)::BIGINT AS level, count(*)::BIGINT AS n FROM events GROUP BY CUBE (event_type, user_id % 5)")
def event_cube(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("slot"))
    out = e.cube("event_type", "slot").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("slot", F.lit(-1)).cast("long").alias("slot"), "level", "n")


@query("WITH l AS (SELECT o_orderkey, o_orderpriority AS p, count(*) AS n, min(l_shipdate) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) SELECT p, arg_min(o_orderkey, (s, o_orderkey)) AS first_order, max(n)::BIGINT AS most FROM l GROUP BY p")
def first_by_group(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.min("l_shipdate").alias("s"))
    x = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p")).join(lines, "o_orderkey")
    return x.groupBy("p").agg(F.min_by("o_orderkey", F.struct("s", "o_orderkey")).alias("first_order"), F.max("n").alias("most"))
