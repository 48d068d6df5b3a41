"""Roles of lines, queries from them, and quality gates, over conversations taken as spines and turns as their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.functions import quality as q
from stackwright.functions import roles as ro
from stackwright.functions import text as tx
from stackwright.operators import roles

from .tables import register, sql_confused, sql_norm, t

QUERIES, SQL, query = register()


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """A line's height and place follow from its length and turn; a line is its turn's first sentence, some are names."""
    n = F.length("text")
    text = F.when(n % 4 == 0, F.concat(F.lit("By Ann Corn"), F.when(F.col("conv_id") % 2 == 0, F.lit("modern")).otherwise(""))).when(n % 7 == 0, F.lit("ISBN 12345")).otherwise(F.substring_index("text", ".", 1))
    top, high = (F.col("turn") * 130 + n % 60).cast("double"), (5 + n % 170).cast("double")
    at = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), y.alias("y"))
    quad = F.array(at(0.0, top), at(400.0, top), at(400.0, top + high), at(0.0, top + high))
    return t(spark, d, "conversations").select("conv_id", F.col("turn").alias("line"), text.alias("text"), (n % 11 / 10).alias("confidence"), quad.alias("quad"), F.lit(1000.0).alias("crop"))


def _band(x: str, b: tuple) -> str:
    a, c, e, f = b
    return f"(CASE WHEN {x} <= {a} OR {x} >= {f} THEN 0 WHEN {x} < {c} THEN ({x} - {a}) / ({c}::DOUBLE - {a}) WHEN {x} <= {e} THEN 1 ELSE ({f} - {x}) / ({f}::DOUBLE - {e}) END)"


_L = """l AS (SELECT conv_id, turn AS line, CASE WHEN length(text) % 4 = 0 THEN 'By Ann Corn' || CASE WHEN conv_id % 2 = 0 THEN 'modern' ELSE '' END WHEN length(text) % 7 = 0 THEN 'ISBN 12345' ELSE split_part(text, '.', 1) END AS text,
 (length(text) % 11) / 10.0 AS confidence, turn * 130 + length(text) % 60 AS top, 5 + length(text) % 170 AS high FROM conversations)"""
_H = "(least(1, greatest(0, high / 1000.0)))::DOUBLE"
_P = "(least(1, greatest(0, (top + high / 2.0) / 1000.0)))::DOUBLE"
_X = "(contains(lower(text), 'isbn') OR contains(lower(text), 'http') OR contains(lower(text), 'www') OR contains(text, '©') OR regexp_matches(text, '\\pN{4}'))"
_W = "list_filter(string_split(CASE WHEN cut > 0 THEN trim(substr(text, cut + 1)) ELSE text END, ' '), lambda w: w <> '')"
_N = f"(len({_W}) BETWEEN 2 AND 4 AND len(list_filter({_W}, lambda w: NOT regexp_full_match(w, '\\pL{{2,24}}'))) = 0 AND (cut > 0 OR (len(list_filter({_W}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= 2 AND NOT (text = upper(text) AND text <> lower(text)))))"
_R = f"""{_L}, c AS (SELECT *, {_H} AS h, {_P} AS place, CASE WHEN starts_with(lower(text), 'by') THEN 2 WHEN starts_with(lower(text), 'written by') THEN 10 WHEN starts_with(lower(text), 'author') THEN 6 ELSE 0 END AS cut FROM l),
w AS (SELECT *, 0.05 + 0.65 * {_band('h', ro.TITLE[0][1])} + 0.30 * {_band('place', ro.TITLE[1][1])} AS t, (0.05 + 0.60 * {_band('h', ro.AUTHOR[0][1])} + 0.30 * {_band('place', ro.AUTHOR[1][1])}) * CASE WHEN {_N} THEN 1.25 ELSE 1 END AS a,
 (0.05 + 0.55 * {_band('h', ro.OTHER_HEIGHT[1])} + 0.30 * greatest({_band('place', ro.OTHER_PLACES[1][0])}, {_band('place', ro.OTHER_PLACES[1][1])})) * CASE WHEN {_X} THEN 1.5 ELSE 1 END AS o FROM c),
s AS (SELECT conv_id, line, text, confidence, place, t / (t + a + o) AS title, a / (t + a + o) AS author, o / (t + a + o) AS other FROM w)"""


@query(f"WITH {_R} SELECT conv_id, line, round(place, 6) AS place, round(title, 6) AS title, round(author, 6) AS author, round(other, 6) AS other FROM s")
def line_roles(spark: SparkSession, d: str) -> DataFrame:
    s = roles.scored_lines(_lines(spark, d), "conv_id")
    return s.select("conv_id", "line", *(F.round(c, 6).alias(c) for c in ("place", "title", "author", "other")))


_AGG = lambda hit, name: f"string_agg(CASE WHEN {hit} THEN text END, ' ' ORDER BY place, line) AS {name}"


@query(f"""WITH {_R}, g AS (SELECT conv_id, {_AGG('title >= 0.35', 'bs')}, {_AGG('title >= author AND title >= other', 'bl')}, {_AGG('author >= 0.40 AND author > title', 'au')}, bool_or(title >= 0.35) AS sm, bool_or(title >= author AND title >= other) AS leaning,
 arg_max(text, (title, -line)) AS bt, max(title) AS b1, arg_max(greatest(author, other), (title, -line)) AS b2, max(author) AS w1, arg_max(greatest(title, other), (author, -line)) AS w2 FROM s GROUP BY conv_id)
SELECT conv_id, {sql_norm("CASE WHEN sm THEN bs WHEN leaning THEN bl ELSE bt END")} AS title_query, {sql_norm("coalesce(au, '')")} AS author_query, NOT sm AS fell_back, (b1 < 0.6 OR b1 - b2 < 0.15) OR (w1 >= 0.35 AND (w1 < 0.6 OR w1 - w2 < 0.15)) AS ambiguous FROM g""")
def role_queries(spark: SparkSession, d: str) -> DataFrame:
    s = roles.scored_lines(_lines(spark, d), "conv_id")
    return roles.canonical_queries(s, "conv_id").select("conv_id", "title_query", "author_query", "fell_back", "ambiguous")


_T = f"""tw AS (SELECT conv_id, line, confidence, title, author, unnest(string_split({sql_norm('text')}, ' ')) AS token, unnest(range(0, len(string_split({sql_norm('text')}, ' '))::BIGINT)) AS pos FROM s), tk AS (SELECT * FROM tw WHERE length(token) >= 3),
v0 AS (SELECT conv_id, line, pos, title, author, token, unnest({sql_confused('token')}) AS v, unnest(range(0, {2 * len(tx.CONFUSED)})) AS i FROM tk WHERE length(token) BETWEEN 4 AND 18 AND confidence < 0.94),
v1 AS (SELECT conv_id, line, pos, title, author, v, min(i) AS i FROM v0 WHERE v IS NOT NULL GROUP BY ALL), v2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, line, pos ORDER BY i) AS no FROM v1),
v3 AS (SELECT * FROM v2 WHERE no <= 2 AND NOT EXISTS (SELECT 1 FROM tk WHERE tk.conv_id = v2.conv_id AND tk.token = v2.v)),
v4 AS (SELECT conv_id, v, min((line, pos, no)) AS f, arg_min(title, (line, pos, no)) AS title, arg_min(author, (line, pos, no)) AS author FROM v3 GROUP BY ALL), v5 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY f) AS place FROM v4)"""


@query(f"WITH {_R}, {_T} SELECT conv_id, v AS token, place::BIGINT AS place FROM v5 WHERE place <= 24")
def spelling_budget(spark: SparkSession, d: str) -> DataFrame:
    s = roles.scored_lines(_lines(spark, d), "conv_id")
    return roles.added_spellings(s, "conv_id").select("conv_id", "token", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_R}, {_T}, e AS (SELECT conv_id, token, title, author FROM tk UNION ALL SELECT conv_id, v, title, author FROM v5 WHERE place <= 24), b AS (SELECT conv_id, token, max(title) AS title, max(author) AS author, max(greatest(title, author)) AS general FROM e GROUP BY ALL),
p AS (SELECT conv_id, token, 'title' AS pool, title AS share, 8 AS most FROM b UNION ALL SELECT conv_id, token, 'author', author, 6 FROM b UNION ALL SELECT conv_id, token, 'general', general, 8 FROM b UNION ALL SELECT conv_id, token, 'fallback', general, 12 FROM b),
r AS (SELECT *, share * (0.70 + 0.03 * least(length(token), 10)) AS pr FROM p), z AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pool ORDER BY round(pr, 9) DESC, token) AS place FROM r) SELECT conv_id, pool, place::BIGINT AS place, token, round(pr, 6) AS priority FROM z WHERE place <= most""")
def token_pools(spark: SparkSession, d: str) -> DataFrame:
    s = roles.scored_lines(_lines(spark, d), "conv_id")
    return roles.token_pools(s, "conv_id").select("conv_id", "pool", F.col("place").cast("long").alias("place"), "token", F.round("priority", 6).alias("priority"))


_LET = lambda x: f"length(regexp_replace({x}, '[^\\pL]', '', 'g'))"
_UP = lambda v, f: f"(CASE WHEN {v} > {f} THEN least(1.0, ({v} - {f}) / {f}) ELSE 0 END)"
_Q = f"""k AS (SELECT conv_id, turn, trim(text, ' ') AS x, (length(text) % 11) / 10.0 AS conf, CASE WHEN turn % 2 = 0 THEN (length(text) % 9) / 9.0 END AS det FROM conversations),
z AS (SELECT conv_id, turn, conf, det, CASE WHEN x = '' THEN 0.0 ELSE ({_UP('length(x)', 3.0)} + {_UP(_LET('x') + ' / length(x)', 0.4)} + (len(list_filter(string_split(x, ' '), lambda w: {_LET('w')} >= 2)) > 0)::INT) / 3 END AS plaus, x FROM k),
sc AS (SELECT conv_id, turn, CASE WHEN x = '' THEN 0.0 ELSE ({_UP('conf', 0.35)} + 1 + plaus + coalesce(det * 0.3, 0)) / CASE WHEN det IS NULL THEN 3.0 ELSE 3.3 END END AS score FROM z)"""


def _quality(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    c = t(spark, d, "conversations").select("conv_id", "turn", "text", (n % 11 / 10).alias("conf"), F.when(F.col("turn") % 2 == 0, n % 9 / 9).alias("det"))
    return c.select("conv_id", "turn", q.text_score(F.col("text"), F.col("conf"), F.lit(0.5), F.col("det")).alias("score"))


@query(f"WITH {_Q} SELECT conv_id, turn, round(score, 6) AS score, score >= 0.5 AS ok, score BETWEEN 0.35 AND 0.65 AS hard FROM sc")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).select("conv_id", "turn", F.round("score", 6).alias("score"), (F.col("score") >= q.PASS).alias("ok"), F.col("score").between(0.35, 0.65).alias("hard"))


@query(f"WITH {_Q}, h AS (SELECT conv_id, turn, round(score, 6) AS s FROM sc WHERE round(score, 6) BETWEEN 0.55 AND 0.85) SELECT conv_id, turn FROM h ORDER BY s, conv_id * 1000 + turn LIMIT (SELECT greatest(1, ceil(count(*) * 0.05))::BIGINT FROM sc)")
def escalation(spark: SparkSession, d: str) -> DataFrame:
    s = _quality(spark, d).withColumn("score", F.round("score", 6)).withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return roles.escalated(s, "key", "score", 0.55, 0.85).select("conv_id", "turn")


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber % 3 AS pass, l_discount * 10 AS c FROM lineitem), g AS (SELECT k, pass, round(sum(c), 6) AS s, round(avg(c), 6) AS mean FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS n, lead(s) OVER w AS nx FROM g WINDOW w AS (PARTITION BY k ORDER BY s DESC, pass))
SELECT k, pass, s AS total, mean, round(CASE WHEN nx IS NULL THEN 1 WHEN s + nx > 0 THEN (s - nx) / (s + nx) ELSE 0 END, 6) AS agreement FROM r WHERE n = 1""")
def winning_passes(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 3).alias("pass")).agg(F.collect_list(F.col("l_discount") * 10).alias("cs"), F.round(F.sum(F.col("l_discount") * 10), 6).alias("sum_"))
    # Sums are rounded, so that the order in which a group is added up decides nothing.
    w = roles.winning_pass(p.select("k", "pass", F.array(F.col("sum_")).alias("cs")), "k", "pass", "cs").join(p.select("k", "pass", F.size("cs").alias("n")), ["k", "pass"])
    return w.select("k", "pass", F.col("sum").alias("total"), F.round(F.col("sum") / F.col("n"), 6).alias("mean"), F.round("agreement", 6).alias("agreement"))
