"""Evaluation, overlap, queue, telemetry and geometry queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.functions import geometry as g
from stackwright.operators import evaluate, monitor, overlap, spatial

from .tables import register, t

QUERIES, SQL, query = register()

_USERS = "WITH u AS (SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 4) AS v FROM events GROUP BY 1) "


def _users(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))


@query(_USERS + ", r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS b FROM u) SELECT count(*)::BIGINT AS n, round(coalesce(corr(a, b), 0), 6) AS rho FROM r")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.spearman(_users(spark, d), "n", "v", "user_id")


@query(_USERS + ", a AS (SELECT user_id FROM u ORDER BY n DESC, user_id LIMIT 20), b AS (SELECT user_id FROM u ORDER BY v DESC, user_id LIMIT 20) SELECT count(*)::BIGINT AS both, (SELECT count(*) FROM b)::BIGINT AS size, round(count(*) / (SELECT count(*) FROM b)::DOUBLE, 6) AS overlap FROM a JOIN b USING (user_id)")
def top_overlap(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.top_overlap(_users(spark, d), "n", "v", "user_id", 20)


@query("WITH x AS (SELECT quality = 1 AS t, n_chars > 800 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM x) SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall FROM c")
def hold_out_confusion(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.confusion(x.select((F.col("quality") == 1).alias("t"), (F.col("n_chars") > 800).alias("p")), "t", "p")


@query("WITH h AS (SELECT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k, text, doc_id FROM documents WHERE text IS NOT NULL) SELECT sha256(k) AS key, count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS texts, min(doc_id) AS first, count(DISTINCT text) > 1 AS suspicious FROM h GROUP BY k HAVING count(*) >= 2")
def suspicious_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose whole texts have the same words: suspicious where the texts themselves differ."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    h = t(spark, d, "documents").filter("text is not null").select(F.sha2(plain, 256).alias("key"), F.sha2("text", 256).alias("text"), "doc_id")
    groups = h.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.min("doc_id").alias("first")).filter("n >= 2")
    return groups.withColumn("suspicious", F.col("texts") > 1)


@query("WITH a AS (SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0)::BIGINT AS a, coalesce(b.n, 0)::BIGINT AS b, (coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS delta FROM a FULL JOIN b ON a.event_type IS NOT DISTINCT FROM b.event_type")
def distribution_delta(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return evaluate.distribution_delta(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "event_type")


@query("WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY -c_acctbal, c_custkey) AS p, ceil(count(*) OVER () / 10.0) AS chunk FROM customer) SELECT c_custkey, p::BIGINT AS place, floor((p - 1) / chunk)::INT AS decile FROM r")
def balance_deciles(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.deciles(t(spark, d, "customer"), [(-F.col("c_acctbal")).alias("a"), F.col("c_custkey").alias("b")], "c_custkey")
    return out.select("c_custkey", F.col("place").cast("long").alias("place"), "decile")


@query("WITH m AS (SELECT count(*) FILTER (l_returnflag = 'R') / count(*) AS recall, count(*) FILTER (l_discount > 0.05) AS conflict, l_linestatus AS s FROM lineitem GROUP BY s), b AS (SELECT * FROM m WHERE s = 'F'), c AS (SELECT * FROM m WHERE s = 'O') SELECT NOT (c.recall < b.recall - 1e-9) AND NOT (c.conflict > b.conflict + 1e-9) AS passed, concat_ws('; ', CASE WHEN c.recall < b.recall - 1e-9 THEN 'recall fell' END, CASE WHEN c.conflict > b.conflict + 1e-9 THEN 'conflict rose' END) AS reasons FROM b, c")
def acceptance_gate(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "lineitem").groupBy("l_linestatus").agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("recall"), F.count_if(F.col("l_discount") > 0.05).alias("conflict"))
    return evaluate.gate(m.filter("l_linestatus = 'F'"), m.filter("l_linestatus = 'O'"), ["recall"], ["conflict"])


_LISTS = "WITH m AS (SELECT DISTINCT 'L' || (l_suppkey % 23) AS l, l_partkey AS i FROM lineitem), s AS (SELECT l, count(*) AS n FROM m GROUP BY l) "


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of parts, by their suppliers."""
    return t(spark, d, "lineitem").select(F.concat(F.lit("L"), (F.col("l_suppkey") % 23).cast("string")).alias("l"), F.col("l_partkey").alias("i")).distinct()


@query(_LISTS + ", p AS (SELECT a.l AS a, b.l AS b, count(*) AS k FROM m a JOIN m b ON a.i = b.i AND a.l < b.l GROUP BY ALL) SELECT p.a, p.b, k::BIGINT AS both, round(k / (x.n + y.n - k), 6) AS jaccard, round(k / x.n, 6) AS a_in_b, round(k / y.n, 6) AS b_in_a FROM p JOIN s x ON x.l = p.a JOIN s y ON y.l = p.b")
def list_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.pair_overlaps(_lists(spark, d), "l", "i")


@query(_LISTS + ", o AS (SELECT i, min(l) AS l FROM m GROUP BY i HAVING count(*) = 1), w AS (SELECT l, count(*) AS own FROM o WHERE i % 2 = 0 GROUP BY l) SELECT s.l, coalesce(own, 0)::BIGINT AS own FROM s LEFT JOIN w USING (l)")
def own_contributions(spark: SparkSession, d: str) -> DataFrame:
    m = _lists(spark, d)
    return overlap.own_contributions(m, m.filter("i % 2 = 0"), "l", "i")


def _cover_sql(steps: int) -> str:
    """The step-wise choice, one pair of CTEs a step."""
    ctes, rows = [], []
    for k in range(1, steps + 1):
        gone = " UNION ALL ".join(f"SELECT i FROM c{j}" for j in range(1, k)) or "SELECT i FROM m WHERE false"
        ctes += [f"g{k} AS MATERIALIZED (SELECT l, count(*) AS gain FROM m WHERE i NOT IN ({gone}) GROUP BY l ORDER BY gain DESC, l LIMIT 1)", f"c{k} AS MATERIALIZED (SELECT i FROM m WHERE l IN (SELECT l FROM g{k}))"]
        rows.append(f"SELECT {k} AS place, l, gain::BIGINT AS gain FROM g{k}")
    return _LISTS + ", " + ", ".join(ctes) + " " + " UNION ALL ".join(rows)


@query(_cover_sql(10))
def greedy_cover(spark: SparkSession, d: str) -> DataFrame:
    return overlap.greedy_cover(_lists(spark, d), "l", "i", 10)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (l_linestatus = 'F') = 0)")
def remaining_queue(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = t(spark, d, "orders"), t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    done = lines.filter("l_linestatus = 'F'").select("o_orderkey").distinct()
    tried = lines.filter("l_returnflag = 'R'").select("o_orderkey", F.lit(1).alias("n"))
    return monitor.remaining(orders, done, monitor.given_up(tried, done, "o_orderkey", "n", 3), "o_orderkey")


@query("SELECT count(*) FILTER (event_type = 'purchase')::BIGINT AS ok, count(*)::BIGINT AS n, round(count(*) FILTER (event_type = 'purchase') / 24.0, 6) AS per_hour FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'")
def window_totals(spark: SparkSession, d: str) -> DataFrame:
    return monitor.window_totals(t(spark, d, "events"), "ts", "2024-01-15 00:00:00", 24, {"ok": (F.col("event_type") == "purchase").cast("long"), "n": F.lit(1).cast("long")}).select("ok", "n", "per_hour")


@query("WITH m AS (SELECT user_id, max((ts, event_id)) AS last FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY 1) SELECT e.user_id, count(*)::BIGINT AS n, count(*) FILTER (event_type IN ('error', 'view'))::BIGINT AS hits, count(*) FILTER (m.last IS NULL OR (ts, event_id) > m.last)::BIGINT AS streak FROM events e LEFT JOIN m USING (user_id) GROUP BY 1")
def trailing_streaks(spark: SparkSession, d: str) -> DataFrame:
    return monitor.trailing_streaks(t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view"))


@query("WITH s AS (SELECT user_id, event_type, sum((props->>'k')::BIGINT) AS v FROM events GROUP BY ALL), m AS (SELECT user_id, max(v) AS most, sum(v) AS total FROM s GROUP BY 1) SELECT s.user_id, min(event_type) AS event_type, round(coalesce(most / nullif(total, 0), 0), 6) AS share FROM s JOIN m ON s.user_id = m.user_id AND v = most GROUP BY s.user_id, most, total")
def dominant_stage(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return monitor.dominant(e, "user_id", "event_type", "k")


@query("WITH u AS (SELECT user_id, max((event_type = 'view')::INT) AS a, max((event_type = 'click')::INT) AS b, max((event_type = 'purchase')::INT) AS c FROM events GROUP BY 1) SELECT 1 AS place, 'view' AS step, sum(a)::BIGINT AS users FROM u UNION ALL SELECT 2, 'click', sum(a * b)::BIGINT FROM u UNION ALL SELECT 3, 'purchase', sum(a * b * c)::BIGINT FROM u")
def step_funnel(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return monitor.funnel(e, "user_id", "event_type", ["view", "click", "purchase"])


@query("WITH o AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND event_id % 2 = 0) AS old, count(*) FILTER (event_type = 'error') AS new FROM events GROUP BY 1) SELECT user_id, greatest(old, new)::BIGINT AS attempts, CASE WHEN new > old THEN TIMESTAMP '2024-02-01 00:00:00' + to_minutes([10, 45, 120][least(new - 1, 2) + 1]) END AS retry_after FROM o")
def retry_cooldown(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "events").groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)).alias("old"), F.count_if(F.col("event_type") == "error").alias("new"))
    state = o.select("user_id", F.col("old").alias("attempts"), F.lit(None).cast("timestamp").alias("retry_after"))
    return monitor.next_retry(state, o.select("user_id", F.col("new").alias("attempts")), "user_id", "2024-02-01 00:00:00")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_totals(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").groupBy(F.window("ts", "1 day").start.alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select("day", "event_type", "n", "total")


_BOXES = "b AS (SELECT p_partkey AS id, p_partkey % 25 AS scene, (p_partkey * 37 % 1000)::DOUBLE AS x0, (p_partkey * 53 % 800)::DOUBLE AS y0, (20 + p_size * 4)::DOUBLE AS w, (15 + p_size * 3)::DOUBLE AS h FROM part)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    b = t(spark, d, "part").select(k.alias("id"), (k % 25).alias("scene"), (k * 37 % 1000).cast("double").alias("x0"), (k * 53 % 800).cast("double").alias("y0"), (20 + F.col("p_size") * 4).cast("double").alias("w"), (15 + F.col("p_size") * 3).cast("double").alias("h"))
    return b.withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + F.col("h"))


_IOU = f"{_BOXES}, ij AS (SELECT a.scene, a.id AS a_id, c.id AS b_id, greatest(0, least(a.x0 + a.w, c.x0 + c.w) - greatest(a.x0, c.x0)) * greatest(0, least(a.y0 + a.h, c.y0 + c.h) - greatest(a.y0, c.y0)) AS i, a.w * a.h + c.w * c.h AS s FROM b a JOIN b c USING (scene) WHERE a.id % 2 = 0 AND c.id % 2 = 1), p AS (SELECT scene, a_id, b_id, round(i / (s - i), 6) AS iou FROM ij WHERE i / (s - i) >= 0.2)"


@query(f"WITH {_IOU} SELECT * FROM p")
def box_iou_join(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    return spatial.iou_pairs(b.filter("id % 2 = 0"), b.filter("id % 2 = 1"), "scene", 0.2, 200.0).withColumn("iou", F.round("iou", 6))


def _greedy_sql(rounds: int) -> str:
    """Round by round, the pairs that come first for both their boxes; the rest goes on without those boxes."""
    ctes, left = [], "p"
    for k in range(1, rounds + 1):
        ctes.append(f"m{k} AS MATERIALIZED (SELECT scene, a_id, b_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY scene, a_id ORDER BY iou DESC, b_id) AS x, row_number() OVER (PARTITION BY scene, b_id ORDER BY iou DESC, a_id) AS y FROM {left}) WHERE x = 1 AND y = 1)")
        ctes.append(f"p{k} AS MATERIALIZED (SELECT * FROM {left} WHERE (scene, a_id) NOT IN (SELECT (scene, a_id) FROM m{k}) AND (scene, b_id) NOT IN (SELECT (scene, b_id) FROM m{k}))")
        left = f"p{k}"
    return f"WITH {_IOU}, " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(1, rounds + 1))


@query(_greedy_sql(16))
def box_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return spatial.greedy_matches(box_iou_join(spark, d), "scene")


@query()
def box_suppression(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).select("id", "scene", (F.col("x0") + F.col("w") / 2).alias("cx"), (F.col("y0") + F.col("h") / 2).alias("cy"), "w", "h", (F.col("id") % 7 * 0.2).alias("angle"), (F.col("id") * 31 % 100 / 100).alias("conf"))
    return spatial.suppressed(b, "scene", 0.3)


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    points = t(spark, d, "part").select(k.alias("point_id"), (k % 25).alias("scene"), (k * 91 % 1000).cast("double").alias("x"), (k * 17 % 800).cast("double").alias("y"))
    b = _boxes(spark, d).select(F.col("id").alias("box_id"), "scene", (F.col("x0") + F.col("w") / 2).alias("cx"), (F.col("y0") + F.col("h") / 2).alias("cy"), "w", "h", F.lit(0.0).alias("angle"))
    return spatial.nearest(points, b, "scene", 5.0)


@query(f"WITH {_BOXES}, q AS (SELECT p_partkey AS point_id, p_partkey % 25 AS scene, (p_partkey * 91 % 1000)::DOUBLE AS x, (p_partkey * 17 % 800)::DOUBLE AS y FROM part), "
 "j AS (SELECT scene, point_id, b.id AS box_id, abs(x - (x0 + w / 2)) <= w / 2 AND abs(y - (y0 + h / 2)) <= h / 2 AS inside, sqrt((x - x0 - w / 2) ** 2 + (y - y0 - h / 2) ** 2) AS away, least(96.0, greatest(24.0, 0.5 * least(w, h))) AS radius FROM q JOIN b USING (scene)), "
 "r AS (SELECT *, row_number() OVER v AS n, lead(away) OVER v AS na, lead(inside) OVER v AS ni FROM j WHERE inside OR away <= radius WINDOW v AS (PARTITION BY scene, point_id ORDER BY inside DESC, away, box_id)) "
 "SELECT scene, point_id, box_id, inside, round(away, 6) AS away, coalesce(inside = ni AND na - away < 5, false) AS ambiguous FROM r WHERE n = 1")
def nearest_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d)


@query("WITH o AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate) // 86400 AS lo, epoch(o_orderdate) // 86400 + o_orderkey % 60 AS hi FROM orders), w AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o), "
 "s AS (SELECT *, CASE WHEN reach IS NULL OR lo > reach + 30 THEN 1 ELSE 0 END AS nw FROM w) SELECT o_custkey, o_orderkey, sum(nw) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey)::BIGINT AS band FROM s")
def interval_bands(spark: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("lo"), (day + F.col("o_orderkey") % 60).alias("hi"))
    return spatial.bands(o, "o_custkey", "lo", "hi", "o_orderkey", 30).select("o_custkey", "o_orderkey", "band")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return spatial.reading_order(t(spark, d, "conversations"), "conv_id", "turn", "text")


@query("WITH a AS (SELECT l_orderkey % 50 AS k, l_quantity / 7 AS a FROM lineitem), m AS (SELECT k, 0.5 * atan2(sum(sin(2 * a)), sum(cos(2 * a))) AS m FROM a GROUP BY k) SELECT k, round(CASE WHEN m < 0 THEN m + pi() ELSE m END, 6) AS mean FROM m")
def axial_means(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("k"), (F.col("l_quantity") / 7).alias("a"))
    return a.groupBy("k").agg(F.round(g.axial_mean(F.col("a")), 6).alias("mean"))


@query(f"WITH {_BOXES} SELECT id, round(w * h, 6) AS area, abs((x0 + w / 2 + 5) - (x0 + w / 2)) <= w / 2 AS inside FROM b")
def polygon_areas(spark: SparkSession, d: str) -> DataFrame:
    box = F.struct((F.col("x0") + F.col("w") / 2).alias("cx"), (F.col("y0") + F.col("h") / 2).alias("cy"), "w", "h", F.lit(0.3).alias("angle"))
    b = _boxes(spark, d).select("id", box.alias("box")).withColumn("ring", g.corners(F.col("box")))
    return b.select("id", F.round(g.polygon_area(F.col("ring")), 6).alias("area"), g.point_in_polygon(F.col("box.cx") + 5 * F.cos(F.lit(0.3)), F.col("box.cy") + 5 * F.sin(F.lit(0.3)), F.col("ring")).alias("inside"))
