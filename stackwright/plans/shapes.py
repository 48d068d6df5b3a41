"""Plane geometry over shapes made from parts and orders, with the same arithmetic in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.functions import geometry as g
from stackwright.functions import planar as pl
from stackwright.functions import quality as q
from stackwright.operators import spatial

from .tables import register, t

QUERIES, SQL, query = register()


def _pt(x, y):
    return F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "cast") else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not hasattr(y, "cast") else y.cast("double").alias("y"))


def _ell(spark: SparkSession, d: str) -> DataFrame:
    """An L of six points for each part: a square of 10 + size less its upper right quarter of a share."""
    s, k = (F.col("p_size") + 10).cast("double"), (F.col("p_partkey") % 7 + 1).cast("double")
    cut = s * k / 10
    pts = F.array(_pt(0.0, 0.0), _pt(s, 0.0), _pt(s, s - cut), _pt(s - cut, s - cut), _pt(s - cut, s), _pt(0.0, s))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), s.alias("s"), cut.alias("cut"), pts.alias("points"))


@query("WITH e AS (SELECT p_partkey AS id, (p_size + 10)::DOUBLE AS s, (p_size + 10) * (p_partkey % 7 + 1) / 10.0 AS c FROM part) SELECT id, round(s * s - c * c, 4) AS area, round(s * s - c * c, 4) AS by_triangles, round(s * s - c * c / 2, 4) AS hull, false AS convex, round(s * s, 4) AS envelope FROM e")
def ell_areas(spark: SparkSession, d: str) -> DataFrame:
    """Shoelace, ear clipping, hull, convexity and envelope of a shape that is not convex."""
    e, p = _ell(spark, d), F.col("points")
    box = pl.envelope(p)
    return e.select("id", F.round(g.polygon_area(p), 4).alias("area"), F.round(pl.triangle_area(p), 4).alias("by_triangles"), F.round(pl.hull_area(p), 4).alias("hull"), pl.convex(p).alias("convex"), F.round((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]), 4).alias("envelope"))


@query("WITH e AS (SELECT p_partkey AS id, (p_size + 10)::DOUBLE AS s, (p_size + 10) * (p_partkey % 7 + 1) / 10.0 AS c, (p_size + 10) * (p_partkey % 3) / 4.0 AS o FROM part) SELECT id, round((s - o) * (s - o) - least(c, s - o) * least(c, s - o), 4) AS common FROM e")
def common_areas(spark: SparkSession, d: str) -> DataFrame:
    """The L with a square moved along the diagonal from its lower left."""
    e = _ell(spark, d)
    o = F.col("s") * (F.col("id") % 3) / 4
    far = o + F.col("s") * 2
    square = F.array(F.struct(o.alias("x"), o.alias("y")), F.struct(far.alias("x"), o.alias("y")), F.struct(far.alias("x"), far.alias("y")), F.struct(o.alias("x"), far.alias("y")))
    return e.select("id", F.round(pl.common_area("points", square), 4).alias("common"))


@query("""WITH e AS (SELECT p_partkey AS id, (p_size + 10)::DOUBLE AS s, (p_size + 10) * (p_partkey % 7 + 1) / 10.0 AS c, (p_partkey * 13 % 60)::DOUBLE + 0.25 AS x, (p_partkey * 29 % 60)::DOUBLE + 0.25 AS y FROM part),
z AS (SELECT *, x <= s AND y <= s AND NOT (x > s - c AND y > s - c) AS plain FROM e) SELECT id, plain FROM z""")
def points_in_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Ray casting without a tolerance."""
    k = F.col("id")
    x, y = (k * 13 % 60).cast("double") + 0.25, (k * 29 % 60).cast("double") + 0.25
    return _ell(spark, d).select("id", g.point_in_polygon(x, y, F.col("points"), boundary=False).alias("plain"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, count(*)::BIGINT AS k, bool_or(d <= 1) AS near, bool_or(d <= 1.5) AS wide FROM (SELECT l_orderkey, l_linenumber, abs(l_quantity - 25.25) AS d FROM lineitem) GROUP BY ALL")
def edge_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Whether a point is on the upper edge of a square from 0 to 25.25, by two tolerances."""
    e = 25.25
    x, y = F.lit(10.0), F.col("l_quantity")
    p, r = _pt(0.0, e), _pt(e, e)
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), pl.on_segment(x, y, p, r).alias("near"), pl.on_segment(x, y, p, r, pl.STRICT).alias("wide"))
    return li.groupBy("id", "n").agg(F.count("*").alias("k"), F.max("near").alias("near"), F.max("wide").alias("wide"))


@query("""WITH e AS (SELECT p_partkey AS id, (p_size + 5)::DOUBLE AS w, (p_partkey % 17 + 3)::DOUBLE AS h, (p_partkey % 36) * 5 * pi() / 180 AS a FROM part) SELECT id, round(w * h, 4) AS area, round(greatest(w, h), 4) AS long_side FROM e""")
def least_rectangles(spark: SparkSession, d: str) -> DataFrame:
    """The corners of turned boxes and their middles back to a rectangle."""
    k = F.col("p_partkey")
    box = F.struct(F.lit(50.0).alias("cx"), F.lit(40.0).alias("cy"), (F.col("p_size") + 5).cast("double").alias("w"), (k % 17 + 3).cast("double").alias("h"), (k % 36 * 5 * 3.141592653589793 / 180).alias("angle"))
    c = g.corners(box)
    more = F.concat(c, F.array(_pt(50.0, 40.0)))
    e = t(spark, d, "part").select(k.alias("id"), pl.rectangle(more).alias("r"))
    side = lambda i, j: F.hypot(F.col("r")[j]["x"] - F.col("r")[i]["x"], F.col("r")[j]["y"] - F.col("r")[i]["y"])
    return e.select("id", F.round(g.polygon_area(F.col("r")), 4).alias("area"), F.round(F.greatest(side(0, 1), side(1, 2)), 4).alias("long_side"))


@query("""WITH e AS (SELECT p_partkey AS id, 100.0 + p_size AS w, 60.0 + p_partkey % 30 AS h, (p_partkey * 7 % 90)::DOUBLE AS x, (p_partkey * 11 % 50)::DOUBLE AS y FROM part) SELECT id, round(x / w * 640 + 5, 4) AS u, round(y / h * 480 + 7, 4) AS v FROM e""")
def projective_points(spark: SparkSession, d: str) -> DataFrame:
    """A projective map that is a plain one: a rectangle to another."""
    k = F.col("p_partkey")
    w, h = (F.col("p_size") + 100).cast("double"), (k % 30 + 60).cast("double")
    src = F.array(_pt(0.0, 0.0), _pt(w, 0.0), _pt(w, h), _pt(0.0, h))
    dst = F.array(_pt(5.0, 7.0), _pt(645.0, 7.0), _pt(645.0, 487.0), _pt(5.0, 487.0))
    e = t(spark, d, "part").select(k.alias("id"), pl.projected(F.array(_pt(k * 7 % 90, k * 11 % 50)), src, dst).alias("m"))
    return e.select("id", F.round(F.col("m")[0]["x"], 4).alias("u"), F.round(F.col("m")[0]["y"], 4).alias("v"))


@query("""WITH e AS (SELECT p_partkey AS id, 600.0 + p_size * 10 AS w, 300.0 + p_partkey % 500 AS h FROM part), f AS (SELECT *, least(640 / w, 640 / h) AS g, least(1.0, least(640 / w, 640 / h)) AS s FROM e)
SELECT id, round(g, 6) AS gain, round((640 - w * g) / 2, 4) + 0 AS pad_x, round((640 - h * g) / 2, 4) + 0 AS pad_y, round(s, 6) AS small, round((100 - (640 - w * g) / 2) / g, 4) AS x, round((200 - (640 - h * g) / 2) / g, 4) AS y FROM f""")
def letterboxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    w, h = (F.col("p_size") * 10 + 600).cast("double"), (k % 500 + 300).cast("double")
    e = t(spark, d, "part").select(k.alias("id"), pl.letterbox(w, h, 640.0).alias("b"), pl.fitted(w, h, 640.0).alias("f"))
    at = pl.unletterboxed(F.lit(100.0), F.lit(200.0), F.col("b"))
    return e.select("id", F.round("b.gain", 6).alias("gain"), (F.round("b.pad_x", 4) + 0).alias("pad_x"), (F.round("b.pad_y", 4) + 0).alias("pad_y"), F.round("f.gain", 6).alias("small"), F.round(at["x"], 4).alias("x"), F.round(at["y"], 4).alias("y"))


@query("""WITH e AS (SELECT p_partkey AS id, 20.0 + p_size AS w, 10.0 + p_partkey % 9 AS h, (p_partkey % 90) * pi() / 180 AS a, ['up', 'right', 'down', 'left'][p_partkey % 4 + 1] AS o, (p_partkey % 11) / 10.0 AS x, (p_partkey % 7) / 6.0 AS y FROM part),
n AS (SELECT *, CASE o WHEN 'up' THEN x WHEN 'right' THEN 1 - y WHEN 'down' THEN 1 - x ELSE y END * w AS u, CASE o WHEN 'up' THEN 1 - y WHEN 'right' THEN 1 - x WHEN 'down' THEN y ELSE x END * h AS v FROM e)
SELECT id, round(u, 4) AS u, round(v, 4) AS v, round(100 + (u - w / 2) * cos(a) - (v - h / 2) * sin(a), 4) AS sx, round(80 + (u - w / 2) * sin(a) + (v - h / 2) * cos(a), 4) AS sy FROM n""")
def crop_points(spark: SparkSession, d: str) -> DataFrame:
    """Points in shares of a crop, by its orientation, to pixels and to the scene."""
    k = F.col("p_partkey")
    w, h = (F.col("p_size") + 20).cast("double"), (k % 9 + 10).cast("double")
    o = F.element_at(F.array(*map(F.lit, ["up", "right", "down", "left"])), (k % 4).cast("int") + 1)
    box = F.struct(F.lit(100.0).alias("cx"), F.lit(80.0).alias("cy"), w.alias("w"), h.alias("h"), (k % 90 * 3.141592653589793 / 180).alias("angle"))
    e = t(spark, d, "part").select(k.alias("id"), box.alias("box"), pl.normalized_to_pixels(k % 11 / 10, k % 7 / 6, o, w, h).alias("p"))
    s = pl.crop_to_scene(F.col("p.x"), F.col("p.y"), F.col("box"))
    return e.select("id", F.round("p.x", 4).alias("u"), F.round("p.y", 4).alias("v"), F.round(s["x"], 4).alias("sx"), F.round(s["y"], 4).alias("sy"))


@query("""WITH e AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS pk, l_suppkey AS sk, l_quantity AS q, l_discount * 100 AS m FROM lineitem) SELECT id, n, pk, sk, round((q - m) / sqrt(2), 5) + 0 AS away, round(q / 2 + m / 2, 5) AS cross_x, round(q, 5) AS y FROM e""")
def line_operations(spark: SparkSession, d: str) -> DataFrame:
    """The diagonal y = x: a point's distance, its crossing with a falling line, its height."""
    x, m = F.col("l_quantity"), F.round(F.col("l_discount") * 100, 6)
    diagonal = pl.line_through(_pt(0.0, 0.0), _pt(1.0, 1.0))
    falling = pl.line_through(F.struct(x.alias("x"), m.alias("y")), F.struct((x - 1).alias("x"), (m + 1).alias("y")))
    li = t(spark, d, "lineitem")
    # The normal points to the left of the direction, so that a point below has a negative distance.
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), (F.round(-pl.signed_distance(diagonal, x, m), 5) + 0).alias("away"), F.round(pl.crossing(diagonal, falling)["x"], 5).alias("cross_x"), F.round(pl.y_at(diagonal, x), 5).alias("y"))


@query("""WITH e AS (SELECT p_partkey AS id, (p_size + 5)::DOUBLE AS w, (p_partkey % 17 + 3)::DOUBLE AS h, (p_partkey % 36) * 5 AS deg FROM part), f AS (SELECT *, CASE WHEN w >= h THEN deg ELSE (deg + 90) % 180 END AS a FROM e)
SELECT id, round(greatest(w, h), 4) AS longest, abs(a - 90) <= 20 AS upright, deg % 90 = 0 AS aligned FROM f WHERE w <> h""")
def edge_angles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    w, h = (F.col("p_size") + 5).cast("double"), (k % 17 + 3).cast("double")
    box = F.struct(F.lit(50.0).alias("cx"), F.lit(40.0).alias("cy"), w.alias("w"), h.alias("h"), (k % 36 * 5 * 3.141592653589793 / 180 + 1e-9).alias("angle"))
    e = t(spark, d, "part").filter(w != h).select(k.alias("id"), g.corners(box).alias("c"))
    a = pl.edge_angles(F.col("c"))
    return e.select("id", F.round(a["longest"], 4).alias("longest"), (F.abs(F.round(F.degrees(a["angle"]), 4) - 90) <= 20).alias("upright"), pl.axis_aligned(F.col("c"), 1e-4).alias("aligned"))


@query("""WITH e AS (SELECT doc_id, text, greatest(8, length(text) // 40) AS w FROM documents WHERE length(text) >= 64 AND text = strip_accents(text) AND regexp_full_match(text, '[\\x00-\\x7f]*')), b AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: ord(c)) AS p FROM e) SELECT doc_id, round(1 - abs(list_avg(p) - 127.5) / 127.5, 6) AS exposure FROM b""")
def picture_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Plain ASCII texts of 64 characters or more, taken as samples."""
    e = t(spark, d, "documents").filter(F.length("text") >= 64).filter(F.col("text").rlike(r"\A[\x00-\x7f]*\z"))
    return e.select("doc_id", F.round(q.exposure(F.col("text").cast("binary")), 6).alias("exposure"))


def _scene(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, d, "part").select(k.alias("id"), (k % 25).alias("scene"), (k * 37 % 1000).cast("double").alias("x0"), (k * 53 % 800).cast("double").alias("y0"), (F.col("p_size") * 4 + 20).cast("double").alias("w"), (F.col("p_size") * 3 + 15).cast("double").alias("h"), (k * 31 % 100 / 100).alias("conf"))


_SCENE = "b AS (SELECT p_partkey AS id, p_partkey % 25 AS scene, (p_partkey * 37 % 1000)::DOUBLE AS x0, (p_partkey * 53 % 800)::DOUBLE AS y0, (20 + p_size * 4)::DOUBLE AS w, (15 + p_size * 3)::DOUBLE AS h, (p_partkey * 31 % 100) / 100.0 AS conf FROM part)"


@query(f"WITH {_SCENE} SELECT scene, count(*) FILTER (conf >= 0.15)::BIGINT AS low, count(*) FILTER (conf >= 0.5)::BIGINT AS middle, count(*) FILTER (conf >= 0.7)::BIGINT AS high, round(least(1, count(*) FILTER (conf >= 0.5) / 5.0), 6) AS proxy, round(avg(conf), 6) AS mean, round(median(least(w, h)), 6) AS thick, round(avg(w * h / ((x0 + w) * (y0 + h))), 6) AS fill FROM b GROUP BY scene")
def scene_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conf")
    at = lambda v: F.count_if(c >= v)
    return _scene(spark, d).groupBy("scene").agg(at(0.15).alias("low"), at(0.5).alias("middle"), at(0.7).alias("high"), F.round(F.least(F.lit(1.0), at(0.5) / 5.0), 6).alias("proxy"), F.round(F.avg("conf"), 6).alias("mean"), F.round(F.percentile(F.least("w", "h"), 0.5), 6).alias("thick"), F.round(F.avg(F.col("w") * F.col("h") / ((F.col("x0") + F.col("w")) * (F.col("y0") + F.col("h")))), 6).alias("fill"))


_PAIRS = f"""{_SCENE}, p AS (SELECT x.scene, x.id AS a, y.id AS b, greatest(0, least(x.x0 + x.w, y.x0 + y.w) - greatest(x.x0, y.x0)) * greatest(0, least(x.y0 + x.h, y.y0 + y.h) - greatest(x.y0, y.y0)) AS i, x.w * x.h AS p, y.w * y.h AS q FROM b x JOIN b y ON x.scene = y.scene AND x.id < y.id), e AS (SELECT scene, a, b FROM p WHERE i / (p + q - i) >= 0.1)"""


@query(f"""WITH RECURSIVE {_PAIRS}, bi AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, root) AS (SELECT id, id FROM b UNION SELECT bi.b, r.root FROM r JOIN bi ON bi.a = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
s AS (SELECT root, count(*) AS n FROM c GROUP BY root) SELECT b.scene, count(*)::BIGINT AS boxes, round(count(*) FILTER (s.n >= 2) / count(*), 6) AS grouped, (SELECT count(*) FROM e WHERE e.scene = b.scene)::BIGINT AS pairs FROM b JOIN c ON c.node = b.id JOIN s USING (root) GROUP BY b.scene""")
def overlap_components(spark: SparkSession, d: str) -> DataFrame:
    """Per scene the share of boxes in a group of overlapping ones, and the overlapping pairs."""
    return spatial.overlap_groups(_scene(spark, d), "scene", 0.1, 100.0)


@query(f"WITH {_PAIRS} SELECT scene, id FROM b WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM p WHERE p.scene = b.scene AND ((p.a = b.id AND p.b % 2 = 0) OR (p.b = b.id AND p.a % 2 = 0)) AND i > 0)")
def boxes_without_truth(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of odd ids that touch no box of even id in their scene."""
    s = _scene(spark, d).select("id", "scene", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
    return spatial.untouched(s.filter("id % 2 = 1"), s.filter("id % 2 = 0"), "scene", 100.0).select("scene", "id")
