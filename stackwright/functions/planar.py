"""Plane geometry beyond boxes: lines, segments, hulls, turned rectangles, projective maps, triangles, seams.

Shapes are lists of points here; ``on_points`` turns a function of such lists into an Arrow UDF over
array<struct<x, y>> columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import area, clipped, convex_hull

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POLYGON = T.ArrayType(POINT)
Points = list[tuple[float, float]]

# Tolerances in pixels.
ON_EDGE, STRICT, APART = 1.0, 1.5, 1e-3


def _points(value) -> Points:
    return [] if value is None else [(float(p["x"]), float(p["y"])) for p in value]


def on_points(f: Callable, kind: T.DataType, shapes: int = 1):
    """``f`` of the first ``shapes`` columns as point lists and the other columns as they are."""

    @F.pandas_udf(kind)
    def run(first: pd.Series, *more: pd.Series) -> pd.Series:
        out = []
        for row in zip(first, *more):
            v = f(*map(_points, row[:shapes]), *row[shapes:])
            out.append([{"x": x, "y": y} for x, y in v] if kind == POLYGON and v is not None else v)
        return pd.Series(out, dtype="float64" if isinstance(kind, T.DoubleType) else object)

    return run


# --- lines: a x + b y = c, with a unit normal ------------------------------------------------------


def line_through(p: Column, q: Column) -> Column:
    """struct(a, b, c) of the line through two points; the normal points left of p to q."""
    n = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
    a, b = (p["y"] - q["y"]) / n, (q["x"] - p["x"]) / n
    return F.struct(a.alias("a"), b.alias("b"), (a * p["x"] + b * p["y"]).alias("c"))


def signed_distance(line: Column, x: Column, y: Column) -> Column:
    return line["a"] * x + line["b"] * y - line["c"]


def crossing(m: Column, n: Column) -> Column:
    """The point of two lines; null for parallel ones."""
    det = m["a"] * n["b"] - n["a"] * m["b"]
    at = F.struct(((m["c"] * n["b"] - n["c"] * m["b"]) / det).alias("x"), ((m["a"] * n["c"] - n["a"] * m["c"]) / det).alias("y"))
    return F.when(F.abs(det) > 1e-12, at)


def y_at(line: Column, x: Column) -> Column:
    """Where a line stands at x; null for upright ones."""
    return F.when(F.abs(line["b"]) > 1e-12, (line["c"] - line["a"] * x) / line["b"])


def separates(line: Column, a: Column, b: Column) -> Column:
    """Whether all points of two shapes lie on opposite sides of a line."""
    d = lambda s: F.transform(s, lambda p: signed_distance(line, p["x"], p["y"]))
    over = lambda p, q: (F.array_min(d(p)) >= -APART) & (F.array_max(d(q)) <= APART)
    return over(a, b) | over(b, a)


def on_segment(x: Column, y: Column, p: Column, q: Column, tolerance: float = ON_EDGE) -> Column:
    """Whether a point is within a tolerance of a segment's line and between its ends."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    cross, dot = F.abs((x - p["x"]) * dy - (y - p["y"]) * dx), (x - p["x"]) * dx + (y - p["y"]) * dy
    return (cross <= tolerance * F.greatest(F.lit(1.0), F.hypot(dx, dy))) & (dot >= -tolerance) & (dot <= dx * dx + dy * dy + tolerance)


def edges(points: Column) -> Column:
    n = F.size(points)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(points, i).alias("p"), F.element_at(points, i % n + 1).alias("q")))


def on_boundary(x: Column, y: Column, points: Column, tolerance: float = ON_EDGE) -> Column:
    return F.exists(edges(points), lambda e: on_segment(x, y, e["p"], e["q"], tolerance))


def strictly_inside(x: Column, y: Column, points: Column) -> Column:
    """Inside a polygon and off its edges."""
    from .geometry import point_in_polygon

    return point_in_polygon(x, y, points) & ~on_boundary(x, y, points, STRICT)


def counter_clockwise(points: Column) -> Column:
    """The points with a positive area, turned round where it is negative."""
    twice = F.aggregate(edges(points), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
    return F.when(twice < 0, F.reverse(points)).otherwise(points)


def envelope(points: Column) -> Column:
    """struct(x0, y0, x1, y1)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def edge_angles(points: Column) -> Column:
    """struct(longest, angle, upright): the longest edge, its axial angle, whether it is within 20 degrees of upright."""
    lengths = F.transform(edges(points), lambda e: F.struct(F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]).alias("n"), F.pmod(F.atan2(e["q"]["y"] - e["p"]["y"], e["q"]["x"] - e["p"]["x"]), F.lit(math.pi)).alias("a")))
    best = F.array_max(lengths)
    return F.struct(best["n"].alias("longest"), best["a"].alias("angle"), (F.abs(best["a"] - math.pi / 2) <= math.radians(20)).alias("upright"))


def axis_aligned(points: Column, tolerance: float) -> Column:
    """Whether each edge is level or upright within a tolerance."""
    return F.forall(edges(points), lambda e: (F.abs(e["q"]["x"] - e["p"]["x"]) <= tolerance) | (F.abs(e["q"]["y"] - e["p"]["y"]) <= tolerance))


# --- whole shapes ----------------------------------------------------------------------------------


def is_convex(points: Points) -> bool:
    turns = {math.copysign(1, c) for p, q, r in zip(points, points[1:] + points[:1], points[2:] + points[:2]) if abs(c := (q[0] - p[0]) * (r[1] - q[1]) - (q[1] - p[1]) * (r[0] - q[0])) > 1e-9}
    return len(points) >= 3 and len(turns) == 1


def triangles(points: Points) -> list[Points]:
    """A simple polygon as triangles, ear by ear; each time the ear with the shortest cut goes."""
    ring = list(points if area(points) > 0 else points[::-1])
    out: list[Points] = []
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    while len(ring) > 3:
        best = None
        for i in range(len(ring)):
            a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
            if side(a, b, c) <= 1e-12:
                continue
            rest = [p for k, p in enumerate(ring) if p not in (a, b, c)]
            if any(side(a, b, p) >= 0 and side(b, c, p) >= 0 and side(c, a, p) >= 0 for p in rest):
                continue
            cut = math.dist(a, c)
            if best is None or cut < best[0]:
                best = (cut, i)
        if best is None:  # what is left has no area
            break
        i = best[1]
        out.append([ring[i - 1], ring[i], ring[(i + 1) % len(ring)]])
        ring.pop(i)
    if len(ring) == 3 and side(*ring) > 1e-12:
        out.append(ring)
    return out


def overlap_area(a: Points, b: Points) -> float:
    """The common area of two simple polygons, over pairs of their triangles."""
    if len(a) < 3 or len(b) < 3:
        return 0.0
    if is_convex(a) and is_convex(b):
        return abs(area(clipped(a, b)))
    return sum(abs(area(c)) for p in triangles(a) for q in triangles(b) if len(c := clipped(p, q)) >= 3)


def least_rectangle(points: Points) -> Points | None:
    """The rectangle of least area around some points: one of its sides lies on an edge of their hull."""
    hull = convex_hull(points)
    if len(hull) < 3:
        return None
    h, best = np.array(hull), None
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1]):
        n = math.hypot(bx - ax, by - ay)
        u = np.array([(bx - ax) / n, (by - ay) / n])
        v = np.array([-u[1], u[0]])
        s, t = h @ u, h @ v
        size = float((s.max() - s.min()) * (t.max() - t.min()))
        if best is None or size < best[0] - 1e-9:
            best = (size, [(float(x), float(y)) for p, q in ((s.min(), t.min()), (s.max(), t.min()), (s.max(), t.max()), (s.min(), t.max())) for x, y in [p * u + q * v]])
    return best[1]


def projective(source: Points, target: Points) -> np.ndarray | None:
    """The 3 x 3 matrix that takes four points to four others; null if there is none."""
    rows, want = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        want += [u, v]
    try:
        return np.append(np.linalg.solve(np.array(rows), np.array(want)), 1.0).reshape(3, 3)
    except np.linalg.LinAlgError:
        return None


def mapped(points: Points, source: Points, target: Points) -> Points | None:
    """Points under the projective map of four corners to four others."""
    m = projective(source, target)
    if m is None:
        return None
    p = np.column_stack([np.array(points), np.ones(len(points))]) @ m.T
    return [(float(x / w), float(y / w)) for x, y, w in p]


def segment_cross(a: Points, b: Points) -> tuple[float, float] | None:
    """Where two segments cross, as shares of their lengths; null if they do not."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = *a, *b
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    if abs(det) < 1e-12:
        return None
    t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
    return (t, u) if 0 <= t <= 1 and 0 <= u <= 1 else None


def separating_angle(a: Points, b: Points, steps: int = 180) -> float | None:
    """The first of ``steps`` axes, upright seams first, on which two shapes do not overlap; null if they always do."""
    p, q = np.array(a), np.array(b)
    for k in sorted(range(steps), key=lambda k: (min(k, steps - k), k)):
        u = np.array([math.cos(math.pi * k / steps), math.sin(math.pi * k / steps)])
        s, t = p @ u, q @ u
        if s.max() <= t.min() + APART or t.max() <= s.min() + APART:
            return math.pi * k / steps
    return None


def smooth(values: np.ndarray, width: int) -> np.ndarray:
    """Moving average with zeros beyond the ends; an even width counts as the next odd one."""
    width = max(1, width | 1)
    return np.convolve(values, np.ones(width) / width, "same") if len(values) >= width else np.convolve(values, np.ones(width) / width, "full")[width // 2 : width // 2 + len(values)]


def best_gap(values: np.ndarray, low: int, high: int, forbidden: list[tuple[int, int]], width: int = 5) -> int | None:
    """The place with the least smoothed value within a range and outside forbidden stretches; the first of equal ones."""
    s = smooth(np.asarray(values, float), width)
    open_ = np.zeros(len(s), bool)
    open_[max(0, low) : max(0, high + 1)] = True
    for a, b in forbidden:
        open_[max(0, a) : max(0, b + 1)] = False
    places = np.flatnonzero(open_)
    return int(places[np.argmin(s[places])]) if len(places) else None


hull_area = on_points(lambda p: abs(area(convex_hull(p))), T.DoubleType())
convex = on_points(lambda p: is_convex(p), T.BooleanType())
triangle_area = on_points(lambda p: sum(area(x) for x in triangles(p)), T.DoubleType())
common_area = on_points(overlap_area, T.DoubleType(), 2)
rectangle = on_points(least_rectangle, POLYGON)
projected = on_points(mapped, POLYGON, 3)
apart_angle = on_points(separating_angle, T.DoubleType(), 2)


# --- maps between pictures -------------------------------------------------------------------------


def letterbox(width: Column, height: Column, model: float) -> Column:
    """struct(gain, pad_x, pad_y) that fits a picture into a square."""
    gain = F.least(model / width, model / height)
    return F.struct(gain.alias("gain"), ((model - width * gain) / 2).alias("pad_x"), ((model - height * gain) / 2).alias("pad_y"))


def fitted(width: Column, height: Column, model: float) -> Column:
    """``letterbox`` without enlarging."""
    gain = F.least(F.lit(1.0), model / width, model / height)
    return F.struct(gain.alias("gain"), ((model - width * gain) / 2).alias("pad_x"), ((model - height * gain) / 2).alias("pad_y"))


def unletterboxed(x: Column, y: Column, box: Column) -> Column:
    return F.struct(((x - box["pad_x"]) / box["gain"]).alias("x"), ((y - box["pad_y"]) / box["gain"]).alias("y"))


def crop_to_scene(x: Column, y: Column, box: Column) -> Column:
    """A point of an upright crop of a turned box, in the scene."""
    c, s = F.cos(box["angle"]), F.sin(box["angle"])
    dx, dy = x - box["w"] / 2, y - box["h"] / 2
    return F.struct((box["cx"] + dx * c - dy * s).alias("x"), (box["cy"] + dx * s + dy * c).alias("y"))


def normalized_to_pixels(x: Column, y: Column, orientation: Column, width: Column, height: Column) -> Column:
    """A point in shares from the lower left, read in an orientation (up, right, down, left), in pixels from the upper left."""
    u = F.when(orientation == "up", x).when(orientation == "right", 1 - y).when(orientation == "down", 1 - x).otherwise(y)
    v = F.when(orientation == "up", 1 - y).when(orientation == "right", 1 - x).when(orientation == "down", y).otherwise(x)
    return F.struct((u * width).alias("x"), (v * height).alias("y"))
