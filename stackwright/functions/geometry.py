"""Geometry of boxes and polygons as Column expressions; polygon clipping is an Arrow UDF.

A box is a struct<cx, cy, w, h, angle: double>; a polygon an array<struct<x, y: double>>.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def axial(a: Column) -> Column:
    """An angle in [0, pi)."""
    return F.pmod(a, F.lit(math.pi))


def axial_difference(a: Column, b: Column) -> Column:
    d = axial(a - b)
    return F.least(d, F.lit(math.pi) - d)


def axial_mean(a: Column) -> Column:
    """Mean direction of angles with period pi (an aggregate)."""
    return axial(0.5 * F.atan2(F.sum(F.sin(2 * a)), F.sum(F.cos(2 * a))))


def corners(box: Column) -> Column:
    """The four corners of a turned box, in order."""
    c, s = F.cos(box["angle"]), F.sin(box["angle"])
    at = lambda dx, dy: F.struct((box["cx"] + dx * box["w"] / 2 * c - dy * box["h"] / 2 * s).alias("x"), (box["cy"] + dx * box["w"] / 2 * s + dy * box["h"] / 2 * c).alias("y"))
    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))


def point_in_box(x: Column, y: Column, box: Column) -> Column:
    """Whether a point lies in a turned box, its edge included, by turning it back."""
    c, s = F.cos(box["angle"]), F.sin(box["angle"])
    dx, dy = x - box["cx"], y - box["cy"]
    return (F.abs(dx * c + dy * s) <= box["w"] / 2) & (F.abs(dy * c - dx * s) <= box["h"] / 2)


def polygon_area(points: Column) -> Column:
    """Unsigned area by the shoelace sum; 0 below three points."""
    n = F.size(points)

    def add(acc: Column, i: Column) -> Column:
        p, q = F.element_at(points, i), F.element_at(points, i % n + 1)
        return acc + p["x"] * q["y"] - q["x"] * p["y"]

    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), add)) / 2)


def aabb_iou(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Intersection over union of two upright boxes; 0 for boxes without area."""
    w = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    both = w * h
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def ring(box: tuple[float, float, float, float, float]) -> list[tuple[float, float]]:
    cx, cy, w, h, angle = box
    c, s = math.cos(angle), math.sin(angle)
    return [(cx + dx * w / 2 * c - dy * h / 2 * s, cy + dx * w / 2 * s + dy * h / 2 * c) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def area(points: list[tuple[float, float]]) -> float:
    return 0.5 * sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1]))


def clipped(subject: list[tuple[float, float]], clip: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a convex one: half planes of its edges, one after the other."""
    if area(clip) < 0:
        clip = clip[::-1]
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in subject]
        out = []
        for i, (p, d) in enumerate(zip(subject, side)):
            q, e = subject[i - 1], side[i - 1]
            if (d >= 0) != (e >= 0):
                t = e / (e - d)
                out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if d >= 0:
                out.append(p)
        subject = out
        if not subject:
            break
    return subject


def box_iou(a: tuple, b: tuple) -> float:
    """Intersection over union of turned boxes."""
    if math.hypot(a[0] - b[0], a[1] - b[1]) > (math.hypot(a[2], a[3]) + math.hypot(b[2], b[3])) / 2:
        return 0.0
    both = abs(area(clipped(ring(a), ring(b)))) if a[2] * a[3] and b[2] * b[3] else 0.0
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0


@F.pandas_udf(T.DoubleType())
def rotated_iou(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    """``box_iou`` of two struct columns (cx, cy, w, h, angle)."""
    keys = ["cx", "cy", "w", "h", "angle"]
    return pd.Series([box_iou(x, y) for x, y in zip(a[keys].itertuples(index=False, name=None), b[keys].itertuples(index=False, name=None))], dtype="float64")


def point_in_polygon(x: Column, y: Column, points: Column, boundary: bool = True) -> Column:
    """Ray casting over an array of points; with ``boundary`` a point within a pixel of an edge is inside."""
    n = F.size(points)

    def flip(inside: Column, i: Column) -> Column:
        p, q = F.element_at(points, i), F.element_at(points, i % n + 1)
        crosses = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return F.when(crosses & (x < at), ~inside).otherwise(inside)

    inside = F.when(n >= 3, F.aggregate(F.sequence(F.lit(1), n), F.lit(False), flip)).otherwise(False)
    if not boundary:
        return inside
    from .planar import on_boundary

    return inside | ((n >= 3) & on_boundary(x, y, points))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Monotone chain."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])
