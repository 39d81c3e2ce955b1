"""Polygons as columns: arrays of struct(x, y), in order around, without repeating the first point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from viaduct.functions.rotations import let

POLYGON = "array<struct<x: double, y: double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(width, height) -> Column:
    """The rectangle from the origin, counter-clockwise."""
    w, h, zero = (v if isinstance(v, Column) else F.lit(v) for v in (width, height, 0.0))
    return F.array(point(zero, zero), point(w, zero), point(w, h), point(zero, h))


def signed_area(polygon: Column) -> Column:
    """The area, positive counter-clockwise; 0 for fewer than three points, null for null."""

    def made(p):
        n = F.size(p)
        return F.aggregate(F.transform(p, lambda a, i: let(p[(i + 1) % n], lambda b: a["x"] * b["y"] - b["x"] * a["y"])), F.lit(0.0), lambda s, x: s + x) / 2

    return let(polygon, lambda p: F.when(F.size(p) >= 3, made(p)).when(p.isNotNull(), 0.0))


def clipped(polygon: Column, by: Column) -> Column:
    """The part of a polygon inside a convex one, given counter-clockwise: a fold over the clipping edges, each of which
    keeps the points on its left and adds the points where it is crossed. Points on an edge are inside. The empty array
    where nothing is left; null where either is null. What falls apart stays joined along the clipping edges."""

    def cut(poly, edge):
        a, b = edge["a"], edge["b"]
        side = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

        def step(p, i):
            def met(q, s0, s1):
                t = s0 / (s0 - s1)
                cross = F.array(point(q["x"] + t * (p["x"] - q["x"]), q["y"] + t * (p["y"] - q["y"])))
                return F.when((s1 >= 0) & (s0 >= 0), F.array(p)).when(s1 >= 0, F.concat(cross, F.array(p))).when(s0 >= 0, cross).otherwise(F.array().cast(POLYGON))

            return let(poly[(i + F.size(poly) - 1) % F.size(poly)], lambda q: let(side(q), lambda s0: let(side(p), lambda s1: met(q, s0, s1))))

        return F.flatten(F.transform(poly, step)).cast(POLYGON)

    edges = let(by, lambda c: F.transform(c, lambda a, i: F.struct(a.alias("a"), c[(i + 1) % F.size(c)].alias("b"))))
    return F.aggregate(edges, polygon.cast(POLYGON), cut)
