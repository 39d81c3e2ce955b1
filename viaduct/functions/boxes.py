"""Oriented boxes as columns: centre and extent are arrays of three, yaw is the turn about z (up) in radians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from viaduct.functions.rotations import array, both, let


def in_box(p: Column, centre: Column, yaw: Column) -> Column:
    """A point in the box's own axes, about its centre."""
    return both(p, centre, lambda p, c: let(F.array(p[0] - c[0], p[1] - c[1], p[2] - c[2], F.cos(yaw), F.sin(yaw)), lambda d: array(d[3] * d[0] + d[4] * d[1], d[3] * d[1] - d[4] * d[0], d[2])))


def signed_distance(p: Column, centre: Column, extent: Column, yaw: Column) -> Column:
    """The distance of a point from a box's surface: negative inside, where it is the depth below the nearest face."""

    def made(d):
        out = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0)) * F.greatest(x, F.lit(0.0))))
        return out + F.least(F.array_max(d), F.lit(0.0))

    return let(F.zip_with(in_box(p, centre, yaw), extent, lambda x, e: F.abs(x) - e / 2), made)


def corners(centre: Column, extent: Column, yaw: Column) -> Column:
    """Eight points: x fastest, then y, then z, each from its negative side."""

    def made(c, e):
        out = []
        for z in (-0.5, 0.5):
            for y in (-0.5, 0.5):
                for x in (-0.5, 0.5):
                    out.append(array(c[0] + F.cos(yaw) * x * e[0] - F.sin(yaw) * y * e[1], c[1] + F.sin(yaw) * x * e[0] + F.cos(yaw) * y * e[1], c[2] + z * e[2]))
        return F.array(*out)

    return both(centre, extent, made)


def half_width(axis: Column, extent: Column, yaw: Column) -> Column:
    """Half of a box's width along a unit axis."""
    return both(axis, extent, lambda a, e: (F.abs(F.cos(yaw) * a[0] + F.sin(yaw) * a[1]) * e[0] + F.abs(F.cos(yaw) * a[1] - F.sin(yaw) * a[0]) * e[1] + F.abs(a[2]) * e[2]) / 2)
