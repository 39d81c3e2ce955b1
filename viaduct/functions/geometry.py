"""Camera geometry on flat arrays: 3x4 world-to-camera matrices as array<double>(12), row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(m: Column, row: int, col: int) -> Column:
    return F.element_at(m, 4 * row + col + 1)


def centre(m: Column) -> Column:
    """The camera's place, -R^T t."""
    return F.array(*[-sum((at(m, r, c) * at(m, r, 3) for r in range(3)), F.lit(0.0)) for c in range(3)])


def inverse(m: Column) -> Column:
    """The inverse of a rigid transform: R^T and -R^T t."""
    place = centre(m)
    return F.array(*[x for r in range(3) for x in (*(at(m, c, r) for c in range(3)), F.element_at(place, r + 1))])


def product(a: Column, b: Column) -> Column:
    """a after b, both rigid."""
    def cell(r: int, c: int) -> Column:
        out = sum((at(a, r, k) * at(b, k, c) for k in range(3)), F.lit(0.0))
        return out + at(a, r, 3) if c == 3 else out

    return F.array(*[cell(r, c) for r in range(3) for c in range(4)])


def angle(a: Column, b: Column) -> Column:
    """Degrees between the rotations of a and b."""
    trace = sum((at(a, r, c) * at(b, r, c) for r in range(3) for c in range(3)), F.lit(0.0))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (trace - 1) / 2))))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((F.element_at(a, i) - F.element_at(b, i)) ** 2 for i in (1, 2, 3)), F.lit(0.0)))


def project(m: Column, point: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Pixel (u, v) and depth of a world point; u and v are null behind the camera."""
    cam = [sum((at(m, r, c) * F.element_at(point, c + 1) for c in range(3)), F.lit(0.0)) + at(m, r, 3) for r in range(3)]
    front = cam[2] > 0
    return F.struct(F.when(front, fx * cam[0] / cam[2] + cx).alias("u"), F.when(front, fy * cam[1] / cam[2] + cy).alias("v"), cam[2].alias("depth"))


def motion_class(dx: Column, dy: Column, dz: Column, least: float = 0.02) -> Column:
    """One of 27 translation classes: each axis still, ahead or back by its threshold, as base-3 digits."""
    digit = lambda v: F.when(v > least, 1).when(v < -least, 2).otherwise(0)
    return digit(dx) * 9 + digit(dy) * 3 + digit(dz)
