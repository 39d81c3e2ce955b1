"""Boxes fitted to point clouds, and gates of camera paths against boxes, with reasons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.functions import boxes as B
from viaduct.functions.rotations import dot, let, unit

BLOCK = 8_192


def hull(p: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points in the plane, counter-clockwise from the least; fewer than three where all
    lie on a line."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points):
        kept: list[np.ndarray] = []
        for q in points:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (q[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (q[0] - kept[-2][0]):
                kept.pop()
            kept.append(q)
        return kept[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(corners: np.ndarray) -> tuple[float, float, float, float, float]:
    """Centre x, y, length, width and yaw of the rectangle of least area around a hull: one of its sides lies on an edge of
    the hull. yaw is the long side's, in (-pi/2, pi/2]; of equal areas the least yaw."""
    edges = np.roll(corners, -1, axis=0) - corners
    edges = edges[(edges**2).sum(axis=1) > 0] if len(edges) else edges
    angles = np.arctan2(edges[:, 1], edges[:, 0]) if len(edges) else np.zeros(1)
    best = None
    for a in angles:
        turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        q = corners @ turn.T
        low, high = q.min(axis=0), q.max(axis=0)
        size = high - low
        yaw = a if size[0] >= size[1] else a + np.pi / 2
        yaw = np.pi / 2 - (np.pi / 2 - yaw) % np.pi
        found = (round(float(size[0] * size[1]), 12), round(float(yaw), 12), *map(float, (low + high) / 2 @ turn), float(size.max()), float(size.min()), float(yaw))
        best = found if best is None or found < best else best
    return best[2:]


def fitted(points: DataFrame, node: str, least: int = 3) -> DataFrame:
    """node, n, centre, extent (length, width, height), yaw: the box of least area in the plane (z is up) around the points
    (node, x, y, z) of each node with at least so many. Blocks of a node's points are reduced to their hulls first, so a
    large node reaches its one task as hull corners only. Null and non-finite points take no part."""
    fine = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in "xyz"))
    kind = points.schema[node].dataType.simpleString()
    dealt = fine.select(node, *[F.col(c).cast("double").alias(c) for c in "xyz"], F.pmod(F.xxhash64("x", "y", "z"), F.lit(4_096)).alias("_h"))
    sizes = dealt.groupBy(node).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    blocked = dealt.join(sizes, node).withColumn("_b", F.pmod(F.col("_h"), F.ceil(F.col("n") / BLOCK)))

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({node: pdf[node].iloc[0], "n": len(pdf), "z0": pdf["z"].min(), "z1": pdf["z"].max(), "hull": [corners.ravel()]})

    parts = blocked.groupBy(node, "_b").applyInPandas(reduce, f"{node} {kind}, n long, z0 double, z1 double, hull array<double>")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, length, width, yaw = least_rectangle(hull(np.concatenate([np.reshape(h, (-1, 2)) for h in pdf["hull"]])))
        z0, z1 = pdf["z0"].min(), pdf["z1"].max()
        return pd.DataFrame({node: pdf[node].iloc[0], "n": pdf["n"].sum(), "centre": [[x, y, (z0 + z1) / 2]], "extent": [[length, width, z1 - z0]], "yaw": yaw})

    return parts.groupBy(node).applyInPandas(fit, f"{node} {kind}, n long, centre array<double>, extent array<double>, yaw double")


def clearance(frames: DataFrame, boxes: DataFrame, scene: str, clip: str, frame: str, node: str, margin: str | None = None) -> DataFrame:
    """scene, clip, frame, clearance, node, slack: of every frame's position (array of three) the box of its scene with the
    least slack, its signed distance less its margin; the least node of equals."""
    own = boxes.select(scene, node, "centre", "extent", "yaw", (F.col(margin) if margin else F.lit(0.0)).alias("_m"))
    met = frames.select(scene, clip, frame, "position").join(own, scene)
    distance = B.signed_distance(F.col("position"), F.col("centre"), F.col("extent"), F.col("yaw"))
    met = met.select(scene, clip, frame, node, distance.alias("_d"), "_m")
    best = F.min(F.struct((F.col("_d") - F.col("_m")).alias("slack"), F.col(node), F.col("_d").alias("clearance"))).alias("_b")
    return met.groupBy(scene, clip, frame).agg(best).select(scene, clip, frame, "_b.clearance", F.col(f"_b.{node}").alias(node), "_b.slack")


def profiles(frames: DataFrame, subjects: DataFrame, clip: str, frame: str, ground: Column) -> DataFrame:
    """Per frame of a clip against its subject's box (clip, centre, extent, yaw): elevation in degrees above the box's
    centre, height above the ground, gap (how far the near face is ahead, along the line from the clip's first position to
    the box's centre; negative once it is passed) and past (how far the far face is behind; positive once it is passed).
    gap and past are null where a clip starts in the centre."""
    first = frames.groupBy(clip).agg(F.min_by("position", frame).alias("_p"))
    subject = subjects.join(first, clip).withColumn("_a", unit(F.zip_with("centre", "_p", lambda c, p: c - p)))
    subject = subject.withColumn("_h", B.half_width(F.col("_a"), F.col("extent"), F.col("yaw"))).select(clip, "centre", "_a", "_h")
    met = frames.join(subject, clip).withColumn("_d", F.zip_with("position", "centre", lambda p, c: p - c))
    flat = F.sqrt(F.col("_d")[0] * F.col("_d")[0] + F.col("_d")[1] * F.col("_d")[1])
    along = dot(F.col("_d"), F.col("_a"))
    return met.select(
        clip, frame, F.degrees(F.atan2(F.col("_d")[2], F.greatest(flat, F.lit(1e-9)))).alias("elevation"), (F.col("position")[2] - ground).alias("height"), (-F.col("_h") - along).alias("gap"), (along - F.col("_h")).alias("past")
    )


def gated(clear: DataFrame, profile: DataFrame, clip: str, frame: str, least_slack: float, most_elevation: float, least_height: float, least_gap: float) -> DataFrame:
    """One row a clip: the worst of each gate over its frames, and reasons, all gates that it breaks, in their order. A
    missing gap breaks the approach gate: the clip starts in its subject."""
    met = profile.join(clear.select(clip, frame, "slack"), [clip, frame], "left")
    per = met.groupBy(clip).agg(F.min("slack").alias("slack"), F.max(F.abs("elevation")).alias("elevation"), F.min("height").alias("height"), F.min("gap").alias("gap"), F.count("*").alias("frames"))
    tests = [("obb", F.col("slack") < least_slack), ("elev", F.col("elevation") > most_elevation), ("ground", F.col("height") < least_height), ("approach", F.col("gap").isNull() | (F.col("gap") < least_gap))]
    return per.withColumn("reasons", F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in tests])))


def nearest_face(p: Column, centre: Column, extent: Column, yaw: Column) -> Column:
    """Which face a point is nearest to or deepest below: x, y or z."""
    return let(F.zip_with(B.in_box(p, centre, yaw), extent, lambda x, e: F.abs(x) - e / 2), lambda d: F.element_at(F.array(*map(F.lit, "xyz")), F.array_position(d, F.array_max(d)).cast("int")))
