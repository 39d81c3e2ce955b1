"""Shapes of camera paths in space, parked frames, projections, and sweeps of filters.

Frames are rows (path, frame, centre: array of three). Series run in windows of a path, sorted and streamed; spectra and
distances of all pairs go through moments and tiles, so no path has to fit one task for them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.rotations import dot, rotated, rotation_of, translation_of
from viaduct.operators import metrics as M
from viaduct.operators import spectra as S


def gap(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def shapes(frames: DataFrame, path: str, frame: str) -> DataFrame:
    """path, length, chord, reach (farthest from the first frame), straightness (chord by length, null without motion), ratio2
    and ratio3 (second and third singular value of the centres about their mean, by the first; null without spread)."""
    w = Window.partitionBy(path).orderBy(frame)
    moved = frames.select(path, frame, "centre", gap(F.col("centre"), F.lag("centre").over(w)).alias("_step"))
    ends = frames.groupBy(path).agg(F.min_by("centre", frame).alias("_first"), F.max_by("centre", frame).alias("_last"))
    per = moved.join(ends, path).groupBy(path).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"), F.max(gap(F.col("centre"), F.col("_first"))).alias("reach"), F.first(gap(F.col("_first"), F.col("_last"))).alias("chord"))
    spectrum = S.spectrum(S.regular(frames.select(path, "centre"), path, "centre"), path, "centre", 1)
    found = spectrum.select(path, F.get("ratios", F.lit(1)).alias("ratio2"), F.get("ratios", F.lit(2)).alias("ratio3"), (F.sqrt(F.get("variances", F.lit(0)) * F.col("n")) >= 1e-12).alias("_wide"))
    straight = F.when(F.col("length") > 1e-9, F.col("chord") / F.col("length"))
    wide = lambda c: F.when(F.col("_wide"), F.col(c)).alias(c)
    return per.join(found, path, "left").select(path, "length", "chord", "reach", straight.alias("straightness"), wide("ratio2"), wide("ratio3"))


def shape_summary(found: DataFrame, percents: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """One row: percentiles of straightness, ratio2, ratio3, length and reach, the share of paths that are nearly straight,
    and of those that are nearly a line."""
    columns = ("straightness", "ratio2", "ratio3", "length", "reach")
    share = lambda c, test: F.avg(F.when(F.col(c).isNotNull(), test.cast("int")))
    return found.agg(
        *[F.percentile(c, p).alias(f"{c}_p{round(100 * p):02d}") for c in columns for p in percents],
        share("straightness", F.col("straightness") > 0.99).alias("straight_share"), share("ratio2", F.col("ratio2") < 0.01).alias("line_share"), F.count("*").alias("paths"),
    )


def extents(frames: DataFrame, path: str) -> DataFrame:
    """path, extent: the greatest distance of two centres, over tiles of a path (quadratic in a path by definition)."""
    kind = frames.schema[path].dataType.simpleString()
    placed = frames.withColumn("pos", F.row_number().over(Window.partitionBy(path).orderBy("centre")) - 1)
    packed = M.tiles(placed, path, "pos", "centre")

    def compare(g, x, y, a, b):
        return pd.DataFrame({path: [g], "extent": [float(M.distances(a, b).max())]})

    return M.met(packed, packed, path, compare, f"{path} {kind}, extent double").groupBy(path).agg(F.max("extent").alias("extent"))


def parked(frames: DataFrame, path: str, frame: str, tolerance: float) -> DataFrame:
    """path, n, extent, share, run: the share of frames in the cell of most centres (the least cell of equals), in a grid as
    wide as the tolerance times the extent, and their longest run of frames one after the other."""
    sized = frames.join(extents(frames, path), path)
    cell = F.transform("centre", lambda x: F.rint(x / F.greatest(tolerance * F.col("extent"), F.lit(1e-9))).cast("long"))
    w = Window.partitionBy(path).orderBy(frame)
    celled = sized.select(path, frame, "extent", cell.alias("cell"), F.row_number().over(w).alias("i"))
    counts = celled.groupBy(path, "cell").agg(F.count("*").alias("m"))
    big = counts.groupBy(path).agg(F.sum("m").alias("n"), F.min(F.struct(-F.col("m"), "cell")).alias("b")).select(path, "n", (-F.col("b.col1")).alias("m"), F.col("b.cell").alias("cell"))
    inside = celled.join(big, [path, "cell"]).withColumn("island", F.col("i") - F.row_number().over(w))
    runs = inside.groupBy(path, "island").agg(F.count("*").alias("run"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("extent").alias("extent"))
    return runs.groupBy(path).agg(F.first("n").alias("n"), F.first("extent").alias("extent"), (F.first("m") / F.first("n")).alias("share"), F.max("run").alias("run"))


def tau(position: Column, source: Column, depth: Column) -> Column:
    """How far a camera has moved from its source, by the median depth."""
    return gap(position, source) / F.greatest(depth, F.lit(1e-9))


def view_angle(position: Column, source: Column, target: Column) -> Column:
    """Degrees between the ways in which a camera and its source see a target."""
    a, b = F.zip_with(target, position, lambda t, p: t - p), F.zip_with(target, source, lambda t, p: t - p)
    cosine = dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-9))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def projected(point: Column, w2c: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """struct(u, v, z) of a point in a camera's frame; z not above 0 lies behind it."""
    seen = F.zip_with(rotated(rotation_of(w2c), point), translation_of(w2c), lambda a, b: a + b)
    z = F.when(F.abs(seen[2]) < 1e-9, F.lit(1e-9)).otherwise(seen[2])
    return F.struct(((fx * seen[0] + cx * seen[2]) / z).alias("u"), ((fy * seen[1] + cy * seen[2]) / z).alias("v"), seen[2].alias("z"))


def quantile_bins(rows: DataFrame, value: str, bins: int, medians: list[str]) -> DataFrame:
    """bin (from 1), low, high, n and the medians of columns: bins between the quantiles of value, the lowest with its lower
    end; equal edges are one, so there may be fewer. Null and NaN values are in none."""
    fine = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    edges = fine.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("_e"))
    at = F.size(F.filter("_e", lambda e: e < F.col(value)))
    placed = fine.join(F.broadcast(edges)).withColumn("bin", F.greatest(at, F.lit(1))).where(F.size("_e") > 1)
    per = placed.groupBy("bin").agg(F.count("*").alias("n"), F.first("_e").alias("_e"), *[F.median(c).alias(f"median_{c}") for c in medians])
    return per.select("bin", F.get("_e", F.col("bin") - 1).alias("low"), F.get("_e", F.col("bin")).alias("high"), "n", *[f"median_{c}" for c in medians])


def sweep(rows: DataFrame, value: str, bad: float, filters: dict[str, Column], least: int = 10) -> DataFrame:
    """filter, kept (share of rows), p95, p99, most and above (the share over bad) of a value, of the rows that each filter
    keeps; filters that keep fewer than so many rows are left out. One pass for all filters."""
    figures = []
    for name, keep in filters.items():
        x = F.when(F.coalesce(keep, F.lit(False)), F.col(value))
        figures.append(F.struct(F.lit(name).alias("filter"), F.count_if(keep).alias("n"), F.avg(F.coalesce(keep, F.lit(False)).cast("int")).alias("kept"), F.percentile(x, 0.95).alias("p95"), F.percentile(x, 0.99).alias("p99"), F.max(x).alias("most"), F.avg(F.when(x.isNotNull(), (x > bad).cast("int"))).alias("above")))
    return rows.agg(F.array(*figures).alias("_f")).select(F.inline("_f")).where(F.col("n") >= least).drop("n")
