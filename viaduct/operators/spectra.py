"""Spectra of vector sets: moments summed by Spark, principal axes with a fixed sign, projections of all rows.

A task adds up the moments of its rows to one n, sum and d x d matrix a group, and these few rows are added again, so
vectors never meet; the eigenvectors are those of one small matrix a group. Rows without a vector, with a null or
non-finite component, or of another length than the group's first kept length (the most frequent, then the smallest)
take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regular(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """rows whose vector is whole and of its group's length, the vector as doubles."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn(vector, F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(fine)
    lengths = rows.groupBy(group, F.size(vector).alias("_d")).agg(F.count("*").alias("_n"))
    best = lengths.groupBy(group).agg(F.max_by("_d", F.struct("_n", -F.col("_d"))).alias("_d"))
    return rows.join(best, group).where(F.size(vector) == F.col("_d")).drop("_d")


def moments(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """group, n, total (d sums), products (d x d sums, row by row) of regular() rows."""
    kind = rows.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, n long, total array<double>, products array<double>"

    def part(batches):
        held = {}
        for pdf in batches:
            for g, v in pdf.groupby(group, dropna=False)[vector]:
                x = np.stack(v.to_numpy())
                add = (len(x), x.sum(axis=0), x.T @ x)
                key = None if pd.isna(g) else g
                held[key] = tuple(a + b for a, b in zip(held[key], add, strict=True)) if key in held else add
            if len(held) > 256:  # groups beyond a task's memory go out as they are
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def frame(held):
        return pd.DataFrame({group: list(held), "n": [h[0] for h in held.values()], "total": [h[1] for h in held.values()], "products": [h[2].ravel() for h in held.values()]})

    parts = rows.select(group, vector).mapInPandas(part, schema)
    long = parts.select(group, F.posexplode(F.concat(F.array(F.col("n").cast("double")), "total", "products")).alias("i", "x"))
    summed = long.groupBy(group, "i").agg(F.sum("x").alias("x")).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("a"))
    d = F.round((F.sqrt(4 * F.size("a").cast("double") - 3) - 1) / 2).cast("int")  # size = 1 + d + d^2
    return summed.withColumn("_d", d).select(group, F.col("a")[0].cast("long").alias("n"), F.slice("a", 2, F.col("_d")).alias("total"), F.slice("a", F.col("_d") + 2, F.col("_d") * F.col("_d")).alias("products"))


def spectrum(rows: DataFrame, group: str, vector: str, k: int = 2) -> DataFrame:
    """group, n, mean, axes (k unit vectors end to end, by falling variance; the component of largest size is positive),
    variances (all, with n), share (of the variance, of the first k), participation ((sum)^2 / sum of squares) and ratios
    (singular values by the largest)."""
    kind = rows.schema[group].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            out = []
            for g, n, total, products in zip(pdf[group], pdf["n"], pdf["total"], pdf["products"], strict=True):
                mean, d = np.asarray(total) / n, len(total)
                values, basis = np.linalg.eigh(np.asarray(products).reshape(d, d) / n - np.outer(mean, mean))
                values, basis = np.maximum(values[::-1], 0.0), basis[:, ::-1].T[:k]
                basis = basis * np.where(basis[np.arange(len(basis)), np.abs(basis).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
                all_ = values.sum()
                out.append((g, n, mean, basis.ravel(), values, values[:k].sum() / all_ if all_ else None, all_**2 / (values**2).sum() if all_ else None, np.sqrt(values / values[0]) if all_ else None))
            yield pd.DataFrame(out, columns=[group, "n", "mean", "axes", "variances", "share", "participation", "ratios"])

    schema = f"{group} {kind}, n long, mean array<double>, axes array<double>, variances array<double>, share double, participation double, ratios array<double>"
    return moments(rows, group, vector).mapInPandas(solve, schema)


def projected(rows: DataFrame, found: DataFrame, group: str, vector: str, k: int = 2) -> DataFrame:
    """rows with pc1 to pck, their coordinates about the mean on the group's axes, null where the group has fewer axes."""
    joined = rows.join(found.select(F.col(group), F.col("mean").alias("_m"), F.col("axes").alias("_a")), group)
    d = F.size("_m")
    centred = F.zip_with(vector, "_m", lambda x, m: x - m)
    dot = lambda i: F.aggregate(F.zip_with(centred, F.slice("_a", i * d + 1, d), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
    return joined.withColumns({f"pc{i + 1}": F.when(F.size("_a") >= (i + 1) * d, dot(F.lit(i))) for i in range(k)}).drop("_m", "_a")


def neighbour_scale(radii: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """group, rows, median radius and its relation to the root mean square distance from the mean."""
    per = radii.groupBy(group).agg(F.count("*").alias("rows"), F.median("radius").alias("median_radius"))
    rms = F.sqrt(F.aggregate("variances", F.lit(0.0), lambda s, x: s + x))
    return per.join(found, group).select(group, "rows", "median_radius", F.try_divide("median_radius", rms).alias("relative"), "participation")
