"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated to principal axes, so that leading dimensions hold most of every product.
Equal vectors of one label are one node with a multiplicity. Each label is cut into cells along the first axes, wide
enough that only a cell and its neighbours can hold pairs that reach the threshold, and cells into tiles of bounded
size. A task compares two tiles: it accumulates the leading dimensions, bounds what the rest can add by the product of
the suffix norms, and goes on only with pairs whose cosine can still reach the threshold. Pairs that are left are
decided by the cosine of the original components in double precision.

A task returns, for its vectors, how many others they link with and enough links to connect what it found connected:
at most one for each vector, however many pairs there are.

Vectors that are null, zero, or hold null or non-finite components, and those with a null label, link with nothing;
neither do vectors of different lengths. Repeated rows and ids stay rows of their own, and count as vectors of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.shared import components, table

THRESHOLD = 0.93
#: The axes are fitted on at most about so many vectors; they decide the speed, never the result.
SAMPLE = 5_000
TILE = 1_024
CELL_AXES = 2
#: Dimensions accumulated before each test.
STEPS = (16, 32)
SLACK = 1e-6


def axes(vectors: np.ndarray, dim: int) -> np.ndarray:
    """Orthonormal principal axes, by decreasing energy, as columns."""
    if not len(vectors):
        return np.eye(dim)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    values, basis = np.linalg.eigh(unit.T @ unit)
    return basis[:, np.argsort(values)[::-1]]


def linked(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine(a[i], b[j]) >= threshold. turned_*: unit vectors on the axes."""
    dim = a.shape[1]
    bounds = [*[s for s in STEPS if s < dim], dim]
    partial = turned_a[:, : bounds[0]] @ turned_b[:, : bounds[0]].T
    rest = lambda t, s: np.sqrt(np.maximum(0.0, (t[:, s:] ** 2).sum(axis=1)))
    i, j = np.nonzero(partial + np.outer(rest(turned_a, bounds[0]), rest(turned_b, bounds[0])) >= threshold - SLACK)
    have = partial[i, j]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        have = have + np.einsum("ij,ij->i", turned_a[i, lo:hi], turned_b[j, lo:hi])
        keep = have + rest(turned_a, hi)[i] * rest(turned_b, hi)[j] >= threshold - SLACK
        i, j, have = i[keep], j[keep], have[keep]
    exact = np.einsum("ij,ij->i", a[i], b[j]) / (np.sqrt((a**2).sum(axis=1))[i] * np.sqrt((b**2).sum(axis=1))[j])
    keep = exact >= threshold
    return i[keep], j[keep]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least connected index of each of n nodes."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: key, n_links, component_id, kept."""
    spark = rows.sparkSession
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), wide.alias("v")).withColumn("ok", F.coalesce(finite & F.col("label").isNotNull(), F.lit(False)))
    nodes = table(usable.where("ok").groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("times")).withColumn("dim", F.size("v")))
    counts = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    fitted = {}
    for dim, n in counts.items():
        drawn = nodes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / n)))).select("v").toPandas()
        fitted[dim] = axes(np.stack(drawn["v"]) if len(drawn) else np.empty((0, dim)), dim)
    shared = spark.sparkContext.broadcast(fitted)
    width = float(np.sqrt(2 - 2 * threshold)) * (1 + SLACK)  # unit vectors further apart along any axis fall short

    def place(batches):
        for pdf in batches:
            cells = np.zeros((len(pdf), CELL_AXES), dtype=np.int64)
            for dim, at in pdf.groupby("dim").indices.items():
                v = np.stack(pdf["v"].iloc[at])
                unit = v / np.abs(v).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                t = unit @ shared.value[dim][:, :CELL_AXES]
                cells[at, : t.shape[1]] = np.floor(t / width)
            yield pd.DataFrame({"node": pdf["node"], "label": pdf["label"], "dim": pdf["dim"], "times": pdf["times"], "v": pdf["v"], "c0": cells[:, 0], "c1": cells[:, 1]})

    kind = nodes.schema["label"].dataType.simpleString()
    idtype = nodes.schema["node"].dataType.simpleString()
    placed = nodes.mapInPandas(place, f"node {idtype}, label {kind}, dim int, times long, v array<double>, c0 long, c1 long")
    cell = ["label", "dim", "c0", "c1"]
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("n"))
    sizes = table(sizes.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")))
    tiled = table(placed.join(sizes.drop("n"), cell).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")))
    # pairs of tiles: within a cell, and with the neighbours after it
    near = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    reach = sizes.select(*cell, "tiles", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in near])).alias("d"))
    other = sizes.select("label", "dim", F.col("c0").alias("o0"), F.col("c1").alias("o1"), F.col("tiles").alias("others"))
    reach = reach.select("label", "dim", "c0", "c1", "tiles", (F.col("c0") + F.col("d.x")).alias("o0"), (F.col("c1") + F.col("d.y")).alias("o1"))
    grid = reach.join(other, ["label", "dim", "o0", "o1"]).where("(o0, o1) >= (c0, c1)")
    grid = grid.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    grid = table(grid.where("(o0, o1) > (c0, c1) OR t >= s").select(*cell, "o0", "o1", "s", "t", F.concat_ws("|", F.col("label").cast("string"), "dim", "c0", "c1", "o0", "o1", "s", "t").alias("pair")))
    left = tiled.join(grid.withColumnRenamed("s", "tile"), [*cell, "tile"]).select("pair", F.lit(True).alias("first"), "node", "times", "v", "dim")
    twin = F.expr("c0 = o0 AND c1 = o1 AND s = t")
    right = tiled.withColumnsRenamed({"c0": "o0", "c1": "o1", "tile": "t"}).join(grid.where(~twin).drop("c0", "c1"), ["label", "dim", "o0", "o1", "t"]).select("pair", F.lit(False).alias("first"), "node", "times", "v", "dim")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy())
        scaled = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])  # by powers of two, which rounds nothing
        unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        turned = unit @ shared.value[int(pdf["dim"].iloc[0])]
        a = np.flatnonzero(pdf["first"].to_numpy())
        b = np.flatnonzero(~pdf["first"].to_numpy())
        same = not len(b)
        b = a if same else b
        found = [(s + i, j) for s in range(0, len(a), 256) for i, j in [linked(scaled[a[s : s + 256]], scaled[b], turned[a[s : s + 256]], turned[b], threshold)]]
        i, j = a[np.concatenate([f[0] for f in found])], b[np.concatenate([f[1] for f in found])]
        if same:
            i, j = i[i != j], j[i != j]
        times, node = pdf["times"].to_numpy(), pdf["node"].to_numpy()
        links = np.bincount(i, weights=times[j], minlength=len(v)) + (0 if same else np.bincount(j, weights=times[i], minlength=len(v)))
        root = _roots(len(v), i, j)
        hit = np.flatnonzero(links > 0)
        return pd.DataFrame({"node": node[hit], "links": links[hit].astype(np.int64), "to": node[root[hit]]})

    found = table(left.union(right).groupBy("pair").applyInPandas(compare, f"node {idtype}, links long, to {idtype}"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    done = table(nodes.join(links, "node", "left").join(classes, "node", "left").select("label", "v", "node", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    out = usable.join(done, (usable["label"] == done["label"]) & (usable["v"] == done["v"]) & usable["ok"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
