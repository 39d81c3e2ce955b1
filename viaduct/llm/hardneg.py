"""Hard negatives by a Voronoi-partitioned distributed kNN join.

Integer vectors are searched by inner product: with M the greatest norm, a candidate x augmented by sqrt(M^2 - |x|^2)
and an anchor a augmented by 0 lie at the squared distance |a|^2 + M^2 - 2 a.x, so the greatest products are the nearest
neighbours. Every row goes to the cell of its nearest pivot and remembers its distance to it; anchors of a cell form
groups of bounded size. For a group and a cell the triangle inequality leaves an interval of distances to the pivot,
outside which no candidate of the cell can serve any anchor of the group; candidates are replicated only to groups whose
interval holds them, in blocks of bounded size, and each (group, block) is one exact local join.

Three joins use this: an anchor's own cell gives a bound for its last positive; the other cells, within that bound, the
positives; their scores then say in which shell negatives lie (no nearer than the best positive, no further than the
tolerated share of the worst one), and the shells give the negatives. Bounds decide what is compared, never the result.

Defined cases: rows whose id, label or vector is null, or with a null or non-finite component, take no part; ties go to
the smaller id; of repeated ids each row is an anchor and a candidate of its own, and an anchor's other rows are all
but that row. Vectors of other lengths than the anchor's aren't compared. Scores are exact; one that doesn't fit 64
bits is returned as the nearest value that does. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.llm.shared import release, table

SCALE = 256.0
#: Pivots are drawn from at most about so many rows; they decide the speed, never the result.
SAMPLE = 4_096
PIVOTS = 1_024
ANCHORS_PER_PIVOT = 32
#: Most anchors in a group, and candidates in a block.
GROUP = 512
BLOCK = 8_192
SLACK = 1e-9
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _numbers(packed: pd.Series, wide: pd.Series) -> np.ndarray:
    """Vectors of one length: 16-bit integers, or doubles where they need more."""
    if not len(packed) or not len(packed.iloc[0]):
        return np.empty((len(packed), 0))
    if not wide.any():
        return np.frombuffer(b"".join(packed), dtype="<i2").reshape(len(packed), -1).astype(float)
    return np.stack([np.frombuffer(p, dtype="<f8" if w else "<i2").astype(float) for p, w in zip(packed, wide, strict=True)])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where all sums stay below 2^53, else in Python integers."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if top < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return whole(a) @ whole(b).T


def _long(score) -> int:
    return max(_LEAST, min(_MOST, int(score)))


def _first(order_score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k first by score descending, then id."""
    if len(ids) > 4 * k and order_score.dtype != object:  # what lies below the k-th score can't be among them
        cut = np.partition(order_score, len(ids) - k)[len(ids) - k]
        near = np.flatnonzero(order_score >= cut)
        return near[np.lexsort((ids[near], -order_score[near]))[:k]]
    return np.array(sorted(range(len(ids)), key=lambda i: (-order_score[i], ids[i]))[:k], dtype=int)


def indexed(rows: DataFrame, key: str, vector: str, label: str, anchors: Column) -> tuple[DataFrame, np.ndarray, float]:
    """Written rows (row, id, label, dim, q, wide, anchor, cell, r: distance to the cell's pivot), the pivots as a
    dictionary by length, and the greatest norms by length."""
    spark = rows.sparkSession
    whole = F.transform(F.col(vector), lambda x: F.lit(SCALE) * x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    usable = usable.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(finite).withColumn("row", F.monotonically_increasing_id())

    def pack(batches):
        for pdf in batches:
            qs = [np.floor(np.asarray(v, dtype=float)) for v in pdf["v"]]
            wide = [bool(len(q) and np.abs(q).max() > 32767) for q in qs]
            norm = [math.sqrt(float(q @ q)) if not w or np.abs(q).max() < 1e150 else float("inf") for q, w in zip(qs, wide, strict=True)]
            yield pdf.drop(columns="v").assign(dim=[len(q) for q in qs], q=[q.astype("<f8" if w else "<i2").tobytes() for q, w in zip(qs, wide, strict=True)], wide=wide, norm=norm)

    packed = table(usable.mapInPandas(pack, "id long, label long, anchor boolean, row long, dim int, q binary, wide boolean, norm double"))
    counts = packed.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.max("norm").alias("m")).orderBy(F.desc("anchors")).limit(64).collect()
    pivots, reach = {}, {}
    for c in counts:
        if not c["anchors"] or not c["dim"] or not math.isfinite(c["m"]):
            continue  # one cell, in which all are compared
        wanted = max(8, min(PIVOTS, c["anchors"] // ANCHORS_PER_PIVOT))
        share = min(1.0, SAMPLE / c["n"])
        drawn = packed.where((F.col("dim") == c["dim"]) & (F.pmod(F.xxhash64("id", "q"), F.lit(1 << 20)) < int((1 << 20) * share) + 1)).select("id", "q", "wide", F.xxhash64("q", "id").alias("h")).toPandas()
        drawn = drawn.sort_values(["h", "id"]).drop_duplicates("q")
        v = _augmented(_numbers(drawn["q"], drawn["wide"]), c["m"]) if len(drawn) else np.empty((0, c["dim"] + 1))
        pivots[c["dim"]], reach[c["dim"]] = _spread(v, wanted), c["m"]
    shared = spark.sparkContext.broadcast((pivots, reach))

    def place(batches):
        pivots, reach = shared.value
        for pdf in batches:
            cell, r = np.zeros(len(pdf), dtype=np.int32), np.zeros(len(pdf))
            for dim, at in pdf.groupby("dim").indices.items():
                if len(pivots.get(dim, ())):
                    part = pdf.iloc[at]
                    d = _distances(_augmented(_numbers(part["q"], part["wide"]), reach[dim]), pivots[dim])
                    cell[at], r[at] = d.argmin(axis=1), d.min(axis=1)
            yield pdf.drop(columns="norm").assign(cell=cell, r=r)

    placed = table(packed.mapInPandas(place, "id long, label long, anchor boolean, row long, dim int, q binary, wide boolean, cell int, r double"))
    release(packed)
    return placed, pivots, reach


def _augmented(v: np.ndarray, m: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(0.0, m * m - (v * v).sum(axis=1)))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


def _spread(v: np.ndarray, wanted: int) -> np.ndarray:
    """Pivots: the first row, then each time the row farthest from all pivots so far, among four times as many as wanted."""
    v = v[: 4 * wanted]
    if len(v) <= wanted:
        return v
    chosen, near = [0], _distances(v, v[:1])[:, 0]
    while len(chosen) < wanted:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(v, v[chosen[-1:]])[:, 0])
    return v[chosen]


def hard_negatives(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row in anchors and each of its
    first positives of the same label, the first negatives of other labels whose score is at most the positive's and at
    least low percent of it. A score is the inner product of floor(256 * component)."""
    spark = rows.sparkSession
    placed, pivots, reach = indexed(rows, key, vector, label, anchors)
    shared = spark.sparkContext.broadcast((pivots, reach))
    # groups of at most about GROUP anchors of a cell, and blocks of about BLOCK candidates, both cut by r
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"))
    sizes = table(sizes.select("dim", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.greatest(F.ceil(F.col("anchors") / GROUP), F.lit(1)).cast("int").alias("groups")))
    dealt = placed.join(F.broadcast(sizes) if sizes.count() <= 64 * PIVOTS else sizes, ["dim", "cell"])
    dealt = table(dealt.withColumns({"block": F.pmod(F.xxhash64("row", "id"), "blocks").cast("int"), "group": F.concat_ws("|", "dim", "cell", F.pmod(F.xxhash64("id", "row", F.lit(1)), "groups"))}).drop("blocks", "groups"))
    asking = table(dealt.where("anchor").select("group", "dim", "cell", "row", "id", "label", "q", "wide"))
    cells = table(dealt.groupBy("dim", "cell", "block").agg(F.min("r").alias("least"), F.max("r").alias("most")))

    def serve(asked: DataFrame, plan: DataFrame, join, schema: str) -> DataFrame:
        """join(anchors, candidates) of every (group, block) that the plan names: (group, dim, cell, block, lo, hi)."""
        unit = F.concat_ws("|", "group", "cell", "block").alias("unit")
        wanted = plan.join(cells, ["dim", "cell", "block"]).where("lo <= most AND least <= hi").drop("least", "most")
        wanted = table(wanted)
        sent = dealt.drop("group", "anchor").join(wanted, ["dim", "cell", "block"]).where("r >= lo AND r <= hi").select(unit, "row", "id", "label", "q", "wide")
        to = asked.join(wanted.select("group", F.col("cell").alias("there"), "block"), "group").drop("cell").withColumnRenamed("there", "cell").select(unit, *[c for c in asked.columns if c not in ("group", "dim", "cell")])
        return table(to.groupBy("unit").cogroup(sent.groupBy("unit")).applyInPandas(join, schema))

    def plan_of(asked: DataFrame, own: bool, shell: bool) -> DataFrame:
        """Intervals of r by group and cell. asked has far, the distance within which an anchor looks, and near, below
        which it doesn't. Every group is one bounded set of rows."""

        def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
            pivots, reach = shared.value
            dim, home = int(pdf["dim"].iloc[0]), int(pdf["cell"].iloc[0])
            if not len(pivots.get(dim, ())):
                return pd.DataFrame([(pdf["group"].iloc[0], dim, 0, -np.inf, np.inf)] if shell or own else [], columns=["group", "dim", "cell", "lo", "hi"])
            v = _numbers(pdf["q"], pdf["wide"])
            d = _distances(np.column_stack([v, np.zeros(len(v))]), pivots[dim])
            far, near = pdf["far"].to_numpy()[:, None], pdf["near"].to_numpy()[:, None]
            slack = SLACK * (reach[dim] + np.abs(d))
            lo = np.maximum(d - far, near - d) - slack
            hi = d + far + slack
            lo, hi = np.where(far < 0, np.inf, lo).min(axis=0), np.where(far < 0, -np.inf, hi).max(axis=0)
            cell = np.arange(len(pivots[dim]))
            use = np.isfinite(lo) | np.isfinite(hi) | (lo < hi)
            if not shell:
                use &= cell != home
            return pd.DataFrame({"group": pdf["group"].iloc[0], "dim": dim, "cell": cell, "lo": lo, "hi": hi})[use]

        schema = "group string, dim int, cell int, lo double, hi double"
        if own:
            found = asked.select("group", "dim", "cell", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")).distinct()
        else:
            found = asked.select("group", "dim", "cell", "q", "wide", "far", "near").groupBy("group").applyInPandas(bounds, schema)
        return found.join(cells.select("dim", "cell", "block"), ["dim", "cell"])

    def same(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            for label, at in a.groupby("label").indices.items():
                part = b[b["label"] == label]
                if len(part):
                    score, ids, row = _products(_numbers(a["q"].iloc[at], a["wide"].iloc[at]), _numbers(part["q"], part["wide"])), part["id"].to_numpy(), part["row"].to_numpy()
                    for i, s in zip(at, score, strict=True):
                        other = np.flatnonzero(row != a["row"].iloc[i])
                        out += [(a["row"].iloc[i], row[other[j]], ids[other[j]], str(s[other[j]])) for j in _first(s[other], ids[other], positives)]
        return pd.DataFrame(out, columns=["anchor", "row", "id", "score"])

    def other(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            score, ids, row, labels = _products(_numbers(a["q"], a["wide"]), _numbers(b["q"], b["wide"])), b["id"].to_numpy(), b["row"].to_numpy(), b["label"].to_numpy()
            for i, s in enumerate(score):
                differs = labels != a["label"].iloc[i]
                for p in sorted({int(x) for x in a["scores"].iloc[i]}):
                    # 100 s >= low p without the product, which may not fit: s >= ceil(low p / 100)
                    hit = np.flatnonzero(differs & (s <= p) & (s >= -(-low * p // 100)))
                    out += [(a["row"].iloc[i], str(p), row[hit[j]], ids[hit[j]], str(s[hit[j]])) for j in _first(s[hit], ids[hit], negatives)]
        return pd.DataFrame(out, columns=["anchor", "positive", "row", "id", "score"])

    exact = "decimal(38,0)"
    first = lambda found, by, k: found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").cast(exact).desc(), "id", "row"))).where(F.col("rank") <= k)
    radius = lambda s: F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") + F.col("m2") - 2 * s.cast("double")))

    # the anchor's own cell, then what other cells hold within the bound that it gives
    pairs = "anchor long, row long, id long, score string"
    near = first(serve(asking, plan_of(asking, True, False), same, pairs), ["anchor"], positives).drop("rank")
    last = near.groupBy(F.col("anchor").alias("row")).agg(F.min(F.col("score").cast(exact)).alias("last"), F.count("*").alias("n"))
    lengths = spark.createDataFrame([(int(d), float(m) ** 2) for d, m in reach.items()], "dim int, m2 double")

    def square(packed: pd.Series, wide: pd.Series) -> pd.Series:
        return pd.Series([float((np.frombuffer(p, dtype="<f8" if w else "<i2").astype(float) ** 2).sum()) for p, w in zip(packed, wide, strict=True)])

    norms = asking.withColumn("norm2", F.pandas_udf(square, "double")("q", "wide")).join(F.broadcast(lengths), "dim", "left")
    far = F.when(F.col("n") >= positives, radius(F.col("last"))).otherwise(F.lit(float("inf")))
    bounded = table(norms.join(last, "row", "left").withColumns({"far": F.coalesce(far, F.lit(float("inf"))), "near": F.lit(0.0)}).drop("last", "n"))
    wide_found = serve(bounded.drop("far", "near", "norm2", "m2"), plan_of(bounded, False, False), same, pairs)
    best = table(first(near.union(wide_found), ["anchor"], positives))

    # negatives lie in the shell that the positives' scores leave
    scores = best.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("score").alias("scores"), F.min(F.col("score").cast(exact)).alias("least"), F.max(F.col("score").cast(exact)).alias("most"))
    lowest = F.col("least").cast("double") * (low / 100.0)
    shells = norms.join(scores, "row").withColumns({"far": F.when(F.col("most") < 0, -1.0).otherwise(F.coalesce(radius(F.when(F.col("least") < 0, 0.0).otherwise(lowest)), F.lit(float("inf")))), "near": F.coalesce(radius(F.col("most")), F.lit(0.0))})
    shells = table(shells.drop("least", "most"))
    found = serve(shells.drop("far", "near", "norm2", "m2"), plan_of(shells, False, True), other, "anchor long, positive string, row long, id long, score string")
    ranked = first(found, ["anchor", "positive"], negatives)
    fits = lambda s: F.greatest(F.least(F.col(s).cast(exact), F.lit(_MOST).cast(exact)), F.lit(_LEAST).cast(exact)).cast("long")
    out = best.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive")).join(ranked.select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative")), ["anchor", "positive"])
    out = out.join(asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", fits("positive").alias("positive_score"), fits("negative").alias("negative_score"))
