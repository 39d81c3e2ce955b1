"""Audits and sweeps: dangling keys, disjoint splits, homogeneous settings, cuts at percentiles, batches by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dangling(edges: DataFrame, nodes: DataFrame, ends: list[str], node: str) -> DataFrame:
    """Ends of edges that no node has: end, key and how often."""
    known = nodes.select(F.col(node).alias("key")).distinct()
    listed = edges.select(F.inline(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("key")) for e in ends])))
    return listed.join(known, "key", "left_anti").groupBy("end", "key").agg(F.count("*").alias("n"))


def overlap(splits: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that are in more than one split; empty when the splits are disjoint."""
    return splits.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def homogeneous(rows: DataFrame, group: str, settings: list[str]) -> DataFrame:
    """How many different combinations of settings each group has, nulls being a value."""
    every = F.concat_ws("␟", *[F.coalesce(F.col(s).cast("string"), F.lit("␀")) for s in settings])
    return rows.groupBy(group).agg(F.count_distinct(every).alias("combinations"))


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail; a check that is null fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def percentile_cuts(rows: DataFrame, value: str, bad: str, cuts: list[float]) -> DataFrame:
    """For each percentile: its value, the share of rows at or below, and the share of bad ones among these."""
    edge = rows.agg(F.percentile(value, F.array(*[F.lit(c) for c in cuts])).alias("e"))
    met = rows.select(value, bad).join(F.broadcast(edge))  # one row beside every row: no row is repeated for a cut
    kept = [F.col(value) <= F.col("e")[i] for i in range(len(cuts))]
    figures = [F.struct(F.lit(c).alias("percent"), F.first("e")[i].alias("cut"), F.avg(k.cast("int")).alias("kept"), F.avg(F.when(k, F.col(bad).cast("int"))).alias("bad")) for i, (c, k) in enumerate(zip(cuts, kept, strict=True))]
    return met.agg(F.array(*figures).alias("_f")).select(F.inline("_f"))


def weighted_batches(rows: DataFrame, corpus: str, key: Column, weights: dict[str, float], size: int, seed: int = 0) -> DataFrame:
    """Batches of one corpus each: a corpus of n rows and weight w gives int(n * w / size) of them; its rows are repeated
    and, for each repeat, put in a new order by hash. batch numbers start from 0 in each corpus."""
    weight = F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col(corpus))
    counted = rows.join(rows.groupBy(corpus).agg(F.count("*").alias("_n")), corpus).withColumn("_w", F.coalesce(weight, F.lit(1.0)))
    repeated = counted.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil("_w").cast("int")))))
    place = F.row_number().over(Window.partitionBy(corpus).orderBy("repeat", F.xxhash64(key, "repeat", F.lit(seed)), key)) - 1
    batched = repeated.withColumn("batch", F.floor(place / size).cast("long"))
    return batched.where(F.col("batch") < F.floor(F.col("_n") * F.col("_w") / size)).drop("_n", "_w")


def linspace(start: Column, stop: Column, count: int) -> Column:
    """count whole numbers from start to stop at even steps, halves to even."""
    if count == 1:
        return F.array(start.cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(start + i * (stop - start) / (count - 1)).cast("long"))


def azimuth_span(rows: DataFrame, group: str, degrees: str) -> DataFrame:
    """360 less the largest gap between neighbouring directions around the circle; 0 for a single one."""
    w = Window.partitionBy(group).orderBy("_d")
    turned = rows.where(F.col(degrees).isNotNull()).select(group, F.pmod(F.col(degrees), F.lit(360.0)).alias("_d")).distinct()
    gaps = turned.withColumn("_gap", F.lead("_d").over(w) - F.col("_d"))
    ends = gaps.groupBy(group).agg(F.max("_gap").alias("_inner"), (F.min("_d") + 360 - F.max("_d")).alias("_around"))
    return ends.select(group, (360 - F.greatest(F.coalesce("_inner", F.lit(0.0)), "_around")).alias("span"))


def unwrapped(rows: DataFrame, entry: str, order: list[str], angle: str, period: float) -> DataFrame:
    """rows with unwrapped: the angle without its jumps by whole periods."""
    w = Window.partitionBy(entry).orderBy(*order)
    jump = F.coalesce(F.round((F.col(angle) - F.lag(angle).over(w)) / period), F.lit(0.0))
    return rows.withColumn("_jump", jump).withColumn("unwrapped", F.col(angle) - period * F.sum("_jump").over(w)).drop("_jump")


def polynomial_rest(rows: DataFrame, entry: str, order: list[str], value: str) -> DataFrame:
    """rows with rest: the value less a local quadratic fit over five frames; the two frames at each end have none."""
    w = Window.partitionBy(entry).orderBy(*order)
    fit = (-3 * F.lag(value, 2).over(w) + 12 * F.lag(value).over(w) + 17 * F.col(value) + 12 * F.lead(value).over(w) - 3 * F.lead(value, 2).over(w)) / 35
    return rows.withColumn("rest", F.col(value) - fit)


def borrowed(rows: DataFrame, group: str, value: str, donor: Column) -> DataFrame:
    """rows with filled: missing values take the median of the group's donors."""
    medians = rows.where(donor).groupBy(group).agg(F.median(value).alias("_m"))
    return rows.join(medians, group, "left").withColumn("filled", F.coalesce(value, "_m")).drop("_m")
