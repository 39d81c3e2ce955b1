"""Joins by which lists and measurements meet rows; sides are never assumed small, Spark broadcasts those that are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(rows: DataFrame, attributes: DataFrame, on: list[str]) -> DataFrame:
    """Left join that keeps rows without a match and marks them (missed)."""
    return rows.join(attributes.withColumn("_hit", F.lit(True)), on, "left").withColumn("missed", F.col("_hit").isNull()).drop("_hit")


def without(rows: DataFrame, blacklist: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return rows.join(blacklist.select(*on).distinct(), on, "left_anti")


def only(rows: DataFrame, whitelist: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is listed."""
    return rows.join(whitelist.select(*on).distinct(), on, "left_semi")


def difference(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full outer comparison by key: change is only_left, only_right, changed or same."""
    l, r = left.select(*on, F.col(value).alias("left_value")), right.select(*on, F.col(value).alias("right_value"))
    both = l.withColumn("_l", F.lit(True)).join(r.withColumn("_r", F.lit(True)), on, "full_outer")
    change = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(~F.col("left_value").eqNullSafe(F.col("right_value")), "changed").otherwise("same")
    return both.withColumn("change", change).drop("_l", "_r")


#: Parts that the targets of a group fall into, each of which meets the whole group.
PARTS = 8


def ordered_pairs(rows: DataFrame, group: str, member: str, *names: str) -> DataFrame:
    """All ordered pairs of different members of one group, with the attributes names of either end (prefixed by target_ and
    context_). A group's targets are spread over PARTS tasks, and pairs are not exchanged."""
    end = lambda e: [F.col(member).alias(e), *[F.col(n).alias(f"{e}_{n}") for n in names]]
    targets = rows.select(group, F.pmod(F.xxhash64(member), F.lit(PARTS)).cast("int").alias("_part"), *end("target"))
    contexts = rows.select(group, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"), *end("context"))
    return targets.hint("shuffle_hash").join(contexts, [group, "_part"]).where("target <> context").drop("_part")


def exists_within(left: DataFrame, right: DataFrame, group: str, at: str, reach: float, bucket: Column | None = None) -> DataFrame:
    """left rows with found: whether right has a row of the group within reach of at.

    A range join by buckets of the reach's width: each right row is put in its bucket and both neighbours, so the join
    is an equi-join on (group, bucket) and a busy group spreads over its buckets.
    """
    cell = lambda c: F.floor(c / reach).cast("long")
    near = right.select(group, F.col(at).alias("_at"), F.explode(F.array(*[cell(F.col(at)) + d for d in (-1, 0, 1)])).alias("_cell"))
    hits = left.withColumn("_cell", cell(F.col(at))).join(near, [group, "_cell"]).where(F.abs(F.col(at) - F.col("_at")) <= reach)
    keys = left.columns
    return left.join(hits.select(*keys).distinct().withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def coalesce_intervals(rows: DataFrame, group: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Maximal runs of intervals that overlap, or lie within gap of each other: group, start, end, n."""
    order = Window.partitionBy(*group).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", (reached.isNull() | (F.col(start) > reached + gap)).cast("int"))
    island = opened.withColumn("_island", F.sum("_new").over(order))
    return island.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def by_priority(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """One row for each key, from the first source that has it, with the source's number."""
    every = None
    for i, s in enumerate(sources):
        part = s.withColumn("source_no", F.lit(i))
        every = part if every is None else every.unionByName(part)
    first = Window.partitionBy(*key).orderBy("source_no")
    return every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
