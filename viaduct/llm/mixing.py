"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The mix has slots 0, 1, 2, ...; the golden-ratio point frac((i + 1) * phi) of slot i falls into one source's stretch of
the cumulative target shares, so at every length of the schedule each source's slots are within a few of its share.
The slots of a source are ranked, its documents are shuffled by hash and laid end to end, EPOCHS times over, and cut
into blocks of equal token counts; slot rank j takes block j. A source whose slots are fewer than the blocks that its
target reaches into gets the missing ranks, surplus ranks are cut, and so is its last block at the rounded target: each
source's taken tokens are its rounded target. A document's `taken` is the tokens of it in taken blocks.

Offsets and ranks come from two-level prefix sums (hash buckets, slot ranges), so a source with a third of all rows is
spread over as many tasks as any other. What is one row per source (names, sizes, targets) is worked on the driver:
it is bounded by SOURCES_AT_MOST, beyond which the operator refuses.

Null texts have no word and take nothing; a null source is a source of its own, the last one. Repeated or null ids are
documents of their own, equal rows too; an empty table gives no rows. Columns other than the four are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SLOTS_AT_LEAST = 1 << 16
BLOCK_AT_MOST = 4096
SLOTS_PER_RANGE = 1 << 14
ROWS_PER_BUCKET = 20_000
SOURCES_AT_MOST = 1_000_000
GOLDEN = (math.sqrt(5) - 1) / 2


def sizes(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(source_sizes: list[int], weights: list[float], share: float = SHARE, epochs: int = EPOCHS) -> list[float]:
    """Shares of share * all sizes by weight; none above epochs * its size, the excess reshared by weight."""
    total, caps = share * sum(source_sizes), [float(epochs * s) for s in source_sizes]
    order = sorted(range(len(caps)), key=lambda i: caps[i] / weights[i])
    out, left, weight = [0.0] * len(caps), total, float(sum(weights))
    for i in order:
        out[i] = min(caps[i], left * weights[i] / weight)
        left, weight = left - out[i], weight - weights[i]
    return out


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, shuffle: str | None = None) -> DataFrame:
    """One row per document: key, size, source_size, target (its source's) and taken. The hash that shuffles is of the
    key, or of the column shuffle where keys differ from run to run."""
    spark = docs.sparkSession
    rows = docs.select(key, F.col(shuffle or key).alias("_shuffle"), F.col(source).alias("_source"), sizes(F.col(text)).alias("size"))
    per_source = rows.groupBy("_source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(SOURCES_AT_MOST + 1).collect()
    if len(per_source) > SOURCES_AT_MOST:
        raise ValueError(f"more than {SOURCES_AT_MOST} sources")
    per_source.sort(key=lambda r: (r[0] is None, [ord(c) for c in r[0] or ""]))
    goal = targets([r[1] for r in per_source], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(per_source))])
    total, n_rows = sum(goal), sum(r[2] for r in per_source)
    block = int(min(BLOCK_AT_MOST, max(1, total // SLOTS_AT_LEAST)))
    slots = math.ceil(total / block)
    bounds, at = [], 0.0
    for i, (r, g) in enumerate(zip(per_source, goal, strict=True)):
        goal_words = math.floor(g + 0.5)
        bounds.append((i, r[0], r[1], g, at / total if total else 0.0, (at + g) / total if total else 0.0, goal_words, -(-goal_words // block)))
        at += g
    if bounds:
        bounds[-1] = (*bounds[-1][:5], 2.0, *bounds[-1][6:])
    plan = spark.createDataFrame(bounds, "s int, name string, source_size long, target double, low double, high double, goal long, blocks long")

    # slots: point -> source -> rank within the source
    cells = 4096
    point = (F.col("id") + 1) * F.lit(GOLDEN)
    schedule = spark.range(slots).select("id", (point - F.floor(point)).alias("x")).withColumn("cell", F.floor(F.col("x") * cells).cast("int"))
    stretches = plan.where("high > low").select("s", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells).cast("int"), F.floor(F.least("high", F.lit(0.9999999999)) * cells).cast("int"))).alias("cell"))
    placed = schedule.join(stretches, "cell").where("x >= low AND x < high").select("s", "id", F.floor(F.col("id") / SLOTS_PER_RANGE).alias("part"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("s", "part").count().withColumn("earlier", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("until", F.col("earlier") + F.col("count")).drop("count")
    ranked = placed.join(parts.drop("until"), ["s", "part"]).select("s", (F.col("earlier") + F.row_number().over(Window.partitionBy("s", "part").orderBy("id")) - 1).alias("block"))
    # as many blocks as the target reaches into: surplus ranks go, missing ones (few at any length of the schedule) come
    had = plan.join(parts.groupBy("s").agg(F.max("until").alias("had")), "s", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    missing = had.where("had < blocks").select("s", F.explode(F.sequence("had", F.col("blocks") - 1)).alias("block"), "goal")
    ranked = ranked.join(plan.select("s", "goal", "blocks"), "s").where("block < blocks").select("s", "block", "goal").union(missing)

    # documents: shuffled by hash, laid end to end within their source
    buckets = max(1, n_rows // ROWS_PER_BUCKET * 4)
    shuffled = F.xxhash64(F.coalesce(F.col("_shuffle").cast("string"), F.lit("")), F.lit(seed))
    dealt = rows.join(plan.select("s", "name", "source_size", "target"), F.col("_source").eqNullSafe(F.col("name")))
    dealt = dealt.select(key, "size", "source_size", "target", "s", shuffled.alias("h")).withColumn("bucket", F.floor((F.shiftrightunsigned("h", 32).cast("double")) / float(1 << 32) * buckets))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("s", "bucket").agg(F.sum("size").alias("here")).withColumn("base", F.coalesce(F.sum("here").over(before), F.lit(0))).drop("here")
    earlier = Window.partitionBy("s", "bucket").orderBy("h", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("s", "bucket").orderBy("h", key, "size")
    laid = dealt.join(sums, ["s", "bucket"]).withColumns({"start": F.col("base") + F.coalesce(F.sum("size").over(earlier), F.lit(0)), "place": F.row_number().over(order)})

    # each pass over a source's documents continues its stream; a document's pieces meet their blocks
    passes = laid.where("size > 0").select("s", "bucket", "place", "size", F.explode(F.array(*[F.col("start") + F.col("source_size") * e for e in range(EPOCHS)])).alias("a"))
    pieces = passes.select("s", "bucket", "place", "a", (F.col("a") + F.col("size")).alias("z"), F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("a") + F.col("size") - 1) / block))).alias("block"))
    overlap = F.greatest(F.least("z", (F.col("block") + 1) * block, "goal") - F.greatest("a", F.col("block") * block), F.lit(0))
    taken = pieces.join(ranked, ["s", "block"]).groupBy("s", "bucket", "place").agg(F.sum(overlap).cast("long").alias("taken"))
    return laid.join(taken, ["s", "bucket", "place"], "left").select(key, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
