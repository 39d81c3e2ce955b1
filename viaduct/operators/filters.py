"""Filters of scenes, segments, instances and variants: each keeps or drops rows, or names why, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def teleports(rows: DataFrame, entry: str, order: list[str], axes: list[str], most_component: float, most_step: float, most_position: float) -> DataFrame:
    """entry and teleport: whether any step has a component beyond most_component or a norm beyond most_step, or any
    position is not finite or farther than most_position from the origin."""
    w = Window.partitionBy(entry).orderBy(*order)
    steps = [F.col(a) - F.lag(a).over(w) for a in axes]
    bad_value = [F.isnan(a) | F.col(a).isNull() | (F.abs(a) == float("inf")) for a in axes]
    large = F.greatest(*[F.abs(s) for s in steps]) > most_component if len(steps) > 1 else F.abs(steps[0]) > most_component
    norm = lambda xs: F.sqrt(sum((x * x for x in xs), F.lit(0.0)))
    any_bad = bad_value[0]
    for b in bad_value[1:]:
        any_bad = any_bad | b
    hit = any_bad | F.coalesce(large, F.lit(False)) | F.coalesce(norm(steps) > most_step, F.lit(False)) | (norm([F.col(a) for a in axes]) > most_position)
    return rows.withColumn("_hit", hit).groupBy(entry).agg(F.max("_hit").alias("teleport"))


def overridden(rows: DataFrame, force_keep: DataFrame, key: str, reasons: str) -> DataFrame:
    """Rows on the list lose their reasons, which stay in auto_reasons; keep is no reason left."""
    listed = force_keep.select(key).distinct().withColumn("_hit", F.lit(True))
    out = rows.withColumn("auto_reasons", F.col(reasons)).join(listed, key, "left")
    out = out.withColumn(reasons, F.when(F.col("_hit"), F.slice(F.col(reasons), 1, 0)).otherwise(F.col(reasons))).drop("_hit")
    return out.withColumn("keep", F.size(reasons) == 0)


def first_drop(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that drops the row, in the given order, or 'kept'; a null check does not drop."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in checks], F.lit("kept"))


def has_token(tokens: Column, wanted: list[str]) -> Column:
    """Whether a text of tokens joined by | holds one of them."""
    return F.arrays_overlap(F.split(F.coalesce(tokens, F.lit("")), r"\|"), F.array(*[F.lit(w) for w in wanted]))


def tagged(rules: dict[str, Column], joiner: str = "|") -> Column:
    """Names of all rules that hold, joined; an empty text when none does."""
    return F.array_join(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])), joiner)


def over_budget(static: Column, dynamic: Column, most_static: float, most_dynamic: float) -> Column:
    """Each share has its own budget, and either may be exceeded; a missing share is within it."""
    over = lambda c, most: F.coalesce(c > most, F.lit(False))
    return over(static, most_static) | over(dynamic, most_dynamic)


def gates(cheap_first: list[tuple[str, Column]]) -> Column:
    """The first gate that fails, cheapest first; a later one is evaluated only where the earlier ones pass."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(cheap_first):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def steady_mean(value: str) -> Column:
    """The mean of a group, the same in any order of its rows: values are added as decimals, so a mean on a limit is on it
    and not next to it, as sums of doubles may have it. Groups with values of 10^9 or more, or NaN, are added as doubles."""
    fine = F.abs(F.col(value)) < 1e9
    return F.when(F.max(F.abs(F.col(value))) < 1e9, F.avg(F.when(fine, F.col(value)).cast("decimal(38,18)")).cast("double")).otherwise(F.avg(value))


def graded(values: DataFrame, limits: DataFrame, metric: str, value: str) -> DataFrame:
    """values with grade by a table (metric, warn, fail) of upper limits: PASS, WARN above warn, FAIL above fail; NONE
    without a value or a limit. The table has a row a metric, so Spark broadcasts it when it is small."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    grade = F.when(v.isNull() | F.col("fail").isNull(), "NONE").when(v > F.col("fail"), "FAIL").when(v > F.col("warn"), "WARN").otherwise("PASS")
    return values.join(limits, metric, "left").withColumn("grade", grade).drop("warn", "fail")


def framing_scope(aim: Column, preset: Column, scope: str) -> Column:
    """all, aimed (looks at its subject), or aimed_nontrack (and its preset follows no track)."""
    aimed = F.coalesce(aim == "look_at", F.lit(False))
    return {"all": F.lit(True), "aimed": aimed, "aimed_nontrack": aimed & ~F.coalesce(preset.rlike("^(track_|dd_)"), F.lit(False))}[scope]


def preset_filter(preset: Column, include: list[str] | None = None, exclude: list[str] = (), prefixes: list[str] = ()) -> Column:
    """Listed presets only (all when there is no list), less excluded names and prefixes."""
    keep = preset.isin(*include) if include is not None else F.lit(True)
    if exclude:
        keep = keep & ~preset.isin(*exclude)
    for p in prefixes:
        keep = keep & ~preset.startswith(p)
    return keep


def usable_segment(start: Column, end: Column, n: Column, frames: int, front: int) -> Column:
    """[start, end) lies in the n frames, is long enough, and leaves frames in front."""
    return (end <= n) & (end - start >= frames) & (start >= front)


def leaks(segments: DataFrame, context: DataFrame, key: str, at: str) -> DataFrame:
    """Per segment (key, s, e): context indexes inside [s, e), before and after it; inside must be 0."""
    met = segments.join(context.select(key, at), key, "left")
    inside = (F.col(at) >= F.col("s")) & (F.col(at) < F.col("e"))
    return met.groupBy(key, "s", "e").agg(F.count_if(inside).alias("inside"), F.count_if(F.col(at) < F.col("s")).alias("before"), F.count_if(F.col(at) >= F.col("e")).alias("after"))


def label_tokens(label: Column) -> Column:
    """Words of a label: its number suffix goes, and it splits at signs and before capitals (WallInner.022 is wall, inner)."""
    bare = F.regexp_replace(label, r"\.[0-9]+$", "")
    spaced = F.regexp_replace(bare, r"([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z]+"), lambda x: x != "")


def is_surface(label: Column, surfaces: list[str]) -> Column:
    return F.arrays_overlap(label_tokens(label), F.array(*[F.lit(s) for s in surfaces]))


def selected_nouns(rows: DataFrame, group: str, noun: str, place: str, dynamic: Column, surfaces: list[str], most: int) -> DataFrame:
    """Each candidate noun with why it goes: duplicate (of an earlier one), dynamic, surface, over_cap, or null when it
    stays; the cap counts those that pass the other checks, in their order."""
    name = F.lower(F.trim(noun))
    again = F.row_number().over(Window.partitionBy(group, "_name").orderBy(place)) > 1
    first = rows.withColumn("_name", name).withColumn("_again", again)
    early = F.when(F.col("_again"), "duplicate").when(dynamic, "dynamic").when(is_surface(F.col(noun), surfaces), "surface")
    judged = first.withColumn("_early", early)
    rank = F.sum(F.col("_early").isNull().cast("int")).over(Window.partitionBy(group).orderBy(place))
    return judged.withColumn("reason", F.coalesce("_early", F.when(rank > most, "over_cap"))).drop("_name", "_again", "_early")


def is_flat(extents: list[Column], ratio: float, least: float) -> Column:
    """A box whose smallest extent is below ratio of its largest, where that is at least least."""
    low, high = F.least(*extents), F.greatest(*extents)
    return (high >= least) & (F.try_divide(low, high) < ratio)


def continuous(rows: DataFrame, entry: str, order: list[str], visible: str, area: str, most_gap: int, most_edge: int, most_occluded: float) -> DataFrame:
    """entry, longest inner gap, hidden frames at either end, share of frames whose area is below half the median, ok."""
    w = Window.partitionBy(entry).orderBy(*order)
    seen = rows.withColumn("_t", F.row_number().over(w) - 1)
    shown = seen.where(visible).withColumn("_gap", F.col("_t") - F.lag("_t").over(w) - 1)
    median = shown.groupBy(entry).agg(F.median(area).alias("_m"))
    agg = shown.join(median, entry).groupBy(entry).agg(F.coalesce(F.max("_gap"), F.lit(0)).cast("long").alias("gap"), F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.avg((F.col(area) < F.col("_m") / 2).cast("int")).alias("occluded"))
    sizes = seen.groupBy(entry).agg(F.count("*").alias("_n"))
    edge = F.greatest(F.col("_a"), F.col("_n") - 1 - F.col("_b")).cast("long")
    ok = (F.col("gap") <= most_gap) & (F.col("edge") <= most_edge) & (F.col("occluded") <= most_occluded)
    out = sizes.join(agg, entry, "left").withColumn("edge", F.coalesce(edge, F.col("_n")))
    return out.select(entry, "gap", "edge", "occluded", F.coalesce(ok, F.lit(False)).alias("ok"))


def moving_only(rows: DataFrame, entry: str, reach: str, share: float) -> DataFrame:
    """Rows of entries whose reach is at least share of the median reach of all entries."""
    per = rows.select(entry, reach).distinct()
    middle = per.agg(F.median(reach).alias("_m"))
    return rows.join(F.broadcast(middle), F.col(reach) >= share * F.col("_m")).drop("_m")  # the other side is one row


def follows_something(preset: Column, moving: Column) -> Column:
    """Not a track preset whose subject stands still; an unknown subject counts as moving."""
    return ~(preset.startswith("track") & ~F.coalesce(moving, F.lit(True)))


def hit_ratio(x: Column, y: Column, box: float) -> Column:
    """Share of centres within a centred box of the unit square; a missing centre is a miss. An aggregate."""
    half = box / 2
    near = lambda c: F.abs(c - 0.5) <= half
    return F.avg(F.coalesce(near(x) & near(y), F.lit(False)).cast("int"))


def with_fallback(value: Column, other: Column, least: float) -> tuple[Column, Column]:
    """(value, or other where it is missing, at least least; whether other was used)."""
    missing = value.isNull() | F.isnan(value.cast("double"))
    return F.greatest(F.when(missing, other).otherwise(value), F.lit(float(least))), missing


def demoted(nodes: DataFrame, categories: DataFrame, category: str, moved: Column, tracked: Column) -> DataFrame:
    """Nodes with static: their category says so (categories: category, is_static) and they neither moved nor are tracked."""
    known = nodes.join(categories, category, "left")
    return known.withColumn("static", F.coalesce("is_static", F.lit(False)) & ~F.coalesce(moved, F.lit(False)) & ~F.coalesce(tracked, F.lit(False))).drop("is_static")


def overlap_share(rows: DataFrame, track: str, overlap: str, area: str, most: float) -> DataFrame:
    """track, share of its area inside the dynamic mask, and drop above most."""
    per = rows.groupBy(track).agg(F.coalesce(F.try_divide(F.sum(overlap), F.sum(area)), F.lit(0.0)).alias("share"))
    return per.withColumn("drop", F.col("share") > most)
