"""Spreads, shares, folds and resampling of grouped measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.measures import turn_gap


def log_spread(value: str) -> Column:
    """Population deviation of log10 of the positive finite values; an aggregate."""
    v = F.col(value)
    return F.stddev_pop(F.when((v > 0) & (v < float("inf")), F.log10(v)))


def conditional_crosstab(rows: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def relative_range(rows: DataFrame, entry: str, arm: str, value: str) -> DataFrame:
    """entry, arms and (max - min) / mean over the arms' means."""
    per = rows.groupBy(entry, arm).agg(F.avg(value).alias("_v"))
    return per.groupBy(entry).agg(F.count("*").alias("arms"), F.try_divide(F.max("_v") - F.min("_v"), F.avg("_v")).alias("spread"))


def weighted_share(rows: DataFrame, label: str, length: str) -> DataFrame:
    """label, its chunks, its frames and their share of all frames."""
    per = rows.groupBy(label).agg(F.count("*").alias("chunks"), F.sum(length).alias("frames"))
    return per.withColumn("share", F.col("frames") / F.sum("frames").over(Window.partitionBy()))  # a row a label


def half_splits(rows: DataFrame, key: str, value: str, trials: int, seed: str = "half") -> DataFrame:
    """trial and the absolute difference of the means of two halves that md5 of (seed, trial, key) deals: every trial is
    four sums, so the work is one pass with map-side combining."""
    bit = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("trial").cast("string"), F.col(key).cast("string")).cast("binary")), 1, 1) < "8"
    drawn = rows.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("_left", bit)
    means = drawn.groupBy("trial").agg(F.avg(F.when(F.col("_left"), F.col(value))).alias("a"), F.avg(F.when(~F.col("_left"), F.col(value))).alias("b"))
    return means.select("trial", F.abs(F.col("a") - F.col("b")).alias("difference"))


def nan_aware(rows: DataFrame, arm: str, value: str) -> DataFrame:
    """n of the values that are numbers, their mean and median, and how many are not."""
    v = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(arm).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.count_if(v.isNull()).alias("missing"))


def histogram_of_counts(rows: DataFrame, split: str, scene: str) -> DataFrame:
    """split, per_scene (records of a scene) and how many scenes have so many."""
    return rows.groupBy(split, scene).agg(F.count("*").alias("per_scene")).groupBy(split, "per_scene").agg(F.count("*").alias("scenes"))


def tally(lines: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """pattern, lines that match it, and its matches."""
    c = F.col(text)
    each = [F.struct(F.lit(n).alias("pattern"), F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0)).alias("m")) for n, p in patterns.items()]
    return lines.select(F.inline(F.array(*each))).groupBy("pattern").agg(F.count_if(F.col("m") > 0).alias("lines"), F.sum("m").alias("matches"))


def track_summary(rows: DataFrame, track: list[str], score: str, frame: str, area: str) -> DataFrame:
    """Mean score, frames, mean and largest area of each track. Means are sums of decimals of four digits, which no order of
    addition changes, divided once in double."""
    mean = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double") / F.count(c)
    return rows.groupBy(*track).agg(mean(score).alias("score"), F.count_distinct(frame).alias("frames"), mean(area).alias("mean_area"), F.max(area).alias("max_area"))


def trimmed_direction(rows: DataFrame, group: str, id_: str, angle: str, share: float) -> DataFrame:
    """Directions of a group of bounded size (frames of a track): the centre is the sample with the least median angle to
    the others; the ceil(share n) samples closest to it are kept and averaged as unit vectors, in degrees."""
    other = rows.select(group, F.col(id_).alias("_o"), F.col(angle).alias("_a"))
    pairs = rows.join(other, group).withColumn("_d", turn_gap(F.col(angle), F.col("_a")))
    per = pairs.groupBy(group, id_).agg(F.median("_d").alias("_m"), F.max("_d").alias("_w"))
    centre = per.groupBy(group).agg(F.min(F.struct("_m", id_)).alias("_c"), F.max("_w").alias("widest"), F.count("*").alias("_n"))
    near = pairs.join(centre, group).where(F.col(id_) == F.col(f"_c.{id_}"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_d", "_o"))
    kept = near.withColumn("_p", place).where(F.col("_p") <= F.ceil(F.col("_n") * share))
    x, y = F.avg(F.cos(F.radians("_a"))), F.avg(F.sin(F.radians("_a")))
    return kept.groupBy(group, "widest").agg(F.count("*").alias("kept"), F.degrees(F.atan2(y, x)).alias("direction")).select(group, "kept", "direction", "widest")


def rates(rows: DataFrame, arm: str, slice_: str, hits: list[str]) -> DataFrame:
    """n and the mean of each 0/1 column for every (arm, slice), every arm and every slice; null stands for all."""
    return rows.cube(arm, slice_).agg(F.count("*").alias("n"), *[F.avg(F.col(h).cast("int")).alias(h) for h in hits])


def median_of_medians(rows: DataFrame, arm: str, entry: str, value: str) -> DataFrame:
    per = rows.groupBy(arm, entry).agg(F.median(value).alias("_m"))
    return per.groupBy(arm).agg(F.count("*").alias("entries"), F.avg("_m").alias("mean_of_medians"), F.median("_m").alias("median_of_medians"))


def signature_counts(rows: DataFrame, entry: str, order: list[str], tag: str) -> DataFrame:
    """One row: entries, distinct tag sequences, and the share of entries whose tag never changes."""
    tags = F.array_sort(F.collect_list(F.struct(*order, tag)))
    per = rows.groupBy(entry).agg(F.sha2(F.array_join(F.transform(tags, lambda s: F.coalesce(s[tag], F.lit("~"))), "|"), 256).alias("_s"), F.count_distinct(tag).alias("_k"))
    return per.agg(F.count("*").alias("entries"), F.count_distinct("_s").alias("signatures"), F.avg((F.col("_k") <= 1).cast("int")).alias("constant_share"))


def straightness(rows: DataFrame, entry: str, order: list[str], value: str) -> DataFrame:
    """entry, path, chord (last from first), their ratio (0 for no path) and reach."""
    w = Window.partitionBy(entry).orderBy(*order)
    at = rows.withColumns({"_step": F.abs(F.col(value) - F.lag(value).over(w)), "_i": F.row_number().over(w), "_first": F.first(value).over(w)})
    agg = at.groupBy(entry).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path"), F.abs(F.max_by(value, "_i") - F.min_by(value, "_i")).alias("chord"), F.max(F.abs(F.col(value) - F.col("_first"))).alias("reach"))
    return agg.withColumn("straightness", F.coalesce(F.try_divide("chord", "path"), F.lit(0.0)))


def log_correlation(rows: DataFrame, key: str, x: str, y: str, above: int = 10) -> DataFrame:
    """Correlation of logarithms over pairs of positive values, for more than above of them; null otherwise."""
    pos = rows.where((F.col(x) > 0) & (F.col(y) > 0))
    return pos.groupBy(key).agg(F.count("*").alias("n"), F.when(F.count("*") > above, F.corr(F.log(x), F.log(y))).alias("r"))


def divisor_blocks(rows: DataFrame, arm: str, subset: str, value: str, divisors: list[str]) -> DataFrame:
    """n, mean and median of value / divisor for each divisor column, by arm and by (arm, subset); subset null is all."""
    each = F.inline(F.array(*[F.struct(F.lit(d).alias("divisor"), F.try_divide(F.col(value), F.col(d)).alias("q")) for d in divisors]))
    long = rows.select(arm, subset, each).where("q IS NOT NULL")
    return long.groupingSets([[arm, "divisor"], [arm, subset, "divisor"]], arm, subset, "divisor").agg(F.count("*").alias("n"), F.avg("q").alias("mean"), F.median("q").alias("median"))


def support_prf(rows: DataFrame, sample: str, truth: str, guess: str) -> DataFrame:
    """Per sample: precision, recall and F1 weighted by support over the classes of its truth, floors of 1e-9, and
    whether all guesses are right."""
    hit = (F.col(truth) == F.col(guess)).cast("int")
    support = rows.groupBy(sample, F.col(truth).alias("_c")).agg(F.count("*").alias("_s"), F.sum(hit).alias("_tp"))
    guessed = rows.groupBy(sample, F.col(guess).alias("_c")).agg(F.count("*").alias("_g"))
    floor = lambda c: F.greatest(c.cast("double"), F.lit(1e-9))
    each = support.join(guessed, [sample, "_c"], "left").withColumns({"_p": F.col("_tp") / floor(F.coalesce("_g", F.lit(0))), "_r": F.col("_tp") / floor(F.col("_s"))})
    each = each.withColumn("_f", 2 * F.col("_p") * F.col("_r") / floor(F.col("_p") + F.col("_r")))
    mean = lambda c: F.sum(F.col(c) * F.col("_s")) / F.sum("_s")
    return each.groupBy(sample).agg(mean("_p").alias("precision"), mean("_r").alias("recall"), mean("_f").alias("f1"), (F.sum("_tp") == F.sum("_s")).alias("exact"))


def spread_table(rows: DataFrame, scene: str, value: str) -> DataFrame:
    """Per scene of two clips or more: coefficient of variation, max / min, deviation of log10, and the middle percentiles."""
    agg = rows.where(F.col(value) > 0).groupBy(scene).agg(
        F.count("*").alias("n"), F.try_divide(F.stddev_pop(value), F.avg(value)).alias("cv"), F.try_divide(F.max(value), F.min(value)).alias("ratio"), log_spread(value).alias("log_sd"), F.percentile(value, 0.25).alias("p25"), F.percentile(value, 0.75).alias("p75")
    )
    return agg.where("n >= 2")


def taxonomy(rows: DataFrame, preset: str, place: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(preset, within: root mean square distance of its members from its mean shape; pairs a < b of presets with the
    distance of their mean shapes). Presets are a closed vocabulary, so the pairs are few."""
    shape = rows.groupBy(preset, place).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count("*").alias("_n"))
    within = shape.groupBy(preset).agg(F.sqrt(F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("within"))
    a, b = (shape.select(F.col(preset).alias(n), place, F.col("_m").alias(f"_{n}")) for n in ("a", "b"))
    between = a.join(b, place).where("a < b").groupBy("a", "b").agg(F.sqrt(F.avg((F.col("_a") - F.col("_b")) ** 2)).alias("between"))
    return within, between
