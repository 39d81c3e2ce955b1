"""Time-series operators over entries: each entry is one window partition, ordered by its frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.operators.tracks import drop_short, encode_runs


def stepped(rows: DataFrame, entry: str, order: list[str], value: str) -> DataFrame:
    """rows with step (first difference) and reach (distance from the first value)."""
    w = Window.partitionBy(entry).orderBy(*order)
    return rows.withColumns({"step": F.col(value) - F.lag(value).over(w), "reach": F.abs(F.col(value) - F.first(value).over(w))})


def jumps(rows: DataFrame, entry: str, order: list[str], value: str) -> DataFrame:
    """Path length, reach, and the ratios of the largest step to the median, the sum and the extent."""
    s = F.abs("step")
    agg = stepped(rows, entry, order, value).groupBy(entry).agg(F.count("*").alias("n"), F.sum(s).alias("path"), F.max("reach").alias("reach"), F.max(s).alias("m"), F.median(s).alias("med"), (F.max(value) - F.min(value)).alias("extent"))
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-12))
    return agg.where("n > 1").select(entry, "n", "path", "reach", (F.col("m") / floor("med")).alias("jump_ratio"), (F.col("m") / floor("path")).alias("max_of_path"), (F.col("m") / floor("extent")).alias("max_of_extent"))


def jerk(rows: DataFrame, entry: str, order: list[str], value: str) -> DataFrame:
    """Mean absolute third difference of each entry; entries of fewer than four frames have none."""
    w = Window.partitionBy(entry).orderBy(*order)
    third = F.lead(value, 3).over(w) - 3 * F.lead(value, 2).over(w) + 3 * F.lead(value, 1).over(w) - F.col(value)
    return rows.withColumn("j", F.abs(third)).groupBy(entry).agg(F.count("j").alias("n"), F.avg("j").alias("jerk")).where("n > 0")


def thirds(rows: DataFrame, entry: str, order: list[str], value: str) -> DataFrame:
    """Mean of each third; the first thirds are longer when the length is no multiple of three."""
    w = Window.partitionBy(entry).orderBy(*order)
    return rows.withColumn("third", F.ntile(3).over(w)).groupBy(entry, "third").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def slope(rows: DataFrame, entry: str, order: list[str], value: str) -> DataFrame:
    """Least-squares slope over time scaled to 0 .. 1."""
    w = Window.partitionBy(entry).orderBy(*order)
    t = F.try_divide(F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(entry)) - 1)
    return rows.withColumn("t", t).groupBy(entry).agg(F.count("*").alias("n"), F.regr_slope(value, "t").alias("slope")).where("n > 1")


def runs(rows: DataFrame, entry: str, order: list[str], label: str) -> DataFrame:
    """Run-length encoding: entry, run, label, length, first and last frame number."""
    w = Window.partitionBy(entry).orderBy(*order)
    changed = rows.withColumns({"frame": F.row_number().over(w) - 1, "new": (~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")})
    numbered = changed.withColumn("run", F.sum("new").over(w))
    return numbered.groupBy(entry, "run", label).agg(F.count("*").alias("length"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def smooth_labels(rows: DataFrame, entry: str, order: list[str], label: str, half: int = 7) -> DataFrame:
    """The most usual label in a centred window that is cut at the ends; the least of equally usual ones."""
    w = Window.partitionBy(entry).orderBy(*order).rowsBetween(-half, half)
    around = rows.withColumn("_around", F.sort_array(F.collect_list(label).over(w)))
    # of a sorted list, the label with the most repeats, first on ties
    def add(s, x):
        n = F.when(x.eqNullSafe(s["x"]), s["n"] + 1).otherwise(1)
        return F.struct(x.alias("x"), n.alias("n"), F.when(n > s["most"], x).otherwise(s["best"]).alias("best"), F.greatest(n, s["most"]).alias("most"))

    kind = dict(rows.dtypes)[label]
    zero = F.struct(F.lit(None).cast(kind).alias("x"), F.lit(0).alias("n"), F.lit(None).cast(kind).alias("best"), F.lit(0).alias("most"))
    return around.withColumn("smooth", F.aggregate("_around", zero, add, lambda s: s["best"])).drop("_around")


def tumbling(rows: DataFrame, entry: str, order: list[str], value: str, length: int) -> DataFrame:
    """Full segments of length frames; a short rest is left out."""
    w = Window.partitionBy(entry).orderBy(*order)
    segment = F.floor((F.row_number().over(w) - 1) / length).cast("long")
    return rows.withColumn("segment", segment).groupBy(entry, "segment").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")).where(F.col("n") == length)


def padded_mean(rows: DataFrame, entry: str, order: list[str], value: str, half: int) -> DataFrame:
    """Moving average whose ends are padded by the edge values."""
    w = Window.partitionBy(entry).orderBy(*order)
    whole = Window.partitionBy(entry).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(entry))
    before, after = F.greatest(F.lit(0), half + 1 - i), F.greatest(F.lit(0), half - (n - i))
    total = F.sum(value).over(w.rowsBetween(-half, half)) + before * F.first(value).over(whole) + after * F.last(value).over(whole)
    return rows.withColumn("smooth", total / (2 * half + 1))


def visibility(rows: DataFrame, entry: str, order: list[str], visible: str) -> DataFrame:
    """Share of visible frames, first and last of them, and hidden frames in between."""
    w = Window.partitionBy(entry).orderBy(*order)
    seen = rows.withColumn("t", F.row_number().over(w) - 1)
    agg = seen.groupBy(entry).agg(F.count("*").alias("n"), F.count_if(visible).alias("seen"), F.min(F.when(F.col(visible), F.col("t"))).alias("first"), F.max(F.when(F.col(visible), F.col("t"))).alias("last"))
    return agg.select(entry, "n", "first", "last", (F.col("seen") / F.col("n")).alias("share"), F.coalesce(F.col("last") - F.col("first") + 1 - F.col("seen"), F.lit(0)).alias("gap_frames"))


def context_side(rows: DataFrame) -> DataFrame:
    """For segments [s, e) of n frames: the longer side outside, before on ties, as [context_start, context_end)."""
    before = F.col("s") >= F.col("n") - F.col("e")
    return rows.withColumns({"context_start": F.when(before, F.lit(0)).otherwise(F.col("e")), "context_end": F.when(before, F.col("s")).otherwise(F.col("n"))})


def drop_short_runs(labels: list, least: int) -> list:
    """Labels with the shortest runs below least handed to their neighbours, the odd frame to the left; a helper of shortened."""
    return [x for x, n in drop_short(encode_runs(labels), least) for _ in range(n)]


def shortened(rows: DataFrame, entry: str, order: list[str], label: str, least: int) -> DataFrame:
    """rows with steady: labels after short runs are dropped. Sequential within an entry, so each entry is one group."""
    schema = rows.select(entry, *order, label).schema
    import pyspark.sql.types as T

    schema = T.StructType([*schema.fields, T.StructField("steady", schema[label].dataType)])

    def one(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(steady=drop_short_runs(pdf[label].tolist(), least))

    return rows.select(entry, *order, label).groupBy(entry).applyInPandas(one, schema)
