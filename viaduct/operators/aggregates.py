"""Group statistics with the conventions that corpora are reported in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_table(rows: DataFrame, key: list[str], value: str, min_n: int = 1) -> DataFrame:
    """n, mean, sd (population), median, min and max of the values that are not null; groups below min_n go."""
    v = F.col(value)
    out = rows.where(v.isNotNull()).groupBy(*key).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    return out.where(F.col("n") >= min_n)


def pearson(rows: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """r over complete pairs: null below three, 0 where a side does not vary."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.when(F.count("*") >= 3, F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)))
    return pairs.groupBy(*key).agg(F.count("*").alias("n"), r.alias("r"))


def value_counts(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Distinct values of each group with how often each occurs (_c), how many values are up to it (_hi) and in all (_n):
    equal values combine before the shuffle."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_c"))
    up_to = F.sum("_c").over(Window.partitionBy(*key).orderBy(value))
    return counts.withColumns({"_hi": up_to, "_n": F.sum("_c").over(Window.partitionBy(*key))})


def average_ranked(rows: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """rows with name: the mean of the ranks that tied values share."""
    ranks = value_counts(rows, key, value).select(*key, value, (F.col("_hi") - (F.col("_c") - 1) / 2).alias(name))
    return rows.join(ranks, [*key, value])


def spearman(rows: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, x, y)
    ranked = average_ranked(average_ranked(pairs, key, x, "rx"), key, y, "ry")
    return pearson(ranked, key, "rx", "ry").withColumnRenamed("r", "rho")


def nearest_rank(fraction: float):
    """The place round(fraction * (n - 1)) of n sorted values, halves to even."""
    return lambda n: F.bround(F.lit(fraction) * (n - 1)).cast("long")


def upper_median(n: Column) -> Column:
    """The place n div 2 of n sorted values."""
    return F.floor(n / 2)


def at_places(rows: DataFrame, key: list[str], value: str, places: dict) -> DataFrame:
    """For each group the sorted values at the given places (functions of n), from value counts: no group is sorted whole
    in one array."""
    inside = lambda at: (at < F.col("_hi")) & (at >= F.col("_hi") - F.col("_c"))
    found = [F.max(F.when(inside(place(F.col("_n"))), F.col(value))).alias(name) for name, place in places.items()]
    return value_counts(rows, key, value).groupBy(*key).agg(*found)


def edges(rows: DataFrame, value: str, bins: int) -> list[float]:
    """Inner edges of equal-count bins by linear interpolation, without repeats."""
    found = rows.select(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0] if bins > 1 else []
    return sorted(set(found or []))


def bin_of(value: str, cuts: list[float]) -> Column:
    """The number of edges below the value: bins are closed on the right, as of a left search in sorted edges."""
    return sum(((F.col(value) > c).cast("int") for c in cuts), F.lit(0))


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair of values, with shares of all rows and of the rows of a."""
    counts = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    every = rows.agg(F.count("*").alias("all_n"))
    per_a = Window.partitionBy(a)
    return counts.crossJoin(F.broadcast(every)).select(a, b, "n", (F.col("n") / F.col("all_n")).alias("share"), (F.col("n") / F.sum("n").over(per_a)).alias("share_of_row"))


def tails(rows: DataFrame, key: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """For each threshold, how many values lie below it: one pass, then one row for each threshold."""
    counted = rows.groupBy(*key).agg(F.count(value).alias("n"), *[F.count_if(F.col(value) < t).alias(f"_t{i}") for i, t in enumerate(thresholds)])
    each = F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("below")) for i, t in enumerate(thresholds)]))
    return counted.select(*key, "n", each).withColumn("share", F.col("below") / F.col("n"))


def with_all(rows: DataFrame, key: str, name: str = "all") -> DataFrame:
    """Every row once for its group and once for the group of all."""
    return rows.withColumn(key, F.explode(F.array(F.col(key), F.lit(name))))


def entropy(rows: DataFrame, key: list[str], tag: str) -> DataFrame:
    """Entropy in bits of the tags of each group, and the share of the most usual one."""
    counts = rows.groupBy(*key, tag).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*key))
    return counts.withColumn("p", p).groupBy(*key).agg((-F.sum(F.col("p") * F.log2("p"))).alias("bits"), F.max("p").alias("top_share"), F.count("*").alias("distinct_tags"))


def icc(rows: DataFrame, subject: str, value: str) -> DataFrame:
    """Variance within and between subjects (population), and between / (between + within)."""
    per = rows.groupBy(subject).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count("*").alias("n"))
    both = per.agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("within"), F.var_pop("m").alias("between"))
    return both.withColumn("icc", F.col("between") / (F.col("between") + F.col("within") + 1e-12))


def weighted_prf(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 of each true class, weighted by support; a class never guessed has precision 0."""
    support = rows.groupBy(F.col(truth).alias("c")).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(guess)).alias("tp"))
    guessed = rows.groupBy(F.col(guess).alias("c")).agg(F.count("*").alias("guessed"))
    p, r = F.col("tp") / F.col("guessed"), F.col("tp") / F.col("support")
    each = support.join(guessed, "c", "left").select("support", F.coalesce(p, F.lit(0.0)).alias("p"), r.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    mean = lambda c: F.sum(c * F.col("support")) / F.sum("support")
    return each.agg(mean(F.col("p")).alias("precision"), mean(F.col("r")).alias("recall"), mean(f1).alias("f1"))
