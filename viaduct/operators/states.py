"""Metrics as mergeable states: tables that can be added to, merged, written, read again and computed from later.

A state is a DataFrame of one row a key and part (key, part, n, and one column for each sum, or one row a value for states
that concatenate), never a value on the driver, so states of any number of runs, shards or days are merged by union, and
only compute() adds them up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """sums: aggregates that add up (name to expression over the rows); kept: columns whose rows are kept as they are; result:
    final columns over the sums (or, with kept, aggregates over the kept rows). A metric has sums or kept."""

    key: tuple[str, ...]
    sums: dict[str, Column] | None = None
    kept: tuple[str, ...] = ()
    result: Callable[[], dict[str, Column]] = dict
    state: DataFrame | None = None

    def update(self, rows: DataFrame) -> Metric:
        """With what these rows add."""
        part = rows.select(*self.key, *self.kept) if self.kept else rows.groupBy(*self.key).agg(*[F.sum(e).alias(n) for n, e in self.sums.items()])
        return replace(self, state=part if self.state is None else self.state.unionByName(part))

    def merge(self, *others: Metric) -> Metric:
        """With the states of others of the same kind."""
        state = self.state
        for other in others:
            if (other.key, tuple(other.sums or ()), other.kept) != (self.key, tuple(self.sums or ()), self.kept):
                raise ValueError("metrics of another kind")
            if other.state is not None:
                state = other.state if state is None else state.unionByName(other.state)
        return replace(self, state=state)

    def reset(self) -> Metric:
        return replace(self, state=None)

    def compact(self) -> DataFrame:
        """The state with one row a key (as it is where rows are kept)."""
        if self.state is None:
            raise ValueError("a metric without rows has no state")
        return self.state if self.kept else self.state.groupBy(*self.key).agg(*[F.sum(n).alias(n) for n in self.sums])

    def save(self, path: str) -> None:
        """Adds the state to the folder; what was saved before stays, so shards may write to one folder, each once."""
        self.compact().write.mode("append").parquet(path)

    def load(self, spark: SparkSession, path: str) -> Metric:
        """With the states saved in the folder, to go on from there."""
        return self.merge(replace(self, state=spark.read.parquet(path)))

    def compute(self) -> DataFrame:
        """key and the result's columns."""
        if self.kept:
            return self.compact().groupBy(*self.key).agg(*[e.alias(n) for n, e in self.result().items()])
        return self.compact().select(*self.key, *[e.alias(n) for n, e in self.result().items()])


def mean(key: tuple[str, ...], value: Column) -> Metric:
    """n and mean of a value that isn't null."""
    fine = value.isNotNull()
    return Metric(key, {"n": fine.cast("long"), "total": F.coalesce(value.cast("double"), F.lit(0.0))}, result=lambda: {"n": F.col("n"), "mean": F.try_divide("total", "n")})


def spread(key: tuple[str, ...], value: Column) -> Metric:
    """n, mean and population variance; values should lie about 0 for their squares to keep their digits."""
    x = F.when(value.isNotNull(), value.cast("double"))
    var = F.try_divide("squares", "n") - F.try_divide("total", "n") * F.try_divide("total", "n")
    return Metric(key, {"n": x.isNotNull().cast("long"), "total": F.coalesce(x, F.lit(0.0)), "squares": F.coalesce(x * x, F.lit(0.0))}, result=lambda: {"n": F.col("n"), "mean": F.try_divide("total", "n"), "variance": F.greatest(var, F.lit(0.0))})


def classes(key: tuple[str, ...], truth: Column, found: Column) -> Metric:
    """Precision, recall and F1 of a binary decision, 0 where undefined."""
    flag = lambda a, b: (a & b).cast("long")
    sums = {"both": flag(truth, found), "only_found": flag(~truth, found), "only_true": flag(truth, ~found)}
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    both, wrong, missed = (F.col(c).cast("double") for c in sums)
    return Metric(key, sums, result=lambda: {"precision": ratio(both, both + wrong), "recall": ratio(both, both + missed), "f1": ratio(2 * both, 2 * both + wrong + missed)})


def median(key: tuple[str, ...], value: str) -> Metric:
    """The exact median, of values that are kept."""
    return Metric(key, kept=(value,), result=lambda: {"n": F.count(value), "median": F.percentile(value, 0.5)})
