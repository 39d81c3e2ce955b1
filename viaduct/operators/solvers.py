"""Knobs solved by bisection under budgets, and recovered from their rounded values.

A solver holds one bracket a variant; each round probes the middle of every bracket at once, and the probe is a Spark
aggregate over whatever table the budgets are measured on. The number of rounds is fixed, the brackets are written after
each, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.operators.dedup import checkpointed

Probe = Callable[[DataFrame], DataFrame]


def binding(*budgets: tuple[str, Column]) -> Column:
    """The name of the first budget that is broken (its column true), null if none: for a probe's column."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(budgets):
        out = F.when(F.coalesce(broken, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def largest_knob(variants: DataFrame, key: str, low: str, high: str, probe: Probe, rounds: int = 24) -> DataFrame:
    """key, knob, status, binding of every variant: the largest knob of [low, high] found within budget.

    probe takes rows (key, knob) and gives rows (key, binding), binding null where all budgets hold; budgets only get
    tighter as the knob grows. status: ceiling (high itself holds), floor (not even low does; knob null) or solved, where
    the bracket is halved so many times, knob holds and what is 2^-rounds of the bracket above it doesn't; binding is what
    the last probe above the knob broke. A variant that the probe doesn't return has nothing to break."""
    bracket = variants.select(key, F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high"))

    def probed(at: DataFrame, knob: Column, name: str) -> DataFrame:
        found = probe(at.select(key, knob.alias("knob"))).select(key, F.col("binding").alias(name))
        return at.join(found, key, "left")

    state = probed(probed(bracket, F.col("high"), "at_high"), F.col("low"), "at_low")
    status = F.when(F.col("at_high").isNull(), "ceiling").when(F.col("at_low").isNotNull(), "floor").otherwise("solved")
    state = checkpointed(state.select(key, "low", "high", status.alias("status"), F.coalesce("at_low", "at_high").alias("binding")))
    ends = state.where("status <> 'solved'")
    state = state.where("status = 'solved'")
    middle = (F.col("low") + F.col("high")) / 2
    for _ in range(rounds):
        held = F.col("met").isNull()
        state = probed(state, middle, "met").select(key, F.when(held, middle).otherwise(F.col("low")).alias("low"), F.when(held, F.col("high")).otherwise(middle).alias("high"), "status", F.coalesce("met", "binding").alias("binding"))
        state = checkpointed(state)
    knob = F.when(F.col("status") == "ceiling", F.col("high")).when(F.col("status") == "solved", F.col("low"))
    return ends.unionByName(state).select(key, knob.alias("knob"), "status", "binding")


def recovered_knob(variants: DataFrame, key: str, rounded: str, error: Probe | Column, tolerance: float, digits: int = 5, steps: int = 50) -> DataFrame:
    """key, knob, error: the true knob behind a value rounded to so many digits, null where none fits.

    error takes rows (key, trial, knob) and gives rows (key, trial, error), how far what the knob rebuilds is from what is
    known; where the variants' own columns tell it, it is a column over them and knob, and trials meet no other rows. Trials spread evenly from the rounded value to both ends of its rounding interval (steps a side, the lower one
    first); the nearest within the tolerance is the answer."""
    half = 0.5 * 10.0**-digits
    side = F.when(F.col("trial") % 2 == 1, -1.0).otherwise(1.0)
    own = variants.columns if isinstance(error, Column) else [key]
    trials = variants.select(*own, F.col(rounded).cast("double").alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(2 * steps))).alias("trial"))
    trials = trials.select(*own, "trial", (F.col("_k") + side * (half * F.ceil(F.col("trial") / 2) / steps)).alias("knob"))
    if isinstance(error, Column):
        fits = trials.select(key, "trial", "knob", error.alias("error")).where(F.col("error") <= tolerance)
    else:
        fits = error(trials).where(F.col("error") <= tolerance).select(key, "trial", "error").join(trials, [key, "trial"])
    best = fits.groupBy(key).agg(F.min(F.struct("trial", "knob", "error")).alias("_b")).select(key, "_b.knob", "_b.error")
    return variants.select(key).join(best, key, "left")
