"""Reject rules that keep every reason: a row is judged once, by all rules, and stays a row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in their order; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))


def first_reason(rules: dict[str, Column]) -> Column:
    """The first rule that holds, or null."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules.items()])


def judge(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with reasons (array<string>) and keep (no reason)."""
    return rows.withColumn("reasons", reasons(rules)).withColumn("keep", F.size("reasons") == 0)


_COMPARISON = re.compile(r"\s*(\w+)\s*(>=|<=|==|!=|=|>|<)\s*(\S+)\s*")


def passes(expressions: list[str]) -> Column:
    """Whether all comparisons "column operator number" hold; one whose value is missing (null or NaN) passes."""
    out = F.lit(True)
    for e in expressions:
        found = _COMPARISON.fullmatch(e)
        if not found:
            raise ValueError(f"not a comparison of a column with a number: {e}")
        value = F.col(found[1]).cast("double")
        holds = F.expr(f"`{found[1]}` {found[2]} {float(found[3])!r}D")
        out = out & (F.isnan(value) | F.coalesce(holds, F.lit(True)))
    return out
