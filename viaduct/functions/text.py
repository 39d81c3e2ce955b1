"""Scalar functions on texts, keys and JSON, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits, without the empty one."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def split_key(key: Column) -> Column:
    """batch_hash_seg as a struct; the hash may hold underscores, batch and seg do not."""
    at = lambda i: F.regexp_extract(key, r"^(.*?)_(.*)_([^_]+)$", i)
    return F.struct(at(1).alias("batch"), at(2).alias("hash"), at(3).alias("seg"))


def join_key(batch: Column, hash_: Column, seg: Column) -> Column:
    return F.concat_ws("_", batch, hash_, seg)


def and_list(items: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def first_sentence(text: Column, most: int = 240) -> Column:
    """The text up to its first full stop, question or exclamation mark; a longer one is cut at a word and ends in '...'."""
    one = F.regexp_extract(F.trim(text), r"^[^.!?]*[.!?]?", 0)
    cut = F.regexp_replace(F.regexp_extract(F.substring(one, 1, most), r"(?s)^(.*)\s", 1), r"[,;]+$", "")
    return F.when(F.length(one) <= most, one).otherwise(F.concat(cut, F.lit("...")))


def singular(noun: Column) -> Column:
    """Closed English rules: -ies to -y, -sses and -xes without -es, a plain -s without it."""
    return (
        F.when(noun.rlike("[^aeiou]ies$"), F.regexp_replace(noun, "ies$", "y"))
        .when(noun.rlike("(ss|x|ch|sh)es$"), F.regexp_replace(noun, "es$", ""))
        .when(noun.rlike("[^su]s$"), F.regexp_replace(noun, "s$", ""))
        .otherwise(noun)
    )


def json_text(reply: Column) -> Column:
    """The JSON in a model's reply: all of it, else what a code fence holds, else from the first bracket to its last partner."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    spanned = F.regexp_extract(reply, r"(?s)(\{.*\}|\[.*\])", 1)
    whole = lambda c: F.when(c.rlike(r"(?s)^\s*[\[{]") & F.try_parse_json(c).isNotNull(), F.trim(c))
    return F.coalesce(whole(reply), whole(fenced), whole(spanned))


def weighted_evidence(text: Column, patterns: dict[str, float]) -> Column:
    """Sum of the weights of the patterns that occur."""
    return sum((F.when(text.rlike(p), F.lit(float(w))).otherwise(0.0) for p, w in patterns.items()), F.lit(0.0))


def bucket_of(value: Column, buckets: list[tuple[float, str]]) -> Column:
    """The label of the first bucket whose bound the value does not exceed; the last one beyond all."""
    out = None
    for bound, label in buckets[:-1]:
        out = F.when(value <= bound, label) if out is None else out.when(value <= bound, label)
    return out.otherwise(buckets[-1][1])
