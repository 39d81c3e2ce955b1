"""Documents of unknown depth: ids scrubbed from JSON text, with counts of what went."""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_ghost(id_: str, assets: set[str], names: set[str], resolve) -> bool:
    """Whether an id names something that is no asset: it isn't listed itself, resolves to a name, and that name holds no
    asset's id. What resolves to nothing does no harm and isn't a ghost."""
    low = id_.strip().lower()
    if not low or low in assets:
        return False
    target = resolve(low, names)
    return target is not None and not any(a in target for a in assets)


def first_name(low: str, names: set[str]) -> str | None:
    """The name equal to low, or else the least name that begins with it, or else the least that holds it."""
    if low in names:
        return low
    return min((n for n in names if n.startswith(low)), default=None) or min((n for n in names if low in n), default=None)


def scrubbed(document: str | None, ghost, lists: frozenset[str], scalars: frozenset[str]) -> tuple[str | None, dict[str, int], dict[str, int]]:
    """The document without ghosts in the lists under the given keys, at any depth; how often each was taken out; and how
    often each stands under a scalar key ("key=id"), where it stays. Text that holds none is returned as it is, and so is
    text that isn't JSON. The walk keeps its own stack, so depth is bounded by the parser only."""
    removed, kept = Counter(), Counter()
    try:
        root = json.loads(document) if document is not None else None
    except (ValueError, RecursionError):
        return document, {}, {}
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            for key, value in node.items():
                if key in lists and isinstance(value, list):
                    bad = [isinstance(x, str) and ghost(x) for x in value]
                    removed.update(x for x, b in zip(value, bad, strict=True) if b)
                    value[:] = [x for x, b in zip(value, bad, strict=True) if not b]
                elif key in scalars and isinstance(value, str) and ghost(value):
                    kept[f"{key}={value}"] += 1
            stack.extend(v for v in node.values() if isinstance(v, (dict, list)))
        elif isinstance(node, list):
            stack.extend(v for v in node if isinstance(v, (dict, list)))
    text = json.dumps(root, ensure_ascii=False, separators=(",", ":")) if removed else document
    return text, dict(removed), dict(kept)


def scrub(document: Column, assets: Column, names: Column, lists: list[str], scalars: list[str], resolve=first_name) -> Column:
    """struct(document, removed map<string, int>, kept map<string, int>) of JSON text or VARIANT; assets and names are the
    row's lists of lower-case ids (null: none). resolve(low, names) gives the name that an id stands for, or None."""
    ids, ones = frozenset(lists), frozenset(scalars)

    @F.pandas_udf("document string, removed map<string, int>, kept map<string, int>")
    def run(documents: pd.Series, assets: pd.Series, names: pd.Series) -> pd.DataFrame:
        out = []
        for d, a, n in zip(documents, assets, names, strict=True):
            listed, known, seen = set(a) if a is not None else set(), set(n) if n is not None else set(), {}

            def ghost(x: str, listed=listed, known=known, seen=seen) -> bool:
                if x not in seen:
                    seen[x] = is_ghost(x, listed, known, resolve)
                return seen[x]

            out.append(scrubbed(d, ghost, ids, ones))
        return pd.DataFrame(out, columns=["document", "removed", "kept"])

    return run(document.cast("string"), assets, names)
