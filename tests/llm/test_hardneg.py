import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, row long, q string, cell int, score double"


def brute(rows, positives=5, negatives=5, low=80):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, v, label) in enumerate(fine):
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for n, (i, w, other) in enumerate(fine) if n != k and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            hits = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(hits, 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2, 0.5) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hardneg.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())


def clusters(n, dim=6, scale=1.0):
    r = np.random.default_rng(3)
    middle = r.normal(size=(12, dim))
    v = middle[r.integers(0, 12, n)] + 0.2 * r.normal(size=(n, dim))
    return [(int(i * 10), [float(x) for x in scale * w], int(r.integers(0, 4))) for i, w in enumerate(v)]


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e11])
def test_negatives_are_those_of_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 64)
    monkeypatch.setattr(hardneg, "GROUP", 5)
    rows = clusters(400, scale=scale)
    want = brute(rows)
    fits = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    assert found(spark, rows) == sorted((*r[:4], fits(r[4]), fits(r[5])) for r in want) and want


def test_odd_rows_ties_and_copies(spark):
    rows = clusters(120)
    v = rows[0][1]
    rows += [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan")] * 6, 1), (4, [float("inf")] * 6, 1), (5, v, None), (None, v, 1), (6, [], 1), (100, [], 1), (200, [1.0, 2.0], 1), (7, [1.0, 2.0], 2), (8, [1.0, 2.0], 1)]
    rows += [(300, v, 1), (300, v, 1), (400, [0.0] * 6, 2), (500, [-x for x in v], 2)] + [(1000 + i, v, i % 3) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_empty_tables_and_no_anchor(spark):
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
