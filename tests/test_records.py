"""Rule versions, preferred records, padding, sibling comparisons, coverage and angles on fixtures worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from viaduct.operators import records


def test_versions_take_over_and_change_rules(spark):
    versions = {"a": {"most": 5, "ask": True}, "b": {"from": "a", "most": 3}, "c": {"from": "b", "ask": False}, "loop": {"from": "loop"}}
    rules = lambda th: {"big": F.col("v") > th["most"]} | ({"none": F.col("w").isNull()} if th["ask"] else {})
    assert records.settings(versions, "c") == {"most": 3, "ask": False}
    for bad in ("loop", "missing"):
        with pytest.raises(ValueError, match="unknown"):
            records.settings(versions, bad)
    df = spark.createDataFrame([(1, 4, None), (2, 9, "x"), (3, None, "x")], "i int, v int, w string")
    got = {r["i"]: (r["reasons"], r["keep"]) for r in records.judged(df, versions, "b", rules).collect()}
    assert got == {1: (["big", "none"], False), 2: (["big"], False), 3: ([], True)}
    counts = {(r["version"], r["reason"]): r["n"] for r in records.version_counts(df, {k: v for k, v in versions.items() if k != "loop"}, rules).collect()}
    assert counts == {("a", "big"): 1, ("a", "none"): 1, ("a", "kept"): 1, ("b", "big"): 2, ("b", "none"): 1, ("b", "kept"): 1, ("c", "big"): 2, ("c", "kept"): 1}


def test_preferred_and_padded_records(spark):
    df = spark.createDataFrame([("u", 1, "a", 10.0), ("u", 2, "b", 20.0), ("u", 3, "b", 30.0), ("u", 4, "a", 40.0), ("v", 2, "a", 50.0), ("v", 1, "c", None)], "k string, t int, m string, v double")
    assert {tuple(r) for r in records.preferred(df, "k", "m", "b", ["t"], ["v"]).collect()} == {("u", "b", 30.0), ("v", "c", None)}
    got = {r["k"]: (r["values"], r["mask"], r["n"]) for r in records.padded(df, "k", ["t"], "v", 3, -1.0).collect()}
    assert got == {"u": ([10.0, 20.0, 30.0], [True] * 3, 4), "v": ([None, 50.0, -1.0], [True, True, False], 2)}
    assert {tuple(r) for r in records.combinations(df, "k", "m").collect()} == {("a+b", 1), ("a+c", 1)}


def test_siblings_are_compared_in_shared_frames(spark):
    rows = [(1, t, "x", 0.1 * t, 4.0, 1.0, "cup") for t in range(4)] + [(1, t, "y", 0.15, 2.0, 3.0, "pan") for t in range(2, 6)] + [(1, 9, "z", 0.5, 1.0, 1.0, "rug"), (1, 2, "z", 0.5, 0.0, 1.0, "rug")]
    df = spark.createDataFrame(rows, "s int, t int, k string, cx double, area double, depth double, label string")
    got = {(r["k"], r["other"]): (r["shared"], r["lines"]) for r in records.compared(df, "s", "t", "k", "label").collect()}
    assert len(got) == 6 and got["x", "z"] == (0, ["- it never appears at the same time as rug"])
    assert got["x", "y"] == (2, ["- it is to the RIGHT of pan in 100% of the frames they share", "- it looks BIGGER: 2.0x the on-screen area of pan (100% of frames)", "- it is NEARER to the viewpoint than pan (100% of frames)"])
    assert got["y", "x"][1][1] == "- it looks SMALLER: 2.0x the on-screen area of cup (100% of frames)"


def test_coverage_angles_and_run_names(spark):
    targets = spark.createDataFrame([(1, i, [float(i), 0.0], [1.0, 0.0], 2.0) for i in range(5)] + [(2, 0, [0.0, 0.0], [1.0, 0.0], 1.0)], "k int, view int, centre array<double>, forward array<double>, scale double")
    selected = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 0.0]), (1, [4.0, 0.0], [0.0, 1.0])], "k int, centre array<double>, forward array<double>")
    assert {tuple(r) for r in records.coverage(targets, selected, ["k"], "view", 1.0, 60.0).collect()} == {(1, 5, 0.6), (2, 1, 0.0)}
    q = lambda a: [math.cos(math.radians(a / 2)), math.sin(math.radians(a / 2)), 0.0, 0.0]
    sets = [spark.createDataFrame([(1, i, q(a), i) for i, a in enumerate(angles)], "g int, i int, q array<double>, pos int") for angles in ([0.0, 90.0], [10.0, 350.0, 180.0])]
    got = {r["i"]: (round(r["mean"], 6), round(r["least"], 6)) for r in records.set_angles(*sets, "g", "i", "q").collect()}
    assert got == {0: (round(200 / 3, 6), 10.0), 1: (90.0, 80.0)}
    names = spark.createDataFrame([("20260101_120000_a_b",), ("20261301_000000_x",), ("plain",)], "n string").select(records.run_parts(F.col("n")).alias("r")).collect()
    assert [r["r"]["name"] for r in names] == ["a_b", "20261301_000000_x", "plain"] and [r["r"]["at"] is None for r in names] == [False, True, True]
