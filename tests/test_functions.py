"""Scalar functions, geometry, readers, sinks and rounds on small fixtures with results worked out by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.functions import geometry as G
from viaduct.functions import text as X
from viaduct.operators import aggregates, dedup, joins, metrics, topk, windows
from viaduct.sources import readers, sinks
from viaduct.streaming import rounds


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('Sure: {"a": {"b": 2}} done', '{"a": {"b": 2}}'), ("[1, 2]", "[1, 2]"), ('{"a": ', None), ("no json", None), (None, None)],
)
def test_json_text(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(X.json_text(F.col("t"))).first()[0]
    assert (got and json.loads(got)) == (want and json.loads(want))


def test_keys_lists_sentences(spark):
    k = spark.createDataFrame([("b1_a_b-c_s2",)], "k string").select(X.split_key(F.col("k")).alias("k")).first()["k"]
    assert tuple(k) == ("b1", "a_b-c", "s2")
    for items, want in ([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b and c"):
        assert spark.createDataFrame([(items,)], "i array<string>").select(X.and_list(F.col("i"))).first()[0] == want
    for noun, want in ("cities", "city"), ("boxes", "box"), ("glass", "glass"), ("cars", "car"), ("bus", "bus"):
        assert one(spark, X.singular(F.col("n")), n=noun) == want
    assert one(spark, X.first_sentence(F.col("t")), t="Go on. Then stop.") == "Go on."
    assert one(spark, X.first_sentence(F.col("t"), 12), t="one two three, four") == "one two..."
    assert [one(spark, X.bucket_of(F.col("v"), [(1, "low"), (2, "mid"), (3, "high")]), v=v) for v in (0.5, 1.0, 1.5, 9.0)] == ["low", "low", "mid", "high"]


def test_geometry(spark):
    def rigid(yaw, t):
        c, s = math.cos(yaw), math.sin(yaw)
        return [c, -s, 0.0, t[0], s, c, 0.0, t[1], 0.0, 0.0, 1.0, t[2]]

    df = spark.createDataFrame([(rigid(0.3, (1.0, 2.0, 3.0)), rigid(1.1, (-1.0, 0.5, 4.0)))], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(G.product(a, G.inverse(a)).alias("i"), G.centre(a).alias("c"), G.angle(a, b).alias("w"), G.product(a, b).alias("p"), G.motion_class(F.lit(0.5), F.lit(0.0), F.lit(-0.5)).alias("k")).first()
    full = lambda m: np.vstack([np.array(m).reshape(3, 4), [0, 0, 0, 1]])
    m, n = (full(x) for x in df.first())
    assert np.allclose(row["i"], np.eye(4)[:3].ravel()) and np.allclose(row["c"], -m[:3, :3].T @ m[:3, 3])
    assert abs(row["w"] - math.degrees(0.8)) < 1e-9 and np.allclose(row["p"], (m @ n)[:3].ravel()) and row["k"] == 11
    eye = spark.createDataFrame([(rigid(0.0, (0.0, 0.0, 0.0)), [0.5, -0.5, 2.0], [0.0, 0.0, -1.0])], "m array<double>, p array<double>, q array<double>")
    f = [F.lit(x) for x in (100.0, 100.0, 50.0, 50.0)]
    seen = eye.select(G.project(F.col("m"), F.col("p"), *f).alias("p"), G.project(F.col("m"), F.col("q"), *f).alias("q")).first()
    assert tuple(seen["p"]) == (75.0, 25.0, 2.0) and tuple(seen["q"]) == (None, None, -1.0)


def test_short_runs_go_to_their_neighbours():
    assert windows.drop_short_runs(list("aaabbb"), 2) == list("aaabbb")
    assert windows.drop_short_runs(list("aaabccc"), 2) == list("aaaaccc")
    assert windows.drop_short_runs(list("bccc"), 2) == list("cccc")
    assert windows.drop_short_runs(list("cccb"), 2) == list("cccc")
    assert windows.drop_short_runs(list("aaaxyzccc"), 2) == list("aaaaaaccc")
    assert windows.drop_short_runs([], 3) == [] and windows.drop_short_runs(list("a"), 5) == ["a"]


def test_statistics_at_their_edges(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 1.0, 5.0), ("b", 2.0, 5.0), ("b", 3.0, 5.0), ("c", 1.0, 2.0), ("c", 2.0, None)], "k string, x double, y double")
    assert {r["k"]: r["r"] for r in aggregates.pearson(rows, ["k"], "x", "y").collect()} == {"a": None, "b": 0.0, "c": None}
    assert {r["k"]: (r["n"], r["sd"]) for r in aggregates.group_table(rows, ["k"], "y", 2).collect()} == {"a": (2, 0.5), "b": (3, 0.0)}
    assert [r["m"] for r in aggregates.at_places(rows, ["k"], "x", {"m": aggregates.upper_median}).orderBy("k").collect()] == [2.0, 2.0, 2.0]


def test_intervals_ranges_and_splits(spark):
    spans = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 11), ("a", 1, 2), ("b", 3, 4)], "k string, s long, e long")
    assert sorted(map(tuple, joins.coalesce_intervals(spans, ["k"], "s", "e").select("k", "s", "e", "n").collect())) == [("a", 0, 7, 3), ("a", 9, 11, 1), ("b", 3, 4, 1)]
    assert joins.coalesce_intervals(spans, ["k"], "s", "e", 2).count() == 2
    rows = spark.range(103)
    ranked = topk.global_rank(rows, ["id"])
    assert all(r["id"] == r["pos"] for r in ranked.collect())
    assert [r["id"] for r in topk.every_stride(rows, ["id"], 7, 103).orderBy("id").collect()] == [i * 103 // 7 for i in range(7)]


def test_components_and_staleness(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 8)], "a long, b long")
    assert {r["node"]: r["component"] for r in dedup.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 8: 8, 9: 8}


def test_frechet_of_equal_sets_is_zero(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(g, [float(x) for x in v]) for g in ("a", "b") for v in np.random.default_rng(1).normal(size=(40, 3))], "g string, v array<double>")
    found = metrics.gaussians(metrics.moments(rows, ["g"], "v"), "g")
    assert abs(metrics.frechet(found["a"], found["b"])) < 1e-6 and np.allclose(found["a"][1], np.cov(np.random.default_rng(1).normal(size=(40, 3)).T))
    assert rng is not None


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"scene": "s1", "v": 1}\nbroken\n{"scene": "s2", "v": 2}\n{"scene": "s1", "v": 3}\n')
    got = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "scene string, v int", key="scene")
    assert sorted(map(tuple, got.collect())) == [("s1", 3), ("s2", 2)]
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y.csv").write_text("a,c\n3,4\n")
    assert sorted(map(tuple, readers.ragged_csv(spark, [str(tmp_path / "x.csv"), str(tmp_path / "y.csv")]).collect())) == [("1", "2", None), ("3", None, "4")]
    (tmp_path / "ids.txt").write_text("b/s/0\n\nb/s/0\nb/t/1\n")
    assert sorted(r["id"] for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["b/s/0", "b/t/1"]
    (tmp_path / "black.csv").write_text("scene,reason\nx/y/h1,bad\nh2,bad\nh1,twice\n")
    assert sorted(r["scene"] for r in readers.blacklist(spark, str(tmp_path / "black.csv")).collect()) == ["h1", "h2"]
    (tmp_path / "prompts.json").write_text(json.dumps({"0": {"concise": "a"}, "1": {"concise": "b"}}))
    assert sorted(map(tuple, readers.nested_map(spark, str(tmp_path / "prompts.json"), "concise string").select("key", "concise").collect())) == [("0", "a"), ("1", "b")]
    np.savez(tmp_path / "pose.npz", extrinsics=np.arange(24.0).reshape(2, 3, 4))
    assert [r["row"] for r in readers.packed_arrays(spark, str(tmp_path / "pose.npz"), "extrinsics").orderBy("pos").collect()] == [list(np.arange(12.0)), list(np.arange(12.0, 24.0))]
    (tmp_path / "full").mkdir()
    (tmp_path / "half").mkdir()
    for p in ("full/a", "full/b", "half/a"):
        (tmp_path / p).write_text("x")
    assert [r["folder"].rpartition("/")[2] for r in readers.complete_folders(spark, str(tmp_path), ["a", "b"]).collect()] == ["full"]


def test_sinks_and_rounds(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    path = sinks.versioned(rows, str(tmp_path / "t"), "v1")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.versioned(rows, str(tmp_path / "t"), "v1")
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows.write.mode("append").parquet(source)
    run = lambda: rounds.rounds(spark, source, "k long, v string", target, check, "k", lambda df: df.withColumn("n", F.length("v")))
    assert run().count() == 2
    spark.createDataFrame([(2, "again"), (3, "z")], "k long, v string").write.mode("append").parquet(source)
    assert sorted((r["k"], r["v"]) for r in run().collect()) == [(1, "x"), (2, "y"), (3, "z")]
    assert run().count() == 3
