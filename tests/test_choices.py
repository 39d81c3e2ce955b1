"""Operators without SQL against plain loops, and edge cases of the others."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.functions import captions, measures
from viaduct.operators import aggregates, choices, dedup, filters, metrics, relations, rules, tracks
from viaduct.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("target", [0, 30, 97, 213, 100000])
def test_stratified_holdout_properties(spark, target):
    r = random.Random(5)
    sizes = {i: r.choice([1, 1, 2, 3, 5, 8]) for i in range(120)}
    forced = {3, 4}
    scenes = spark.createDataFrame(list(sizes.items()), "scene long, size long")
    got = [(x["scene"], x["size"], x["why"]) for x in choices.stratified(scenes, "scene", "size", target, spark.createDataFrame([(s,) for s in forced] + [(999,)], "scene long")).collect()]
    assert len({g[0] for g in got}) == len(got) and all(sizes[s] == k for s, k, _ in got)
    assert {s for s, _, why in got if why == "forced"} == forced
    rest = {s: k for s, k in sizes.items() if s not in forced}
    left = min(max(0, target - sum(sizes[s] for s in forced)), sum(rest.values()))
    drawn = [k for _, k, why in got if why == "drawn"]
    assert abs(sum(drawn) - left) <= max(sizes.values()) / 2
    for k in set(rest.values()):  # in proportion, within one scene of each size
        n = sum(1 for v in rest.values() if v == k)
        assert abs(drawn.count(k) - left * n / sum(rest.values())) <= 1
    assert target < 1000 or len(got) == len(sizes)


def test_first_drawn_is_a_prefix_of_the_draws(spark):
    rows = spark.createDataFrame([(i % 2, i, 5 + i % 2) for i in range(9000)], "g int, i long, wanted int")
    got = {(x["g"], x["i"]) for x in choices.first_drawn(rows, "g", "wanted", "i", "s").collect()}
    order = lambda i: hashlib.md5(f"s|{i}".encode()).hexdigest()
    assert got == {(g, i) for g in (0, 1) for i in sorted(range(g, 9000, 2), key=order)[: 5 + g]}


def test_split_again_keeps_the_old_and_stratifies_the_new(spark):
    scenes = spark.createDataFrame([(i, 1 + i % 3) for i in range(90)], "scene long, size long")
    old = spark.createDataFrame([(i, "test" if i % 2 else "train") for i in range(30)], "scene long, split string")
    got = {x["scene"]: (x["split"], x["kept"]) for x in choices.split_again(scenes, old, "scene", "size", 0.2).collect()}
    assert all(got[i] == ("test" if i % 2 else "train", True) for i in range(30)) and not any(got[i][1] for i in range(30, 90))
    held = [1 + i % 3 for i in range(30, 90) if got[i][0] == "test"]
    assert sorted(held) == [1] * 4 + [2] * 4 + [3] * 4
    assert {x["split"] for x in choices.split_again(scenes, old.limit(0), "scene", "size", 0.0).collect()} == {"train"}


def test_rotated_slots(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a")]
    rows = [(i, list("abc") if i % 3 else ["a", "c"]) for i in range(40)] + [(99, [])]
    df = spark.createDataFrame(rows, "video long, free array<string>")
    got = {x["video"]: x["s"] for x in df.select("video", choices.rotated_slot(F.col("video"), pairs, F.col("free")).alias("s")).collect()}
    for video, free in rows:
        start = zlib.crc32(str(video).encode()) % 3
        fits = [p for p in (pairs[(start + i) % 3] for i in range(3)) if set(p) <= set(free)]
        assert (tuple(got[video]) if got[video] else None) == (fits[0] if fits else None)


def test_few_segments():
    assert tracks.drop_short([["a", 3], ["b", 1], ["a", 3], ["c", 8]], 4) == [["a", 6], ["c", 9]]
    assert tracks.drop_short([["b", 1], ["c", 3]], 2) == [["c", 4]] and tracks.drop_short([], 3) == []
    r = random.Random(1)
    labels = [r.choice("xyz") for _ in range(120)]
    out = tracks.few_segments(labels)
    assert len(out) == 120 and len(tracks.encode_runs(out)) <= 4
    assert tracks.few_segments(list("aaaabbbb"), 3, 2) == list("aaaabbbb") and tracks.few_segments([]) == []
    assert tracks.mode_filter(list("ab"), 3) == list("aa")


def test_cover_and_farthest_by_rounds(spark):
    r = random.Random(2)
    rows = [(g, c, e) for g in (1, 2) for c in range(8) for e in r.sample(range(20), 5)] + [(3, 1, None)]
    got = choices.covering(spark.createDataFrame(rows, "g int, c int, e int"), "g", "c", "e", 5, dedup.checkpointed).collect()
    for g in (1, 2):
        sets, seen, want = {c: {e for a, b, e in rows if (a, b) == (g, c)} for c in range(8)}, set(), []
        for _ in range(5):
            best = max(sets, key=lambda c: (len(sets[c] - seen), -c))
            if not sets[best] - seen:
                break
            want.append(best)
            seen |= sets[best]
        assert [x["c"] for x in sorted(got, key=lambda x: x["pick"]) if x["g"] == g] == want
    points = [(1, i, [float(x), 0.0]) for i, x in enumerate((0, 1, 10, 4))] + [(2, 0, [1.0, 1.0]), (2, 1, [1.0, 1.0]), (3, 0, None)]
    far = choices.far_apart(spark.createDataFrame(points, "g int, i int, v array<double>"), "g", "i", "v", 3, metrics.distance).collect()
    assert sorted((x["g"], x["pick"], x["i"]) for x in far) == [(1, 0, 0), (1, 1, 2), (1, 2, 3), (2, 0, 0)]


def test_frechet_distance(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, v = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), dtype=float)
    a, b = v[ids % 2 == 0], v[ids % 2 == 1]
    want = metrics.frechet((a.mean(0), np.cov(a.T)), (b.mean(0), np.cov(b.T)))
    assert abs(registry.queries()["frechet_distance"](spark, SF).first()[0] - want) < 1e-6


def _vectors(spark, n, seed):
    v = np.random.default_rng(seed).integers(-2, 3, size=(n, 4)).astype(float) + 0.5
    rows = [(i, [float(x) for x in v[i]], i % 3, i) for i in range(n)]
    return v, spark.createDataFrame(rows, "id long, v array<double>, label int, pos long").withColumn("chunk", F.floor(F.col("pos") / 30).cast("long"))


def _distance(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))


def test_set_metrics_by_tiles_are_those_of_whole_chunks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "TILE", 7)
    (a, real), (b, fake) = _vectors(spark, 62, 1), _vectors(spark, 58, 2)
    radius = {r["id"]: r["radius"] for r in metrics.radii(real, "chunk", "id", "v", 3).collect()}
    got = {r["chunk"]: r for r in metrics.prdc(real, fake, "chunk", "id", "v", 3).collect()}
    for c, (lo, hi, end) in {0: (0, 30, 30), 1: (30, 60, 58)}.items():
        ra, rb = np.sort(_distance(a[lo:hi], a[lo:hi]))[:, 3], np.sort(_distance(b[lo:end], b[lo:end]))[:, 3]
        assert [radius[i] for i in range(lo, hi)] == list(ra)
        d = _distance(a[lo : lo + len(rb)], b[lo:end])  # rows without a partner drop out
        ra = ra[: len(rb)]
        want = [(d < ra[:, None]).any(axis=0).mean(), (d < rb[:, None]).any(axis=1).mean(), (d < ra[:, None]).sum(axis=0).mean() / 3, (d < ra[:, None]).any(axis=1).mean()]
        assert np.allclose([got[c][x] for x in ("precision", "recall", "density", "coverage")], want)
    assert set(radius) == set(range(60)) and set(got) == {0, 1}  # the last chunk has two rows, so no radius


@pytest.mark.parametrize("label", [None, "label"])
def test_retrieval_over_all_candidates(spark, label, monkeypatch):
    monkeypatch.setattr(metrics, "TILE", 9)
    (a, left), (b, right) = _vectors(spark, 40, 3), _vectors(spark, 25, 4)
    got = {r["direction"]: r for r in metrics.retrieval(left, right, "id", "v", label).collect()}
    cosine = (a @ b.T) / np.sqrt((a**2).sum(1)[:, None] * (b**2).sum(1)[None])
    same = np.arange(40)[:, None] == np.arange(25)[None]
    if label:
        same |= np.arange(40)[:, None] % 3 == np.arange(25)[None] % 3
    for name, s, own in (("there", cosine, same), ("back", cosine.T, same.T)):
        has = own.any(axis=1)
        best = np.where(own, s, -9).max(axis=1)[has, None]
        rank = (s[has] > best + 1e-12).sum(axis=1) + (np.isclose(s[has], best, atol=1e-12).sum(axis=1) - 1) / 2
        assert got[name]["queries"] == has.sum() and got[name]["median_rank"] == np.median(rank) + 1
        assert np.allclose([got[name][f"r{k}"] for k in (1, 2, 3, 5, 10)], [round(100 * (rank < k).mean(), 2) for k in (1, 2, 3, 5, 10)])


def test_bootstrap_interval(spark):
    r = np.random.default_rng(3)
    d = r.normal(0.3, 1, 200)
    got = metrics.bootstrap(spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)], "k long, d double"), "k", "d", 2000).first()
    means = np.array([d[r.integers(0, 200, 200)].mean() for _ in range(4000)])
    low, high = np.percentile(means, [2.5, 97.5])
    assert abs(got["low"] - low) < 0.03 and abs(got["high"] - high) < 0.03 and got["star"] == (low > 0 or high < 0)


def test_missing_values_pass(spark):
    df = spark.createDataFrame([(0.05,), (0.07,), (None,), (float("nan"),)], "t double")
    assert [x[0] for x in df.select(rules.passes(["t <= 0.06"])).collect()] == [True, False, True, True]
    assert [x[0] for x in df.select(rules.passes(["t >= 0.06"])).collect()] == [False, True, True, True]
    with pytest.raises(ValueError):
        rules.passes(["t is null"])


def test_places_and_components(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in (3, 1, 2, 2)] + [(2, None)], "k int, x double")
    got = aggregates.at_places(rows, ["k"], "x", {"low": aggregates.nearest_rank(0.1), "m": aggregates.upper_median}).collect()
    assert [tuple(x) for x in got] == [(1, 1.0, 2.0)]
    edges = [(i, i + 1) for i in range(70)] + [(100, 101)]
    found = {x["node"]: x["component"] for x in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(71)} | {100: 100, 101: 100}
    assert dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tracks_that_share_few_cells_are_pairs_too(spark, tmp_path):
    # 1 and 2 share one cell of 19; 3 shares none with them, though it would modulo 40; 4 is of another nation
    lines = [(1, p, 10.0) for p in range(10)] + [(2, p, 50.0) for p in range(9, 19)] + [(3, p, 50.0) for p in range(40, 50)] + [(4, p, 50.0) for p in range(10)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(x) for x in registry.queries()["track_overlaps"](spark, str(tmp_path)).collect()] == [(7, 1, 2, round(1 / 19, 6))]


def test_intervals_and_neighbours(spark):
    a = spark.createDataFrame([(1, 0.0, 5.0), (1, 9.0, 30.0), (2, 0.0, 1.0)], "k int, start double, end double")
    w = spark.createDataFrame([(1, 4.0, 10.0), (1, 31.0, 32.0), (2, 1.0, 2.0)], "k int, from double, until double")
    assert sorted((x["start"], x["from"]) for x in relations.overlapping(a, w, "k", 3.0).collect()) == [(0.0, 4.0), (9.0, 4.0)]
    p = spark.createDataFrame([(1, 0.0), (1, 9.0)], "g int, x double")
    assert sorted((x["x"], x["distance"]) for x in relations.nearest(p, spark.createDataFrame([(1, 1.5), (2, 0.0)], "g int, x double"), "g", "x", 2.0).collect()) == [(0.0, 1.5), (9.0, None)]
    with pytest.raises(ValueError):
        relations.concatenated({"a": a, "w": w})


@pytest.mark.parametrize(("n", "window", "degree"), [(30, 11, 3), (9, 11, 3), (5, 11, 3), (4, 11, 3), (1, 11, 3), (12, 4, 2), (7, 3, 3)])
def test_smoothing_fits_polynomials_up_to_the_ends(spark, n, window, degree):
    v = np.random.default_rng(n).normal(size=n).cumsum()
    got = [x["smooth"] for x in tracks.smoothed(spark.createDataFrame([("e", i, float(x)) for i, x in enumerate(v)], "e string, i int, v double"), "e", ["i"], "v", window, degree).orderBy("i").collect()]
    w = min(window + 1 - window % 2, n - 1 + n % 2)
    want = list(v)
    if w >= degree + 2:
        for i in range(n):
            lo = min(max(i - w // 2, 0), n - w)
            want[i] = np.polyval(np.polyfit(np.arange(w), v[lo : lo + w], degree), i - lo)
    assert np.allclose(got, want, atol=1e-8)


def test_small_functions(spark):
    one = spark.range(1)
    row = one.select(
        filters.label_tokens(F.lit("WallInner.022")).alias("tokens"), captions.flipped(F.lit("left of upright, up")).alias("flip"), captions.nouns(F.lit("A red car in the old garages, with two berries beside the bus: walking into the meeting of a glass, is the car")).alias("nouns"),
        captions.shortened(F.lit("one two, three"), 8).alias("short"), captions.redacted(F.lit("The 3.5 cats"), ["cats"]).alias("red"), measures.box_distance(*[F.lit(float(x)) for x in (3, 0, 0, 0, 90, 2, 2)]).alias("d"), captions.content_words(F.lit("the the"), ["the"], "it").alias("c"),
    ).first()
    assert row["tokens"] == ["wall", "inner"] and row["flip"] == "right of upright, down" and row["nouns"] == ["car", "garage", "berry"]
    assert row["short"] == "one two" and row["red"] == "The # [removed]" and abs(row["d"] - 2) < 1e-9 and row["c"] == "it"
