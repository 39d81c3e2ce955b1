"""Planes, rotations, solvers, views, nested documents and spectra against plain loops."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.functions import nested
from viaduct.functions import rotations as R
from viaduct.operators import choices, covisibility, planes, solvers, spectra
from viaduct.operators.dedup import checkpointed


def draw(*key):
    return hashlib.md5("|".join(map(str, key)).encode()).hexdigest()


def plain_planes(points, seed, count, threshold):
    """points: {scene: [(id, x, y, z)]}; the best triple's plane, refitted by singular values."""
    out = {}
    for scene, rows in points.items():
        rows = sorted(rows, key=lambda r: (draw(seed, r[0]), *r))
        p, best = np.array([r[1:] for r in rows], dtype=float), None
        n = len(p)
        for h in range(count if n >= 3 else 0):
            r = [int(draw(seed, scene, h, i)[:14], 16) for i in range(3)]
            a = r[0] % n
            b = (a + 1 + r[1] % (n - 1)) % n
            c = [i for i in range(n) if i not in (a, b)][r[2] % (n - 2)]
            normal = np.cross(p[b] - p[a], p[c] - p[a])
            size = np.linalg.norm(normal)
            if size >= 1e-9:
                inside = np.abs(p @ (normal / size) - normal / size @ p[a]) < threshold
                best = inside if best is None or inside.sum() > best.sum() else best
        if best is not None:
            mean = p[best].mean(axis=0)
            normal = np.linalg.svd(p[best] - mean, full_matrices=False)[2][-1]
            normal = normal * np.sign(normal[np.abs(normal).argmax()])
            out[scene] = (*normal, -normal @ mean, int((np.abs(p @ normal - normal @ mean) < threshold).sum()))
    return out


def cloud():
    r = np.random.default_rng(4)
    flat = lambda n, normal, d, wide: [(x, y, (d - normal[0] * x - normal[1] * y) / normal[2] + e) for x, y, e in zip(r.uniform(-wide, wide, n), r.uniform(-wide, wide, n), r.normal(0, 0.01, n), strict=True)]
    scenes = {1: flat(300, (0.1, 0.2, 1), 3, 5) + list(map(tuple, r.uniform(-5, 5, (150, 3)))), 2: flat(40, (1, 0, 0.2), 1, 2), 3: [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 3)], 4: [(0, 0, 0), (1, 0, 0)], 5: [(0, 0, 0)] * 9}
    scenes[6] = flat(200, (1, 0.1, 0.02), 2, 1) + flat(200, (0.1, 1, 0.02), -4, 1) + flat(300, (0, 0, 1), 0, 3)
    return {s: [(i, *map(float, v)) for i, v in enumerate(rows)] for s, rows in scenes.items()}


def test_planes_are_those_of_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(planes, "BLOCK", 64)
    points = cloud()
    rows = [(s, *r) for s, rs in points.items() for r in rs] + [(1, 9999, None, 0.0, 0.0), (1, 9998, float("nan"), 0.0, 0.0), (7, 1, None, None, None)]
    df = planes.usable(spark.createDataFrame(rows, "scene int, id long, x double, y double, z double"), "scene", "id", ("x", "y", "z"))
    got = {r["scene"]: r for r in planes.plane(df, "scene", "id", 0.05, 40, "plane").collect()}
    want = plain_planes(points, "plane", 40, 0.05)
    assert set(got) == set(want) == {1, 2, 6}
    for s, w in want.items():
        assert np.allclose([got[s][c] for c in ("nx", "ny", "nz", "d")], w[:4], atol=1e-9) and got[s]["inliers"] == w[4]
    assert planes.plane(df.limit(0), "scene", "id", 0.05, 40).count() == 0


def test_walls_are_peeled_off(spark):
    points = cloud()
    df = planes.usable(spark.createDataFrame([(s, *r) for s, rs in points.items() for r in rs], "scene int, id long, x double, y double, z double"), "scene", "id", ("x", "y", "z"))
    got = sorted((r["scene"], r["round"], round(r["nx"], 6), round(r["d"], 6), r["inliers"]) for r in planes.walls(df, "scene", "id", 0.05, most=2, count=30, least=60).collect())
    want = []
    for s, rows in points.items():
        left, found = rows, 0
        for i in range(4):
            if len(left) < 60 or found >= 2 or not (fit := plain_planes({s: left}, f"walls{i}", 30, 0.05)):
                break
            x, y, z, d, n = fit[s]
            if n / len(left) >= 0.05 and abs(z) < 0.3:
                want.append((s, i, round(x, 6), round(d, 6), n))
                found += 1
            left = [r for r in left if abs(r[1] * x + r[2] * y + r[3] * z + d) >= 0.05]
    assert got == sorted(want) and {w[0] for w in want} >= {6}


def vectors():
    r = np.random.default_rng(6)
    v = list(r.normal(size=(60, 3)) * 1.5) + [np.zeros(3), np.array([1e-9, 0, 0]), np.array([np.pi, 0, 0]), np.array([0, -np.pi, 0]), np.array([0, 0, np.pi - 1e-9]), np.array([4.0, 0, 0]), np.array([0, 2 * np.pi, 0])]
    return [[float(x) for x in a] for a in v]


def rodrigues(v):
    v = np.asarray(v)
    n = np.linalg.norm(v)
    if not n:
        return np.eye(3)
    x, y, z = v / n
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(n) * k + (1 - np.cos(n)) * k @ k


def test_rotation_forms_go_round(spark):
    df = spark.createDataFrame(list(enumerate(vectors())) + [(99, None)], "i int, v array<double>")
    m = df.withColumn("m", R.from_vector(F.col("v")))
    rows = m.select("i", "v", "m", R.vector_of(F.col("m")).alias("back"), R.matrix_of(R.quaternion(F.col("m"))).alias("q"), R.from_six(R.six(F.col("m"))).alias("six"), R.nearest_rotation(F.transform("m", lambda x: 3 * x)).alias("near"), R.angle(F.col("m"), R.array(1, 0, 0, 0, 1, 0, 0, 0, 1)).alias("deg")).collect()
    for r in rows:
        if r["i"] == 99:
            assert all(r[c] is None for c in ("m", "back", "q", "six", "near", "deg"))
            continue
        want, n = rodrigues(r["v"]), np.linalg.norm(r["v"])
        for c in ("m", "q", "six", "near"):
            assert np.allclose(np.reshape(r[c], (3, 3)), want, atol=1e-9), (c, r)
        assert np.allclose(rodrigues(r["back"]), want, atol=1e-9) and np.linalg.norm(r["back"]) <= np.pi + 1e-12
        assert abs(r["deg"] - np.degrees(min(n % (2 * np.pi), 2 * np.pi - n % (2 * np.pi)))) < 1e-6
        if 0 < n < np.pi - 1e-3:
            assert np.allclose(r["back"], r["v"], atol=1e-9)
    at_half = {r["i"]: r["back"] for r in rows}
    assert np.allclose(at_half[62], [np.pi, 0, 0]) and np.allclose(at_half[63], [0, np.pi, 0])


def test_nearest_rotation_is_one_and_nearest(spark):
    r = np.random.default_rng(2)
    ms = [r.normal(size=(3, 3)) for _ in range(30)]
    df = spark.createDataFrame([([float(x) for x in m.ravel()],) for m in ms] + [(None,), ([float("nan")] * 9,)], "m array<double>")
    got = df.select(R.nearest_rotation("m").alias("r"), R.from_six(R.array(1, 0, 0, 2, 0, 0)).alias("flat")).collect()
    assert got[-1]["r"] is None and got[-2]["r"] is None and got[0]["flat"] is None
    for m, g in zip(ms, got, strict=False):
        q = np.reshape(g["r"], (3, 3))
        assert np.allclose(q @ q.T, np.eye(3)) and np.isclose(np.linalg.det(q), 1)
        others = [rodrigues(r.normal(size=3) * s) @ q for s in (0.01, 0.1, 1) for _ in range(20)]
        assert all(np.linalg.norm(m - q) <= np.linalg.norm(m - o) + 1e-12 for o in others)


def test_paths_resampled_and_anchored(spark):
    vs = vectors()[:12]
    poses = [np.column_stack([rodrigues(v), np.array([i, i * i, -i])]) for i, v in enumerate(vs)]
    rows = [("a", i, [float(x) for x in p.ravel()]) for i, p in enumerate(poses)] + [("one", 0, [float(x) for x in poses[3].ravel()])]
    df = spark.createDataFrame(rows, "clip string, frame long, pose array<double>")
    got = {(r["clip"], r["frame"]): np.reshape(r["pose"], (3, 4)) for r in R.resampled(df, "clip", "frame", "pose", 23).collect()}
    assert len(got) == 46 and all(np.allclose(got["one", j], poses[3]) for j in range(23))
    for j in range(23):
        i, s = divmod(j * 11 / 22, 1)
        a, b = poses[int(i)], poses[min(int(i) + 1, 11)]
        turn = b[:, :3] @ a[:, :3].T
        angle = np.arccos(np.clip((np.trace(turn) - 1) / 2, -1, 1))
        axis = np.array([turn[2, 1] - turn[1, 2], turn[0, 2] - turn[2, 0], turn[1, 0] - turn[0, 1]])
        axis = axis / np.linalg.norm(axis) if angle > 1e-9 else axis
        assert np.allclose(got["a", j][:, :3], rodrigues(axis * angle * s) @ a[:, :3], atol=1e-8) and np.allclose(got["a", j][:, 3], (1 - s) * a[:, 3] + s * b[:, 3])
    index = {r["frame"]: r["pose"] for r in R.resampled(df.where("clip = 'a'"), "clip", "frame", "pose", 9, "index").collect()}
    assert all(np.allclose(index[j], poses[int(np.rint(j * 11 / 8))].ravel()) for j in range(9))
    four = lambda p: np.vstack([p, [0, 0, 0, 1]])
    for r in R.anchored(df.where("clip = 'a'"), "clip", "frame", "pose").collect():
        assert np.allclose(four(np.reshape(r["pose"], (3, 4))), np.linalg.inv(four(poses[0])) @ four(poses[r["frame"]]))


def test_bisection_finds_the_last_knob_within_budget(spark):
    limits = {1: 0.3, 2: 1.7, 3: 5.0, 4: -1.0, 5: 0.0}
    variants = spark.createDataFrame([(k, 0.0, 2.0) for k in [*limits, 6]], "k int, low double, high double")
    table = spark.createDataFrame(list(limits.items()), "k int, most double")

    def probe(at):
        return at.join(table, "k").groupBy("k").agg(solvers.binding(("size", F.max(F.col("knob") > F.col("most"))), ("never", F.lit(None).cast("boolean"))).alias("binding"))

    got = {r["k"]: r for r in solvers.largest_knob(variants, "k", "low", "high", probe, 20).collect()}
    assert (got[3]["status"], got[3]["knob"], got[3]["binding"]) == ("ceiling", 2.0, None) and got[6]["status"] == "ceiling"
    assert (got[4]["status"], got[4]["knob"], got[4]["binding"]) == ("floor", None, "size")
    for k in (1, 2, 5):
        assert got[k]["status"] == "solved" and got[k]["binding"] == "size" and limits[k] - 2 * 2**-20 <= got[k]["knob"] <= limits[k]


def test_knobs_are_recovered_within_their_rounding(spark):
    truth = {1: 0.123456, 2: 0.999994999, 3: 2.0, 4: 0.5}
    variants = spark.createDataFrame([(k, round(v, 5)) for k, v in truth.items()], "k int, r double")
    known = spark.createDataFrame([(k, v if k < 4 else 9.0) for k, v in truth.items()], "k int, v double")
    error = lambda t: t.join(known, "k").select("k", "trial", F.abs(F.col("knob") - F.col("v")).alias("error"))
    got = {r["k"]: r for r in solvers.recovered_knob(variants, "k", "r", error, 1e-7, steps=50).collect()}
    assert got[4]["knob"] is None and got[3]["knob"] == 2.0
    assert all(abs(got[k]["knob"] - truth[k]) <= 1e-7 and abs(got[k]["knob"] - round(truth[k], 5)) <= 0.5e-5 + 1e-12 for k in (1, 2, 3))


def test_nested_documents_are_scrubbed_at_any_depth(spark):
    deep = {"focus_ids": ["Window", "book", "cup_01"]}
    for i in range(200):
        deep = {"x": [deep, {"primary": "window", "n": i}]} if i % 2 else [deep]
    clean = '{ "focus_ids" : ["cup_01", "sofa"],  "focus": ["window"] }'
    rows = [(1, json.dumps(deep)), (2, clean), (3, None), (4, "no json"), (5, '{"focus_ids": "window", "primary": ["window"], "é": ["ü"]}'), (6, '{"focus_ids": ["window", 7, null, ["window"]]}'), (7, "[" * 100_000)]
    df = spark.createDataFrame(rows, "i int, d string")
    lists = F.array(F.lit("cup_01"), F.lit("book_left_01")), F.array(*map(F.lit, ("window", "book_left_01", "cup_01", "floor")))
    got = {r["i"]: r["s"] for r in df.select("i", nested.scrub(F.col("d"), *lists, ["focus_ids"], ["primary"]).alias("s")).collect()}
    assert got[1]["removed"] == {"Window": 1} and got[1]["kept"] == {"primary=window": 100}
    assert json.loads(got[1]["document"]) == json.loads(json.dumps(deep).replace('"Window", ', ""))
    for i in (2, 3, 4, 5, 7):  # nothing to take out: as it was, byte for byte
        assert got[i]["document"] == rows[i - 1][1] and not got[i]["removed"]
    assert got[6]["document"] == '{"focus_ids":[7,null,["window"]]}' and got[6]["removed"] == {"window": 1}
    none = df.select("i", nested.scrub(F.col("d"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), ["focus_ids"], []).alias("s"))
    assert all(not r["s"]["removed"] for r in none.collect())


def plain_views(views, segments, radius, degrees, score, k):
    out = {}
    for scene, segment, first, last in segments:
        own = views[scene]
        c, f = own[first]["centre"], own[first]["forward"]
        scale = np.mean([np.linalg.norm(own[i]["centre"] - c) for i in range(first, last)])
        if scale < 1e-6:
            continue
        x = c + max((np.mean([v["centre"] for v in own], axis=0) - c) @ f, 0.5 * scale) * f
        found = []
        for j, v in enumerate(own):
            to = x - v["centre"]
            w = to @ v["forward"]
            if first <= j < last or np.linalg.norm(v["centre"] - c) > radius * scale or f @ v["forward"] < np.cos(np.radians(degrees)) or w <= 1e-6:
                continue
            if not (0 <= to @ v["right"] / w + 1 < 2 and 0 <= to @ v["down"] / w + 1 < 2):
                continue
            a, b = c - x, v["centre"] - x
            angle = np.degrees(np.arccos(np.clip(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-9), -1, 1)))
            found.append((-score(angle), j, b / np.linalg.norm(b)))
        found.sort(key=lambda t: t[:2])
        picks = found[:1]
        while 0 < len(picks) < min(k, len(found)):
            rest = [t for t in found if all(t[1] != p[1] for p in picks)]
            picks.append(max(rest, key=lambda t: (min(np.linalg.norm(t[2] - p[2]) for p in picks), -t[0], -t[1])))
        out[scene, segment] = [p[1] for p in picks]
    return out


def test_covisible_views_are_those_of_a_plain_loop(spark):
    r = np.random.default_rng(8)
    views = {}
    for scene, (n, wide) in {1: (120, 3.0), 2: (60, 40.0), 3: (20, 0.0)}.items():
        views[scene] = []
        for _ in range(n):
            f = np.array([1.0, *r.normal(0, 0.5, 2)])
            f /= np.linalg.norm(f)
            right = np.cross(f, [0, 0, 1.0])
            right /= np.linalg.norm(right)
            views[scene].append({"centre": r.normal(size=3) * wide, "forward": f, "right": right, "down": np.cross(f, right)})
    segments = [(1, 0, 0, 20), (1, 1, 20, 22), (1, 2, 100, 120), (2, 0, 5, 30), (3, 0, 0, 9)]
    fields = ("centre", "right", "down", "forward")
    rows = [(s, i, *[[float(x) for x in v[c]] for c in fields]) for s, vs in views.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "scene int, view long, centre array<double>, right array<double>, down array<double>, forward array<double>")
    seg = spark.createDataFrame(segments, "scene int, segment int, first long, last long")
    seen = covisibility.sights(df, seg, "scene", "view", "segment")
    found = checkpointed(covisibility.candidates(df, seen, "scene", "view", "segment", 1.5, 60.0, (1.0, 1.0, 1.0, 1.0, 2.0, 2.0), lambda a: F.exp(-((a - 10) ** 2) / 50)))
    got = {}
    for x in sorted(covisibility.spread(found, "scene", "segment", "view", 4, checkpointed).collect(), key=lambda x: x["pick"]):
        got.setdefault((x["scene"], x["segment"]), []).append(x["view"])
    want = plain_views(views, segments, 1.5, 60.0, lambda a: np.exp(-((a - 10) ** 2) / 50), 4)
    assert got == {k: v for k, v in want.items() if v} and (3, 0) not in want and len(got) >= 3


def test_cover_is_padded_by_the_farthest(spark):
    rows = [("a", 1, 10), ("a", 1, 11), ("a", 2, 12), ("a", 3, 10), ("a", 4, 12), ("a", 5, 12), ("b", 1, 1), ("b", 2, 2)]
    cover = choices.covering(spark.createDataFrame(rows, "g string, c int, e int"), "g", "c", "e", 4, checkpointed)
    place = {("a", 1): 0.0, ("a", 2): 10.0, ("a", 3): 4.0, ("a", 4): 6.5, ("a", 5): 100.0, ("b", 1): 0.0, ("b", 2): 1.0}
    pool = spark.createDataFrame([(g, c, [x, 0.0]) for (g, c), x in place.items()], "g string, c int, v array<double>")
    got = sorted(tuple(r) for r in covisibility.padded(cover, pool, "g", "c", "v", 4, checkpointed).select("g", "pick", "c", "filled").collect())
    assert got == [("a", 0, 1, False), ("a", 1, 2, False), ("a", 2, 5, True), ("a", 3, 3, True), ("b", 0, 1, False), ("b", 1, 2, False)]


@pytest.mark.parametrize("k", [1, 2])
def test_spectra_are_those_of_singular_values(spark, k):
    r = np.random.default_rng(1)
    data = {1: r.normal(size=(50, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 7, 2: r.normal(size=(4, 3)), 3: np.ones((3, 2))}
    rows = [(g, [float(x) for x in v]) for g, m in data.items() for v in m] + [(1, None), (1, [1.0, None, 1.0, 1.0, 1.0]), (1, [float("inf")] * 5), (2, [1.0]), (2, []), (9, None)]
    df = spectra.regular(spark.createDataFrame(rows, "g int, v array<double>").repartition(3), "g", "v")
    found = spectra.spectrum(df, "g", "v", k)
    by = {x["g"]: x for x in found.collect()}
    assert set(by) == {1, 2, 3} and by[3]["share"] is None and by[3]["participation"] is None
    for g in (1, 2):
        m = data[g]
        c = m - m.mean(axis=0)
        s, v = np.linalg.svd(c, full_matrices=False)[1:]
        var = s**2 / len(m)
        assert by[g]["n"] == len(m) and np.isclose(by[g]["share"], var[:k].sum() / var.sum()) and np.isclose(by[g]["participation"], var.sum() ** 2 / (var**2).sum())
        assert np.allclose(by[g]["ratios"][: len(s)], s / s[0], atol=1e-6)
        v = v[:k] * np.sign(v[np.arange(k), np.abs(v[:k]).argmax(axis=1)])[:, None]
        got = sorted([x[f"pc{i + 1}"] for i in range(k)] for x in spectra.projected(df, found, "g", "v", k).where(F.col("g") == g).collect())
        assert np.allclose(got, sorted((c @ v.T).tolist()), atol=1e-9)
