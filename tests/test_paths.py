"""Path shapes, parked frames, projections, bins and sweeps against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.functions import rotations as R
from viaduct.operators import metrics, paths


def walks():
    r = np.random.default_rng(7)
    out = {"line": [(t, 2.0 * t, 0) for t in range(6)], "still": [(1, 1, 1)] * 4, "one": [(0, 0, 0)], "back": [(0, 0, 0), (1, 0, 0), (0, 0, 0)]}
    out["park"] = [(0, 0, 0), (5, 0, 0), (5.01, 0, 0), (9, 0, 0), (5, 0, 0), (5, 0.01, 0), (5, 0, 0)]
    return out | {f"r{i}": r.normal(size=(20, 3)).cumsum(axis=0).tolist() for i in range(3)}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(p, i, [float(x) for x in c]) for p, cs in walks().items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "path string, frame int, centre array<double>").repartition(5)


def test_shapes_of_paths(frames):
    got = {r["path"]: r for r in paths.shapes(frames, "path", "frame").collect()}
    for p, cs in walks().items():
        c, g = np.array(cs, dtype=float), got[p]
        length = np.linalg.norm(np.diff(c, axis=0), axis=1).sum()
        s = np.linalg.svd(c - c.mean(axis=0), compute_uv=False)
        assert np.isclose(g["length"], length) and np.isclose(g["reach"], np.linalg.norm(c - c[0], axis=1).max()) and np.isclose(g["chord"], np.linalg.norm(c[-1] - c[0]))
        assert (g["straightness"] is None) == (length <= 1e-9) and (g["ratio2"] is None) == (s[0] < 1e-12)
        if s[0] > 1e-9:
            assert abs(g["ratio2"] - (s[1] / s[0] if len(s) > 1 else 0)) < 1e-6 and abs(g["ratio3"] - (s[2] / s[0] if len(s) > 2 else 0)) < 1e-6
    total = paths.shape_summary(paths.shapes(frames, "path", "frame")).first()
    straight = [g["straightness"] for g in got.values() if g["straightness"] is not None]
    assert np.isclose(total["straightness_p50"], np.median(straight)) and np.isclose(total["straight_share"], np.mean(np.array(straight) > 0.99)) and total["paths"] == len(got)


def test_parked_frames(frames, monkeypatch):
    monkeypatch.setattr(metrics, "TILE", 4)
    got = {r["path"]: r for r in paths.parked(frames, "path", "frame", 0.05).collect()}
    for p, cs in walks().items():
        c = np.array(cs, dtype=float)
        extent = max(np.linalg.norm(a - b) for a in c for b in c)
        keys = [tuple(k) for k in np.rint(c / max(0.05 * extent, 1e-9)).astype(int)]
        big = min(set(keys), key=lambda k: (-keys.count(k), k))
        run = best = 0
        for k in keys:
            run = run + 1 if k == big else 0
            best = max(best, run)
        assert np.isclose(got[p]["extent"], extent) and (got[p]["n"], got[p]["run"]) == (len(c), best) and np.isclose(got[p]["share"], keys.count(big) / len(c))
    assert got["park"]["run"] == 3 and got["still"]["share"] == 1.0


def test_projection_and_angles(spark):
    r = np.random.default_rng(1)
    rows = [([float(x) for x in r.normal(size=3)], [float(x) for x in r.normal(size=3)]) for _ in range(20)] + [([0.0, 0.0, 0.0], [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "v array<double>, p array<double>")
    pose = R.pose_of(R.from_vector(F.col("v")), F.array(F.lit(0.1), F.lit(-0.2), F.lit(0.3)))
    out = df.select("*", pose.alias("m"), paths.projected(F.col("p"), pose, F.lit(50.0), F.lit(60.0), F.lit(7.0), F.lit(8.0)).alias("s"), paths.tau(F.col("p"), F.col("v"), F.lit(2.0)).alias("tau"), paths.view_angle(F.col("p"), F.col("v"), R.array(1, 2, 3)).alias("a"))
    for x in out.collect():
        m, p, v, t = np.reshape(x["m"], (3, 4)), np.array(x["p"]), np.array(x["v"]), np.array([1.0, 2, 3])
        c = m[:, :3] @ p + m[:, 3]
        assert np.isclose(x["s"]["z"], c[2]) and np.isclose(x["s"]["u"], 50 * c[0] / c[2] + 7) and np.isclose(x["s"]["v"], 60 * c[1] / c[2] + 8) and np.isclose(x["tau"], np.linalg.norm(p - v) / 2)
        want = np.degrees(np.arccos(np.clip((t - p) @ (t - v) / np.linalg.norm(t - p) / np.linalg.norm(t - v), -1, 1)))
        assert abs(x["a"] - want) < 1e-5


def test_bins_and_sweeps(spark):
    v = [1.0] * 6 + [2.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(x, float(i)) for i, x in enumerate(v)] + [(None, 0.0), (float("nan"), 0.0)], "v double, w double")
    got = [tuple(r) for r in paths.quantile_bins(df, "v", 4, ["w"]).orderBy("bin").collect()]
    assert got == [(1, 1.0, 2.75, 7, 3.0), (2, 2.75, 5.0, 3, 8.0)]
    assert paths.quantile_bins(df.where("v = 1"), "v", 4, ["w"]).count() == 0
    rows = paths.sweep(df.where("v IS NOT NULL AND NOT isnan(v)"), "w", 7.0, {"all": F.lit(True), "few": F.col("v") > 2, "none": F.col("v") > 9}, 2).collect()
    assert {r["filter"]: (r["kept"], round(r["p95"], 6), r["most"], round(r["above"], 6)) for r in rows} == {"all": (1.0, 8.55, 9.0, 0.2), "few": (0.3, 8.9, 9.0, round(2 / 3, 6))}
