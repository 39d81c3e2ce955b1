"""Boxes, gates, polygons and nearest neighbours against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.functions import boxes as B
from viaduct.functions import polygons as P
from viaduct.operators import boxes, proximity


def floats(v):
    return [float(x) for x in v]


def test_boxes_have_least_area_over_all_turns(spark, monkeypatch):
    monkeypatch.setattr(boxes, "BLOCK", 40)
    r = np.random.default_rng(3)
    nodes = {1: r.normal(size=(300, 3)) * [4, 1, 2], 2: np.array([[0, 0, 0], [2, 0, 1], [0, 1, 5], [2, 1, 1.0]]), 3: np.array([[0, 0, 0], [1, 1, 0], [2, 2, 0], [3, 3, 1.0]]), 4: np.ones((5, 3)), 5: np.zeros((2, 3)), 6: r.normal(size=(60, 3))}
    turn = np.array([[np.cos(0.7), -np.sin(0.7)], [np.sin(0.7), np.cos(0.7)]])
    nodes[1][:, :2] = nodes[1][:, :2] @ turn.T + 5
    rows = [(n, *floats(p)) for n, ps in nodes.items() for p in ps] + [(2, None, 0.0, 0.0), (2, float("nan"), 9.0, 0.0), (7, None, None, None)]
    got = {x["node"]: x for x in boxes.fitted(spark.createDataFrame(rows, "node int, x double, y double, z double"), "node").collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    for n, g in got.items():
        p, c, e, yaw = nodes[n], np.array(g["centre"]), g["extent"], g["yaw"]
        own = (p[:, :2] - c[:2]) @ np.array([[np.cos(yaw), -np.sin(yaw)], [np.sin(yaw), np.cos(yaw)]])
        assert g["n"] == len(p) and (np.abs(own) <= np.array(e[:2]) / 2 + 1e-9).all() and e[0] >= e[1] and -np.pi / 2 < yaw <= np.pi / 2 + 1e-12
        assert np.isclose(e[2], np.ptp(p[:, 2])) and np.isclose(c[2], (p[:, 2].min() + p[:, 2].max()) / 2)
        areas = [np.prod(np.ptp(p[:, :2] @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]), axis=0)) for a in np.linspace(0, np.pi / 2, 2000)]
        assert e[0] * e[1] <= min(areas) + 1e-9
    assert np.allclose(got[3]["extent"], [np.sqrt(18), 0, 1], atol=1e-9) and np.isclose(got[3]["yaw"], np.pi / 4) and got[4]["extent"] == [0, 0, 0]


def plain_distance(p, c, e, yaw):
    turn = np.array([[np.cos(yaw), np.sin(yaw), 0], [-np.sin(yaw), np.cos(yaw), 0], [0, 0, 1]])
    d = np.abs(turn @ (np.array(p) - c)) - np.array(e) / 2
    return np.linalg.norm(np.maximum(d, 0)) + min(d.max(), 0)


def test_box_distances_corners_and_widths(spark):
    r = np.random.default_rng(5)
    rows = [(floats(r.normal(size=3) * 2), floats(r.normal(size=3)), floats(r.uniform(0.1, 3, 3)), float(r.uniform(-3, 3))) for _ in range(60)] + [([0.0] * 3, [0.0] * 3, [2.0, 4.0, 6.0], 0.0)]
    df = spark.createDataFrame(rows, "p array<double>, c array<double>, e array<double>, yaw double")
    out = df.select("*", B.signed_distance(*map(F.col, ("p", "c", "e", "yaw"))).alias("d"), B.corners(*map(F.col, ("c", "e", "yaw"))).alias("k"), B.half_width(F.array(F.lit(0.6), F.lit(0.0), F.lit(0.8)), F.col("e"), F.col("yaw")).alias("h"), boxes.nearest_face(*map(F.col, ("p", "c", "e", "yaw"))).alias("f"))
    for x in out.collect():
        assert np.isclose(x["d"], plain_distance(x["p"], x["c"], x["e"], x["yaw"]))
        k = np.array(x["k"])
        assert all(abs(plain_distance(q, x["c"], x["e"], x["yaw"])) < 1e-9 for q in k) and len({tuple(np.round(q, 9)) for q in k}) == 8
        assert np.isclose(x["h"], np.ptp(k @ [0.6, 0, 0.8]) / 2)
    assert x["d"] == -1.0 and x["f"] == "x"


def test_gates_name_every_reason(spark):
    b = spark.createDataFrame([("s", 1, [0.0, 10.0, 1.0], [2.0, 2.0, 2.0], 0.0, 0.0), ("s", 2, [5.0, 0.0, 1.0], [1.0, 1.0, 2.0], 0.5, 0.4)], "scene string, node int, centre array<double>, extent array<double>, yaw double, margin double")
    walks = {"ahead": [(0, t, 1) for t in range(0, 8)], "through": [(0, t, 1) for t in range(0, 14)], "over": [(0, 0, 1), (0, 10, 9)], "under": [(0, 0, 1), (0, 0, -1)], "inside": [(0, 10, 1)]}
    frames = spark.createDataFrame([("s", n, i, floats(p)) for n, ps in walks.items() for i, p in enumerate(ps)], "scene string, clip string, frame int, position array<double>")
    subject = frames.select("clip").distinct().crossJoin(b.where("node = 1").select("centre", "extent", "yaw"))
    clear = boxes.clearance(frames, b, "scene", "clip", "frame", "node", "margin")
    for x in clear.join(frames, ["scene", "clip", "frame"]).collect():
        both = [(plain_distance(x["position"], c, e, yaw) - m, n) for n, c, e, yaw, m in ((1, [0, 10, 1], [2, 2, 2], 0.0, 0.0), (2, [5, 0, 1], [1, 1, 2], 0.5, 0.4))]
        assert x["node"] == min(both)[1] and np.isclose(x["slack"], min(both)[0]) and np.isclose(x["clearance"], min(both)[0] + (0.4 if min(both)[1] == 2 else 0))
    got = {x["clip"]: x for x in boxes.gated(clear, boxes.profiles(frames, subject, "clip", "frame", F.lit(0.0)), "clip", "frame", 0.1, 60.0, 0.2, 0.5).collect()}
    assert {n: got[n]["reasons"] for n in walks} == {"ahead": [], "through": ["obb", "approach"], "over": ["elev", "approach"], "under": ["ground"], "inside": ["obb", "approach"]}
    assert np.isclose(got["ahead"]["gap"], 2.0) and np.isclose(got["through"]["gap"], -4.0) and got["inside"]["gap"] is None


def plain_clip(poly, clip):
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1], strict=True):
        out = []
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        for q, p in zip(poly[-1:] + poly[:-1], poly, strict=True):
            s, t = side(q), side(p)
            if (s >= 0) != (t >= 0):
                out.append((q[0] + s / (s - t) * (p[0] - q[0]), q[1] + s / (s - t) * (p[1] - q[1])))
            if t >= 0:
                out.append(p)
        poly = out
    return poly


def test_polygons_are_clipped(spark):
    r = np.random.default_rng(9)
    box = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    tri = [(0.0, 0.0), (5.0, 1.0), (1.0, 4.0)]
    polys = [[tuple(floats(p)) for p in r.uniform(-3, 7, (n, 2))] for n in (3, 4, 5, 7) for _ in range(8)] + [[(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)], [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)], [], box, box[::-1], [(0.0, 0.0)]]
    rows = [(i, p, c) for i, p in enumerate(polys) for c in (box, tri)] + [(-1, None, box), (-2, box, None)]
    df = spark.createDataFrame(rows, f"i int, p {P.POLYGON}, c {P.POLYGON}")
    for x in df.select("*", P.clipped(F.col("p"), F.col("c")).alias("k"), P.signed_area(F.col("p")).alias("a")).collect():
        if x["i"] < 0:
            assert x["k"] is None
            continue
        want = plain_clip([tuple(q) for q in x["p"]], [tuple(q) for q in x["c"]])
        assert len(x["k"]) == len(want) and np.allclose(np.array([tuple(q) for q in x["k"]]).reshape(-1, 2), np.array(want).reshape(-1, 2))
        if x["p"] == df.where("i = 35").first()["p"]:
            assert x["a"] == 12.0
    whole = df.limit(1).select(P.clipped(P.rectangle(4.0, 3.0), P.rectangle(F.lit(2.0), 9.0)).alias("k")).select(P.signed_area(F.col("k")).alias("a")).first()["a"]
    assert whole == 6.0


def plain_nearest(queries, points, k, others):
    out = set()
    for s, q, *v in queries:
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)))), p) for t, p, *w in points if t == s and not (others and p == q))
        out |= {(s, q, p, rank, round(d, 5)) for rank, (d, p) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize(("k", "others"), [(1, False), (4, False), (3, True)])
def test_nearest_is_exact_at_any_distance(spark, k, others):
    r = np.random.default_rng(11)
    points = [(1, i, *floats(v)) for i, v in enumerate(r.normal(size=(150, 3)))] + [(1, 200 + i, *floats(v)) for i, v in enumerate(50 + 0.01 * r.normal(size=(60, 3)))]
    points += [(1, 300 + i, 7.0, 7.0, 7.0) for i in range(40)] + [(2, i, 0.0, 0.0, 0.0) for i in range(5)] + [(3, 1, 1.0, 2.0, 3.0), (5, 1, float(10**9), 0.0, 0.0), (5, 2, 0.0, 0.0, 0.0), (5, 3, 1e-6, 0.0, 0.0)]
    queries = points if others else [(1, i, *floats(v)) for i, v in enumerate(r.uniform(-20, 70, (40, 3)))] + [(1, 900, 1e6, -1e6, 0.0), (1, 901, 7.0, 7.0, 7.0), (2, 1, 5.0, 5.0, 5.0), (3, 9, 0.0, 0.0, 0.0), (4, 1, 0.0, 0.0, 0.0), (5, 7, 0.5, 0.0, 0.0)]
    name = "point" if others else "query"
    pdf = spark.createDataFrame([*points, (1, 999, None, 0.0, 0.0)], "scene int, point long, x double, y double, z double")
    qdf = pdf if others else spark.createDataFrame(queries, "scene int, query long, x double, y double, z double")
    got = proximity.nearest(qdf, pdf, "scene", name, "point", k, others)
    near = "point_near" if others else "point"
    assert {(x["scene"], x[name], x[near], x["rank"], round(x["distance"], 5)) for x in got.collect()} == plain_nearest(queries, points, k, others)


def test_sparse_points_and_empty_clouds(spark):
    r = np.random.default_rng(2)
    points = [(1, i, *floats(v)) for i, v in enumerate(r.uniform(0, 5, (120, 3)))] + [(2, 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(points, "scene int, point long, x double, y double, z double")
    got = {(x["scene"], x["point"]): x["outlier"] for x in proximity.sparse(df, "scene", "point", 1.0, 3).collect()}
    for s, p, *v in points:
        assert got[s, p] == (sum(np.linalg.norm(np.subtract(v, w)) <= 1.0 for t, q, *w in points if t == s and q != p) < 3)
    assert proximity.nearest(df.limit(0).withColumnRenamed("point", "query"), df, "scene", "query", "point", 2).count() == 0
    assert proximity.nearest(df.withColumnRenamed("point", "query"), df.limit(0), "scene", "query", "point", 2).count() == 0
