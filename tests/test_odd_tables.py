"""Queries against their SQL on small tables with ties, half turns and borders, as larger tables have them."""

import datetime
import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from viaduct.functions import measures
from viaduct.operators import choices, metrics, proximity
from viaduct.plans import registry


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return tuple(plain(v) for v in x) if isinstance(x, (list, tuple)) else x


@pytest.fixture
def agrees(spark, tmp_path):
    """agrees(query, table=frame, ...): the query's rows on these tables, once they are those of its SQL."""

    def check(name, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for table, frame in tables.items():
            frame.to_parquet(tmp_path / f"{table}.parquet", index=False, coerce_timestamps="us")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        want = con.execute(registry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        rows = registry.queries()[name](spark, str(tmp_path)).select(*[f"`{c}`" for c in columns]).collect()
        assert sorted((plain(tuple(r)) for r in rows), key=repr) == sorted((plain(r) for r in want.fetchall()), key=repr)
        return rows

    return check


def events(rows):
    """(user_id, value) as events, a second apart."""
    start = datetime.datetime(2024, 1, 1)
    return pd.DataFrame({"event_id": range(len(rows)), "ts": [start + datetime.timedelta(seconds=i) for i in range(len(rows))], "user_id": [r[0] for r in rows], "event_type": "error", "value": [r[1] for r in rows]})


def test_trimmed_directions_hold_ties_of_gaps(agrees):
    degrees = [138.168, 24.66, 92.34, 412.848, 100.08, 64.8, 192.276, 142.308, 103.464, 296.46, 252.0, 113.148]
    agrees("trimmed_directions", events=events([(83, round(d / 3.6, 2)) for d in degrees]))


def test_view_angles_on_the_target_itself(agrees):
    rows = events([(1, 40.0 if i in (25, 75) else i * 7.77) for i in range(80)])
    got = {r["event_id"]: r["view"] for r in agrees("view_angles", events=rows)}
    assert got[25] == got[75] == 144.0


def test_separated_pairs_on_the_border(agrees):
    keys = [0, 3, 6, 9, 12, 15]
    rows = pd.DataFrame({"s_suppkey": keys, "s_nationkey": [1, 1, 2, 2, 3, 3], "s_acctbal": [521.3, 481.3, -287.65, -247.65, 288.78, 248.78]}).astype({"s_nationkey": "int32"})
    agrees("separated_pairs", supplier=rows)


def test_rotation_vectors_of_half_turns(agrees):
    rows = [(5.0, 61740.0, 0.07, 0.04), (36.0, 83700.0, 0.09, 0.07), (19.0, 78300.0, 0.05, 0.05), (25.0, 61740.0, 0.01, 0.04), (25.0, 61740.0, 0.05, 0.04), (1.0, 61739.99, 0.0, 0.08), (1.0, 61740.01, 0.0, 0.08)]
    lines = pd.DataFrame(rows, columns=["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    agrees("rotation_vectors", lineitem=lines.assign(l_orderkey=range(len(rows)), l_linenumber=1))


def test_resampled_paths_between_half_turns(agrees):
    prices = {481: [115175.34, 84156.53, 131279.5, 141994.68, 381587.2, 158596.26, 310414.58], 1331: [499787.5, 135575.34, 305470.02, 146380.89, 145984.56, 156351.5], 2192: [372772.98, 412002.78, 191361.76, 249852.97, 62472.69, 443830.5, 257826.72, 199010.9, 492005.38]}
    keys = {481: [7644, 48048, 67111, 81638, 106455, 108561, 143413], 1331: [85083, 85649, 100563, 100781, 110812, 116414], 2192: [1, 12915, 22100, 32496, 72554, 108013, 113771, 134452, 136513]}
    rows = [(k, c, p) for c in prices for k, p in zip(keys[c], prices[c], strict=True)]
    agrees("resampled_paths", orders=pd.DataFrame(rows, columns=["o_orderkey", "o_custkey", "o_totalprice"]))


def test_metric_grades_of_a_mean_on_its_limit(spark, tmp_path):
    values = [36.56, 85.83, 5.02, 64.7, 94.34, 1.55]  # their mean is 48, and as doubles 48.00000000000001 in this order
    rows = events([(7, v) for v in values] + [(8, v) for v in sorted(values)] + [(9, 1e12), (9, 5.0), (10, 49.0), (11, None)])
    rows.assign(event_type="click").to_parquet(tmp_path / "events.parquet", index=False, coerce_timestamps="us")
    got = {r["user_id"]: r["grade"] for r in registry.queries()["metric_grades"](spark, str(tmp_path)).collect()}
    assert got == {7: "PASS", 8: "PASS", 9: "FAIL", 10: "WARN", 11: "NONE"}


def test_box_clearances_of_many_equal_boxes(agrees, monkeypatch):
    monkeypatch.setattr(measures, "BLOCK", 7)
    rows = events([(u, v) for u in range(12) for v in (0.0, 2.0, 3.5, 21.25, 49.0, 560.21, 2.0)])
    keys = [k + 1800 * i for k in (0, 2, 20, 90, 130) for i in range(5)]  # a box of a key modulo 1800
    agrees("box_clearances", events=rows, supplier=pd.DataFrame({"s_suppkey": keys, "s_nationkey": [k % 7 for k in range(len(keys))]}).astype({"s_nationkey": "int32"}))


def test_near_duplicates_of_equal_and_repeated_vectors(agrees, monkeypatch):
    monkeypatch.setattr(metrics, "TILE", 3)
    at = [0.0, 0.9, 0.9, 1.8, 2.6999, 9.0, 9.0, 30.0, 31.0, 50.0, 51.0]  # 9.0 repeats under one id, 30 and 31 share one
    ids = [1, 2, 3, 4, 5, 6, 6, 8, 8, 10, 11]
    rows = pd.DataFrame({"vec_id": ids + [20, 21, 22, 23], "embedding": [[x, 3.0] for x in at] + [[50.0, 3.0], [50.0, 3.5], [1.0, 1.0], [1.0, 1.0]], "label": [0] * len(at) + [1, 1, None, None]})
    got = agrees("near_duplicate_rate", embeddings=rows.astype({"label": "Int32"}))
    assert {r["label"]: r["n"] for r in got} == {0: 9, 1: 2, None: 2}


def test_pairs_of_tiles_are_not_written(spark):
    rows = spark.range(40).select(F.lit(0).alias("g"), F.col("id").alias("pos"), "id", F.array(F.col("id").cast("double")).alias("v"))
    packed = metrics.tiles(rows, "g", "id", "v")
    plan = metrics.met(packed, packed, "g", lambda g, x, y, a, b: pd.DataFrame({"n": [1]}), "n int")._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Join")]  # what comes after the join stands before it
    assert "Exchange" not in after and "MapInPandas" in after


def test_recovered_knobs_meet_no_other_rows(agrees, spark, tmp_path):
    agrees("recovered_knobs", part=pd.DataFrame({"p_partkey": range(300), "p_retailprice": [900 + k * 3.37 for k in range(300)]}))
    plan = registry.queries()["recovered_knobs"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the answers meet the keys, and trials nothing


@pytest.mark.parametrize("spare", [6, 0.4])
def test_expanded_cameras_of_few_far_ones(agrees, monkeypatch, spare):
    """At a spare of 0.4 nearly all cameras come again."""
    monkeypatch.setattr(choices, "SPARE", spare)
    cameras = pd.DataFrame({"s_suppkey": range(12), "s_nationkey": [k % 3 for k in range(12)], "s_acctbal": [-900.0, 9900.0, 4500.0, None, 0.0, 5000.0] * 2})
    near = [(k, k % 4, (k * 331 % 11000) - 999.0) for k in range(700)] + [(800, 0, None), (801, 2, 9999.0)]
    candidates = pd.DataFrame(near, columns=["c_custkey", "c_nationkey", "c_acctbal"])
    got = agrees("expanded_cameras", supplier=cameras.astype({"s_nationkey": "int32"}), customer=candidates.astype({"c_nationkey": "int32"}))
    assert {r["tier"] for r in got} == {"far", "near"} and len(got) == 12 * 8


def test_pair_attributes_come_with_the_pairs(agrees, spark, tmp_path):
    rows = pd.DataFrame({"s_suppkey": [1, 2, 3, 3, 5, 6], "s_nationkey": pd.array([0, 0, 0, 0, None, 1], dtype="Int32"), "s_acctbal": [1.5, None, 3.0, 4.0, 5.0, 6.0]})
    assert len(agrees("pair_attributes", supplier=rows)) == 10
    plan = registry.queries()["pair_attributes"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


@pytest.mark.parametrize("points", [2048, 5])
def test_nearest_points_of_shared_queries(agrees, monkeypatch, points):
    monkeypatch.setattr(proximity, "POINTS", points)
    monkeypatch.setattr(proximity, "QUERIES", 4)
    cloud = [(o, o % 4, 1 + o % 2, o * 7 % 50, 900.0 + o * 1009 % 90000, o % 11 / 100) for o in range(60)] + [(60 + i, 0, 1, 5, 2000.0, 0.01) for i in range(6)]
    lines = pd.DataFrame(cloud, columns=["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]).astype({"l_quantity": float, "l_linenumber": "int32"})
    lone = pd.DataFrame({"l_orderkey": [99], "l_suppkey": [5], "l_linenumber": [1], "l_quantity": [3.0], "l_extendedprice": [9.0], "l_discount": [0.0]}).astype({"l_linenumber": "int32"})
    suppliers = pd.DataFrame({"s_suppkey": [0, 1, 2, 3, 4, 5], "s_nationkey": [0, 0, 1, 2, 0, 1]}).astype({"s_nationkey": "int32"})
    customers = pd.DataFrame({"c_custkey": range(30), "c_nationkey": [c % 2 for c in range(30)], "c_acctbal": [c * 37.5 for c in range(30)]}).astype({"c_nationkey": "int32"})
    agrees("nearest_points", lineitem=pd.concat([lines, lone]), supplier=suppliers, customer=customers)
