"""Queries on planar geometry, depths and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import geometry as G
from viaduct.functions import measures as Q
from viaduct.plans.aggregates import rounded
from viaduct.plans.registry import query
from viaduct.sources.tables import load

ORDER = ["ts", "event_id"]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("value IS NOT NULL")
    return rows.select((F.col("user_id") % 10).alias("scene"), "user_id", *ORDER, F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"), "event_type")


_P = "p AS (SELECT user_id % 10 AS scene, user_id, ts, event_id, value AS x, (event_id % 50)::DOUBLE AS y, event_type FROM events WHERE value IS NOT NULL)"
_BOX = "sqrt(greatest(qx, 0) ** 2 + greatest(qy, 0) ** 2) + least(greatest(qx, qy), 0)"


@query(f"""
WITH {_P} SELECT event_id, round(abs((((degrees(atan2(25 - y, 40 - x)) - x * 3.6 + 180) % 360) + 360) % 360 - 180), 6) AS view FROM p
""")
def view_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = Q.view_angle(F.col("x"), F.col("y"), F.lit(40.0), F.lit(25.0), F.col("x") * 3.6)
    return _points(spark, sf_dir).select("event_id", F.round(angle, 6).alias("view"))


@query(f"""
WITH {_P}, b AS (SELECT s_nationkey % 10 AS scene, s_suppkey % 50 AS cx, s_suppkey % 40 AS cy, s_suppkey * 7 % 180 AS yaw, 4.0 AS w, 2.0 AS h FROM supplier),
 q AS (SELECT scene, user_id, abs((x - cx) * cos(radians(yaw)) + (y - cy) * sin(radians(yaw))) - w / 2 AS qx, abs((y - cy) * cos(radians(yaw)) - (x - cx) * sin(radians(yaw))) - h / 2 AS qy FROM p JOIN b USING (scene))
SELECT scene, user_id, round(min({_BOX}), 6) AS clearance, count_if({_BOX} < 0)::BIGINT AS inside FROM q GROUP BY 1, 2
""")
def box_clearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    boxes = s.select((F.col("s_nationkey") % 10).cast("long").alias("scene"), (F.col("s_suppkey") % 50).alias("cx"), (F.col("s_suppkey") % 40).alias("cy"), (F.col("s_suppkey") * 7 % 180).alias("yaw"), F.lit(4.0).alias("w"), F.lit(2.0).alias("h"))
    return rounded(Q.clearances(_points(spark, sf_dir), boxes, "scene", "user_id"), "clearance")


@query(f"""
WITH {_P}, g AS (SELECT scene, quantile_cont(x, 0.02) AS ground FROM p GROUP BY 1) SELECT scene, round(ground, 6) AS ground, count_if(abs(x - ground) <= 0.5)::BIGINT AS near FROM p JOIN g USING (scene) GROUP BY 1, 2
""")
def ground_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.ground(_points(spark, sf_dir), "scene", "x"), "ground")


@query(f"""
WITH {_P}, g AS (SELECT scene, quantile_cont(x, 0.05) AS a, quantile_cont(x, 0.95) AS b FROM p GROUP BY 1) SELECT scene, count(*)::BIGINT AS n, round(max(x) - min(x), 6) AS extent FROM p JOIN g USING (scene) WHERE x BETWEEN a AND b GROUP BY 1
""")
def depth_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Q.tail_trimmed(_points(spark, sf_dir), "scene", "x", 0.05, 0.95)
    return kept.groupBy("scene").agg(F.count("*").alias("n"), F.round(F.max("x") - F.min("x"), 6).alias("extent"))


@query(f"""
WITH {_P}, b AS (SELECT scene, floor(x / 5)::BIGINT AS bin, count(*) AS c FROM p GROUP BY 1, 2), t AS (SELECT scene, bin AS tb, c AS tc FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY c DESC, bin) AS r FROM b) WHERE r = 1),
 f AS (SELECT *, bin - row_number() OVER (PARTITION BY scene ORDER BY bin) AS i FROM b JOIN t USING (scene) WHERE c >= 0.8 * tc), g AS (SELECT scene, i, tb, min(bin) AS a, max(bin) AS z, sum(c) AS n FROM f GROUP BY 1, 2, 3)
SELECT scene, a * 5.0::DOUBLE AS "from", (z + 1) * 5.0::DOUBLE AS until, n::BIGINT AS n FROM g WHERE tb BETWEEN a AND z
""")
def depth_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.mode_band(_points(spark, sf_dir), "scene", "x", 5.0, 0.8)


@query(f"""
WITH {_P}, d AS (SELECT user_id, sqrt((x - first_value(x) OVER w) ** 2 + (y - first_value(y) OVER w) ** 2) AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(greatest(avg(d), 1e-5), 6) AS scale FROM d GROUP BY 1
""")
def scene_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.scene_scale(_points(spark, sf_dir), "user_id", ORDER, "x", "y"), "scale")


@query(f"""
WITH {_P} SELECT user_id, round((max(x) - min(x)) / nullif(median(y), 0), 6) AS parallax FROM p GROUP BY 1
""")
def parallax_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.parallax(_points(spark, sf_dir), "user_id", "x", "y"), "parallax")


@query(f"""
WITH {_P}, s AS (SELECT user_id, abs(x - lag(x) OVER w) AS s, (row_number() OVER w - 1) // 12 AS k FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), m AS (SELECT user_id, k, avg(s) AS m FROM s GROUP BY 1, 2 HAVING count(*) = 12)
SELECT user_id, count(*)::BIGINT AS windows, round(avg(m), 6) AS movement FROM m GROUP BY 1
""")
def window_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.window_movement(_points(spark, sf_dir), "user_id", ORDER, "x", 12), "movement")


@query("""
SELECT p_partkey, round(exp(-(((p_size - 20) / CASE WHEN p_size < 20 THEN 6.0 ELSE 12.0 END) ** 2) / 2), 6) AS score FROM part
""")
def bell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.round(Q.bell(F.col("p_size"), 20, 6.0, 12.0), 6).alias("score"))


@query(f"""
WITH {_P}, g AS (SELECT * FROM p WHERE x > 0 AND y > 0), s AS (SELECT scene, median(y / x) AS s FROM g GROUP BY 1)
SELECT scene, count(*)::BIGINT AS n, round(avg(abs(x * s - y) / y), 6) AS abs_rel, round(avg(CASE WHEN greatest(x * s / y, y / (x * s)) < 1.25 THEN 1 ELSE 0 END), 6) AS delta FROM g JOIN s USING (scene) GROUP BY 1
""")
def depth_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.depth_errors(_points(spark, sf_dir), "scene", "x", "y"), "abs_rel", "delta")


@query(f"""
WITH {_P}, d AS (SELECT a.user_id, a.event_id, abs(a.x - b.x) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.x - b.x)) AS r FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_id <> b.event_id), k AS (SELECT user_id, event_id, d FROM d WHERE r = 3), m AS (SELECT user_id, median(d) AS m FROM k GROUP BY 1)
SELECT event_id, round(d, 6) AS reach, d > 4 * m AS outlier FROM k JOIN m USING (user_id)
""")
def radius_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.outliers(_points(spark, sf_dir), "user_id", "event_id", "x", 3, 4.0).select("event_id", F.round("reach", 6).alias("reach"), "outlier")


@query("""
SELECT p_partkey, round(abs(0 * 1 - p_size * 0 + p_size * (p_size + 2.0) - (p_size + 1.0) * 1 + (p_size + 1.0) * 3 - 1 * (p_size + 2.0) + 1 * 0 - 0 * 3) / 2, 6) AS area FROM part
""")
def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct((F.lit(x) if not hasattr(x, "cast") else x).cast("double").alias("x"), (F.lit(y) if not hasattr(y, "cast") else y).cast("double").alias("y"))
    s = F.col("p_size")
    return load(spark, sf_dir, "part").select("p_partkey", F.round(Q.polygon_area(F.array(point(0, 0), point(s, 1), point(s + 1, s + 2), point(1, 3))), 6).alias("area"))


@query(f"""
WITH {_P}, t AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM p), f AS (SELECT DISTINCT user_id, n, i FROM t, range(16) r(i))
SELECT f.user_id, i::INTEGER AS frame, x FROM f JOIN t ON t.user_id = f.user_id AND t.t = round_even(i * (f.n - 1) / 15.0, 0)
""")
def resampled_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.resampled(_points(spark, sf_dir), "user_id", ORDER, "x", 16)


@query(f"""
WITH {_P} SELECT event_id, round(x - 20, 6) AS cx, round(y * cos(radians(30)) + 3 * sin(radians(30)), 6) AS cy, 30.0::DOUBLE AS turn FROM p
""")
def camera_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses as 3x4 matrices: centre in the plane and the angle to the identity, of cameras turned by 30 degrees about x."""
    c, s = F.cos(F.radians(F.lit(30.0))), F.sin(F.radians(F.lit(30.0)))
    zero, one = F.lit(0.0), F.lit(1.0)
    m = F.array(one, zero, zero, 20 - F.col("x"), zero, c, s, -F.col("y"), zero, -s, c, F.lit(3.0))
    eye = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)])
    rows = _points(spark, sf_dir).select("event_id", G.centre(m).alias("c"), F.round(G.angle(m, eye), 6).alias("turn"))
    return rows.select("event_id", F.round(F.element_at("c", 1), 6).alias("cx"), F.round(F.element_at("c", 2), 6).alias("cy"), "turn")
