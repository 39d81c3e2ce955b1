"""Queries over paths in space and sweeps of filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.functions import rotations as R
from viaduct.operators import grouped as G
from viaduct.operators import paths as K
from viaduct.operators.dedup import checkpointed
from viaduct.plans.registry import query
from viaduct.sources.tables import load

_ORDER = "o_orderdate, o_orderkey"
_FRAMES = f"f AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_ORDER}) - 1 AS frame, [o_totalprice / 1e5, o_orderkey % 7, (o_custkey % 5) * (o_orderkey % 3)]::DOUBLE[] AS c FROM orders)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a path."""
    key = F.col("o_orderkey")
    centre = F.array(F.col("o_totalprice") / 1e5, (key % 7).cast("double"), ((F.col("o_custkey") % 5) * (key % 3)).cast("double"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return load(spark, sf_dir, "orders").select("o_custkey", place.alias("frame"), centre.alias("centre"))


#: Eigenvalues of the 3 x 3 covariance by the trigonometric form of the cubic's roots.
_SHAPES = f"""
{_FRAMES}, s AS (SELECT *, list_distance(c, lag(c) OVER (PARTITION BY o_custkey ORDER BY frame)) AS step, first_value(c) OVER (PARTITION BY o_custkey ORDER BY frame) AS c0 FROM f),
p AS (SELECT o_custkey, coalesce(sum(step), 0) AS length, max(list_distance(c, c0)) AS reach, list_distance(arg_min(c, frame), arg_max(c, frame)) AS chord, count(*) AS n, var_pop(c[1]) AS a, var_pop(c[2]) AS b, var_pop(c[3]) AS d, covar_pop(c[1], c[2]) AS e, covar_pop(c[1], c[3]) AS g, covar_pop(c[2], c[3]) AS h FROM s GROUP BY 1),
q AS (SELECT *, (a + b + d) / 3 AS q FROM p), v AS (SELECT *, sqrt(((a - q)**2 + (b - q)**2 + (d - q)**2 + 2 * (e**2 + g**2 + h**2)) / 6) AS w FROM q),
r AS (SELECT *, CASE WHEN w > 0 THEN greatest(-1, least(1, ((a - q) * ((b - q) * (d - q) - h * h) - e * (e * (d - q) - h * g) + g * (e * h - (b - q) * g)) / w**3 / 2)) END AS z FROM v),
l AS (SELECT *, q + 2 * w * cos(acos(z) / 3) AS l1, q + 2 * w * cos(acos(z) / 3 + 2 * pi() / 3) AS l3 FROM r),
k AS (SELECT o_custkey, length, chord, reach, CASE WHEN length > 1e-9 THEN chord / length END AS straightness, CASE WHEN sqrt(l1 * n) >= 1e-12 THEN sqrt(greatest(0, 3 * q - l1 - l3) / l1) END AS ratio2, CASE WHEN sqrt(l1 * n) >= 1e-12 THEN sqrt(greatest(0, l3) / l1) END AS ratio3 FROM l)"""


@query(f"WITH {_SHAPES} SELECT o_custkey, round(length, 5) AS length, round(chord, 5) AS chord, round(reach, 5) AS reach, round(straightness, 5) AS straightness, round(ratio2, 2) AS ratio2, round(ratio3, 2) AS ratio3 FROM k")
def path_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.shapes(checkpointed(frames(spark, sf_dir)), "o_custkey", "frame")
    return out.select("o_custkey", *[F.round(c, 5).alias(c) for c in ("length", "chord", "reach", "straightness")], F.round("ratio2", 2).alias("ratio2"), F.round("ratio3", 2).alias("ratio3"))


_PERCENTS = ", ".join(f"round(quantile_cont({c}, {p}), 3) AS {c}_p{n}" for c in ("straightness", "ratio2", "ratio3", "length", "reach") for p, n in (("0.05", "05"), ("0.5", "50"), ("0.95", "95")))


@query(f"WITH {_SHAPES} SELECT {_PERCENTS}, round(avg(CASE WHEN straightness > 0.99 THEN 1 WHEN straightness IS NOT NULL THEN 0 END), 6) AS straight_share, round(avg(CASE WHEN ratio2 < 0.01 THEN 1 WHEN ratio2 IS NOT NULL THEN 0 END), 6) AS line_share, count(*)::BIGINT AS paths FROM k")
def path_shape_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.shape_summary(K.shapes(checkpointed(frames(spark, sf_dir)), "o_custkey", "frame"))
    return out.select(*[F.round(c, 6 if c.endswith("share") else 3).alias(c) if c != "paths" else c for c in out.columns])


@query(f"""
WITH {_FRAMES}, x AS (SELECT a.o_custkey, max(list_distance(a.c, b.c)) AS extent FROM f a JOIN f b USING (o_custkey) GROUP BY 1), c AS (SELECT f.*, extent, [round_even(v / greatest(0.3 * extent, 1e-9), 0)::BIGINT FOR v IN c] AS cell FROM f JOIN x USING (o_custkey)),
m AS (SELECT o_custkey, cell, count(*) AS m FROM c GROUP BY 1, 2), g AS (SELECT o_custkey, cell, m, sum(m) OVER (PARTITION BY o_custkey) AS n FROM m QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY m DESC, cell) = 1),
i AS (SELECT c.o_custkey, frame, extent, m, n, frame - row_number() OVER (PARTITION BY c.o_custkey ORDER BY frame) AS island FROM c JOIN g ON g.o_custkey = c.o_custkey AND g.cell = c.cell), r AS (SELECT o_custkey, island, any_value(extent) AS extent, any_value(m) AS m, any_value(n) AS n, count(*) AS run FROM i GROUP BY 1, 2)
SELECT o_custkey, any_value(n)::BIGINT AS n, round(any_value(extent), 6) AS extent, round(any_value(m) / any_value(n), 6) AS share, max(run)::BIGINT AS run FROM r GROUP BY 1
""")
def parked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each path stays in one cell, and for how long."""
    out = K.parked(checkpointed(frames(spark, sf_dir)), "o_custkey", "frame", 0.3)
    return out.withColumns({c: F.round(c, 6) for c in ("extent", "share")})


@query(f"""
WITH {_FRAMES}, s AS (SELECT *, first_value(c) OVER (PARTITION BY o_custkey ORDER BY frame) AS c0, [3.0, 2.0 + o_custkey % 4, 1.5]::DOUBLE[] AS t FROM f), a AS (SELECT *, [t[1] - c[1], t[2] - c[2], t[3] - c[3]] AS u, [t[1] - c0[1], t[2] - c0[2], t[3] - c0[3]] AS v FROM s)
SELECT o_custkey, frame::INTEGER AS frame, round(list_distance(c, c0) / 2.5, 6) AS tau, round(degrees(acos(greatest(-1, least(1, list_dot_product(u, v) / greatest(sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)), 1e-9))))), 4) AS angle,
  round((500 * u[1] + 320 * u[3]) / CASE WHEN abs(u[3]) < 1e-9 THEN 1e-9 ELSE u[3] END, 5) AS u, round((400 * u[2] + 240 * u[3]) / CASE WHEN abs(u[3]) < 1e-9 THEN 1e-9 ELSE u[3] END, 5) AS v, u[3] > 0 AS ahead FROM a
""")
def views_of_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every frame: how far it has moved, how far it looks round its target, and where that lies in its picture."""
    rows = frames(spark, sf_dir)
    rows = rows.withColumn("source", F.first("centre").over(Window.partitionBy("o_custkey").orderBy("frame"))).withColumn("target", F.array(F.lit(3.0), 2.0 + F.col("o_custkey") % 4, F.lit(1.5)))
    w2c = R.pose_of(R.array(1, 0, 0, 0, 1, 0, 0, 0, 1), F.transform("centre", lambda x: -x))
    seen = rows.withColumn("p", K.projected(F.col("target"), w2c, F.lit(500.0), F.lit(400.0), F.lit(320.0), F.lit(240.0)))
    c, s, t = (F.col(n) for n in ("centre", "source", "target"))
    return seen.select("o_custkey", "frame", F.round(K.tau(c, s, F.lit(2.5)), 6).alias("tau"), F.round(K.view_angle(c, s, t), 4).alias("angle"), F.round("p.u", 5).alias("u"), F.round("p.v", 5).alias("v"), (F.col("p.z") > 0).alias("ahead"))


@query("""
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 6) SELECT o_custkey, round(1.0 + (o_custkey % 9) / 4.0, 5)::DOUBLE AS scale, [(o_custkey % 3)::DOUBLE, -2.0::DOUBLE, 0.5::DOUBLE] AS shift, 0.0::DOUBLE AS rms FROM n
""")
def similarity_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and their turned, scaled and shifted copies: the fit finds scale and shift again, with nothing left."""
    rows = frames(spark, sf_dir)
    many = rows.groupBy("o_custkey").count().where("count >= 6").select("o_custkey")
    scale, turn = 1.0 + (F.col("o_custkey") % 9) / 4.0, R.from_vector(F.array(F.col("o_custkey") % 5 * 0.3, F.lit(0.4), F.lit(-0.2)))
    bent = F.transform("centre", lambda x: x + 0.1 * x * x)  # no path of a plane: its turn would not be one
    spread = F.zip_with(bent, F.array(F.cos("frame"), F.sin("frame"), F.cos(3 * F.col("frame"))), lambda a, b: a + b)
    left = rows.join(many, "o_custkey", "left_semi").select("o_custkey", spread.alias("a"), scale.alias("s"), turn.alias("r"))
    shift = F.array((F.col("o_custkey") % 3).cast("double"), F.lit(-2.0), F.lit(0.5))
    both = left.withColumn("b", F.zip_with(R.rotated(F.col("r"), F.col("a")), shift, lambda x, t: x * F.col("s") + t))
    out = G.similarity_fits(both.select("o_custkey", "a", "b"), "o_custkey", "a", "b")
    return out.select("o_custkey", F.round("scale", 5).alias("scale"), F.transform("shift", lambda x: F.round(x, 5) + 0.0).alias("shift"), (F.round("rms", 5) + 0.0).alias("rms"))


@query("""
WITH e AS (SELECT list_distinct(quantile_cont(l_quantity::DOUBLE, [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1])).list_sort() AS e FROM lineitem), b AS (SELECT greatest(1, len(list_filter(e, lambda x: x < l_quantity))) AS bin, e, l_extendedprice, l_discount FROM lineitem, e)
SELECT bin::INTEGER AS bin, any_value(e[bin]) AS low, any_value(e[bin + 1]) AS high, count(*)::BIGINT AS n, round(median(l_extendedprice), 6) AS median_l_extendedprice, round(median(l_discount), 6) AS median_l_discount FROM b GROUP BY bin
""")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between the twentieths of their quantity, and the medians of each bin."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), "l_extendedprice", "l_discount")
    return K.quantile_bins(rows, "l_quantity", 20, ["l_extendedprice", "l_discount"]).withColumns({c: F.round(c, 6) for c in ("median_l_extendedprice", "median_l_discount")})


def _sweep_sql() -> str:
    tests = {f"price<={c}": f"l_extendedprice <= {c}" for c in (1000, 20000, 50000, 80000)} | {f"price<={c}, quantity>={q}": f"l_extendedprice <= {c} AND l_quantity >= {q}" for c in (20000, 50000) for q in (5, 10, 20)} | {"none": "l_extendedprice < -1"}
    return " UNION ALL ".join(f"SELECT '{n}' AS filter, round(avg(CASE WHEN {t} THEN 1 ELSE 0 END), 6) AS kept, round(quantile_cont(CASE WHEN {t} THEN l_discount END, 0.95), 6) AS p95, round(quantile_cont(CASE WHEN {t} THEN l_discount END, 0.99), 6) AS p99, max(CASE WHEN {t} THEN l_discount END) AS most, round(avg(CASE WHEN {t} THEN CASE WHEN l_discount > 0.07::DOUBLE THEN 1 ELSE 0 END END), 6) AS above FROM lineitem HAVING count_if({t}) >= 10" for n, t in tests.items())


@query(_sweep_sql())
def filter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cuts of one column, and of two together, leave of the lines, and what discounts these have."""
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    filters = {f"price<={c}": price <= c for c in (1000, 20000, 50000, 80000)} | {f"price<={c}, quantity>={q}": (price <= c) & (quantity >= q) for c in (20000, 50000) for q in (5, 10, 20)} | {"none": price < -1}
    return K.sweep(load(spark, sf_dir, "lineitem"), "l_discount", 0.07, filters).withColumns({c: F.round(c, 6) for c in ("kept", "p95", "p99", "above")})
