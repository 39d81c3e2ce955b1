"""Queries that audit corpora and sweep thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators import audits as A
from viaduct.plans.registry import query
from viaduct.sources.tables import load

ORDER = ["ts", "event_id"]


@query("""
SELECT "end", key, count(*)::BIGINT AS n FROM (SELECT 'l_partkey' AS "end", l_partkey AS key FROM lineitem UNION ALL SELECT 'l_suppkey', l_suppkey FROM lineitem) WHERE key NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2
""")
def dangling_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dangling(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "supplier"), ["l_partkey", "l_suppkey"], "s_suppkey")


@query("""
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1
""")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overlap(load(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus").select("o_custkey", F.array_join("splits", ",").alias("splits"))


@query("""
SELECT l_returnflag, count(DISTINCT concat_ws('|', l_linestatus, coalesce(l_tax::VARCHAR, '~')))::BIGINT AS combinations FROM lineitem GROUP BY 1
""")
def homogeneous_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.homogeneous(load(spark, sf_dir, "lineitem"), "l_returnflag", ["l_linestatus", "l_tax"])


@query("""
SELECT page_id, array_to_string([x FOR x IN [CASE WHEN NOT coalesce(starts_with(url, 'http'), false) THEN 'url' END, CASE WHEN NOT coalesce(contains(html, '<title>'), false) THEN 'title' END, CASE WHEN NOT coalesce(length(html) < 5000, false) THEN 'size' END] IF x IS NOT NULL], ',') AS violations FROM pages
""")
def page_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.violations({"url": F.col("url").startswith("http"), "title": F.col("html").contains("<title>"), "size": F.length("html") < 5000})
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(found, ",").alias("violations"))


@query("""
WITH c AS (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS percent, unnest(quantile_cont(l_extendedprice, [0.5, 0.9, 0.99])) AS cut FROM lineitem)
SELECT percent, round(cut, 6) AS cut, round(avg(CASE WHEN l_extendedprice <= cut THEN 1 ELSE 0 END), 6) AS kept, round(avg(CASE WHEN l_extendedprice <= cut THEN CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END END), 6) AS bad FROM lineitem, c GROUP BY 1, 2
""")
def percentile_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").alias("bad"))
    return A.percentile_cuts(rows, "l_extendedprice", "bad", [0.5, 0.9, 0.99]).withColumns({c: F.round(c, 6) for c in ("cut", "kept", "bad")})


@query("""
WITH n AS (SELECT o_orderpriority AS c, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 2.5 WHEN '5-LOW' THEN 0.5 ELSE 1 END AS w FROM orders GROUP BY 1)
SELECT c AS o_orderpriority, floor(n * w / 16)::BIGINT AS batches, (floor(n * w / 16) * 16)::BIGINT AS rows FROM n
""")
def weighted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = A.weighted_batches(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", F.col("o_orderkey"), {"1-URGENT": 2.5, "5-LOW": 0.5}, 16)
    return batched.groupBy("o_orderpriority").agg((F.max("batch") + 1).alias("batches"), F.count("*").alias("rows"))


@query("""
SELECT c_custkey, i::INTEGER AS i, round_even(i * (c_custkey % 97) / 6.0, 0)::BIGINT AS frame FROM customer, range(7) t(i)
""")
def linspace_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").select("c_custkey", A.linspace(F.lit(0), F.col("c_custkey") % 97, 7).alias("f"))
    return rows.select("c_custkey", F.posexplode("f").alias("i", "frame"))


@query("""
WITH d AS (SELECT DISTINCT user_id, value * 3 % 360 AS d FROM events WHERE value >= 0), g AS (SELECT user_id, d, lead(d) OVER (PARTITION BY user_id ORDER BY d) - d AS g FROM d)
SELECT user_id, round(360 - greatest(coalesce(max(g), 0), min(d) + 360 - max(d)), 6) AS span FROM g GROUP BY 1
""")
def azimuth_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("value >= 0").select("user_id", (F.col("value") * 3).alias("a"))
    return A.azimuth_span(rows, "user_id", "a").withColumn("span", F.round("span", 6))


@query("""
WITH j AS (SELECT user_id, event_id, ts, value, coalesce(round((value - lag(value) OVER w) / 40), 0) AS j FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(value - 40 * sum(j) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS unwrapped FROM j
""")
def unwrap_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("value IS NOT NULL")
    return A.unwrapped(rows, "user_id", ORDER, "value", 40.0).select("user_id", "event_id", F.round("unwrapped", 6).alias("unwrapped"))


@query("""
SELECT user_id, round(avg(abs(rest)), 6) AS mean_rest, count(rest)::BIGINT AS n FROM (SELECT user_id, value - (-3 * lag(value, 2) OVER w + 12 * lag(value) OVER w + 17 * value + 12 * lead(value) OVER w - 3 * lead(value, 2) OVER w) / 35 AS rest
  FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1
""")
def polynomial_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.polynomial_rest(load(spark, sf_dir, "events").where("value IS NOT NULL"), "user_id", ORDER, "value")
    return rows.groupBy("user_id").agg(F.round(F.avg(F.abs("rest")), 6).alias("mean_rest"), F.count("rest").alias("n"))


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v, event_type FROM events), m AS (SELECT user_id, median(v) AS m FROM e WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, event_id, round(coalesce(v, m), 6) AS filled FROM e LEFT JOIN m USING (user_id)
""")
def borrowed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return A.borrowed(rows, "user_id", "v", F.col("event_type") == "click").select("user_id", "event_id", F.round("filled", 6).alias("filled"))
