"""Queries that report group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators import aggregates as A
from viaduct.plans.registry import query
from viaduct.sources.tables import load


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("""
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS sd, round(median(l_extendedprice), 6) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max
FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 10
""")
def group_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    return rounded(A.group_table(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", 10), "mean", "sd", "median")


@query("""
SELECT l_returnflag, count(*)::BIGINT AS n, CASE WHEN count(*) < 3 THEN NULL WHEN max(l_quantity) = min(l_quantity) OR max(l_extendedprice) = min(l_extendedprice) THEN 0.0 ELSE round(corr(l_quantity, l_extendedprice), 6) END AS r FROM lineitem GROUP BY 1
""")
def pearson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.pearson(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "r")


@query("""
WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS ry FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*)::BIGINT AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1
""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.spearman(load(spark, sf_dir, "events").select("event_type", "value", "user_id"), ["event_type"], "value", "user_id"), "rho")


@query("""
SELECT l_shipmonth, s[(round_even(0.1 * (n - 1), 0))::BIGINT + 1] AS p10, s[(round_even(0.9 * (n - 1), 0))::BIGINT + 1] AS p90, s[n // 2 + 1] AS upper_median FROM (
  SELECT month(l_shipdate)::INTEGER AS l_shipmonth, list_sort(list(l_extendedprice)) AS s, count(*) AS n FROM lineitem GROUP BY 1)
""")
def quantile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.month("l_shipdate").alias("l_shipmonth"), "l_extendedprice")
    return A.at_places(rows, ["l_shipmonth"], "l_extendedprice", {"p10": A.nearest_rank(0.1), "p90": A.nearest_rank(0.9), "upper_median": A.upper_median})


@query("""
SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1
""")
def quantile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(f"p{round(100 * p)}") for p in (0.05, 0.5, 0.95)])
    return rows


@query("""
WITH e AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem)
SELECT (CASE WHEN l_extendedprice > a THEN 1 ELSE 0 END + CASE WHEN l_extendedprice > b THEN 1 ELSE 0 END + CASE WHEN l_extendedprice > c THEN 1 ELSE 0 END)::INTEGER AS quartile, count(*)::BIGINT AS n, round(median(l_quantity), 6) AS median_quantity FROM lineitem, e GROUP BY 1
""")
def quartile_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    cuts = A.edges(rows, "l_extendedprice", 4)
    return rows.groupBy(A.bin_of("l_extendedprice", cuts).alias("quartile")).agg(F.count("*").alias("n"), F.round(F.median("l_quantity"), 6).alias("median_quantity"))


@query("""
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, o_orderpriority, n::BIGINT AS n, round(n / (SELECT count(*) FROM orders), 6) AS share, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share_of_row FROM c
""")
def crosstab_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.crosstab(load(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"), "share", "share_of_row")


@query("""
SELECT c_mktsegment, t AS threshold, count(c_acctbal)::BIGINT AS n, count_if(c_acctbal < t)::BIGINT AS below, round(count_if(c_acctbal < t) / count(c_acctbal), 6) AS share FROM customer, (VALUES (0::DOUBLE), (1000::DOUBLE), (5000::DOUBLE)) v(t) GROUP BY 1, 2
""")
def tails_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.tails(load(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", [0, 1000, 5000]), "share")


@query("""
SELECT coalesce(o_orderpriority, 'all') AS arm, count(*)::BIGINT AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())
""")
def subsets_and_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.with_all(load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), "o_totalprice"), "arm")
    return rounded(rows.groupBy("arm").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), "mean")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), p AS (SELECT *, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, round(-sum(p * log2(p)), 6) AS bits, round(max(p), 6) AS top_share, count(*)::BIGINT AS distinct_tags FROM p GROUP BY 1
""")
def tag_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.entropy(load(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id"], "event_type"), "bits", "top_share")


@query("""
WITH s AS (SELECT user_id, avg(value) AS m, var_pop(value) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT round(sum(v * n) / sum(n), 6) AS within, round(var_pop(m), 6) AS between, round(var_pop(m) / (var_pop(m) + sum(v * n) / sum(n) + 1e-12), 6) AS icc FROM s
""")
def icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.icc(load(spark, sf_dir, "events"), "user_id", "value"), "within", "between", "icc")


@query("""
WITH r AS (SELECT l.quality AS truth, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS guess FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL),
 s AS (SELECT truth AS c, count(*) AS support, count_if(truth = guess) AS tp FROM r GROUP BY 1), g AS (SELECT guess AS c, count(*) AS guessed FROM r GROUP BY 1),
 e AS (SELECT support, coalesce(tp / guessed, 0) AS p, tp / support AS r FROM s LEFT JOIN g USING (c))
SELECT round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall, round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support), 6) AS f1 FROM e
""")
def weighted_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").where("quality IS NOT NULL").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select(F.col("quality").alias("truth"), (F.col("n_chars") >= 500).cast("int").alias("guess"))
    return rounded(A.weighted_prf(rows, "truth", "guess"), "precision", "recall", "f1")


@query("""
SELECT c_mktsegment, count(DISTINCT o_orderpriority)::BIGINT AS kinds, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)
""")
def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that have every kind of member."""
    orders = load(spark, sf_dir, "orders")
    kinds = orders.agg(F.count_distinct("o_orderpriority").alias("all_kinds"))
    rows = orders.join(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    counted = rows.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("c")).groupBy("c_mktsegment").agg(F.count("*").alias("kinds"), F.sum("c").alias("n"))
    return counted.join(F.broadcast(kinds), F.col("kinds") == F.col("all_kinds")).select("c_mktsegment", "kinds", "n")


@query("""
WITH g AS (SELECT l_suppkey, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1 HAVING count(*) >= 3) SELECT round(median(sd), 6) AS median_sd, count(*)::BIGINT AS groups FROM g
""")
def median_group_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.stddev_samp("l_extendedprice").alias("sd"), F.count("*").alias("c")).where("c >= 3")
    return per.agg(F.round(F.median("sd"), 6).alias("median_sd"), F.count("*").alias("groups"))


@query("""
SELECT o_orderpriority, round(median(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 6) AS f, round(median(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 6) AS o, round(median(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 6) AS p FROM orders GROUP BY 1
""")
def pivot_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.median("o_totalprice"), 6))
    return table.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("""
WITH x AS (SELECT user_id, event_id, value, avg(value) OVER (PARTITION BY user_id) AS m FROM events) SELECT user_id, count(*)::BIGINT AS n, round(avg((value - m) ** 2), 6) AS mse FROM x GROUP BY 1
""")
def within_group_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of the group's mean as a guess; one aggregation, as it is the population variance."""
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.var_pop("value"), 6).alias("mse"))
