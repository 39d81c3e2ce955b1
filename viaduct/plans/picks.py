"""Queries that rank, cap, split and interleave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators import topk as T
from viaduct.plans.registry import query
from viaduct.sources.tables import load


@query("""
SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3
""")
def stable_topk_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders")
    return T.top_k(rows, ["o_custkey"], [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber) AS i FROM lineitem),
 b AS (SELECT *, CASE WHEN i <= 1 THEN row_number() OVER (PARTITION BY l_orderkey, i <= 1 ORDER BY l_extendedprice DESC, l_linenumber) END AS o FROM a)
SELECT l_orderkey, l_linenumber, CASE WHEN i > 1 THEN 'inner' WHEN o > 2 THEN 'outer' END AS dropped_by FROM b
""")
def two_level_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_extendedprice")
    return T.two_level_cap(rows, ["l_orderkey", "l_returnflag"], ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 1, 2).select("l_orderkey", "l_linenumber", "dropped_by")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem)
SELECT l_orderkey, max(l_linenumber) FILTER (r = 1) AS best, max(v) FILTER (r = 1) AS best_score, round(coalesce(max(v) FILTER (r = 2) / max(v) FILTER (r = 1), 0), 6) AS rival_ratio FROM s GROUP BY 1
""")
def rival_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return T.rival_ratio(rows, ["l_orderkey"], "l_linenumber", "l_extendedprice").withColumn("rival_ratio", F.round("rival_ratio", 6))


@query("""
SELECT c_custkey, CASE WHEN (('0x' || md5(c_custkey::VARCHAR))::UHUGEINT % 10) = 0 THEN 'test' ELSE 'train' END AS split FROM customer
""")
def md5_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.holdout(load(spark, sf_dir, "customer"), "c_custkey", 10).select("c_custkey", "split")


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS turn FROM orders
""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.round_robin(load(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "turn")


@query("""
WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders WHERE o_orderpriority = '1-URGENT'),
 w AS (SELECT least((SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT'), round_even((SELECT count(*) FROM orders WHERE o_orderpriority <> '1-URGENT') * 0.1 / 0.9, 0))::BIGINT AS want)
SELECT o_orderkey FROM h, w WHERE pos IN (SELECT (i * n // want) FROM range(0, 1000000) t(i) WHERE i < want)
""")
def subsample_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders thinned at even strides until they are a tenth of all that stay."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    hits, rest = orders.agg(F.count_if(F.col("o_orderpriority") == "1-URGENT"), F.count_if(F.col("o_orderpriority") != "1-URGENT")).first()
    want = min(hits, round(rest * 0.1 / 0.9))
    return T.every_stride(orders.where("o_orderpriority = '1-URGENT'"), ["o_orderkey"], want, hits).select("o_orderkey")


@query("""
SELECT event_type, arg_max(event_id, (value, event_id)) AS most, arg_min(event_id, (value, event_id)) AS least FROM events WHERE value IS NOT NULL GROUP BY 1
""")
def argmax_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("value IS NOT NULL")
    return rows.groupBy("event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("most"), F.min_by("event_id", F.struct("value", "event_id")).alias("least"))


@query("""
SELECT s_suppkey, round(s_acctbal / 10000 * exp(-abs(ln((s_suppkey % 50 + 1) / 12.0)) / 1.2), 4) AS board FROM supplier WHERE s_acctbal > 0 ORDER BY board DESC, s_suppkey LIMIT 20
""")
def board_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.col("s_acctbal") / 10000 * F.exp(-F.abs(F.log((F.col("s_suppkey") % 50 + 1) / 12.0)) / 1.2), 4)
    return load(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey", score.alias("board")).orderBy(F.desc("board"), "s_suppkey").limit(20)
