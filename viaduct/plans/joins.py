"""Queries that join rows with lists, measurements and each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators import dedup, joins, rules
from viaduct.plans.registry import query
from viaduct.sources.tables import load


@query("""
SELECT coalesce(CASE WHEN l_quantity <= 5 THEN 'few' WHEN l_discount >= 0.08 THEN 'discounted' WHEN l_returnflag = 'R' THEN 'returned' END, 'ok') AS reason,
  count(*)::BIGINT AS n FROM lineitem GROUP BY 1
""")
def first_failure_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem")
    why = rules.first_reason({"few": F.col("l_quantity") <= 5, "discounted": F.col("l_discount") >= 0.08, "returned": F.col("l_returnflag") == "R"})
    return rows.groupBy(F.coalesce(why, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT reason, count(*)::BIGINT AS n FROM (
  SELECT unnest([x FOR x IN [CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END] IF x IS NOT NULL]) AS reason FROM documents
) GROUP BY reason
""")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("n_chars", "lang")
    named = rules.reasons({"short": F.col("n_chars") < 200, "long": F.col("n_chars") > 5000, "foreign": F.col("lang") != "en"})
    return docs.select(F.explode(named).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, coalesce(l_discount >= 0.05, true) AND coalesce(CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END <= 0.06, true) AS passed FROM lineitem
""")
def missing_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression filters in which a missing value passes; a zero tax counts as missing (NaN)."""
    rows = load(spark, sf_dir, "lineitem")
    rows = rows.withColumn("tax", F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")))
    return rows.select("l_orderkey", "l_linenumber", rules.passes(["l_discount >= 0.05", "tax <= 0.06"]).alias("passed"))


@query("""
SELECT l_returnflag AS source, CASE WHEN l_quantity < 10 THEN 'unreachable' WHEN l_discount < m THEN 'static' WHEN l_tax < m THEN 'dynamic' ELSE 'ok' END AS channel, m AS margin, count(*)::BIGINT AS n
FROM lineitem, (VALUES (0.02::DOUBLE), (0.05::DOUBLE)) t(m) GROUP BY ALL
""")
def margin_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive failure channels, in order, at each margin."""
    rows = load(spark, sf_dir, "lineitem").withColumn("margin", F.explode(F.array(F.lit(0.02), F.lit(0.05))))
    channel = F.coalesce(rules.first_reason({"unreachable": F.col("l_quantity") < 10, "static": F.col("l_discount") < F.col("margin"), "dynamic": F.col("l_tax") < F.col("margin")}), F.lit("ok"))
    return rows.groupBy(F.col("l_returnflag").alias("source"), channel.alias("channel"), "margin").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
""")
def blacklist_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.without(load(spark, sf_dir, "orders"), listed, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def holdout_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.only(load(spark, sf_dir, "orders"), listed, ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("""
SELECT d.source, count(*)::BIGINT AS n, count_if(l.doc_id IS NULL)::BIGINT AS missed FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source
""")
def enrich_with_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = joins.enrich(load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "labels"), ["doc_id"])
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count_if("missed").alias("missed"))


@query("""
WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1)
SELECT CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' ELSE 'same' END AS change, count(*)::BIGINT AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1
""")
def paired_full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_linenumber", "l_quantity")
    side = lambda test: rows.where(test).groupBy("k").agg(F.sum("l_quantity").alias("v"))
    return joins.difference(side("l_linenumber <= 2"), side("l_linenumber >= 2"), ["k"], "v").groupBy("change").agg(F.count("*").alias("n"))


@query("""
SELECT a.n_regionkey AS region, a.n_name AS target, b.n_name AS context FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name
""")
def ordered_pairs_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.ordered_pairs(load(spark, sf_dir, "nation"), "n_regionkey", "n_name").withColumnRenamed("n_regionkey", "region")


@query("""
WITH e AS (SELECT event_id, user_id, epoch(ts) AS t, event_type FROM events)
SELECT c.event_id, c.user_id, EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND abs(p.t - c.t) <= 3600) AS found FROM e c WHERE c.event_type = 'click'
""")
def theta_exists_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of a user that have a purchase within an hour."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "t")
    return joins.exists_within(clicks, events.where("event_type = 'purchase'"), "user_id", "t", 3600.0).select("event_id", "user_id", "found")


@query("""
WITH e AS (SELECT user_id, epoch(ts) AS s, epoch(ts) + 7200 AS e FROM events),
 w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e),
 g AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS i FROM w)
SELECT user_id, round(min(s), 3) AS s, round(max(e), 3) AS e, count(*)::BIGINT AS n FROM g GROUP BY user_id, i
""")
def interval_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's activity, two hours from every event, as maximal intervals."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    spans = load(spark, sf_dir, "events").select("user_id", t.alias("s"), (t + 7200).alias("e"))
    return joins.coalesce_intervals(spans, ["user_id"], "s", "e").select("user_id", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"), "n")


@query("""
SELECT source, doc_id, text_length FROM (SELECT source, doc_id, n_chars AS text_length, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1
""")
def exact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text; a digest of the text is shuffled, not the text."""
    docs = load(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("text_length"), F.sha2("text", 256).alias("digest"))
    return dedup.first_of(docs, ["digest"], ["doc_id"]).drop("digest")


@query("""
SELECT l_orderkey, l_linenumber, first_value(l_linenumber) OVER w AS representative, row_number() OVER w > 1 AS folded FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber)
""")
def folded_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return dedup.folded(rows, ["l_orderkey", "l_returnflag", "l_linestatus"], ["l_linenumber"], "l_linenumber").select("l_orderkey", "l_linenumber", "representative", "folded")


@query("""
WITH c AS (SELECT user_id, round_even(value / 5, 0) AS cell, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT user_id, sum(c)::BIGINT AS n, max(c)::BIGINT AS biggest, round(max(c) / sum(c), 6) AS dup_share FROM c GROUP BY 1
""")
def duplicate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("value IS NOT NULL")
    return dedup.grid_share(rows, "user_id", "value", F.lit(5.0)).withColumn("dup_share", F.round("dup_share", 6))


@query("""
WITH up AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), down AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT k FROM up WHERE k NOT IN (SELECT k FROM down)
""")
def resume_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return dedup.ready(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), ["k"])


@query("""
WITH made AS (SELECT user_id, max(ts) AS m FROM events WHERE event_type = 'view' GROUP BY 1), done AS (SELECT user_id, max(ts) AS d FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, CASE WHEN d IS NULL THEN 'missing' ELSE 'older' END AS reason FROM made LEFT JOIN done USING (user_id) WHERE d IS NULL OR d < m
""")
def stale_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return dedup.stale(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"), ["user_id"], "ts")


@query("""
SELECT 'only_a' AS kind, count(*)::BIGINT AS n FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
UNION ALL SELECT 'both', count(*)::BIGINT FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
""")
def set_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    a, b = (orders.where(F.col("o_orderpriority") == p).select("o_custkey") for p in ("1-URGENT", "5-LOW"))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(a.subtract(b), "only_a").union(count(a.intersect(b), "both"))


@query("""
SELECT k, v, source_no FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_no) AS r FROM (
  SELECT s_suppkey AS k, s_name AS v, 0 AS source_no FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT c_custkey, c_name, 1 FROM customer)) WHERE r = 1
""")
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    b = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return joins.by_priority([a, b], ["k"])
