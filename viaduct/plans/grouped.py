"""Queries with steps that are sequential within a group; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.operators import grouped as G
from viaduct.plans.registry import query
from viaduct.sources.tables import load


@query()
def viterbi_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers smoothed over turns: a change is cheap after a question."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.coalesce(F.lag(F.col("text").endswith("?")).over(w), F.lit(False))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", 1.0).otherwise(-1.0).alias("evidence"), F.when(asked, 0.15).otherwise(0.9).alias("penalty"))
    return G.viterbi_turns(rows, "conv_id", "turn", "evidence", "penalty")


@query()
def activity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.coalesce((F.col("value") > 50).cast("int"), F.lit(0)).alias("active"))
    return G.activity_windows(rows, "user_id", ["ts", "event_id"], "active", 8, 0.5)


@query("""
WITH k AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT n, count(*) AS c, n * count(*) AS mass FROM k GROUP BY 1)
SELECT n::BIGINT AS per_scene, c::BIGINT AS scenes, round_even(200 * mass / (SELECT sum(mass) FROM m) / n, 0)::BIGINT AS quota FROM m
""")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many scenes of each size to hold out for 200 members in proportion."""
    sizes = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("per_scene")).groupBy("per_scene").agg(F.count("*").alias("scenes"))
    total = sizes.agg(F.sum(F.col("per_scene") * F.col("scenes")).alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select("per_scene", "scenes", F.bround(F.lit(200) * (F.col("per_scene") * F.col("scenes")) / F.col("total") / F.col("per_scene")).cast("long").alias("quota"))


@query("""
WITH f AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events WHERE value IS NOT NULL)
SELECT user_id, s::BIGINT AS start, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM (SELECT user_id, value, t, unnest(range(greatest(0, ((t - 9 + 4) // 5)) * 5, t + 1, 5)) AS s FROM f) GROUP BY 1, 2 HAVING count(*) = 10
""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten frames every five: each frame goes to the windows that it is in."""
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = load(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", "value", t.alias("t"))
    last = F.floor(F.col("t") / 5) * 5
    each = rows.withColumn("start", F.explode(F.filter(F.array(last, last - 5), lambda s: s >= 0)))
    return each.groupBy("user_id", "start").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).where("n = 10")


@query("""
SELECT user_id, count(*)::BIGINT AS n, round(max(ts_gap), 3) AS longest_silence FROM (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ts_gap FROM events) GROUP BY 1
""")
def silence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    gap = at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, sf_dir, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("gap"), 3).alias("longest_silence"))


@query("""
SELECT time_bucket(INTERVAL '6 hours', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2
""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream of events counts in windows of six hours, run as a batch."""
    from viaduct.streaming.rounds import windowed

    return windowed(load(spark, sf_dir, "events").select("ts", "event_type"), "ts", "6 hours", "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))
