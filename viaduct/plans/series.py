"""Queries over entries as time series: a user is an entry, its events are the frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators import windows as W
from viaduct.plans.registry import query
from viaduct.sources.tables import load

ORDER = ["ts", "event_id"]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", "ts", "event_id", "value", "event_type")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("""
WITH s AS (SELECT user_id, value, abs(value - lag(value) OVER w) AS s, abs(value - first_value(value) OVER w) AS r FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*)::BIGINT AS n, round(sum(s), 6) AS path, round(max(r), 6) AS reach, round(max(s) / greatest(median(s), 1e-12), 6) AS jump_ratio, round(max(s) / greatest(sum(s), 1e-12), 6) AS max_of_path, round(max(s) / greatest(max(value) - min(value), 1e-12), 6) AS max_of_extent
FROM s GROUP BY 1 HAVING count(*) > 1
""")
def path_reach_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.jumps(frames(spark, sf_dir), "user_id", ORDER, "value"), "path", "reach", "jump_ratio", "max_of_path", "max_of_extent")


@query("""
WITH j AS (SELECT user_id, abs(lead(value, 3) OVER w - 3 * lead(value, 2) OVER w + 3 * lead(value, 1) OVER w - value) AS j FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(j)::BIGINT AS n, round(avg(j), 6) AS jerk FROM j GROUP BY 1 HAVING count(j) > 0
""")
def jerk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.jerk(frames(spark, sf_dir), "user_id", ORDER, "value"), "jerk")


@query("""
SELECT user_id, third::INTEGER AS third, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM (SELECT user_id, value, ntile(3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS third FROM events WHERE value IS NOT NULL) GROUP BY 1, 2
""")
def thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.thirds(frames(spark, sf_dir), "user_id", ORDER, "value"), "mean")


@query("""
WITH t AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / nullif(count(*) OVER (PARTITION BY user_id) - 1, 0) AS t FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*)::BIGINT AS n, round(regr_slope(value, t), 6) AS slope FROM t GROUP BY 1 HAVING count(*) > 1
""")
def regr_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.slope(frames(spark, sf_dir), "user_id", ORDER, "value"), "slope")


@query("""
WITH c AS (SELECT user_id, event_type, row_number() OVER w - 1 AS frame, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM c)
SELECT user_id, run::BIGINT AS run, event_type, count(*)::BIGINT AS length, min(frame)::INTEGER AS first, max(frame)::INTEGER AS last FROM r GROUP BY 1, 2, 3
""")
def runs_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.runs(frames(spark, sf_dir), "user_id", ORDER, "event_type")


@query("""
WITH f AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
 c AS (SELECT a.user_id, a.event_id, b.event_type, count(*) AS c FROM f a JOIN f b ON a.user_id = b.user_id AND abs(a.i - b.i) <= 3 GROUP BY 1, 2, 3)
SELECT user_id, event_id, event_type AS smooth FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY c DESC, event_type) AS r FROM c) WHERE r = 1
""")
def mode_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.smooth_labels(frames(spark, sf_dir), "user_id", ORDER, "event_type", 3).select("user_id", "event_id", "smooth")


@query("""
WITH f AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 7 AS segment FROM events WHERE value IS NOT NULL)
SELECT user_id, segment::BIGINT AS segment, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, max(value) AS max FROM f GROUP BY 1, 2 HAVING count(*) = 7
""")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.tumbling(frames(spark, sf_dir), "user_id", ORDER, "value", 7), "mean")


@query("""
WITH f AS (SELECT user_id, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s,
  first_value(value) OVER w AS a, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round((s + greatest(0, 3 - i) * a + greatest(0, 2 - (n - i)) * z) / 5, 6) AS smooth FROM f
""")
def padded_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.padded_mean(frames(spark, sf_dir), "user_id", ORDER, "value", 2).select("user_id", "event_id", "smooth"), "smooth")


@query("""
WITH f AS (SELECT user_id, event_type = 'view' AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*)::BIGINT AS n, (min(t) FILTER (v))::INTEGER AS first, (max(t) FILTER (v))::INTEGER AS last, round(count_if(v) / count(*), 6) AS share, coalesce(max(t) FILTER (v) - min(t) FILTER (v) + 1 - count_if(v), 0)::BIGINT AS gap_frames FROM f GROUP BY 1
""")
def visibility_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("visible", F.col("event_type") == "view")
    return rounded(W.visibility(rows, "user_id", ORDER, "visible"), "share")


@query("""
SELECT s, e, n, CASE WHEN s >= n - e THEN 0 ELSE e END AS context_start, CASE WHEN s >= n - e THEN s ELSE n END AS context_end FROM (
  SELECT (l_linenumber * 7 % 40)::BIGINT AS s, (l_linenumber * 7 % 40 + 9)::BIGINT AS e, (60 + l_partkey % 10)::BIGINT AS n FROM lineitem)
""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_linenumber") * 7 % 40
    rows = load(spark, sf_dir, "lineitem").select(s.cast("long").alias("s"), (s + 9).cast("long").alias("e"), (F.col("l_partkey") % 10 + 60).alias("n"))
    return W.context_side(rows).withColumns({c: F.col(c).cast("long") for c in ("context_start", "context_end")})


@query()
def short_run_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential within an entry; tests compare it with brute force."""
    return W.shortened(frames(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), "user_id", ORDER, "event_type", 2).select("user_id", "event_id", "steady")
