"""Queries that report spreads, shares, folds and resampled statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.operators import statistics as S
from viaduct.plans.aggregates import rounded
from viaduct.plans.registry import query
from viaduct.sources.tables import load

ORDER = ["ts", "event_id"]


@query("""
SELECT c_mktsegment, round(stddev_pop(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END), 6) AS log_sd, count(*)::BIGINT AS n FROM customer GROUP BY 1
""")
def log_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(S.log_spread("c_acctbal"), 6).alias("log_sd"), F.count("*").alias("n"))


@query("""
SELECT l_returnflag, count(*)::BIGINT AS n, count_if(l_linestatus = 'O')::BIGINT AS open, count_if(l_discount > 0.05)::BIGINT AS cheap, count_if(l_linestatus = 'O' AND l_discount > 0.05)::BIGINT AS both FROM lineitem GROUP BY 1
""")
def conditional_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_, cheap = F.col("l_linestatus") == "O", F.col("l_discount") > 0.05
    return S.conditional_crosstab(load(spark, sf_dir, "lineitem"), "l_returnflag", {"open": open_, "cheap": cheap, "both": open_ & cheap})


@query("""
SELECT coalesce(l_returnflag, 'all') AS flag, count(DISTINCT l_suppkey)::BIGINT AS suppliers, count(DISTINCT l_partkey)::BIGINT AS parts FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())
""")
def distinct_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = load(spark, sf_dir, "lineitem").rollup("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))
    return counted.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), "suppliers", "parts")


@query("""
WITH p AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) SELECT user_id, count(*)::BIGINT AS arms, round((max(v) - min(v)) / avg(v), 6) AS spread FROM p GROUP BY 1
""")
def relative_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.relative_range(load(spark, sf_dir, "events"), "user_id", "event_type", "value"), "spread")


@query("""
SELECT lang, count(*)::BIGINT AS chunks, sum(n_chars)::BIGINT AS frames, round(sum(n_chars) / (SELECT sum(n_chars) FROM documents), 6) AS share FROM documents GROUP BY 1
""")
def vocabulary_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.weighted_share(load(spark, sf_dir, "documents"), "lang", "n_chars"), "share")


@query("""
WITH d AS (SELECT t AS trial, md5('half|' || t || '|' || c_custkey)[1] < '8' AS l, c_acctbal AS v FROM customer, range(1, 201) r(t)) SELECT trial::INTEGER AS trial, round(abs(avg(CASE WHEN l THEN v END) - avg(CASE WHEN NOT l THEN v END)), 4) AS difference FROM d GROUP BY 1
""")
def half_split_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.half_splits(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 200).withColumn("difference", F.round("difference", 4))


@query("""
WITH v AS (SELECT l_linestatus, CASE WHEN l_quantity = 13 THEN NULL ELSE l_extendedprice / l_quantity END AS v FROM lineitem) SELECT l_linestatus, count(v)::BIGINT AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, count_if(v IS NULL)::BIGINT AS missing FROM v GROUP BY 1
""")
def nan_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("l_quantity") == 13, float("nan")).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
    return rounded(S.nan_aware(load(spark, sf_dir, "lineitem").select("l_linestatus", v.alias("v")), "l_linestatus", "v"), "mean", "median")


@query("""
WITH p AS (SELECT o_orderstatus, o_custkey, count(*) AS per_scene FROM orders GROUP BY 1, 2) SELECT o_orderstatus, per_scene::BIGINT AS per_scene, count(*)::BIGINT AS scenes FROM p GROUP BY 1, 2
""")
def split_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.histogram_of_counts(load(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")


@query("""
WITH p(pattern, r) AS (VALUES ('links', 'href="[^"]+"'), ('scripts', '<script'), ('numbers', '[0-9]+')), m AS (SELECT pattern, len(regexp_extract_all(html, r)) AS m FROM pages, p)
SELECT pattern, count_if(m > 0)::BIGINT AS lines, sum(m)::BIGINT AS matches FROM m GROUP BY 1
""")
def line_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tally(load(spark, sf_dir, "pages"), "html", {"links": 'href="[^"]+"', "scripts": "<script", "numbers": "[0-9]+"})


@query("""
SELECT l_suppkey, round(sum(l_discount::DECIMAL(18,4))::DOUBLE / count(l_discount), 6) AS score, count(DISTINCT l_shipdate)::BIGINT AS frames, round(sum(l_quantity::DECIMAL(18,4))::DOUBLE / count(l_quantity), 6) AS mean_area, max(l_quantity) AS max_area FROM lineitem GROUP BY 1
""")
def track_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.track_summary(load(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount", "l_shipdate", "l_quantity"), "score", "mean_area")


@query("""
SELECT p_brand, p_size, count(*)::BIGINT AS n, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1, 2
""")
def folded_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that share a knob are folded into their mean."""
    return load(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"))


@query("""
WITH r AS (SELECT user_id AS g, event_id AS i, value * 3.6 AS a FROM events WHERE event_type = 'error' AND value IS NOT NULL), p AS (SELECT x.g, x.i, y.i AS o, y.a, abs((((x.a - y.a + 180) % 360) + 360) % 360 - 180) AS d FROM r x JOIN r y USING (g)),
 m AS (SELECT g, i, median(d) AS m, max(d) AS w FROM p GROUP BY 1, 2), c AS (SELECT g, arg_min(i, struct_pack(m := m, i := i)) AS i, max(w) AS widest, count(*) AS n FROM m GROUP BY 1),
 k AS (SELECT p.g, p.a, widest, n, row_number() OVER (PARTITION BY p.g ORDER BY d, o) AS r FROM p JOIN c ON p.g = c.g AND p.i = c.i)
SELECT g AS user_id, count(*)::BIGINT AS kept, round(degrees(atan2(avg(sin(radians(a))), avg(cos(radians(a))))), 5) AS direction, round(any_value(widest), 6) AS widest FROM k WHERE r <= ceil(n * 0.75) GROUP BY 1
""")
def trimmed_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("event_type = 'error' AND value IS NOT NULL").select("user_id", "event_id", (F.col("value") * 3.6).alias("a"))
    return S.trimmed_direction(rows, "user_id", "event_id", "a", 0.75).withColumns({"direction": F.round("direction", 5), "widest": F.round("widest", 6)})


@query("""
SELECT coalesce(o_orderstatus, 'all') AS arm, coalesce(o_orderpriority, 'all') AS slice, count(*)::BIGINT AS n, round(avg(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END), 6) AS collided, round(avg(CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END), 6) AS occluded FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
def collision_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_totalprice") > 200000).alias("collided"), (F.month("o_orderdate") < 4).alias("occluded"))
    out = S.rates(rows, "o_orderstatus", "o_orderpriority", ["collided", "occluded"])
    return rounded(out.select(F.coalesce("o_orderstatus", F.lit("all")).alias("arm"), F.coalesce("o_orderpriority", F.lit("all")).alias("slice"), "n", "collided", "occluded"), "collided", "occluded")


@query("""
SELECT event_type, coalesce(user_id % 5, -1)::BIGINT AS scene, count(*)::BIGINT AS n, round(avg(CASE WHEN coalesce(abs(value - 50) <= 20, false) THEN 1 ELSE 0 END), 6) AS r20, round(avg(CASE WHEN coalesce(abs(value - 50) <= 40, false) THEN 1 ELSE 0 END), 6) AS r40 FROM events GROUP BY GROUPING SETS ((event_type), (event_type, user_id % 5))
""")
def slice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share within each box, overall and per scene; a missing value is a miss."""
    rows = load(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("scene"), "value")
    near = lambda d: F.round(F.avg(F.coalesce(F.abs(F.col("value") - 50) <= d, F.lit(False)).cast("int")), 6)
    out = rows.groupingSets([["event_type"], ["event_type", "scene"]], "event_type", "scene").agg(F.count("*").alias("n"), near(20).alias("r20"), near(40).alias("r40"))
    return out.withColumn("scene", F.coalesce("scene", F.lit(-1).cast("long")))


@query("""
WITH p AS (SELECT event_type, user_id, median(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, count(*)::BIGINT AS entries, round(avg(m), 6) AS mean_of_medians, round(median(m), 6) AS median_of_medians FROM p GROUP BY 1
""")
def median_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.median_of_medians(load(spark, sf_dir, "events"), "event_type", "user_id", "value"), "mean_of_medians", "median_of_medians")


@query("""
WITH p AS (SELECT o_custkey, string_agg(o_orderstatus, '|' ORDER BY o_orderdate, o_orderkey) AS s, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY 1) SELECT count(*)::BIGINT AS entries, count(DISTINCT s)::BIGINT AS signatures, round(avg(CASE WHEN k <= 1 THEN 1 ELSE 0 END), 6) AS constant_share FROM p
""")
def tag_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.signature_counts(load(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus"), "constant_share")


@query("""
WITH s AS (SELECT user_id, ts, event_id, value, abs(value - lag(value) OVER w) AS step, first_value(value) OVER w AS f, row_number() OVER w AS i FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 a AS (SELECT user_id, coalesce(sum(step), 0) AS path, abs(arg_max(value, i) - arg_min(value, i)) AS chord, max(abs(value - f)) AS reach FROM s GROUP BY 1)
SELECT user_id, round(path, 6) AS path, round(chord, 6) AS chord, round(reach, 6) AS reach, round(CASE WHEN path = 0 THEN 0 ELSE chord / path END, 6) AS straightness FROM a
""")
def straightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.straightness(load(spark, sf_dir, "events").where("value IS NOT NULL"), "user_id", ORDER, "value"), "path", "chord", "reach", "straightness")


@query("""
SELECT l_returnflag, count(*)::BIGINT AS n, round(CASE WHEN count(*) > 10 THEN corr(ln(l_quantity), ln(l_discount)) END, 6) AS r FROM lineitem WHERE l_quantity > 0 AND l_discount > 0 GROUP BY 1
""")
def log_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.log_correlation(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_discount"), "r")


@query("""
WITH l AS (SELECT l_returnflag, l_linestatus, unnest(['l_quantity', 'l_partkey']) AS divisor, unnest([l_extendedprice / nullif(l_quantity, 0), l_extendedprice / nullif(l_partkey, 0)]) AS q FROM lineitem)
SELECT l_returnflag, coalesce(l_linestatus, 'all') AS subset, divisor, count(*)::BIGINT AS n, round(avg(q), 5) AS mean, round(median(q), 5) AS median FROM l WHERE q IS NOT NULL GROUP BY GROUPING SETS ((l_returnflag, divisor), (l_returnflag, l_linestatus, divisor))
""")
def divisor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.divisor_blocks(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", ["l_quantity", "l_partkey"])
    return out.select("l_returnflag", F.coalesce("l_linestatus", F.lit("all")).alias("subset"), "divisor", "n", F.round("mean", 5).alias("mean"), F.round("median", 5).alias("median"))


@query("""
WITH r AS (SELECT user_id AS s, event_type AS t, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), event_type) AS g FROM events), u AS (SELECT s, t AS c, count(*) AS n, sum(CASE WHEN t = g THEN 1 ELSE 0 END) AS tp FROM r GROUP BY 1, 2), v AS (SELECT s, g AS c, count(*) AS g FROM r GROUP BY 1, 2),
 e AS (SELECT s, n, tp, tp / greatest(coalesce(g, 0)::DOUBLE, 1e-9) AS p, tp / greatest(n::DOUBLE, 1e-9) AS r FROM u LEFT JOIN v USING (s, c))
SELECT s AS user_id, round(sum(p * n) / sum(n), 6) AS precision, round(sum(r * n) / sum(n), 6) AS recall, round(sum(2 * p * r / greatest(p + r, 1e-9) * n) / sum(n), 6) AS f1, sum(tp) = sum(n) AS exact FROM e GROUP BY 1
""")
def sample_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    rows = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("truth"), F.coalesce(F.lag("event_type").over(w), "event_type").alias("guess"))
    return rounded(S.support_prf(rows, "user_id", "truth", "guess"), "precision", "recall", "f1")


@query("""
SELECT o_orderstatus, o_orderpriority, round(avg(date_diff('day', DATE '1992-01-01', o_orderdate::DATE)), 6) AS mean_days, count(DISTINCT o_custkey)::BIGINT AS variants FROM orders GROUP BY 1, 2
""")
def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.round(F.avg(days), 6).alias("mean_days"), F.count_distinct("o_custkey").alias("variants"))


@query("""
SELECT l_suppkey, count(*)::BIGINT AS n, round(stddev_pop(l_extendedprice) / avg(l_extendedprice), 6) AS cv, round(max(l_extendedprice) / min(l_extendedprice), 6) AS ratio, round(stddev_pop(log10(l_extendedprice)), 6) AS log_sd, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75 FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1 HAVING count(*) >= 2
""")
def clip_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.spread_table(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice"), "cv", "ratio", "log_sd", "p25", "p75")


_SHAPE = "s AS (SELECT event_type AS preset, event_id % 12 AS place, avg(value) AS m, var_pop(value) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"


@query(f"""
WITH {_SHAPE} SELECT preset, round(sqrt(sum(v * n) / sum(n)), 6) AS within FROM s GROUP BY 1
""")
def preset_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("preset"), (F.col("event_id") % 12).alias("place"), "value")
    return rounded(S.taxonomy(rows, "preset", "place", "value")[0], "within")


@query(f"""
WITH {_SHAPE} SELECT x.preset AS a, y.preset AS b, round(sqrt(avg((x.m - y.m) ** 2)), 6) AS between FROM s x JOIN s y ON x.place = y.place AND x.preset < y.preset GROUP BY 1, 2
""")
def preset_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("preset"), (F.col("event_id") % 12).alias("place"), "value")
    return rounded(S.taxonomy(rows, "preset", "place", "value")[1], "between")
