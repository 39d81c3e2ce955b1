"""Queries that filter scenes, segments, instances and variants, and say why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.operators import filters as P
from viaduct.operators import rules as R
from viaduct.plans.registry import query
from viaduct.sources.tables import load

ORDER = ["ts", "event_id"]


@query("""
WITH s AS (SELECT user_id, value AS x, event_id % 7 AS y, value - lag(value) OVER w AS dx, event_id % 7 - lag(event_id % 7) OVER w AS dy FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, bool_or(x IS NULL OR coalesce(greatest(abs(dx), abs(dy)) > 60, false) OR coalesce(sqrt(dx * dx + dy * dy) > 55, false) OR coalesce(sqrt(x * x + y * y) > 98, false)) AS teleport FROM s GROUP BY 1
""")
def teleports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("x"), (F.col("event_id") % 7).cast("double").alias("y"))
    return P.teleports(rows, "user_id", ORDER, ["x", "y"], 60, 55, 98)


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'no_price' WHEN o_totalprice < 20000 THEN 'too_small' WHEN o_orderstatus = 'P' THEN 'unsettled' WHEN month(o_orderdate) = 12 THEN 'late' ELSE 'ok' END AS reason FROM orders)
SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY 1
""")
def segment_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = R.first_reason({"no_price": F.col("o_totalprice").isNull(), "too_small": F.col("o_totalprice") < 20000, "unsettled": F.col("o_orderstatus") == "P", "late": F.month("o_orderdate") == 12})
    return load(spark, sf_dir, "orders").groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, [x FOR x IN [CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_totalprice > 200000 THEN 'dear' END] IF x IS NOT NULL] AS r FROM orders)
SELECT o_orderkey, array_to_string(r, ',') AS auto_reasons, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000) THEN '' ELSE array_to_string(r, ',') END AS reasons,
  len(r) = 0 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000) AS keep FROM r
""")
def override_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = R.reasons({"urgent": F.col("o_orderpriority") == "1-URGENT", "dear": F.col("o_totalprice") > 200000})
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), reasons.alias("reasons"))
    forced = load(spark, sf_dir, "customer").where("c_acctbal > 8000").select(F.col("c_custkey").alias("key"))
    out = P.overridden(rows, forced, "key", "reasons")
    return out.select("o_orderkey", F.array_join("auto_reasons", ",").alias("auto_reasons"), F.array_join("reasons", ",").alias("reasons"), "keep")


@query("""
SELECT p_partkey, array_to_string([x FOR x IN [CASE WHEN p_size < 10 THEN 'size ' || p_size || ' < 10' END, CASE WHEN p_retailprice > 1500 THEN 'price > 1500' END, CASE WHEN p_type = 'PROMO' THEN 'type PROMO' END] IF x IS NOT NULL], '; ') AS reasons FROM part
""")
def instance_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_compact(F.array(F.when(F.col("p_size") < 10, F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" < 10"))), F.when(F.col("p_retailprice") > 1500, F.lit("price > 1500")), F.when(F.col("p_type") == "PROMO", F.lit("type PROMO"))))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(found, "; ").alias("reasons"))


@query("""
SELECT CASE WHEN starts_with(o_orderpriority, '4') OR starts_with(o_orderpriority, '5') THEN 'status' WHEN list_has_any(string_split(o_orderstatus || '|' || CASE WHEN o_totalprice > 150000 THEN 'far' ELSE '' END, '|'), ['far', 'P']) THEN 'suspect' WHEN o_orderkey % 3 = 0 THEN 'unpicked'
  WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'not_listed' ELSE 'kept' END AS drop_reason, count(*)::BIGINT AS n FROM orders GROUP BY 1
""")
def variant_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status prefix, suspect token, picked and whitelist, in this order, with how many each drops."""
    listed = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("listed"))
    rows = load(spark, sf_dir, "orders").join(listed, "o_custkey", "left")
    suspect = F.concat(F.col("o_orderstatus"), F.lit("|"), F.when(F.col("o_totalprice") > 150000, "far").otherwise(""))
    checks = [("status", F.col("o_orderpriority").rlike("^[45]")), ("suspect", P.has_token(suspect, ["far", "P"])), ("unpicked", F.col("o_orderkey") % 3 == 0), ("not_listed", F.col("listed").isNull())]
    return rows.groupBy(P.first_drop(checks).alias("drop_reason")).agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string([x FOR x IN [CASE WHEN l_quantity > 45 THEN 'bulk' END, CASE WHEN l_discount >= 0.09 THEN 'cheap' END, CASE WHEN l_tax = 0 THEN 'free' END, CASE WHEN l_returnflag = 'R' THEN 'back' END, CASE WHEN l_extendedprice / l_quantity > 1800 THEN 'dear' END] IF x IS NOT NULL], '|') AS suspect FROM lineitem
""")
def suspect_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"bulk": F.col("l_quantity") > 45, "cheap": F.col("l_discount") >= 0.09, "free": F.col("l_tax") == 0, "back": F.col("l_returnflag") == "R", "dear": F.try_divide("l_extendedprice", "l_quantity") > 1800}
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", P.tagged(rules).alias("suspect"))


@query("""
SELECT l_returnflag, count(*)::BIGINT AS n, count_if(coalesce(l_discount > 0.07, false) OR coalesce(l_tax > 0.06, false))::BIGINT AS over FROM lineitem GROUP BY 1
""")
def split_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = P.over_budget(F.col("l_discount"), F.col("l_tax"), 0.07, 0.06)
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(over).alias("over"))


@query("""
SELECT doc_id, CASE WHEN NOT coalesce(n_chars >= 200, false) THEN 'length' WHEN NOT coalesce(lang IN ('en', 'fr', 'de'), false) THEN 'lang' WHEN NOT coalesce(length(text) - length(replace(text, '.', '')) > 2, false) THEN 'sentences' END AS failed FROM documents
""")
def gates_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = F.length("text") - F.length(F.replace(F.col("text"), F.lit("."), F.lit(""))) > 2
    return load(spark, sf_dir, "documents").select("doc_id", P.gates([("length", F.col("n_chars") >= 200), ("lang", F.col("lang").isin("en", "fr", "de")), ("sentences", sentences)]).alias("failed"))


@query("""
WITH v AS (SELECT event_type AS metric, user_id, avg(value) AS value FROM events GROUP BY 1, 2), l(metric, warn, fail) AS (VALUES ('click', 48.0, 60.0), ('error', 40.0, 52.0), ('view', 50.0, 51.0))
SELECT metric, user_id, CASE WHEN value IS NULL OR fail IS NULL THEN 'NONE' WHEN value > fail THEN 'FAIL' WHEN value > warn THEN 'WARN' ELSE 'PASS' END AS grade FROM v LEFT JOIN l USING (metric)
""")
def metric_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([("click", 48.0, 60.0), ("error", 40.0, 52.0), ("view", 50.0, 51.0)], "metric string, warn double, fail double")
    values = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), "user_id").agg(P.steady_mean("value").alias("value"))
    return P.graded(values, limits, "metric", "value").select("metric", "user_id", "grade")


@query("""
SELECT count(*)::BIGINT AS "all", count_if(p_type = 'ECONOMY')::BIGINT AS aimed, count_if(p_type = 'ECONOMY' AND NOT regexp_matches(p_name, '^(small|red)'))::BIGINT AS aimed_nontrack FROM part
""")
def framing_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    aim = F.when(F.col("p_type") == "ECONOMY", "look_at").otherwise("free")
    preset = F.regexp_replace("p_name", "^(small|red)", "track_")
    return load(spark, sf_dir, "part").agg(*[F.count_if(P.framing_scope(aim, preset, s)).alias(s) for s in ("all", "aimed", "aimed_nontrack")])


@query("""
SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') AND p_brand NOT IN ('Brand#2') AND NOT starts_with(p_name, 'small')
""")
def preset_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return rows.where(P.preset_filter(F.col("p_brand"), ["Brand#1", "Brand#2", "Brand#3", "Brand#4"], ["Brand#2"]) & P.preset_filter(F.col("p_name"), prefixes=["small"])).select("p_partkey", "p_brand")


@query("""
WITH s AS (SELECT user_id, count(*) AS n, user_id % 5 AS s, 40 + user_id % 40 AS e FROM events GROUP BY 1) SELECT user_id, s::BIGINT AS s, e::BIGINT AS e, e <= n AND e - s >= 49 AND s >= 2 AS usable FROM s
""")
def usable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumns({"s": F.col("user_id") % 5, "e": 40 + F.col("user_id") % 40})
    return rows.select("user_id", "s", "e", P.usable_segment(F.col("s"), F.col("e"), F.col("n"), 49, 2).alias("usable"))


@query("""
WITH s AS (SELECT DISTINCT user_id, 10 + user_id % 20 AS s, 30 + user_id % 20 AS e FROM events), c AS (SELECT user_id, event_id % 60 AS i FROM events WHERE event_type = 'click')
SELECT user_id, s, e, count_if(i >= s AND i < e)::BIGINT AS inside, count_if(i < s)::BIGINT AS before, count_if(i >= e)::BIGINT AS after FROM s LEFT JOIN c USING (user_id) GROUP BY 1, 2, 3
""")
def context_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    segments = events.select("user_id").distinct().withColumns({"s": 10 + F.col("user_id") % 20, "e": 30 + F.col("user_id") % 20})
    return P.leaks(segments, events.where("event_type = 'click'").select("user_id", (F.col("event_id") % 60).alias("i")), "user_id", "i")


@query("""
SELECT p_partkey, array_to_string([x FOR x IN regexp_split_to_array(lower(regexp_replace(regexp_replace(replace(p_name, ' ', 'Inner') || '.0' || p_size, '\\.[0-9]+$', ''), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z]+') IF x <> ''], ',') AS tokens,
  list_has_any(regexp_split_to_array(lower(regexp_replace(regexp_replace(replace(p_name, ' ', 'Inner') || '.0' || p_size, '\\.[0-9]+$', ''), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z]+'), ['small', 'bolt']) AS surface FROM part
""".replace("\\\\", "\\"))
def surface_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("Inner")), F.lit(".0"), F.col("p_size").cast("string"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(P.label_tokens(label), ",").alias("tokens"), P.is_surface(label, ["small", "bolt"]).alias("surface"))


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(trim(p_name)) ORDER BY p_partkey) > 1 AS again FROM part),
 b AS (SELECT *, CASE WHEN again THEN 'duplicate' WHEN p_size > 40 THEN 'dynamic' WHEN list_has_any(regexp_split_to_array(lower(p_name), '[^a-z]+'), ['ring']) THEN 'surface' END AS early FROM a)
SELECT p_partkey, coalesce(early, CASE WHEN sum(CASE WHEN early IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) > 3 THEN 'over_cap' END) AS reason FROM b
""")
def noun_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    return P.selected_nouns(rows, "p_brand", "p_name", "p_partkey", F.col("p_size") > 40, ["ring"], 3).select("p_partkey", "reason")


@query("""
SELECT l_linestatus, count(*)::BIGINT AS n, count_if(greatest(l_quantity, l_discount * 100, l_tax * 100) >= 8 AND least(l_quantity, l_discount * 100, l_tax * 100) / greatest(l_quantity, l_discount * 100, l_tax * 100) < 0.1)::BIGINT AS flat FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL GROUP BY 1
""")
def flat_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").where("l_discount IS NOT NULL AND l_tax IS NOT NULL")
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_if(P.is_flat([F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100], 0.1, 8)).alias("flat"))


@query("""
WITH t AS (SELECT user_id, value, coalesce(value > 20, false) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
 g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) - 1 AS gap FROM t WHERE v), m AS (SELECT user_id, median(value) AS m FROM g GROUP BY 1),
 a AS (SELECT user_id, coalesce(max(gap), 0) AS gap, min(t) AS a, max(t) AS b, avg(CASE WHEN value < m / 2 THEN 1 ELSE 0 END) AS occluded FROM g JOIN m USING (user_id) GROUP BY 1), n AS (SELECT user_id, count(*) AS n FROM t GROUP BY 1)
SELECT user_id, gap::BIGINT AS gap, coalesce(greatest(a, n - 1 - b), n)::BIGINT AS edge, round(occluded, 6) AS occluded, coalesce(gap <= 4 AND greatest(a, n - 1 - b) <= 3 AND occluded <= 0.15, false) AS ok FROM n LEFT JOIN a USING (user_id)
""")
def subject_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", F.coalesce(F.col("value") > 20, F.lit(False)).alias("visible"))
    return P.continuous(rows, "user_id", ORDER, "visible", "value", 4, 3, 0.15).withColumn("occluded", F.round("occluded", 6))


@query("""
WITH r AS (SELECT l_suppkey, max(l_extendedprice) - min(l_extendedprice) AS reach FROM lineitem GROUP BY 1) SELECT l_suppkey, round(reach, 6) AS reach FROM r WHERE reach >= 0.97 * (SELECT median(reach) FROM r)
""")
def static_entries_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("reach"))
    return P.moving_only(per, "l_suppkey", "reach", 0.97).withColumn("reach", F.round("reach", 6))


@query("""
SELECT o_orderkey FROM orders LEFT JOIN (SELECT c_custkey, c_acctbal > 2000 AS moving FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey WHERE NOT (starts_with(o_orderpriority, '1') AND NOT coalesce(moving, true))
""")
def still_tracks_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    moving = load(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 2000).alias("moving"))
    rows = load(spark, sf_dir, "orders").withColumn("preset", F.regexp_replace("o_orderpriority", "^1", "track"))
    return rows.join(moving, "o_custkey", "left").where(P.follows_something(F.col("preset"), F.col("moving"))).select("o_orderkey")


@query("""
SELECT event_type, b AS box, round(avg(CASE WHEN coalesce(abs(value / 100 - 0.5) <= b / 2 AND abs((event_id % 100) / 100 - 0.5) <= b / 2, false) THEN 1 ELSE 0 END), 6) AS ratio FROM events, (VALUES (0.4::DOUBLE), (0.8::DOUBLE)) v(b) GROUP BY 1, 2
""")
def in_box_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = [0.4, 0.8]
    x, y = F.col("value") / 100, (F.col("event_id") % 100) / 100
    wide = load(spark, sf_dir, "events").groupBy("event_type").agg(*[F.round(P.hit_ratio(x, y, b), 6).alias(f"r{i}") for i, b in enumerate(boxes)])
    return wide.select("event_type", F.inline(F.array(*[F.struct(F.lit(b).alias("box"), F.col(f"r{i}").alias("ratio")) for i, b in enumerate(boxes)])))


@query("""
SELECT event_id, round(greatest(coalesce(value, user_id / 2.0), 1.5), 6) AS scale, value IS NULL AS borrowed, round(event_id / nullif(greatest(coalesce(value, user_id / 2.0), 1.5), 0), 6) AS divided FROM events
""")
def fallback_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale, borrowed = P.with_fallback(F.col("value"), F.col("user_id") / 2.0, 1.5)
    rows = load(spark, sf_dir, "events").select("event_id", scale.alias("scale"), borrowed.alias("borrowed"))
    return rows.select("event_id", F.round("scale", 6).alias("scale"), "borrowed", F.round(F.col("event_id") / F.nullif(F.col("scale"), F.lit(0.0)), 6).alias("divided"))


@query("""
WITH c(p_type, is_static) AS (VALUES ('ECONOMY', true), ('PROMO', true), ('STANDARD', false))
SELECT p_partkey, coalesce(is_static, false) AND NOT p_retailprice > 1200 AND NOT coalesce(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'), false) AS static FROM part LEFT JOIN c USING (p_type)
""")
def demoted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = spark.createDataFrame([("ECONOMY", True), ("PROMO", True), ("STANDARD", False)], "p_type string, is_static boolean")
    tracked = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("tracked", F.lit(True))
    nodes = load(spark, sf_dir, "part").join(tracked, "p_partkey", "left")
    return P.demoted(nodes, categories, "p_type", F.col("p_retailprice") > 1200, F.col("tracked")).select("p_partkey", "static")


@query("""
SELECT user_id, round(coalesce(sum(CASE WHEN event_type = 'error' THEN value END) / sum(value), 0), 6) AS share, coalesce(sum(CASE WHEN event_type = 'error' THEN value END) / sum(value), 0) > 0.2 AS "drop" FROM events GROUP BY 1
""")
def dynamic_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "value", F.when(F.col("event_type") == "error", F.col("value")).alias("inside"))
    return P.overlap_share(rows, "user_id", "inside", "value", 0.2).withColumn("share", F.round("share", 6))


@query("""
SELECT event_id, (json_extract(props, '$.k') > 50) IS TRUE AS high, json_extract(props, '$.missing.deeper') IS NULL AS absent FROM events
""")
def nested_getter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path into nested JSON; any missing step gives null."""
    get = lambda path: F.get_json_object("props", path)
    return load(spark, sf_dir, "events").select("event_id", F.coalesce(get("$.k").cast("long") > 50, F.lit(False)).alias("high"), get("$.missing.deeper").isNull().alias("absent"))
