"""Queries over records, rule versions and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.operators import records as C
from viaduct.plans.cameras import SEGMENT
from viaduct.plans.registry import query
from viaduct.sources.tables import load

#: A first set of rules, one that is stricter, one without the lower bound, and one that no longer asks for the language.
VERSIONS = {"v1": {"least": 200, "most": 20_000, "digits": 0.2, "lang": True}, "v2": {"from": "v1", "most": 5_000, "digits": 0.05}, "v3": {"from": "v2", "least": 0}, "v4": {"from": "v3", "lang": False}}


def _rules(th: dict) -> dict:
    digits = F.regexp_count("text", F.lit("[0-9]")) / F.greatest(F.length("text"), F.lit(1))
    out = {"too_long": F.length("text") > th["most"], "digits": digits > th["digits"]}
    if th["least"]:
        out = {"too_short": F.length("text") < th["least"]} | out
    return out | ({"no_lang": F.col("lang").isNull()} if th["lang"] else {})


def _rules_sql() -> str:
    parts = []
    for name, th in (("v1", (200, 20000, 0.2, True)), ("v2", (200, 5000, 0.05, True)), ("v3", (0, 5000, 0.05, True)), ("v4", (0, 5000, 0.05, False))):
        least, most, digits, lang = th
        tests = ({"too_short": f"n < {least}"} if least else {}) | {"too_long": f"n > {most}", "digits": f"d > {digits}::DOUBLE"} | ({"no_lang": "lang IS NULL"} if lang else {})
        tests["kept"] = " AND ".join(f"NOT coalesce({t}, false)" for t in tests.values())
        parts += [f"SELECT '{name}' AS version, '{reason}' AS reason, count_if({t})::BIGINT AS n FROM x" for reason, t in tests.items()]
    return "WITH x AS (SELECT length(text) AS n, length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1) AS d, lang FROM documents) " + " UNION ALL ".join(parts)


@query(_rules_sql())
def rule_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each rule of each version rejects, and how many each version keeps."""
    return C.version_counts(load(spark, sf_dir, "documents").select("text", "lang"), VERSIONS, _rules)


@query("""
SELECT user_id, coalesce(arg_max(event_type, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'click'), arg_min(event_type, struct_pack(a := ts, b := event_id))) AS event_type, coalesce(arg_max(event_id, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'click'), arg_min(event_id, struct_pack(a := ts, b := event_id))) AS event_id FROM events GROUP BY 1
""")
def preferred_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user the last click, or else the first event of all."""
    return C.preferred(load(spark, sf_dir, "events"), "user_id", "event_type", "click", ["ts", "event_id"], ["event_id"])


@query("""
WITH h AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), '+') AS combination FROM lineitem GROUP BY 1) SELECT combination, count(*)::BIGINT AS n FROM h GROUP BY 1
""")
def member_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which return flags occur together in orders."""
    return C.combinations(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("""
WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), h AS (SELECT o_custkey, any_value(n) AS n, list(o_totalprice::DOUBLE ORDER BY r) AS v FROM r WHERE r <= 8 GROUP BY 1)
SELECT o_custkey, list_concat(v, list_transform(range(8 - len(v)), lambda i: 0.0::DOUBLE)) AS values, list_transform(range(8), lambda i: i < len(v)) AS mask, n FROM h
""")
def padded_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight orders of each customer, filled up, with a mask."""
    return C.padded(load(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 8)


@query("""
WITH t AS (SELECT l_suppkey AS scene, l_orderkey % 40 AS frame, l_linenumber AS track, min(l_quantity)::DOUBLE AS cx, CASE WHEN l_linenumber < 5 OR l_orderkey % 40 < 20 THEN max(l_extendedprice) ELSE 0 END AS area, min(l_tax) AS depth FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT a.scene, a.track, b.track AS other, count(*) AS shared, avg(CASE WHEN a.cx < b.cx THEN 1 ELSE 0 END) AS l, avg(CASE WHEN a.area > b.area THEN 1 ELSE 0 END) AS g, avg(CASE WHEN a.depth < b.depth THEN 1 ELSE 0 END) AS n, median(a.area / greatest(b.area, 1e-9)) AS r FROM t a JOIN t b ON a.scene = b.scene AND a.frame = b.frame AND a.track <> b.track AND a.area > 0 AND b.area > 0 GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT scene, track FROM t), q AS (SELECT x.scene, x.track, y.track AS other FROM k x JOIN k y ON x.scene = y.scene AND x.track <> y.track)
SELECT scene, track, other, coalesce(shared, 0)::BIGINT AS shared, CASE WHEN shared IS NULL THEN ['- it never appears at the same time as thing ' || other] ELSE [
 '- it is to the ' || CASE WHEN l >= 0.5 THEN 'LEFT' ELSE 'RIGHT' END || ' of thing ' || other || ' in ' || round_even(100 * greatest(l, 1 - l), 0)::INTEGER || '% of the frames they share',
 '- it looks ' || CASE WHEN r >= 1 THEN 'BIGGER' ELSE 'SMALLER' END || ': ' || round_even(greatest(r, 1 / greatest(r, 1e-9)), 1)::VARCHAR || 'x the on-screen area of thing ' || other || ' (' || round_even(100 * greatest(g, 1 - g), 0)::INTEGER || '% of frames)',
 '- it is ' || CASE WHEN n >= 0.5 THEN 'NEARER to' ELSE 'FURTHER from' END || ' the viewpoint than thing ' || other || ' (' || round_even(100 * greatest(n, 1 - n), 0)::INTEGER || '% of frames)'] END AS lines
FROM q LEFT JOIN p USING (scene, track, other)
""")
def sibling_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the lines of a supplier's orders stand to each other, as sentences."""
    rows, shown = load(spark, sf_dir, "lineitem"), (F.col("track") < 5) | (F.col("frame") < 20)  # tracks 5 to 7 are seen in half of the frames
    frames = rows.groupBy(F.col("l_suppkey").alias("scene"), (F.col("l_orderkey") % 40).alias("frame"), F.col("l_linenumber").alias("track")).agg(F.min("l_quantity").cast("double").alias("cx"), F.max("l_extendedprice").alias("area"), F.min("l_tax").alias("depth"))
    frames = frames.withColumn("area", F.when(shown, F.col("area")).otherwise(0.0))
    return C.compared(frames.withColumn("label", F.concat(F.lit("thing "), F.col("track").cast("string"))), "scene", "frame", "track", "label")


@query(f"""
WITH v AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS view, [l_quantity / 10.0, l_extendedprice / 20000, l_discount * 20]::DOUBLE[] AS c, [1.0, (l_tax - 0.04) * 10, (l_discount - 0.05) * 8]::DOUBLE[] AS g FROM lineitem),
u AS (SELECT l_suppkey, view, (view // {SEGMENT})::BIGINT AS segment, c, [e / sqrt(list_dot_product(g, g)) FOR e IN g] AS f FROM v), s AS (SELECT l_suppkey, segment - 1 AS segment, c, f FROM u WHERE view % {SEGMENT} IN (0, 10, 20, 30) AND segment > 0),
k AS (SELECT u.l_suppkey, u.segment, u.view, max(CASE WHEN list_distance(u.c, s.c) / 1.5 <= 1.0 AND list_dot_product(u.f, s.f) >= cos(radians(20.0)) THEN 1 ELSE 0 END) AS hit FROM u LEFT JOIN s USING (l_suppkey, segment) GROUP BY 1, 2, 3)
SELECT l_suppkey, segment, count(*)::BIGINT AS frames, round(avg(hit), 6) AS covered FROM k GROUP BY 1, 2
""")
def view_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every stretch of views, the share that one of four views of the next stretch covers."""
    rows = load(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")) - 1
    ahead = F.array(F.lit(1.0), (F.col("l_tax") - 0.04) * 10, (F.col("l_discount") - 0.05) * 8)
    length = F.sqrt(ahead[0] * ahead[0] + ahead[1] * ahead[1] + ahead[2] * ahead[2])
    views = rows.select("l_suppkey", place.cast("long").alias("view"), F.array(F.col("l_quantity") / 10.0, F.col("l_extendedprice") / 20000, F.col("l_discount") * 20).alias("centre"), F.transform(ahead, lambda x: x / length).alias("forward"))
    views = views.withColumn("segment", F.floor(F.col("view") / SEGMENT))
    selected = views.where((F.col("view") % SEGMENT).isin(0, 10, 20, 30) & (F.col("segment") > 0)).withColumn("segment", F.col("segment") - 1)
    out = C.coverage(views.withColumn("scale", F.lit(1.5)), selected, ["l_suppkey", "segment"], "view", 1.0, 20.0)
    return out.withColumn("covered", F.round("covered", 6))


@query("""
WITH q AS (SELECT o_custkey, o_orderkey, [1.0, o_totalprice % 7 - 3, o_orderkey % 5 - 2, o_totalprice % 3 - 1]::DOUBLE[] AS r FROM orders), u AS (SELECT o_custkey, o_orderkey, [v / sqrt(list_dot_product(r, r)) FOR v IN r] AS q FROM q),
d AS (SELECT a.o_custkey, a.o_orderkey, degrees(2 * acos(least(abs(list_dot_product(a.q, b.q)), 1))) AS d FROM u a JOIN u b ON a.o_custkey = b.o_custkey AND a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1)
SELECT o_custkey, o_orderkey, round(avg(d), 4) AS mean, round(min(d), 3) AS least FROM d GROUP BY 1, 2
""")
def rotation_set_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees from each even order's rotation to those of the customer's odd orders."""
    price, key = F.col("o_totalprice").cast("double"), F.col("o_orderkey").cast("double")
    raw = F.array(F.lit(1.0), price % 7 - 3, key % 5 - 2, price % 3 - 1)
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", raw.alias("r"))
    rows = rows.withColumn("q", F.transform("r", lambda x: x / F.sqrt(F.aggregate("r", F.lit(0.0), lambda s, y: s + y * y))))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    out = C.set_angles(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderkey", "q")
    return out.withColumns({"mean": F.round("mean", 4), "least": F.round("least", 3)})


@query("""
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'run_' || o_custkey ELSE strftime(o_orderdate, '%Y%m%d') || '_' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || '0559_run_' || o_custkey END AS name FROM orders),
p AS (SELECT o_orderkey, CASE WHEN regexp_matches(name, '^[0-9]{8}_[0-9]{6}_.+$') THEN strptime(left(name, 15), '%Y%m%d_%H%M%S') END AS t, regexp_replace(name, '^[0-9]{8}_[0-9]{6}_', '') AS name FROM n)
SELECT o_orderkey, name, epoch(t)::BIGINT AS moment, (epoch(t) - epoch(lag(t) OVER (PARTITION BY name ORDER BY t, o_orderkey)))::BIGINT AS waited FROM p WHERE t IS NOT NULL UNION ALL SELECT o_orderkey, name, NULL, NULL FROM p WHERE t IS NULL
""")
def run_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and names of runs, and the seconds since the run of the same name before."""
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit("0559_run_"), F.col("o_custkey").cast("string"))
    name = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("run_"), F.col("o_custkey").cast("string"))).otherwise(stamp)
    rows = load(spark, sf_dir, "orders").select("o_orderkey", C.run_parts(name).alias("r")).select("o_orderkey", "r.name", F.unix_timestamp("r.at").alias("moment"))
    w = Window.partitionBy("name").orderBy("moment", "o_orderkey")
    timed = rows.where("moment IS NOT NULL").withColumn("waited", F.col("moment") - F.lag("moment").over(w))
    return timed.unionByName(rows.where("moment IS NULL").withColumn("waited", F.lit(None).cast("long")))
