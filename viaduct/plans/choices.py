"""Queries that rank, split, sample and spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators import choices as C
from viaduct.operators import dedup as D
from viaduct.operators import metrics as M
from viaduct.plans.registry import query
from viaduct.sources.tables import load


@query("""
SELECT p_brand, p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY md5('scene|' || p_brand || '|' || p_size || '|' || p_partkey), p_partkey) AS r FROM part) WHERE r = 1
""")
def one_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.one_each(load(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand", "p_size"], "p_partkey", "scene")


@query("""
WITH a AS (SELECT *, c_acctbal > 5000 AS m, row_number() OVER (PARTITION BY c_nationkey, c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer), b AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY m DESC, c_acctbal DESC, c_custkey) AS r FROM a WHERE k <= CASE WHEN m THEN 3 ELSE 4 END)
SELECT c_nationkey, c_custkey, r::INTEGER AS rank FROM b WHERE r <= 6
""")
def anchor_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").withColumn("moving", F.col("c_acctbal") > 5000).withColumn("frames", F.lit(1))
    return C.anchors(rows, "c_nationkey", "c_custkey", "moving", "c_acctbal", "frames", 3, 4, 6).select("c_nationkey", "c_custkey", "rank")


@query("""
WITH g AS (SELECT c_nationkey, c_custkey FROM customer WHERE c_acctbal > 9900), e AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM g))
SELECT c_nationkey, c_custkey, false AS restored FROM g UNION ALL SELECT c_nationkey, c_custkey, true FROM e WHERE r = 1
""")
def restored_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer")
    return C.restored(rows.where("c_acctbal > 9900"), rows, "c_nationkey", "c_custkey", "c_acctbal")


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20
""")
def worst_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.worst(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 20)


@query("""
WITH g AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) - avg(CASE WHEN event_type = 'error' AND user_id % 10 <> 0 THEN value END) AS gap FROM events GROUP BY 1)
SELECT user_id, round(gap, 6) AS gap FROM g ORDER BY round(coalesce(gap, -1e9), 9) DESC, user_id LIMIT 25
""")
def largest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by the gap of two arms, those without an arm last; a top-k report of 25."""
    rows = load(spark, sf_dir, "events").where("event_type <> 'error' OR user_id % 10 <> 0")
    ranked = C.ranked_by_gap(rows, "user_id", "event_type", "value", "click", "error").withColumn("key", F.round("key", 9))
    return ranked.orderBy(F.desc("key"), "user_id").limit(25).select("user_id", F.round("gap", 6).alias("gap"))


@query("""
WITH m AS (SELECT user_id, max(value) - min(value) AS motion FROM events GROUP BY 1) SELECT user_id, round(motion, 6) AS motion FROM m ORDER BY round(motion, 9) DESC, user_id LIMIT 10
""")
def most_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten entries whose subject moves most; a top-k report."""
    moved = load(spark, sf_dir, "events").groupBy("user_id").agg((F.max("value") - F.min("value")).alias("motion"))
    return moved.orderBy(F.desc(F.round("motion", 9)), "user_id").limit(10).select("user_id", F.round("motion", 6).alias("motion"))


@query("""
SELECT CASE WHEN ('0x' || md5('split|' || o_custkey)[1:8])::BIGINT / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END AS split, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS scenes FROM orders GROUP BY 1
""")
def scene_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded split in which all rows of a scene go together."""
    rows = C.split_by_scene(load(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", 0.8, "split")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("scenes"))


@query("""
SELECT doc_id, CASE WHEN ('0x' || md5('rows|' || doc_id)[1:8])::BIGINT / 4294967296.0 < 0.9 THEN 'train' ELSE 'test' END AS split FROM documents
""")
def row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_by_scene(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.9, "rows")


def _quota_sql(pool: str, target: str, key: str) -> str:
    """CTEs m, b, q, h over the pool (key, size): the rows drawn by size."""
    return f"""
m AS (SELECT coalesce(sum(size), 0)::BIGINT AS mass, greatest(0, least(({target})::BIGINT, coalesce(sum(size), 0)::BIGINT)) AS goal FROM {pool}),
b AS (SELECT size, count(*) AS n, any_value(goal) * count(*) // any_value(mass) AS whole, any_value(goal) * count(*) % any_value(mass) AS rest, any_value(goal) AS goal FROM {pool}, m GROUP BY size),
q AS (SELECT size, whole + CASE WHEN rest > 0 AND 2 * sum(CASE WHEN rest > 0 THEN size ELSE 0 END) OVER (ORDER BY rest DESC, size DESC ROWS UNBOUNDED PRECEDING) - size <= 2 * (goal - sum(whole * size) OVER ()) THEN 1 ELSE 0 END AS wanted FROM b),
h AS (SELECT * FROM (SELECT {pool}.*, wanted, row_number() OVER (PARTITION BY size ORDER BY md5('stratified|' || {key}), {key}) AS r FROM {pool} JOIN q USING (size)) WHERE r <= wanted)"""


@query(f"""
WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1), f AS (SELECT s.* FROM s JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 9950), p AS (SELECT * FROM s WHERE o_custkey NOT IN (SELECT o_custkey FROM f)), {_quota_sql("p", "400 - (SELECT coalesce(sum(size), 0) FROM f)", "o_custkey")}
SELECT o_custkey, size, 'forced' AS why FROM f UNION ALL SELECT o_custkey, size, 'drawn' FROM h
""")
def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers held out in proportion of their orders, to 400 orders, the richest ones forced."""
    scenes = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"))
    forced = load(spark, sf_dir, "customer").where("c_acctbal > 9950").select(F.col("c_custkey").alias("o_custkey"))
    return C.stratified(scenes, "o_custkey", "size", 400, forced)


@query(f"""
WITH s AS (SELECT c_custkey, c_nationkey, count(o_orderkey) AS size FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), p AS (SELECT c_custkey, size FROM s WHERE c_nationkey >= 12), {_quota_sql("p", "(SELECT round_even(coalesce(sum(size), 0) * 0.1::DOUBLE, 0) FROM p)", "c_custkey")}
SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END WHEN c_custkey IN (SELECT c_custkey FROM h) THEN 'test' ELSE 'train' END AS split, c_nationkey < 12 AS kept FROM s
""")
def kept_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old split of customers stays; of the new ones a tenth of their orders is held out, stratified by their number."""
    rows, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("size"))
    old = rows.where("c_nationkey < 12").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split"))
    return C.split_again(rows.select("c_custkey").join(orders, "c_custkey", "left").na.fill(0, ["size"]), old, "c_custkey", "size", 0.1)


@query("""
WITH l AS (SELECT *, coalesce(c_acctbal < 7000, true) AS low FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY low, CASE WHEN low THEN -c_acctbal END, md5('pure|' || c_custkey), c_custkey) AS r FROM l)
SELECT c_nationkey, c_custkey, low AS fallback FROM r WHERE (NOT low AND r <= 3) OR (low AND r = 1)
""")
def drawn_above_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drawn_above(load(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_acctbal", 7000, 3, "pure").select("c_nationkey", "c_custkey", "fallback")


@query("""
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS pool, max(l_quantity) AS span FROM lineitem WHERE l_quantity >= 30 GROUP BY 1, 2 HAVING count(*) >= 50
""")
def retrieval_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.query_plan(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", 30, 50)


@query("""
WITH r AS (SELECT o_orderpriority AS reason, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('reel|' || o_orderkey), o_orderkey) AS turn FROM orders) SELECT reason, o_orderkey, turn::INTEGER AS turn FROM r ORDER BY turn, reason LIMIT 23
""")
def review_reel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """23 rows that take turns over the reasons; a stated sample."""
    return C.cycled(load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("reason"), "o_orderkey"), "reason", "o_orderkey", "reel", 23)


@query("""
WITH b AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'moving' ELSE 'still' END AS bucket, o_totalprice FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, bucket ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM b)
SELECT o_custkey, o_orderkey, bucket, rank::INTEGER AS rank FROM r WHERE rank <= CASE bucket WHEN 'moving' THEN 2 ELSE 1 END
""")
def bucket_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.quotas(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.col("o_totalprice") > 100000, "o_totalprice", {"moving": 2, "still": 1})
    return out.select("o_custkey", "o_orderkey", "bucket", "rank")


@query("""
WITH t AS (SELECT c_nationkey, c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS t FROM customer) SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY t, c_mktsegment)::INTEGER AS place FROM t
""")
def alternating_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.alternating(load(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey").select("c_nationkey", "c_custkey", "place")


@query("""
SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_suppkey % 3 IS DISTINCT FROM b.s_suppkey % 3 OR abs((((a.s_acctbal - b.s_acctbal + 180) % 360) + 360) % 360 - 180) >= 40 AS separated FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey
""")
def separated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    a, b = (s.select("s_nationkey", F.col("s_suppkey").alias(n), (F.col("s_suppkey") % 3).alias(f"r{n}"), F.col("s_acctbal").alias(f"z{n}")) for n in ("a", "b"))
    return a.join(b, "s_nationkey").where("a < b").select("a", "b", C.separated(F.col("ra"), F.col("za"), F.col("rb"), F.col("zb"), 40).alias("separated"))


@query("""
WITH m AS (SELECT s_nationkey AS scene, s_suppkey AS camera, c_custkey AS candidate, CASE WHEN abs(c_acctbal - s_acctbal) >= 6000 THEN 'far' ELSE 'near' END AS tier FROM supplier JOIN customer ON c_nationkey = s_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY scene, camera ORDER BY tier, md5('grow|' || camera || '|' || candidate), candidate) AS rank FROM m)
SELECT scene, camera, candidate, tier, rank::INTEGER AS rank FROM r WHERE rank <= 8
""")
def expanded_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("camera"), F.col("s_acctbal").alias("at"))
    candidates = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scene"), F.col("c_custkey").alias("candidate"), F.col("c_acctbal").alias("at"))
    return C.expanded(cameras, candidates, "scene", "camera", "candidate", "at", 6000, 8, "grow")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM orders) SELECT o_custkey, o_orderkey, round(spent, 4) AS spent FROM s WHERE spent <= 500000
""")
def budgeted_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.budgeted(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice", 500000)
    return out.select("o_custkey", "o_orderkey", F.round("spent", 4).alias("spent"))


#: CRC-32 of a part's decimal key, bit by bit over its digits.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(p_partkey::VARCHAR, ''), lambda d: ord(d)::UBIGINT)), lambda h, d: list_reduce([xor(h, d), 1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[], lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT))), 4294967295::UBIGINT)"


@query(f"""
WITH s AS (SELECT p_partkey, p_size, ({_CRC} % 4)::BIGINT AS start, list_filter(['front', 'left', 'rear', 'top'], lambda s: (length(s) + p_size) % 3 <> 0) AS free FROM part),
t AS (SELECT *, list_filter(list_transform(range(4), lambda i: [['front', 'left', 'rear', 'top'][(start + i) % 4 + 1], ['left', 'rear', 'top', 'front'][(start + i) % 4 + 1]]), lambda p: list_contains(free, p[1]) AND list_contains(free, p[2]))[1] AS p FROM s)
SELECT p_partkey, p_size, p[1] AS a, p[2] AS b FROM t
""")
def rotated_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of slots of each video by crc32, or the next one that is free."""
    available = F.filter(F.array(F.lit("front"), F.lit("left"), F.lit("rear"), F.lit("top")), lambda s: (F.length(s) + F.col("p_size")) % 3 != 0)
    slot = C.rotated_slot(F.col("p_partkey"), [("front", "left"), ("left", "rear"), ("rear", "top"), ("top", "front")], available)
    return load(spark, sf_dir, "part").select("p_partkey", F.col("p_size"), slot.alias("s")).select("p_partkey", "p_size", "s.a", "s.b")


@query("""
WITH p AS (SELECT user_id, event_id, value, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM events WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY value DESC, event_id) AS r FROM p)
SELECT user_id, part::INTEGER AS part, event_id, value FROM r WHERE r = 1
""")
def spread_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.spread_frames(load(spark, sf_dir, "events").where("value IS NOT NULL"), "user_id", ["ts", "event_id"], "value", "event_id", 4)


def _cover_sql(k: int) -> str:
    parts = ["l0 AS (SELECT DISTINCT source, doc_id, unnest([x FOR x IN regexp_split_to_array(lower(text), '[^a-z]+') IF length(x) = 4]) AS e FROM documents WHERE source IS NOT NULL)"]
    for i in range(k):
        parts.append(f"g{i} AS (SELECT source, doc_id, count(*) AS gain FROM l{i} GROUP BY 1, 2), p{i} AS (SELECT source, doc_id, gain FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gain DESC, doc_id) AS r FROM g{i}) WHERE r = 1)")
        parts.append(f"l{i + 1} AS (SELECT l.* FROM l{i} l ANTI JOIN (SELECT DISTINCT source, e FROM l{i} SEMI JOIN p{i} USING (source, doc_id)) c USING (source, e))")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT source, doc_id, gain::BIGINT AS gain, {i}::INTEGER AS pick FROM p{i}" for i in range(k))


@query(_cover_sql(4))
def greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source, up to four documents whose words cover most of it; words of four letters stand for directions."""
    words = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda x: F.length(x) == 4)
    rows = load(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "doc_id", F.explode(words).alias("e"))
    return C.covering(rows, "source", "doc_id", "e", 4, D.checkpointed)


def _far_sql(k: int) -> str:
    parts = ["e AS (SELECT label, vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)", "p0 AS (SELECT label, min(vec_id) AS vec_id FROM e GROUP BY 1)", "d0 AS (SELECT label, vec_id, v, 'inf'::DOUBLE AS d FROM e)"]
    for i in range(1, k):
        parts.append(f"d{i} AS (SELECT s.label, s.vec_id, s.v, least(s.d, list_distance(s.v, q.v)) AS d FROM d{i - 1} s JOIN p{i - 1} p ON s.label = p.label JOIN e q ON q.vec_id = p.vec_id)")
        parts.append(f"p{i} AS (SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id) AS r FROM d{i}) WHERE r = 1 AND d > 0)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT label, vec_id, {i}::INTEGER AS pick FROM p{i}" for i in range(k))


@query(_far_sql(4))
def fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vectors of each label that lie far apart."""
    return C.far_apart(load(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 4, M.distance, D.checkpointed)
