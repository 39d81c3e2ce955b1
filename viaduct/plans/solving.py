"""Queries that solve knobs by rounds and scrub nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import nested
from viaduct.operators import solvers as S
from viaduct.plans.registry import query
from viaduct.sources.tables import load

ROUNDS = 16
_BROKEN = "CASE WHEN avg(least(1, knob * l_quantity / 50)) > 0.6 + 1e-9 THEN 'hole' WHEN count_if(knob * l_extendedprice > 60000) > 0.1 * count(*) THEN 'collision' END"


def _solver_sql() -> str:
    """A probe and a state of all brackets for each round."""
    probe = lambda name, state, knob: f"{name} AS MATERIALIZED (SELECT k, {_BROKEN} AS b FROM (SELECT k, {knob} AS knob FROM {state}) JOIN lineitem ON l_suppkey = k GROUP BY k)"
    ctes = ["r AS (SELECT s_suppkey AS k, 0.0::DOUBLE AS lo, 0.5 + s_suppkey % 4 AS hi FROM supplier)", probe("ph", "r", "hi"), probe("pl", "r", "lo"), "e AS (SELECT r.*, ph.b AS bh, pl.b AS bl FROM r LEFT JOIN ph USING (k) LEFT JOIN pl USING (k))"]
    ctes.append("s0 AS MATERIALIZED (SELECT k, lo, hi, bh AS b FROM e WHERE bh IS NOT NULL AND bl IS NULL)")
    for i in range(ROUNDS):
        ctes += [probe(f"p{i}", f"s{i}", "(lo + hi) / 2"), f"s{i + 1} AS MATERIALIZED (SELECT k, CASE WHEN p.b IS NULL THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN p.b IS NULL THEN hi ELSE (lo + hi) / 2 END AS hi, coalesce(p.b, s.b) AS b FROM s{i} s LEFT JOIN p{i} p USING (k))"]
    return f"WITH {', '.join(ctes)} SELECT k AS s_suppkey, lo AS knob, 'solved' AS status, b AS binding FROM s{ROUNDS} UNION ALL SELECT k, CASE WHEN bh IS NULL THEN hi END, CASE WHEN bh IS NULL THEN 'ceiling' ELSE 'floor' END, coalesce(bl, bh) FROM e WHERE bh IS NULL OR bl IS NOT NULL"


@query(_solver_sql())
def largest_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's largest knob under two budgets measured on its lines."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_quantity", "l_extendedprice")
    variants = load(spark, sf_dir, "supplier").select("s_suppkey", F.lit(0.0).alias("low"), (F.col("s_suppkey") % 4 + 0.5).alias("high"))

    def probe(at: DataFrame) -> DataFrame:
        hole = F.avg(F.least(F.lit(1.0), F.col("knob") * F.col("l_quantity") / 50)) > 0.6 + 1e-9
        collision = F.count_if(F.col("knob") * F.col("l_extendedprice") > 60000) > 0.1 * F.count("*")
        return at.join(lines, "s_suppkey").groupBy("s_suppkey").agg(S.binding(("hole", hole), ("collision", collision)).alias("binding"))

    return S.largest_knob(variants, "s_suppkey", "low", "high", probe, ROUNDS)


@query("""
WITH p AS (SELECT p_partkey, p_retailprice / 7777 AS truth FROM part), v AS (SELECT p_partkey, round(truth, 5) AS k, floor(truth * 400000)::BIGINT AS step FROM p),
t AS (SELECT p_partkey, step, i::INTEGER AS trial, k + CASE WHEN i % 2 = 1 THEN -1.0 ELSE 1.0 END::DOUBLE * (0.5e-5::DOUBLE * ceil(i / 2.0) / 20) AS knob FROM v, range(41) AS u(i)),
b AS (SELECT *, abs(floor(knob * 400000)::BIGINT - step) AS error FROM t), f AS (SELECT * FROM b WHERE error <= 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY trial) = 1)
SELECT p_partkey, knob, error::DOUBLE AS error FROM v LEFT JOIN f USING (p_partkey)
""")
def recovered_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knobs rounded to five digits, recovered so that they rebuild the same step."""
    truth = F.col("p_retailprice") / 7777
    variants = load(spark, sf_dir, "part").select("p_partkey", F.round(truth, 5).alias("k"), F.floor(truth * 400000).alias("step"))
    error = F.abs(F.floor(F.col("knob") * 400000) - F.col("step")).cast("double")
    return S.recovered_knob(variants, "p_partkey", "k", error, 0.0, steps=20)


_JSON = """json_object('order', l_orderkey, 'focus_ids', {first}, 'shots', to_json(list(json_object('line', l_linenumber, 'primary', l_shipmode, 'parts', json_array(json_object('focus_ids', {second}))) ORDER BY l_linenumber, l_shipmode, l_returnflag)))"""


@query(f"""
WITH o AS (SELECT *, ['AIR', 'RAIL', 'SHIP', 'TRUCK', 'MAIL', 'FOB', 'REG AIR'][l_partkey % 7 + 1] AS l_shipmode FROM lineitem), l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_shipmode, [l_shipmode, l_returnflag, 'SHIP'] AS ids FROM o), n AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_shipmode, ids, list_filter(ids, lambda x: x NOT IN ('TRUCK', 'MAIL')) AS good FROM l)
SELECT l_orderkey, {_JSON.format(first="to_json(list_filter(['FOB', min(l_shipmode)], lambda x: x NOT IN ('TRUCK', 'MAIL')))", second="to_json(good)")}::VARCHAR AS document,
 (sum(len(ids) - len(good)) + CASE WHEN min(l_shipmode) IN ('TRUCK', 'MAIL') THEN 1 ELSE 0 END)::BIGINT AS removed, count_if(l_shipmode IN ('TRUCK', 'MAIL'))::BIGINT AS kept FROM n GROUP BY l_orderkey
""")
def scrubbed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested documents, without the ids that name something that is no asset, at any depth."""
    modes = F.array(*map(F.lit, ("AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB", "REG AIR")))
    rows = load(spark, sf_dir, "lineitem").withColumn("l_shipmode", modes[(F.col("l_partkey") % 7).cast("int")])
    ids = F.array("l_shipmode", "l_returnflag", F.lit("SHIP"))
    shot = F.struct(F.col("l_linenumber").alias("line"), F.col("l_shipmode").alias("primary"), F.array(F.struct(ids.alias("focus_ids"))).alias("parts"))
    orders = rows.groupBy("l_orderkey").agg(F.min("l_shipmode").alias("least"), F.array_sort(F.collect_list(shot)).alias("shots"))
    text = F.to_json(F.struct(F.col("l_orderkey").alias("order"), F.array(F.lit("FOB"), "least").alias("focus_ids"), "shots"))
    assets, names = F.array(*map(F.lit, ("air", "rail", "ship"))), F.array(*map(F.lit, ("air_left_01", "truck", "mail", "fob_rail_x", "reg air")))
    out = orders.select("l_orderkey", nested.scrub(text, assets, names, ["focus_ids"], ["primary"]).alias("s"))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("l_orderkey", "s.document", total("s.removed").alias("removed"), total("s.kept").alias("kept"))
