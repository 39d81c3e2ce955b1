"""Queries on caption and label texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import captions as T
from viaduct.functions import text as X
from viaduct.plans.registry import query
from viaduct.sources.tables import load


_listed = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(rf"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS i FROM benchmark), n AS (SELECT *, lead(w) OVER (PARTITION BY item_id ORDER BY i) AS next FROM w),
h AS (SELECT item_id, i, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(ss|us|is)$') OR w NOT LIKE '%s' OR length(w) <= 3 THEN w ELSE left(w, -1) END AS h FROM n WHERE (next IS NULL OR next IN {_listed(T.ANCHORS)}) AND w NOT IN {_listed(T.ANCHORS)} AND w NOT IN {_listed(T.NON_NOUNS)}),
f AS (SELECT item_id, h, min(i) AS i FROM h WHERE length(h) > 2 AND h NOT IN {_listed(T.NON_NOUNS)} AND NOT regexp_matches(h, '(ing|ed|ion|ness|ly)$') GROUP BY 1, 2)
SELECT item_id, coalesce(string_agg(h, ',' ORDER BY i), '') AS nouns FROM benchmark LEFT JOIN f USING (item_id) GROUP BY item_id
""")
def prompt_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.nouns(F.col("text")), ",").alias("nouns"))


@query("""
WITH f AS (SELECT p_partkey, [x FOR x IN [trim(CASE WHEN p_size > 25 THEN 'a large ' || p_name END), trim(lower(p_type)), trim(CASE WHEN NOT coalesce(p_size / 50.0 < 0.4, false) THEN 'in frame' END), trim(CASE WHEN p_retailprice > 1400 THEN ' ' END)] IF x IS NOT NULL AND x <> ''] AS f FROM part)
SELECT p_partkey, CASE WHEN len(f) = 0 THEN '' ELSE upper(array_to_string(f, ', ')[1]) || array_to_string(f, ', ')[2:] || '.' END AS caption FROM f
""")
def caption_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions from fields; the framing clause goes where too little is in frame."""
    framing = T.framing_kept(F.lit("in frame"), F.col("p_size") / 50, 0.4)
    parts = [F.when(F.col("p_size") > 25, F.concat(F.lit("a large "), "p_name")), F.lower("p_type"), framing, F.when(F.col("p_retailprice") > 1400, " ")]
    return load(spark, sf_dir, "part").select("p_partkey", T.sentence(parts).alias("caption"))


@query(r"""
SELECT item_id, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(regexp_extract(left(text, 61), '(?s)^(.*)\s', 1), '[,;:]+$', '') END AS short FROM benchmark
""")
def caption_shortening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", T.shortened(F.col("text"), 60).alias("short"))


#: Verbs that follow no rule, by third person and by gerund.
_THIRD, _GERUND = {"have": "has", "be": "is", "do": "does"}, {"lie": "lying", "be": "being", "run": "running", "sit": "sitting", "put": "putting"}


@query(r"""
WITH v AS (SELECT DISTINCT w AS verb FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM documents WHERE lang = 'en' UNION ALL SELECT unnest(['have', 'be', 'do', 'lie', 'run', 'sit', 'put'])))
SELECT verb, CASE WHEN verb = 'have' THEN 'has' WHEN verb = 'be' THEN 'is' WHEN verb = 'do' THEN 'does' WHEN regexp_matches(verb, '(s|x|ch|sh|o)$') THEN verb || 'es' WHEN regexp_matches(verb, '[^aeiou]y$') THEN left(verb, -1) || 'ies' ELSE verb || 's' END AS third,
 CASE verb WHEN 'lie' THEN 'lying' WHEN 'be' THEN 'being' WHEN 'run' THEN 'running' WHEN 'sit' THEN 'sitting' WHEN 'put' THEN 'putting' ELSE CASE WHEN regexp_matches(verb, '[^eoy]e$') THEN left(verb, -1) ELSE verb END || 'ing' END AS gerund FROM v
""")
def verb_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the English texts as if it were a verb, and some that follow no rule, in both forms."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))
    rows = load(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(words).alias("verb"))
    rows = rows.unionByName(spark.createDataFrame([(v,) for v in sorted(_THIRD | _GERUND)], "verb string")).distinct()
    return rows.select("verb", T.third_person(F.col("verb"), _THIRD).alias("third"), T.gerund(F.col("verb"), _GERUND).alias("gerund"))


@query("""
SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '__' || lower(c_mktsegment) AS slug, CASE WHEN contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'house') THEN 'place' WHEN contains(lower(c_mktsegment), 'auto') THEN 'vehicle' ELSE 'thing' END AS slot FROM customer
""")
def label_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = T.slot(F.col("c_mktsegment"), {"place": ["build", "house"], "vehicle": ["auto"]}, "thing")
    return load(spark, sf_dir, "customer").select("c_custkey", T.slug(F.col("c_name"), F.col("c_mktsegment")).alias("slug"), slot.alias("slot"))


@query("""
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'arc' WHEN 'ECONOMY' THEN 'push_in' ELSE p_type END || CASE WHEN p_size % 2 = 0 THEN '_aimed' ELSE '' END AS preset FROM part
""")
def preset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    aim = F.when(F.col("p_size") % 2 == 0, "look_at").otherwise("free")
    return load(spark, sf_dir, "part").select("p_partkey", T.preset(F.col("p_type"), {"PROMO": "arc", "ECONOMY": "push_in"}, aim).alias("preset"))


@query(r"""
SELECT conv_id, turn, regexp_replace(array_to_string(list_transform(regexp_extract_all(text, '(?s)[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda x: CASE WHEN lower(x) IN ('the', 'and', 'dans') THEN '[removed]' ELSE x END), ''), '[0-9]+(?:\.[0-9]+)?', '#', 'g') AS prompt FROM conversations
""")
def redacted_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.redacted(F.col("text"), ["the", "and", "dans"]).alias("prompt"))


@query("""
SELECT p_partkey, 'turn ' || CASE WHEN p_size % 2 = 0 THEN 'right' ELSE 'left' END || ' then ' || CASE WHEN p_size % 3 = 0 THEN 'down' ELSE 'up' END || ' leftover' AS prompt FROM part
""")
def flipped_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with directions changed: the SQL writes the opposite directly."""
    text = F.concat(F.lit("turn "), F.when(F.col("p_size") % 2 == 0, "left").otherwise("right"), F.lit(" then "), F.when(F.col("p_size") % 3 == 0, "up").otherwise("down"), F.lit(" leftover"))
    return load(spark, sf_dir, "part").select("p_partkey", T.flipped(text).alias("prompt"))


@query("""
WITH w AS (SELECT item_id, [x FOR x IN regexp_split_to_array(lower(text), '[^a-z]+') IF x <> '' AND x NOT IN ('the', 'and', 'that', 'in', 'a')] AS w FROM benchmark) SELECT item_id, CASE WHEN len(w) > 0 THEN array_to_string([x FOR x, i IN w IF list_position(w, x) = i], ' ') ELSE 'something' END AS words FROM w
""")
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", T.content_words(F.col("text"), ["the", "and", "that", "in", "a"], "something").alias("words"))


@query("""
SELECT p_partkey, ['still', 'ahead', 'back'][(p_size // 4)::BIGINT + 1] || ' and ' || ['level', 'left', 'right', 'up'][p_size % 4 + 1] AS label FROM part
""")
def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", T.segment_text(F.col("p_size"), ["still", "ahead", "back"], ["level", "left", "right", "up"]).alias("label"))


@query("""
WITH g AS (SELECT DISTINCT regexp_replace(lower(string_split(p_name, ' ')[-1]), '([^s])s$', '\\1') AS stem FROM part), e AS (SELECT DISTINCT stem FROM g), d AS (SELECT item_id, lower(text) AS t FROM benchmark)
SELECT item_id, count(stem)::BIGINT AS hits, arg_max(stem, struct_pack(a := length(stem), b := stem)) AS longest FROM d LEFT JOIN e ON contains(t, substr(stem, 1, 3)) GROUP BY 1
""".replace("\\\\", "\\"))
def object_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object groups whose first three letters an action text contains; the longest wins. Texts meet groups over their
    runs of three letters, an equi-join."""
    name = F.concat(F.element_at(F.split("p_name", " "), -1), F.lit("_"), F.col("p_partkey").cast("string"))
    stems = load(spark, sf_dir, "part").select(T.stem(name).alias("stem")).distinct().withColumn("gram", F.substring("stem", 1, 3))
    low = F.lower("text")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))
    met = load(spark, sf_dir, "benchmark").select("item_id", F.explode(grams).alias("gram")).join(stems, "gram", "left")
    return met.groupBy("item_id").agg(F.count("stem").alias("hits"), F.max(F.struct(F.length("stem").alias("n"), F.col("stem").alias("s")))["s"].alias("longest"))


@query("""
WITH m AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN ['in', 'left'] WHEN p_size % 4 = 1 THEN ['out'] WHEN p_size % 4 = 2 THEN ['up', 'in', 'left'] ELSE [] END AS m, p_name AS t FROM part)
SELECT p_partkey, CASE WHEN len(m) > 0 THEN 'moves ' || m[1] || CASE m[1] WHEN 'in' THEN ' toward ' || t WHEN 'out' THEN ' from ' || t ELSE '' END || array_to_string([', then ' || x FOR x IN m[2:]], '') END AS text FROM m
""")
def move_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    listed = lambda *xs: F.array(*[F.lit(x) for x in xs])
    moves = F.when(k == 0, listed("in", "left")).when(k == 1, listed("out")).when(k == 2, listed("up", "in", "left")).otherwise(F.array().cast("array<string>"))
    return load(spark, sf_dir, "part").select("p_partkey", T.clauses(moves, F.col("p_name")).alias("text"))


@query("""
WITH e AS (SELECT c_nationkey, c_mktsegment, arg_max(floor(c_acctbal / 1000)::BIGINT, c_custkey) AS prompt FROM customer GROUP BY 1, 2)
SELECT c_nationkey, array_to_string(list_sort(list(c_mktsegment || '=' || prompt)), ';') AS prompts FROM e GROUP BY 1
""")
def prompt_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map of targets to prompts for each scene, as text; of several prompts for a target the last counts."""
    rows = load(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max_by(F.floor(F.col("c_acctbal") / 1000).cast("string"), "c_custkey").alias("prompt"))
    entries = F.map_entries(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "prompt"))))
    return rows.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("prompts"))


@query("""
SELECT o_orderkey, sha1(o_orderstatus || '|' || o_totalprice::BIGINT || '|~')[1:8] AS mark FROM orders
""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short content marks; a null differs from a blank."""
    return load(spark, sf_dir, "orders").select("o_orderkey", T.fingerprint(F.col("o_orderstatus"), F.bround("o_totalprice").cast("long"), F.lit(None)).alias("mark"))


@query("""
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS bucket, CASE p_name WHEN 'boxes' THEN 'box' ELSE CASE WHEN regexp_matches(p_name || 's', '(ss|x|ch|sh)es$') THEN regexp_replace(p_name || 's', 'es$', '') ELSE p_name END END AS one FROM part
""")
def size_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket words of sizes and the singular of a plural name."""
    return load(spark, sf_dir, "part").select("p_partkey", X.bucket_of(F.col("p_size"), [(10, "small"), (30, "medium"), (50, "large")]).alias("bucket"), X.singular(F.concat("p_name", F.lit("s"))).alias("one"))
