"""Queries on texts, keys, JSON and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.functions import text as X
from viaduct.operators import metrics as M
from viaduct.plans.registry import query
from viaduct.sources.tables import load


@query("""
SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events
""")
def props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""
SELECT doc_id, json_extract_string(('{"id": ' || doc_id || ', "lang": "' || lang || '"}'), '$.lang') AS lang FROM documents
""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON from replies that wrap it in a fence, in prose, or not at all."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    body = F.format_string('{"id": %d, "lang": "%s"}', "doc_id", "lang")
    reply = F.when(F.col("doc_id") % 3 == 0, body).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" as asked")))
    return docs.select("doc_id", F.get_json_object(X.json_text(reply), "$.lang").alias("lang"))


@query("""
SELECT c_custkey, 'b' || c_nationkey AS batch, replace(replace(c_name, '#', '_'), ' ', '_') AS hash, c_custkey::VARCHAR AS seg FROM customer
""")
def key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer")
    key = X.join_key(F.concat(F.lit("b"), F.col("c_nationkey").cast("string")), F.translate("c_name", "# ", "__"), F.col("c_custkey").cast("string"))
    return rows.select("c_custkey", key.alias("key")).select("c_custkey", X.split_key(F.col("key")).alias("k")).select("c_custkey", "k.batch", "k.hash", "k.seg")


@query("""
SELECT r_name, CASE len(l) WHEN 0 THEN '' WHEN 1 THEN l[1] ELSE array_to_string(l[1:-2], ', ') || ' and ' || l[-1] END AS caption FROM (SELECT r_name, list_sort(list(n_name)) AS l FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
""")
def caption_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "region").join(load(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("l")).select("r_name", X.and_list(F.col("l")).alias("caption"))


@query(r"""
WITH s AS (SELECT doc_id, regexp_extract(trim(text), '^[^.!?]*[.!?]?') AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 240 THEN s ELSE regexp_replace(regexp_extract(left(s, 240), '(?s)^(.*)\s', 1), '[,;]+$', '') || '...' END AS sentence FROM s
""")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("sentence"))


@query("""
WITH t AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^a-z0-9]+') IF x <> ''] AS w FROM documents), p AS (SELECT doc_id, unnest([w[i] FOR i IN range(1, len(w) + 1) IF list_has_any(w[i + 1 : i + 3], ['the', 'le', 'der'])]) AS token FROM t)
SELECT token, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM p GROUP BY 1 HAVING count(*) >= 20
""")
def token_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with an article among the three that follow, by count; the look ahead stays within the row, without a window."""
    article = F.array(*[F.lit(x) for x in ("the", "le", "der")])
    docs = load(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("w"))
    ahead = F.transform("w", lambda x, i: F.when(F.arrays_overlap(F.slice(F.col("w"), i + 2, F.lit(3)), article), x))
    per = docs.select("doc_id", F.explode(F.array_compact(ahead)).alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("c"))
    return per.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs")).where("n >= 20")


@query("""
SELECT doc_id, (CASE WHEN regexp_matches(text, 'the|The') THEN 1.5 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(text, '[!?]') THEN -1 ELSE 0 END)::DOUBLE AS evidence FROM documents
""")
def style_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", X.weighted_evidence(F.col("text"), {"the|The": 1.5, "[0-9]": 0.5, "[!?]": -1}).alias("evidence"))


@query("""
SELECT conv_id, turn, length(text) - length(replace(text, '?', '')) > 0 AS asks, role <> lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS switched FROM conversations
""")
def turn_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").contains("?").alias("asks"), (F.col("role") != F.lag("role", 1, "").over(w)).alias("switched"))


@query("""
WITH e AS (SELECT label, vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), p AS (SELECT a.label, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.label = b.label AND b.vec_id = a.vec_id + 1)
SELECT round(greatest(100 * avg(c), 0), 6) AS score, count(*)::BIGINT AS n FROM p
""")
def cosine_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors of one label as prediction and reference."""
    e = load(spark, sf_dir, "embeddings")
    a, b = e.select("label", "vec_id", F.col("embedding").alias("x")), e.select("label", (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return M.cosine_score(a.join(b, ["label", "vec_id"]), "x", "y").withColumn("score", F.round("score", 6))


def _chunks(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """All vectors of even or odd id in contiguous chunks, each with its place."""
    return M.chunked(load(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == parity).select("vec_id", "label", "embedding"), "vec_id")


_E = "e AS (SELECT vec_id, label, vec_id % 2 AS side, [x::DOUBLE FOR x IN embedding] AS v, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY vec_id % 2) AS n FROM embeddings), c AS (SELECT *, pos // ceil(n / least(5, n // 4))::BIGINT AS chunk FROM e)"
_K = "k AS (SELECT vec_id, d AS radius FROM (SELECT a.vec_id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM c a JOIN c b ON a.chunk = b.chunk AND a.side = b.side) WHERE r = 4)"
_D = "r AS (SELECT c.*, radius FROM c JOIN k USING (vec_id) WHERE side = 0), f AS (SELECT c.*, radius FROM c JOIN k USING (vec_id) WHERE side = 1), d AS (SELECT r.chunk, r.vec_id AS r, f.vec_id AS f, list_distance(r.v, f.v) AS d, r.radius AS rr, p.radius AS pr FROM r JOIN f USING (chunk) JOIN f p ON p.pos = r.pos)"


@query(f"WITH {_E}, {_K} SELECT c.chunk, vec_id, round(radius, 6) AS radius FROM c JOIN k USING (vec_id) WHERE side = 0")
def knn_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.radii(_chunks(spark, sf_dir, 0), "chunk", "vec_id", "embedding", 3).select("chunk", "vec_id", F.round("radius", 6).alias("radius"))


@query(f"""
WITH {_E}, {_K}, {_D}, x AS (SELECT chunk, f, max(CASE WHEN d < rr THEN 1 ELSE 0 END) AS i, sum(CASE WHEN d < rr THEN 1 ELSE 0 END) AS n FROM d GROUP BY 1, 2), y AS (SELECT chunk, r, max(CASE WHEN d < pr THEN 1 ELSE 0 END) AS e, max(CASE WHEN d < rr THEN 1 ELSE 0 END) AS c FROM d GROUP BY 1, 2),
 z AS (SELECT * FROM (SELECT chunk, avg(i) AS p, avg(n) / 3 AS q FROM x GROUP BY 1) JOIN (SELECT chunk, avg(e) AS r, avg(c) AS c FROM y GROUP BY 1) USING (chunk))
SELECT count(*)::BIGINT AS chunks, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(q), 6) AS density, round(avg(c), 6) AS coverage FROM z
""")
def prdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the chunks; a chunk of fewer than four rows has no radius and drops out."""
    out = M.prdc(_chunks(spark, sf_dir, 0), _chunks(spark, sf_dir, 1), "chunk", "vec_id", "embedding", 3)
    return out.agg(F.count("*").alias("chunks"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "density", "coverage")])


@query(f"""
WITH {_E}, {_K}, r AS (SELECT c.*, radius FROM c JOIN k USING (vec_id) WHERE side = 0) SELECT f.vec_id, count_if(list_distance(r.v, f.v) < radius)::BIGINT AS balls, count_if(list_distance(r.v, f.v) < radius) > 0 AS inside FROM c f JOIN r USING (chunk) WHERE f.side = 1 GROUP BY 1
""")
def prdc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each generated vector: how many balls of real ones hold it."""
    per, _ = M.balls(_chunks(spark, sf_dir, 0), _chunks(spark, sf_dir, 1), "chunk", "vec_id", "embedding", 3)
    return per.select("vec_id", "balls", (F.col("balls") > 0).alias("inside"))


@query("""
WITH l AS (SELECT label, unnest([x::DOUBLE FOR x IN embedding]) AS x, generate_subscripts(embedding, 1) AS i, vec_id FROM embeddings)
SELECT a.label, (a.i - 1)::INTEGER AS i, (b.i - 1)::INTEGER AS j, count(*)::BIGINT AS n, round(sum(a.x), 6) AS sx, round(sum(b.x), 6) AS sy, round(sum(a.x * b.x), 6) AS sxy FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2, 3
""")
def frechet_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("v"))
    return M.moments(rows, ["label"], "v").withColumns({c: F.round(c, 6) for c in ("sx", "sy", "sxy")})


@query()
def frechet_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the Gaussians of even and odd vectors: moments are summed by Spark, and their d x d matrices meet on the
    driver; tests hold it against numpy."""
    sides = M.gaussians(M.moments(load(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("side"), F.col("embedding").alias("v")), ["side"], "v"), "side")
    return spark.createDataFrame([(M.frechet(sides[0], sides[1]),)], "distance double")


def _retrieval_sql(truth: str) -> str:
    one = lambda name, q, c: f"SELECT '{name}' AS direction, a.vec_id AS q, list_cosine_similarity(a.v, b.v) AS s, {truth} AS own FROM c a JOIN c b ON a.side = {q} AND b.side = {c}"
    ks = ", ".join(f"round(100 * avg(CASE WHEN rank < {k} THEN 1 ELSE 0 END), 2) AS r{k}" for k in (1, 2, 3, 5, 10))
    return f"WITH {_E}, s AS ({one('there', 0, 1)} UNION ALL {one('back', 1, 0)}), t AS (SELECT *, max(CASE WHEN own THEN s END) OVER (PARTITION BY direction, q) AS o FROM s), r AS (SELECT direction, q, count_if(s > o) + (count_if(s = o) - 1) / 2 AS rank FROM t WHERE o IS NOT NULL GROUP BY 1, 2) SELECT direction, {ks}, median(rank) + 1 AS median_rank, count(*)::BIGINT AS queries FROM r GROUP BY 1"


def _retrieval(spark: SparkSession, sf_dir: str, label: str | None = None) -> DataFrame:
    """Even vectors look for their odd partners among all, and the other way."""
    return M.retrieval(_chunks(spark, sf_dir, 0), _chunks(spark, sf_dir, 1), "vec_id", "embedding", label)


@query(_retrieval_sql("a.pos = b.pos"))
def retrieval_rk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieval(spark, sf_dir)


@query(_retrieval_sql("a.pos = b.pos OR a.label = b.label"))
def retrieval_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the same label are as good as the partner."""
    return _retrieval(spark, sf_dir, "label")


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean difference of quality and toxicity labels; weights are drawn by hash, so reruns agree."""
    rows = load(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", (F.col("quality") - F.col("toxic")).alias("d"))
    return M.bootstrap(rows, "doc_id", "d", 20_000)
