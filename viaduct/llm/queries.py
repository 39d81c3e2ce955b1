"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm import bpe, extract, fingerprints, hardneg, katz, languages, mixing, neardup, pii, repeats, toxicity, tries, vectors
from viaduct.llm.shared import documents, remainder

#: For production a secret; here a fixed one, so that reruns agree.
PSEUDONYM_KEY = "viaduct-demonstration-key"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (pseudonymised), n_private: values replaced in it."""
    return pii.private_documents(documents(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_KEY)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    return languages.identify(docs, ~F.col("held_out"), ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_documents(documents(spark, sf_dir), labels, lambda key: remainder(key, 4) != 2)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def encoded(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all rows of docs."""
    return bpe.digest_documents(docs, bpe.coder(*bpe.tokenizer_file(vocabulary)))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(documents(spark, sf_dir), remainder(F.col("doc_id"), 7) != 2)


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(*tries.reopened(*tries.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_pseudonyms, op2_language_id, op3_source_mixing, op4_weighted_fingerprints, op5_toxicity, op6_near_duplicates, op7_byte_bpe, op8_katz_scores, op9_repeated_strings, op10_near_vectors,
        op11_hard_negatives, op12_main_text, op13_conversation_trie,
    )
}

_NEGATIVES = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM own a JOIN own b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5
"""
#: CRC-32 of a decimal number, bit by bit over its digits, and the opening that it gives.
_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda d: ord(d)::UBIGINT)), lambda h, d: " + "list_reduce([xor(h, d), 1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[], lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT)))"
_TRIE = f"""
WITH own AS (
  SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), opened AS (SELECT c, turns, CAST(xor({_CRC.format(c="c")}, 4294967295::UBIGINT) % 4 AS BIGINT) AS h FROM own
), built AS (
  SELECT o.c, list_concat(coalesce(b.turns, [])[:o.h], o.turns[o.h + 1:]) AS turns FROM opened o LEFT JOIN own b ON b.c = o.c - o.c % 20
), members AS (
  SELECT c, d AS depth, len(turns) = d AS ends, sha256(CAST(to_json(turns[:d]) AS VARCHAR)) AS node, CASE WHEN d > 0 THEN sha256(CAST(to_json(turns[:d - 1]) AS VARCHAR)) END AS parent,
    CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words
  FROM built, unnest(range(len(turns) + 1)) AS t(d)
), nodes AS (
  SELECT node, min(c) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, min(words) AS words,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ended
  FROM members GROUP BY node
), children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT m.node, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved_tokens
  FROM nodes v JOIN members m ON m.c = v.conv_id AND m.depth <= v.depth LEFT JOIN children k ON k.node = v.node GROUP BY m.node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ended) AS ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children k USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""
#: SQL of the queries that it can express and run on whole tables.
ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": _NEGATIVES, "op13_conversation_trie": _TRIE}
