"""A corpus pipeline of five stages over documents: language ID, near-dedup, pseudonyms, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm import bpe, languages, mixing, neardup, pii, queries
from viaduct.llm.shared import remainder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document of at least so many characters is rejected when no language knows so large a share of its n-grams.
JUDGED_FROM = 40
KNOWN_AT_LEAST = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and longer ones whose n-grams no language knows."""
    train = remainder(F.col("doc_id"), 4) != 2
    filters = languages.learn(docs.where(train), ["doc_id"], "text", "lang")
    found = languages.predict(docs, filters, COLUMNS, "text")
    known = (F.length("text") < JUDGED_FROM) | (F.col("known") >= KNOWN_AT_LEAST)
    return found.where((F.col("lang_pred") != "und") & known).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs written with _row, a key of each row, and _mark, a hash of its columns that is the same in every run: doc_id
    may be null, repeated or shared by different texts."""
    return table(docs.select(*COLUMNS).withColumns({"_row": F.monotonically_increasing_id(), "_mark": F.xxhash64(*COLUMNS)}))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the least doc_id (null is the last)."""
    rows = keyed(docs)
    found = neardup.near_duplicates(rows, "_row").select("_row", "class_id").join(rows.select("_row", "_mark", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_mark", "_row")).alias("first")
    return rows.join(found.groupBy("class_id").agg(first).select("first._row"), "_row", "left_semi").select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.private_documents(docs, queries.PSEUDONYM_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes its words, rounded half up."""
    rows = keyed(docs)
    taken = mixing.mix(rows, "_row", shuffle="_mark").select("_row", F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int").alias("times")).where("times > 0")
    return rows.join(taken, "_row").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.encoded(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pseudonyms), ("mixing", mixture), ("byte_bpe", byte_bpe)]
#: The stages are not expressible in SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = table(out) if name != STAGES[-1][0] else out
    return docs
