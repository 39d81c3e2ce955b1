"""Sinks: versions are never overwritten, rejects stay rows, lists are written in a seeded order."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def versioned(rows: DataFrame, folder: str, version: str) -> str:
    """Writes Parquet as folder/version=...; fails if that version exists."""
    path = f"{folder}/version={version}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def judged(rows: DataFrame, folder: str) -> None:
    """Passed and failed rows in partitions of keep, and beside them how often each reason was given."""
    rows.write.mode("errorifexists").partitionBy("keep").parquet(f"{folder}/rows")
    rows.select(F.explode("reasons").alias("reason")).groupBy("reason").count().write.mode("errorifexists").json(f"{folder}/reasons")


def append_new(rows: DataFrame, done: DataFrame, key: list[str], folder: str) -> None:
    """Appends the rows whose key is not done yet, as JSON lines."""
    rows.join(done.select(*key).distinct(), key, "left_anti").write.mode("append").json(folder)


def id_list(rows: DataFrame, key: str, folder: str, seed: int = 0) -> None:
    """One key a line, in an order drawn by hash."""
    rows.select(F.col(key).cast("string").alias("value")).orderBy(F.xxhash64("value", F.lit(seed)), "value").write.mode("errorifexists").text(folder)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def corpus(scenes: DataFrame, folder: str, chunk: str) -> None:
    """Scenes as Parquet in folders of their chunk, poses and prompts as arrays and maps."""
    scenes.write.mode("errorifexists").partitionBy(chunk).parquet(folder)


def blacklist(rows: DataFrame, key: list[str], reasons: dict[str, Column], folder: str) -> None:
    """key, reason (the first that holds), detail (all of them, with a space between) of rows for which any holds, as CSV."""
    named = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in reasons.items()]))
    listed = rows.select(*key, named.alias("_r")).where(F.size("_r") > 0)
    listed.select(*key, F.col("_r")[0].alias("reason"), F.array_join("_r", " ").alias("detail")).write.mode("errorifexists").option("header", True).csv(folder)


def fingerprint(config: dict) -> str:
    """A digest of settings that doesn't depend on the order of their keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def indexed(spark: SparkSession, build: Callable[[], DataFrame], folder: str, config: dict) -> DataFrame:
    """The table that build gives under these settings: read where an earlier run has finished it (Spark's _SUCCESS says
    so), else made anew."""
    path = f"{folder}/index={fingerprint(config)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def column_rewritten(rows: DataFrame, fixes: DataFrame, key: list[str], column: str, folder: str, version: str) -> str:
    """A new version of rows in which column is that of fixes (key, column), where they list the key."""
    new = rows.join(fixes.select(*key, F.col(column).alias("_new"), F.lit(True).alias("_has")), key, "left")
    fixed = new.withColumn(column, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(column))).select(*rows.columns)
    return versioned(fixed, folder, version)


def metrics(samples: DataFrame, total: DataFrame, folder: str) -> None:
    """samples as CSV with the one row of set figures beside every sample, and that row as JSON."""
    if total.limit(2).count() != 1:
        raise ValueError("set figures are one row")
    total.coalesce(1).write.mode("errorifexists").json(f"{folder}/metrics")
    whole = total.select(*[F.col(c).alias(f"set_{c}") for c in total.columns])
    samples.join(F.broadcast(whole)).write.mode("errorifexists").option("header", True).csv(f"{folder}/samples")


def with_provenance(rows: DataFrame, source: str, folder: str, version: str) -> str:
    """A new version of rows, and beside it how many came from each source; older versions stay as they are."""
    path = versioned(rows, folder, version)
    counted = rows.groupBy(F.col(source).alias("source")).count().withColumn("version", F.lit(version))
    counted.write.mode("errorifexists").json(f"{folder}/provenance/version={version}")
    return path


def scalars(rows: DataFrame, key: list[str], folder: str, again: bool = False) -> DataFrame:
    """Appends value of the keys that have none yet (of all with again, which wins); returns all, the last of each key.
    What is missing stays missing: an inner join with the table leaves such segments out."""
    spark = rows.sparkSession
    stamped = rows.select(*key, "value", F.current_timestamp().alias("at"))
    if exists(spark, folder) and not again:
        stamped = stamped.join(spark.read.parquet(folder).select(*key).distinct(), key, "left_anti")
    stamped.write.mode("append").parquet(folder)
    return spark.read.parquet(folder).groupBy(*key).agg(F.max_by("value", "at").alias("value"))


def quarantined(outputs: DataFrame, listed: DataFrame, key: list[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): outputs without the listed keys, whose rows are appended to the quarantine instead of being deleted;
    counts: moved and absent keys."""
    keys = listed.select(*key).distinct()
    moved = outputs.join(keys, key, "left_semi")
    moved.write.mode("append").parquet(folder)
    have = outputs.select(*key).distinct().withColumn("_has", F.lit(True))
    counts = keys.join(have, key, "left").agg(F.count_if(F.col("_has").isNotNull()).alias("moved"), F.count_if(F.col("_has").isNull()).alias("absent"))
    return outputs.join(keys, key, "left_anti"), counts


def evaluation(poses: DataFrame, folder: str) -> None:
    """One JSON line an entry and arm, in folders of their arm: name and frames in order, each a matrix of four rows; poses
    are entry, arm, frame, c2w of twelve numbers."""
    last = F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    matrix = F.array(*[F.slice("c2w", 4 * i + 1, 4) for i in range(3)], last)
    entries = poses.groupBy("entry", "arm").agg(F.array_sort(F.collect_list(F.struct("frame", matrix.alias("transform_matrix")))).alias("f"))
    frames = F.transform("f", lambda x: F.struct(x["transform_matrix"].alias("transform_matrix")))
    entries.select("arm", F.concat("entry", F.lit("_transforms_"), "arm").alias("name"), frames.alias("frames")).write.mode("errorifexists").partitionBy("arm").json(folder)
