"""Readers of the corpus formats: JSON lines, ragged CSV, id lists, blacklists, nested maps, packed arrays."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, paths, schema: str, key: str | None = None, strict: bool = False) -> DataFrame:
    """JSON lines; strict fails on a bad line, else it is skipped. With key the last line of each key, by file and place, wins."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    parsed = lines.withColumn("_r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).where(F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{.*\}\s*$"))
    if key is None:
        return parsed.select("_r.*")
    last = parsed.groupBy(F.col(f"_r.{key}").alias("_k")).agg(F.max_by("_r", F.struct("_file", "_line")).alias("_r"))
    return last.select("_r.*")


def ragged_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with headers of their own, all strings; what a file lacks is null."""
    out = None
    for p in paths:
        one = spark.read.option("header", True).csv(p)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def id_list(spark: SparkSession, paths) -> DataFrame:
    """batch/scene/seg lines as columns id, batch, scene, seg; blank lines and repeats go."""
    parts = F.split(F.trim("value"), "/")
    return spark.read.text(paths).where(F.trim("value") != "").select(F.trim("value").alias("id"), *[F.get(parts, i).alias(n) for i, n in enumerate(("batch", "scene", "seg"))]).distinct()


def blacklist(spark: SparkSession, path: str, columns: tuple[str, ...] = ("scene",)) -> DataFrame:
    """A CSV list of keys; a scene given as a path counts by its last part."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.element_at(F.split(F.trim(c), "/"), -1).alias(c) for c in columns]).distinct()


def nested_map(spark: SparkSession, paths, value_schema: str) -> DataFrame:
    """Files that hold one JSON map each: path, key and the entry's fields."""
    text = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return text.select("path", F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias("key", "entry")).select("path", "key", "entry.*")


def packed_arrays(spark: SparkSession, paths, name: str) -> DataFrame:
    """Rows of a two-dimensional array in .npz files: path, pos, row (array<double>)."""
    import numpy as np
    import pandas as pd

    def unpack(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    a = np.asarray(z[name], dtype=float)
                if not len(a):
                    continue
                a = a.reshape(len(a), -1)
                yield pd.DataFrame({"path": path, "pos": range(len(a)), "row": list(a)})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(unpack, "path string, pos long, row array<double>")


def complete_folders(spark: SparkSession, root: str, required: list[str]) -> DataFrame:
    """Folders below root that hold all required files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    held = named.groupBy("folder").agg(F.collect_set("name").alias("names"))
    return held.where(F.size(F.array_intersect("names", F.array(*[F.lit(r) for r in required]))) == len(set(required))).select("folder")
