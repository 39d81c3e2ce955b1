"""Helpers of this subpackage: written tables in the shared folder, distributed ranks, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager, nullcontext
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one is made and set in local mode, and on a
    cluster that is an error, as its machines share no temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-viaduct-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_written: WeakKeyDictionary = WeakKeyDictionary()


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Spark deletes the shuffle files of each plan that runs inside as soon as it ends. Otherwise they stay until the
    driver's garbage is collected after Python has told the JVM what it let go, which its own thread does up to a second late."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Writes df once into the shared folder and reads it back: lineage ends there, and lost executors lose nothing.
    drop_shuffles: its shuffle files go when it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/viaduct-{uuid.uuid4().hex}"
    with shuffles_dropped(spark) if drop_shuffles else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = hadoop
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what table() wrote for these, which no later plan may read, and has the driver collect its garbage, so
    that Spark's cleaner removes shuffle files of plans that are gone."""
    for each in tables:
        path = _written.pop(each)
        path.getFileSystem(each.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    collected(tables[0].sparkSession)


def collected(spark: SparkSession) -> None:
    """Shuffle files live until the driver drops the plans that made them."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, use) -> Column:
    """use(value), evaluating value once (a one-element array carries it through a lambda)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo divisor: the folds of the contracts."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014) on checkpointed tables; every step is
    grouped minima, which combine before the shuffle, and joins with the written minima, which Spark broadcasts when
    small and otherwise can split, so a node with very many links is no hot task.
    Only nodes that have a link to another are returned.
    """
    links = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        links = table(small)
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
