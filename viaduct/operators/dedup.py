"""Exact and grid duplicates, folding, and what is still to do."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def folded(rows: DataFrame, key: list[Column | str], order: list[Column | str], name: str) -> DataFrame:
    """Every row, with the representative (name of the first of its key) and whether it is folded into it."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumns({"representative": F.first(name).over(w), "folded": F.row_number().over(w) > 1})


def vector_signature(vector: Column, decimals: int = 9) -> Column:
    """A digest of a vector rounded to decimals: equal for vectors that are equal but for rounding noise."""
    return F.sha2(F.array_join(F.transform(vector, lambda x: F.format_number(x.cast("double"), decimals)), ","), 256)


def grid_share(rows: DataFrame, entry: str, value: str, eps: Column) -> DataFrame:
    """The largest share of an entry's values that fall into one grid cell round(value / eps), halves to even."""
    cells = rows.withColumn("cell", F.bround(F.col(value) / eps)).groupBy(entry, "cell").agg(F.count("*").alias("c"))
    return cells.groupBy(entry).agg(F.sum("c").alias("n"), F.max("c").alias("biggest")).withColumn("dup_share", F.col("biggest") / F.col("n"))


def ready(upstream: DataFrame, downstream: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are done upstream and not yet downstream."""
    return upstream.select(*key).distinct().join(downstream.select(*key).distinct(), key, "left_anti")


def stale(upstream: DataFrame, downstream: DataFrame, key: list[str], at: str) -> DataFrame:
    """Keys whose output is missing or older than their input, with the reason."""
    done = downstream.groupBy(*key).agg(F.max(at).alias("_done"))
    made = upstream.groupBy(*key).agg(F.max(at).alias("_made"))
    why = F.when(F.col("_done").isNull(), "missing").when(F.col("_done") < F.col("_made"), "older")
    return made.join(done, key, "left").select(*key, why.alias("reason")).where("reason IS NOT NULL")


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the folder of spark.checkpoint.dir; where it is unset, local mode gets a temporary one and a
    cluster an error, as its machines share no temporary folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-viaduct-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """Connected components (node, component: the least node) of undirected edges (a, b), by least labels that hop along
    links and then along labels until no label falls; every round is a join and a grouped minimum, checkpointed. Labels
    only fall, so their sum tells when to stop."""
    links = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = links.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    before = None
    while True:
        offered = links.join(nodes.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offered"))
        hop = nodes.join(offered, "node", "left").select("node", F.least("component", F.coalesce("offered", "component")).alias("component"))
        jump = hop.select(F.col("node").alias("component"), F.col("component").alias("further"))
        nodes = checkpointed(hop.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")))
        now = nodes.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return nodes
        before = now
