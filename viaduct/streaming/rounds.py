"""Incremental rounds: new files are read once, judged, and merged so that a rerun of a round changes nothing."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rounds(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame], files_per_round: int = 100):
    """Runs all rounds that are due and stops; a round's rows whose key is in the target already are left out.

    The checkpoint remembers the files read; the anti-join makes a round that failed half way safe to repeat.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = work(batch.dropDuplicates([key]))
        try:
            new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:  # the first round finds no target
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.withColumn("round", F.lit(number)).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_round).parquet(source)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)


def windowed(events: DataFrame, at: str, length: str, late: str, key: str) -> DataFrame:
    """Counts in tumbling windows with a watermark; batch or stream."""
    held = events.withWatermark(at, late) if events.isStreaming else events
    return held.groupBy(F.window(at, length), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def settled(events: DataFrame, key: str, at: str, done: Column, late: str, idle_seconds: int) -> DataFrame:
    """key, first, last, n, ending of every key of a stream, once nothing more is to be waited for: finished, as soon as an
    event of it is done, or idle, when event time (less the watermark's delay) has passed its last event by the idle limit.
    A key that comes again later is counted anew. The state is four numbers a key, kept by Spark with the query's progress,
    so a restarted query goes on where it stopped; events later than the watermark are left out."""
    out = f"{key} string, first timestamp, last timestamp, n long, ending string"

    def step(name, batches, state):
        low, high, n = state.get if state.exists else (None, None, 0)
        row = lambda ending: pd.DataFrame({key: [name[0]], "first": [pd.Timestamp(low, unit="us")], "last": [pd.Timestamp(high, unit="us")], "n": [n], "ending": [ending]})
        if state.hasTimedOut:
            state.remove()
            yield row("idle")
            return
        over = False
        for pdf in batches:
            times = pdf["at"].astype("int64") // (1000 if str(pdf["at"].dtype).endswith("ns]") else 1)
            low = int(times.min()) if low is None else min(low, int(times.min()))
            high = int(times.max()) if high is None else max(high, int(times.max()))
            n += len(pdf)
            over |= bool(pdf["done"].any())
        if over:
            if state.exists:
                state.remove()
            yield row("finished")
            return
        state.update((low, high, n))
        state.setTimeoutTimestamp(max(high // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    given = events.select(F.col(key).cast("string").alias(key), F.col(at).alias("at"), F.coalesce(done, F.lit(False)).alias("done")).withWatermark("at", late)
    return given.groupBy(key).applyInPandasWithState(step, out, "low long, high long, n long", "append", "EventTimeTimeout")


def rerun(inputs: DataFrame, listed: DataFrame, key: str, target: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Works on the listed keys again, whatever is done already, and returns the current rows: of each key those of its last
    version. Outputs are versions in the target (_version counts up for every rerun), so nothing is overwritten, a rerun that
    fails half way is repeated under the same number, and listed keys without input are left as they are."""
    spark = inputs.sparkSession
    have = spark.read.parquet(target) if _there(spark, target) else None
    number = 0 if have is None else (have.agg(F.max("_version")).first()[0] or 0) + 1
    todo = inputs.join(listed.select(key).distinct(), key, "left_semi")
    work(todo).write.mode("overwrite").parquet(f"{target}/_version={number}")
    return current(spark, target, key)


def current(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The rows of every key's last version."""
    have = spark.read.parquet(target)
    last = have.groupBy(key).agg(F.max("_version").alias("_version"))
    return have.join(last, [key, "_version"]).drop("_version")


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
