"""Streaming forms of the time rules and of ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_path

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def globbed(path: str) -> str:
    """The path as a pattern that matches itself: a stream takes a folder of files, and a single file only by a pattern."""
    return f"{path[:-1]}[{path[-1]}]"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table of files as a stream, with times that watermarks accept."""
    batch = spark.read.parquet(path)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 4).parquet(globbed(path)).withColumn("ts", F.col("ts").cast("timestamp"))


def span(events: DataFrame) -> str:
    """A lateness that no event of a table exceeds."""
    seconds = events.agg((F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) - F.unix_seconds(F.min(F.col("ts").cast("timestamp")))).alias("s")).first().s
    return f"{(seconds or 0) + 3600} seconds"


def usage_stream(events: DataFrame, limit: int, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(user_id, window_start, used) per fixed window, for update or complete mode."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", window).alias("w")).agg(F.least(F.count("*"), F.lit(limit)).alias("used"))
    return g.select("user_id", F.col("w.start").alias("window_start"), "used")


def settled(written: DataFrame, key: str) -> DataFrame:
    """What holds in the end of all rows that ``run_once`` has written: each key's row of the last batch."""
    rest = [c for c in written.columns if c not in (key, "batch_no", "batch")]
    return written.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_no").alias("x")).select(key, "x.*")


def run_once(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, progress: list | None = None) -> DataFrame:
    """Work off what is there, batch by batch, and return what was written: all rows of all batches.

    State lies in RocksDB, which the stateful rules need. ``progress`` takes what each batch reports. ``each`` goes over every batch instead of a plain write; it takes (batch, number) and the result is empty.
    """
    spark = stream.sparkSession
    out = shared_path(spark, "stream")

    def write(batch: DataFrame, n: int) -> None:
        if each:
            each(batch, n)
        else:
            batch.withColumn("batch_no", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    kept = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, kept)
    if progress is not None:
        progress += q.recentProgress
    return spark.read.parquet(f"{out}/batch=*") if not each else spark.range(0)


def ingest_stream(docs: DataFrame, chunker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Documents as they arrive -> chunks, one batch after another; a batch that is run again gives the same files."""
    spark = docs.sparkSession
    out = shared_path(spark, "chunks")

    def each(batch: DataFrame, n: int) -> None:
        chunker(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    run_once(docs, each=each)
    return spark.read.parquet(f"{out}/batch=*")
