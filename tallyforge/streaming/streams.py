"""Streams over event files. Event times without a zone are read as UTC timestamps, which watermarks need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", time: str = "ts") -> DataFrame:
    """Parquet files of a folder as a stream, with their schema."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 4).parquet(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(rows: DataFrame, time: str, keys: list[str], length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Tumbling or sliding counts; rows later than the watermark are dropped."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(rows: DataFrame, time: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen(rows: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def idempotent(rows: DataFrame, keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Appends only rows whose identity the target lacks; replayed batches change nothing."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = fresh.join(batch.sparkSession.read.parquet(target).select(*keys), keys, "left_anti")
        except Exception as e:  # noqa: BLE001  the target doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(rows: DataFrame, name: str, mode: str = "append", then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over what is there now into a memory table; for tests and small results."""
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    out = rows.sparkSession.table(name)
    return then(out) if then else out
