"""Streaming request counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketspark.session import is_folder


def request_windows(requests: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """R1. Requests per user and tumbling window in event time.

    The watermark both closes a window and frees its state, which is also the sweep of old
    counters (R2): a window is emitted once it ends at or before the newest time minus ``delay``.
    So the windows that are still open at the end of a replay are not in the result, and neither are rows that
    arrive more than ``delay`` behind the newest row of an earlier micro-batch: both follow from append mode.
    """
    return (
        requests.withWatermark("ts", delay)
        .groupBy("user_id", F.window("ts", window).alias("_window"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("user_id", F.col("_window.start").alias("window_start"), "count")
    )


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what the stream emits to a Parquet table; works through all there is, then stops."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The table ``folder/name`` as a stream, whether it is one file or a folder of part files."""
    if is_folder(spark, f"{folder}/{name}"):
        return read_stream(spark, f"{folder}/{name}", None, files_per_batch)
    return read_stream(spark, folder, name, files_per_batch)


def read_stream(spark: SparkSession, folder: str, file_glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet folder as a stream, with the schema that its files have now."""
    sample = spark.read.option("pathGlobFilter", file_glob or "*").parquet(folder)
    reader = spark.readStream.schema(sample.schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
