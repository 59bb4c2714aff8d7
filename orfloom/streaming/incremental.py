"""Incremental jobs over file streams: first-occurrence de-duplication and resumable work lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def dedup_stream(stream: DataFrame, keys: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """First occurrence per key. Without a delay every key is remembered for ever; with one, state older than
    the watermark is dropped and repeats further apart than the delay pass."""
    if time is None or delay is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all files not yet seen by this checkpoint, append the result as Parquet, then stop.

    Running it again with the same checkpoint resumes after the last finished batch.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", path)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The same with a batch function, for sinks that are not files."""
    query = (
        stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
