"""Streaming twins of the cursor-driven operators: the same results, kept up by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they come. A single file has to be given as a pattern, a stream takes plain paths for folders."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts per window; a window is final once the watermark has passed its end."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, time: str, width: str, slide: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """Counts per session, which a pause of more than `gap` ends."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """Each event once; its key is remembered as long as the watermark lets copies in."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def run_to_end(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, output: str | None = None, mode: str = "append") -> None:
    """Process all that is there, then stop. A sink gets each batch with its number, which a restart repeats."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", output).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if (failure := query.exception()) is not None:
        raise failure
