"""Streams: image files as they arrive, and windowed sums over a stream of readings with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def arriving_files(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    """A stream of new files in a folder: path, modificationTime, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Count, sum and range of readings (ts, event_type, value) in tumbling or sliding windows.

    On a stream, state is kept until the watermark passes, ``late`` behind the latest row.
    """
    if events.isStreaming:
        events = events.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.groupBy(w.alias("win"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return out.select(c("win.start").alias("win_start"), "event_type", "n", "total", "lo", "hi")
