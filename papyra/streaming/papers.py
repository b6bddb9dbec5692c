"""Structured Streaming forms of ingestion: filtered papers as they arrive, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.records import in_categories
from papyra.sources.papers import PAPER


def stream_papers(spark: SparkSession, path: str, wanted: list[str], files_per_trigger: int = 64) -> DataFrame:
    """Papers of the wanted categories from JSON-lines files dropped into a folder."""
    rows = spark.readStream.schema(PAPER).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)
    return rows.where(in_categories(F.col("categories"), wanted))


def first_deliveries(stream: DataFrame, keys: list[str], time: str, late: str = "30 days") -> DataFrame:
    """Each key's first row; state is forgotten once the watermark has passed a row's time."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of ``value`` per tumbling window and ``by``, final once the watermark has passed the window."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), by, "n", "total")


def run_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process what is there, append it as Parquet, and stop."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
