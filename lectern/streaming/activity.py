"""An extension: chunks as they arrive, and windows over events. What is matched has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import text


def windowed_activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events (ts, event_type, value), batch or stream, counted and summed by window and type; rows later than `late` go."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = at.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def ingest_stream(spark: SparkSession, folder: str, schema: str, to: str, checkpoint: str) -> StreamingQuery:
    """Texts from a folder's new files with language and token estimate, appended exactly once per micro-batch."""
    found = spark.readStream.schema(schema).parquet(folder)
    rows = found.withColumns({"language": text.language(F.col("text")), "tokens": text.estimated_tokens(F.col("text"))})
    return rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
