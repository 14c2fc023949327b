"""Structured Streaming counterparts: windowed counts with late data, running status of keys.

The batch operators are the reference point: over a finished input these give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources.sinks import latest_status


def stream_table(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, at: str, keys: list[str], value: str, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(window_start, keys, n, total) per tumbling window; rows later than `late` behind the newest are dropped by the watermark."""
    w = events.withWatermark(at, late) if events.isStreaming else events
    out = w.groupBy(F.window(at, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def status_sink(events: DataFrame, path: str, checkpoint: str, key: str, at: str) -> StreamingQuery:
    """Keeps at `path`/batch=N the last event of each key of every micro-batch; latest_status over the folder is the state.

    Writing by batch number makes a repeated batch replace its own output.
    """
    def write(batch: DataFrame, number: int) -> None:
        latest_status(batch, key, at).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
