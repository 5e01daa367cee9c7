"""Metrics over streams: a windowed confusion table with a watermark, in Structured Streaming.

Scalar functions of this library (distances, tokenizers, phonetics, stems) keep no state and run on streams unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def windowed_confusion(stream: DataFrame, ts: str, y_true: Column, y_pred: Column, window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """``start``, ``end``, ``y_true``, ``y_pred``, ``w``; rows later than the watermark are left out."""
    rows = stream.select(F.col(ts).cast("timestamp").alias("_ts"), y_true.alias("y_true"), y_pred.alias("y_pred")).withWatermark("_ts", watermark)
    w = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    return rows.groupBy(w.alias("_w"), "y_true", "y_pred").agg(F.count("*").alias("w")).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "y_true", "y_pred", "w")


def run_to_table(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Run a streaming query over what is there now into an in-memory table."""
    q = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
