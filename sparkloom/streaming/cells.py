"""Tensors from streams: cells summed over watermarked time windows, and a running tensor kept by foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_cells(events: DataFrame, indices: list[str], value: str, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, i0, ..., v): sums per cell and window; state of windows past the watermark is dropped. Works on batches as well."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    keys = [F.col(c).alias(f"i{k}") for k, c in enumerate(indices)]
    return source.groupBy(F.window(time, window).alias("w"), *keys).agg(F.sum(value).alias("v")).select(F.col("w.start").alias("start"), *[f"i{k}" for k in range(len(indices))], "v")


def accumulate(cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every batch of closed windows to a Parquet table, by batch number, so a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
