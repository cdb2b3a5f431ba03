"""Windows over a stream of events, and its state: an addition of ours.

Each function takes a streaming or a batch DataFrame with an event time; watermarks bound the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, at: str, length: str, slide: str | None, late: str, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Tumbling (no slide) or sliding windows."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    out = events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(*[v.alias(k) for k, v in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), *keys, *aggregates)


def sessions(events: DataFrame, at: str, gap: str, late: str, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*[v.alias(k) for k, v in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def first_seen(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """Rows whose key did not come before within the watermark (fingerprints of inputs already worked on)."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def append_log(rows: DataFrame, path: str, checkpoint: str):
    """Append a stream to a Parquet log; ``ledger.latest`` reads the latest rows from it. Exactly once by the sink's own log."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
