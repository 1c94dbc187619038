"""Streams (the batch operators over readStream sources)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of tumbling windows; rows later than `late` are left out once their window is closed."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def first_seen(rows: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once; its state goes after `late`."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Applies a batch operator to what has arrived, and ends."""

    def each(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
