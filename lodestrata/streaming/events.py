"""Event-time streams: windows, service levels, limits, deduplicated ingest, entries that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import content_hash


def read(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder; the number per batch bounds how fast a backlog is taken."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def timed(events: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events with a watermark; times without a zone, which take none, are read in the session's."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def window_error_rates(events: DataFrame, is_error: Column, width: str, slide: str | None = None, time: str = "ts") -> DataFrame:
    """(window_start, n, errors) of tumbling or sliding windows."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(is_error).alias("errors"))
    return out.select(F.col("w.start").alias("window_start"), "n", "errors")


def over_limit(events: DataFrame, client: str, width: str, limit: int, time: str = "ts") -> DataFrame:
    """(window_start, client, n) of clients beyond the limit of a window."""
    out = events.groupBy(F.window(time, width).alias("w"), client).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    return out.select(F.col("w.start").alias("window_start"), client, "n")


def new_documents(docs: DataFrame, text: str, time: str | None = None) -> DataFrame:
    """Documents whose content the stream hasn't had; with a watermark only as long as that reaches, so that the state stays bounded."""
    hashed = docs.withColumn("file_hash", content_hash(F.col(text)))
    return hashed.dropDuplicatesWithinWatermark(["file_hash"]) if time else hashed.dropDuplicates(["file_hash"])


def live_entries(entries: DataFrame, ttl_ms: int) -> DataFrame:
    """(key, value, state) per batch of a cache stream (key, value): the last value ``set``, and ``expired`` after ttl_ms without another."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (value,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [value], "state": ["expired"]})
            return
        value = None
        for rows in batches:
            value = rows["value"].iloc[-1]
        state.update((value,))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": [key[0]], "value": [value], "state": ["set"]})

    return entries.groupBy("key").applyInPandasWithState(keep, "key string, value string, state string", "value string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Takes all that is there and stops: the scheduled ingest; a next run goes on from the checkpoint, and none overlap on it."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
