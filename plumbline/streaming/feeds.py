"""Feeds as streams: windowed counts with late rows, deduplication within a watermark, running histories.

Every function takes a streaming DataFrame and gives one; the same functions work on batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_feed(spark: SparkSession, folder: str, schema: StructType | str, per_batch: int = 4) -> DataFrame:
    """Parquet files of a folder as a stream, a few files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def windowed_counts(feed: DataFrame, at: str, by: list[str], window: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Rows and distinct-safe totals per window and group, for rows at most ``late`` behind the newest."""
    marked = feed.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    span = F.window(at, window, slide) if slide else F.window(at, window)
    return marked.groupBy(span.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def session_counts(feed: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    marked = feed.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), key, "n")


def deduplicated(feed: DataFrame, at: str, ids: list[str], late: str = "2 days") -> DataFrame:
    return feed.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(ids)


def running_counts(feed: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Per batch and key: rows seen so far and their mean, kept in state across batches."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n += len(frame)
            total += float(frame[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [group[0]], "n_so_far": [n], "mean_so_far": [total / n if n else None]})

    kind = dict(feed.dtypes)[key]
    return feed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n_so_far bigint, mean_so_far double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything that is there now, through the stream, as a table in memory (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
