"""Consumers as Structured Streaming queries: drain, offsets, late data, heartbeats and rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_log(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """New files of a log folder as a stream; `max_files` bounds a poll."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], timeout: int | None = None) -> None:
    """Everything there is now, batch by batch; positions are in the checkpoint, so the next call goes on from there.

    After `timeout` seconds, if given, the query is stopped and TimeoutError raised.
    """
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"not drained in {timeout} s")


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts per topic; an extension, as the log itself knows no watermark."""
    ts = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return ts.groupBy("topic", F.window("at", width).alias("w")).agg(F.count("*").alias("n")).select("topic", "w.start", "n")


def commit_offsets(path: str, consumer: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the highest offset of each topic to an offsets table; a batch that runs twice commits the same."""

    def each(batch: DataFrame, epoch: int) -> None:
        ends = batch.groupBy("topic").agg(F.max(F.col("byte_offset") + F.col("total_size")).alias("offset"))
        ends.withColumns({"consumer": F.lit(consumer), "epoch": F.lit(epoch)}).write.mode("append").parquet(path)

    return each


def committed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("consumer", "topic").agg(F.max_by("offset", "epoch").alias("offset"))


def rate_limited(stream: DataFrame, limit: int) -> DataFrame:
    """Granted bytes of requests (key, ms, want) under a token bucket per key: one second of burst, integer refill."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (limit, None)
        rows = pd.concat(list(frames)).sort_values("ms", kind="stable")
        granted = []
        for ms, want in zip(rows["ms"].tolist(), rows["want"].tolist(), strict=True):
            last = ms if last is None else last
            more = limit * (ms - last) // 1000
            if more > 0:
                tokens, last = min(limit, tokens + more), ms
            granted.append(min(tokens, want))
            tokens -= granted[-1]
        state.update((tokens, last))
        yield rows[["key", "ms", "want"]].assign(granted=granted)

    return stream.groupBy("key").applyInPandasWithState(step, "key string, ms long, want long, granted long", "tokens long, last long", "append", GroupStateTimeout.NoTimeout)


def workers_seen(stream: DataFrame) -> DataFrame:
    """The last heartbeat of each worker (worker, at_ms), as a running state."""
    return stream.groupBy("worker").agg(F.max("at_ms").alias("at_ms"))
