"""Streaming variant of the ingest: deduplication within a watermark and look-back windows, with an idempotent sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState


def stream_table(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def with_event_time(rows: DataFrame, column: str, late: str = "2 hours") -> tuple[DataFrame, DataFrame]:
    """(timed rows with a watermark, rows without a time): a watermark would not keep the latter."""
    return rows.filter(F.col(column).isNotNull()).withWatermark(column, late), rows.filter(F.col(column).isNull())


def first_within_watermark(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key; the state of keys is dropped behind the watermark."""
    return rows.dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, column: str, keys: list[str], width: str = "26 hours", slide: str = "24 hours") -> DataFrame:
    """(window_start, keys, n) of sliding look-back windows."""
    grouped = rows.groupBy(F.window(column, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n")


def cached_answers(rows: DataFrame, ttl_seconds: int = 30 * 86400, late: str = "1 hour") -> DataFrame:
    """(key, payload, is_hit) for keys that ask, from a keyed store whose entries expire (J-4, K-4, T-11).

    rows: a stream (key string, payload string, at timestamp); a row with a payload stores it, of several in one batch the latest, one
    without asks. State is partitioned by key; an entry goes when the watermark passes its time to live, and is no hit after it.
    """

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = 0
        asked = 0
        stored: list[tuple[int, str]] = []
        for batch in batches:
            times = batch["at"].astype("int64") // 1_000_000_000 if str(batch["at"].dtype).endswith("[ns]") else batch["at"].map(lambda x: int(x.timestamp()))
            stored += [(int(t), p) for t, p in zip(times, batch["payload"]) if p]
            asked += sum(1 for p in batch["payload"] if not p)
            last = max(last, int(times.max()))
        if stored:
            state.update(max(stored)[::-1])
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (max(stored)[0] + ttl_seconds) * 1000))
        if asked:
            known = state.get[0] if state.exists and state.get[1] + ttl_seconds >= last else None
            yield pd.DataFrame({"key": [key[0]], "payload": [known], "is_hit": [known is not None]})

    timed = rows.select("key", "payload", "at").withWatermark("at", late)
    return timed.groupBy("key").applyInPandasWithState(serve, "key string, payload string, is_hit boolean", "payload string, at bigint", "append", "EventTimeTimeout")


def idempotent_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: a repeated batch replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; restarts go on from the checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(idempotent_writer(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
