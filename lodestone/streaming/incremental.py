"""Structured Streaming counterparts of polling: incremental indexing, sessions, windows. Extensions of the batch API."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_texts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Rows (ts, text) of a stream whose text was not seen within the delay, by content hash."""
    return stream.withColumn("hash", F.sha2("text", 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["hash"])


def index_incrementally(stream: DataFrame, folder: str, checkpoint: str, chunk) -> StreamingQuery:
    """Chunk every new document and append it to the index; a replayed batch overwrites its own folder."""

    def add(batch: DataFrame, number: int) -> None:
        chunk(batch).write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) by session windows; in batch and in streaming."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    found = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
