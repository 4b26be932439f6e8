"""Incremental work as streams: indexing new chapters, the latest progress of each book, reading sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import index, library

SESSION_GAP, LATENESS = "30 minutes", "1 hour"


def index_stream(chapters: DataFrame, path: str, checkpoint: str, name: str = "chapters") -> StreamingQuery:
    """Indexes the chapters that have come in since the last run and stops; the index is the one of operators/index.py.

    A chapter that comes again replaces the one before. A batch that is run again after its commit is passed over.
    """
    write = lambda batch, number: index.index_batch(batch, path, name, number)
    return chapters.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_stream(progress: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest progress of each book under path/<batch>: each batch is joined with the state before it."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, new = batch.sparkSession, batch
        if batch_id:
            new = spark.read.parquet(f"{path}/{batch_id - 1}").unionByName(new)
        library.latest(new, ["book_id"], ["ts"]).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return progress.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(opened: DataFrame, gap: str = SESSION_GAP, lateness: str = LATENESS) -> DataFrame:
    """(user_id, started_at, ended_at, events) of each session, a stream or not; a stream drops what comes in too late."""
    timed = opened.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.unix_micros("s.start").alias("started_at"), F.unix_micros("s.end").alias("ended_at"), "events")
