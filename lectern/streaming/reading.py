"""Reading time as a stream: opening a book settles the one before it, closing settles it without opening another.

State is kept for each reader: the book that is open, and since when. Rows are taken in the order
in which they come, those of a batch by ts and event_id; a query that is started again goes on
from its checkpoint. For rows that come in the order of time, whatever their batches, the stream gives
what library.reading_segments gives of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.library import MAX_SECONDS, MIN_SECONDS

#: The state store that the operator needs: spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEGMENTS = "user_id long, book_id string, started_at long, seconds long"


class Reading(StatefulProcessor):
    """Segments of reading; a clock that went back, or less than MIN_SECONDS, records nothing, and none is over MAX_SECONDS."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "book_id string, started_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        come = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        book, since = self.open.get() if self.open.exists() else (None, None)
        found = []
        for next_book, at in zip(come["book_id"], come["at"].tolist(), strict=True):
            seconds = (at - since) // 1_000_000 if since is not None else 0
            if book is not None and seconds >= MIN_SECONDS:
                found.append((key[0], book, since, min(seconds, MAX_SECONDS)))
            # closing is opening no book
            book, since = (next_book, at) if isinstance(next_book, str) and next_book.strip() else (None, None)
        if book is None:
            self.open.clear()
        else:
            self.open.update((book, since))
        yield pd.DataFrame(found, columns=["user_id", "book_id", "started_at", "seconds"])

    def close(self) -> None:
        pass


def segments(opened: DataFrame) -> DataFrame:
    """(user_id, book_id, started_at, seconds) of a stream of openings: user_id, event_id, ts, book_id (blank or null: closed)."""
    timed = opened.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("book_id").cast("string").alias("book_id"))
    return timed.groupBy("user_id").transformWithStateInPandas(Reading(), SEGMENTS, "Append", "None")


def run(opened: DataFrame, path: str, checkpoint: str) -> None:
    """Appends the segments of what has come in since the last run to a table of Parquet files."""
    spark, name = opened.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        segments(opened).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
