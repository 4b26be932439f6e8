"""Tables that change together: cascades in one commit, writers at once, failed writers; reading time as a stream; fused ranks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import commits, tables
from lectern.operators import index as I
from lectern.operators import library as B
from lectern.streaming import reading


def _ids(df):
    return sorted(r.book_id for r in df.collect())


def test_forgetting_takes_everything_along(spark, tmp_path):
    path = str(tmp_path)
    tables.save_books(spark, path, spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "book_id string, title string, added_at long"))
    tables.save_books(spark, path, spark.createDataFrame([("b", "B2", 9), ("c", "C", 3)], "book_id string, title string, added_at long"))
    assert sorted((r.book_id, r.title, r.added_at) for r in tables.snapshot(spark, path).table("books").collect()) == [("a", "A", 1), ("b", "B2", 2), ("c", "C", 3)]
    tables.add_rows(spark, path, "bookmarks", spark.createDataFrame([("a", 1, 0.5, "x", 1), ("b", 1, 0.5, None, 2), ("gone", 1, 0.5, "z", 3)], B.BOOKMARK))
    tables.add_rows(spark, path, "sessions", spark.createDataFrame([("b", 1, 2, 60)], tables.SESSION))
    I.index_books(spark.createDataFrame([("a", 0, "of the"), ("b", 0, "of the")], "book_id string, chapter_index int, text string"), path)
    tables.set_note(spark, path, spark.createDataFrame([("a", 1, 1, "  new "), ("b", 1, 2, "　")], "book_id string, chapter_index int, created_at long, note string"))
    before = tables.snapshot(spark, path)
    assert sorted((r.book_id, r.note) for r in before.table("bookmarks").collect()) == [("a", "new"), ("b", "")]
    after = tables.forget(spark, path, spark.createDataFrame([("b",)], "book_id string"))
    assert after.number == before.number + 1
    assert _ids(after.table("books")) == ["a", "c"] and _ids(after.table("bookmarks")) == ["a"] and after.table("sessions").count() == 0
    assert _ids(I.indexed_books(spark, path)) == ["a"] and _ids(I.candidates(spark, path, "of the")) == ["a"]
    # an older snapshot is still what it was
    assert _ids(before.table("books")) == ["a", "b", "c"] and before.table("sessions").count() == 1
    tables.save_settings(spark, path, {"theme": "dark"}, ["theme"])
    assert tables.vacuum(spark, path) == [] and tables.vacuum(spark, path, hours=0)
    assert _ids(tables.snapshot(spark, path).table("books")) == ["a", "c"]


def test_a_second_writer_is_refused_and_a_failed_one_changes_nothing(spark, tmp_path):
    path, one_book = str(tmp_path), "book_id string, title string"
    tables.save_books(spark, path, spark.createDataFrame([("a", "A")], one_book))
    mine, theirs = tables.snapshot(spark, path), tables.snapshot(spark, path)
    theirs.commit({"books": spark.createDataFrame([("theirs", "T")], one_book)})
    with pytest.raises(commits.Conflict):
        mine.commit({"books": spark.createDataFrame([("mine", "M")], one_book)})
    assert _ids(tables.snapshot(spark, path).table("books")) == ["theirs"]
    with pytest.raises(Exception, match="lost"):
        tables.change(spark, path, lambda now: {"bookmarks": now.table("bookmarks"), "books": now.table("books").withColumn("title", F.raise_error(F.lit("lost")))})
    assert _ids(tables.snapshot(spark, path).table("books")) == ["theirs"]
    # change() tries again on the newer snapshot
    seen = []

    def work(now):
        if not seen:
            now.commit({"books": spark.createDataFrame([("between", "B")], one_book)})
        seen.append(_ids(now.table("books")))
        return {"books": now.table("books").unionByName(B.migrated(spark.createDataFrame([("late", "L")], one_book), B.BOOK))}

    tables.change(spark, path, work)
    assert seen == [["theirs"], ["between"]] and _ids(tables.snapshot(spark, path).table("books")) == ["between", "late"]


EVENTS = "user_id long, event_id long, ts timestamp, book_id string"


@pytest.mark.parametrize("cuts", [(0, 1000), (0, 1, 2, 300, 301, 700, 1000)])
def test_stream_of_reading_equals_the_batch(spark, tmp_path, cuts):
    rng = random.Random(2)
    at, rows = 1_700_000_000, []
    for i in range(1000):
        at += rng.choice([0, 1, 29, 30, 31, 500, 90_000])
        rows.append((rng.randrange(4), i, at, f"b{rng.randrange(3)}"))
    frame = lambda part: spark.createDataFrame(part, "user_id long, event_id long, ts long, book_id string").withColumn("ts", F.timestamp_seconds("ts"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", reading.STATE_STORE)
    try:
        for a, b in zip(cuts, cuts[1:]):
            frame(rows[a:b]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            # each run goes on from the checkpoint of the one before
            stream = reading.segments(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = spark.read.parquet(str(tmp_path / "out"))
    want = B.reading_segments(frame(rows))
    assert sorted(map(tuple, found.select("user_id", "started_at", "seconds").collect())) == sorted(map(tuple, want.collect()))
    books = {(u, t * 1_000_000): b for u, _, t, b in rows}
    assert all(r.book_id == books[r.user_id, r.started_at] for r in found.collect())


def test_fused_ranks(spark):
    rows = [(1, "a", 10, 1), (1, "a", 20, 2), (1, "a", 20, 9), (1, "b", 20, 1), (1, "b", 30, 2), (2, "a", 7, 5), (2, "b", 5, 5), (2, "b", 6, 3)]
    found = B.fused(spark.createDataFrame(rows, "query_id long, list string, item_id long, rank int")).collect()
    assert [(r.query_id, r.item_id, r["rank"]) for r in sorted(found, key=lambda r: (r.query_id, r["rank"]))] == [(1, 20, 1), (1, 10, 2), (1, 30, 3), (2, 6, 1), (2, 5, 2), (2, 7, 3)]
    assert {r.item_id: r.score for r in found if r.query_id == 1} == {20: 1 / 61 + 1 / 62, 10: 1 / 61, 30: 1 / 62}
