"""The index on disk: commits, failed runs, replaced and dropped books, merges, ordered blocks and early stops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import commits
from lectern.operators import index as I
from lectern.operators import search as S

CHAPTERS = "book_id string, chapter_index int, text string"


def pairs(df):
    return {(r.book_id, r.chapter_index) for r in df.collect()}


@pytest.fixture
def chapters(spark):
    return spark.createDataFrame([("b1", 0, "of the town"), ("b2", 3, "the"), ("b3", 1, "the rest of it"), ("b3", 2, "of the"), ("b4", 0, None), ("b4", 1, "")], CHAPTERS)


def test_replace_drop_and_on_demand(spark, tmp_path, chapters):
    path = str(tmp_path)
    found = lambda: pairs(I.candidates(spark, path, "of the"))
    assert found() == set() and I.indexed_books(spark, path).count() == 0
    I.index_books(chapters, path, chapters.select("book_id", F.lit("1:2").alias("fingerprint")).distinct())
    assert found() == {("b1", 0), ("b3", 1), ("b3", 2)}
    # again, with other texts and fewer chapters
    I.index_books(spark.createDataFrame([("b2", 3, "of the"), ("b3", 1, "of it all")], CHAPTERS), path)
    assert found() == {("b1", 0), ("b2", 3)}
    assert {r.book_id: (r.fingerprint, r.chapters, r.generation) for r in I.indexed_books(spark, path).collect()} == {"b1": ("1:2", 1, 1), "b2": ("unknown", 1, 2), "b3": ("unknown", 1, 2), "b4": ("1:2", 2, 1)}
    I.index_books(chapters.limit(0), path)
    assert len(I._runs(spark, path)) == 2
    I.drop_books(spark.createDataFrame([("b1",), ("gone",)], "book_id string"), path)
    assert found() == {("b2", 3)} and I.indexed_books(spark, path).count() == 3
    files = spark.createDataFrame([("b1", "1:2"), ("b2", "unknown")], "book_id string, fingerprint string")
    I.index_on_demand(chapters.filter("book_id < 'b3'"), files, path)
    assert found() == {("b1", 0), ("b2", 3)}
    texts = S.texts_of(spark.createDataFrame([("b1", 0, "Of  The, of the"), ("b2", 3, None)], CHAPTERS))
    assert [(r.book_id, r.hit_count) for r in I.verified(spark, path, texts, "of the").collect()] == [("b1", 1)]
    assert found() == pairs(I.candidates(spark, path, "The OF")) and pairs(I.candidates(spark, path, "，")) == set()


def test_a_failed_run_leaves_nothing(spark, tmp_path, chapters, monkeypatch):
    path = str(tmp_path)
    I.index_books(chapters.filter("book_id = 'b1'"), path)
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            I.index_books(spark.createDataFrame([("b1", n, "of the") for n in range(4)], CHAPTERS), path)
    assert pairs(I.candidates(spark, path, "of the")) == {("b1", 0)}
    I.index_books(spark.createDataFrame([("b1", n, "of the") for n in (5, 6)], CHAPTERS), path)
    assert pairs(I.candidates(spark, path, "of the")) == {("b1", 5), ("b1", 6)}
    assert I.vacuum(spark, path) == []
    assert len(I.vacuum(spark, path, hours=0)) == 1
    assert pairs(I.candidates(spark, path, "of the")) == {("b1", 5), ("b1", 6)}


def test_batches_count_once_and_replace_chapters(spark, tmp_path):
    path, found = str(tmp_path), lambda: pairs(I.candidates(spark, str(tmp_path), "of the"))
    I.index_books(spark.createDataFrame([("b", n, "of the") for n in range(3)], CHAPTERS), path)
    late = spark.createDataFrame([("b", 1, "nothing"), ("b", 7, "the of"), ("c", 0, "of the")], CHAPTERS)
    I.index_batch(late, path, "s", 0)
    I.index_batch(late.withColumn("text", F.lit("x")), path, "s", 0)
    assert found() == {("b", 0), ("b", 2), ("b", 7), ("c", 0)}
    assert {r.book_id: r.chapters for r in I.indexed_books(spark, path).collect()} == {"b": 4, "c": 1}
    I.index_books(spark.createDataFrame([("b", 9, "of the")], CHAPTERS), path)
    I.drop_books(spark.createDataFrame([("c",)], "book_id string"), path)
    assert found() == {("b", 9)}
    I.merge(spark, path)
    assert found() == {("b", 9)} and {r.book_id: (r.chapters, r.generation) for r in I.indexed_books(spark, path).collect()} == {"b": (1, 3)}


def _random(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["of", "the"]
    return [(f"book{rng.randrange(9)}", i, " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(n)]


def _brute(rows, *tokens):
    return {(b, c) for b, c, t in rows if all(x in t.split() for x in tokens)}


@pytest.mark.parametrize("zone", [7, 64, I.ZONE])
def test_merge_equals_a_fresh_index(spark, tmp_path, zone):
    rows, path = _random(300, 1), str(tmp_path)
    frame = lambda part: spark.createDataFrame(part, CHAPTERS)
    I.index_books(frame([(b, c + 1000, "of the w1") for b, c, _ in rows if b == "book3"]), path, zone=zone)
    for k in range(3):
        I.index_books(frame([r for r in rows if int(r[0][4:]) % 3 == k]), path, zone=zone)
    before = len(list(tmp_path.glob("postings/run=*/part=*/*.parquet")))
    I.merge(spark, path, zone=13 if zone == 7 else zone)
    assert len(I._runs(spark, path)) == 1
    I.vacuum(spark, path, hours=0)
    assert len(list(tmp_path.glob("postings/run=*/part=*/*.parquet"))) < before
    for tokens in (("of",), ("of", "the"), ("w1", "w2", "of"), ("w5",), ("nowhere", "of")):
        assert pairs(I.candidates(spark, path, " ".join(tokens))) == _brute(rows, *tokens)
    I.drop_books(spark.createDataFrame([("book3",)], "book_id string"), path)
    assert pairs(I.candidates(spark, path, "of")) == {p for p in _brute(rows, "of") if p[0] != "book3"}


def test_writers_at_once(spark, tmp_path):
    path, log = str(tmp_path), f"{tmp_path}/log"
    one = I.write_run(spark.createDataFrame([("a", 0, "of the")], CHAPTERS), path)
    two = I.write_run(spark.createDataFrame([("b", 0, "of the")], CHAPTERS), path)
    number, state = commits.last(spark, log)
    commits.commit(spark, log, number + 1, {"runs": [one | {"version": 1}]})
    with pytest.raises(commits.Conflict):
        commits.commit(spark, log, number + 1, {"runs": [two | {"version": 1}]})
    commits.change(spark, log, lambda state, n: state | {"runs": [*state["runs"], two | {"version": n}]})
    assert pairs(I.candidates(spark, path, "of the")) == {("a", 0), ("b", 0)}
    # a merge whose runs another merge has taken is refused
    runs = I._runs(spark, path)
    I.merge(spark, path)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(I, "_runs", lambda *a: runs)
        with pytest.raises(commits.Conflict):
            I.merge(spark, path)


@pytest.mark.parametrize("runs", [1, 3])
def test_early_stop(spark, tmp_path, runs):
    rows, path = _random(1500, 2), str(tmp_path)
    rows = [(b, c, t + (" of the" if c % 4 == 0 else "")) for b, c, t in rows]
    for k in range(runs):
        I.index_books(spark.createDataFrame([r for r in rows if int(r[0][4:]) % runs == k], CHAPTERS), path, zone=16)
    texts = S.texts_of(spark.createDataFrame(rows, CHAPTERS))
    ordered = sorted(r for r in rows if (r[0], r[1]) in _brute(rows, "of", "the"))
    for limit, most in ((1, 2000), (10, 2000), (40, 25), (10**6, 2000), (10**6, None), (5, None)):
        want, hits = [], 0
        for n, (b, c, t) in enumerate(ordered):
            if hits >= limit or most is not None and n >= most:
                break
            want.append((b, c, t.count("of the")))
            hits += want[-1][2] > 0
        shown, progress = I.first_hits(spark, path, texts, "of the", limit, most)
        assert sorted((r.book_id, r.chapter_index, r.hit_count) for r in shown.collect()) == want
        if limit <= 10:
            assert progress.blocks_read < len(ordered) and progress.zones_read < progress.zones and progress.verified < len(ordered) / 2
    assert I.first_hits(spark, path, texts, "，")[0].count() == 0
