"""Carrying values over spans, with one group that holds most rows."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import library as B
from lectern.operators.ordinals import carried
from lectern.sources import books


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("backward", [True, False])
def test_carried(spark, own, backward):
    rng = random.Random(3)
    rows = [("hot", i * 3, rng.choice([None, None, None, f"v{i}"])) for i in range(300)] + [(None, 5, "n"), (None, 900, None), ("empty", 1, None), ("empty", 99, None), ("neg", -7, "a"), ("neg", -70, None), ("neg", 2, None)]
    df = spark.createDataFrame(rows, "k string, o long, v string").repartition(5)
    found = {(r.k, r.o): r.c for r in carried(df, "k", "o", F.col("v"), "c", span=16, own=own, backward=backward).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        last = None
        for _, o, v in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1] if backward else r[1]):
            if not own:
                want[k, o] = last
            last = v or last
            if own:
                want[k, o] = last
    assert found == want


def test_lines_find_their_chapters(spark):
    rng = random.Random(5)
    lines, chapters, at = [], [], 0
    for n in range(3000):
        if rng.random() < 0.02:
            # a chapter may begin within a line
            chapters.append(["hot", len(chapters), at + rng.choice([0, 0, 1]), None])
        size = rng.randrange(2, 2000)
        lines.append(("hot", n, at, at + size, f"l{n}"))
        at += size
    for a, b in zip(chapters, chapters[1:]):
        a[3] = b[2]
    chapters[-1][3] = at - 4000
    df = books.chapter_texts(spark.createDataFrame(lines, "book_id string, line_no long, start long, stop long, line string"), spark.createDataFrame(chapters, "book_id string, chapter_index long, start long, stop long"))
    want = {i: "\n".join(line for _, _, a, _, line in lines if start <= a < stop) for _, i, start, stop in chapters}
    assert {r.chapter_index: r.text for r in df.collect()} == {i: t for i, t in want.items() if t}


def test_many_places_in_one_chapter_take_linear_time(spark):
    marks = spark.range(32_000).select(F.lit("b").alias("book_id"), F.lit(1).alias("chapter_index"), (F.col("id") / 32_000.0).alias("ratio"), "id").withColumnRenamed("id", "created_at")
    took = {}
    for n in (8_000, 64_000):
        places = spark.range(n).select(F.col("id").alias("place_id"), F.lit("b").alias("book_id"), F.lit(1).alias("chapter_index"), ((F.col("id") * 7919 % n) / float(n)).alias("ratio"))
        began = time.perf_counter()
        assert B.near_all(marks, places).count() == n
        took[n] = time.perf_counter() - began
    # eight times as many: a frame that is gone through anew for each place would take sixty times as long
    assert took[64_000] < 16 * max(took[8_000], 1)
