"""Rows of blocks: a token has one for a span of chapters, however small the zones are, and its blocks are cut from it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from lectern.operators import index as I

CHAPTERS = "book_id string, chapter_index int, text string"


def _texts(n):
    return [" ".join(w for k, w in ((1, "all"), (3, "third"), (64, "seldom"), (4097, "far")) if i % k == 0) for i in range(n)]


def test_small_zones_make_no_more_rows(spark, tmp_path):
    texts = _texts(4200)
    chapters = spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], CHAPTERS)
    for zone in (5, 64):
        path, span = f"{tmp_path}/{zone}", zone * (4096 // zone)
        I.index_books(chapters, path, zone=zone)
        rows = spark.read.parquet(f"{path}/postings")
        assert {(r.token, r.span) for r in rows.collect()} == {(w, i // span) for i, t in enumerate(texts) for w in t.split()} and rows.count() == 8
        want: dict = {}
        for i, t in enumerate(texts):
            for w in t.split():
                want.setdefault((w, i // zone), []).append(i % zone)
        blocks = I._own_blocks(spark, path, I.live_runs(spark, path), ["all", "third", "seldom", "far"]).collect()
        assert {(r.token, r.zone): np.cumsum(r.gaps).tolist() for r in blocks} == want and len(blocks) == len(want)
        assert all((r.n, r.first, r["last"], r.span) == (len(p := want[r.token, r.zone]), p[0], p[-1], r.zone * zone // span) for r in blocks)


@pytest.mark.parametrize("batch", [1, 2, 100])
def test_rows_of_a_span_in_batches(monkeypatch, batch):
    monkeypatch.setattr(I, "BATCH_BLOCKS", batch)
    parts = [(pa.array(["x", "y"], pa.large_string()), np.array([0, 9, 4096 + 9, 4096 + 4095])), (pa.array(["y", "z"], pa.large_string()), np.array([9, 10, 4096 + 63, 4096 + 64]))]
    rows = pa.Table.from_batches(list(I._span_rows(2, parts, 64))).to_pylist()
    x, y, z = sorted(rows, key=lambda r: r["token"])
    assert x == {"token": "x", "span": 2, "zones": [128], "ends": [2], "firsts": [0], "lasts": [9], "gaps": [0, 9]}
    assert y == {"token": "y", "span": 2, "zones": [128, 191], "ends": [2, 3], "firsts": [9, 63], "lasts": [10, 63], "gaps": [9, 1, 63]}
    assert z == {"token": "z", "span": 2, "zones": [128, 129], "ends": [1, 2], "firsts": [63, 0], "lasts": [63, 0], "gaps": [63, 0]}


def test_runs_without_spans_are_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    I.index_books(spark.createDataFrame([("b", 0, "of the")], CHAPTERS), path)
    runs = [{k: v for k, v in r.items() if k != "span"} for r in I._runs(spark, path)]
    monkeypatch.setattr(I, "_runs", lambda *a: runs)
    with pytest.raises(ValueError, match="spans"):
        I.candidates(spark, path, "of")
