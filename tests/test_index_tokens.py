"""The tokens that the index is made of are those of the column function, whatever the texts and parts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import index as I

TEXTS = ["Of THE of the", None, "", "林动走了。林动 a林1", "KK İx 9é9 naïve", "中", "一二三 一二 ab一cd", " \x00\x0bx\x1cy", "𠀀林𠀀动", "，。", "a" * 300 + "林" * 300, "mixed 文字 and Words"]


@pytest.mark.parametrize("part", [1, 16, 4 << 20])
def test_blocks_hold_the_tokens_of_the_column_function(spark, monkeypatch, part):
    monkeypatch.setattr(I, "PART_BYTES", part)
    monkeypatch.setattr(I, "BATCH_BLOCKS", 3)
    held = spark.createDataFrame([(i // 5, i % 5, t) for i, t in enumerate(TEXTS)] + [(1, 0, "林 again of the")], "zone int, place int, text string")
    want = {(r.token, r.zone, r.place) for r in held.select("zone", "place", F.explode(X.tokens(F.col("text"))).alias("token")).collect()}
    found = I._blocks_of_texts(held, 8).collect()
    places = lambda gaps: [sum(gaps[: i + 1]) for i in range(len(gaps))]
    assert {(r.token, r.zone, p) for r in found for p in places(r.gaps)} == want
    assert len({(r.token, r.zone) for r in found}) == len(found)
    assert all((r.n, r.first, r["last"]) == (len(r.gaps), places(r.gaps)[0], places(r.gaps)[-1]) for r in found)
