"""A chunk's first document is searched like any other."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lectern.llm import recompression as R
from lectern.llm import substring_dedup as S

NO_HINTS = pa.table({"to_chunk": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "stop": pa.array([], pa.int32())})


def _chunk(texts: list[str]) -> pa.Table:
    n = len(texts)
    return pa.table({"chunk": pa.array([0] * n, pa.int32()), "doc_id": pa.array(range(n), pa.int64()), "h1": pa.array(range(n), pa.int64()), "h2": pa.array(range(n), pa.int64()), "text": texts})


def test_opening_of_the_first_document_shares_its_anchor():
    for seed in range(300):
        rng = random.Random(seed)
        prose = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
        opening = prose(S.WINDOW)
        c = S._Chunk(_chunk([f"{opening} {prose(15)}", f"{prose(9)} {opening} {prose(9)}", opening]), NO_HINTS)
        c.sequence()
        key, _ = R.anchors(c.seqs[0], S.WINDOW, S.ROUNDS)
        at = c.starts + np.array([0, 9, 0])
        assert c.whole[at].all() and len(set(key[at].tolist())) == 1, seed


def test_repeat_of_the_opening_is_verified():
    for seed in range(100):
        rng = random.Random(seed)
        prose = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
        opening = prose(S.WINDOW)
        chunk = _chunk([f"{opening} {prose(15)}", f"{prose(9)} {opening} {prose(9)}"])
        anchors = S._anchor_rows((pa.scalar(0),), chunk, NO_HINTS).filter(pa.compute.field("many")).column("anchor")
        hints = pa.table({"to_chunk": pa.array([0] * len(anchors), pa.int32()), "kind": pa.array([0] * len(anchors), pa.int32()), "a": anchors, "b": pa.array([None] * len(anchors), pa.int64()), "stop": pa.array([None] * len(anchors), pa.int32())})
        rows = S._window_rows((pa.scalar(0),), chunk, hints).to_pylist()
        assert (1 << 32 | 9) in {r["at"] for r in rows if r["known"]}, seed


def test_repeated_and_missing_ids_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 2000)
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    passage = prose(30)
    rows = [(rng.choice([None, 1, 2, i + 3]), f"{prose(rng.randrange(0, 40))} {passage if rng.random() < 0.5 else ''} {prose(rng.randrange(0, 40))}") for i in range(60)]
    rows += [rows[0], rows[1], rows[1], (None, None), (None, None), (1, ""), (5, passage), (None, passage), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    chunks = S.chunk_count(spark, docs, "text", S.CHUNK_BYTES)
    assert chunks > 3
    hashed = docs.selectExpr("doc_id", "text", f"pmod(xxhash64(doc_id, text), {chunks}) as chunk", "xxhash64(text) as h1", "xxhash64(1, text) as h2").collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.chunk, r.h1, r.h2))
    seen, want = set(), []
    for r in order:
        words = (r.text or "").split()
        gone = [False] * len(words)
        for at in range(len(words) - S.WINDOW + 1):
            window = tuple(words[at : at + S.WINDOW])
            if window in seen:
                gone[at : at + S.WINDOW] = [True] * S.WINDOW
            seen.add(window)
        want.append((r.doc_id or 0, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    got = [(r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in S.deduplicated(docs).collect()]
    assert sorted(got) == sorted(want)
