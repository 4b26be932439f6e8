"""The pipeline's near-duplicate stage against sets of five-word shingles in plain loops."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lectern.llm import near_copies, simhash_dedup
from lectern.llm.common import documents


def _changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def _set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_stage_keeps_one_of_each_group(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts: list = [None, "", "one two", "One two", "one two three"]
    for size in (40, 120, 400):
        for _ in range(8):
            base = prose(size)
            texts += [" ".join(_changed(rng, base, n)) for n in (0, 0, 1, 1, size // 60, size // 40, size // 10)]
    chain = prose(200)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = _changed(rng, chain, 3)
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    ids = [None if i % 5 == 0 else i for i in range(len(texts))]
    (tmp_path / "documents.parquet").mkdir()
    for n in range(3):
        pq.write_table(pa.table({"doc_id": pa.array(ids[n::3], pa.int64()), "text": pa.array(texts[n::3], pa.string())}), tmp_path / "documents.parquet" / f"{n}.parquet")

    sets = [_set(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups: dict = {}
    for i in range(len(texts)):
        groups.setdefault(top(i), []).append(i)
    got = simhash_dedup.stage(spark, documents(spark, str(tmp_path)), str(tmp_path)).collect()
    assert len(got) == len(groups) < len(texts)
    want = [min(ids[i] for i in g if ids[i] is not None) for g in groups.values() if any(ids[i] is not None for i in g)]
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(want)


def test_shingles_are_sets():
    found, offsets = near_copies.shingles(pa.array(["a b c d e f", "", "A b", "a b c d e a b c d e a b c d e", "a b"], pa.large_string()))
    assert (offsets[1:] - offsets[:-1]).tolist() == [2, 0, 1, 5, 1]
    nodes = near_copies.nodes_of(found, offsets)
    assert nodes[2] == nodes[4] and len(set(nodes.tolist())) == 4
    minima = near_copies.minima_of(found, offsets)
    assert near_copies.bands_of(minima).shape == (4, near_copies.BANDS)
    assert near_copies.sketches_of(minima).shape == (4, near_copies.PLANES * near_copies.MINIMA // 64)


def test_sketches_tell_similarity(spark):
    rng = np.random.default_rng(3)
    for similar, low, high in ((0.8, 190, 226), (0.5, 110, 162), (1.0, 256, 256)):
        both = int(similar * 2000)
        hashes = [np.sort(rng.integers(0, 1 << 63, 2000, dtype=np.int64).astype(np.uint64)) for _ in range(2)]
        own = (2000 - both) // 2
        a, b = np.concatenate([hashes[0][:both], hashes[1][:own]]), np.concatenate([hashes[0][:both], hashes[1][own : 2 * own]])
        found, offsets = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)])
        x, y = near_copies.sketches_of(near_copies.minima_of(found, offsets)).view(np.int64).tolist()
        got = spark.createDataFrame([(x, y)], "x array<long>, y array<long>").select(near_copies._agreeing("x", "y")).first()[0]
        assert low <= got <= high
