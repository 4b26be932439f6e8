"""Recall against brute force, the rows that have to come out whatever is missed, and copies."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import adaptive_search as A

KIND = "vec_id long, embedding array<float>, label int"


def _brute(rows, every=A.EVERY, top=A.TOP):
    """(query's place in rows): [(vec_id, score)] best first."""
    sound = [(i, v, np.array(e, np.float64)) for i, (v, e) in enumerate(rows) if v is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    out = {}
    for i, v, e in sound:
        if v % every == 0:
            others = [(-float((x * e).sum()), w) for j, w, x in sound if j != i and len(x) == len(e)]
            out[i] = [(w, -s) for s, w in sorted(others)[:top]]
    return out


def _found(spark, rows, **options):
    table = spark.createDataFrame([(v, None if e is None else [None if x is None else float(x) for x in e], 0) for v, e in rows], KIND).repartition(3)
    found: dict[int, list] = {}
    for r in A.nearest_rows(table, F.col("vec_id") % A.EVERY == 0, **options).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(own)] for q, own in found.items()}


def _f32(rng, n, dim):
    return rng.standard_normal((n, dim)).astype(np.float32)


@pytest.mark.parametrize("kind", ["sphere", "clusters", "lengths"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = _f32(rng, 3000, 32)
    if kind == "clusters":
        x = x * 0.3 + _f32(rng, 20, 32)[rng.integers(0, 20, 3000)]
    x = (x / np.linalg.norm(x, axis=1)[:, None] * (rng.lognormal(0, 0.7, 3000)[:, None] if kind == "lengths" else 1)).astype(np.float32)
    rows = [(i, e.tolist()) for i, e in enumerate(x)]
    want, found = _brute(rows), _found(spark, rows)
    hits = sum(len({v for v, _ in own} & {v for v, _ in found[rows[i][0]]}) for i, own in want.items())
    assert hits >= 0.9 * 20 * len(want)
    exact = x.astype(np.float64)
    for q, own in found.items():
        assert len(own) == 20 and len({v for v, _ in own}) == 20 and q not in {v for v, _ in own}
        assert own == sorted(own, key=lambda b: (-b[1], b[0]))
        assert all(abs(s - float((exact[v] * exact[q]).sum())) < 1e-12 for v, s in own)


def test_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found: dict[int, set] = {}
    for r in A.query(spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = _brute(rows)
    assert sum(len({v for v, _ in own} & found[rows[i][0]]) for i, own in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_clusters_need_few_lists():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((200, 16)) * 5
    near = centres[rng.integers(0, 200, 4000)] + rng.standard_normal((4000, 16)) * 0.1
    far = rng.standard_normal((4000, 16))
    probes = [A.Model(float(np.linalg.norm(x, axis=1).max()), x, len(x), 0.95, 20).n_probes for x in (near, far)]
    assert probes[0] == A.LEAST_PROBES < probes[1]


def test_candidates_are_given_up_early_and_rightly():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 63))
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = A.Model(1.0, x, len(x), 0.95, 20)
    points, queries = model.placed(x), model.aimed(x[:50])
    blocks = A._by_columns(points)
    through = A.scan(blocks, queries, 20, np.full(50, np.inf))
    lost, left = 0, 0
    for q, near in zip(queries, through, strict=True):
        best = set(np.argsort(((points - q) ** 2).sum(axis=1))[:20].tolist())
        lost += len(best - set(near.tolist()))
        left += len(near)
    assert lost <= 10  # of 1000
    assert left < 50 * 400  # of 50 * 4000


def test_few_candidates_copies_and_unsound_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(0, [1, 0]), (20, None), (40, [0, 0]), (60, [1, None]), (None, [1, 1]), (80, [2, 1, 0]), (3, [float("nan"), 1]), (5, []), (100, [1, 1]), (7, [1, 1]), (7, [0, 1]), (0, [1, 0]), (9, [float("inf"), 1])]
    want = _brute(rows)
    found = _found(spark, rows)
    assert sorted(found.get(100, [])) == sorted(want[8]) and 80 not in found
    # both rows of id 0 leave out their own row only
    table = spark.createDataFrame([(v, None if e is None else [None if x is None else float(x) for x in e], 0) for v, e in rows], KIND)
    own = [(r["rank"], r.vec_id, r.score) for r in A.nearest_rows(table, F.col("vec_id") == 0).collect()]
    assert sorted(own) == sorted(2 * [(n + 1, v, s) for n, (v, s) in enumerate(want[0])])
    # a third of all rows are copies of one vector; ties go by id
    common = _f32(rng, 1, 8)[0].tolist()
    rows = [(i, common if i % 3 == 0 else e.tolist()) for i, e in enumerate(_f32(rng, 900, 8))]
    found, want = _found(spark, rows), _brute(rows)
    for i in (0, 60, 300, 840):
        assert [v for v, _ in found[i]] == [v for v, _ in want[i]] == [v for v in range(0, 63, 3) if v != i][:20]


def test_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, e.tolist()) for i, e in enumerate(_f32(rng, 800, 12))]
    whole = _found(spark, rows, recall=1.0)
    monkeypatch.setattr(A, "BLOCK", 9)
    monkeypatch.setattr(A, "QUERY_BLOCK", 4)
    cut = _found(spark, rows, recall=1.0)
    same = sum(len(set(whole[q]) & set(cut[q])) for q in whole)
    assert same >= 0.99 * 20 * len(whole)


def test_empty(spark):
    assert A.nearest_rows(spark.createDataFrame([], KIND), F.col("vec_id") % 20 == 0).collect() == []
    assert _found(spark, [(1, [1.0, 2.0]), (2, [1.0, 1.0])]) == {}
