"""Vector recall by blocks against plain loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lectern.plans import catalogue


def test_blocks_miss_nothing_and_no_side_is_broadcast_to_a_nested_loop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "VECTOR_BLOCK", 7, raising=False)
    vectors = np.random.default_rng(4).standard_normal((1200, 5)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(1200), pa.int64()), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    found = catalogue.queries()["vector_recall"](spark, str(tmp_path))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    want = set()
    for q in range(0, 1200, 50):
        best = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(1200) if i != q)[:3]
        want |= {(q, i, n) for n, (_, i) in enumerate(best, 1)}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
