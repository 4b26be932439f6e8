"""Vector recall with missing, zero and equal vectors against its SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lectern.operators import vectors
from lectern.plans import catalogue


def test_missing_zero_and_equal_vectors_are_ranked_as_by_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 3)
    monkeypatch.setattr(vectors, "TILE_ROWS", 16)
    own = np.random.default_rng(6).standard_normal((400, 4)).round(1).astype(np.float32).tolist()
    own[7], own[100], own[150], own[200] = [0.0] * 4, None, [0.0] * 4, [float("nan"), 1.0, 1.0, 1.0]
    for i in range(210, 290):
        own[i] = own[250]
    rows = pa.table({"vec_id": pa.array(range(400), pa.int64()), "embedding": pa.array(own, pa.list_(pa.float32()))})
    pq.write_table(rows, tmp_path / "embeddings.parquet")
    found = catalogue.queries()["vector_recall"](spark, str(tmp_path)).select("query_id", "vec_id", "rank", "cosine").collect()
    with duckdb.connect() as duck:
        duck.register("embeddings", rows)
        want = duck.execute(f"SELECT query_id, vec_id, rank, cosine FROM ({catalogue.oracle_sql()['vector_recall']})").fetchall()
    # lengths of equal vectors are summed in another order, which may show in a zero's sign
    plain = lambda r: (r[0], r[1], r[2], repr(None if r[3] is None else r[3] + 0.0))
    assert sorted(map(plain, found)) == sorted(map(plain, want))
