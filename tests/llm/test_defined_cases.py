"""Repeated rows, repeated and missing ids, columns named like the operators' own, and empty tables, for every operator and stage."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lectern.llm import mixing, near_copies, registry, simhash_dedup
from lectern.llm.common import documents, written

#: Columns that operators and stages use for themselves.
NAMES = ("_at", "_row", "_of", "_id", "_key", "_size", "_slot", "_from", "_hash", "_host", "_text", "_spans", "_shard", "kept", "base", "node", "fp", "chunk", "score", "labelled", "block")


def _rows() -> list[tuple]:
    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    texts = [None, "", "short", prose(70), prose(300), prose(5000), f"Zebulon asks bob@mail.org. {prose(80)}"]
    rows = [(rng.choice([None, 3, 7, 7, i + 10]), rng.choice(texts), rng.choice(["a", "a", "b", None])) for i in range(40)]
    rows += rows[:12] + [(7, texts[3], "a")] * 5 + [(None, texts[4], None)] * 3
    rng.shuffle(rows)
    return rows


def _write(where, rows) -> str:
    ids = pa.array([r[0] for r in rows], pa.int64())
    columns = {"doc_id": ids, "text": pa.array([r[1] for r in rows], pa.string()), "lang": ["en"] * len(rows), "source": pa.array([r[2] for r in rows], pa.string()), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}
    columns |= {name: pa.array(range(len(rows)), pa.int64()) for name in NAMES}
    table = pa.table(columns)
    (where / "documents.parquet").mkdir()
    for n in range(3):
        pq.write_table(table.slice(n * len(rows) // 3, (n + 1) * len(rows) // 3 - n * len(rows) // 3), where / "documents.parquet" / f"{n}.parquet")
    labels = pa.table({"doc_id": pa.array([3, 7, None, 7, 12], pa.int64())[: 5 if rows else 0], "quality": pa.array([1] * 5, pa.int32())[: 5 if rows else 0], "toxic": pa.array([1, 0, 1, None, 0], pa.int32())[: 5 if rows else 0]})
    pq.write_table(labels, where / "labels.parquet")
    vectors = [np.arange(4).tolist(), None, [1.0, None, 0.0, 0.0], [], [2.0, 1.0, 0.0, 0.0], [2.0, 1.0, 0.0, 0.0]]
    pq.write_table(pa.table({"vec_id": pa.array([0, 50, 1, 2, 3, 4], pa.int64())[: 6 if rows else 0], "embedding": pa.array(vectors, pa.list_(pa.float32()))[: 6 if rows else 0], "label": pa.array([0] * 6, pa.int32())[: 6 if rows else 0]}), where / "embeddings.parquet")
    return str(where)


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("cases"), _rows())


@pytest.fixture(scope="module")
def none(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("none"), [])


#: Rows for each document: pieces and turns can be more than one.
ONE_EACH = ("op1_substring_dedup", "op2_simhash_dedup", "op3_toxicity", "op4_token_output", "op5_pii", "op6_quality_rules", "op7_lm_scoring", "op12_merkle_manifest", "op13_fill_in_middle")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries(spark, sf, name):
    found = registry.queries()[name](spark, sf).collect()
    if name in ONE_EACH:
        assert Counter(r.doc_id for r in found) == Counter(r[0] for r in _rows())
    elif name not in ("op8_topk_search", "op11_adaptive_search"):
        assert {r.doc_id for r in found} == {r[0] for r in _rows()}
    if name == "op10_packing":
        assert Counter(r.doc_id for r in found if r.start == 0) == Counter(r[0] for r in _rows())
    if name == "op9_mixing":
        assert Counter(r.doc_id for r in found if r.epoch == 0) == Counter(r[0] for r in _rows())


def test_fingerprints_of_rows_without_id_link(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    changed = [*words[:200], "other", *words[201:]]
    a, b = (" ".join(w) for w in (words, changed))
    prints = {r.t: r.fp for r in simhash_dedup.fingerprints(spark.createDataFrame([("a", a), ("b", b)], "t string, text string"), ("t",)).collect()}
    near = (prints["a"] ^ prints["b"]) & ((1 << 64) - 1)
    rows = [(1, a), (None, b), (None, "else entirely")]
    found = {r.fp: r.component_id for r in simhash_dedup.clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[prints["a"]] == 1 and found[prints["b"]] == (1 if near.bit_count() <= 2 else None) and None in found.values()
    # a chain over a fingerprint that only a row without id has
    nodes = spark.createDataFrame([(0, 5), (1, None), (3, None), (7, 2), (1 << 40 | 1 << 50 | 1 << 60, None)], "fp long, _id long")
    assert {r.fp: r.component_id for r in simhash_dedup.group_ids(nodes).collect()} == {0: 2, 1: 2, 3: 2, 7: 2, 1 << 40 | 1 << 50 | 1 << 60: None}


@pytest.mark.parametrize("which", ["sf", "none"])
def test_pipeline(spark, request, which):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = request.getfixturevalue(which)
    docs = documents(spark, sf)
    columns = docs.columns
    for _, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "cases")
        assert docs.columns == columns
    last = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert bool(last) == (which == "sf")


def test_near_copies_of_equal_rows(spark, sf):
    docs = documents(spark, sf)
    kept = simhash_dedup.stage(spark, docs, sf).collect()
    texts = [r.text for r in kept]
    # null and empty texts have the same empty set
    assert len(texts) == len({t or "" for t in texts}) and {t or "" for t in texts} == {r[1] or "" for r in _rows()}
    assert near_copies.SIMILAR == (4, 5)


def test_many_sources_are_not_broadcast(spark, sf, monkeypatch):
    before = sorted(map(str, mixing.query(spark, sf).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.query(spark, sf).collect())) == before
