"""The mixing stage's written table against the schedule in plain loops."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lectern.llm import mixing
from lectern.llm.common import documents


def _table(where: Path) -> str:
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(5000, 40000), "abc"[min(2, rng.randrange(9) // 3 + rng.randrange(2))]) for i in range(400)]
    # several files, so that rows of a source are apart
    (where / "documents.parquet").mkdir()
    for n in range(4):
        part = rows[n::4]
        pq.write_table(pa.table({"doc_id": [r[0] for r in part], "text": [r[1] for r in part], "source": [r[2] for r in part]}), where / "documents.parquet" / f"{n}.parquet")
    return str(where)


@pytest.mark.parametrize("part_slots", [1024, 16])
def test_stage_writes_in_the_order_of_slots(spark, tmp_path, monkeypatch, part_slots):
    monkeypatch.setattr(mixing, "PART_SLOTS", part_slots)
    sf = _table(tmp_path)
    out = str(tmp_path / "out")
    mixing.stage(spark, documents(spark, sf), sf).write.parquet(out)
    got = [(r["doc_id"], r["source"], len(r["text"])) for file in sorted(Path(out).glob("part-*")) for r in pq.read_table(file).to_pylist()]

    # plain loops: lay the sources out, give their blocks the turns of the schedule
    place = {r.doc_id: r.source_offset for r in mixing.query(spark, sf).filter("epoch = 0").collect()}
    own = {i: (source, size) for i, source, size in got}
    size = Counter()
    for source, n in own.values():
        size[source] += n
    slots = mixing.shares({f"={k}": v**mixing.SMOOTHING for k, v in size.items()}, mixing.PERIOD)
    order = mixing.schedule(slots)
    blocks = {k: n // mixing.BLOCK_BYTES + 1 for k, n in size.items()}
    ring = {k: [i for i in sorted(own, key=place.get) if own[i][0] == k] for k in size}
    at, along = Counter(), Counter()
    turn: Counter = Counter()
    want, slot = [], 0
    while any(turn[k] < blocks[k] for k in blocks):
        source = order[slot % mixing.PERIOD][1:]
        turn[source] += 1
        while along[source] < turn[source] * mixing.BLOCK_BYTES:
            i = ring[source][at[source] % len(ring[source])]
            want.append(i)
            at[source] += 1
            along[source] += own[i][1]
        slot += 1
        for k in blocks:
            assert abs(turn[k] - slot * slots[f"={k}"] / mixing.PERIOD) < 1
    assert len(set(own.values())) > 3 and [i for i, *_ in got] == want


def test_query_equals_plain_loops(spark, tmp_path):
    sf = _table(tmp_path)
    docs = documents(spark, sf).selectExpr("doc_id", "source", "octet_length(text) as size", "xxhash64(doc_id) as hash").collect()
    shards = max(1, int(len(docs) ** 0.5))
    own: dict = {}
    for r in sorted(docs, key=lambda r: (r.hash % shards, r.hash, r.doc_id)):
        own.setdefault(r.source, []).append(r)
    size = {k: sum(r.size for r in rs) for k, rs in own.items()}
    slots = mixing.shares({f"={k}": v**mixing.SMOOTHING for k, v in size.items()}, mixing.PERIOD)
    order = mixing.schedule(slots)
    blocks = {k: n // mixing.BLOCK_BYTES + 1 for k, n in size.items()}
    # the slots one after the other until every source has been gone through
    turn: Counter = Counter()
    taken, slot = {}, 0
    while any(turn[k] < blocks[k] for k in blocks):
        source = order[slot % mixing.PERIOD][1:]
        taken[source, turn[source]] = slot
        turn[source] += 1
        slot += 1
    want = set()
    for source, rs in own.items():
        along, epoch = 0, 0
        while along < turn[source] * mixing.BLOCK_BYTES:
            for r in rs:
                if along < turn[source] * mixing.BLOCK_BYTES:
                    n = along // mixing.BLOCK_BYTES
                    want.add((r.doc_id, source, r.size, along - epoch * size[source], n, epoch, taken[source, n]))
                    along += r.size
            epoch += 1
    got = {(r.doc_id, r.source, r.n_bytes, r.source_offset, r.block, r.epoch, r.slot) for r in mixing.query(spark, sf).collect()}
    assert got == want


def test_weights_hold_in_bytes(spark, monkeypatch):
    """One tiny and one huge source, half of the bytes each: in every prefix of slots, to within a block and a document."""
    monkeypatch.setattr(mixing, "EPOCHS_A_ROW", 16)
    rows = [(i, "=huge", i, 1000 + i % 700) for i in range(3000)] + [(9000 + i, "=tiny", i, 300) for i in range(5)] + [(9900, "=none", 1, 0), (9901, "=none", 2, 0)]
    frame = spark.createDataFrame(rows, "_at long, _key string, _id long, _size long")
    found = mixing.mixed(frame, {"huge": 0.5, "tiny": 0.5}, 4096).join(frame.select("_at", "_size"), "_at").select("_key", "_size", "slot", "_at", "epoch").collect()
    slots = max(r.slot for r in found) + 1
    held = {k: [0] * slots for k in ("=huge", "=tiny", "=none")}
    for r in found:
        held[r._key][r.slot] += r._size
    for k in ("=huge", "=tiny"):
        done = 0
        for slot in range(slots):
            done += held[k][slot]
            assert abs(done - (slot + 1) / 2 * 4096) < 2 * 4096 + 1700
    whole = {k: sum(own) for k, own in held.items()}
    assert 0.49 < whole["=tiny"] / (whole["=tiny"] + whole["=huge"]) < 0.51
    assert Counter(r._at for r in found if r._key == "=none") == {9900: 1, 9901: 1} and len({r._at for r in found}) == len(rows)
    assert len({(r._at, r.epoch) for r in found}) == len(found)
