"""Each numbered operator against plain loops, on documents with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from lectern.llm.common import written
from lectern.llm import lm_scoring, mixing, packing, pii, quality_rules, simhash_dedup, substring_dedup, token_output, topk_search, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts() -> list[str | None]:
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本", "#x", "|", "the", "The"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = prose(60)
    texts: list[str | None] = [None, "", " \t\n", "one", "two words", prose(30), prose(400), shared, f"{prose(20)} {shared} {prose(5)}", f"{shared}\n{shared}"]
    texts += [texts[6], texts[6] + " extra", prose(9000), "a b c " * 100, "line one\nline one\n\nother", "# $ % | < >"]
    texts += ["mail bob.smith@example.co.uk or 10.0.0.1 or 300.1.1.1, card 4111 1111 1111 1111 and +1 (555) 123-4567.", "😀 x@y.z 4111-1111-1111-1111", "\x0bveil\x0c and\x85nel　wide"]
    texts += [f"Alice{i} Wonder writes alice@wonder.org about chess {prose(3)}" for i in range(6)]
    texts += [prose(rng.randrange(1, 80)) for _ in range(30)]
    return texts


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    texts = _texts()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    source = [None if i % 11 == 0 else f"s{i % 3}" for i in ids]
    # columns that are called like the operators' own
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * len(ids), "source": source, "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "chunk": ids, "fp": ids, "slot": ids, "score": ids, "spans": ids})
    pq.write_table(table, where / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([1] * len(ids), pa.int32()), "toxic": pa.array([i % 2 for i in ids], pa.int32())}), where / "labels.parquet")
    rng = np.random.default_rng(0)
    vectors = [None if i == 7 else [None, 1.0, 2.0, 3.0] if i == 9 else [math.nan, 0, 0, 0] if i == 11 else [0.0] * 4 if i == 13 else (rng.standard_normal(4) * 3 ** (i % 4)).tolist() for i in range(300)]
    vectors[20] = vectors[21] = vectors[22]
    pq.write_table(pa.table({"vec_id": pa.array(range(300), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * 300, pa.int32())}), where / "embeddings.parquet")
    return str(where)


@pytest.fixture(scope="module")
def empty(sf, tmp_path_factory):
    where = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "embeddings"):
        pq.write_table(pq.read_table(f"{sf}/{name}.parquet").slice(0, 0), where / f"{name}.parquet")
    return str(where)


@pytest.fixture(scope="module")
def docs(sf):
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in rows}


QUERIES = {name: q for m in (lm_scoring, mixing, packing, pii, quality_rules, simhash_dedup, substring_dedup, token_output, topk_search, toxicity) for name, q in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_substring_dedup(spark, sf, docs):
    seen, want = set(), {}
    for i in sorted(docs):
        words = WORD.findall(docs[i]["text"] or "")
        gone = [False] * len(words)
        for at in range(len(words) - 19):
            window = tuple(words[at : at + 20])
            if window in seen:
                gone[at : at + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        want[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.query(spark, sf).collect()} == want


def _fingerprint(text: str | None) -> int:
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, sf, docs):
    prints = {i: _fingerprint(d["text"]) for i, d in docs.items()}
    root = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.query(spark, sf).collect()} == {i: (f"{prints[i]:016x}", root[i]) for i in docs}


def test_covering_masks_miss_no_pair():
    masks = simhash_dedup.table_masks()
    for a in range(64):
        for b in range(a, 64):
            assert any(not (1 << a | 1 << b) & m for m in masks)


def test_toxicity(spark, sf, docs):
    rows = toxicity.query(spark, sf).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_finds_the_sentence():
    clean, bad = "A calm word here. Another calm line there.", "A calm word here. You foul brute here. Another calm line there."
    model = toxicity.fit([clean, bad] * 60, np.array([0, 1] * 60), np.ones(120))
    score, found = toxicity.score_text(bad, model)
    assert score > 0.5 > toxicity.score_text(clean, model)[0]
    start, stop, _ = max(found, key=lambda f: f[2])
    assert "foul" in bad[start:stop] and "Another" not in bad[start:stop]


def _ids(name: str, text: str | None, end: int) -> list[int]:
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + [end]


def test_token_output_round_trip(spark, sf, docs):
    at, want = 0, {}
    for i in sorted(docs):
        ids = _ids("byte_bpe_50k.json", docs[i]["text"], 2)
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.query(spark, sf).collect()} == want


def _base_spans(text: str) -> list[tuple[int, int, str]]:
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]


def test_pii(spark, sf, docs):
    rows = {r.doc_id: r for r in pii.query(spark, sf).collect()}
    for i, d in docs.items():
        want = sorted(_base_spans(d["text"] or ""))
        said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert rows[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        counts = Counter(k for *_, k in want)
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))
        assert set(filter(None, said.split(","))) <= set(rows[i].spans.split(","))


def test_pii_stage_removes_what_it_found(spark, sf, docs):
    rows = pii.stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert rows.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(not _base_spans(r.text or "") or "<" in r.text for r in rows.collect())
    assert not any("alice@wonder.org" in (r.text or "") for r in rows.collect())


def test_quality_rules(spark, sf, docs):
    rows = {r.doc_id: r for r in quality_rules.query(spark, sf).collect()}
    for i, d in docs.items():
        text = d["text"] or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (r.kept and r.base_failed)


def test_lm_base_score(spark, sf, docs):
    tokens = {i: WORD.findall("".join(c.lower() if c.isascii() else c for c in d["text"] or "")) + [""] for i, d in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(t for i in docs if not held[i] for t in tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    for r in lm_scoring.query(spark, sf).collect():
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[t] > 0 for t in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own), abs=1e-6)
        assert math.isfinite(r.score) and r.score < 0


def _model(vocabulary: int = 40):
    counts = np.arange(60, 0, -1)
    names = pa.array(["", *(f"w{i}" for i in range(59))], pa.large_string())
    return lm_scoring.Model(lm_scoring.Lexicon(names, counts, int(counts.sum()), 60, vocabulary))


def test_lm_probabilities_add_up_and_learn():
    model = _model()
    rng = np.random.default_rng(1)
    symbols = np.tile(np.arange(1, 21, dtype=np.int32), 40)
    offsets = np.arange(0, 801, 20)
    lanes = lm_scoring.lay_out(symbols, offsets, model.lexicon.end, 7)
    before = model.log_likelihood(lanes, 40).sum()
    trainer = lm_scoring.Trainer(model)
    for _ in range(60):
        trainer.train(lanes)
    assert model.log_likelihood(lanes, 40).sum() > before / 4
    hidden = np.append(rng.standard_normal((1, lm_scoring.STATE)), [[1.0]], axis=1).astype(np.float32)
    k = len(model.lexicon.weight)
    assert np.exp(model.output(np.repeat(hidden, k, axis=0), np.arange(k))).sum() == pytest.approx(1, abs=1e-4)


def test_lm_state_does_not_depend_on_lanes():
    model = _model()
    rng = np.random.default_rng(2)
    lengths = [1, 50, 3, 700, 2, 9]
    symbols, offsets = rng.integers(0, 40, sum(lengths)).astype(np.int32), np.concatenate([[0], np.cumsum(lengths)])
    scores = [model.log_likelihood(lm_scoring.lay_out(symbols, offsets, model.lexicon.end, n), 6) for n in (1, 2, 6)]
    assert np.allclose(scores[0], scores[1], atol=1e-3) and np.allclose(scores[0], scores[2], atol=1e-3)


def test_lm_gradient():
    model = _model()
    symbols, offsets = np.random.default_rng(3).integers(0, 40, 30).astype(np.int32), np.array([0, 12, 30])
    lanes = lm_scoring.lay_out(symbols, offsets, model.lexicon.end, 2)
    found = {}

    class Spy(lm_scoring.Trainer):
        def move(self, name, gradient, rows=slice(None)):
            found.setdefault(name, np.zeros_like(self.model.of[name]))[rows] += gradient

    spy = Spy(model)
    steps, lm_scoring.STEPS = lm_scoring.STEPS, 64
    plain, lm_scoring.PLAIN = lm_scoring.PLAIN, 0.0
    try:
        spy.train(lanes)
        full = spy.full
        for name, at in (("state", (3, 30)), ("gate", (60,)), ("input", (int(symbols[0]), 5)), ("classes", (2, 1)), ("words", (int(symbols[3]), 4))):
            value = model.of[name]
            sides = []
            for delta in (0.02, -0.04):
                value[at] += delta
                sides.append(-model.log_likelihood(lanes, 2).sum() / full)
            value[at] += 0.02
            assert (sides[0] - sides[1]) / 0.04 == pytest.approx(found[name][at], rel=0.05, abs=2e-6)
    finally:
        lm_scoring.STEPS, lm_scoring.PLAIN = steps, plain


def test_topk(spark, sf):
    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    whole = {r["vec_id"]: [math.floor(256 * x) for x in r["embedding"]] for r in rows if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.query(spark, sf).collect()} == want


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": (i + 1) ** 2.0 for i in range(25)}, {"a": 0.0, "b": 0.0}])
def test_schedule_is_within_a_block(weights):
    slots = mixing.shares(weights, 512)
    order = mixing.schedule(slots)
    assert sum(slots.values()) == 512 == len(order) and Counter(order) == Counter(slots)
    done: Counter = Counter()
    for slot, name in enumerate(order, 1):
        release, deadline = mixing.window(done[name], slots[name], 512)
        assert release < slot <= deadline
        done[name] += 1
        assert all(abs(done[k] - slot * slots[k] / 512) < 1 for k in slots)


def test_mixing(spark, sf, docs):
    rows = mixing.query(spark, sf).collect()
    assert {r.doc_id for r in rows if r.epoch == 0} == set(docs) and Counter((r.doc_id, r.epoch) for r in rows).most_common(1)[0][1] == 1
    assert all(r.release <= r.slot < r.deadline for r in rows)
    for own in docs.values():
        assert any(r.source == own["source"] for r in rows)
    staged = mixing.stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert staged.columns == spark.read.parquet(f"{sf}/documents.parquet").columns and staged.count() == len(rows)


def test_packing(spark, sf, docs):
    rows = packing.query(spark, sf).collect()
    own: dict[int, list] = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
    assert own.keys() == docs.keys()
    for i, pieces in own.items():
        ids, at = _ids("word_bpe_49k.json", docs[i]["text"], 1), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= total / 2048 * 1.02 + 2


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    read = spark.read.parquet(f"{sf}/documents.parquet")
    docs, before = read, read.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "test")
        assert docs.columns == read.columns
        if name in ("quality_rules", "simhash_dedup"):
            assert docs.count() <= before
            before = docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in pipeline.run(spark, sf).select("doc_id").collect()} == ids
