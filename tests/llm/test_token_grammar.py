"""The grammar of a block: exact round trips, random access, and nothing left that pays."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import token_output as T


def _compressed(docs: list[list[int]], monkeypatch_end: int = 2):
    """Each id is a cut of its own or, for even ones, a cut of two ids."""
    names = sorted({x for d in docs for x in d})
    expand = {x: [x] if x % 2 else [x, x + 1000] for x in names}
    flat = np.array([y for x in names for y in expand[x]], np.uint32)
    at = np.cumsum([0] + [len(expand[x]) for x in names])
    place = {x: i for i, x in enumerate(names)}
    index = np.array([place[x] for d in docs for x in d], np.int64)
    by_text = np.cumsum([0] + [len(d) for d in docs])
    symbols, first, rules = T.compress(np.arange(len(names)), index, by_text, flat, at, monkeypatch_end)
    want = [[y for x in d for y in expand[x]] + [monkeypatch_end] for d in docs]
    return symbols, first, rules, want


def _block(symbols, first, rules):
    return T.Block(T.packed(rules, symbols), first)


def _docs(seed: int) -> list[list[int]]:
    rng = random.Random(seed)
    passage = [rng.randrange(10, 60) for _ in range(50)]
    docs = [[], [11], [12] * 40, passage * 5]
    for _ in range(60):
        own = [int(10 + 50 * rng.random() ** 3) for _ in range(rng.randrange(0, 80))]
        docs.append(own[:20] + passage + own[20:] if rng.random() < 0.4 else own)
    return docs


@pytest.mark.parametrize("seed", range(5))
def test_round_trip_and_slices(seed):
    docs = _docs(seed)
    symbols, first, rules, want = _compressed(docs)
    block = _block(symbols, first, rules)
    rng = random.Random(seed)
    for i, ids in enumerate(want):
        assert block.document(i).tolist() == ids
        for _ in range(10):
            a = rng.randrange(len(ids) + 1)
            b = rng.randrange(a, len(ids) + 1)
            assert block.part(i, a, b).tolist() == ids[a:b]
    assert block.ids().tolist() == [x for ids in want for x in ids]
    assert all(len(block._expanded(np.array([T.FIRST_RULE + k], np.uint32))) == n for k, n in enumerate(T.expansion_lengths(rules).tolist()))


def test_empty_block():
    assert _block(np.zeros(0, np.int32), np.array([0]), []).ids().tolist() == []


def test_numbers_keep_their_bits(monkeypatch):
    monkeypatch.setattr(T, "PACK", 64)
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 7, 8, 9, 16, 17, 31, 32):
        for n in (0, 1, 7, 8, 63, 64, 65, 300):
            numbers = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
            data = T.pack(numbers, width)
            assert len(data) == -(-n * width // 8)
            # the first number's least bit is the first byte's least bit
            assert int.from_bytes(data, "little") == sum(int(x) << i * width for i, x in enumerate(numbers))
            for start, stop in ((0, n), (n // 3, n), (n // 3, 2 * n // 3), (n, n)):
                assert T.unpack(data, width, start, stop).tolist() == numbers[start:stop].tolist()


def test_few_ids_and_long_repeats():
    # a symbol of two or three bits, rules that fill less than a byte, and a run of one id
    for docs in ([[1] * 5], [[1, 3] * 9], [[1] * 3000, [], [3]], [[0, 1, 3] * 200]):
        symbols, first, rules, want = _compressed(docs)
        block = _block(symbols, first, rules)
        assert block.ids().tolist() == [x for ids in want for x in ids]
        assert [block.document(i).tolist() for i in range(len(want))] == want


def test_file_is_smaller_than_plain_ids(spark, tmp_path):
    from lectern.llm.common import documents

    T.write(documents(spark, "/root/testdata/sf0.001"), str(tmp_path / "tokens"))
    rows = spark.read.parquet(str(tmp_path / "tokens")).collect()
    stored = sum(len(r[k]) for r in rows for k in ("rules", "lengths", "symbols"))
    # ids of this vocabulary take 16 bits each
    assert stored < 2 * sum(sum(r.n_tokens) for r in rows)


def test_cuts_that_hold_special_tokens():
    from lectern.llm.tokenizing import Encoder, vocabulary_path

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(vocabulary_path(name), 1)
        cuts = [" the", "<|endoftext|>", " a<|endoftext|>b", "", " x", "<|ENDOFTEXT|>", " naïve", "\n"] * 50 + [" plain"] * 300
        ids, sizes = e._encoded(cuts)
        want = [x.ids for x in e.tokenizer.encode_batch_fast(cuts, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("seed", range(5))
def test_no_pair_is_left_that_pays(seed):
    symbols, first, rules, want = _compressed(_docs(seed))
    left: Counter = Counter()
    for a, b in zip(first, first[1:]):
        last: dict = {}
        for i in range(a, b - 1):
            pair = (int(symbols[i]), int(symbols[i + 1]))
            if last.get(pair) != i - 1:
                left[pair] += 1
                last[pair] = i
    assert left.most_common(1)[0][1] < T.MIN_COUNT
    used = Counter(symbols.tolist()) + Counter(x for own in rules for pair in own.tolist() for x in pair)
    assert all(used[T.FIRST_RULE + k] for k in range(sum(map(len, rules))))
    # the passage that many documents share has become a few symbols
    assert len(symbols) < sum(map(len, want)) / 2


def test_pairs_by_sorting_either_way():
    rng = np.random.default_rng(0)
    small = rng.integers(0, 6, 500).astype(np.int32)
    at = np.arange(499)
    for symbols in (small, small + (1 << 21)):
        order, begin = T._by_pair(symbols[:-1], symbols[1:], at)
        want = sorted(at.tolist(), key=lambda i: (symbols[i], symbols[i + 1], i))
        assert order.tolist() == want
        assert begin.tolist() == [k for k in range(499) if k == 0 or tuple(symbols[want[k] : want[k] + 2]) != tuple(symbols[want[k - 1] : want[k - 1] + 2])] + [499]
