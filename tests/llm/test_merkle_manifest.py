"""The manifest against a plain loop, over one and over several tiers of blocks."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest

from lectern.llm import merkle_manifest as M


def H(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def _value(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _leaf(row) -> str:
    return H(*map(_value, row))


def _levels(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def _siblings(levels: list[list[str]], place: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for level in levels[:-1]:
        run = level[place // 8 * 8 : place // 8 * 8 + 8]
        out.append((run[: place % 8], run[place % 8 + 1 :]))
        place //= 8
    return out


def expected(rows: list[tuple]) -> list[tuple]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = sorted({r[2] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    by = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for k in langs}
    trees = {k: _levels([_leaf(r) for r in own]) for k, own in by.items()}
    top = _levels([trees[k][-1][0] for k in langs])
    out = []
    for n, k in enumerate(langs):
        for i, r in enumerate(by[k]):
            path = _siblings(trees[k], i) + _siblings(top, n)
            tampered = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 0 and r[4] is not None
            node = _leaf((*r[:4], r[4].translate(lower))) if tampered else _leaf(r)
            for before, after in path:
                node = H(*before, node, *after)
            proof = H(*[x for before, after in path for x in (*before, *after)])
            out.append((r[0], _leaf(r), trees[k][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def _rows(n: int) -> list[tuple]:
    rng = random.Random(n)
    text = lambda: rng.choice([None, "", "plain", "Some Text", "ÄÖ é 林 Text", "x" * 500])
    rows = [(rng.choice([i, i, i, 5, None]), rng.choice(["a", None]), rng.choice(["en", "en", "en", "de", "", "Ünd", "林", None]), rng.randrange(9), text()) for i in range(n)]
    return rows + rows[:5] + [(10**15, "s", "alone", 1, "One Leaf")]


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def _found(spark, tmp_path, rows) -> list[tuple]:
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in M.query(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize(("digits", "n"), [(1, 700), (2, 90), (4, 700), (4, 1)])
def test_plain_loop(spark, tmp_path, monkeypatch, digits, n):
    # of one digit a block, the tree of 700 rows has four tiers
    monkeypatch.setattr(M, "DIGITS", digits)
    monkeypatch.setattr(M, "BLOCK", 8**digits)
    rows = _rows(n)
    assert _found(spark, tmp_path, rows) == expected(rows)


def test_sizes_around_full_runs(spark, tmp_path):
    for n in (7, 8, 9, 64, 65):
        rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
        assert _found(spark, tmp_path, rows) == expected(rows)


def test_many_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "DIGITS", 1)
    monkeypatch.setattr(M, "BLOCK", 8)
    rows = [(i, "s", f"lang{i % 150}", i, f"Text {i}") for i in range(400)]
    assert _found(spark, tmp_path, rows) == expected(rows)


def test_empty(spark, tmp_path):
    assert _found(spark, tmp_path, []) == []


def test_other_columns_take_no_part(spark):
    docs = spark.createDataFrame([(1, "en", "a", 7, 8), (2, "en", "b", 9, 9)], "doc_id long, lang string, text string, digest long, _key long")
    a = M.manifest(docs, columns=("doc_id", "text")).collect()
    assert {r.id: r.leaf for r in a} == {1: H("1:1", "1:a"), 2: H("1:2", "1:b")}
    assert all(r.root == H(H("1:1", "1:a"), H("1:2", "1:b")) and r.now is None for r in a)
