"""Groups of near copies: documents whose sets of word shingles are similar, by MinHash and exact checks.

Documents whose sets have SIMILAR or more of their union in common are linked, and linked ones
are a group. Equal sets are one node, known by a 64-bit hash of the set.

Candidates share one of BANDS hashes over ROWS minima each. A pair of similarity 0.8 shares none
with a chance of 0.0002, and similar ones less. Every candidate pair is either compared or already
in one group: in STARS rounds the nodes with a hash are compared with one of them, first with the
one that shares its hashes with most others (of copies of one text mostly that text), then with
another one, and groups are formed from what passed; then all pairs are compared whose nodes share
a hash and are still in different groups. So a large group of near copies, which rounds bring
together, makes no pairs of all with all.

To compare means: of MINIMA minima, of which each node keeps four bits, AGREE or more have to
agree, which a pair of similarity 0.8 fails with a chance of 0.0003; the others are checked on
their whole sets.

Words are lower case in ASCII. A text of fewer words than a shingle has its word sequence as its
only shingle; texts without words have the empty set, and are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import words as W
from lectern.llm.common import cut, written
from lectern.llm.components import components
from lectern.llm.tokenizing import release

SHINGLE = 5
#: Shared part of the union of two sets, as (numerator, denominator).
SIMILAR = (4, 5)
BANDS, ROWS = 16, 4
MINIMA, PLANES, AGREE = 256, 4, 186
STARS = 2
#: Texts are worked through in parts of about so many words, to bound memory.
PART_WORDS = 1 << 18
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text, sorted, offsets by text)."""
    words, offsets = W.split(pc.ascii_lower(texts))
    codes, distinct = W.encode(words)
    name = W.hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    many = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), many)
    start = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + offsets[:-1][text]
    found = np.minimum(n, size)[text].astype(np.uint64)
    for j in range(size):
        there = j < n[text]
        found = np.where(there, W.mix(found * _BASE + name[np.minimum(start + j, max(0, len(name) - 1))]) if len(name) else found, found)
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    text, found = text[new], found[new]
    return found, np.searchsorted(text, np.arange(len(n) + 1))


def nodes_of(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set (empty: zero)."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(found + _STEP), dtype=np.uint64)])
    return W.mix(sums[offsets[1:]] - sums[offsets[:-1]])


def minima_of(found: np.ndarray, offsets: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """n minima of each set that is not empty, a row for each minimum."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((n, len(full)), np.uint64)
    if len(full):
        factors = W.mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
        for k in range(n):
            out[k] = np.minimum.reduceat(found * (factors[2 * k] | np.uint64(1)) + factors[2 * k + 1], offsets[:-1][full])
    return out


def bands_of(minima: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The band hashes, one row a set."""
    out = np.zeros((minima.shape[1], bands), np.uint64)
    for band in range(bands):
        key = np.full(minima.shape[1], band + 1, np.uint64)
        for row in range(rows):
            key = W.mix(key * _BASE + minima[band * rows + row])
        out[:, band] = key
    return out


def sketches_of(minima: np.ndarray) -> np.ndarray:
    """PLANES bits of each minimum, packed by plane in 64-bit integers, one row a set."""
    mixed = np.ascontiguousarray(W.mix(minima).T)
    planes = [np.packbits((mixed >> np.uint64(p) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)]
    return np.concatenate(planes, axis=1)


def _agreeing(x: str, y: str) -> Column:
    """How many minima agree in their bits."""
    words = MINIMA // 64
    differ = lambda w: reduce(lambda a, b: a.bitwiseOR(b), [F.col(x)[p * words + w].bitwiseXOR(F.col(y)[p * words + w]) for p in range(PLANES)])
    return sum((F.bit_count(F.bitwise_not(differ(w))) for w in range(1, words)), F.bit_count(F.bitwise_not(differ(0))))


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    texts = W.texts(batch.column(column))
    # a word has a byte and a space at least
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + 6 * PART_WORDS, side="right")))
        yield batch.slice(at, stop - at), texts.slice(at, stop - at)
        at = stop


def sketches(docs: DataFrame, keep: tuple[str, ...], text: str = "text", more: dict[str, Callable[[pa.Array], pa.Array]] | None = None) -> DataFrame:
    """The columns in keep, node, n_shingles, bands and sketch (both empty for the empty set), and `more` long columns of the same texts."""
    more = more or {}
    numbers = T.ArrayType(T.LongType())
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("node", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("bands", numbers), T.StructField("sketch", numbers)] + [T.StructField(c, T.LongType()) for c in more])

    def listed(full: np.ndarray, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * values.shape[1])]), pa.int32()), pa.array(values.reshape(-1).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _parts(batch, len(keep)):
                found, offsets = shingles(texts)
                n = np.diff(offsets)
                minima = minima_of(found, offsets)
                own = [pa.array(nodes_of(found, offsets).view(np.int64)), pa.array(n), listed(n > 0, bands_of(minima)), listed(n > 0, sketches_of(minima))]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *own, *[f(texts) for f in more.values()]], schema.names)
        release()

    return docs.select(*keep, text).mapInArrow(run, schema)


def _sets(docs: DataFrame) -> DataFrame:
    """node and its set, as an array of hashes; docs: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _parts(batch, 1):
                found, offsets = shingles(texts)
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column(0), values], ["node", "hashes"])
        release()

    return docs.mapInArrow(run, "node long, hashes array<long>")


def _judged(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with `similar`, whether their sets are."""
    own, other = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(own, "a").join(other, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("n"))
    return both.select("a", "b", (F.col("both") * SIMILAR[1] >= (F.col("n") - F.col("both")) * SIMILAR[0]).alias("similar"))


def links(printed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that connect each group.

    printed: _at and what sketches() gives; texts: _at, text.
    """
    distinct = printed.groupBy("node").agg(F.min(F.struct("_at", "n_shingles", "bands", "sketch")).alias("d")).select("node", "d.*")
    keyed = distinct.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    meeting = cut(keyed.join(shared, "key"))
    # how many nodes each shares its hashes with
    weights = meeting.groupBy("node").agg(F.sum("many").alias("weight"))
    wanted = written(distinct.join(weights, "node").select("node", "_at", F.col("n_shingles").alias("n"), "sketch", "bands", "weight"), "near-wanted")
    meeting = written(meeting.select("key", "node").join(wanted.drop("_at"), "node"), "near-meeting")
    sets = written(_sets(texts.join(wanted.select("_at", "node"), "_at").select("node", "text")), "near-sets")

    found = tested = group = None
    for turn in range(STARS + 1):
        now = meeting if group is None else meeting.join(group, "node", "left")
        now = now.withColumn("g", F.coalesce("component", "node") if group is not None else F.col("node"))
        if turn < STARS:
            first = (-F.col("weight")) if turn == 0 else F.xxhash64("node", F.lit(turn))
            centre = now.groupBy("key").agg(F.min(F.struct(first.alias("h"), "node", "g", "n", "sketch")).alias("c"))
            met = now.join(centre, "key").select("g", "node", "n", "sketch", F.col("c.g").alias("g2"), F.col("c.node").alias("node2"), F.col("c.n").alias("n2"), F.col("c.sketch").alias("sketch2")).filter("g <> g2")
        else:
            # only hashes that are still shared by different groups
            open_keys = now.groupBy("key").agg((F.min("g") != F.max("g")).alias("open")).filter("open").select("key")
            left = cut(now.join(open_keys, "key").select("key", "node", "n", "g", "sketch", "bands"))
            right = left.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("g").alias("g2"), F.col("sketch").alias("sketch2"), F.col("bands").alias("bands2"))
            met = left.join(right, "key").filter("g < g2")
        low, high = F.least("n", "n2"), F.greatest("n", "n2")
        close = met.filter((low * SIMILAR[1] >= high * SIMILAR[0]) & (_agreeing("sketch", "sketch2") >= AGREE))
        if turn == STARS:
            # a pair that shares several hashes comes by the least of them
            close = close.filter(F.array_min(F.array_intersect("bands", "bands2")) == F.col("key"))
        pairs = close.select(F.greatest("node", "node2").alias("a"), F.least("node", "node2").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        judged = cut(_judged(pairs, sets))
        passed, pairs = judged.filter("similar").select("a", "b"), judged.select("a", "b")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = passed if found is None else found.unionByName(passed)
        if turn < STARS:
            group = cut(components(found).select("node", "component"))
            found = group.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return found
