"""Packing token pieces into fixed windows by non-negative least squares over length combinations.

A document longer than a window is cut into full windows and a rest. Combinations of two to four
lengths that fill a window exactly are enumerated from the histogram of lengths (pairs of all
lengths; of three and four, those of the COMMON most frequent). Their repeat counts x >= 0 are
fitted to the histogram by least squares, rounded down, and taken as far as the lengths last.
What is left is packed greedily, longest first, again by counts of lengths. Windows that come
out under FULL are dissolved; their pieces are laid end to end and cut where windows end.

Only the histogram (one number per length up to the window) reaches the driver, and only the
plan, whose size depends on the window and not on the documents, goes back: for each length,
which ranks go to which windows. Each piece finds its rank among the pieces of its length.

Defined cases: a null or empty text is its end id alone; equal rows are packed one by one; rows
without doc_id are packed like others; no documents give no pieces.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import documents, ranked, written
from lectern.llm.tokenizing import encoder, parts, release, vocabulary_path

WINDOW = 2048
VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: Text that is encoded at once: bounds a task's memory.
PART_BYTES = 4 << 20
#: Lengths that are combined by threes and fours.
COMMON = 48
SWEEPS = 40
#: Share of a window that has to be filled.
FULL = 0.995


class Slots(NamedTuple):
    """Pieces of `length` with ranks from `low` on, up to the next row's `low`, go to windows base + rank - low, at `offset`."""

    length: np.ndarray
    low: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    #: Windows in all.
    windows: int


def combinations(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Combinations of two to four lengths that fill a window; histogram[l] is the number of pieces of length l."""
    window = len(histogram) - 1
    there = np.flatnonzero(histogram[:window])
    known = set(there.tolist())
    found = {(a, window - a) for a in known if 2 * a >= window and window - a in known}
    common = sorted(there[np.argsort(-histogram[there], kind="stable")][:COMMON].tolist())
    for i, a in enumerate(common):
        for j, b in enumerate(common[i:], i):
            if (rest := window - a - b) > 0:
                if rest in known:
                    found.add(tuple(sorted((a, b, rest), reverse=True)))
                for c in common[j:]:
                    if rest - c >= c and rest - c in known:
                        found.add(tuple(sorted((a, b, c, rest - c), reverse=True)))
    return sorted(found, reverse=True)


def nonnegative_fit(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that brings the sum of x times the columns' length counts near the target, by coordinate descent."""
    x = np.zeros(len(columns))
    rest = target.astype(float)
    counted = [tuple(Counter(c).items()) for c in columns]
    norms = [sum(m * m for _, m in c) for c in counted]
    rest = rest.tolist()
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(counted):
            step = sum(m * rest[length] for length, m in c) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for length, m in c:
                    rest[length] -= m * step
        if moved < 0.25:
            break
    return x


def plan(histogram: np.ndarray) -> tuple[Slots, np.ndarray]:
    """(slots, pieces placed by length); the pieces of each length from that rank on are the tail."""
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], most: int) -> int:
        counted = Counter(pattern)
        n = min([most, *(int(left[length]) // m for length, m in counted.items())])
        if n > 0:
            for length, m in counted.items():
                left[length] -= n * m
            patterns.append((pattern, n))
        return n

    take((window,), int(left[window]))
    columns = combinations(left)
    x = nonnegative_fit(columns, left)
    for j in np.argsort(-x, kind="stable"):
        take(columns[j], int(x[j]))
    lengths = np.flatnonzero(left[:window]).tolist()
    skipped = np.zeros(window + 1, np.int64)
    while lengths:
        pattern, space = [], window
        used: Counter[int] = Counter()
        at = len(lengths)
        while at := bisect.bisect_right(lengths, space, 0, at):
            length = lengths[at - 1]
            n = min(space // length, int(left[length]) - used[length])
            pattern += [length] * n
            used[length] += n
            space -= n * length
            at -= 1
        full = window - space >= FULL * window
        n = min(int(left[length]) // m for length, m in used.items())
        if full:
            take(tuple(pattern), n)
        else:
            # the longest length can't be filled up; it is left to the tail
            first = pattern[0]
            skipped[first] += left[first]
            left[first] = 0
        lengths = [x for x in lengths if left[x] > 0]
    placed = histogram.astype(np.int64) - skipped
    rows, used_ranks, base = [], np.zeros(window + 1, np.int64), 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, int(used_ranks[length]), base, offset))
            used_ranks[length] += n
            offset += length
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return Slots(*(table[:, i].copy() for i in range(4)), base), placed


def token_pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (little-endian unsigned 32-bit) of each document's full windows and rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary_path(VOCABULARY), end_id).encode
        for batch in batches:
            for rows, texts in parts(batch, 1, PART_BYTES):
                ids, offsets = encode(texts)
                n = np.diff(offsets)
                each = -(-n // window)
                of = np.repeat(np.arange(len(n)), each)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)) * window
                bounds = np.append(offsets[:-1][of] + start, offsets[-1]) * 4
                binary = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                columns = [rows.column(0).take(pa.array(of)), pa.array(start), pa.array(np.diff(bounds) // 4), pa.array(n[of]), binary.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids"])
        release()

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text)
    return named.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def layout(kept: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, list[int]]:
    """Where the pieces of kept (_at, length) go.

    Returned: (_at, sequence_id, offset) of those that stay whole; (_at, _skip, _take,
    sequence_id, offset) of the parts of the tail's pieces; and the lengths found in the tail.
    """
    spark = kept.sparkSession
    histogram = np.zeros(window + 1, np.int64)
    for length, n in kept.groupBy("length").count().collect():
        histogram[length] = n
    slots, placed = plan(histogram)
    # a few slots per length: bounded by the window, not by the documents
    shared = spark.sparkContext.broadcast((slots, placed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, placed = shared.value
        key = slots.length << 40 | slots.low
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            tail = rank >= placed[length]
            at = np.maximum(np.searchsorted(key, length << 40 | rank, side="right") - 1, 0)
            if len(key):
                sequence, offset = slots.base[at] + rank - slots.low[at], slots.offset[at]
            else:
                sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_at"), batch.column("length"), pa.array(sequence, mask=tail), pa.array(offset, mask=tail)], ["_at", "length", "sequence_id", "offset"])

    part = F.shiftright("_at", 33)
    ranks = ranked(kept.select("_at", "length"), ["length"], part, [F.col("_at")], "_rank")
    placed_at = written(ranks.mapInArrow(place, "_at long, length long, sequence_id long, offset long"), "placed")
    whole = placed_at.filter("sequence_id is not null").drop("length")

    tail = ranked(placed_at.filter("sequence_id is null").select("_at", "length"), [], part, [F.col("_at")], "_from", F.col("length"))
    first, last = F.expr(f"_from div {window}"), F.expr(f"(_from + length - 1) div {window}")
    cuts = tail.select("_at", "_from", "length", F.explode(F.sequence(first, last)).alias("_window"))
    low = F.greatest(F.col("_from"), F.col("_window") * window)
    high = F.least(F.col("_from") + F.col("length"), (F.col("_window") + 1) * window)
    cuts = cuts.select("_at", (low - F.col("_from")).alias("_skip"), (high - low).alias("_take"), (F.col("_window") + slots.windows).alias("sequence_id"), (low - F.col("_window") * window).alias("offset"))
    return whole, cuts, np.flatnonzero(placed < histogram).tolist()


def packed(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces (with start, length and ids, each up to a window).

    Pieces of the tail may come out cut in two, with start, length and ids of their own. Other
    columns are carried along.
    """
    kept = written(pieces.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    whole, cuts, tail = layout(kept, window)
    return kept.join(whole, "_at").drop("_at").unionByName(_cut(kept, cuts, tail).drop("_at"))


def _cut(kept: DataFrame, cuts: DataFrame, tail: list[int]) -> DataFrame:
    ids = F.expr("substring(ids, cast(_skip * 4 + 1 as int), cast(_take * 4 as int))")
    joined = kept.filter(F.col("length").isin(tail)).join(cuts, "_at")
    return joined.withColumns({"start": F.col("start") + F.col("_skip"), "length": F.col("_take"), "ids": ids}).drop("_skip", "_take")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, its number of ids, and the ids of its pieces in order."""
    joined = F.expr("aggregate(sort_array(collect_list(struct(offset, ids))), cast('' as binary), (a, x) -> a || x.ids)")
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), joined.alias("ids"))


_RESULT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def digests(docs: DataFrame) -> DataFrame:
    """What packed() gives for all documents, with the checksum of each piece's ids for the ids."""
    pieces = token_pieces(docs).withColumns({"ids_crc32": F.crc32("ids"), "_at": F.monotonically_increasing_id()})
    kept = written(pieces, "pieces")
    whole, cuts, tail = layout(kept)
    cut = _cut(kept, cuts, tail).withColumn("ids_crc32", F.crc32("ids"))
    return kept.drop("ids").join(whole, "_at").select(*_RESULT).unionByName(cut.select(*_RESULT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places."""
    return digests(docs)


QUERIES = {"op10_packing": query}
