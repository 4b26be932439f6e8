"""Substring deduplication by recompression.

A window is WINDOW consecutive words of a document. Each word covered by a window whose word
sequence also starts earlier (in a document with a smaller doc_id, or earlier in the same one)
is removed.

1. Documents are dealt out in chunks by a hash of doc_id and text. Exact copies of an earlier
   document need no search: all their windows start earlier.
2. Each chunk's word sequence is recompressed (see recompression): runs are named in the first
   round, then pairs in each of ROUNDS rounds. Every window has an anchor,
   a symbol that is decided by the window's words alone, so equal windows share it, and the words
   that decided it, wherever they are. Neighbouring windows mostly have the same anchor: about one
   anchor for six words goes over the network, each distinct one once a chunk.
3. An anchor found at one place only proves that its windows are unique. The names of shared
   anchors go back to the chunks that have them.
4. Windows with shared anchors are verified by 96 bits of hash over their words. Each chunk
   keeps the first place of each, so that a passage found in every document makes one row a
   chunk; over all chunks the first place of each window stands, the others are repeats.
5. The repeats go back to their chunks, which drop the covered words.

Defined cases: a null text has no words; a text with fewer words than a window keeps all; rows
that repeat a doc_id are ordered by a hash of the text (first by its chunk), and of equal rows one
comes first; a null doc_id comes before all others; no documents give no rows. Equal rows of one
doc_id share a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import recompression as R
from lectern.llm import words as W
from lectern.llm.common import chunk_count, documents
from lectern.llm.tokenizing import release

WINDOW = 20
ROUNDS = 4
CHUNK_BYTES = 8 << 20


class _Chunk:
    """The documents of a chunk in order, as one sequence of word hashes with a border before the first document and after each."""

    def __init__(self, table: pa.Table, hints: pa.Table) -> None:
        table = table.sort_by([("doc_id", "ascending"), ("h1", "ascending"), ("h2", "ascending")]) if table.num_rows else table
        # Arrow sorts nulls last
        nulls = pc.is_null(table["doc_id"]).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        order = np.concatenate([np.flatnonzero(nulls), np.flatnonzero(~nulls)])
        self.table = table.take(pa.array(order)) if nulls.any() else table
        self.rows = self.table.num_rows
        self.doc_id = pc.fill_null(self.table["doc_id"], 0).to_numpy()
        self.known = pc.is_valid(self.table["doc_id"]).to_numpy(zero_copy_only=False)
        self.words, self.offsets = W.split(self.table["text"])
        self.n_words = np.diff(self.offsets)
        kind = hints["kind"].to_numpy()
        a, b, stop = (pc.fill_null(hints[x], 0).to_numpy() for x in ("a", "b", "stop"))
        self.hints = {k: (a[kind == k], b[kind == k], stop[kind == k]) for k in (0, 1, 2)}
        h1, h2 = (self.table[c].to_numpy() for c in ("h1", "h2"))
        same = np.zeros(self.rows, bool)
        if self.rows > 1:
            same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & (self.doc_id[1:] == self.doc_id[:-1]) & (self.known[1:] == self.known[:-1])
        copied = set(zip(self.hints[1][0].tolist(), self.hints[1][1].tolist(), strict=True))
        self.copy = same | np.fromiter(((d, h) in copied for d, h in zip(self.doc_id.tolist(), h1.tolist(), strict=True)), bool, self.rows)

    def sequence(self) -> None:
        """Sets coded words of the documents that are not copies, with borders, and the windows within documents."""
        codes, distinct = W.encode(self.words)
        use = np.repeat(~self.copy, self.n_words)
        self.row = np.flatnonzero(~self.copy)
        length = self.n_words[self.row]
        # the first word too has a border before it, or its symbols would count as decided without it
        self.starts = 1 + np.concatenate([[0], np.cumsum(length + 1)[:-1]]) if len(length) else np.zeros(0, np.int64)
        total = 1 + int((length + 1).sum())
        border = np.zeros(total, bool)
        border[0] = True
        border[self.starts + length] = True
        self.seqs = []
        for seed in (42, 43):
            name = W.hashes(distinct, seed)
            name[name == R.BORDER] = 1
            seq = np.zeros(total, np.uint64)
            seq[~border] = name[codes[use]]
            self.seqs.append(seq)
        n = max(0, total - WINDOW + 1)
        upto = np.concatenate([[0], np.cumsum(border, dtype=np.int32)])
        self.whole = upto[WINDOW : WINDOW + n] == upto[:n]


def _anchor_rows(key, table: pa.Table, hints: pa.Table) -> pa.Table:
    c = _Chunk(table, hints)
    c.sequence()
    name, place = (x[c.whole] for x in R.anchors(c.seqs[0], WINDOW, ROUNDS))
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (place[1:] != place[:-1])
    found, count = np.unique(name[new], return_counts=True)
    return pa.table({"chunk": pa.array(np.full(len(found), key[0].as_py(), np.int32)), "anchor": found.view(np.int64), "many": count > 1})


def _window_hash(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    base, found = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(at), np.uint64)
    for j in range(WINDOW):
        found *= base
        found += seq[at + j]
    return W.mix(found)


def _window_rows(key, table: pa.Table, hints: pa.Table) -> pa.Table:
    c = _Chunk(table, hints)
    c.sequence()
    shared = np.sort(c.hints[0][0].view(np.uint64))
    name, _ = R.anchors(c.seqs[0], WINDOW, ROUNDS)
    at = np.flatnonzero(c.whole)
    if len(shared):
        spot = np.minimum(np.searchsorted(shared, name[at]), len(shared) - 1)
        at = at[shared[spot] == name[at]]
    else:
        at = at[:0]
    h1, h2 = _window_hash(c.seqs[0], at), _window_hash(c.seqs[1], at)
    order = np.lexsort((h2, h1))
    first = np.ones(len(at), bool)
    first[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    firsts = np.sort(order[first])
    repeats = at[np.sort(order[~first])]
    doc = np.searchsorted(c.starts, at[firsts], side="right") - 1
    row = c.row[doc]
    windows = pa.table(
        {
            "h1": h1[firsts].view(np.int64),
            "h2": h2[firsts].astype(np.uint32).view(np.int32),
            "doc_id": pa.array(c.doc_id[row], pa.int64(), mask=~c.known[row]),
            "at": row << 32 | at[firsts] - c.starts[doc],
            "known": np.zeros(len(firsts), np.int32),
        }
    )
    # what a chunk knows to be a repeat leaves it as ranges of windows
    begin = np.ones(len(repeats), bool)
    begin[1:] = repeats[1:] != repeats[:-1] + 1
    end = np.append(begin[1:], True) if len(repeats) else begin
    low, high = repeats[begin], repeats[end] + 1
    doc = np.searchsorted(c.starts, low, side="right") - 1
    ranges = pa.table({"h1": low.astype(np.int64), "h2": np.full(len(low), key[0].as_py(), np.int32), "at": c.row[doc] << 32 | low - c.starts[doc], "known": (high - low).astype(np.int32)})
    out = pa.concat_tables([windows, ranges], promote_options="default")
    release()
    return out.append_column("chunk", pa.array(np.full(out.num_rows, key[0].as_py(), np.int32)))


#: at: the document's row in its chunk, times 2^32, plus the window's first word; known: a range of so many windows that surely are repeats.
_WINDOW_ROWS = "h1 long, h2 int, doc_id long, at long, known int, chunk int"


def _kept_rows(key, table: pa.Table, hints: pa.Table) -> pa.Table:
    c = _Chunk(table, hints)
    total = int(c.offsets[-1])
    change = np.zeros(total + 1, np.int32)
    at, _, windows = c.hints[2]
    low = c.offsets[at >> 32] + (at & 0xFFFFFFFF)
    np.add.at(change, low, 1)
    np.add.at(change, low + windows - 1 + WINDOW, -1)
    gone = np.cumsum(change[:-1]) > 0
    gone |= np.repeat(c.copy & (c.n_words >= WINDOW), c.n_words)
    left = np.concatenate([[0], np.cumsum(~gone, dtype=np.int64)])[c.offsets]
    kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), c.words.filter(pa.array(~gone)).cast(pa.string()))
    n_kept = np.diff(left)
    return pa.table(
        {
            "doc_id": c.table["doc_id"],
            "n_words": c.n_words.astype(np.int64),
            "n_removed": (c.n_words - n_kept).astype(np.int64),
            "kept": pc.binary_join(kept, " "),
        }
    )


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each document."""
    chunks = chunk_count(docs.sparkSession, docs, text, CHUNK_BYTES)
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", text), F.lit(chunks)).cast("int").alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), F.col(text)).alias("h2"),
        F.col(text).alias("text"),
    )
    seen = dealt.select("chunk", "doc_id", "h1", "h2").distinct()
    first = seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = seen.join(first, ["h1", "h2"]).filter("doc_id > first")
    copies = copies.select(F.col("chunk").alias("to_chunk"), F.lit(1).alias("kind"), F.col("doc_id").alias("a"), F.col("h1").alias("b"), F.lit(None).cast("int").alias("stop"))

    by_chunk = dealt.groupBy("chunk")
    found = by_chunk.cogroup(copies.groupBy("to_chunk")).applyInArrow(_anchor_rows, "chunk int, anchor long, many boolean")
    same = Window.partitionBy("anchor")
    shared = found.withColumn("n", F.count("*").over(same)).filter("many or n > 1")
    shared = shared.select(F.col("chunk").alias("to_chunk"), F.lit(0).alias("kind"), F.col("anchor").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("int").alias("stop"))

    windows = by_chunk.cogroup(shared.unionByName(copies).groupBy("to_chunk")).applyInArrow(_window_rows, _WINDOW_ROWS)
    known = F.col("known") > 0
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "chunk", "at")
    earliest = F.min(place).over(Window.partitionBy("h1", "h2", known.cast("int")))
    repeats = windows.withColumn("first", earliest).filter(known | (place > F.col("first")))
    repeats = repeats.select(F.col("chunk").alias("to_chunk"), F.lit(2).alias("kind"), F.col("at").alias("a"), F.lit(None).cast("long").alias("b"), F.greatest("known", F.lit(1)).alias("stop"))

    return by_chunk.cogroup(repeats.unionByName(copies).groupBy("to_chunk")).applyInArrow(_kept_rows, "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": query}
