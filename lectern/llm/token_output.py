"""Token ids on disk as grammars: Re-Pair compression per shard.

Documents are range-partitioned by doc_id; each partition is a shard, whose blocks of about
PART_BYTES of text are compressed one by one. Within a block frequent adjacent pairs of symbols
are replaced by new symbols, round after round, until no pair can be replaced at MIN_COUNT
places: a rule takes three numbers (its two symbols and its expansion length) and each
replacement saves one, so rarer pairs do not pay. Neither rounds nor rules are limited. A round
replaces all such pairs at once; where they overlap, the more frequent one goes first. Pairs
counted as rare stay rare, so later rounds look only at places beside new symbols and at frequent
pairs that had to wait.

Rounds first work on the distinct cuts of the text (mostly words) weighted by how often they
occur, then on the whole block; no rule reaches over the end of a document.

The file format is a Parquet table with a row per block:

    shard, block      place in the order of documents
    doc_ids           array of the block's documents in ascending order
    n_tokens          array: ids of each document, its end id included
    at                array: first symbol of each document, and the number of symbols at last
    n_rules           how many nonterminals there are
    top               number of the first nonterminal: one more than the block's greatest id
    width             bits of a symbol: as many as its greatest number takes
    length_width      bits of an expansion length, likewise
    rules             binary: for nonterminal top + i its two symbols, of width bits each
    lengths           binary: how many ids each nonterminal expands to
    symbols           binary: the compressed sequence
    (numbers of a fixed width one after the other, least bit first, in bytes filled from their least bit)

A document is decoded by itself from its slice of symbols, which starts at bit `at` times `width`;
the expansion lengths find the symbol that holds its k-th id without expanding those before it.

Defined cases: a null or empty text is its end id alone; rows without doc_id come first; rows
that repeat a doc_id are ordered by a hash of the text, so that many of them spread over shards;
no documents give no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import chunk_count, documents, new_path
from lectern.llm.tokenizing import encoder, parts, release, vocabulary_path

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
#: Symbols from here on are nonterminals in memory.
FIRST_RULE = 1 << 17
#: Numbers packed or unpacked at a time: bounds memory.
PACK = 1 << 18
SHARD_BYTES = 24 << 20
#: Text to a block: bounds a task's memory.
PART_BYTES = 4 << 20
MIN_COUNT = 4

_BLOCKS = "shard int, block int, doc_ids array<long>, n_tokens array<int>, at array<int>, n_rules int, top int, width int, length_width int, rules binary, lengths binary, symbols binary"


def _by_pair(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places at, ordered by their pairs (left, right), then place; where each pair's begin, and the end)."""
    if len(at) and int(at[-1]) < 1 << 24 and max(int(left.max()), int(right.max())) < 1 << 20:
        # a pair and its place fit in one number, which sorts fastest
        key = np.sort((left.astype(np.uint64) << np.uint64(44)) | (right.astype(np.uint64) << np.uint64(24)) | at.astype(np.uint64))
        at = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
        pair = key >> np.uint64(24)
    else:
        pair = left.astype(np.int64) << 32 | right
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
    return at, np.append(np.flatnonzero(np.append(True, pair[1:] != pair[:-1])), len(at)) if len(at) else np.zeros(1, np.int64)


def replace_rounds(symbols: np.ndarray, of: np.ndarray, weights: np.ndarray | None, next_rule: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(symbols left, what each is of, the rules of each round): rounds of replacements until none pays.

    of: what each symbol is of (a cut, a document), in ascending order; pairs do not reach over it.
    weights: how often each of these occurs (None: once).
    """
    rules = []
    alive = np.arange(max(0, len(symbols) - 1))
    while True:
        alive = alive[of[alive] == of[alive + 1]]
        if not len(alive):
            return symbols, of, rules
        at, begin = _by_pair(symbols[alive], symbols[alive + 1], alive)
        # of a pair that overlaps itself, every other place counts
        run = np.append(True, at[1:] != at[:-1] + 1)
        run[begin[:-1]] = True
        since = np.arange(len(at))
        apart = (since - np.maximum.accumulate(np.where(run, since, 0))) % 2 == 0
        count = np.add.reduceat(apart if weights is None else np.where(apart, weights[of[at]], 0), begin[:-1], dtype=np.int64)
        frequent = np.flatnonzero(count >= MIN_COUNT)
        if not len(frequent):
            return symbols, of, rules
        # the most frequent pair has rank 0; ties by symbols
        frequent = frequent[np.argsort(-count[frequent], kind="stable")]
        sizes = begin[frequent + 1] - begin[frequent]
        first = np.cumsum(sizes) - sizes
        here = np.arange(sizes.sum()) + np.repeat(begin[frequent] - first, sizes)
        places, apart, big = at[here], apart[here], np.int32(len(frequent))
        own = np.repeat(np.arange(big, dtype=np.int32), sizes)[apart]
        rank = np.full(len(symbols) + 2, big, np.int32)
        rank[places[apart] + 1] = own
        ahead = (own < rank[places[apart]]) & (own < rank[places[apart] + 2])
        won, ranks = places[apart][ahead], own[ahead]
        paid = np.bincount(ranks, weights=None if weights is None else weights[of[won]], minlength=big) >= MIN_COUNT
        won, ranks = won[paid[ranks]], ranks[paid[ranks]]
        number = np.cumsum(paid) - 1
        one = at[begin[frequent[paid]]]
        rules.append(np.stack([symbols[one], symbols[one + 1]], axis=1))
        symbols = symbols.copy()
        symbols[won] = next_rule + number[ranks]
        next_rule += len(one)
        kept = np.ones(len(symbols), bool)
        kept[won + 1] = False
        # what may be frequent in the next round: pairs with a new symbol, and frequent ones that had to wait
        mark = np.zeros(len(symbols) + 1, bool)
        mark[places] = True
        mark[won] = True
        mark[won - 1] = True
        mark[-1] = False
        before = np.flatnonzero(kept)
        marked = mark[before]
        # a pair's first symbol may have been the one that went
        marked[:-1] |= mark[before[1:] - 1]
        symbols, of = symbols[before], of[before]
        alive = np.flatnonzero(marked[:-1])


def compress(used: np.ndarray, index: np.ndarray, by_text: np.ndarray, flat: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(symbols, first symbol by document with the number of symbols at last, rules by round).

    used: the distinct cuts, index: which of them each cut of the documents is, by_text: offsets
    of documents in them; cut c stands for the ids flat[at[c]:at[c + 1]]. Each document gets the
    end id.
    """
    count = np.bincount(index, minlength=len(used))
    lengths = at[used + 1] - at[used]
    of = np.repeat(np.arange(len(used), dtype=np.int32), lengths)
    first = np.cumsum(lengths) - lengths
    symbols = flat[np.arange(len(of)) + np.repeat(at[used] - first, lengths)].astype(np.int32)
    symbols, of, rules = replace_rounds(symbols, of, count, FIRST_RULE)
    word_at = np.searchsorted(of, np.arange(len(used) + 1))
    each = (word_at[1:] - word_at[:-1])[index]
    bounds = np.concatenate([[0], np.cumsum(each)])
    sequence = symbols[np.arange(bounds[-1]) + np.repeat(word_at[:-1][index] - bounds[:-1], each)]
    ends = bounds[by_text[1:]]
    sequence = np.insert(sequence, ends, end_id)
    document = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(bounds[by_text]) + 1)
    sequence, document, more = replace_rounds(sequence, document, None, FIRST_RULE + sum(map(len, rules)))
    return sequence, np.searchsorted(document, np.arange(len(ends) + 1)), rules + more


def expansion_lengths(rules: list[np.ndarray]) -> np.ndarray:
    """How many ids each rule stands for; a round's rules hold symbols of the rounds before."""
    found = np.zeros(0, np.int64)
    for own in rules:
        each = np.ones(own.shape, np.int64)
        inner = own >= FIRST_RULE
        each[inner] = found[own[inner] - FIRST_RULE]
        found = np.append(found, each.sum(axis=1))
    return found


def bits_of(greatest: int) -> int:
    return max(1, int(greatest).bit_length())


def pack(numbers: np.ndarray, width: int) -> bytes:
    """The numbers in width bits each."""
    out = []
    # slices of a multiple of eight numbers end at a byte
    for low in range(0, len(numbers), PACK):
        own = np.ascontiguousarray(numbers[low : low + PACK], "<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(own, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """The numbers from start up to stop; no byte that holds none of them is looked at."""
    found = np.zeros(max(0, stop - start), np.uint32)
    for low in range(start, stop, PACK):
        high = min(stop, low + PACK)
        first = low * width // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-high * width // 8) - first, first), bitorder="little")
        wide = np.zeros((high - low, 32), np.uint8)
        wide[:, :width] = bits[low * width - 8 * first :][: (high - low) * width].reshape(-1, width)
        found[low - start : high - start] = np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)
    return found


class Packed(NamedTuple):
    """A block's grammar as it is in the file."""

    n_rules: int
    top: int
    width: int
    length_width: int
    rules: bytes
    lengths: bytes
    symbols: bytes


def packed(rules: list[np.ndarray], symbols: np.ndarray) -> Packed:
    flat = np.concatenate([np.zeros((0, 2), np.int32), *rules]).reshape(-1).astype(np.int64)
    lengths = expansion_lengths(rules)
    ids = [x[x < FIRST_RULE].max(initial=-1) for x in (flat, symbols)]
    top = int(max(ids)) + 1
    width, length_width = bits_of(top + len(lengths) - 1), bits_of(lengths.max(initial=1))
    near = lambda x: np.where(x < FIRST_RULE, x, x - FIRST_RULE + top)
    return Packed(len(lengths), top, width, length_width, pack(near(flat), width), pack(lengths, length_width), pack(near(symbols.astype(np.int64)), width))


class Symbols:
    """The packed sequence of a block, unpacked by slices."""

    def __init__(self, grammar: Packed, n: int) -> None:
        self.grammar, self.n = grammar, n

    def __getitem__(self, part: slice) -> np.ndarray:
        start, stop, _ = part.indices(self.n)
        return far(unpack(self.grammar.symbols, self.grammar.width, start, stop), self.grammar.top)


def far(symbols: np.ndarray, top: int) -> np.ndarray:
    """Symbols of the file as they are in memory."""
    return np.where(symbols < top, symbols, symbols - np.uint32(top) + np.uint32(FIRST_RULE))


class Block:
    """A block read back: all of it, or documents and parts of them by themselves."""

    def __init__(self, grammar: Packed, at: np.ndarray) -> None:
        self.rules = far(unpack(grammar.rules, grammar.width, 0, 2 * grammar.n_rules), grammar.top).reshape(-1, 2)
        self.lengths = unpack(grammar.lengths, grammar.length_width, 0, grammar.n_rules)
        self.symbols, self.at = Symbols(grammar, int(at[-1])), at

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a few symbols, from the top down."""
        while (rule := symbols >= FIRST_RULE).any():
            first = np.cumsum(1 + rule) - 1 - rule
            pair = self.rules[symbols[rule] - FIRST_RULE]
            symbols = np.repeat(symbols, 1 + rule)
            symbols[first[rule]], symbols[first[rule] + 1] = pair[:, 0], pair[:, 1]
        return symbols

    def document(self, i: int) -> np.ndarray:
        """The ids of document i."""
        return self._expanded(self.symbols[self.at[i] : self.at[i + 1]])

    def part(self, i: int, start: int, stop: int) -> np.ndarray:
        """The ids of document i from start up to stop, by expanding only the symbols that hold them."""
        symbols = self.symbols[self.at[i] : self.at[i + 1]]
        each = self._sizes(symbols)
        ends = np.cumsum(each)
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self._expanded(symbols[a:b])[skip : skip + stop - start]

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        each = np.ones(len(symbols), np.int64)
        rule = symbols >= FIRST_RULE
        each[rule] = self.lengths[symbols[rule] - FIRST_RULE]
        return each

    def ids(self) -> np.ndarray:
        """The ids of all documents, one after the other."""
        # the ids of the rules, from the bottom up: each time those whose symbols are known by then
        ends = np.cumsum(self.lengths, dtype=np.int64)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)

        def spread(symbols: np.ndarray, out: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
            rule = symbols >= FIRST_RULE
            out[at[~rule]] = symbols[~rule]
            own, size = symbols[rule] - FIRST_RULE, sizes[rule]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(at[rule], size) + inside] = flat[np.repeat(ends[own] - size, size) + inside]

        needs = np.where(self.rules >= FIRST_RULE, self.rules.astype(np.int64) - FIRST_RULE, -1).max(axis=1, initial=-1)
        done = 0
        while done < len(needs):
            later = needs[done:] >= done
            stop = done + int(later.argmax()) if later.any() else len(needs)
            both = self.rules[done:stop].reshape(-1)
            sizes = self._sizes(both)
            begin = int(ends[done - 1]) if done else 0
            spread(both, flat, begin + np.cumsum(sizes) - sizes, sizes)
            done = stop
        symbols = self.symbols[:]
        sizes = self._sizes(symbols)
        whole = np.zeros(int(sizes.sum()), np.uint32)
        spread(symbols, whole, np.cumsum(sizes) - sizes, sizes)
        return whole


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encodes all documents and writes their ids to path, in ascending order of doc_id."""
    shards = chunk_count(docs.sparkSession, docs, text, SHARD_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary or vocabulary_path(VOCABULARY), end_id)
        block = 0
        for batch in batches:
            for rows, texts in parts(batch, 2, PART_BYTES):
                used, index, by_text = e.cut_codes(texts)
                tokens = np.concatenate([[0], np.cumsum((e.at[used + 1] - e.at[used])[index])])[by_text]
                symbols, at, rules = compress(used, index, by_text, e.flat, e.at, end_id)
                values = {
                    "shard": rows.column(0).to_pylist()[:1],
                    "block": [block],
                    "doc_ids": [rows.column(1).to_pylist()],
                    "n_tokens": [(np.diff(tokens) + 1).tolist()],
                    "at": [at.tolist()],
                    **{k: [v] for k, v in packed(rules, symbols)._asdict().items()},
                }
                types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int32()] * 4, *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values.values(), types, strict=True)], list(values))
                block += 1
        release()

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_hash"))
    ordered = named.repartitionByRange(shards, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(run, _BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids of each document in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                ids = Block(Packed(*[r[k] for k in Packed._fields]), np.array(r["at"])).ids().astype("<u4")
                n = np.array(r["n_tokens"], np.int64)
                ends = np.cumsum(n)
                binary = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(4 * np.append(0, ends)), pa.py_buffer(ids)])
                for low in range(0, len(n), 256):
                    columns = [pa.array(r["doc_ids"][low : low + 256], pa.int64()), pa.array(r["start"] + (ends - n)[low : low + 256]), pa.array(n[low : low + 256]), binary.slice(low, 256).cast(pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
        release()

    blocks = spark.read.schema(_BLOCKS).parquet(path)
    counts = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard in the first of these, one per block of a shard in the second
    shards = counts.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(upto.orderBy("shard")), F.lit(0)).alias("before"))
    inside = counts.select("shard", "block", F.coalesce(F.sum("n").over(upto.partitionBy("shard").orderBy("block")), F.lit(0)).alias("inside"))
    starts = inside.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("start"))
    return blocks.join(starts, ["shard", "block"]).drop("shard", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write(documents(spark, sf_dir), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op4_token_output": query}
