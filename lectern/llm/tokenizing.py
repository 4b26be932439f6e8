"""Token ids of whole texts by the tokenizers library, with each distinct piece of text encoded once.

The tokenizers used here split texts with patterns whose matches never reach from a character
that is no white space into white space after it. So a text may be cut before white space that
follows such a character, and the ids of the text are those of its cuts one after the other.
Cuts repeat (most are a space and a word); each distinct one goes through the library once. Many
go at once, with a special token of the tokenizer between them, at which their ids are told apart.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lectern.llm import words as W

#: Texts are worked through in parts of about so many bytes, to bound memory.
PART_BYTES = 8 << 20
#: Distinct cuts are kept from part to part until they take so many bytes with their ids.
CACHE_BYTES = 24 << 20
#: Cuts that go to the library at once, and so many of them as one text.
ENCODE_AT_ONCE, JOINED = 16_384, 128


def vocabulary_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where cuts start: at each text, before white space after a character that surely is none, before a stop after a letter.

    Surely no white space: an ASCII character over space, or one of two bytes from U+00C0 on.
    Stops are . and , and letters here those of ASCII and U+00C0 to U+00FF.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    solid = (data > 32) & (data < 128)
    if len(data) > 1:
        solid[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    start = np.zeros(len(data), bool)
    start[1:] = space[1:] & solid[:-1]
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    start[1:] |= ((data[1:] == 46) | (data[1:] == 44)) & letter[:-1]
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        special = {i: t for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark_id, mark = max(special.items(), key=lambda x: x[0], default=(-1, None))
        self.mark = mark.content if mark else ""
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.bytes = 0

    def codes(self, distinct: pa.Array) -> np.ndarray:
        """The number in the cache of each distinct cut."""
        if self.bytes > CACHE_BYTES:
            self.clear()
        place = pc.index_in(distinct, value_set=self.known)
        missing = pc.is_null(place)
        codes = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        new = distinct.filter(missing)
        if len(new):
            ids, sizes = [self.flat], []
            for low in range(0, len(new), ENCODE_AT_ONCE):
                own, lengths = self._encoded(new.slice(low, ENCODE_AT_ONCE).cast(pa.large_string()).to_pylist())
                ids.append(own)
                sizes.append(lengths)
            self.flat = np.concatenate(ids)
            ends = np.cumsum(np.concatenate(sizes))
            codes[missing.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(new))
            self.at = np.concatenate([self.at, self.at[-1] + ends])
            self.known = pa.concat_arrays([self.known, new])
            self.bytes = self.known.nbytes + self.flat.nbytes + self.at.nbytes
        return codes

    def _encoded(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each cut has)."""
        encode = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        groups = [cuts[low : low + JOINED] for low in range(0, len(cuts), JOINED)]
        ids, sizes = [], []
        gc.disable()  # many small lists, none in a cycle
        try:
            for group, found in zip(groups, encode([self.mark.join(g) for g in groups]) if self.mark else groups, strict=True):
                own = np.array(found if self.mark else [], np.uint32)
                marks = np.flatnonzero(own == self.mark_id)
                if len(marks) != len(group) - 1:
                    # a cut holds the mark itself
                    each = encode(group)
                    sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
                    ids.append(np.fromiter(chain.from_iterable(each), np.uint32, int(sizes[-1].sum())))
                else:
                    sizes.append(np.diff(np.concatenate([[-1], marks, [len(own)]])) - 1)
                    ids.append(np.delete(own, marks))
        finally:
            gc.enable()
        return np.concatenate(ids), np.concatenate(sizes)

    def cut_codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes of the distinct cuts, which of them each cut is, offsets by text)."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        starts = _cuts(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        index, distinct = W.encode(pieces)
        return self.codes(distinct), index, np.searchsorted(starts, offsets)

    def spread(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the cuts in order, offsets by cut)."""
        lengths = self.at[codes + 1] - self.at[codes]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        where = np.arange(offsets[-1]) + np.repeat(self.at[codes] - offsets[:-1], lengths)
        return self.flat[where], offsets

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, offsets by text)."""
        codes, index, by_text = self.cut_codes(texts)
        ids, by_cut = self.spread(codes[index])
        offsets = by_cut[by_text]
        full = np.insert(ids, offsets[1:], self.end_id)
        return full, offsets + np.arange(len(offsets))


def parts(batch: pa.RecordBatch, column: int, size: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in parts of about `size` bytes of text (a text is never cut), each with its texts."""
    texts = W.texts(batch.column(column))
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield batch.slice(at, stop - at), texts.slice(at, stop - at)
        at = stop


def release() -> None:
    """Gives memory that is no longer used back, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


@cache
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a worker, so that its cache serves them all."""
    return Encoder(path, end_id)
