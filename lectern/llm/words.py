"""Splitting whole texts into words with Arrow, shared by the operators of this package.

A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r. Texts that are
null have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def texts(column) -> pa.Array:
    """A text column as one large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def split(column) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, offsets): the words of text i are words[offsets[i]:offsets[i + 1]]."""
    lists = pc.ascii_split_whitespace(texts(column))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.not_equal(words, "")
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return words.filter(full), kept[offsets]


def split_encoded(column) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(index of each word into the distinct words, distinct words, offsets by text): split() and encode() at once."""
    lists = pc.ascii_split_whitespace(texts(column))
    codes, distinct = encode(lists.flatten())
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    empty = pc.index(distinct, "").as_py()
    if empty < 0:
        return codes, distinct, offsets
    full = codes != empty
    kept = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
    codes = codes[full]
    codes -= codes > empty
    return codes, pa.concat_arrays([distinct.slice(0, empty), distinct.slice(empty + 1)]), kept[offsets]


def encode(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(index of each word into the distinct words, distinct words)."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def hashes(distinct: pa.Array, seed: int = 42) -> np.ndarray:
    """XXH64 of the UTF-8 bytes of each string."""
    digest = xxhash.xxh64_intdigest
    binary = distinct.cast(pa.large_binary()).to_pylist()
    return np.fromiter((digest(x, seed) for x in binary), np.uint64, len(binary))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters its input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
