"""The nearest vectors by cosine, exactly: blocks of queries meet blocks of rows.

Every pair of blocks is a group of its own and holds one block of either side, however many rows
there are. In it tiles of products are made; of a tile only those are looked at that can enter a
query's best, and each pair of blocks hands on the best `most` of each query.

Cosines are compared as they are shown, rounded to DIGITS places, equal ones by id. Defined cases,
as DuckDB orders them: the cosine with a vector that is null, empty or holds a null is null and comes last; with a
vector of length zero, or one that is not finite, it is NaN and comes first; vectors of other
numbers of components are an error; a query leaves out all rows of its own id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6
#: Queries and rows of a tile of products.
TILE_QUERIES, TILE_ROWS = 512, 8192
#: Places of null, of a row that takes no part and of NaN among cosines.
_NULL, _NONE, _NAN = -2.0, -np.inf, 2.0


def _units(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length one, whether each is there); those that are null, empty or hold a null are zeros."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(whole.value_lengths().fill_null(0))
    flat = whole.flatten()
    missing = np.asarray(flat.is_null())
    start = np.concatenate([[0], np.cumsum(sizes)])
    there = (sizes > 0) & (np.concatenate([[0], np.cumsum(missing)])[start[1:]] == np.concatenate([[0], np.cumsum(missing)])[start[:-1]])
    dims = set(sizes[there].tolist())
    if len(dims) > 1:
        raise ValueError(f"vectors of {sorted(dims)} components can't be compared")
    dim = dims.pop() if dims else 1
    out = np.zeros((len(sizes), dim))
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    out[there] = values[np.repeat(there, sizes)].reshape(-1, dim)
    with np.errstate(all="ignore"):
        out[there] /= np.sqrt((out[there] * out[there]).sum(axis=1))[:, None]
    return out, there


def rounded(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


def _best(asked: np.ndarray, q: np.ndarray, q_there: np.ndarray, ids: np.ndarray, x: np.ndarray, x_there: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, cosine or its place) of each query's best; ids ascend."""
    at, found, keys = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    last = np.full(len(asked), _NONE)
    odd = bool(np.isnan(q).any() or np.isnan(x).any())
    for begin in range(0, len(ids), TILE_ROWS):
        own = slice(begin, begin + TILE_ROWS)
        with np.errstate(all="ignore"):
            products = q @ x[own].T
        if odd:
            products[np.isnan(products)] = _NAN
        products[:, ~x_there[own]] = _NULL
        products[~q_there] = _NULL
        low, high = np.searchsorted(ids[own], asked), np.searchsorted(ids[own], asked, side="right")
        for i in np.flatnonzero(high > low):
            products[i, low[i] : high[i]] = _NONE
        # what is shown as no more than the last of the best comes after it, as ids ascend
        least = last + 4 * 10.0 ** -(DIGITS + 1)
        if products.shape[1] > most:
            of_tile = np.partition(products, -most, axis=1)[:, -most] - 11 * 10.0 ** -(DIGITS + 1)
            least = np.where(np.isneginf(last), of_tile, least)
        row, column = np.nonzero((products > least[:, None]) & (products > _NONE))
        if not len(row):
            continue
        new = products[row, column]
        shown = np.abs(new) < _NAN
        new[shown] = rounded(new[shown])
        at, found, keys = np.concatenate([at, row]), np.concatenate([found, ids[own][column]]), np.concatenate([keys, new])
        order = np.lexsort((found, -keys, at))
        at, found, keys = at[order], found[order], keys[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < most
        at, found, keys = at[kept], found[kept], keys[kept]
        many = np.bincount(at, minlength=len(asked))
        full = many == most
        last[full] = keys[np.cumsum(many)[full] - 1]
    return at, found, keys


def nearest(vectors: DataFrame, queries: DataFrame, most: int, block: int) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the `most` rows nearest to each query. vectors: vec_id, embedding; queries: query_id, embedding; block: rows of a block, on either side."""
    n_rows, n_asked = (df.count() // block + 1 for df in (vectors, queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.select(dealt("query_id", n_asked).alias("asked_block"), every(n_rows).alias("block"), F.col("query_id").cast("long").alias("query_id"), "embedding")
    right = vectors.select(every(n_asked).alias("asked_block"), dealt("vec_id", n_rows).alias("block"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        ids, query_ids = rows["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        (q, q_there), (x, x_there) = _units(asked["embedding"]), _units(rows["embedding"])
        if q_there.any() and x_there.any() and q.shape[1] != x.shape[1]:
            raise ValueError(f"vectors of {q.shape[1]} and {x.shape[1]} components can't be compared")
        if q.shape[1] != x.shape[1]:
            # one side has no vector at all
            q, x = (q, np.zeros((len(ids), q.shape[1]))) if q_there.any() else (np.zeros((len(query_ids), x.shape[1])), x)
        parts = []
        for begin in range(0, len(query_ids), TILE_QUERIES):
            own = slice(begin, begin + TILE_QUERIES)
            at, found, keys = _best(query_ids[own], q[own], q_there[own], ids, x, x_there, most)
            parts.append(pa.table({"query_id": query_ids[own][at], "vec_id": found, "cosine": pa.array(np.where(keys == _NAN, np.nan, keys), mask=keys == _NULL)}))
        return pa.concat_tables(parts) if parts else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})

    of_blocks = left.groupBy("asked_block", "block").cogroup(right.groupBy("asked_block", "block")).applyInArrow(lambda a, b: meet(a, b), "query_id long, vec_id long, cosine double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("cosine"), "vec_id"))
    return of_blocks.withColumn("rank", order).filter(F.col("rank") <= most)
