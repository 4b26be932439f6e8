"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are quantised to integers, floor(SCALE * x), so that scores are exact. Candidates are
bucketed by length (norm); large buckets are split in blocks by a hash, so that neither a common
length nor a common vector makes a large group. Each query starts with a threshold: its k-th best
score among the SEEDS longest candidates. Queries meet the blocks that can hold a better score.

In a block a query has the local cosine threshold t = threshold / (|query| * longest length).
Over 1, nothing in the block can win. From COSINE on, coordinates prune: a unit vector within
cosine t of the query lies, in each coordinate, in a known interval, and candidates outside of it
in any of the query's FOCUS largest coordinates go. Below, length prunes: candidates are sorted
by length, and those shorter than threshold / |query| go. The others' products are computed.
Pruning is strict and allows for rounding, so ties at the threshold always get through.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; vectors meet only those of their own number of components; with fewer
candidates than k a query gets them all; rows that repeat an id are rows of their own, and a
query leaves out only its own row; equal scores go by id; no vectors give no rows. Components are
expected below 2^31 / SCALE in size (products are then exact in 64 bits).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import written

SCALE = 256
TOP = 5
#: Queries are the rows whose id is divisible by this.
EVERY = 50
#: Lengths in a bucket differ by this factor at most.
RATIO = 1.15
BLOCK, QUERY_BLOCK = 8192, 16384
SEEDS = 2048
FOCUS, COSINE = 4, 0.7
TILE = 128


def quantised(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, v (integers), dim, norm and row (a number of its own) of each vector that takes part."""
    x = F.col(vector)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    rows = table.filter(F.col(vec_id).isNotNull() & x.isNotNull() & sound).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return written(rows.select("*", F.size("v").alias("dim"), F.sqrt(square).alias("norm"), F.monotonically_increasing_id().alias("row")), "vectors")


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(-1, dim)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in integers, by floating point where that is exact."""
    size = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if size < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Positions of the `top` highest scores, ties to the smaller id."""
    if len(scores) > top:
        at_least = np.partition(scores, len(scores) - top)[len(scores) - top]
        near = np.flatnonzero(scores >= at_least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:top]]


class Bucket:
    """A block of candidates sorted by length, longest first."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, norm: np.ndarray, v: np.ndarray) -> None:
        order = np.argsort(-norm, kind="stable")
        self.row, self.vec_id, self.norm, self.v = row[order], vec_id[order], norm[order], v[order]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.unit = np.nan_to_num(self.v / self.norm[:, None]).T.copy()

    def by_coordinates(self, q: np.ndarray, q_norm: float, t: float) -> np.ndarray:
        """Candidates whose direction can be within cosine t of q."""
        direction = q / q_norm
        use = np.ones(len(self.norm), bool)
        slack = 1e-9
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            spread = math.sqrt(max(0.0, (1 - t * t) * (1 - direction[f] ** 2)))
            low = direction[f] * t - spread if direction[f] > -t else -1.0
            high = direction[f] * t + spread if direction[f] < t else 1.0
            use &= (self.unit[f] >= low - slack) & (self.unit[f] <= high + slack)
        return np.flatnonzero(use)

    def search(self, row: np.ndarray, norm: np.ndarray, v: np.ndarray, threshold: np.ndarray, top: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(query's position, positions of its best candidates, scores) of each query that finds any."""
        found = []
        longest = self.norm[0]
        # a threshold of zero or less prunes nothing: anything may reach it
        bound = np.where(threshold > 0, threshold * (1 - 1e-9), -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(norm * longest > 0, bound / (norm * longest), np.where(bound > 0, np.inf, -np.inf))
        plain = []
        for i in np.flatnonzero(cosine <= 1):
            if cosine[i] < COSINE:
                plain.append(i)
                continue
            near = self.by_coordinates(v[i], norm[i], float(cosine[i]))
            near = near[self.row[near] != row[i]]
            if len(near):
                scores = _exact(self.v[near], v[i][:, None])[:, 0]
                best = _best(scores, self.vec_id[near], top)
                found.append((i, near[best], scores[best]))
        plain = np.array(plain, np.int64)
        # queries that reach about as far down the lengths share a tile
        reach = np.full(len(plain), len(self.norm))
        some = np.isfinite(bound[plain]) & (norm[plain] > 0)
        reach[some] = np.searchsorted(-self.norm, -(bound[plain][some] / norm[plain][some]), side="right")
        order = np.argsort(reach, kind="stable")
        for at in range(0, len(order), TILE):
            tile = order[at : at + TILE]
            last = int(reach[tile[-1]])
            if not last:
                continue
            products = _exact(self.v[:last], v[plain[tile]].T)
            for j, k in enumerate(tile):
                i = plain[k]
                near = np.arange(reach[k])
                near = near[self.row[near] != row[i]]
                scores = products[near, j]
                if len(near):
                    best = _best(scores, self.vec_id[near], top)
                    found.append((i, near[best], scores[best]))
        return found


def top_matches(vectors: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score of the best candidates of each query.

    vectors: as quantised() gives them; is_query: a condition on vec_id.
    """
    spark = vectors.sparkSession
    queries = vectors.filter(is_query)
    longest = vectors.orderBy(F.desc("norm"), "row").limit(SEEDS).collect()
    seeds: dict[int, Bucket] = {}
    for dim in {r["dim"] for r in longest}:
        own = [r for r in longest if r["dim"] == dim]
        seeds[dim] = Bucket(np.array([r["row"] for r in own]), np.array([r["vec_id"] for r in own]), np.array([r["norm"] for r in own]), np.array([r["v"] for r in own], np.int64).reshape(len(own), dim))
    # SEEDS rows at most
    shared = spark.sparkContext.broadcast(seeds)

    def thresholds(batches):
        for batch in batches:
            out = np.full(batch.num_rows, np.nan)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in shared.value or not dim:
                    continue
                part = batch.take(pa.array(at))
                no = np.full(len(at), -np.inf)
                for i, _, scores in shared.value[dim].search(part.column("row").to_numpy(), part.column("norm").to_numpy(), _matrix(part.column("v"), dim), no, top):
                    if len(scores) == top:
                        out[at[i]] = scores[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=np.isnan(out))], [*batch.schema.names, "threshold"])

    names = "vec_id long, v array<long>, dim int, norm double, row long"
    aimed = written(queries.select("vec_id", "v", "dim", "norm", "row").mapInArrow(thresholds, f"{names}, threshold double"), "queries")

    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(RATIO))).otherwise(-1_000_000).cast("int")
    bucketed = vectors.withColumn("bucket", bucket)
    # as many rows as there are lengths' magnitudes and numbers of components
    sizes = bucketed.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    n_queries = aimed.count()
    if not sizes or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    query_blocks = -(-n_queries // QUERY_BLOCK)
    blocks = [(r["dim"], r["bucket"], -(-r["n"] // BLOCK), r["longest"]) for r in sizes]
    split = F.create_map(*[F.lit(x) for d, b, n, _ in blocks for x in (f"{d}/{b}", n)])
    n_blocks = split[F.concat_ws("/", "dim", "bucket")]
    spread = bucketed.withColumn("block", F.pmod(F.xxhash64("row"), n_blocks).cast("int")).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    candidates = spread.select("dim", "bucket", "block", "query_block", "row", "vec_id", "norm", "v")

    all_blocks = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(b).alias("bucket"), F.lit(n).alias("blocks"), F.lit(float(longest)).alias("longest")) for d, b, n, longest in blocks])
    can_win = lambda b: (b.d == F.col("dim")) & (F.col("threshold").isNull() | (F.col("threshold") <= 0) | (F.col("norm") * b.longest * (1 + 1e-9) >= F.col("threshold")))
    aimed = aimed.withColumn("query_block", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int"))
    sent = aimed.select("*", F.explode(F.filter(all_blocks, can_win)).alias("to")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("to.blocks") - 1)))
    sent = sent.select(F.col("dim").alias("q_dim"), F.col("to.bucket").alias("q_bucket"), F.col("block").alias("q_block"), F.col("query_block").alias("q_query_block"), "row", "vec_id", "norm", "threshold", "v")

    def search(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        dim = key[0].as_py()
        if own.num_rows and asked.num_rows and dim:
            c = Bucket(own["row"].to_numpy(), own["vec_id"].to_numpy(), own["norm"].to_numpy(), _matrix(own["v"], dim))
            threshold = asked["threshold"].to_numpy()
            threshold = np.where(np.isnan(threshold), -np.inf, threshold)
            row, ids = asked["row"].to_numpy(), asked["vec_id"].to_numpy()
            for i, best, scores in c.search(row, asked["norm"].to_numpy(), _matrix(asked["v"], dim), threshold, top):
                out["query_row"] += [int(row[i])] * len(best)
                out["query_id"] += [int(ids[i])] * len(best)
                out["vec_id"] += c.vec_id[best].tolist()
                out["score"] += scores.tolist()
        return pa.table({k: pa.array(x, pa.int64()) for k, x in out.items()})

    cells = candidates.groupBy("dim", "bucket", "block", "query_block").cogroup(sent.groupBy("q_dim", "q_bucket", "q_block", "q_query_block"))
    found = cells.applyInArrow(search, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_matches(vectors, F.col("vec_id") % EVERY == 0)


QUERIES = {"op8_topk_search": query}

ORACLE_SQL = {
    "op8_topk_search": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """
}
