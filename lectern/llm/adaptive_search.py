"""Approximate nearest neighbours by inner product: inverted lists, scanned dimension by dimension.

Vectors are put on a sphere: x / M with one further component sqrt(1 - |x|^2 / M^2), M the largest
length, and queries q / |q| with 0 there. Distances on it order candidates as inner products do.
A random rotation then spreads each vector's length evenly over the components, so a few of them
tell how long a difference is. Rotated vectors belong to the list of their nearest centre.

A query probes the lists of its nearest centres: as many as hold a share RECALL of the true neighbours of
some of the sample's vectors within the sample, and more until they hold enough candidates. So vectors in
clusters need a few lists, and vectors without any structure about half of them. A list's vectors are kept by column blocks of WIDTH components. After
each block the distance so far, t of D components, is held against the k-th best distance r known:
the candidate is given up if sqrt(D / t) * partial > r * (1 + EPSILON / sqrt(t)), as with that
margin a nearer one has so long a part by a small chance only. Those who come through all blocks
are scored by their original components in double precision.

Centres are fitted on at most SAMPLE vectors of each number of components; every vector is in a
list. Equal vectors are one candidate that carries its TOP + 1 smallest ids, and equal queries are
asked once, so that a common vector makes no group; lists are cut in blocks of BLOCK vectors, the
queries that come to a list in blocks of QUERY_BLOCK.

On the driver: the sample, a centre, a size and a number of queries for each list (MAX_LISTS at
most), and SEEDS vectors, for each number of components.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and
rows without an id, take no part; vectors meet only those of their own number of components;
rows that repeat an id are rows of their own, and a query leaves out only its own row; with fewer
candidates than asked for a query gets them all; equal scores go by id; no vectors give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import written

TOP = 20
#: Queries are the rows whose id is divisible by this.
EVERY = 20
SAMPLE, ROUNDS = 16384, 8
#: Lists: the square root of the number of vectors, by this. Fewer and longer lists make fewer pairs of query and list.
LIST_SHARE, MAX_LISTS = 4, 4096
#: The share of true neighbours whose lists are probed, as TUNED vectors of the sample tell; and lists probed at least.
RECALL, TUNED, LEAST_PROBES = 0.95, 512, 2
WIDTH, EPSILON = 16, 2.1
BLOCK, QUERY_BLOCK = 8192, 16384
SEEDS = 64
#: So many times the rows asked for are measured whole before the others are scanned.
FIRST = 8
TILE = 256

_FOUND = "q_node long, vec_id long, row long, score double"
_NO_ROWS = "query_id long, rank int, vec_id long, score double"


def taking_part(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, e, and row (a number of its own) of each vector that takes part."""
    x = F.col(vector)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kind = table.schema[vector].dataType.elementType.simpleString()
    e = x if kind in ("float", "double") else F.transform(x, lambda c: c.cast("double"))
    rows = table.filter(F.col(vec_id).isNotNull() & x.isNotNull() & sound & F.exists(x, lambda c: c != 0))
    return written(rows.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("e"), F.monotonically_increasing_id().alias("row")), "vectors")


def distinct_vectors(rows: DataFrame, top: int = TOP) -> DataFrame:
    """node, h, e, dim and ids (vec_id and row of the top + 1 rows with the smallest ids) of each different vector. A task sends no more than that of a vector."""
    hashed = rows.withColumn("h", F.xxhash64("e"))
    nth = F.row_number().over(Window.partitionBy("h", "e").orderBy("vec_id", "row"))
    first = hashed.withColumn("_n", nth).filter(F.col("_n") <= top + 1)
    grouped = first.groupBy("h", "e").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("ids"))
    return written(grouped.select(F.monotonically_increasing_id().alias("node"), "h", "e", F.size("e").alias("dim"), "ids"), "nodes")


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


class Model:
    """Where vectors of one number of components lie on the sphere, and the lists' centres."""

    def __init__(self, longest: float, sample: np.ndarray, n: int, recall: float, top: int) -> None:
        dim, rng = sample.shape[1] + 1, np.random.default_rng(7)
        self.longest = longest
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        points = self.placed(sample)
        lists = min(MAX_LISTS, max(1, math.isqrt(n) // LIST_SHARE), len(points))
        self.centres = points[np.sort(rng.choice(len(points), lists, replace=False))]
        for _ in range(ROUNDS):
            own = self.nearest(points)
            order = np.argsort(own, kind="stable")
            there, starts = np.unique(own[order], return_index=True)
            means = np.add.reduceat(points[order], starts, axis=0)
            # a centre without points stays where it is
            self.centres[there] = means / np.maximum(np.linalg.norm(means, axis=1), 1e-300)[:, None]
        self.sizes = np.zeros(lists, np.int64)
        self.n_probes = self._enough_probes(sample, self.nearest(points), recall, top)

    def _enough_probes(self, sample: np.ndarray, own: np.ndarray, recall: float, top: int) -> int:
        """How many lists hold that share of the sample's true neighbours of TUNED of its vectors, best lists first."""
        queries = sample[:TUNED]
        products = queries @ sample.T
        np.fill_diagonal(products, -np.inf)
        near = np.argpartition(-products, min(top, len(sample)) - 1, axis=1)[:, : min(top, len(sample) - 1)]
        if not near.size:
            return len(self.centres)
        order = np.argsort(-(self.aimed(queries) @ self.centres.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        needed = np.sort(np.take_along_axis(place, own[near], axis=1), axis=None)
        return max(LEAST_PROBES, int(needed[math.ceil(len(needed) * recall) - 1]) + 1)

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        """Candidates on the sphere, rotated."""
        inside = vectors / self.longest
        last = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", inside, inside)))
        return np.column_stack([inside, last]) @ self.rotation

    def aimed(self, queries: np.ndarray) -> np.ndarray:
        unit = queries / np.linalg.norm(queries, axis=1)[:, None]
        return np.column_stack([unit, np.zeros(len(unit))]) @ self.rotation

    def nearest(self, points: np.ndarray) -> np.ndarray:
        # centres and points are of length one, so the largest product is the nearest
        return np.concatenate([np.argmax(points[i : i + 4096] @ self.centres.T, axis=1) for i in range(0, len(points), 4096)] or [np.zeros(0, np.int64)])

    def probes(self, points: np.ndarray, enough: int) -> list[np.ndarray]:
        """The lists that each query probes."""
        least = min(len(self.centres), self.n_probes)
        order = np.argsort(-(points @ self.centres.T), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        return [row[: max(least, int(np.searchsorted(full, enough)) + 1)] for row, full in zip(order, held, strict=True)]


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision: equal vectors have equal ones."""
    return (vectors * query).sum(axis=1)


def scan(columns: list[np.ndarray], points: np.ndarray, top: int, radius: np.ndarray) -> list[np.ndarray]:
    """The candidates of a list that come through for each query.

    columns: the list's rotated vectors by column blocks, components in rows; points: rotated
    queries; radius: a squared distance that the k-th best of each query does not exceed.
    """
    dim, n = points.shape[1], columns[0].shape[1]
    out = []
    for at in range(0, len(points), TILE):
        tile = points[at : at + TILE]
        first = columns[0]
        w = len(first)
        head = (first * first).sum(axis=0)[None, :] - 2 * (tile[:, :w] @ first) + (tile[:, :w] ** 2).sum(axis=1)[:, None]
        for q, partial, r in zip(tile, np.maximum(head, 0.0), radius[at : at + TILE], strict=True):
            if n > top:
                # those that look nearest so far bound the k-th best
                near = np.argpartition(partial, min(n, FIRST * (top + 1)) - 1)[: FIRST * (top + 1)]
                whole, t = partial[near], w
                for block in columns[1:]:
                    whole = whole + ((block[:, near] - q[t : t + len(block), None]) ** 2).sum(axis=0)
                    t += len(block)
                r = min(r, float(np.partition(whole, top)[top]) * (1 + 1e-9))
            t, alive, part = w, None, partial
            for block in columns[1:]:
                keep = part * (dim / t) <= r * (1 + EPSILON / math.sqrt(t)) ** 2
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                part = part[keep]
                if not len(alive):
                    break
                part = part + ((block[:, alive] - q[t : t + len(block), None]) ** 2).sum(axis=0)
                t += len(block)
            alive = np.arange(n) if alive is None else alive
            out.append(alive[part <= r])
    return out


def best_rows(vectors: np.ndarray, ids: list[list[dict]], query: np.ndarray, near: np.ndarray, top: int) -> list[tuple[int, int, float]]:
    """(vec_id, row, score) of the top + 1 best rows of the vectors at `near`."""
    found = scores(vectors[near], query)
    order = np.argsort(-found, kind="stable")
    if len(order) > top:
        order = order[found[order] >= found[order[top]]]
    rows = [(-float(found[i]), r["vec_id"], r["row"]) for i in order for r in ids[near[i]]]
    return [(vec_id, row, -score) for score, vec_id, row in sorted(rows)[: top + 1]]


def _by_columns(points: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(points[:, t : t + WIDTH].T) for t in range(0, points.shape[1], WIDTH)]


def nearest_rows(table: DataFrame, is_query: Column, top: int = TOP, vector: str = "embedding", vec_id: str = "vec_id", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the candidates found for each query. is_query: a condition on vec_id."""
    spark = table.sparkSession
    rows = taking_part(table, vector, vec_id)
    nodes = distinct_vectors(rows, top)
    square = F.aggregate("e", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    counts = {r["dim"]: (r["n"], math.sqrt(r["longest"])) for r in nodes.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("longest")).collect()}
    if not counts:
        return spark.createDataFrame([], _NO_ROWS)
    nth = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("h"), "h", "node"))
    # SAMPLE rows for each number of components
    sampled: dict[int, list] = {}
    for r in nodes.withColumn("_n", nth).filter(F.col("_n") <= SAMPLE).orderBy("dim", "_n").select("dim", "node", "e", F.when(F.col("_n") <= SEEDS, F.col("ids")).alias("ids")).toLocalIterator():
        sampled.setdefault(r["dim"], []).append(r)
    models = {dim: Model(longest, np.array([r["e"] for r in sampled[dim]], np.float64), n, recall, top) for dim, (n, longest) in counts.items()}
    seeds = {dim: (np.array([r["e"] for r in own[:SEEDS]], np.float64), [[x.asDict() for x in r["ids"]] for r in own[:SEEDS]]) for dim, own in sampled.items()}
    placing = spark.sparkContext.broadcast(models)

    def place(batches):
        for batch in batches:
            dims, lists = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                at, model = np.flatnonzero(dims == dim), placing.value[dim]
                lists[at] = model.nearest(model.placed(_matrix(batch.column("e").take(pa.array(at)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists)], [*batch.schema.names, "list"])

    kind = nodes.schema["e"].dataType.simpleString()
    listed = written(nodes.select("node", "dim", "e", "ids").mapInArrow(place, f"node long, dim int, e {kind}, ids array<struct<vec_id:long,row:long>>, list int"), "lists")
    sizes = {(r["dim"], r["list"]): (r["n"], r["rows"]) for r in listed.groupBy("dim", "list").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("rows")).collect()}
    for (dim, k), (_, n_rows) in sizes.items():
        models[dim].sizes[k] = n_rows
    aiming = spark.sparkContext.broadcast((models, seeds))

    def aim(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            radius, lists, near = np.full(batch.num_rows, np.inf), [None] * batch.num_rows, [None] * batch.num_rows
            for dim in np.unique(dims).tolist():
                at, (model, (vectors, ids)) = np.flatnonzero(dims == dim), (aiming.value[0][dim], aiming.value[1][dim])
                queries = _matrix(batch.column("e").take(pa.array(at)))
                points = model.aimed(queries)
                for i, q, own in zip(at.tolist(), queries, model.probes(points, top + 1), strict=True):
                    lists[i] = own.tolist()
                    near[i] = [{"vec_id": v, "row": r, "score": s} for v, r, s in best_rows(vectors, ids, q, np.arange(len(vectors)), top)]
                    if len(vectors) > top:
                        # a query's own vector may be among the seeds, so one more than asked for
                        kth = np.partition(scores(vectors, q), -(top + 1))[-(top + 1)]
                        radius[i] = (2 - 2 * kth / (np.linalg.norm(q) * model.longest)) + 1e-9
            more = [pa.array(radius), pa.array(lists, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.struct([("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "radius", "lists", "near"])

    asked = rows.filter(is_query).withColumn("h", F.xxhash64("e"))
    of_query = written(asked.join(nodes.select("h", "e", "node"), ["h", "e"]).select("vec_id", "row", "node"), "queries")
    query_nodes = nodes.select("node", "dim", "e").join(of_query.select("node").distinct(), "node", "left_semi")
    aimed = written(query_nodes.mapInArrow(aim, f"node long, dim int, e {kind}, radius double, lists array<int>, near array<struct<vec_id:long,row:long,score:double>>"), "aimed")
    sent = aimed.select("node", "dim", "e", "radius", F.explode("lists").alias("list"))
    arriving = {(r["dim"], r["list"]): r["n"] for r in sent.groupBy("dim", "list").agg(F.count("*").alias("n")).collect()}
    # a row for each list that is probed
    cells = spark.createDataFrame([(dim, k, -(-n // BLOCK), -(-arriving[dim, k] // QUERY_BLOCK)) for (dim, k), (n, _) in sizes.items() if (dim, k) in arriving] or [(-1, -1, 1, 1)], "dim int, list int, blocks int, query_blocks int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = listed.join(F.broadcast(cells), ["dim", "list"]).withColumn("block", one_of("blocks")).withColumn("query_block", every("query_blocks")).select("dim", "list", "block", "query_block", "e", "ids")
    right = sent.join(F.broadcast(cells), ["dim", "list"]).withColumn("query_block", one_of("query_blocks")).withColumn("block", every("blocks")).select("dim", "list", "block", "query_block", "node", "e", "radius")

    def search(own: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q_node": [], "vec_id": [], "row": [], "score": []}
        if own.num_rows and queries.num_rows:
            model = aiming.value[0][own["dim"][0].as_py()]
            vectors, ids = _matrix(own["e"]), own["ids"].to_pylist()
            asked = _matrix(queries["e"])
            nodes_asked = queries["node"].to_pylist()
            for i, near in enumerate(scan(_by_columns(model.placed(vectors)), model.aimed(asked), top, queries["radius"].to_numpy())):
                for v, r, s in best_rows(vectors, ids, asked[i], near, top):
                    out["q_node"].append(nodes_asked[i])
                    out["vec_id"].append(v)
                    out["row"].append(r)
                    out["score"].append(s)
        return pa.table({k: pa.array(x, pa.float64() if k == "score" else pa.int64()) for k, x in out.items()})

    cell = ["dim", "list", "block", "query_block"]
    scanned = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, _FOUND)
    begun = aimed.select(F.col("node").alias("q_node"), F.explode("near").alias("x")).select("q_node", "x.*")
    order = Window.partitionBy("q_node").orderBy(F.desc("score"), "vec_id", "row")
    # a row may come from the seeds and from its list
    ranked = scanned.unionByName(begun).withColumn("_n", F.dense_rank().over(order)).filter(F.col("_n") <= top + 1)
    best = ranked.groupBy("q_node").agg(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("less"), "vec_id", "row"))).alias("best"))
    mine = of_query.join(best, F.col("node") == F.col("q_node"))
    others = F.slice(F.filter("best", lambda b: b["row"] != F.col("row")), 1, top)
    shown = mine.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("_at", "b"))
    return shown.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op11_adaptive_search": query}
