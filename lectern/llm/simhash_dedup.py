"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64 hashes
(seed 42) of the document's word shingles. Fingerprints link at RADIUS or fewer differing bits.

Candidates come from 2^(RADIUS + 1) - 1 tables. Bit i carries a non-zero vector m(i) of
RADIUS + 1 bits, and table v keeps the bits whose m(i) has odd overlap with v. The vectors of
any RADIUS bits leave some v orthogonal to all of them, so two fingerprints within the radius
agree on all that some table keeps: no pair is missed, whatever the bits are.

Fingerprints that share a table's key are not paired with each other, as a key may be shared by
any number of them. They can only differ in the bits that the table drops, so each emits itself
and itself with any one of those bits flipped (RADIUS 2: two fingerprints within two bits share
at least one of these, and fingerprints that share one are within two bits). All who emit the
same are linked to the smallest: as many rows as fingerprints, times a constant.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a text
with fewer words than a shingle has its whole word sequence as its only shingle; equal
fingerprints are one node, so copies cost nothing and rows that repeat a doc_id share its
component; documents without doc_id link like others, and get null if no document that theirs
is linked to has a doc_id; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import near_copies
from lectern.llm import words as W
from lectern.llm.common import cut, documents, identified, written
from lectern.llm.components import components

SHINGLE = 3
BITS = 64
RADIUS = 2
SEED = 42


def table_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """For each table, the mask of the bits that it keeps."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes (none: zero)."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = (ends - 1)[size - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def _prints(texts: pa.Array, size: int = SHINGLE) -> pa.Array:
    """Fingerprints as signed 64-bit integers."""
    lowered = pc.ascii_lower(texts).cast(pa.large_binary())
    return pa.array(np.fromiter((fingerprint(shingle_hashes(x.as_py().split(), size)) for x in lowered), np.uint64, len(lowered)).view(np.int64))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = SHINGLE) -> DataFrame:
    """The columns in keep and fp, the fingerprint as a signed 64-bit integer."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _prints(W.texts(batch.column(len(keep))), size)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], [*keep, "fp"])

    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def near_links(nodes: DataFrame, fp: str = "fp", rep: str = "rep") -> DataFrame:
    """Links (a, b) between the reps of different fingerprints that connect whatever is within the radius.

    nodes: one row per distinct fingerprint.
    """
    masks = table_masks()
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.explode(F.array(*[F.struct(F.lit(v).alias("table"), F.col(fp).bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(signed)]))
    keyed = nodes.select(fp, rep, tables.alias("t")).select(fp, rep, "t.table", "t.key")
    shared = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    meeting = keyed.join(shared, ["table", "key"])
    flips = [[(1 << i) - (1 << 64 if i == 63 else 0) for i in range(BITS) if not masks[v] >> i & 1] for v in range(len(masks))]
    of_table = F.create_map(*[x for v, bits in enumerate(flips) for x in (F.lit(v), F.array(F.lit(0).cast("long"), *[F.lit(b).cast("long") for b in bits]))])
    emitted = meeting.select("table", fp, rep, F.explode(of_table[F.col("table")]).alias("flip"))
    emitted = emitted.select("table", F.col(fp).bitwiseXOR(F.col("flip")).alias("met"), rep)
    least = emitted.groupBy("table", "met").agg(F.min(rep).alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return emitted.join(least, ["table", "met"]).select(F.col(rep).alias("a"), "b").filter("a > b").distinct()


def clusters(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns in keep, fp and component_id: the smallest doc_id that the document is linked to, itself included."""
    marked = docs.withColumn("_id", F.col(doc_id).cast("long"))
    printed = written(fingerprints(marked, (*keep, "_id"), text), "simhash")
    return printed.join(group_ids(printed), "fp", "left").drop("_id")


def group_ids(printed: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of printed (fp, _id)."""
    nodes = cut(printed.groupBy("fp").agg(F.min("_id").alias("rep")))
    # fingerprints are the graph's nodes, so those of documents without doc_id link like others
    found = components(near_links(nodes.select("fp", F.col("fp").alias("rep"))))
    linked = found.join(nodes, F.col("node") == F.col("fp")).select("node", "component", "rep")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    named = linked.join(least, "component").select("node", "least")
    return nodes.join(named, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("least", "rep").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _groups(printed: DataFrame, near: DataFrame) -> DataFrame:
    """(node, component) of the near copies' nodes whose group is not the node itself, by links of both kinds.

    printed: node, fp; near: the links (a, b) of near copies.
    """
    both = printed.select("node", "fp").distinct()
    # a fingerprint is known by one of its nodes, to which the others are linked
    reps = cut(both.groupBy("fp").agg(F.min("node").alias("rep")))
    equal = both.join(reps, "fp").filter("node > rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return components(near.unionByName(equal).unionByName(near_links(reps))).filter("node <> component")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays: the first by doc_id, then text; those without doc_id come last.

    Documents are linked if their fingerprints differ in RADIUS bits or fewer, as in the query, or if
    they are near copies (see near_copies), which most of 0.8 similarity are only there.
    """
    rows = identified(docs)
    own = rows.select("_at", F.col("_row.doc_id").cast("long").alias("_id"), F.xxhash64("_row.text").alias("_hash"), F.col("_row.text").alias("_text"))
    printed = written(near_copies.sketches(own, ("_at", "_id", "_hash"), "_text", {"fp": _prints}), "near-sketches")
    joined = _groups(printed, near_copies.links(printed, rows.select("_at", "_row.text")))
    grouped = printed.join(joined, "node", "left")
    first = grouped.groupBy(F.coalesce("component", "node").alias("_group")).agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_hash", "_at")).alias("_first"))
    return rows.join(first.select("_first._at"), "_at", "left_semi").select("_row.*")


QUERIES = {"op2_simhash_dedup": query}
