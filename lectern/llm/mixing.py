"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash of doc_id, are a ring: laid end to end they begin anew
(epoch 1, 2, ...) where the last one ends. Each BLOCK_BYTES along the ring make a block, and a document
belongs to the block in which it begins. A slot of the mixture takes one block, so all slots bring
the same number of bytes, to within a document, and weights hold in bytes however small a source is. With weight w, block j of a source is released at slot floor(j / w) and due by
slot ceil((j + 1) / w); in each slot the released block with the earliest deadline goes. Weights
add up to one, so all deadlines are met, and at every slot each source has had its weight's share
of blocks to within less than one.

Weights are whole numbers of PERIOD slots, so the schedule repeats itself: one period is worked
out on the driver and the slot of any block follows from it. The mixture ends when every source
has been gone through; sources that are short for their weight come again and again until then. No
document is dropped. A weight under one slot of a period is rounded up to it.

Without given weights, a source gets its share of bytes to the power of SMOOTHING, which raises
small sources.

Only one row per source, and the period, are on the driver: as many rows as there are sources, and
PERIOD (or SLOTS_A_SOURCE for each source, if that is more). They are broadcast if they are at
most BROADCAST_ROWS, and joined like other tables beyond that.

Defined cases: a null source is a source of its own; a null or empty text takes no bytes and goes
with the documents around it; a source without any bytes comes once, in its first slot; equal rows and rows that repeat a doc_id take part one by one; rows
without doc_id too; a source without a given weight, or with weight 0 or less, gets the least
weight, one slot a period; given weights of sources without documents are left out; no documents
give no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import documents, identified, ranked, written

BLOCK_BYTES = 1 << 16
PERIOD, SLOTS_A_SOURCE = 4096, 8
SMOOTHING = 0.7
BROADCAST_ROWS = 1 << 17
#: Epochs of a document that are made rows by one task.
EPOCHS_A_ROW = 1024
#: Slots to a part of the written mixture: about 16 MB of texts.
PART_SLOTS = 256


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots of a period for each source: at least one, in proportion to the weights by largest remainders, `period` in all."""
    names = sorted(weights)
    positive = {k: max(0.0, weights[k]) for k in names}
    total = sum(positive.values())
    if not total:
        positive, total = dict.fromkeys(names, 1.0), float(len(names))
    spare = period - len(names)
    exact = {k: positive[k] / total * period for k in names}
    over = sum(max(0.0, exact[k] - 1) for k in names) or 1.0
    extra = {k: max(0.0, exact[k] - 1) / over * spare for k in names}
    slots = {k: 1 + int(extra[k]) for k in names}
    left = period - sum(slots.values())
    by_rest = sorted(names, key=lambda k: (int(extra[k]) - extra[k], k))
    for i in range(left):
        slots[by_rest[i % len(by_rest)]] += 1
    return slots


def window(j: int, share: int, period: int) -> tuple[int, int]:
    """(release, deadline) of a source's block j."""
    return j * period // share, -(-(j + 1) * period // share)


def schedule(slots: dict[str, int]) -> list[str]:
    """The source of each slot of a period: of the released blocks the one with the earliest deadline, ties by name."""
    period = sum(slots.values())
    released: list[list[tuple[int, str, int]]] = [[] for _ in range(period + 1)]
    for name, share in slots.items():
        released[0].append((window(0, share, period)[1], name, 0))
    ready: list[tuple[int, str, int]] = []
    order = []
    for slot in range(period):
        for block in released[slot]:
            heapq.heappush(ready, block)
        _, name, j = heapq.heappop(ready)
        order.append(name)
        if j + 1 < slots[name]:
            release, deadline = window(j + 1, slots[name], period)
            if release <= slot + 1:
                released[slot + 1].append((deadline, name, j + 1))
            else:
                released[release].append((deadline, name, j + 1))
    return order


def _key(source: str):
    """The source as text, the empty text for none."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def mixed(rows: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """_at, _key, _from (place in the source), _along (place along the ring), block (along the ring), epoch, slot, release and deadline for each time a document is in the mixture.

    rows: _at (a number of its own), _key (see _key), _id, _size (bytes) of each document.
    """
    spark = rows.sparkSession
    totals = {r["_key"]: (r["size"], r["n"]) for r in rows.groupBy("_key").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()}
    if not totals:
        return rows.select("_at", "_key", *[F.lit(0).cast("long").alias(c) for c in ("_from", "_along", "block", "epoch", "slot", "release", "deadline")]).limit(0)
    period = max(PERIOD, SLOTS_A_SOURCE * len(totals))
    if weights is None:
        wanted = {k: float(max(size, 1)) ** SMOOTHING for k, (size, _) in totals.items()}
    else:
        given = {"" if k is None else f"={k}": w for k, w in weights.items()}
        wanted = {k: given.get(k, 0.0) for k in totals}
    slots = shares(wanted, period)
    order = schedule(slots)
    places: dict[str, list[int]] = {k: [] for k in slots}
    for slot, name in enumerate(order):
        places[name].append(slot)
    # a text without bytes may come after the last full block
    blocks = {k: size // block_bytes + 1 for k, (size, _) in totals.items()}
    last = max((n - 1) // slots[k] * period + places[k][(n - 1) % slots[k]] for k, n in blocks.items())
    whole, part = divmod(last + 1, period)
    turns = {k: whole * slots[k] + sum(p < part for p in places[k]) for k in slots}
    # one row per source, and one per slot of the period
    plan = spark.createDataFrame([(k, slots[k], totals[k][0], turns[k]) for k in slots], "_key string, share long, _ring long, turns long")
    period_rows = spark.createDataFrame([(k, i, slot) for k, own in places.items() for i, slot in enumerate(own)], "_key string, _nth long, _place long")

    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    n_docs = sum(n for _, n in totals.values())
    hashed = rows.withColumn("_hash", F.xxhash64("_id"))
    placed = ranked(hashed, ["_key"], F.pmod("_hash", F.lit(max(1, int(n_docs**0.5)))), [F.col("_hash"), F.col("_id"), F.col("_at")], "_from", F.col("_size"))
    of_source = placed.join(small(plan, len(slots)), "_key")
    # the last epoch in which a document begins before the source's last block ends
    times = F.when(F.col("_ring") > 0, F.expr(f"(turns * {block_bytes} - 1 - _from) div _ring")).otherwise(0)
    counted = of_source.withColumn("_times", F.greatest(times, F.lit(0).cast("long")))
    # a tiny source comes very often: its epochs are dealt out before they are made rows
    if any(turns[k] * block_bytes // size >= EPOCHS_A_ROW for k, (size, _) in totals.items() if size):
        counted = counted.withColumn("_some", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_times div {EPOCHS_A_ROW}")))).repartition("_at", "_some")
        first = F.col("_some") * EPOCHS_A_ROW
        epochs = F.sequence(first, F.least(F.col("_times"), first + EPOCHS_A_ROW - 1))
    else:
        epochs = F.sequence(F.lit(0).cast("long"), F.col("_times"))
    each = counted.withColumn("epoch", F.explode(epochs))
    along = each.withColumn("_along", F.col("_from") + F.col("epoch") * F.col("_ring"))
    numbered = along.withColumn("_turn", F.expr(f"_along div {block_bytes}")).withColumn("_nth", F.expr("_turn % share"))
    release, deadline = F.expr(f"_turn * {period} div share"), F.expr(f"((_turn + 1) * {period} + share - 1) div share")
    found = numbered.join(small(period_rows, period), ["_key", "_nth"]).withColumn("slot", F.expr(f"_turn div share * {period} + _place"))
    return found.select("_at", "_key", "_from", "_along", F.col("_turn").alias("block"), "epoch", "slot", release.alias("release"), deadline.alias("deadline"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each document is in the mixture: slot, and place in its block."""
    docs = documents(spark, sf_dir)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_size")
    rows = written(docs.select(F.monotonically_increasing_id().alias("_at"), _key("source").alias("_key"), F.col("doc_id").cast("long").alias("_id"), "source", size), "mixing")
    found = mixed(rows.drop("source"))
    own = rows.select(F.col("_at").alias("_of"), F.col("_id").alias("doc_id"), "source", F.col("_size").alias("n_bytes"))
    joined = found.join(own, F.col("_at") == F.col("_of"))
    return joined.select("doc_id", "source", "n_bytes", F.col("_from").alias("source_offset"), "block", "epoch", "slot", "release", "deadline")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document for each of its turns, in the order of slots, then of places in the source.

    Parts hold PART_SLOTS slots each, one part after the other, so the files of the written table
    by name, and the rows in them, are in that order. Slots take a block each, so parts are about
    equal in bytes and need no sampling of the texts.
    """
    rows = identified(docs)
    size = F.coalesce(F.octet_length("_row.text"), F.lit(0)).cast("long").alias("_size")
    narrow = written(rows.select("_at", _key("_row.source").alias("_key"), F.col("_row.doc_id").cast("long").alias("_id"), size), "mixing")
    turns = written(mixed(narrow).select("_at", F.col("slot").alias("_slot"), "_along"), "mixing-turns")
    last = turns.agg(F.max("_slot")).first()[0] or 0
    dealt = rows.join(turns, "_at").repartitionById(last // PART_SLOTS + 1, F.expr(f"cast(_slot div {PART_SLOTS} as int)"))
    return dealt.sortWithinPartitions("_slot", "_along", "_at").select("_row.*")


QUERIES = {"op9_mixing": query}
