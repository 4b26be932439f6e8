"""The index on disk: runs of ordered posting blocks and a log of commits.

A folder holds, for each run (an indexing of books, a merge) under its own random name:

    chapters/run=…   doc_no, zone, book_id, chapter_index: the run's chapters in order of their keys
    postings/run=…   part, token, span, zones, ends, firsts, lasts, gaps: a token's blocks of a span's zones
    books/run=…      book_id, generation, fingerprint, chapters, tokenizer_version, partial
    log/             commits (operators/commits.py): the runs that count, in order

A zone is ZONE chapters one after the other; a block has the places of a token in a zone, the first
place and the gaps between them, so blocks of several tokens meet by zone alone and are in the
order of (book_id, chapter_index). A span is as many whole zones as ZONE chapters hold, one at least: a
row has a token's blocks of a span one after the other, so smaller zones do not make more rows. Rows are
kept by a hash of the token and sorted by token and span: a query reads the rows of its tokens, and of
the spans it comes to, and cuts blocks from them.

A run counts once its commit is there, whatever failed before, and a failed run's name is never
used again. The last run that has a book holds for the book (a run of a stream, `partial`: for
the chapters that it has). merge() makes one run of all, vacuum() removes what no commit names.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import commits, library, search
from lectern.operators.shared import once

#: Chapters to a zone; spans to a file.
ZONE, SPANS_A_FILE = 4096, 1024
#: Files are kept apart by this many values of a token's hash.
PARTS = 64
#: Bytes of text that are split into tokens together, and rows of blocks that are handed on together.
PART_BYTES, BATCH_BLOCKS = 4 << 20, 1 << 16
TOKENIZER_VERSION = 1
UNKNOWN_FINGERPRINT = "unknown"
#: Zones that a search with a limit looks at first; each further time so many times as many.
FIRST_ZONES, GROWTH, MOST_ZONES = 2, 4, 1024

#: Bytes of letters and digits in lower case, a space for all others.
_LOWERED = bytes(x if chr(x) in "abcdefghijklmnopqrstuvwxyz0123456789" else x + 32 if 65 <= x <= 90 else 32 for x in range(256))

_CHAPTERS = "doc_no long, zone int, book_id string, chapter_index long"
_POSTINGS = "token string, span int, zones array<int>, ends array<int>, firsts array<int>, lasts array<int>, gaps array<smallint>"
_BOOKS = "book_id string, generation long, fingerprint string, chapters long, tokenizer_version int, partial boolean"


def _part(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(PARTS)).cast("int")


def _runs(spark: SparkSession, path: str) -> list[dict]:
    """The runs that count, in the order in which they were committed: id, version, partial, zone, span."""
    return commits.last(spark, f"{path}/log")[1].get("runs", [])


def _table(spark: SparkSession, path: str, name: str, schema: str, runs: list[dict]) -> DataFrame:
    """A table of these runs with `run` and `turn`, the run's place among those that count."""
    if not runs:
        return spark.createDataFrame([], f"{schema}, run string, turn int")
    rows = spark.read.schema(f"{schema}, run string").option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/run={r['id']}" for r in runs])
    turn = F.create_map(*[F.lit(x) for r in runs for x in (r["id"], r["turn"])])
    return rows.withColumn("turn", turn[F.col("run")])


def _span(zone: int) -> int:
    """Chapters of a span."""
    return zone * max(1, ZONE // zone)


def _rows_of_blocks(spark: SparkSession, path: str, runs: list[dict]) -> DataFrame:
    """part, and what postings, run and turn hold, of those of these runs that have chapters."""
    real = [r for r in runs if "drop" not in r]
    if any("span" not in r for r in real):
        raise ValueError(f"{path} has runs whose blocks are not kept by spans; index their books again")
    return _table(spark, path, "postings", f"{_POSTINGS}, part int", real)


def _cut(rows: DataFrame) -> DataFrame:
    """A row for each block of rows of blocks: token, zone, n, first, last and gaps beside the columns that are no lists."""
    lists = ("zones", "ends", "firsts", "lasts", "gaps")
    each = rows.select("*", F.posexplode("zones").alias("_at", "zone"))
    begin = F.coalesce(F.get("ends", F.col("_at") - 1), F.lit(0))
    n = F.get("ends", F.col("_at")) - begin
    return each.select(*[c for c in rows.columns if c not in lists], "zone", n.alias("n"), F.get("firsts", F.col("_at")).alias("first"), F.get("lasts", F.col("_at")).alias("last"), F.slice("gaps", begin + 1, n).alias("gaps"))


def _turned(runs: list[dict]) -> list[dict]:
    return [r | {"turn": i} for i, r in enumerate(runs)]


# Writing


def _numbered_keys(keys: DataFrame) -> DataFrame:
    """keys with doc_no, their place in the order of (book_id, chapter_index): what lies before in the partition and in the partitions before it."""
    order = ["book_id", "chapter_index"]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = once(dealt.select("*", F.spark_partition_id().alias("_shard"), F.monotonically_increasing_id().alias("_at")))
    # a row for each partition
    shards = placed.groupBy("_shard").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("_shard", (before - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(starts), "_shard").select(*keys.columns, (F.col("_at") + F.col("_shift")).alias("doc_no"))


def _packed(parts: DataFrame, zone: int) -> DataFrame:
    """Rows of blocks of rows (token, span, places in the span), of which a token and span may have several."""
    own = parts.groupBy("span", "token").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    at, base = lambda i: F.get("places", i), lambda x: x - x % zone
    begins = F.filter("places", lambda x, i: ~base(at(i - 1)).eqNullSafe(base(x)))
    closes = F.filter("places", lambda x, i: ~base(at(i + 1)).eqNullSafe(base(x)))
    ends = F.filter(F.sequence(F.lit(1), F.size("places")), lambda k: ~base(at(k)).eqNullSafe(base(at(k - 1))))
    gaps = F.transform("places", lambda x, i: (x - F.when(base(at(i - 1)) == base(x), at(i - 1)).otherwise(base(x))).cast("smallint"))
    zones = F.transform(begins, lambda x: (F.col("span") * (_span(zone) // zone) + base(x) / zone).cast("int"))
    return own.select("token", "span", zones.alias("zones"), ends.alias("ends"), F.transform(begins, lambda x: x % zone).alias("firsts"), F.transform(closes, lambda x: x % zone).alias("lasts"), gaps.alias("gaps"))


def _each_once(keys: np.ndarray) -> np.ndarray:
    """These numbers, not negative, in order and each once."""
    keys.sort()
    return keys[np.diff(keys, prepend=-1) != 0]


def _distinct_tokens(texts: pa.Array, places: np.ndarray, span: int) -> tuple[pa.Array, np.ndarray]:
    """(distinct tokens, tokens' numbers * span + places, each once) of texts, as X.tokens has them."""
    bare = pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], pa.py_buffer((texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes().translate(_LOWERED))], offset=texts.offset)
    lists = pc.ascii_split_whitespace(bare)
    offsets = lists.offsets.to_numpy()
    words, of = lists.flatten(), np.repeat(places, np.diff(offsets))
    han = np.flatnonzero(pc.match_substring_regex(texts, f"[{X.HAN}]").to_numpy(zero_copy_only=False))
    if len(han):
        runs = re.compile(f"[{X.HAN}]+")
        own = [sorted({r[i : i + 2] for r in runs.findall(texts[int(t)].as_py()) for i in range(max(1, len(r) - 1))}) for t in han]
        words = pa.concat_arrays([words, pa.array([w for ws in own for w in ws], words.type)])
        of = np.concatenate([of, np.repeat(places[han], [len(ws) for ws in own])])
    coded = words.dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    full = np.asarray(pc.not_equal(distinct, ""))[codes] if len(codes) else np.zeros(0, bool)
    return distinct, _each_once(codes[full] * span + of[full])


def _span_rows(number: int, parts: list[tuple[pa.Array, np.ndarray]], zone: int) -> Iterator[pa.RecordBatch]:
    """The rows of blocks of a span's parts (see _distinct_tokens)."""
    span = _span(zone)
    coded = pa.concat_arrays([tokens for tokens, _ in parts]).dictionary_encode()
    codes, starts = coded.indices.to_numpy().astype(np.int64), np.cumsum([0, *[len(tokens) for tokens, _ in parts]])
    keys = _each_once(np.concatenate([codes[start + own // span] * span + own % span for start, (_, own) in zip(starts, parts, strict=False)]))
    token, place = keys // span, keys % zone
    # where tokens begin among keys, where blocks do, and where tokens do among blocks
    rows, begins = np.flatnonzero(np.diff(token, prepend=-1)), np.flatnonzero(np.diff(keys // zone, prepend=-1))
    tokens, closes = token[rows], np.append(begins[1:], len(keys)) - 1
    gaps = np.diff(place, prepend=0)
    gaps[begins] = place[begins]
    zones, firsts, lasts = number * (span // zone) + keys[begins] % span // zone, place[begins], place[closes]
    blocks, rows = np.append(np.searchsorted(begins, rows), len(begins)), np.append(rows, len(keys))
    ends = closes + 1 - np.repeat(rows[:-1], np.diff(blocks))
    lists = lambda values, at, kind: pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(values[at[0] : at[-1]].astype(kind)))
    for begin in range(0, len(tokens), BATCH_BLOCKS):
        own = slice(begin, begin + BATCH_BLOCKS + 1)
        heads = [lists(x, blocks[own], np.int32) for x in (zones, ends, firsts, lasts)]
        names = coded.dictionary.take(pa.array(tokens[begin : begin + BATCH_BLOCKS])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), number, np.int32)), *heads, lists(gaps, rows[own], np.int16)], ["token", "span", "zones", "ends", "firsts", "lasts", "gaps"])


def _packed_of_texts(held: DataFrame, zone: int) -> DataFrame:
    """Rows of blocks of rows (span, place in the span, text): a span's rows come together and in parts, of which the tokens are kept and not the texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            spans, places = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            texts = pc.fill_null(batch.column(2).cast(pa.large_string()), "")
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            # cut where a span begins, and where a part has its bytes
            cuts = np.flatnonzero((np.diff(spans, prepend=spans[0] if len(spans) else 0) != 0) | (np.diff(size // PART_BYTES, prepend=0) != 0))
            for a, b in zip([0, *cuts], [*cuts, len(spans)], strict=True):
                if a == b:
                    continue
                if now is not None and spans[a] != now:
                    yield from _span_rows(now, parts, zone)
                    parts = []
                now = int(spans[a])
                # a copy of its own, as a slice's buffers are those of the whole
                parts.append(_distinct_tokens(pa.concat_arrays([texts.slice(a, b - a).take(pa.array(np.arange(b - a)))]), places[a:b], _span(zone)))
        if parts:
            yield from _span_rows(now, parts, zone)

    return held.repartition("span").sortWithinPartitions("span").select("span", "place", "text").mapInArrow(make, _POSTINGS)


def _blocks_of_texts(held: DataFrame, zone: int) -> DataFrame:
    """Blocks of rows (zone, place, text)."""
    within = _span(zone) // zone
    spans = held.select(F.expr(f"cast(zone div {within} as int)").alias("span"), (F.col("zone") % within * zone + F.col("place")).alias("place"), "text")
    return _cut(_packed_of_texts(spans, zone)).drop("span")


def _write_blocks(rows: DataFrame, path: str, run: str) -> None:
    parted = rows.withColumn("part", _part(F.col("token")))
    parted.repartition("part", F.expr(f"span div {SPANS_A_FILE}")).sortWithinPartitions("part", "token", "span").write.partitionBy("part").parquet(f"{path}/postings/run={run}")


def _write_chapters(keys: DataFrame, path: str, run: str, zone: int) -> DataFrame:
    numbered = _numbered_keys(keys).withColumn("zone", F.expr(f"cast(doc_no div {zone} as int)"))
    numbered.sortWithinPartitions("doc_no").write.parquet(f"{path}/chapters/run={run}")
    return keys.sparkSession.read.schema(numbered.schema).parquet(f"{path}/chapters/run={run}")


def write_run(chapters: DataFrame, path: str, fingerprints: DataFrame | None = None, partial: bool = False, zone: int = ZONE) -> dict | None:
    """Writes what an indexing of chapters adds; it counts once it is committed. None if there are no chapters.

    Rows that repeat a chapter are one chapter with the tokens of all.
    """
    spark, run = chapters.sparkSession, uuid.uuid4().hex
    own = chapters.select(F.col("book_id").cast("string").alias("book_id"), F.col("chapter_index").cast("long").alias("chapter_index"), "text")
    keys = _write_chapters(own.select("book_id", "chapter_index").distinct(), path, run, zone)
    counted = keys.groupBy("book_id").agg(F.count("*").alias("chapters"))
    known = counted.withColumn("fingerprint", F.lit(None).cast("string")) if fingerprints is None else counted.join(fingerprints.select(F.col("book_id").cast("string").alias("book_id"), "fingerprint"), "book_id", "left")
    rows = known.select("book_id", F.lit(None).cast("long").alias("generation"), F.coalesce("fingerprint", F.lit(UNKNOWN_FINGERPRINT)).alias("fingerprint"), "chapters", F.lit(TOKENIZER_VERSION).alias("tokenizer_version"), F.lit(partial).alias("partial"))
    rows.write.parquet(f"{path}/books/run={run}")
    if keys.isEmpty():
        return None
    span = _span(zone)
    held = own.join(keys, ["book_id", "chapter_index"]).select(F.expr(f"cast(doc_no div {span} as int)").alias("span"), F.expr(f"cast(doc_no % {span} as int)").alias("place"), "text")
    _write_blocks(_packed_of_texts(held, zone), path, run)
    return {"id": run, "partial": partial, "zone": zone, "span": span}


def index_books(chapters: DataFrame, path: str, fingerprints: DataFrame | None = None, zone: int = ZONE) -> None:
    """Indexes whole books, in place of what the index has of them. Books without chapters are not there, so nothing of them changes.

    fingerprints: book_id, fingerprint of the books' files.
    """
    run = write_run(chapters, path, fingerprints, zone=zone)
    if run:
        commits.change(chapters.sparkSession, f"{path}/log", lambda state, number: state | {"runs": [*state.get("runs", []), run | {"version": number}]})


def index_batch(chapters: DataFrame, path: str, stream: str, batch: int) -> None:
    """Indexes the chapters of a stream's batch, each in place of the one before it; a batch that has been committed is passed over."""
    spark = chapters.sparkSession
    if commits.last(spark, f"{path}/log")[1].get("streams", {}).get(stream, -1) >= batch:
        return
    run = write_run(chapters, path, partial=True)

    def add(state: dict, number: int) -> dict:
        done = state.get("streams", {})
        if done.get(stream, -1) >= batch:
            raise commits.Conflict(f"batch {batch} of {stream} has been committed by another writer")
        return state | {"runs": [*state.get("runs", []), *([run | {"version": number}] if run else [])], "streams": done | {stream: batch}}

    commits.change(spark, f"{path}/log", add)


def write_drop(gone: DataFrame, path: str) -> dict:
    """A run that says of books (book_id) that they are dropped; those that are not in the index are passed over."""
    run = uuid.uuid4().hex
    there = indexed_books(gone.sparkSession, path).join(gone.select(F.col("book_id").cast("string").alias("book_id")).distinct(), "book_id", "left_semi")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("generation", "long"), ("fingerprint", "string"), ("chapters", "long"))]
    there.select("book_id", *none, F.lit(TOKENIZER_VERSION).alias("tokenizer_version"), F.lit(False).alias("partial")).write.parquet(f"{path}/books/run={run}")
    return {"id": run, "partial": False, "drop": True}


def drop_books(gone: DataFrame, path: str) -> None:
    """Takes books (book_id) out of the index."""
    run = write_drop(gone, path)
    commits.change(gone.sparkSession, f"{path}/log", lambda state, number: state | {"runs": [*state.get("runs", []), run | {"version": number}]})


def index_on_demand(chapters: DataFrame, fingerprints: DataFrame, path: str) -> None:
    """Indexes the books (with fingerprints) that the index lacks, or has of another file or tokenizer."""
    spark = chapters.sparkSession
    wanted = fingerprints.select(F.col("book_id").cast("string").alias("book_id"), "fingerprint")
    missing = library.pending(wanted, indexed_books(spark, path), TOKENIZER_VERSION)
    if not missing.isEmpty():
        index_books(chapters.withColumn("book_id", F.col("book_id").cast("string")).join(missing.select("book_id"), "book_id", "left_semi"), path, wanted)


# State


def _states(spark: SparkSession, path: str, runs: list[dict]) -> DataFrame:
    """book_id, turn, and what the books table says, of the last run that has each book whole (or dropped)."""
    rows = _table(spark, path, "books", _BOOKS, runs).filter("not partial")
    version = F.create_map(*[F.lit(x) for r in runs for x in (r["id"], r["version"])]) if runs else F.lit(None)
    dated = rows.withColumn("generation", F.coalesce("generation", version[F.col("run")].cast("long") if runs else F.lit(0))).drop("run", "partial")
    return library.latest(dated, ["book_id"], ["turn"])


def _in_turn(rows: DataFrame, spark: SparkSession, path: str, runs: list[dict]) -> DataFrame:
    """The rows (book_id, chapter_index, turn) that hold: of the last run that has the book, or the chapter."""
    last = _states(spark, path, runs).select("book_id", F.col("turn").alias("_last"))
    kept = rows.join(last, "book_id", "left").filter("_last is null or turn >= _last").drop("_last")
    partial = [r for r in runs if r["partial"]]
    if not partial:
        return kept
    later = _table(spark, path, "chapters", _CHAPTERS, partial).groupBy("book_id", "chapter_index").agg(F.max("turn").alias("_later"))
    return kept.join(later, ["book_id", "chapter_index"], "left").filter("_later is null or turn >= _later").drop("_later")


def live_chapters(spark: SparkSession, path: str) -> DataFrame:
    """book_id, chapter_index, run, turn, zone and doc_no of every chapter in the index."""
    runs = _turned(_runs(spark, path))
    return _in_turn(_table(spark, path, "chapters", _CHAPTERS, [r for r in runs if "drop" not in r]), spark, path, runs)


def indexed_books(spark: SparkSession, path: str) -> DataFrame:
    """The index state of each book in the index: book_id, generation (the commit that indexed it last as a whole, or first), fingerprint, chapters, tokenizer_version."""
    runs = _turned(_runs(spark, path))
    whole = _states(spark, path, runs).filter("chapters is not null").drop("turn")
    if not any(r["partial"] for r in runs):
        return whole
    version = F.create_map(*[F.lit(x) for r in runs for x in (r["id"], r["version"])])
    counted = live_chapters(spark, path).groupBy("book_id").agg(F.count("*").alias("_chapters"), F.min(version[F.col("run")]).cast("long").alias("_generation"))
    joined = counted.join(whole, "book_id", "left")
    return joined.select("book_id", F.coalesce("generation", "_generation").alias("generation"), F.coalesce("fingerprint", F.lit(UNKNOWN_FINGERPRINT)).alias("fingerprint"), F.col("_chapters").alias("chapters"), F.coalesce("tokenizer_version", F.lit(TOKENIZER_VERSION)).alias("tokenizer_version"))


# Upkeep


def _moved(old: pa.Table, blocks: pa.Table, span: int) -> pa.Table:
    """(token, span, places) of a zone's blocks, by the new numbers of its chapters; a row for each new span of a token."""
    to = np.full(1 << 16, -1, np.int64)
    to[old["place"].to_numpy()] = old["new_no"].to_numpy()
    lists = blocks["gaps"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    gaps = lists.flatten().to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    run = np.cumsum(gaps)
    # places start anew with each block
    run -= np.repeat(np.concatenate([[0], run[ends[:-1] - 1]]) if len(ends) else np.zeros(0, np.int64), sizes)
    new = to[run]
    held = new >= 0
    token, new = np.repeat(np.arange(len(sizes)), sizes)[held], new[held]
    order = np.lexsort((new, token))
    token, new = token[order], new[order]
    of = new // span
    begins = np.flatnonzero((np.diff(token, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    places = pa.ListArray.from_arrays(pa.array(np.append(begins, len(new)), pa.int32()), pa.array((new % span).astype(np.int32)))
    return pa.table({"token": blocks["token"].combine_chunks().take(pa.array(token[begins])), "span": pa.array(of[begins].astype(np.int32)), "places": places})


def merge(spark: SparkSession, path: str, zone: int = ZONE) -> None:
    """Makes one run of all that count now; runs that are committed meanwhile come after it. Conflict if another merge was faster."""
    runs = _turned(_runs(spark, path))
    if len(runs) < 2:
        return
    run = uuid.uuid4().hex
    live = once(live_chapters(spark, path).select("book_id", "chapter_index", F.col("run").alias("_run"), F.col("zone").alias("_zone"), F.col("doc_no").alias("_no")))
    numbered = once(_numbered_keys(live).withColumn("zone", F.expr(f"cast(doc_no div {zone} as int)")))
    numbered.select("doc_no", "zone", "book_id", "chapter_index").sortWithinPartitions("doc_no").write.parquet(f"{path}/chapters/run={run}")
    old_zone = F.create_map(*[F.lit(x) for r in runs for x in (r["id"], r.get("zone", ZONE))])
    places = numbered.select("_run", "_zone", (F.col("_no") % old_zone[F.col("_run")]).cast("int").alias("place"), F.col("doc_no").alias("new_no"))
    blocks, span = _cut(_rows_of_blocks(spark, path, runs)).select("run", "zone", "token", "gaps"), _span(zone)
    moved = places.groupBy("_run", "_zone").cogroup(blocks.groupBy("run", "zone")).applyInArrow(lambda old, own: _moved(old, own, span), "token string, span int, places array<int>")
    _write_blocks(_packed(moved, zone), path, run)
    indexed_books(spark, path).withColumn("partial", F.lit(False)).write.parquet(f"{path}/books/run={run}")
    merged = {r["id"] for r in runs}

    def put(state: dict, number: int) -> dict:
        now = state.get("runs", [])
        if not merged <= {r["id"] for r in now}:
            raise commits.Conflict("what was merged has been merged by another writer")
        return state | {"runs": [{"id": run, "partial": False, "zone": zone, "span": span, "version": number}, *[r for r in now if r["id"] not in merged]]}

    commits.change(spark, f"{path}/log", put)


def vacuum(spark: SparkSession, path: str, hours: float = 24.0) -> list[str]:
    """Removes the runs that the last commit does not name and that nothing has been written to for so many hours; their names. Writers and readers must not take longer."""
    named = {f"run={r['id']}" for r in _runs(spark, path)}
    before = (time.time() - hours * 3600) * 1000
    gone = set()
    for table in ("postings", "chapters", "books"):
        for name, changed in commits.files_in(spark, f"{path}/{table}"):
            if name not in named and changed <= before:
                commits.remove(spark, f"{path}/{table}/{name}")
                gone.add(name.removeprefix("run="))
    return sorted(gone)


# Search


def _own_blocks(spark: SparkSession, path: str, runs: list[dict], tokens: list[str]) -> DataFrame:
    """The blocks of these tokens: files of other parts are not read, nor most rows of other tokens."""
    parts = spark.range(1).select(F.array(*[_part(F.lit(t)) for t in tokens]).alias("p")).first()["p"]
    return _cut(_rows_of_blocks(spark, path, runs).filter(F.col("part").isin(sorted(set(parts))) & F.col("token").isin(tokens)))


def live_runs(spark: SparkSession, path: str) -> list[dict]:
    """The runs that have chapters, with `turn`."""
    return [r for r in _turned(_runs(spark, path)) if "drop" not in r]


def blocks_of(spark: SparkSession, path: str, tokens: DataFrame) -> DataFrame:
    """The blocks of a table of tokens, with run and turn."""
    rows = _rows_of_blocks(spark, path, live_runs(spark, path))
    return _cut(rows.join(tokens.select("token", _part(F.col("token")).alias("part")), ["part", "token"])).drop("part", "span")


def met_by_term(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """(term, book_id, chapter_index) of the chapters that hold all of a term's tokens. blocks: term, n (its tokens), run, turn, zone, gaps."""
    runs = _turned(_runs(spark, path))
    kinds = "term string, run string, turn int, zone int, place long"

    def meet(own: pa.Table) -> pa.Table:
        found = _common(own["gaps"]) if own.num_rows == own["n"][0].as_py() else np.zeros(0, np.int64)
        columns = {"term": pa.string(), "run": pa.string(), "turn": pa.int32(), "zone": pa.int32()}
        return pa.table({c: pa.array([own[c][0].as_py()] * len(found), kind) for c, kind in columns.items()} | {"place": pa.array(found, pa.int64())})

    places = blocks.select("term", "n", "run", "turn", "zone", "gaps").groupBy("term", "run", "zone").applyInArrow(meet, kinds)
    real = live_runs(spark, path)
    keyed = _keyed(places, _table(spark, path, "chapters", _CHAPTERS, real), real, ["term"])
    return _in_turn(keyed, spark, path, runs).select("term", "book_id", "chapter_index")


def _common(lists: pa.ChunkedArray) -> np.ndarray:
    """The places that all of these lists of gaps have: the shortest is held against one after the other."""
    ordered = sorted((np.asarray(g.values.to_numpy(zero_copy_only=False)) for g in lists), key=len)
    found = np.cumsum(ordered[0], dtype=np.int64)
    for gaps in ordered[1:]:
        if not len(found):
            break
        found = np.intersect1d(found, np.cumsum(gaps, dtype=np.int64), assume_unique=True)
    return found


def _met(blocks: DataFrame, n_tokens: int) -> DataFrame:
    """(run, turn, zone, place) of the places that all of a zone's blocks have."""

    def meet(own: pa.Table) -> pa.Table:
        found = _common(own["gaps"]) if own.num_rows == n_tokens else np.zeros(0, np.int64)
        n = len(found)
        return pa.table({"run": pa.array([own["run"][0].as_py()] * n, pa.string()), "turn": pa.array([own["turn"][0].as_py()] * n, pa.int32()), "zone": pa.array([own["zone"][0].as_py()] * n, pa.int32()), "place": pa.array(found, pa.int64())})

    return blocks.select("run", "turn", "zone", "gaps").groupBy("run", "zone").applyInArrow(meet, "run string, turn int, zone int, place long")


def _keyed(places: DataFrame, chapters: DataFrame, runs: list[dict], also: list[str] | None = None) -> DataFrame:
    """(book_id, chapter_index, turn) of places, and the columns `also`."""
    size = F.create_map(*[F.lit(x) for r in runs for x in (r["id"], r.get("zone", ZONE))])
    numbered = places.select(*(also or []), "run", "turn", "zone", (F.col("zone") * size[F.col("run")] + F.col("place")).alias("doc_no"))
    return numbered.join(chapters.select("run", "zone", "doc_no", "book_id", "chapter_index"), ["run", "zone", "doc_no"]).select(*(also or []), "book_id", "chapter_index", "turn")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(book_id, chapter_index) of the indexed chapters that hold all tokens of the query; none for a query without tokens."""
    runs, tokens = _turned(_runs(spark, path)), search.query_tokens(spark, query)
    real = [r for r in runs if "drop" not in r]
    if not tokens or not real:
        return spark.createDataFrame([], "book_id string, chapter_index long")
    found = _keyed(_met(_own_blocks(spark, path, runs, tokens), len(tokens)), _table(spark, path, "chapters", _CHAPTERS, real), real)
    return _in_turn(found, spark, path, runs).select("book_id", "chapter_index")


def verified(spark: SparkSession, path: str, texts: search.TextSource, query: str) -> DataFrame:
    """(book_id, chapter_index, hit_count, first_at, snippet) of the chapters that hold the query: only candidates' texts are asked for. A candidate without a text has no hit."""
    found = candidates(spark, path, query)
    return search.with_hits(texts(found).filter("text is not null"), query).filter("hit_count > 0").select("book_id", "chapter_index", "hit_count", "first_at", "snippet")


def _before(row, order: list[str]) -> Column:
    """Whether a row comes before the given one, by columns without nulls."""
    first, *rest = order
    less = F.col(first) < row[first]
    return less | ((F.col(first) == row[first]) & _before(row, rest)) if rest else less


@dataclass
class Progress:
    """How far a search with a limit has come."""

    zones: int = 0
    zones_read: int = 0
    blocks_read: int = 0
    verified: int = 0
    hits: int = 0
    rounds: int = 0
    parts: list[DataFrame] = field(default_factory=list)


def first_hits(spark: SparkSession, path: str, texts: search.TextSource, query: str, limit: int = search.LIMIT, most: int | None = search.MAX_VERIFIED) -> tuple[DataFrame, Progress]:
    """The candidates that a search looks at that goes through them by book and chapter and stops at `limit` hits, or `most` candidates: book_id, chapter_index, hit_count, first_at, snippet; and how far it came.

    First the heads of blocks alone tell which zones hold all tokens, and can hold them in one chapter. Then
    zones are taken in the order of their first chapters, GROWTH times as many each round: their
    blocks meet, the candidates' texts are verified, and the search ends when the limit is
    reached. Zones of several runs may overlap, so a round goes up to the first chapter of the zone
    after it, and candidates beyond wait. On the driver are the zones of a round, MOST_ZONES at most.
    """
    progress = Progress()
    runs, tokens = _turned(_runs(spark, path)), search.query_tokens(spark, query)
    real = [r for r in runs if "drop" not in r]
    empty = spark.createDataFrame([], "book_id string, chapter_index long, hit_count long, first_at int, snippet string")
    if not tokens or not real:
        return empty, progress
    blocks, chapters = _own_blocks(spark, path, runs, tokens), _table(spark, path, "chapters", _CHAPTERS, real)
    heads = blocks.groupBy("run", "turn", "zone").agg(F.count("*").alias("n"), F.max("first").alias("first"), F.min("last").alias("last")).filter((F.col("n") == len(tokens)) & (F.col("first") <= F.col("last")))
    size = F.create_map(*[F.lit(x) for r in real for x in (r["id"], r.get("zone", ZONE))])
    firsts = chapters.filter(F.col("doc_no") % size[F.col("run")] == 0).select("run", "zone", "book_id", "chapter_index")
    zones = once(heads.select("run", "zone").join(firsts, ["run", "zone"]))
    progress.zones = zones.count()
    order = ["book_id", "chapter_index", "turn", "zone"]
    ordered = zones.join(spark.createDataFrame([(r["id"], r["turn"]) for r in real], "run string, turn int"), "run")
    at, waiting, take = None, None, FIRST_ZONES
    while progress.zones_read < progress.zones and progress.hits < limit and (most is None or progress.verified < most):
        rest = ordered if at is None else ordered.filter(~_before(at, order))
        taken = rest.orderBy(*order).limit(take + 1).collect()
        now, after = taken[:take], taken[take] if len(taken) > take else None
        wanted = spans = F.lit(False)
        for r in (r for r in real if any(z["run"] == r["id"] for z in now)):
            own, within = [z["zone"] for z in now if z["run"] == r["id"]], r["span"] // r["zone"]
            wanted = wanted | ((F.col("run") == r["id"]) & F.col("zone").isin(own))
            spans = spans | ((F.col("run") == r["id"]) & F.col("span").isin(sorted({z // within for z in own})))
        found = _keyed(_met(blocks.filter(spans).filter(wanted), len(tokens)), chapters.filter(wanted), real)
        pool = _in_turn(found, spark, path, runs).select("book_id", "chapter_index")
        pool = once(pool if waiting is None else pool.unionByName(waiting))
        ready = pool
        if after is not None:
            early = _before(after, order[:2])
            ready, waiting = pool.filter(early), pool.filter(~early)
        judged = once(ready.join(search.with_hits(texts(ready), query), ["book_id", "chapter_index"], "left").select("book_id", "chapter_index", F.coalesce("hit_count", F.lit(0)).cast("long").alias("hit_count"), F.coalesce("first_at", F.lit(-1)).alias("first_at"), "snippet"))
        counts = judged.agg(F.count("*").alias("n"), F.count_if(F.col("hit_count") > 0).alias("hits")).first()
        progress.parts.append(judged)
        progress.rounds += 1
        progress.zones_read += len(now)
        progress.blocks_read += len(now) * len(tokens)
        progress.verified += counts["n"]
        progress.hits += counts["hits"]
        at, take = after, min(MOST_ZONES, take * GROWTH)
    whole = empty
    for part in progress.parts:
        whole = whole.unionByName(part)
    return search.capped(whole, limit, most).filter("seen").drop("seen"), progress
