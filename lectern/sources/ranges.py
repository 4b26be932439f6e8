"""Reading parts of files: a data source whose partitions are byte ranges, opened and sought where they are read.

    spark.dataSource.register(Books)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("books").option("read", "lines").load(folder)

read = heads     book_id, path, charset, head: the first HEAD_BYTES of each text file
read = lines     book_id, charset, split, nth, start, stop, line: files are cut in splits of
                 `split_bytes`; a split has the lines that begin in it
read = chapters  book_id, chapter_index, text: folder is a Parquet table of byte ranges (book_id,
                 path, chapter_index, start, stop), of which a partition takes a file

Filters on book_id (and chapter_index) are pushed down: other books' files are not opened, other
chapters' ranges not read. Files are reached through
pyarrow's file systems: local paths, and URIs that it knows (hdfs, s3, gs, abfs).

Line ends are found in the bytes, so a split needs no text before it: in UTF-8, GB18030 and Big5
the bytes of \\n and \\r are in no other character, and wide charsets are looked through unit by
unit. On the driver is the list of files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from lectern.functions import text as X
from lectern.functions import titles
from lectern.operators.shared import new_folder, once
from lectern.sources import books

SPLIT_BYTES = 32 << 20
#: Bytes that are read at a time to find a line's end.
STEP = 1 << 16

_SCHEMAS = {
    "heads": "book_id string, path string, charset string, head string",
    "lines": "book_id string, charset string, split int, nth long, start long, stop long, line string",
    "chapters": "book_id string, chapter_index long, text string",
}


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before that path in Spark's name of the file)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/"), "file:"
    if "://" in path:
        store, inner = fs.FileSystem.from_uri(path)
        return store, inner, path[: path.index(inner)] if inner and inner in path else path[: path.index("://") + 3]
    return fs.LocalFileSystem(), path, "file:"


def opened(path: str):
    """The file, open for reading at any place. Spark may have written signs of its name as %xx."""
    store, inner, _ = located(path)
    try:
        return store.open_input_file(inner)
    except FileNotFoundError:
        return store.open_input_file(unquote(inner))


def text_files(folder: str) -> list[tuple[str, int]]:
    """(path as Spark names it, bytes) of the text files of a folder at any depth, hidden ones left out, by path."""
    store, inner, before = located(folder)
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((before + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(".txt") and not f.base_name.startswith((".", "_")))


def book_id(path: str) -> str:
    return sha256(path.encode()).hexdigest()[:16]


def read_at(file, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def split_lines(file, size: int, charset: str, mark: int, start: int, stop: int) -> Iterator[tuple[int, int, int, str]]:
    """(nth, start, stop, line) of the lines that begin at a byte from start on and before stop. mark: length of the byte order mark."""
    width = {"utf-16": 2, "utf-32": 4}.get(charset[:6], 1)
    aligned = lambda at: mark + -(-(max(at, mark) - mark) // width) * width
    start, stop = aligned(start), min(aligned(stop), size)
    if start >= stop:
        return
    # the unit before tells whether a line begins at start, the one after whether \r is a line end of its own
    base = max(mark, start - width)
    data = read_at(file, base, stop - base + width)
    kind = f"{'>' if charset.endswith('be') else '<'}u{width}"

    def begins(block: bytes) -> np.ndarray:
        """Places in a block at which a line begins: after line ends."""
        units = np.frombuffer(block, kind, len(block) // width)
        ends = (units == 10) | (units == 13)
        ends[:-1] &= ~((units[:-1] == 13) & (units[1:] == 10))
        return (np.flatnonzero(ends) + 1) * width

    found = begins(data) + base
    found = found[(found >= start) & (found < stop)]
    first = start if start == mark else int(found[0]) if len(found) else None
    if first is None:
        return
    last = int(found[-1]) if len(found) else first
    end, at = None, base + len(data)
    if len(later := begins(data[last - base :])) and (int(later[0]) + last < at or at >= size):
        end = last + int(later[0])
    while end is None and at < size:
        # the last line goes on: one unit of what is known, and the next step
        more = read_at(file, at, STEP)
        known = data[-width:]
        places = begins(known + more) + at - width
        places = places[(places > last) & ((places < at + len(more)) | (at + len(more) >= size))]
        data += more
        at += len(more)
        if len(places):
            end = int(places[0])
    end = size if end is None else end
    for nth, a, b, line in books.lines_of(data[first - base : end - base], charset, 0):
        yield nth, a + first, b + first, line


def chapter_text(file, size: int, charset: str, mark: int, start: int, stop: int) -> str:
    """The text of a byte range, cut at the ends of the file."""
    start = max(0, min(start, size))
    stop = max(start, min(stop, size))
    begin = max(start, mark)
    return re.sub(r"(?:\r\n|\r|\n)\Z", "", read_at(file, begin, max(0, stop - begin)).decode(charset, "replace"))


@dataclass
class _Head(InputPartition):
    files: list


@dataclass
class _Split(InputPartition):
    path: str
    size: int
    nth: int
    start: int
    stop: int


@dataclass
class _Ranges(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.wanted = options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            known = isinstance(f, (EqualTo, In)) and f.attribute in (("book_id",), ("chapter_index",)) and (f.attribute[0] == "book_id" or self.options["read"] == "chapters")
            if not known:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            column = f.attribute[0]
            self.wanted[column] = self.wanted[column] & values if column in self.wanted else values

    def _files(self) -> list[tuple[str, int]]:
        found = text_files(self.options["path"])
        return [f for f in found if book_id(f[0]) in self.wanted["book_id"]] if "book_id" in self.wanted else found

    def partitions(self) -> Sequence[InputPartition]:
        split = int(self.options.get("split_bytes", SPLIT_BYTES))
        if self.options["read"] == "chapters":
            store, inner, before = located(self.options["path"])
            return [_Ranges(before + p) for p in ds.dataset(inner, filesystem=store, format="parquet").files]
        if self.options["read"] == "heads":
            files = self._files()
            return [_Head(files[i : i + 256]) for i in range(0, len(files), 256)]
        return [_Split(path, size, n, n * split, min((n + 1) * split, size)) for path, size in self._files() for n in range(-(-size // split))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, _Head):
            for path, _ in partition.files:
                with opened(path) as file:
                    head = read_at(file, 0, books.HEAD_BYTES)
                charset, mark = books.detect(head)
                yield book_id(path), path, charset, head[mark:].decode(charset, "replace")
        elif isinstance(partition, _Split):
            with opened(partition.path) as file:
                charset, mark = charset_of(file, partition.size)
                for row in split_lines(file, partition.size, charset, mark, partition.start, partition.stop):
                    yield book_id(partition.path), charset, partition.nth, *row
        else:
            yield from self._chapters(partition.path)

    def _chapters(self, path: str) -> Iterator[tuple]:
        store, inner, _ = located(path)
        use = None
        for column, values in self.wanted.items():
            own = ds.field(column).isin(pa.array(sorted(values), pa.string() if column == "book_id" else pa.int64()))
            use = own if use is None else use & own
        file, at, charset, mark, size = None, None, "", 0, 0
        for batch in ds.dataset(inner, filesystem=store, format="parquet").to_batches(columns=["book_id", "path", "chapter_index", "start", "stop"], filter=use):
            for row in batch.to_pylist():
                if row["path"] != at:
                    if file:
                        file.close()
                    file, at = opened(row["path"]), row["path"]
                    size = file.size()
                    charset, mark = charset_of(file, size)
                yield row["book_id"], row["chapter_index"], chapter_text(file, size, charset, mark, row["start"], row["stop"])
        if file:
            file.close()


def charset_of(file, size: int) -> tuple[str, int]:
    """(charset, length of the byte order mark) by the file's first bytes. They may end within a character, unless they are all."""
    sample = read_at(file, 0, books.SAMPLE_BYTES)
    return books.detect(sample if len(sample) == size else sample + b"\0")


class Books(DataSource):
    """Text files of a folder; see above."""

    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("read", "lines")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader({"read": "lines"} | dict(self.options))


def _loaded(spark: SparkSession, read: str, folder: str, **options) -> DataFrame:
    spark.dataSource.register(Books)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("books").option("read", read).options(**options).load(folder)


def _numbered(found: DataFrame) -> DataFrame:
    """Lines of splits with their numbers in the book: the place in the split and the lines of the splits before it."""
    counts = found.groupBy(F.col("book_id").alias("_book"), F.col("split").alias("_split")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_book").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_book", "_split", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = found.join(starts, (F.col("book_id") == F.col("_book")) & (F.col("split") == F.col("_split")))
    return joined.select("book_id", "charset", (F.col("_before") + F.col("nth")).alias("line_no"), "start", "stop", "line")


def lines(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """What books.read_lines gives, with large files cut in splits."""
    return _numbered(_loaded(spark, "lines", folder, split_bytes=split_bytes))


def lines_of(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same of a table of files (book_id, path, length), each split where it is dealt to."""
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(length - 1) div {split_bytes}")))).alias("split")
    splits = files.select("book_id", "path", F.col("length").cast("long").alias("length"), nth).repartition("path", "split")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["nth", "start", "stop", "line"]
        for frame in frames:
            for book, path, size, split in frame[["book_id", "path", "length", "split"]].itertuples(index=False):
                with opened(path) as file:
                    charset, mark = charset_of(file, size)
                    rows = pd.DataFrame(list(split_lines(file, size, charset, mark, split * split_bytes, (split + 1) * split_bytes)), columns=names)
                yield rows.assign(book_id=book, charset=charset, split=np.int32(split))[["book_id", "charset", "split", *names]]

    return _numbered(once(splits.mapInPandas(read, _SCHEMAS["lines"])))


def heads(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, path, charset and head of the text books of a folder: HEAD_BYTES of each are read."""
    return _loaded(spark, "heads", folder)


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, path, title and author of the text books of a folder."""
    file_name = F.regexp_extract("path", r"([^/]*)$", 1)
    return heads(spark, folder).select("book_id", "path", titles.title(F.col("head"), file_name).alias("title"), titles.author(F.col("head")).alias("author"))


def chapter_ranges(spark: SparkSession, folder: str, chapters: DataFrame) -> str:
    """Writes the byte ranges (book_id, chapter_index, start, stop) of chapters with their files' paths, a book's one after the other; the folder that chapters() reads."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder).select("path")
    named = listed.select(X.book_id(F.col("path")).alias("book_id"), "path")
    target = new_folder(spark, "ranges")
    order = ["book_id", "start"]
    rows = chapters.select("book_id", F.col("chapter_index").cast("long").alias("chapter_index"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).join(named, "book_id")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(target)
    return target


def chapters(spark: SparkSession, ranges: str) -> DataFrame:
    """book_id, chapter_index and text, cleaned, of the chapters of a table that chapter_ranges() wrote: no other bytes of their files are read, but for the first that tell the charset."""
    return _loaded(spark, "chapters", ranges).withColumn("text", X.clean(F.col("text")))
