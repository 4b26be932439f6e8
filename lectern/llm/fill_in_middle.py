"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of FRAME_CHARS code points, each with the number
of line ends, code points and bytes before it. Whether and where a text is cut follows from
hashes of its id: so many lines are its prefix, so many more its middle, the rest its suffix. Only
the frames in which a cut lies are decompressed to find it; the output is then written as frames
itself, streamed piece by piece from the frames that a piece touches. Digests, and the text rebuilt from an
output, are streams over frames in order: no more than a frame or two is decompressed at a time.

    plain   the text as it is: it is empty, contains a marker, or its hash says so
    psm     <P> prefix <S> suffix <M> middle
    spm     <S> suffix <P> prefix <M> middle

Tables: framed() has `frames` of the texts and how each text is to be cut, transformed() the
`output` frames and the lengths of the pieces in code points; a frame is a struct of data (binary,
a zstandard frame), and lines, chars, bytes (of the whole text before it). with_texts() reads
outputs and the texts they were made of back, with_digests() their digests.

A unit is a line with its line end; the last one may have none. A task holds one batch of texts
and their frames; a text is whole in a row, before and after, and never more than that.

Defined cases: a null text is an empty one, plain, with no frames; a null id is hashed as the
empty text; rows that repeat an id are cut by the same hashes, each its own text; lines of any
length are cut over frames; pieces may be empty; other columns come along under their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.common import documents, written

FRAME_CHARS = 1 << 15
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Percent of the texts that are transformed, and of those the ones whose suffix goes first.
RATE, SPM_RATE = 100, 50

_FRAME = pa.struct([("data", pa.binary()), ("lines", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64())])
_FRAMES = "array<struct<data:binary,lines:bigint,chars:bigint,bytes:bigint>>"

Frames = list[dict]


class Writer:
    """Makes frames of the text that it is given in parts."""

    def __init__(self, frame_chars: int = FRAME_CHARS) -> None:
        self.size, self.frames, self.held, self.n_held = frame_chars, [], [], 0
        self.lines = self.chars = self.bytes = 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def write(self, text: str) -> None:
        at = 0
        while at < len(text):
            part = text[at : at + self.size - self.n_held]
            self.held.append(part)
            self.n_held += len(part)
            at += len(part)
            if self.n_held == self.size:
                self._close()

    def _close(self) -> None:
        text = "".join(self.held)
        data = text.encode("utf-8", "surrogatepass")
        self.frames.append({"data": self.compressor.compress(data), "lines": self.lines, "chars": self.chars, "bytes": self.bytes})
        self.lines += text.count("\n")
        self.chars += len(text)
        self.bytes += len(data)
        self.held, self.n_held = [], 0

    def done(self) -> Frames:
        if self.n_held:
            self._close()
        return self.frames


class Reader:
    """Reads a text from its frames: decompressed are those that are asked for, one at a time. opened counts them."""

    def __init__(self, frames: Frames) -> None:
        self.frames, self.opened = frames or [], 0
        self.decompressor = zstandard.ZstdDecompressor()

    def text(self, i: int) -> str:
        self.opened += 1
        return self.decompressor.decompress(self.frames[i]["data"]).decode("utf-8", "surrogatepass")

    def last(self, field: str, most: int) -> int:
        """The last frame with at most so much before it."""
        low, high = 0, len(self.frames)
        while high - low > 1:
            half = (low + high) // 2
            low, high = (half, high) if self.frames[half][field] <= most else (low, half)
        return low

    def after_lines(self, n: int, n_lines: int, n_chars: int) -> int:
        """The code point at which unit n ends. n_lines, n_chars: line ends and code points of the whole text."""
        if n <= 0:
            return 0
        if n > n_lines:
            return n_chars
        i = self.last("lines", n - 1)
        text, at = self.text(i), -1
        for _ in range(n - self.frames[i]["lines"]):
            at = text.index("\n", at + 1)
        return self.frames[i]["chars"] + at + 1

    def parts(self, start: int = 0, stop: int | None = None) -> Iterator[str]:
        """The text from one code point to another, frame by frame."""
        if not self.frames or stop is not None and stop <= start:
            return
        for i in range(self.last("chars", start), len(self.frames)):
            before = self.frames[i]["chars"]
            if stop is not None and before >= stop:
                return
            text = self.text(i)
            yield text[max(0, start - before) : None if stop is None else stop - before]

    def find(self, needle: str, start: int = 0) -> int:
        """The code point at which the first needle after start begins: whatever frames it lies over."""
        held, at = "", start
        for part in self.parts(start):
            seen = held + part
            if (found := seen.find(needle)) >= 0:
                return at - len(held) + found
            at += len(part)
            held = seen[len(seen) - len(needle) + 1 :] if len(seen) >= len(needle) else seen
        raise ValueError(f"no {needle} in this output")


def digest(parts: Iterable[str]) -> str:
    out = hashlib.sha256()
    for part in parts:
        out.update(part.encode("utf-8", "surrogatepass"))
    return out.hexdigest()


def frames_of(text: str, frame_chars: int = FRAME_CHARS) -> tuple[Frames, int, int]:
    """(frames, line ends, code points) of a text."""
    writer = Writer(frame_chars)
    writer.write(text)
    return writer.done(), writer.lines, writer.chars


def arranged(frames: Frames, n_lines: int, n_chars: int, first: int, second: int, form: str, frame_chars: int = FRAME_CHARS) -> tuple[Frames, int | None, int | None]:
    """(frames of the output, code points of prefix and middle): the prefix ends after unit `first`, the middle after unit `second`."""
    if form == "plain":
        return frames, None, None
    reader = Reader(frames)
    p, m = reader.after_lines(first, n_lines, n_chars), reader.after_lines(second, n_lines, n_chars)
    pieces = {PREFIX: (0, p), MIDDLE: (p, m), SUFFIX: (m, n_chars)}
    writer = Writer(frame_chars)
    for marker in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        writer.write(marker)
        for part in reader.parts(*pieces[marker]):
            writer.write(part)
    return writer.done(), p, m - p


def restored(output: Frames, form: str) -> Iterator[str]:
    """The text that an output was made of, part by part. Markers are found in the output: the text of a transformed output has none."""
    reader = Reader(output)
    if form == "plain":
        yield from reader.parts()
        return
    second = SUFFIX if form == "psm" else PREFIX
    n = len(second)
    cut = reader.find(second, n)
    middle = reader.find(MIDDLE, cut + n)
    prefix, suffix = ((n, cut), (cut + n, middle)) if form == "psm" else ((cut + n, middle), (n, cut))
    yield from reader.parts(*prefix)
    yield from reader.parts(middle + n)
    yield from reader.parts(*suffix)


def _mapped(rows: DataFrame, taken: tuple[str, ...], given: str, types: dict[str, pa.DataType], work) -> DataFrame:
    """rows with further columns: work(*values of the taken columns) gives a row's values of them."""
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(given).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in types]
            for values in zip(*[batch.column(c) for c in taken], strict=True):
                for column, value in zip(found, work(*[v.as_py() for v in values]), strict=True):
                    column.append(value)
            arrays = [pa.array(x, kind) for x, kind in zip(found, types.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *types])

    return rows.mapInArrow(run, schema)


def framed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """`_row` (what docs has but for the text), form, frames, n_lines (line ends), n_chars, n (units), first and second (units before which prefix and middle end)."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long")
    own = F.coalesce(F.col(text), F.lit(""))
    marked = F.contains(own, F.lit(PREFIX)) | F.contains(own, F.lit(SUFFIX)) | F.contains(own, F.lit(MIDDLE))
    kind = F.when((own == "") | marked | (number(2) % 100 >= rate), "plain").when(number(3) % 100 < spm_rate, "spm").otherwise("psm")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    open_end = ((own != "") & ~F.endswith(own, F.lit("\n"))).cast("long")
    rows = docs.select(row.alias("_row"), kind.alias("form"), number(0).alias("h1"), number(1).alias("h2"), open_end.alias("open_end"), own.alias("_text"))
    stored = _mapped(rows, ("_text",), f"frames {_FRAMES}, n_lines long, n_chars long", {"frames": pa.list_(_FRAME), "n_lines": pa.int64(), "n_chars": pa.int64()}, lambda t: frames_of(t, frame_chars))
    cut = stored.select("_row", "form", "frames", "n_lines", "n_chars", (F.col("n_lines") + F.col("open_end")).alias("n"), "h1", "h2")
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    return cut.select("_row", "form", "frames", "n_lines", "n_chars", "n", F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def transformed(store: DataFrame, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """_row, n, form, prefix_chars, middle_chars and output (frames) of each text of the store, as framed() gives it."""
    kinds = {"output": pa.list_(_FRAME), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
    work = lambda frames, n_lines, n_chars, first, second, form: arranged(frames, n_lines, n_chars, first, second, form, frame_chars)
    found = _mapped(store, ("frames", "n_lines", "n_chars", "first", "second", "form"), f"output {_FRAMES}, prefix_chars long, middle_chars long", kinds, work)
    return found.select("_row", "n", "form", "prefix_chars", "middle_chars", "output")


def with_texts(outputs: DataFrame) -> DataFrame:
    """Adds output_text and restored_text to what transformed() gives."""
    work = lambda output, form: ("".join(Reader(output).parts()), "".join(restored(output, form)))
    return _mapped(outputs, ("output", "form"), "output_text string, restored_text string", {"output_text": pa.string(), "restored_text": pa.string()}, work)


def with_digests(outputs: DataFrame) -> DataFrame:
    """Adds output_sha256 and restored_sha256 to what transformed() gives, from streams over the frames."""
    work = lambda output, form: (digest(Reader(output).parts()), digest(restored(output, form)))
    return _mapped(outputs, ("output", "form"), "output_sha256 string, restored_sha256 string", {"output_sha256": pa.string(), "restored_sha256": pa.string()}, work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cuts, and the digests of its output and of the text rebuilt from it."""
    store = written(framed(documents(spark, sf_dir).select("doc_id", "text")), "frames")
    outputs = written(transformed(store), "outputs")
    return with_digests(outputs).select("_row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES = {"op13_fill_in_middle": query}

ORACLE_SQL = {
    "op13_fill_in_middle": r"""
        WITH hashed AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), units AS (
            SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u,
                   CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
            FROM hashed
        ), cut AS (
            SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM units
        ), pieces AS (
            SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM pieces
    """
}
