"""Reading books from files: folders, character sets, lines with byte offsets, EPUB archives, HTML blocks.

Files come in through Spark's binaryFile source, so any store that Spark reads will do; a file is
worked on where it was read. One file is held in memory at a time.
"""

from __future__ import annotations

import codecs
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser
from urllib.parse import unquote_plus
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.ordinals import carried

# Fixed values.
MAX_FILES, SAMPLE_BYTES, HEAD_BYTES, MAX_IMAGE_BYTES = 2000, 256 * 1024, 4096, 8 * 1024 * 1024
EXTENSIONS = ("txt", "epub")
#: Half bytes of a file whose lines find their chapters together.
LINE_SPAN = 1 << 20
#: Weights of UTF-16 units, later lines over earlier ones; of line ends and tabs, and what common characters add; and the mean under which a text makes no sense.
UNIT_WEIGHTS = (
    (0x0000, 0x001F, -60), (0x0020, 0x007E, 8), (0x007F, 0x009F, -60), (0x3000, 0x303F, 14), (0x3040, 0x30FF, -25), (0x3400, 0x4DBF, -6),
    (0x4E00, 0x9FFF, 12), (0xAC00, 0xD7AF, -25), (0xE000, 0xF8FF, -40), (0xFF00, 0xFFEF, 10), (0xFEFF, 0xFEFF, 0), (0xFFFD, 0xFFFD, -120),
)
LINE_WEIGHT, COMMON_WEIGHT, GARBAGE = 6, 25, 0.0
_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("format", ending).filter(F.col("format").isin(*EXTENSIONS) & ~F.col("path").rlike(r"/\.[^/]*$"))


def fingerprinted(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, format, book_id and fingerprint of every book of a folder."""
    return _listed(spark, folder).select("path", "length", "format", X.book_id(F.col("path")).alias("book_id"), X.fingerprint(F.col("length"), F.col("modificationTime")).alias("fingerprint"))


def scan(spark: SparkSession, folder: str, most: int = MAX_FILES) -> DataFrame:
    """path, length, modificationTime, book_id, format and fingerprint of the first `most` books of a folder by path, at any depth, hidden ones left out; and truncated, whether it came to that many."""
    listed = _listed(spark, folder)
    rows = listed.orderBy("path").limit(most)
    total = rows.agg(F.count("*").alias("_n"))
    shown = rows.crossJoin(F.broadcast(total))  # one row
    return shown.select(*listed.columns, X.book_id(F.col("path")).alias("book_id"), X.fingerprint(F.col("length"), F.col("modificationTime")).alias("fingerprint"), (F.col("_n") >= most).alias("truncated"))


def import_report(scanned: DataFrame, known: DataFrame, read: DataFrame) -> DataFrame:
    """One row about an import: scanned, skipped (known before), imported, failed, truncated, and failures (path and reason of each, by path).

    scanned: see scan(); known: book_id; read: book_id and error (null where it went well), of the files that were read.
    """
    old = known.select("book_id", F.lit(True).alias("_old")).distinct()
    tried = read.groupBy("book_id").agg(F.max("error").alias("error"), F.lit(True).alias("_read"))
    rows = scanned.join(old, "book_id", "left").join(tried, "book_id", "left")
    skipped = F.col("_old").isNotNull()
    failed = ~skipped & (F.col("error").isNotNull() | F.col("_read").isNull())
    failure = F.when(failed, F.struct("path", F.coalesce("error", F.lit("not read")).alias("reason")))
    return rows.agg(F.count("*").alias("scanned"), F.count_if(skipped).alias("skipped"), F.count_if(~skipped & ~failed).alias("imported"), F.count_if(failed).alias("failed"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"), F.array_sort(F.collect_list(failure)).alias("failures"))


@cache
def _weights() -> np.ndarray:
    """How much each UTF-16 unit speaks for a text being Chinese prose."""
    weight = np.zeros(1 << 16)
    for first, last, value in UNIT_WEIGHTS:
        weight[first : last + 1] = value
    for unit in map(ord, "\n\r\t"):
        weight[unit] = LINE_WEIGHT
    # the characters of the first level of GB2312 are the common ones
    common = b"".join(bytes((high, low)) for high in range(0xB0, 0xD8) for low in range(0xA1, 0xFF)).decode("gb2312", "ignore")
    weight[np.frombuffer(common.encode("utf-16-le"), "<u2")] += COMMON_WEIGHT
    return weight


def plausibility(sample: bytes, charset: str) -> tuple[float, int]:
    """(mean weight of a unit of the sample, read in this charset; minus how many of its bytes stand for nothing). Higher is likelier."""
    units = np.frombuffer(sample.decode(charset, "replace").encode("utf-16-le", "surrogatepass"), "<u2")
    return (float(_weights()[units].mean()), -int((units == 0xFFFD).sum())) if len(units) else (float("-inf"), 0)


def detect(content: bytes) -> tuple[str, int]:
    """(character set, length of the byte order mark): by the mark, by zero bytes, as UTF-8, the more plausible of GB18030 and Big5, or, if neither makes sense, of the two kinds of UTF-16."""
    for mark, name in sorted(_BOMS, key=lambda b: -len(b[0])):
        if content.startswith(mark):
            return name, len(mark)
    sample = content[:SAMPLE_BYTES]
    if len(sample) >= 32:
        units = len(sample) // 2
        even, odd = sample[: 2 * units : 2].count(0) / units, sample[1 : 2 * units : 2].count(0) / units
        if odd >= 0.7 and even <= 0.1:
            return "utf-16-le", 0
        if even >= 0.7 and odd <= 0.1:
            return "utf-16-be", 0
    try:
        codecs.getincrementaldecoder("utf-8")().decode(sample, len(sample) == len(content))
        return "utf-8", 0
    except UnicodeDecodeError:
        pass
    best, name = _likeliest(sample, ("gb18030", "big5"))
    if best[0] >= GARBAGE:
        return name, 0
    # neither makes sense, so it may be of wide units without a mark and without zero bytes
    wide, wide_name = _likeliest(sample, ("utf-16-le", "utf-16-be"))
    return (wide_name if wide[0] > best[0] else "gb18030"), 0


def _likeliest(sample: bytes, charsets: tuple[str, ...]) -> tuple[tuple[float, int], str]:
    """The best score and its charset, the first one of equals."""
    scores = [plausibility(sample, name) for name in charsets]
    best = max(scores)
    return best, charsets[scores.index(best)]


def lines_of(content: bytes, charset: str, at: int) -> Iterator[tuple[int, int, int, str]]:
    """(line_no, start, stop, line) of a text from byte `at` on: offsets in bytes, line ends \\r\\n, \\n and \\r left out of the line and counted in stop.

    The bytes are cut at line ends before they are decoded, so offsets hold whatever can't be decoded.
    """
    width = {"utf-16": 2, "utf-32": 4}.get(charset[:6], 1)
    units = np.frombuffer(content, f"{'>' if charset.endswith('be') else '<'}u{width}", (len(content) - at) // width, at)
    stops = np.flatnonzero((units == 10) | (units == 13))
    # \r before \n ends no line by itself
    followed = stops[:-1][(units[stops[:-1]] == 13) & (units[stops[1:]] == 10) & (stops[1:] == stops[:-1] + 1)] if len(stops) else stops
    ends = at + width * (np.setdiff1d(stops, followed) + 1)
    for n, (start, stop) in enumerate(zip([at, *ends.tolist()], [*ends.tolist(), len(content)], strict=True)):
        if start < stop:
            yield n, start, stop, content[start:stop].decode(charset, "replace").rstrip("\r\n")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder).withColumn("book_id", X.book_id(F.col("path")))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, charset, line_no, start, stop and line of the text books of a folder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for book, content in zip(frame["book_id"], frame["content"], strict=True):
                charset, at = detect(content)
                rows = pd.DataFrame(lines_of(content, charset, at), columns=["line_no", "start", "stop", "line"])
                rows.insert(0, "charset", charset)
                rows.insert(0, "book_id", book)
                yield rows

    return _texts(spark, folder).select("book_id", "content").mapInPandas(run, "book_id string, charset string, line_no long, start long, stop long, line string")


def chapter_texts(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id, chapter_index and text: each chapter's lines, cleaned."""
    # chapters begin before the line at the same place; each line then has the last chapter begun
    begun = chapters.select("book_id", (F.col("start") * 2).alias("_at"), F.struct("chapter_index", "stop").alias("_begun"), F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("string").alias("line"))
    own = lines.select("book_id", (F.col("start") * 2 + 1).alias("_at"), F.lit(None).cast(begun.schema["_begun"].dataType).alias("_begun"), "line_no", "start", "line")
    placed = carried(own.unionByName(begun), "book_id", "_at", F.col("_begun"), "_chapter", span=LINE_SPAN).filter("line_no is not null and start < _chapter.stop")
    inside = placed.select("book_id", F.col("_chapter.chapter_index").alias("chapter_index"), "line_no", "line")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    texts = inside.groupBy("book_id", "chapter_index").agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("text"))
    return texts.withColumn("text", X.clean(F.col("text")))


class _Blocks(HTMLParser):
    """Headings, paragraphs and images of a page, in order."""

    HEADINGS, PARAGRAPHS, SKIPPED = frozenset(("h1", "h2", "h3", "h4", "h5", "h6")), frozenset(("p", "blockquote", "li", "td")), frozenset(("script", "style", "head"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.kind, self.depth, self.skip = "", 0, 0
        self.parts: list[str] = []
        self.images: list[str] = []
        self.loose: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIPPED:
            self.skip += 1
        elif self.skip:
            return
        elif tag in ("img", "image"):
            of = dict(attrs)
            source = of.get("src") or of.get("xlink:href") or of.get("href") or ""
            if source:
                (self.images if self.kind else self.blocks).append(source if self.kind else ("image", source))
        elif self.kind:
            self.depth += tag == self.kind
        elif tag in self.HEADINGS or tag in self.PARAGRAPHS:
            self.kind, self.depth = tag, 1

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == self.kind:
            self.depth -= 1
            if not self.depth:
                self.end()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.parts if self.kind else self.loose).append(data)

    def end(self) -> None:
        if self.kind:
            if value := collapsed("".join(self.parts)):
                self.blocks.append(("heading" if self.kind in self.HEADINGS else "paragraph", value))
            self.blocks += [("image", source) for source in self.images]
        self.kind, self.depth, self.parts, self.images = "", 0, [], []


def collapsed(text: str) -> str:
    return re.sub(r"[\s　 ]+", " ", text).strip()


def html_blocks(html: str | None) -> list[tuple[str, str]]:
    """(kind, value) of each block; a page without blocks is one paragraph of its text."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.end()
    loose = collapsed(" ".join(parser.loose))
    return parser.blocks or ([("paragraph", loose)] if loose else [])


def blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, n, kind and value of each block of each page."""
    kind = pages.schema[page_id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, *block) for i, source in zip(frame[page_id], frame[html], strict=True) for n, block in enumerate(html_blocks(source))]
            yield pd.DataFrame(rows, columns=[page_id, "n", "kind", "value"])

    return pages.select(page_id, html).mapInPandas(run, f"{page_id} {kind}, n int, kind string, value string")


def resolve(base: str, href: str) -> str:
    """The archive's path that href means in the file base."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote_plus(href.partition("#")[0]))).lstrip("/")


def _xml(data: bytes) -> ElementTree.Element:
    # entities that a document type declares are refused rather than resolved
    if re.search(rb"<!(?:ENTITY|DOCTYPE[^>]*\[)", data):
        raise ValueError("declares entities")
    return ElementTree.fromstring(data)


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


class _Archive:
    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = {n.lower(): n for n in reversed(self.zip.namelist())}

    def _exact(self, name: str) -> str | None:
        return name if name in self.zip.namelist() else self.names.get(name.lower())

    def read(self, name: str) -> bytes | None:
        exact = self._exact(name)
        return self.zip.read(exact) if exact else None

    def bounded(self, name: str, most: int) -> bytes | None:
        """The same of entries of at most so many bytes, whatever the archive says of their size."""
        exact = self._exact(name)
        if exact is None or self.zip.getinfo(exact).file_size > most:
            return None
        with self.zip.open(exact) as entry:
            content = entry.read(most + 1)
        return content if len(content) <= most else None


def _contents(archive: _Archive, base: str, manifest: dict, toc_id: str | None) -> dict[str, str]:
    """Titles by path: of the navigation page, else of the NCX table that the spine or the media type names."""
    titles: dict[str, str] = {}
    for item in manifest.values():
        if "nav" in item.get("properties", "").split() and (page := archive.read(resolve(base, item["href"]))):
            where = resolve(base, item["href"])
            for link in (e for e in _xml(page).iter() if _local(e) == "a" and e.get("href")):
                titles.setdefault(resolve(where, link.get("href")), collapsed("".join(link.itertext())))
    if titles:
        return titles
    ncx = manifest.get(toc_id) or next((i for i in manifest.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
    if ncx and (table := archive.read(resolve(base, ncx["href"]))):
        where = resolve(base, ncx["href"])
        for point in (e for e in _xml(table).iter() if _local(e) == "navPoint"):
            label = next((collapsed("".join(e.itertext())) for e in point if _local(e) == "navLabel"), "")
            source = next((e.get("src") for e in point if _local(e) == "content"), None)
            if source:
                titles.setdefault(resolve(where, source), label)
    return titles


def epub_chapters(content: bytes) -> Iterator[tuple[int, str, str, list[tuple[str, str]]]]:
    """(chapter_index, path, title, blocks) in reading order, pages out of the flow left out."""
    archive = _Archive(content)
    container = _xml(archive.read("META-INF/container.xml") or b"<container/>")
    base = next((e.get("full-path") for e in container.iter() if _local(e) == "rootfile"), None)
    package = _xml(archive.read(base) or b"<package/>") if base else ElementTree.Element("package")
    manifest = {e.get("id"): dict(e.attrib) for e in package.iter() if _local(e) == "item" and e.get("href")}
    spine = next((e for e in package.iter() if _local(e) == "spine"), ElementTree.Element("spine"))
    titles = _contents(archive, base or "", manifest, spine.get("toc"))
    index = 0
    for ref in spine:
        item = manifest.get(ref.get("idref"))
        if item is None or ref.get("linear") == "no":
            continue
        path = resolve(base, item["href"])
        page = (archive.read(path) or b"").decode("utf-8", "replace")
        own = html_blocks(page)
        heading = next((v for kind, v in own if kind == "heading"), "")
        tag = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
        title = titles.get(path) or heading or (collapsed(tag[1]) if tag else "") or f"第 {index + 1} 章"
        yield index, path, title, [(kind, resolve(path, v) if kind == "image" else v) for kind, v in own]
        index += 1


def read_epubs(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, chapter_index, title, n, kind, value and error: a row per block, or one with the error for an archive that can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(folder)
    names = ["book_id", "chapter_index", "title", "n", "kind", "value", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for book, content in zip(frame["book_id"], frame["content"], strict=True):
                try:
                    rows = [(book, i, title, n, kind, value, None) for i, _, title, own in epub_chapters(content) for n, (kind, value) in enumerate(own)]
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError) as problem:
                    rows = [(book, None, None, None, None, None, str(problem))]
                yield pd.DataFrame(rows, columns=names).astype({"chapter_index": "Int64", "n": "Int64"})

    return files.select(X.book_id(F.col("path")).alias("book_id"), "content").mapInPandas(run, "book_id string, chapter_index long, title string, n long, kind string, value string, error string")


#: What reads each format.
READERS = {"txt": read_lines, "epub": read_epubs}
