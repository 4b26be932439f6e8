"""Chapters of plain-text books: headings, tables of contents, numbering, volumes, offsets.

lines: book_id, line_no (from 0), start and stop (bytes), line. Headings are found and judged by
column functions; tables of contents, volumes and offsets are windows over a book's headings,
which are few. Only the alignment of chapter numbers walks through them in order, in one group
per book.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import chinese as C
from lectern.functions import text as X
from lectern.operators.ordinals import carried, summed_before
from lectern.operators.shared import once

# Fixed values.
MIN_CHAPTERS, TOC_RUN, PREFIX_CHARS = 3, 4, 30
WHOLE_TITLE, PROLOGUE_TITLE = "全文", "开篇"
_BLANK_LINE = r"^[ \t　﻿]*$"


def judged_lines(lines: DataFrame) -> DataFrame:
    """Adds filled (the number of lines with text up to and with this one, in the book) and heading."""
    marked = lines.withColumn("_filled", (~F.col("line").rlike(_BLANK_LINE)).cast("long"))
    counted = summed_before(marked, "book_id", "line_no", "_filled", "_before")
    filled = F.col("_before") + F.col("_filled")
    return counted.select(*lines.columns, filled.alias("filled"), C.heading(F.col("line")).alias("heading"))


def _encoded_length(text: Column, charset: Column) -> Column:
    @F.pandas_udf("long")
    def of_charset(texts: pd.Series, charsets: pd.Series) -> pd.Series:
        return pd.Series([len(t.encode(c, "replace")) for t, c in zip(texts, charsets, strict=True)])

    return of_charset(text, charset)


def headings(judged: DataFrame) -> DataFrame:
    """The lines that are headings, with number, kind, title and inline: whether other text comes before it in its line.

    An inline heading starts after that text. Its offset takes the bytes of the text in the book's
    charset (a column of the lines; without one UTF-8). In charsets of wide units none is looked for.
    """
    columns = ["book_id", "line_no", "start", "filled", "heading.number", "heading.kind", F.col("heading.text").alias("title"), "inline"]
    whole = judged.filter("heading.reason = 'accepted'").withColumn("inline", F.lit(False))
    other = judged.filter("heading.reason <> 'accepted' and contains(line, '第')").withColumn("_in", C.inline_heading(F.col("line"))).filter("_in is not null")
    before = F.substr("line", F.lit(1), F.col("_in.cut"))
    size = F.octet_length(before).cast("long")
    if "charset" in judged.columns:
        other = other.filter(~F.lower("charset").rlike("^utf-?(16|32)"))
        size = _encoded_length(before, F.col("charset"))
    inside = other.withColumn("start", F.col("start") + size).withColumn("heading", F.col("_in.heading")).withColumn("inline", F.lit(True))
    return whole.select(*columns).unionByName(inside.select(*columns))


def without_contents(found: DataFrame, run: int = TOC_RUN) -> DataFrame:
    """Without tables of contents: runs of `run` or more headings that each have no text before the next one.

    filled counts lines with text up to a heading, so headings with none between them differ by one.
    """
    following = carried(found, "book_id", "line_no", F.col("filled"), "_next", own=False, backward=True)
    marked = following.withColumn("_dense", F.coalesce(F.col("_next") - F.col("filled") <= 1, F.lit(False))).withColumn("_open", (~F.col("_dense")).cast("long"))
    # a run is numbered by the headings before it that are followed by text
    grouped = summed_before(marked, "book_id", "line_no", "_open", "_run")
    runs = grouped.groupBy(F.col("book_id").alias("_book"), F.col("_run").alias("_of")).agg(F.count_if("_dense").alias("_length"))
    joined = grouped.join(runs, F.col("book_id").eqNullSafe(F.col("_book")) & (F.col("_run") == F.col("_of")))
    return joined.filter(~F.col("_dense") | (F.col("_length") < run)).select(*found.columns)


def longest_increasing(numbers: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence; of equal numbers that could end it alike, the earliest."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for place, value in enumerate(numbers):
        k = bisect_left(ends, value)
        before.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(value)
            at.append(place)
        elif ends[k] != value:
            ends[k], at[k] = value, place
    found = []
    place = at[-1] if at else -1
    while place >= 0:
        found.append(place)
        place = before[place]
    return found[::-1]


def _kept(kinds: list[str], numbers: list[int]) -> list[bool]:
    return _segmented(kinds, numbers)[0]


def _segmented(kinds: list[str], numbers: list[int]) -> tuple[list[bool], int]:
    """(which headings stay, how often a new segment begins)."""
    keep = [kind != "CHAPTER" for kind in kinds]
    segments: list[list[int]] = [[]]
    fresh = True
    for i, (kind, number) in enumerate(zip(kinds, numbers, strict=True)):
        # a volume, or a first chapter, ends the segment before it and belongs to none, unless it begins one
        if not fresh and (kind == "VOLUME" or (kind == "CHAPTER" and number == 1)):
            keep[i] = True
            segments.append([])
            fresh = True
            continue
        fresh = False
        if kind == "CHAPTER":
            segments[-1].append(i)
    for segment in segments:
        for place in longest_increasing([numbers[i] for i in segment]):
            keep[segment[place]] = True
    return keep, len(segments) - 1


def aligned(found: DataFrame) -> DataFrame:
    """Without chapters whose numbers break the order. A book's headings, without its text, make a group."""
    def align(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line_no")
        return rows[_kept(rows["kind"].tolist(), rows["number"].astype(int).tolist())]

    return found.groupBy("book_id").applyInPandas(align, found.schema)


def segments(found: DataFrame) -> DataFrame:
    """(book_id, segments): how often numbering begins anew in each book, with a volume or a first chapter."""
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line_no")
        return pd.DataFrame({"book_id": rows["book_id"].head(1), "segments": [_segmented(rows["kind"].tolist(), rows["number"].astype(int).tolist())[1]]})

    kind = found.schema["book_id"].dataType.simpleString()
    return found.select("book_id", "line_no", "kind", "number").groupBy("book_id").applyInPandas(count, f"book_id {kind}, segments long")


def starts_new_volume(chapters: DataFrame) -> DataFrame:
    """Adds new_volume: whether a chapter's volume is another than that of the chapter before it; never without a volume."""
    before = carried(chapters, "book_id", "chapter_index", F.struct("volume"), "_before", own=False)
    return before.select(*chapters.columns, (F.col("volume").isNotNull() & ~F.col("volume").eqNullSafe(F.col("_before.volume"))).alias("new_volume"))


def with_volumes(kept: DataFrame) -> DataFrame:
    """Chapters with the title of the volume that they are in; the volumes' own rows go."""
    return carried(kept, "book_id", "line_no", F.when(F.col("kind") == "VOLUME", F.col("title")), "volume").filter("kind <> 'VOLUME'")


def split(lines: DataFrame, min_chapters: int = MIN_CHAPTERS, filter_contents: bool = True, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(book_id, chapter_index, title, volume, start, stop): the chapters of each book, in bytes, without gaps after the first.

    A book with fewer chapters is one chapter from end to end. Text before the first heading is a
    chapter of its own if it has that many characters.
    """
    found = once(headings(judged_lines(lines)))
    chapters = once(with_volumes(aligned(without_contents(found) if filter_contents else found)))
    books = lines.groupBy("book_id").agg(F.min("start").alias("_begin"), F.max("stop").alias("_end"))
    counted = chapters.groupBy("book_id").agg(F.count("*").alias("_n"), F.min("start").alias("_first"))
    states = books.join(counted, "book_id", "left").withColumn("_whole", F.coalesce(F.col("_n") < min_chapters, F.lit(True)))
    real = chapters.join(states.filter("not _whole").select("book_id"), "book_id").select("book_id", "start", "title", "volume")
    whole = states.filter("_whole").select("book_id", F.col("_begin").alias("start"), F.lit(WHOLE_TITLE).alias("title"), F.lit(None).cast("string").alias("volume"))
    early = lines.join(states.filter("not _whole").select("book_id", "_first"), "book_id").filter("start < _first")
    characters = F.length(F.regexp_replace("line", r"[\s　﻿]", ""))
    prefix = early.groupBy("book_id").agg(F.min("start").alias("start"), F.sum(characters).alias("_chars")).filter(F.col("_chars") >= prefix_chars)
    prologue = prefix.select("book_id", "start", F.lit(PROLOGUE_TITLE).alias("title"), F.lit(None).cast("string").alias("volume"))
    order = Window.partitionBy("book_id").orderBy("start")
    every = real.unionByName(whole).unionByName(prologue).join(books.select("book_id", "_end"), "book_id")
    stop = F.coalesce(F.lead("start").over(order), F.col("_end"))
    index = F.row_number().over(order) - 1
    return every.select("book_id", index.cast("long").alias("chapter_index"), "title", "volume", "start", stop.alias("stop"))


def blocks(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_index, title, n, kind, value, paragraph_index) of each line that holds something, in order; kind is heading or paragraph.

    chapters: book_id, chapter_index, title and text. A chapter's first such line is its heading
    if it is a heading that says the chapter's title; no other line is one. A chapter without
    text has no blocks, one without a title has no heading. Headings take no paragraph_index.
    """
    lines = F.filter(F.transform(F.split(X.clean(F.coalesce("text", F.lit(""))), "\n"), X.strip), lambda line: line != "")
    first = X.bound(C.heading(F.col("_lines")[0]), lambda h: F.when(h.reason == "accepted", h.text))
    own = chapters.select("book_id", "chapter_index", "title", lines.alias("_lines")).filter(F.size("_lines") > 0)
    headed = own.withColumn("_headed", F.coalesce((F.col("title") != "") & (first == F.col("title")), F.lit(False)))
    rows = headed.select("book_id", "chapter_index", "title", "_headed", F.posexplode("_lines").alias("n", "value"))
    kind = F.when(F.col("_headed") & (F.col("n") == 0), "heading").otherwise("paragraph")
    place = F.when(kind == "paragraph", F.col("n") - F.col("_headed").cast("int"))
    return rows.select("book_id", "chapter_index", "title", "n", kind.alias("kind"), "value", place.alias("paragraph_index"))


def report(lines: DataFrame, min_chapters: int = MIN_CHAPTERS) -> DataFrame:
    """(book_id, headings, inline, rejected, contents_dropped, numbering_dropped, segments, chapters, fallback) of each book.

    headings: all candidates, inline ones among them; chapters: those left, volumes not counted;
    fallback: whether these are too few, so that the book is one chapter.
    """
    judged = judged_lines(lines)
    found = once(headings(judged))
    real = without_contents(found)
    last = aligned(real)
    books = found.groupBy("book_id").agg(F.count("*").alias("headings"), F.count_if("inline").alias("inline"))
    tried = judged.groupBy("book_id").agg(F.count_if(~F.col("heading.reason").isin("accepted", "blank", "line too long", "not a heading")).alias("rejected"))
    after = real.groupBy("book_id").agg(F.count("*").alias("_real")).join(last.groupBy("book_id").agg(F.count("*").alias("_last"), F.count_if(F.col("kind") != "VOLUME").alias("chapters")), "book_id", "left")
    joined = tried.join(books, "book_id", "left").join(after, "book_id", "left").join(segments(real), "book_id", "left").fillna(0, ["headings", "inline", "_real", "_last", "chapters", "segments"])
    dropped = (F.col("headings") - F.col("_real")).alias("contents_dropped"), (F.col("_real") - F.col("_last")).alias("numbering_dropped")
    return joined.select("book_id", "headings", "inline", "rejected", *dropped, "segments", "chapters", (F.col("chapters") < min_chapters).alias("fallback"))
