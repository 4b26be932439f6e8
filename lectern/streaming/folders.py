"""Keeping an index in step with a folder of text files, run after run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from lectern.operators import chapters as H
from lectern.operators import commits, index, library
from lectern.operators.shared import once
from lectern.sources import books, ranges


@dataclass
class Step:
    """Books of a run: indexed (new or changed), dropped (their files are gone), unchanged."""

    indexed: int
    dropped: int
    unchanged: int


def sync(spark: SparkSession, folder: str, path: str) -> Step:
    """Indexes the text files that are new or whose fingerprint has changed, and drops books whose file is gone, in one commit.

    A run that fails leaves the index as it was, and the next one does its work; a run without
    changes commits nothing. Only files to be indexed are opened. A file without any line has no
    chapters and is looked at again each time.
    """
    files = once(books.fingerprinted(spark, folder).filter("format = 'txt'"))
    known = once(index.indexed_books(spark, path))
    stale = library.pending(files, known, index.TOKENIZER_VERSION)
    gone = known.join(files, "book_id", "left_anti").select("book_id")
    counts = stale.count(), gone.count(), files.count()
    runs = []
    if counts[0]:
        lines = ranges.lines_of(stale)
        run = index.write_run(books.chapter_texts(lines, once(H.split(lines))), path, stale.select("book_id", "fingerprint"))
        runs += [run] if run else []
    if counts[1]:
        runs.append(index.write_drop(gone, path))
    if runs:
        commits.change(spark, f"{path}/log", lambda state, number: state | {"runs": [*state.get("runs", []), *[r | {"version": number} for r in runs]]})
    return Step(counts[0], counts[1], counts[2] - counts[0])
