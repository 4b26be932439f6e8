"""Images of EPUB books as files, written by the tasks that read the archives.

An image's file is named by its content and by the end of its name in the archive, flattened, so a task that
runs twice, or two chapters with one image, leave one file, and no name leads out of the folder. A file
is written under a name of its own and then moved, so none is ever seen half.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from hashlib import sha256
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.sources import books
from lectern.sources.ranges import located

# Fixed value: characters of a file's name.
NAME_CHARS = 120


def file_name(resource: str, content: bytes) -> str:
    """Content first; of the archive's path letters, digits, dots, dashes, and _ for all others."""
    flat = re.sub(r"[^A-Za-z0-9._-]", "_", resource)
    return f"{sha256(content).hexdigest()[:16]}-{flat[-NAME_CHARS:]}"


def _put(store: fs.FileSystem, folder: str, name: str, content: bytes) -> None:
    known = store.get_file_info(f"{folder}/{name}")
    if known.type == fs.FileType.File and known.size == len(content):
        return
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(content)
    store.move(draft, f"{folder}/{name}")


def extract(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """book_id, chapter_index, n (the block), resource (path in the archive), path and size of each image block of a folder's EPUB books, its file being written under target/book_id.

    path is null, and nothing is written, for images that are not in the archive or over
    MAX_IMAGE_BYTES. Archives that can't be read have no rows. target is a folder that all executors share.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(folder)
    names = ["book_id", "chapter_index", "n", "resource", "path", "size"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner, before = located(target)
        for frame in frames:
            for book, content in zip(frame["book_id"], frame["content"], strict=True):
                rows = []
                try:
                    archive = books._Archive(content)
                    for index, _, _, own in books.epub_chapters(content):
                        for n, (kind, resource) in enumerate(own):
                            if kind == "image":
                                found = archive.bounded(resource, books.MAX_IMAGE_BYTES)
                                if found is not None:
                                    _put(store, f"{inner}/{book}", file_name(resource, found), found)
                                rows.append((book, index, n, resource, None if found is None else f"{before}{inner}/{book}/{file_name(resource, found)}", None if found is None else len(found)))
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError):
                    rows = []
                yield pd.DataFrame(rows, columns=names).astype({"size": "Int64"})

    return files.select(X.book_id(F.col("path")).alias("book_id"), "content").mapInPandas(run, "book_id string, chapter_index long, n int, resource string, path string, size long")
