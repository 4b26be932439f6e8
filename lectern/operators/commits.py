"""A log of commits: each is a numbered file with the whole state after it, and each number can be taken once.

Data are written first, under names of their own, by any number of tasks; the commit then makes
them part of the state, or nothing does. Who reads takes the last number's state and sees what it
names. Who writes reads a state, works, and takes the next number; if another writer has taken it,
the commit is refused (Conflict), so no change is lost. The state names folders, not rows: it fits in
a small file however much data there is.

The files are put in place by a rename that does not replace. On HDFS that is atomic; on a local
file system two commits within the same instant could both believe they came first, so such a folder
should have one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

ATTEMPTS = 20


class Conflict(Exception):
    """Another writer has committed meanwhile."""


def _hadoop(spark: SparkSession):
    return spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()


def files_in(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, milliseconds of the last change) of what lies in a folder; nothing for a folder that is not there."""
    fs, conf = _hadoop(spark)
    at = fs.Path(folder)
    store = at.getFileSystem(conf)
    if not store.exists(at):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in store.listStatus(at)]


def remove(spark: SparkSession, path: str) -> None:
    fs, conf = _hadoop(spark)
    at = fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def _read(spark: SparkSession, path: str) -> str:
    fs, conf = _hadoop(spark)
    at = fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def last(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """(number, state) of the last commit; (0, {}) if there is none."""
    numbers = [int(name[:-5]) for name, _ in files_in(spark, folder) if re.fullmatch(r"\d{12}\.json", name)]
    return (max(numbers), json.loads(_read(spark, f"{folder}/{max(numbers):012d}.json"))) if numbers else (0, {})


def commit(spark: SparkSession, folder: str, number: int, state: dict) -> None:
    """Makes state the commit of that number; Conflict if there is one already."""
    fs, conf = _hadoop(spark)
    whole, draft = fs.Path(f"{folder}/{number:012d}.json"), fs.Path(f"{folder}/.{uuid.uuid4().hex}")
    store = whole.getFileSystem(conf)
    stream = store.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(state).encode()))
    finally:
        stream.close()
    try:
        if store.exists(whole):
            raise Conflict(f"commit {number} of {folder} has been made by another writer")
        options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        fs.FileContext.getFileContext(whole.toUri(), conf).rename(draft, whole, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            raise Conflict(f"commit {number} of {folder} has been made by another writer") from e
        raise
    finally:
        store.delete(draft, False)


def change(spark: SparkSession, folder: str, work: Callable[[dict, int], dict], attempts: int = ATTEMPTS) -> int:
    """Commits work(state, number of the commit), again on the newer state if another writer was faster; the commit's number. work must be right on any state."""
    for attempt in range(attempts):
        number, state = last(spark, folder)
        try:
            commit(spark, folder, number + 1, work(state, number + 1))
            return number + 1
        except Conflict:
            if attempt + 1 == attempts:
                raise
    raise Conflict(folder)
