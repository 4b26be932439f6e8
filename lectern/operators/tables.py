"""The library's tables as snapshots under one log of commits, which the index in the same folder shares.

A commit names a folder of Parquet files for each table, so tables change together or not at all: a
book that is forgotten takes its bookmarks, its sessions and its index along in one step. A
snapshot is what one commit names; a change made on it is refused (commits.Conflict) if another has
been committed since. Folders that no longer count stay for readers until vacuum().
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import commits, index, library

SESSION = "book_id string, started_at long, ended_at long, seconds long"
SCHEMAS = {"books": library.BOOK, "bookmarks": library.BOOKMARK, "settings": library.SETTING, "sessions": SESSION}
#: Tables whose rows go with their book.
DEPENDENT = ("bookmarks", "sessions")


@dataclass
class Snapshot:
    """What one commit names."""

    spark: SparkSession
    path: str
    number: int
    state: dict

    def table(self, name: str) -> DataFrame:
        """A table as it was then, with the columns that its schema has now; empty if it has never been written."""
        folder = self.state.get("tables", {}).get(name)
        if folder is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return library.migrated(self.spark.read.parquet(f"{self.path}/data/{folder}"), SCHEMAS[name])

    def commit(self, changed: dict[str, DataFrame], runs: list[dict] | None = None) -> Snapshot:
        """Writes the changed tables and makes them, and runs of the index, the next snapshot. Conflict if there is one already."""
        folders = {}
        for name, rows in changed.items():
            folders[name] = f"{name}-{uuid.uuid4().hex}"
            library.migrated(rows, SCHEMAS[name]).write.parquet(f"{self.path}/data/{folders[name]}")
        state = self.state | {"tables": self.state.get("tables", {}) | folders}
        if runs:
            state["runs"] = [*state.get("runs", []), *[r | {"version": self.number + 1} for r in runs]]
        commits.commit(self.spark, f"{self.path}/log", self.number + 1, state)
        return Snapshot(self.spark, self.path, self.number + 1, state)


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The last commit's tables."""
    return Snapshot(spark, path, *commits.last(spark, f"{path}/log"))


def change(spark: SparkSession, path: str, work: Callable[[Snapshot], dict[str, DataFrame]], attempts: int = commits.ATTEMPTS) -> Snapshot:
    """Commits work(snapshot), the tables that change; once more on the newer snapshot if another writer was faster."""
    for attempt in range(attempts):
        now = snapshot(spark, path)
        try:
            return now.commit(work(now))
        except commits.Conflict:
            if attempt + 1 == attempts:
                raise
    raise commits.Conflict(path)


def save_books(spark: SparkSession, path: str, books: DataFrame) -> Snapshot:
    """Puts books in by id; when they were added, and their group, stay as they were."""
    return change(spark, path, lambda now: {"books": library.upsert(now.table("books"), library.migrated(books, SCHEMAS["books"]), "book_id", ("added_at", "group_name"))})


def save_settings(spark: SparkSession, path: str, values: dict[str, str], known: list[str]) -> Snapshot:
    """Replaces the known keys; keys of others are left alone."""
    return change(spark, path, lambda now: {"settings": library.saved_settings(now.table("settings"), values, known)})


def add_rows(spark: SparkSession, path: str, name: str, rows: DataFrame) -> Snapshot:
    """Appends rows to a table; those of books that are not there are left out."""
    return change(spark, path, lambda now: {name: now.table(name).unionByName(library.migrated(rows, SCHEMAS[name]).join(now.table("books").select("book_id"), "book_id", "left_semi"))})


def set_note(spark: SparkSession, path: str, marks: DataFrame) -> Snapshot:
    """Gives bookmarks (book_id, chapter_index, created_at) their notes, stripped; none becomes the empty note."""
    return change(spark, path, lambda now: {"bookmarks": library.with_notes(now.table("bookmarks"), marks)})


def forget(spark: SparkSession, path: str, gone: DataFrame, attempts: int = commits.ATTEMPTS) -> Snapshot:
    """Takes books (book_id) off the shelf, with the rows that depend on them and their index, in one commit."""
    for attempt in range(attempts):
        now = snapshot(spark, path)
        names = ("books", *DEPENDENT)
        left = library.forgotten(gone, *[now.table(n) for n in names])
        try:
            return now.commit(dict(zip(names, left, strict=True)), [index.write_drop(gone, path)])
        except commits.Conflict:
            if attempt + 1 == attempts:
                raise
    raise commits.Conflict(path)


def vacuum(spark: SparkSession, path: str, hours: float = 24.0) -> list[str]:
    """Removes the tables' folders that the last commit does not name and that are older; their names."""
    named = set(snapshot(spark, path).state.get("tables", {}).values())
    before = (time.time() - hours * 3600) * 1000
    gone = sorted(n for n, changed in commits.files_in(spark, f"{path}/data") if n not in named and changed <= before)
    for name in gone:
        commits.remove(spark, f"{path}/data/{name}")
    return gone
