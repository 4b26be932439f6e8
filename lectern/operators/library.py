"""The library's tables: shelf, groups, bookmarks, settings, index state, reading time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalised_name
from lectern.operators.ordinals import carried, summed_before

# Fixed values.
RECENT = 12
NEAR, ROUNDING = 0.02, 1e-12
MIN_SECONDS, MAX_SECONDS = 30, 24 * 3600
#: What reciprocal ranks add to a place.
RANK_OFFSET = 60
#: Openings of a reader that are looked at together: those of a day.
DAY_MICROS = 86_400_000_000

#: Columns of each table; older tables get what they lack.
BOOK = "book_id string, title string, author string, format string, path string, added_at long, last_read_at long, group_name string, chapter_count int, version int"
BOOKMARK = "book_id string, chapter_index int, ratio double, note string, created_at long"
SETTING = "key string, value string"


def migrated(old: DataFrame, schema: str) -> DataFrame:
    """old with the columns of the schema, in its order and types; columns it lacks are null."""
    empty = old.sparkSession.createDataFrame([], schema)
    whole = empty.unionByName(old, allowMissingColumns=True)
    return whole.select(*[F.col(f.name).cast(f.dataType) for f in empty.schema])


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`: as one aggregate, so each task sends one row a key."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in others if c not in order])).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def upsert(old: DataFrame, new: DataFrame, key: str, preserved: tuple[str, ...]) -> DataFrame:
    """old with new's rows put in by key; the preserved columns of rows that were there stay as they were."""
    kept = old.join(new.select(key), key, "left_anti")
    own = old.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in preserved], F.lit(True).alias("_there"))
    joined = new.join(own, new[key] == own["_key"], "left")
    columns = [F.when(F.col("_there"), F.col(f"_{c}")).otherwise(new[c]).alias(c) if c in preserved else new[c] for c in old.columns]
    return kept.unionByName(joined.select(*columns))


def with_progress(books: DataFrame, progress: DataFrame) -> DataFrame:
    """books with the reading places of progress (the same columns, by book_id) put in; places of unknown books are left out."""
    places = [c for c in progress.columns if c != "book_id"]
    new = progress.select(F.col("book_id").alias("_of"), *[F.col(c).alias(f"_{c}") for c in places], F.lit(True).alias("_there"))
    joined = books.join(new, F.col("book_id") == F.col("_of"), "left")
    return joined.select(*[F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in places else F.col(c) for c in books.columns])


def with_group(books: DataFrame, book_ids: list[str], group: str | None) -> DataFrame:
    """The books of these ids in a group; in none for a blank one."""
    name = normalised_name(F.lit(group).cast("string"))
    return books.withColumn("group_name", F.when(F.col("book_id").isin(book_ids), name).otherwise(F.col("group_name")))


def with_notes(bookmarks: DataFrame, notes: DataFrame) -> DataFrame:
    """bookmarks with the notes of notes (book_id, chapter_index, created_at, note) put in, stripped, the empty note for none."""
    keys = ["book_id", "chapter_index", "created_at"]
    new = notes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(normalised_name(F.col("note")), F.lit("")).alias("_note"))
    joined = bookmarks.join(new, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    return joined.select(*[F.coalesce("_note", "note").alias("note") if c == "note" else F.col(c) for c in bookmarks.columns])


def fused(ranks: DataFrame, k: int = RANK_OFFSET) -> DataFrame:
    """Several rankings as one by reciprocal ranks: query_id, item_id, score, rank.

    ranks: query_id, list (which ranking), item_id, rank (from 1). An item's score is the sum of
    1 / (k + rank) over the rankings that have it; of an item that a ranking has twice, the better place
    counts; equal scores go by the best place, then by item_id.
    """
    once_each = ranks.groupBy("query_id", "item_id", "list").agg(F.min("rank").alias("rank"))
    # the ranks are added in order, so equal ones give equal sums
    parts = once_each.groupBy("query_id", "item_id").agg(F.array_sort(F.collect_list("rank")).alias("_ranks"))
    score = F.aggregate("_ranks", F.lit(0.0), lambda a, r: a + F.lit(1.0) / (F.lit(k) + r))
    scored = parts.select("query_id", "item_id", score.alias("score"), F.get("_ranks", F.lit(0)).alias("_best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_best", "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).drop("_best")


def forgotten(gone: DataFrame, books: DataFrame, *dependents: DataFrame) -> tuple[DataFrame, ...]:
    """books without those of gone (book_id), and each dependent table (bookmarks, sessions, index states) without their rows."""
    ids = gone.select("book_id").distinct()
    return tuple(df.join(ids, "book_id", "left_anti") for df in (books, *dependents))


def shelf(books: DataFrame) -> DataFrame:
    """All books, those read last first; ties by id."""
    return books.orderBy(F.desc("last_read_at"), "book_id")


def recent(books: DataFrame, n: int = RECENT) -> DataFrame:
    """The n books read last (0 or less: the usual number)."""
    return books.orderBy(F.desc("last_read_at"), "book_id").limit(n if n > 0 else RECENT)


def groups(books: DataFrame, column: str = "group_name") -> DataFrame:
    return books.select(normalised_name(F.col(column)).alias(column)).filter(F.col(column).isNotNull()).distinct()


def of_group(books: DataFrame, group: str | None, column: str = "group_name") -> DataFrame:
    """The books of a group; all for a blank one."""
    return books if group is None or not group.strip() else books.filter(normalised_name(F.col(column)) == group.strip())


def ungrouped(books: DataFrame, column: str = "group_name") -> DataFrame:
    return books.filter(normalised_name(F.col(column)).isNull())


def near(bookmarks: DataFrame, book_id: str, chapter_index: int, ratio: float, tolerance: float = NEAR) -> DataFrame:
    """The first bookmark of a chapter within the tolerance of a place."""
    here = bookmarks.filter((F.col("book_id") == book_id) & (F.col("chapter_index") == chapter_index) & (F.abs(F.col("ratio") - ratio) <= tolerance))
    return here.orderBy("ratio", "created_at").limit(1)


def near_all(bookmarks: DataFrame, places: DataFrame, tolerance: float = NEAR) -> DataFrame:
    """For many places (place_id, book_id, chapter_index, ratio) at once: the bookmark that near() gives.

    Of a place only the first bookmark at or after ratio - tolerance can be near, so bookmarks, one
    for each ratio, and the different places of a chapter are put in one order and looked through
    once. Rounding may leave that bookmark just outside, so the next one is tried too; ratios of
    bookmarks are taken to differ by more than ROUNDING.
    """
    chapter = ["book_id", "chapter_index"]
    firsts = bookmarks.groupBy(*chapter, "ratio").agg(F.min("created_at").alias("created_at"))
    asked = places.select(*chapter, F.col("ratio").alias("_at")).distinct()
    none = F.lit(None)
    marks = firsts.select(*chapter, F.col("ratio").alias("_key"), F.lit(1).alias("_kind"), none.cast("double").alias("_at"), F.struct("ratio", "created_at").alias("_mark"))
    spots = asked.select(*chapter, (F.col("_at") - tolerance - ROUNDING).alias("_key"), F.lit(0).alias("_kind"), F.col("_at"), none.cast(marks.schema["_mark"].dataType).alias("_mark"))
    order = Window.partitionBy(*chapter).orderBy("_key", "_kind")
    # in descending order the next bookmark is the last one seen, so the frame only grows
    seen = Window.partitionBy(*chapter).orderBy(F.desc("_key"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, -1)
    # each bookmark knows the next one; a place then needs only the bookmark after it
    chained = marks.withColumn("_next", F.lead("_mark").over(order)).unionByName(spots.withColumn("_next", none.cast(marks.schema["_mark"].dataType)))
    pair = F.when(F.col("_mark").isNotNull(), F.struct("_mark", "_next"))
    met = chained.withColumn("_pair", F.last(pair, ignorenulls=True).over(seen)).filter("_kind = 0")
    close = lambda mark: F.abs(mark["ratio"] - F.col("_at")) <= tolerance
    first, second = F.col("_pair._mark"), F.col("_pair._next")
    found = met.withColumn("_b", F.when(close(first), first).when(close(second), second)).filter("_b is not null").select(*chapter, "_at", "_b")
    named = places.select("place_id", *chapter, F.col("ratio").alias("_at"))
    return named.join(found, [*chapter, "_at"]).select("place_id", "_b.ratio", "_b.created_at")


def saved_settings(old: DataFrame, values: dict[str, str], known: list[str]) -> DataFrame:
    """Known keys are replaced by the given values; keys of others are left alone."""
    rest = old.filter(~F.col("key").isin(known))
    return rest.unionByName(old.sparkSession.createDataFrame(sorted(values.items()), SETTING))


def all_settings(settings: DataFrame) -> DataFrame:
    """Every setting, by key."""
    return settings.orderBy("key")


def whole_or(raw: Column, fallback: int) -> Column:
    """The whole number that a setting's text says, or the fallback."""
    value = F.trim(raw)
    return F.coalesce(F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("int")), F.lit(fallback))


def decimal_or(raw: Column, fallback: float) -> Column:
    """The finite number that a setting's text says, or the fallback."""
    value = F.trim(raw).try_cast("double")
    return F.coalesce(F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value), F.lit(fallback))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def percent_label(ratio: Column) -> Column:
    return F.concat(F.floor(ratio * 100 + 0.5).cast("string"), F.lit("%"))


def bookmark_label(title: Column, chapter_index: Column, ratio: Column) -> Column:
    name = F.when(normalised_name(title).isNull(), F.concat(F.lit("第 "), (chapter_index + 1).cast("string"), F.lit(" 章"))).otherwise(title)
    return F.concat(name, F.lit("  ·  章内 "), percent_label(ratio))


def reading_time_label(millis: Column) -> Column:
    """Hours and minutes in words; nothing for no time."""
    minutes = F.floor(millis / 60_000)
    hours, rest = F.floor(minutes / 60), minutes % 60
    said = F.when(hours <= 0, F.concat(rest.cast("string"), F.lit(" 分钟"))).when(rest == 0, F.concat(hours.cast("string"), F.lit(" 小时"))).otherwise(F.concat(hours.cast("string"), F.lit(" 小时 "), rest.cast("string"), F.lit(" 分")))
    return F.when(F.coalesce(millis, F.lit(0)) <= 0, "").when(minutes < 1, "不足 1 分钟").otherwise(said)


def searchable(books: DataFrame, meta: DataFrame) -> DataFrame:
    return books.join(meta, "book_id", "left_semi")


def orphans(books: DataFrame, meta: DataFrame) -> DataFrame:
    """Index states of books that are gone."""
    return meta.join(books, "book_id", "left_anti")


def pending(books: DataFrame, meta: DataFrame, version: int = 1, files: DataFrame | None = None) -> DataFrame:
    """Books (with fingerprint) whose index is missing or of another file or tokenizer.

    files: path and fingerprint of the files that are there, as a folder scan gives them. With it
    books (with path) have the fingerprint of their file, and those whose file is gone, which no
    run could index, are left out.
    """
    if files is not None:
        there = files.select("path", "fingerprint").dropDuplicates(["path"])
        books = books.drop("fingerprint").join(there, "path")
    fresh = meta.filter(F.col("tokenizer_version") == version).select("book_id", "fingerprint")
    return books.join(fresh, ["book_id", "fingerprint"], "left_anti")


def reading_segments(opened: DataFrame) -> DataFrame:
    """(user_id, started_at, seconds) between a reader's openings: none under 30 s, a day at most, none for a clock that went back.

    opened: user_id, event_id, ts. A book that is opened settles the one before it.
    """
    timed = opened.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("started_at"))
    followed = carried(timed, "user_id", "started_at", F.col("started_at"), "_next", DAY_MICROS, own=False, ties=("event_id",), backward=True)
    own = followed.select("user_id", "started_at", F.floor((F.col("_next") - F.col("started_at")) / 1_000_000).alias("seconds"))
    return own.filter(F.col("seconds") >= MIN_SECONDS).withColumn("seconds", F.least("seconds", F.lit(MAX_SECONDS)).cast("long"))


def whole_book_ratio(chapters: DataFrame, ratio: Column | None = None) -> DataFrame:
    """Where a place in each chapter is in its book, from 0 to 1. chapters: book_id, chapter_index, length.

    ratio: the place in the chapter, from 0 to 1; without it the chapter's middle, rounded down.
    """
    placed = summed_before(chapters, "book_id", "chapter_index", "length", "start_at")
    ends = chapters.groupBy("book_id").agg(F.sum("length").alias("_end"))
    inside = F.floor(F.col("length") / 2) if ratio is None else F.floor(ratio * F.col("length") + 0.5)
    at = F.col("start_at") + inside
    of_book = F.when(F.col("_end") > 0, clamped(at / F.col("_end"), 0.0, 1.0)).otherwise(F.lit(0.0))
    return placed.join(ends, "book_id").select("book_id", "chapter_index", "start_at", (F.col("start_at") + F.col("length")).alias("end_at"), F.round(of_book, 6).alias("ratio"))
