"""Full-text search: candidates that hold all of a query's tokens, their verification, caps and coverage.

Chapters are (book_id, chapter_index, text). Pairs of Han characters and whole ASCII words narrow a
query down; only the text proves it. The index on disk is in operators/index.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.ordinals import numbered
from lectern.operators.shared import once, stored

# Hits returned, and candidates verified in a search over all books, at most.
LIMIT, MAX_VERIFIED = 300, 2000
#: Gives the texts of the chapters (book_id, chapter_index) that it is handed.
TextSource = Callable[[DataFrame], DataFrame]


def postings(chapters: DataFrame) -> DataFrame:
    """(token, book_id, chapter_index), each once. A chapter's own tokens are made distinct before they are spread, so nothing is shuffled."""
    return chapters.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"), "book_id", "chapter_index")


def query_tokens(spark: SparkSession, query: str) -> list[str]:
    """The distinct tokens of a query."""
    return sorted(set(spark.range(1).select(X.tokens(F.lit(query)).alias("t")).first()["t"]))


def candidates_of_index(index: DataFrame, query: str) -> DataFrame:
    """(book_id, chapter_index) of the chapters that hold all tokens of the query; none for a query without tokens."""
    wanted = query_tokens(index.sparkSession, query)
    some = index.filter(F.col("token").isin(wanted))
    return some.groupBy("book_id", "chapter_index").agg(F.count_distinct("token").alias("n")).filter(F.col("n") == len(wanted)).drop("n")


def candidates(chapters: DataFrame, query: str) -> DataFrame:
    """The same without an index, in one pass: the chapters, with their texts."""
    wanted = query_tokens(chapters.sparkSession, query)
    if not wanted:
        return chapters.limit(0)
    return chapters.filter(F.size(F.array_except(F.array(*map(F.lit, wanted)), X.tokens(F.col("text")))) == 0)


def with_hits(found: DataFrame, query: str) -> DataFrame:
    """Adds hit_count, first_at and snippet to candidates; a candidate without a hit has 0, -1 and null."""
    needle = F.lit(query.strip())
    hits = found.withColumn("hit_count", F.coalesce(X.count_ignoring_case(F.col("text"), needle), F.lit(0))).withColumn("first_at", F.coalesce(X.position_ignoring_case(F.col("text"), needle), F.lit(-1)))
    return hits.withColumn("snippet", F.when(F.col("hit_count") > 0, X.snippet(F.col("text"), needle)))


def verified(chapters: DataFrame, query: str) -> DataFrame:
    """(book_id, chapter_index, hit_count, first_at, snippet) of the chapters that hold the query. Texts without it are not split into tokens."""
    holding = chapters.filter(X.position_ignoring_case(F.col("text"), F.lit(query.strip())) >= 0)
    return with_hits(candidates(holding, query), query).filter("hit_count > 0").select("book_id", "chapter_index", "hit_count", "first_at", "snippet")


def texts_of(chapters: DataFrame) -> TextSource:
    """A source of texts over a table of chapters. What is wanted is stored first, so that Spark knows its size and, if that is small, shuffles no texts."""
    return lambda wanted: chapters.join(stored(wanted.select("book_id", "chapter_index").distinct(), "wanted"), ["book_id", "chapter_index"], "left_semi").select("book_id", "chapter_index", "text")


def capped(judged: DataFrame, limit: int = LIMIT, most: int | None = MAX_VERIFIED) -> DataFrame:
    """Adds seen: whether a search that goes through the candidates by book and chapter and stops at `limit` hits, or `most` candidates, comes to this one.

    judged: candidates with hit_count. Only the first `most` candidates, or those up to the hit
    that fills the limit, can be seen, so a bounded head of them is ordered; the rest is not. They
    are worked out once, so hand in what is to come out and no texts.
    """
    order = ["book_id", "chapter_index"]
    judged = once(judged)
    heads = judged.select(*order, "hit_count")
    stop = heads.filter("hit_count > 0").orderBy(*order).limit(limit)
    last = stop.agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("last"))
    budget = None if most is None else heads.orderBy(*order).limit(most).agg(F.max(F.struct(*order)).alias("last_verified"))
    here = F.struct(*order)
    out = judged.crossJoin(F.broadcast(last))  # one row
    seen = (F.col("n") < limit) | (here <= F.col("last"))
    if budget is not None:
        out = out.crossJoin(F.broadcast(budget))  # one row
        seen = seen & (here <= F.col("last_verified"))
    return out.withColumn("seen", seen).drop("n", "last", "last_verified")


def summary(marked: DataFrame, library_books: int) -> DataFrame:
    """One row about a capped search: candidates, hits, what was not looked at, and the books covered."""
    seen, hit = F.col("seen"), F.col("seen") & (F.col("hit_count") > 0)
    counts = marked.agg(
        F.count("*").alias("candidates"),
        F.count_if(hit).alias("hits"),
        F.count_if(~seen).alias("not_verified"),
        F.count_distinct(F.when(seen, F.col("book_id"))).alias("searched_books"),
    )
    truncated = F.col("not_verified") > 0
    return counts.select(
        "candidates",
        "hits",
        truncated.alias("truncated"),
        F.when(truncated, F.col("candidates") - F.col("hits")).otherwise(0).alias("unchecked"),
        F.when(truncated, 0).otherwise(F.col("candidates") - F.col("hits")).alias("false_positives"),
        "not_verified",
        "searched_books",
        F.lit(library_books).cast("long").alias("library_books"),
    )


def coverage(library: DataFrame, indexed: DataFrame, searched: DataFrame) -> DataFrame:
    """One row about books (each frame: book_id): how many are there, indexed and searched, how many are not, and in words."""
    count = lambda df, name: df.agg(F.count_distinct("book_id").alias(name))
    rows = count(library, "library_books").crossJoin(count(indexed, "indexed_books")).crossJoin(count(searched, "searched_books"))  # one row each
    whole = F.greatest("library_books", "indexed_books")
    missing, skipped = whole - F.col("indexed_books"), F.greatest(F.lit(0), F.col("indexed_books") - F.col("searched_books"))
    # an empty library lacks no index
    kind = F.when(whole == 0, "FULL").when(F.col("indexed_books") == 0, "NONE").when(missing > 0, "PARTIAL").otherwise("FULL")
    return rows.select(whole.alias("library_books"), "indexed_books", "searched_books", missing.alias("unindexed_books"), skipped.alias("skipped_books"), kind.alias("coverage"))


# What is said about a search.
EMPTY_LIBRARY = "书库还是空的，先导入几本书再来搜。"
NO_INDEX = ("书库里有 ", " 本书，一本都还没有建立索引，所以搜不到任何内容。建立索引后才能搜。")
NOTHING_FOUND = ("已搜索 ", " 本书，没有找到「", "」")
FOUND = ("找到 ", " 章，来自 ", " 本书")
CUT_SHORT = ("（已截断，另有 ", " 章未校验", "、", " 本书没轮到", "）")
NOT_INDEXED = ("    ·    还有 ", " 本没建索引，没被搜索")
ELAPSED = ("    ·    耗时 ", " ms")


def with_message(results: DataFrame) -> DataFrame:
    """Adds message, what each search is said to have found and not looked at.

    results: query, library_books, indexed_books, searched_books, hits, hit_books, unchecked and
    truncated, a row per search; with elapsed_ms the time is said too. A number that is null
    counts as zero, a query that is null as empty.
    """
    number = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    library, indexed, hits = number("library_books"), number("indexed_books"), number("hits")
    missing, skipped = library - indexed, indexed - number("searched_books")

    def said(parts: tuple[str, ...], *values: Column) -> Column:
        filled = [x for part, value in zip(parts, values, strict=False) for x in (F.lit(part), value.cast("string"))]
        return F.concat(*filled, *[F.lit(part) for part in parts[len(values) :]])

    found = F.when(hits == 0, said(NOTHING_FOUND, indexed, F.coalesce("query", F.lit("")))).otherwise(said(FOUND, hits, number("hit_books")))
    not_reached = F.when(skipped > 0, said(CUT_SHORT[2:4], skipped)).otherwise("")
    cut_short = F.when(F.col("truncated"), F.concat(said(CUT_SHORT[:2], number("unchecked")), not_reached, F.lit(CUT_SHORT[4]))).otherwise("")
    not_indexed = F.when(missing > 0, said(NOT_INDEXED, missing)).otherwise("")
    elapsed = said(ELAPSED, number("elapsed_ms")) if "elapsed_ms" in results.columns else F.lit("")
    message = F.when((indexed == 0) & (library == 0), EMPTY_LIBRARY).when(indexed == 0, said(NO_INDEX, library)).otherwise(F.concat(found, cut_short, not_indexed, elapsed))
    return results.withColumn("message", message)


def with_headers(hits: DataFrame) -> DataFrame:
    """Rows for display: before each book's hits a header row with their number, in the order of (book_id, row)."""
    headers = hits.groupBy("book_id").agg(F.count("*").alias("hits"))
    header_rows = headers.select("book_id", F.lit(0).cast("long").alias("row"), F.lit("header").alias("kind"), F.lit(None).cast("long").alias("chapter_index"), "hits")
    rows = numbered(hits.select("book_id", "chapter_index", "hit_count"), "book_id", "chapter_index", "_before")
    return header_rows.unionByName(rows.select("book_id", (F.col("_before") + 1).alias("row"), F.lit("hit").alias("kind"), F.col("chapter_index").cast("long"), F.col("hit_count").alias("hits")))


def display_order(hits: DataFrame, titles: DataFrame) -> DataFrame:
    """Hits with their titles, by the title's Chinese collation, then id and chapter."""
    named = hits.join(titles, "book_id", "left").withColumn("title", F.coalesce("title", F.lit("（未知书名）")))
    return named.orderBy(F.expr("title collate zh"), "book_id", "chapter_index")
