"""The catalogue of queries over the reader's tables, by name, with their SQL.

A book is a source of `documents`, its chapters are that source's documents by doc_id; pages are
the HTML documents, events are a reader's openings, conversations the questions. What is about
Chinese text is in chinese_rows.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import ask as A
from lectern.operators import chapters as H
from lectern.operators import index as I
from lectern.operators import library as B
from lectern.operators import search as S
from lectern.operators import tables as T
from lectern.operators import vectors as V
from lectern.operators.ordinals import numbered
from lectern.operators.shared import new_folder, stored
from lectern.plans import chinese_rows
from lectern.sources import books
from lectern.streaming import incremental, reading

QUERY, QUERY_TOKENS = "of the", ("of", "the")
LIMIT = 20

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, chapter_index, doc_id and text. The numbers are worked out without the texts."""
    docs = table(spark, sf_dir, "documents")
    places = numbered(docs.select(F.col("source").alias("book_id"), "doc_id"), "book_id", "doc_id", "chapter_index")
    return places.join(docs.select("doc_id", "text"), "doc_id").select("book_id", "chapter_index", "doc_id", "text")


_CHAPTERS = """
    WITH chapters AS (
        SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chapter_index, doc_id, text FROM documents
    ), tokens AS (
        SELECT *, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: lower(t)) AS tokens FROM chapters
    ), candidates AS (
        SELECT * FROM tokens WHERE list_has_all(tokens, ['of', 'the'])
    ), judged AS (
        SELECT *, CAST((length(lower(text)) - length(replace(lower(text), 'of the', ''))) / 6 AS BIGINT) AS hit_count, instr(lower(text), 'of the') - 1 AS first_at FROM candidates
    ), hits AS (
        SELECT * FROM judged WHERE hit_count > 0
    )
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_verified(spark, sf_dir)


# Tokens and the index


@_query("SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: lower(t)) AS t FROM documents)")
def tokenize_documents(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@_query(_CHAPTERS + "SELECT DISTINCT unnest(tokens) AS token, book_id, chapter_index FROM tokens")
def build_postings(spark, sf_dir):
    return S.postings(chapters(spark, sf_dir))


@_query(_CHAPTERS + "SELECT token, count(*) AS chapters, count(DISTINCT book_id) AS books FROM (SELECT DISTINCT unnest(tokens) AS token, book_id, chapter_index FROM tokens) GROUP BY token")
def token_statistics(spark, sf_dir):
    return S.postings(chapters(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("chapters"), F.count_distinct("book_id").alias("books"))


# Search


@_query(_CHAPTERS + "SELECT book_id, chapter_index FROM candidates")
def search_candidates(spark, sf_dir):
    return S.candidates_of_index(S.postings(chapters(spark, sf_dir)), QUERY)


_SNIPPET = r"""
    trim(regexp_replace(regexp_replace((CASE WHEN first_at > 32 THEN '…' ELSE '' END)
        || substr(text, CAST(greatest(0, first_at - 32) + 1 AS INTEGER), CAST(least(length(text), first_at + 38) - greatest(0, first_at - 32) AS INTEGER)) || '…', '[\n\r]', ' ', 'g'), '[ \t\x{3000}]{2,}', ' ', 'g'), E' \t\n\r\f\v　')
"""


@_query(_CHAPTERS + f"SELECT book_id, chapter_index, hit_count, CAST(first_at AS INTEGER) AS first_at, {_SNIPPET} AS snippet FROM hits")
def search_verified(spark, sf_dir):
    return S.verified(chapters(spark, sf_dir), QUERY)


@_query(_CHAPTERS + "SELECT book_id, chapter_index FROM judged WHERE hit_count = 0")
def search_false_positives(spark, sf_dir):
    return S.with_hits(S.candidates(chapters(spark, sf_dir), QUERY), QUERY).filter("hit_count = 0").select("book_id", "chapter_index")


@_query(_CHAPTERS + "SELECT chapter_index, hit_count FROM hits WHERE book_id = 'src1'")
def search_one_book(spark, sf_dir):
    return S.verified(chapters(spark, sf_dir).filter("book_id = 'src1'"), QUERY).select("chapter_index", "hit_count")


@_query(_CHAPTERS + "SELECT book_id, count(*) AS chapters, CAST(sum(hit_count) AS BIGINT) AS hits FROM hits GROUP BY book_id")
def search_hits_by_book(spark, sf_dir):
    return S.verified(chapters(spark, sf_dir), QUERY).groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum("hit_count").alias("hits"))


_MARKED = (
    _CHAPTERS.rstrip()
    + f""", running AS (
        SELECT *, coalesce(sum(CAST(hit_count > 0 AS INTEGER)) OVER (ORDER BY book_id, chapter_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               row_number() OVER (ORDER BY book_id, chapter_index) AS rn FROM judged
    ), marked AS (
        SELECT *, before < {LIMIT} AND rn <= 2000 AS seen FROM running
    )
"""
)


@_query(_MARKED + "SELECT book_id, chapter_index, hit_count, seen FROM marked")
def search_capped(spark, sf_dir):
    judged = S.with_hits(S.candidates(chapters(spark, sf_dir), QUERY), QUERY).select("book_id", "chapter_index", "hit_count")
    return S.capped(judged, LIMIT)


@_query(
    _MARKED
    + """
    SELECT candidates, hits, not_verified > 0 AS truncated, CASE WHEN not_verified > 0 THEN candidates - hits ELSE 0 END AS unchecked,
           CASE WHEN not_verified > 0 THEN 0 ELSE candidates - hits END AS false_positives, not_verified, searched_books, library_books
    FROM (SELECT count(*) AS candidates, count(*) FILTER (seen AND hit_count > 0) AS hits, count(*) FILTER (NOT seen) AS not_verified,
                 count(DISTINCT book_id) FILTER (seen) AS searched_books, (SELECT count(DISTINCT source) FROM documents) AS library_books FROM marked)"""
)
def search_summary(spark, sf_dir):
    library = table(spark, sf_dir, "documents").agg(F.count_distinct("source")).first()[0]
    return S.summary(search_capped(spark, sf_dir), library)


@_query(
    _CHAPTERS
    + """
    SELECT greatest(l, i) AS library_books, i AS indexed_books, s AS searched_books, greatest(l, i) - i AS unindexed_books, greatest(0, i - s) AS skipped_books,
           CASE WHEN greatest(l, i) = 0 THEN 'FULL' WHEN i = 0 THEN 'NONE' WHEN greatest(l, i) > i THEN 'PARTIAL' ELSE 'FULL' END AS coverage
    FROM (SELECT (SELECT count(DISTINCT source) FROM documents) AS l, (SELECT count(DISTINCT source) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) AS i,
                 (SELECT count(DISTINCT book_id) FROM hits) AS s)"""
)
def search_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id")
    indexed = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id")
    return S.coverage(docs, indexed, S.verified(chapters(spark, sf_dir), QUERY))


@_query("""
    WITH j AS (SELECT source, n_chars, toxic = 1 AS indexed, toxic = 1 AND contains(lower(text), 'of the') AS hit FROM documents LEFT JOIN labels USING (doc_id)),
    c AS (SELECT source AS query, count(*) AS l, coalesce(count(*) FILTER (indexed), 0) AS i, coalesce(count(*) FILTER (indexed AND n_chars > 300), 0) AS s, coalesce(count(*) FILTER (hit), 0) AS h,
                 coalesce(count(*) FILTER (NOT coalesce(hit, false)), 0) AS u, max(n_chars) % 2 = 0 AS t FROM j GROUP BY source)
    SELECT query, CASE WHEN i = 0 THEN '书库里有 ' || l || ' 本书，一本都还没有建立索引，所以搜不到任何内容。建立索引后才能搜。' ELSE
        CASE WHEN h = 0 THEN '已搜索 ' || i || ' 本书，没有找到「' || query || '」' ELSE '找到 ' || h || ' 章，来自 ' || h || ' 本书' END
        || CASE WHEN t THEN '（已截断，另有 ' || u || ' 章未校验' || CASE WHEN i > s THEN '、' || (i - s) || ' 本书没轮到' ELSE '' END || '）' ELSE '' END
        || CASE WHEN l > i THEN '    ·    还有 ' || (l - i) || ' 本没建索引，没被搜索' ELSE '' END END AS message FROM c""")
def search_messages(spark, sf_dir):
    """What is said about a search in each source, whose documents with label 1 are the indexed ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    indexed = F.coalesce(F.col("toxic") == 1, F.lit(False))
    hit = F.coalesce(indexed & (X.position_ignoring_case(F.col("text"), F.lit(QUERY)) >= 0), F.lit(False))
    counts = docs.join(labels, "doc_id", "left").groupBy(F.col("source").alias("query")).agg(
        F.count("*").alias("library_books"),
        F.count_if(indexed).alias("indexed_books"),
        F.count_if(indexed & (F.col("n_chars") > 300)).alias("searched_books"),
        F.count_if(hit).alias("hits"),
        F.count_if(hit).alias("hit_books"),
        F.count_if(~hit).alias("unchecked"),
        (F.max("n_chars") % 2 == 0).alias("truncated"),
    )
    return S.with_message(counts).select("query", "message")


@_query(
    _CHAPTERS
    + """
    SELECT book_id, 0 AS row, 'header' AS kind, CAST(NULL AS BIGINT) AS chapter_index, count(*) AS hits FROM hits GROUP BY book_id
    UNION ALL SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index), 'hit', chapter_index, hit_count FROM hits"""
)
def search_rows(spark, sf_dir):
    return S.with_headers(S.verified(chapters(spark, sf_dir), QUERY))


@_query(_CHAPTERS + "SELECT book_id, chapter_index, hit_count FROM hits WHERE book_id <> 'src2' AND NOT (book_id = 'src1' AND chapter_index % 2 = 1)")
def search_index(spark, sf_dir):
    """A search by an index on disk, after a book has been indexed again with half of its chapters and another one dropped."""
    path, own = new_folder(spark, "index"), stored(chapters(spark, sf_dir), "chapters")
    I.index_books(own, path)
    I.index_books(own.filter("book_id = 'src1' and chapter_index % 2 = 0"), path)
    I.drop_books(spark.createDataFrame([("src2",), ("nobody",)], "book_id string"), path)
    return I.verified(spark, path, S.texts_of(own), QUERY).select("book_id", "chapter_index", "hit_count")


@_query("SELECT source AS book_id, count(*) AS chapters, CASE WHEN source < 'src15' THEN 1 ELSE 2 END AS generation FROM documents WHERE source <> 'src3' GROUP BY source")
def index_on_demand(spark, sf_dir):
    """The index's books after one has been dropped and those that were missing have been indexed on demand."""
    path, own = new_folder(spark, "index"), stored(chapters(spark, sf_dir), "chapters")
    files = own.select("book_id", F.lit("f").alias("fingerprint")).distinct()
    I.index_books(own.filter("book_id < 'src15'"), path, files)
    I.index_on_demand(own, files, path)
    I.drop_books(spark.createDataFrame([("src3",)], "book_id string"), path)
    return I.indexed_books(spark, path).select("book_id", "chapters", F.col("generation").cast("int").alias("generation"))


@_query(_CHAPTERS + "SELECT book_id, chapter_index FROM candidates WHERE book_id <> 'src2' AND NOT (book_id = 'src1' AND chapter_index % 2 = 1) AND NOT (book_id = 'src5' AND chapter_index % 3 = 0)")
def index_merged(spark, sf_dir):
    """Candidates after a failed run, one that did it again, a drop, chapters that came as a stream's batch, and a merge of all of it."""
    path, own = new_folder(spark, "index"), stored(chapters(spark, sf_dir), "chapters")
    I.index_books(own, path)
    half = own.filter("book_id = 'src1' and chapter_index % 2 = 0")
    I.write_run(own.filter("book_id = 'src1'").withColumn("text", F.lit(f"{QUERY} nothing else")), path)  # never committed
    I.index_books(half, path)
    I.index_batch(own.filter("book_id = 'src5' and chapter_index % 3 = 0").withColumn("text", F.lit("nothing of it")), path, "late", 0)
    I.drop_books(spark.createDataFrame([("src2",)], "book_id string"), path)
    I.merge(spark, path)
    I.vacuum(spark, path, hours=0)
    return I.candidates(spark, path, QUERY)


@_query(_MARKED + "SELECT book_id, chapter_index, hit_count, CAST(first_at AS INTEGER) AS first_at FROM marked WHERE seen")
def search_first(spark, sf_dir):
    """What a search by the index looks at until its limit is reached: it reads the blocks of a few zones, and these candidates' texts."""
    path, own = new_folder(spark, "index"), stored(chapters(spark, sf_dir), "chapters")
    I.index_books(own, path, zone=64)
    return I.first_hits(spark, path, S.texts_of(own), QUERY, LIMIT)[0].select("book_id", "chapter_index", "hit_count", "first_at")


# The library


def _shelf(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    read = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("last_read_at"))
    group = F.when(F.col("c_custkey") % 7 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment"))
    return customers.join(read, "c_custkey", "left").select(F.col("c_custkey").cast("string").alias("book_id"), F.col("c_name").alias("title"), group.alias("group_name"), "last_read_at")


_SHELF = """
    WITH shelf AS (
        SELECT CAST(c_custkey AS VARCHAR) AS book_id, c_name AS title, CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_mktsegment END AS group_name, last_read_at
        FROM customer LEFT JOIN (SELECT o_custkey, max(epoch_us(o_orderdate)) AS last_read_at FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)
"""


@_query(_SHELF + "SELECT book_id, title, last_read_at FROM shelf ORDER BY last_read_at DESC NULLS LAST, book_id LIMIT 12")
def shelf_recent(spark, sf_dir):
    return B.recent(_shelf(spark, sf_dir), 0).select("book_id", "title", "last_read_at")


@_query(_SHELF + "SELECT DISTINCT trim(group_name) AS group_name FROM shelf WHERE trim(group_name) <> ''")
def shelf_groups(spark, sf_dir):
    return B.groups(_shelf(spark, sf_dir))


@_query(_SHELF + "SELECT book_id, title FROM shelf WHERE trim(group_name) = 'BUILDING'")
def shelf_group(spark, sf_dir):
    return B.of_group(_shelf(spark, sf_dir), "BUILDING").select("book_id", "title")


@_query(_SHELF + "SELECT book_id, title FROM shelf WHERE group_name IS NULL OR trim(group_name) = ''")
def shelf_ungrouped(spark, sf_dir):
    return B.ungrouped(_shelf(spark, sf_dir)).select("book_id", "title")


@_query(_SHELF + "SELECT coalesce(nullif(trim(group_name), ''), '-') AS group_name, count(*) AS books, count(last_read_at) AS read FROM shelf GROUP BY 1")
def shelf_counts(spark, sf_dir):
    name = F.coalesce(X.normalised_name(F.col("group_name")), F.lit("-")).alias("group_name")
    return _shelf(spark, sf_dir).groupBy(name).agg(F.count("*").alias("books"), F.count("last_read_at").alias("read"))


def _bookmarks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_suppkey") % 50).alias("book_id"), F.col("l_linenumber").alias("chapter_index"), F.col("l_discount").alias("ratio"), F.col("l_orderkey").alias("created_at"))


_BOOKMARKS = "WITH bookmarks AS (SELECT l_suppkey % 50 AS book_id, l_linenumber AS chapter_index, l_discount AS ratio, l_orderkey AS created_at FROM lineitem)"


@_query(_BOOKMARKS + "SELECT ratio, created_at FROM bookmarks WHERE book_id = 3 AND chapter_index = 2 AND abs(ratio - 0.045) <= 0.02 ORDER BY ratio, created_at LIMIT 1")
def bookmark_near(spark, sf_dir):
    return B.near(_bookmarks(spark, sf_dir), 3, 2, 0.045).select("ratio", "created_at")


@_query(
    _BOOKMARKS
    + """
    , places AS (SELECT o_orderkey AS place_id, o_custkey % 50 AS book_id, CAST(o_orderkey % 7 + 1 AS INTEGER) AS chapter_index, (o_orderkey % 97) / 900.0 AS place FROM orders)
    SELECT place_id, b.ratio AS ratio, b.created_at AS created_at FROM
        (SELECT place_id, min(struct_pack(ratio := ratio, created_at := created_at)) AS b FROM places JOIN bookmarks USING (book_id, chapter_index) WHERE abs(ratio - CAST(place AS DOUBLE)) <= 0.02 GROUP BY place_id)"""
)
def bookmarks_near_all(spark, sf_dir):
    places = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place_id"), (F.col("o_custkey") % 50).alias("book_id"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("chapter_index"), ((F.col("o_orderkey") % 97) / 900.0).alias("ratio"))
    return B.near_all(_bookmarks(spark, sf_dir), places)


@_query(_SHELF + "SELECT book_id, title, CASE WHEN CAST(book_id AS BIGINT) IN (1, 2, 3, 7) THEN 'to read' ELSE group_name END AS group_name FROM shelf")
def shelf_set_group(spark, sf_dir):
    return B.with_group(_shelf(spark, sf_dir), ["1", "2", "3", "7"], " to read ").select("book_id", "title", "group_name")


@_query(_SHELF + ", progress AS (SELECT CAST(user_id AS VARCHAR) AS book_id, max(epoch_us(ts)) AS last_read_at FROM events GROUP BY user_id) SELECT book_id, title, coalesce(p.last_read_at, s.last_read_at) AS last_read_at FROM shelf s LEFT JOIN progress p USING (book_id)")
def shelf_progress(spark, sf_dir):
    progress = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("book_id")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_read_at"))
    return B.shelf(B.with_progress(_shelf(spark, sf_dir), progress)).select("book_id", "title", "last_read_at")


@_query("SELECT o_orderkey, o_custkey AS book_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def shelf_forgotten(spark, sf_dir):
    """What is left of a dependent table (orders for bookmarks) when a group of books is forgotten."""
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), "c_mktsegment")
    marks = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("book_id"))
    return B.forgotten(books.filter("c_mktsegment = 'BUILDING'"), books, marks)[1]


_RAW = "CASE user_id % 5 WHEN 0 THEN ' 12 ' WHEN 1 THEN 'x' WHEN 2 THEN '2.5' WHEN 3 THEN 'NaN' ELSE NULL END"


@_query("SELECT event_id, CAST(CASE user_id % 5 WHEN 0 THEN 12 ELSE 18 END AS INTEGER) AS size, CAST(CASE user_id % 5 WHEN 0 THEN 2.0 WHEN 2 THEN 2.0 ELSE 1.5 END AS DOUBLE) AS spacing FROM events")
def settings_parsed(spark, sf_dir):
    raw = F.expr(_RAW)
    return table(spark, sf_dir, "events").select("event_id", B.whole_or(raw, 18).alias("size"), B.clamped(B.decimal_or(raw, 1.5), 1.0, 2.0).alias("spacing"))


@_query("""
    WITH m AS (SELECT event_id, (event_id * 7919) % 20000000 AS ms, (event_id % 201) / 200.0 AS r, event_id % 4 AS k FROM events)
    SELECT event_id, CASE WHEN ms <= 0 THEN '' WHEN ms < 60000 THEN '不足 1 分钟' WHEN ms < 3600000 THEN (ms // 60000) || ' 分钟' WHEN ms // 60000 % 60 = 0 THEN (ms // 3600000) || ' 小时' ELSE (ms // 3600000) || ' 小时 ' || (ms // 60000 % 60) || ' 分' END AS reading_time,
           (CASE WHEN k = 0 THEN '第 ' || (k + 1) || ' 章' ELSE 'c' || k END) || '  ·  章内 ' || CAST(floor(CAST(r AS DOUBLE) * 100 + 0.5) AS INTEGER) || '%' AS bookmark FROM m""")
def labels_shown(spark, sf_dir):
    k = F.col("event_id") % 4
    title = F.when(k == 0, " ").otherwise(F.concat(F.lit("c"), k))
    return table(spark, sf_dir, "events").select("event_id", B.reading_time_label(F.col("event_id") * 7919 % 20_000_000).alias("reading_time"), B.bookmark_label(title, k, F.col("event_id") % 201 / 200.0).alias("bookmark"))


@_query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def progress_latest(spark, sf_dir):
    return B.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@_query("""
    WITH old AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey, upper(c_name) AS c_name, -c_acctbal AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
    SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)
    UNION ALL SELECT n.c_custkey, n.c_name, CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal ELSE o.c_acctbal END FROM new n LEFT JOIN old o USING (c_custkey)""")
def shelf_upsert(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = customers.filter("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (-F.col("c_acctbal")).alias("c_acctbal"))
    return B.upsert(customers.filter("c_custkey % 3 <> 0"), new, "c_custkey", ("c_acctbal",))


@_query("SELECT user_id, max(CASE WHEN event_type = 'view' THEN value END) AS view, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM events GROUP BY user_id")
def settings_pivot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.max("value"))


_SEGMENTS = """
    WITH gaps AS (SELECT user_id, epoch_us(ts) AS started_at, CAST(floor((lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1000000) AS BIGINT) AS seconds FROM events),
    segments AS (SELECT user_id, started_at, least(seconds, 86400) AS seconds FROM gaps WHERE seconds >= 30)
"""


@_query(_SEGMENTS + "SELECT * FROM segments")
def reading_segments(spark, sf_dir):
    return B.reading_segments(table(spark, sf_dir, "events"))


@_query(_SEGMENTS + "SELECT user_id, count(*) AS segments, CAST(sum(seconds) AS BIGINT) AS seconds FROM segments GROUP BY user_id")
def reading_totals(spark, sf_dir):
    return B.reading_segments(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("segments"), F.sum("seconds").alias("seconds"))


_META = """
    WITH books AS (SELECT doc_id AS book_id, CAST(n_chars AS VARCHAR) AS fingerprint FROM documents),
    meta AS (SELECT doc_id * 2 AS book_id, CAST(n_chars AS VARCHAR) AS fingerprint, CAST(quality AS INTEGER) AS tokenizer_version FROM documents JOIN labels USING (doc_id))
"""


def _books_and_meta(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("string").alias("fingerprint"))
    meta = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("tokenizer_version")), "doc_id")
    return docs.withColumnRenamed("doc_id", "book_id"), meta.withColumn("doc_id", F.col("doc_id") * 2).withColumnRenamed("doc_id", "book_id")


@_query(_META + "SELECT book_id FROM books WHERE book_id IN (SELECT book_id FROM meta)")
def index_searchable(spark, sf_dir):
    return B.searchable(*_books_and_meta(spark, sf_dir)).select("book_id")


@_query(_META + "SELECT book_id FROM meta WHERE book_id NOT IN (SELECT book_id FROM books)")
def index_orphans(spark, sf_dir):
    return B.orphans(*_books_and_meta(spark, sf_dir)).select("book_id")


@_query(_META + "SELECT book_id FROM books b WHERE NOT EXISTS (SELECT 1 FROM meta m WHERE m.book_id = b.book_id AND m.fingerprint = b.fingerprint AND tokenizer_version = 1)")
def index_pending(spark, sf_dir):
    return B.pending(*_books_and_meta(spark, sf_dir)).select("book_id")


@_query("""
    SELECT doc_id AS book_id FROM documents JOIN pages ON page_id = doc_id
    WHERE NOT (page_id % 3 = 0 AND page_id % 2 = 0)""")
def index_pending_files(spark, sf_dir):
    """Books (documents) whose file (a page of their id) is there and whose index is missing, of another file, or of another tokenizer."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.concat(F.lit("f"), "doc_id").alias("path"))
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("f"), "page_id").alias("path"), F.length("html").cast("string").alias("fingerprint"))
    meta = files.filter("page_id % 3 < 2").select(F.col("page_id").alias("book_id"), F.when(F.col("page_id") % 3 == 0, F.col("fingerprint")).otherwise("old").alias("fingerprint"), (F.col("page_id") % 2 + 1).alias("tokenizer_version"))
    return B.pending(own, meta, files=files).select("book_id")


@_query("""
    WITH j AS (SELECT 'f' || doc_id AS path, quality IS NOT NULL AS old, n_chars < 60 AS failed FROM documents LEFT JOIN labels USING (doc_id))
    SELECT count(*) AS scanned, count(*) FILTER (old) AS skipped, count(*) FILTER (NOT old AND NOT failed) AS imported, count(*) FILTER (NOT old AND failed) AS failed, true AS truncated,
           coalesce(string_agg(path || ' too short', ',' ORDER BY path) FILTER (NOT old AND failed), '') AS failures FROM j""")
def import_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.concat(F.lit("f"), "doc_id").alias("path"), F.lit(True).alias("truncated"), F.when(F.col("n_chars") < 60, "too short").alias("error"))
    report = books.import_report(docs.drop("error"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("book_id")), docs.select("book_id", "error"))
    return report.withColumn("failures", F.array_join(F.transform("failures", lambda f: F.concat(f["path"], F.lit(" "), f["reason"])), ","))


@_query("SELECT page_id, substr(sha256(url), 1, 16) AS book_id FROM pages")
def book_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.book_id(F.col("url")).alias("book_id"))


@_query("SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ':' || CAST(epoch_ms(o_orderdate) AS VARCHAR) AS fingerprint FROM orders")
def fingerprints(spark, sf_dir):
    size = F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.fingerprint(size, F.col("o_orderdate").cast("timestamp")).alias("fingerprint"))


@_query("""
    WITH shelf AS (SELECT CAST(c_custkey AS VARCHAR) AS book_id, c_name AS title FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 3 <> 0
                   UNION ALL SELECT CAST(c_custkey AS VARCHAR), upper(c_name) FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 3 = 0)
    SELECT 'book' AS kind, book_id, title AS value FROM shelf
    UNION ALL SELECT 'bookmark', book_id, CASE WHEN o_orderkey % 4 = 1 THEN 'noted' ELSE o_orderpriority END FROM orders JOIN shelf ON book_id = CAST(o_custkey AS VARCHAR)
    UNION ALL SELECT 'session', book_id, CAST(event_id AS VARCHAR) FROM events JOIN shelf ON book_id = CAST(user_id AS VARCHAR)""")
def library_committed(spark, sf_dir):
    """The library's tables after books, bookmarks and sessions have been put in, notes set, and a group of books forgotten with all that depends on it, each in a commit."""
    path, customers, orders = new_folder(spark, "library"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    shelf = customers.select(F.col("c_custkey").cast("string").alias("book_id"), F.col("c_name").alias("title"))
    marks = orders.select(F.col("o_custkey").cast("string").alias("book_id"), F.lit(0).alias("chapter_index"), F.col("o_orderkey").cast("long").alias("created_at"))
    T.save_books(spark, path, shelf)
    T.save_books(spark, path, shelf.filter("book_id % 3 = 0").withColumn("title", F.upper("title")))
    T.add_rows(spark, path, "bookmarks", marks.join(orders.select(F.col("o_orderkey").alias("created_at"), F.col("o_orderpriority").alias("note")), "created_at"))
    T.add_rows(spark, path, "sessions", table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("book_id"), F.col("event_id").cast("long").alias("seconds")))
    T.set_note(spark, path, marks.filter("created_at % 4 = 1").withColumn("note", F.lit(" noted ")))
    last = T.forget(spark, path, customers.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("book_id")))
    of = lambda name, kind, value: last.table(name).select(F.lit(kind).alias("kind"), "book_id", F.col(value).cast("string").alias("value"))
    return of("books", "book", "title").unionByName(of("bookmarks", "bookmark", "note")).unionByName(of("sessions", "session", "seconds"))


@_query("""
    WITH gaps AS (SELECT user_id, event_type AS book_id, epoch_us(ts) AS started_at, CAST(floor((lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1000000) AS BIGINT) AS seconds FROM events)
    SELECT user_id, book_id, started_at, least(seconds, 86400) AS seconds FROM gaps WHERE seconds >= 30""")
def reading_stream(spark, sf_dir):
    """Reading time from a stream of openings (the event's type is the book) that is stopped and started again between its parts."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("book_id"))
    folder, days = new_folder(spark, "openings"), F.unix_date(F.col("ts").cast("date"))
    first, last = events.agg(F.min(days), F.max(days)).first()
    parts = 3
    for n in range(parts):
        own = F.floor((days - first) * parts / (last - first + 1)) == n
        events.filter(own).write.mode("append").parquet(f"{folder}/in")
        reading.run(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(reading.SEGMENTS).parquet(f"{folder}/out")


# Chapters and texts

_LENGTHS = "WITH c AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chapter_index, n_chars AS length FROM documents)"


@_query(
    _LENGTHS
    + """
    SELECT book_id, chapter_index, start_at, start_at + length AS end_at, CASE WHEN total > 0 THEN round(least(1.0, (start_at + length // 2) / total), 6) ELSE 0.0 END AS ratio
    FROM (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY book_id ORDER BY chapter_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at, CAST(sum(length) OVER (PARTITION BY book_id) AS BIGINT) AS total FROM c)"""
)
def whole_book_ratio(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id", F.col("n_chars").alias("length"))
    return B.whole_book_ratio(numbered(docs, "book_id", "doc_id", "chapter_index"))


@_query(
    _LENGTHS.replace("n_chars AS length", "n_chars AS length, (doc_id % 11) / 10.0 AS r")
    + """
    SELECT book_id, chapter_index, start_at, start_at + length AS end_at, CASE WHEN total > 0 THEN round(least(1.0, (start_at + floor(CAST(r AS DOUBLE) * length + 0.5)) / total), 6) ELSE 0.0 END AS ratio
    FROM (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY book_id ORDER BY chapter_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at, CAST(sum(length) OVER (PARTITION BY book_id) AS BIGINT) AS total FROM c)"""
)
def place_in_book(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id", F.col("n_chars").alias("length"))
    return B.whole_book_ratio(numbered(docs, "book_id", "doc_id", "chapter_index"), F.col("doc_id") % 11 / 10.0)


@_query("SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^﻿', ''), '\\r\\n?', chr(10), 'g'), '(?m)[ \\t\\x{3000}]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS sha FROM documents")
def clean_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.clean(F.col("text")), 256).alias("sha"))


@_query("""
    SELECT doc_id, paragraph_index, length(line) AS chars FROM (
        SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS paragraph_index FROM (
            SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\\s\\x{3000}]+|[\\s\\x{3000}]+$', '', 'g')) AS l FROM documents)) WHERE line <> '')""")
def paragraphs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.lit(0).alias("chapter_index"), "text")
    return A.paragraphs(docs).select(F.col("book_id").alias("doc_id"), F.col("paragraph_index").cast("long").alias("paragraph_index"), F.length("text").cast("long").alias("chars"))


@_query("SELECT min(doc_id) AS pos, doc_id % 5 AS question_id, source AS book_id, n_chars % 7 AS chapter_index, n_chars % 3 AS paragraph_index FROM documents GROUP BY doc_id % 5, source, n_chars % 7, n_chars % 3")
def dedupe_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("pos"), (F.col("doc_id") % 5).alias("question_id"), F.col("source").alias("book_id"), (F.col("n_chars") % 7).alias("chapter_index"), (F.col("n_chars") % 3).alias("paragraph_index"))
    return A.deduplicated(rows)


@_query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def equal_texts(spark, sf_dir):
    # a hash stands for the text, so that no text is shuffled
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return hashed.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@_query("""
    WITH candidates AS (SELECT source AS book_id, doc_id AS line_no, n_chars < 1500 AS dense0, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS from_last FROM documents),
    d AS (SELECT book_id, line_no, dense0 AND from_last > 1 AS dense FROM candidates),
    r AS (SELECT *, coalesce(sum(CAST(NOT dense AS INTEGER)) OVER (PARTITION BY book_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM d),
    l AS (SELECT *, sum(CAST(dense AS INTEGER)) OVER (PARTITION BY book_id, run) AS length FROM r)
    SELECT book_id, line_no FROM l WHERE NOT dense OR length < 4""")
def contents_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("line_no"), "n_chars")
    before = F.sum(F.when(F.col("n_chars") < 1500, 1).otherwise(3)).over(Window.partitionBy("book_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return H.without_contents(docs.select("book_id", "line_no", F.coalesce(before, F.lit(0)).alias("filled"))).select("book_id", "line_no")


@_query("""
    SELECT book_id, line_no, volume FROM (
        SELECT source AS book_id, doc_id AS line_no, doc_id % 10 = 0 AS is_volume, last_value(CASE WHEN doc_id % 10 = 0 THEN 'v' || doc_id END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS volume FROM documents)
    WHERE NOT is_volume""")
def volumes(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 10 == 0, "VOLUME").otherwise("CHAPTER")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("line_no"), kind.alias("kind"), F.concat(F.lit("v"), "doc_id").alias("title"))
    return H.with_volumes(rows).select("book_id", "line_no", "volume")


@_query("""
    WITH c AS (SELECT source AS book_id, doc_id AS chapter_index, CASE WHEN doc_id % 30 < 20 THEN 'v' || (doc_id // 200) END AS volume FROM documents)
    SELECT *, volume IS NOT NULL AND volume IS DISTINCT FROM lag(volume) OVER (PARTITION BY book_id ORDER BY chapter_index) AS new_volume FROM c""")
def volume_starts(spark, sf_dir):
    volume = F.when(F.col("doc_id") % 30 < 20, F.concat(F.lit("v"), F.floor(F.col("doc_id") / 200).cast("string")))
    return H.starts_new_volume(table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_index"), volume.alias("volume")))


# Pages


@_query(r"""
    SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s\x{3000}\x{00A0}]+', ' ', 'g'))) AS sha FROM pages""")
def stripped_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.strip_tags(F.col("html")), 256).alias("sha"))


@_query()
def page_blocks(spark, sf_dir):
    return books.blocks(table(spark, sf_dir, "pages"))


# Questions and answers


_CITED = "coalesce(text, '') || ' [' || turn || '][' || (turn % 3) || '][' || turn || ']'"


@_query(f"""
    SELECT conv_id, turn, array_to_string(list_distinct_ordered, ',') AS refs FROM (
        SELECT conv_id, turn, list_transform(list_filter(list_zip(r, range(1, len(r) + 1)), lambda p: list_position(r, p[1]) = p[2]), lambda p: p[1])[1:12] AS list_distinct_ordered
        FROM (SELECT conv_id, turn, list_transform(regexp_extract_all({_CITED}, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)) AS r FROM conversations))""")
def citations_extracted(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    cited = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), F.col("turn"), F.lit("]["), F.col("turn") % 3, F.lit("]["), F.col("turn"), F.lit("]"))
    return turns.select("conv_id", "turn", F.array_join(A.citations(cited), ",").alias("refs"))


def _questions(spark):
    return spark.createDataFrame([(1, "market price"), (2, "the committee")], "question_id int, question string")


@_query("""
    WITH q AS (SELECT * FROM (VALUES (1, 'market', 'price'), (2, 'the', 'committee')) AS v(question_id, a, b)),
    p AS (SELECT doc_id, n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) WHERE line <> ''),
    s AS (SELECT question_id, doc_id, n, CAST((length(line) - length(replace(line, a, ''))) / length(a) + (length(line) - length(replace(line, b, ''))) / length(b) AS BIGINT) AS score FROM p, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, n) AS rank FROM s)
    SELECT question_id, doc_id, n, score, rank FROM r WHERE rank <= 50""")
def paragraphs_ranked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).filter("text <> ''").withColumn("n", (F.col("n") + 1).cast("long"))
    asked = _questions(spark).select("question_id", F.split("question", " ").alias("terms"))
    # two questions
    scored = lines.join(F.broadcast(asked)).withColumn("score", F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + A.occurrences(F.col("text"), t)))
    best = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id", "n"))
    return scored.withColumn("rank", best).filter("rank <= 50").select("question_id", "doc_id", "n", "score", "rank")


def _asked(spark, sf_dir):
    """A question of each benchmark item: its first two words of letters, and a question word."""
    words = F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(words, F.lit("在哪里？")).alias("question"))


_PIECES = "list_filter(flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform([4, 3, 2], lambda n: CASE WHEN i + n - 1 <= length(k) THEN substr(k, CAST(i AS INTEGER), CAST(n AS INTEGER)) END))), lambda p: p IS NOT NULL AND NOT contains(p, ' '))"
_COUNT = "CAST((length(line) - length(replace(line, {0}, ''))) / length({0}) AS BIGINT)"
_CHOSEN = f"""
    , q AS (SELECT item_id AS question_id, regexp_extract(text, '[A-Za-z]+ [A-Za-z]+') AS k FROM benchmark),
    ladder AS (SELECT question_id, k, CASE WHEN k = '' THEN [] ELSE list_concat([k], {_PIECES}) END AS l FROM q),
    terms AS (SELECT question_id, term, min(place) AS place FROM (SELECT question_id, unnest(l) AS term, unnest(range(0, len(l))) AS place FROM ladder) GROUP BY question_id, term),
    capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place) AS n FROM terms) WHERE n <= 12),
    own AS (SELECT term, list_transform(regexp_extract_all(term, '[A-Za-z0-9]+'), lambda t: lower(t)) AS need FROM (SELECT DISTINCT term FROM capped)),
    met AS (SELECT term, book_id, chapter_index, row_number() OVER (PARTITION BY term ORDER BY book_id, chapter_index) AS nth FROM own JOIN tokens ON len(need) > 0 AND list_has_all(tokens, need) AND contains(lower(text), lower(term))),
    firsts AS (SELECT question_id, book_id, chapter_index, min(place) AS place FROM capped JOIN met USING (term) WHERE nth <= 40 GROUP BY question_id, book_id, chapter_index),
    recalled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place, book_id, chapter_index) AS n FROM firsts) WHERE n <= 4),
    lines AS (SELECT book_id, chapter_index, n, regexp_replace(line, '^[\\s\\x{{3000}}]+|[\\s\\x{{3000}}]+$', '', 'g') AS line FROM
        (SELECT book_id, chapter_index, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM chapters)),
    paragraphs AS (SELECT book_id, chapter_index, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY n) - 1 AS paragraph_index, line FROM lines WHERE line <> ''),
    chunks AS (SELECT * FROM (SELECT question_id, book_id, chapter_index, paragraph_index, line AS whole, row_number() OVER (PARTITION BY question_id ORDER BY book_id, chapter_index, paragraph_index) - 1 AS pos FROM recalled JOIN paragraphs USING (book_id, chapter_index)) WHERE pos < 200),
    clipped AS (SELECT *, CASE WHEN length(whole) > 1200 THEN substr(whole, 1, 1200) || '…' ELSE whole END AS line FROM chunks),
    words AS (SELECT question_id, list_distinct(list_filter(string_split(k, ' '), lambda w: length(w) >= 2)) AS w FROM q),
    scored AS (SELECT *, coalesce(CAST(list_sum(list_transform(w, lambda x: {_COUNT.format('x')})) AS BIGINT), 0) AS score FROM clipped JOIN words USING (question_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos) AS rank FROM scored),
    spread AS (SELECT *, row_number() OVER (PARTITION BY question_id, book_id, chapter_index ORDER BY rank) AS nth, min(rank) OVER (PARTITION BY question_id, book_id, chapter_index) AS best FROM ranked),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CAST(nth > 2 AS INTEGER), best, rank) AS number FROM spread) WHERE number <= 8)
"""


def _indexed(spark, sf_dir):
    path, own = new_folder(spark, "index"), stored(chapters(spark, sf_dir), "chapters")
    I.index_books(own, path, zone=256)
    return path, own


@_query(_CHAPTERS.rstrip() + _CHOSEN + "SELECT question_id, CAST(number AS INTEGER) AS number, book_id, chapter_index, CAST(paragraph_index AS INTEGER) AS paragraph_index, score FROM chosen")
def ask_selected(spark, sf_dir):
    """The chunks that go into each question's context, recalled by an index."""
    questions, (path, own) = _asked(spark, sf_dir), _indexed(spark, sf_dir)
    recalled = A.recall_by_index(spark, path, A.ladders(questions), S.texts_of(own))
    chosen = A.selected(A.chunks(recalled, own), questions)
    return chosen.select("question_id", "number", "book_id", "chapter_index", "paragraph_index", "score")


@_query(
    _CHAPTERS.rstrip()
    + _CHOSEN
    + """
    SELECT question_id, coalesce(n, 0) AS n_chunks, CASE WHEN n IS NULL THEN '' WHEN n = 1 THEN 'See [1].' ELSE 'See [1]. And [2]!' END AS answer, CASE WHEN n IS NULL THEN 'no-chunks' ELSE 'ok' END AS outcome,
           CASE WHEN n IS NULL THEN '' WHEN n = 1 THEN '1' ELSE '1,2' END AS refs
    FROM q LEFT JOIN (SELECT question_id, count(*) AS n FROM chosen GROUP BY question_id) USING (question_id)"""
)
def ask_answers(spark, sf_dir):
    """Whole questions and answers, with a stand-in for the model that cites the first two chunks and one that is not there."""
    questions, (path, own) = _asked(spark, sf_dir), _indexed(spark, sf_dir)
    answers, _ = A.ask(questions, own, lambda prompts: prompts.select("question_id", F.concat(F.lit("See [1]. And [2]! Nothing here. Not there [99]."), F.substring("context", 1, 0)).alias("raw")), index_path=path)
    return answers.select("question_id", "n_chunks", "answer", "outcome", F.array_join("refs", ",").alias("refs"))


@_query("""
    WITH q AS (SELECT DISTINCT conv_id AS question_id FROM conversations), r AS (SELECT conv_id AS question_id, turn % 3 AS book_id FROM conversations WHERE role = 'user')
    SELECT question_id, CAST(question_id % 4 AS BIGINT) AS searched_books, count(DISTINCT book_id) AS indexed_books, count(book_id) AS hits FROM q LEFT JOIN r USING (question_id) GROUP BY question_id""")
def ask_coverage(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "question_id")
    asked = turns.select("question_id").distinct().withColumn("book_ids", F.expr("transform(filter(sequence(1, 4), i -> i <= question_id % 4), i -> string(i))"))
    return A.ask_coverage(asked, turns.filter("role = 'user'").select("question_id", (F.col("turn") % 3).alias("book_id")))


# Sessions


@_query("""
    WITH g AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
    s AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g)
    SELECT user_id, min(us) AS started_at, max(us) + 1800000000 AS ended_at, count(*) AS events FROM s GROUP BY user_id, n""")
def reading_sessions(spark, sf_dir):
    return incremental.sessions(table(spark, sf_dir, "events"))


# Vectors: an extension for recall by meaning

#: Rows to a block, on either side.
VECTOR_BLOCK = 32768


@_query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS cosine FROM q, embeddings WHERE vec_id <> query_id)
    SELECT query_id, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def vector_recall(spark, sf_dir):
    """The three rows nearest to each row whose id is divisible by 50, by cosine: blocks of queries meet blocks of rows, each pair of blocks keeps its best, and those are merged."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return V.nearest(own, own.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 3, VECTOR_BLOCK)


@_query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
    v AS (SELECT query_id, vec_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) DESC, vec_id) AS rank FROM q, embeddings WHERE vec_id <> query_id),
    w AS (SELECT doc_id, source, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents),
    k AS (SELECT query_id, i.doc_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY i.n DESC, i.doc_id) AS rank FROM q JOIN w o ON o.doc_id = query_id JOIN w i ON i.source = o.source),
    r AS (SELECT query_id, item_id, rank FROM v WHERE rank <= 3 UNION ALL SELECT query_id, item_id, rank FROM k WHERE rank <= 5),
    s AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS best FROM r GROUP BY query_id, item_id)
    SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, item_id) AS INTEGER) AS rank FROM s""")
def ranks_fused(spark, sf_dir):
    """For each question (a vector, and the source of the document of its id): the nearest vectors and the source's documents with most of a word, fused by their ranks."""
    near = vector_recall(spark, sf_dir).select("query_id", F.lit("vector").alias("list"), F.col("vec_id").alias("item_id"), "rank")
    counted = table(spark, sf_dir, "documents").select("doc_id", "source", A.occurrences(F.col("text"), F.lit("the")).alias("n"))
    # the five first documents of a source are the same for all its questions
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "doc_id"))).filter("rank <= 5").select("source", F.col("doc_id").alias("item_id"), "rank")
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")).join(counted.select(F.col("doc_id").alias("query_id"), "source"), "query_id")
    keyword = asked.join(best, "source").select("query_id", F.lit("keyword").alias("list"), "item_id", "rank")
    return B.fused(near.unionByName(keyword)).withColumn("score", F.round("score", 9))


def queries() -> dict:
    return _QUERIES | chinese_rows.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | chinese_rows.SQL
