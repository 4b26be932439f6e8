"""Blocks of chapters, titles of chunks, what is said about a search, and books whose files are gone."""

from __future__ import annotations

from lectern.operators import ask, chapters, library, search

CHAPTERS = "book_id string, chapter_index long, title string, text string"


def test_heading_of_the_chapter_alone_is_one(spark):
    rows = [
        ("b", 0, "第一章 起", "\n　第一章 起 \n\n正文\n第二章 落\n第一章 起"),
        ("b", 1, "第二章 落", "第一章 起\n正文"),
        ("b", 2, None, "第一章 起"),
        ("b", 3, "", "第一章 起"),
        ("b", 4, "起", "起\n正文"),
        ("b", 5, "x", None),
        ("b", 6, "x", " \n\u3000\n"),
    ]
    found = chapters.blocks(spark.createDataFrame(rows, CHAPTERS)).orderBy("chapter_index", "n").collect()
    assert [(r.chapter_index, r.n, r.kind, r.value, r.paragraph_index) for r in found] == [
        (0, 0, "heading", "第一章 起", None), (0, 1, "paragraph", "正文", 0), (0, 2, "paragraph", "第二章 落", 1), (0, 3, "paragraph", "第一章 起", 2),
        (1, 0, "paragraph", "第一章 起", 0), (1, 1, "paragraph", "正文", 1),
        (2, 0, "paragraph", "第一章 起", 0), (3, 0, "paragraph", "第一章 起", 0), (4, 0, "paragraph", "起", 0), (4, 1, "paragraph", "正文", 1),
    ]


def test_chunks_and_citations_have_their_titles(spark):
    own = spark.createDataFrame([("b", 0, "第一章 起", "第一章 起\n林动 来\n别的"), ("b", 1, None, "林动 去")], CHAPTERS)
    questions = spark.createDataFrame([(1, "林动在哪里？")], "question_id long, question string")
    books = spark.createDataFrame([("b", "武")], "book_id string, title string")
    model = lambda asked: asked.selectExpr("question_id", "'他来了[1]。他去了[2]。' as raw")
    answers, chosen = ask.ask(questions, own, model, books=books)
    assert {(r.number, r.chapter_title, r.paragraph_index, r.text) for r in chosen.collect()} == {(1, "第一章 起", 0, "林动 来"), (2, "第一章 起", 1, "别的"), (3, "", 0, "林动 去")}
    cited = ask.citation_rows(answers, ask.with_titles(chosen, books)).orderBy("number").collect()
    assert [r.book_title for r in cited] == ["武", "武"] and cited[0].chapter_title == "第一章 起" and cited[0].paragraph_index == 0


RESULTS = "query string, library_books long, indexed_books long, searched_books long, hits long, hit_books long, unchecked long, truncated boolean, elapsed_ms long"


def test_messages(spark):
    rows = {
        ("a", 0, 0, 0, 0, 0, 0, False, 3): "书库还是空的，先导入几本书再来搜。",
        ("b", 5, 0, 0, 0, 0, 0, False, 3): "书库里有 5 本书，一本都还没有建立索引，所以搜不到任何内容。建立索引后才能搜。",
        ("c", 5, 5, 5, 0, 0, 0, False, 3): "已搜索 5 本书，没有找到「c」    ·    耗时 3 ms",
        ("d", 5, 3, 3, 7, 2, 0, False, 3): "找到 7 章，来自 2 本书    ·    还有 2 本没建索引，没被搜索    ·    耗时 3 ms",
        ("e", 5, 5, 4, 7, 2, 9, True, 3): "找到 7 章，来自 2 本书（已截断，另有 9 章未校验、1 本书没轮到）    ·    耗时 3 ms",
        (None, 2, 2, 2, None, None, None, None, None): "已搜索 2 本书，没有找到「」    ·    耗时 0 ms",
    }
    found = search.with_message(spark.createDataFrame(list(rows), RESULTS)).collect()
    assert {r.query: r.message for r in found} == {k[0]: v for k, v in rows.items()}


def test_coverage_of_an_empty_library(spark):
    none = spark.createDataFrame([], "book_id string")
    one = spark.createDataFrame([("a",)], "book_id string")
    assert [search.coverage(x, none, none).first().coverage for x in (none, one)] == ["FULL", "NONE"]


def test_pending_by_files(spark):
    books = spark.createDataFrame([("a", "/a", "1"), ("b", "/b", "1"), ("c", "/c", "1"), ("d", None, "1")], "book_id string, path string, fingerprint string")
    meta = spark.createDataFrame([("a", "2", 1), ("b", "1", 1)], "book_id string, fingerprint string, tokenizer_version int")
    files = spark.createDataFrame([("/a", "2"), ("/b", "2"), ("/b", "2"), ("/x", "1")], "path string, fingerprint string")
    # the file of b has changed, that of c is gone, d has none
    assert [r.book_id for r in library.pending(books, meta, files=files).collect()] == ["b"]
    assert sorted(r.book_id for r in library.pending(books, meta).collect()) == ["a", "c", "d"]
