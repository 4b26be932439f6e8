"""Functions and operators on small cases with known results."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import chinese as C
from lectern.functions import text as X
from lectern.operators import ask as A
from lectern.operators import chapters as H
from lectern.operators import index as I
from lectern.operators import library as B
from lectern.operators import search as S
from lectern.operators.ordinals import numbered
from lectern.sources import books, ranges
from lectern.streaming import incremental


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens_stop_at_punctuation(spark):
    assert values(spark, X.tokens, ["石头。符号", "我 JavaFX", "", None]) == [["石头", "符号"], ["我", "javafx"], [], []]


def test_numbers(spark):
    given = {"一": 1, "十三": 13, "一百二": 102, "十二万三千四百五十六": 123456, "1024": 1024, "０７": 7, "贰拾": 20, "一二三": 3, "零十": None, "第": None, "": None, "第 一": None, "二 十": 20}
    assert values(spark, C.number, list(given)) == list(given.values())


def test_headings(spark):
    found = values(spark, C.heading, ["第三章，他离开了这座城", "【第二章 觉醒】", "第三卷 远行", "番外3 雪", "第九章 走！", "第九章 走！快", None])
    assert [f["reason"] for f in found] == ["begins with punctuation", "accepted", "accepted", "accepted", "accepted", "sentence end inside", "blank"]
    assert [(f["kind"], f["number"]) for f in found[1:4]] == [("CHAPTER", 2), ("VOLUME", 3), ("SPECIAL", 3)]


def test_questions(spark):
    assert values(spark, C.question_keyword, ["叶修是谁", "谁知道这件事", "药老是什么来历", "怎么样"]) == ["叶修", "谁知道这件事", "药老来历", "样"]


def test_clean(spark):
    assert values(spark, X.clean, ["﻿a \r\nb　\r\n\r\n\r\n\r\nc"]) == ["a\nb\n\nc"]


def test_false_positive_and_caps(spark):
    chapters = spark.createDataFrame([("b1", 0, "云岚山中有个岚宗派"), ("b1", 1, "云岚宗"), ("b2", 0, "云岚宗与云岚宗"), ("b3", 0, "云岚宗"), ("b3", 1, None)], "book_id string, chapter_index int, text string")
    judged = S.with_hits(S.candidates(chapters, "云岚宗"), "云岚宗")
    assert {(r.book_id, r.chapter_index): r.hit_count for r in judged.collect()} == {("b1", 0): 0, ("b1", 1): 1, ("b2", 0): 2, ("b3", 0): 1}
    one = S.summary(S.capped(judged, limit=2), 3).first()
    assert (one.candidates, one.hits, one.truncated, one.unchecked, one.not_verified, one.searched_books) == (4, 2, True, 2, 1, 2)
    whole = S.summary(S.capped(judged), 3).first()
    assert (whole.hits, whole.truncated, whole.false_positives) == (3, False, 1)
    assert S.candidates(chapters, "，。").count() == 0


def test_display_order(spark):
    titles = spark.createDataFrame([(str(i), t) for i, t in enumerate(["子羽书", "阿澜书", "星尘纪", "沧澜录"])], "book_id string, title string")
    hits = titles.select("book_id", F.lit(0).alias("chapter_index"))
    assert [r.title for r in S.display_order(hits, titles).collect()] == ["阿澜书", "沧澜录", "星尘纪", "子羽书"]


def test_numbered_across_spans(spark):
    rows = [("a", i * 3) for i in range(50)] + [(None, 7), ("b", 1)]
    found = numbered(spark.createDataFrame(rows, "k string, o long"), "k", "o", "n", span=16).collect()
    assert sorted((r.o, r.n) for r in found if r.k == "a") == [(i * 3, i) for i in range(50)]
    assert [r.n for r in found if r.k != "a"] == [0, 0]


def test_library_tables(spark):
    old = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "book_id string, title string, added_at long")
    new = spark.createDataFrame([("b", "B2", 9), ("c", "C", 9)], old.schema)
    assert sorted(map(tuple, B.upsert(old, new, "book_id", ("added_at",)).collect())) == [("a", "A", 1), ("b", "B2", 2), ("c", "C", 9)]
    assert B.migrated(old, B.BOOK).first().group_name is None
    settings = spark.createDataFrame([("font", "12"), ("other", "x")], B.SETTING)
    assert sorted(map(tuple, B.saved_settings(settings, {"theme": "dark"}, ["font", "theme"]).collect())) == [("other", "x"), ("theme", "dark")]


@pytest.mark.parametrize(("numbers", "kept"), [([1, 2, 9, 3, 4], [0, 1, 3, 4]), ([5, 5], [0]), ([], []), ([3, 2, 1], [2])])
def test_longest_increasing(numbers, kept):
    assert H.longest_increasing(numbers) == kept


@pytest.mark.parametrize("charset", ["utf-8", "gb18030", "utf-16-le", "utf-8-sig"])
def test_text_files(spark, tmp_path, charset):
    body = "开头的话，写上三十个字以上的内容，好让这一段自己成为一章，不然就没有了，对不对。\r\n" + "".join(f"第{n}章 标题{n}\r\n正文的内容在这里，他们说的是一样的话。\n" for n in "一二三四") + "ABC def ghi jkl mno pqr stu vwx yz 0123456789 " * 40
    raw = body.encode(charset)
    (tmp_path / "book.txt").write_bytes(raw)
    lines = books.read_lines(spark, str(tmp_path)).cache()
    chapters = H.split(lines).cache()
    rows = sorted(chapters.collect(), key=lambda r: r.chapter_index)
    assert [r.title for r in rows] == ["开篇", "第一章 标题一", "第二章 标题二", "第三章 标题三", "第四章 标题四"]
    assert all(a.stop == b.start for a, b in zip(rows, rows[1:])) and rows[-1].stop == len(raw)
    plain = charset.removesuffix("-sig")
    assert raw[rows[1].start : rows[1].stop].decode(plain).startswith("第一章")
    texts = {r.chapter_index: r.text for r in books.chapter_texts(lines, chapters).collect()}
    assert texts[1] == "第一章 标题一\n正文的内容在这里，他们说的是一样的话。"
    assert books.scan(spark, str(tmp_path)).first().format == "txt"
    cut = chapters.select("book_id", "chapter_index", "start", (F.col("stop") + F.when(F.col("chapter_index") == 4, 1000).otherwise(0)).alias("stop"))
    assert {r.chapter_index: r.text for r in ranges.chapters(spark, ranges.chapter_ranges(spark, str(tmp_path), cut)).collect()} == texts


def test_offsets_hold_over_broken_bytes(spark, tmp_path):
    for charset, raw in (("gb18030", b"\xb5\xda\xff\n\x81\x30\r\nabc\xfe"), ("utf-8", "é\r\r\n".encode() + b"\xc3\n\n"), ("utf-16-le", "a\nb\r\n\u0a0d\u0d0a".encode("utf-16-le") + b"x"), ("utf-32-be", "a\r\nb".encode("utf-32-be"))):
        rows = list(books.lines_of(raw, charset, 0))
        assert [n for n, *_ in rows] == list(range(len(rows)))
        assert rows[0][1] == 0 and rows[-1][2] == len(raw) and all(a[2] == b[1] for a, b in zip(rows, rows[1:]))
        assert [line for *_, line in rows] == [raw[a:b].decode(charset, "replace").rstrip("\r\n") for _, a, b, _ in rows]
    assert [line for *_, line in books.lines_of("a\nb\r\nc".encode("utf-16-be"), "utf-16-be", 0)] == ["a", "b", "c"]


@pytest.mark.parametrize("charset", ["utf-8", "gb18030"])
def test_inline_headings_split_at_their_bytes(spark, tmp_path, charset):
    body = "".join(f"第{n}章 标题\n正文的内容在这里，他们说的是一样的话。\n" for n in "一二三") + "（求收藏，谢谢大家第四章 冲突\n正文。\n"
    (tmp_path / "book.txt").write_bytes(raw := body.encode(charset) + b" " + "正文里的一句话写得长一点，好认出文字来。".encode(charset))
    lines = books.read_lines(spark, str(tmp_path)).cache()
    last = H.split(lines).orderBy("chapter_index").collect()[-1]
    assert last.title == "第四章 冲突" and raw[last.start :].decode(charset).startswith("第四章 冲突\n")
    report = H.report(lines).first()
    assert (report.headings, report.inline, report.chapters, report.fallback) == (4, 1, 4, False)


def test_titles_of_files(spark, tmp_path):
    (tmp_path / "01.txt").write_bytes("书名：《元尊》\n作者：天蚕土豆』\n第一章 一\n".encode("gb18030") * 20)
    (tmp_path / "《全职高手》（精校版）.txt").write_text("没有别的。\n" * 10)
    rows = {r.title: r.author for r in ranges.metadata(spark, str(tmp_path)).collect()}
    assert rows == {"元尊": "天蚕土豆", "全职高手": None}


def test_import_report(spark, tmp_path):
    for name in ("a.txt", "b.txt", "c.txt", ".d.txt", "e.doc"):
        (tmp_path / name).write_text("x")
    assert {r.truncated for r in books.scan(spark, str(tmp_path)).collect()} == {False}
    scanned = books.scan(spark, str(tmp_path), 2)
    rows = {r.path[-5:]: r for r in scanned.collect()}
    assert set(rows) == {"a.txt", "b.txt"} and all(r.truncated for r in rows.values())
    known = spark.createDataFrame([], "book_id string")
    read = spark.createDataFrame([(rows["a.txt"].book_id, None), (rows["b.txt"].book_id, "no archive")], "book_id string, error string")
    one = books.import_report(scanned, known, read).first()
    assert (one.scanned, one.skipped, one.imported, one.failed, one.truncated, [f.reason for f in one.failures]) == (2, 0, 1, 1, True, ["no archive"])


def test_asking_without_a_model(spark):
    questions = spark.createDataFrame([(1, "叶修是谁")], "question_id int, question string")
    own = spark.createDataFrame([("b", 0, "叶修来了")], "book_id string, chapter_index int, text string")
    assert A.ask(questions, own, None)[0].first().outcome == "not-configured"
    seen = []
    model = lambda asked: (seen.append(asked.first()), asked.select("question_id", F.lit("是他[1]。").alias("raw")))[1]
    answers, _ = A.ask(questions, own, model, books=spark.createDataFrame([("b", "全职高手")], "book_id string, title string"))
    assert answers.first().outcome == "ok" and "《全职高手》第 1 章第 1 段" in seen[0].user_prompt and seen[0].system_prompt.startswith("你是一个")


def test_numerals(spark):
    given = ["一百二十", "十", "", None, "1", "第", "零" * 30]
    assert values(spark, C.is_numeral, given) == [True, True, False, False, False, False, True]
    assert values(spark, lambda x: C.number_or(x, -1), given) == [120, 10, -1, -1, 1, -1, 0]


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><manifest><item id="a" href="a%20b.xhtml"/><item id="b" href="b.xhtml"/><item id="n" href="n.xhtml" properties="nav"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="n" linear="no"/><itemref idref="gone"/></spine></package>')
        z.writestr("O/n.xhtml", '<html><a href="a%20b.xhtml#x">First</a></html>')
        z.writestr("O/a b.xhtml", "<html><head><title>t</title></head><body><h1>One</h1><p>Some <b>text</b><img src='i/p.png'/></p><script>no</script></body></html>")
        z.writestr("O/b.xhtml", "<html><body><h2>Two</h2>loose</body></html>")
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    rows = books.read_epubs(spark, str(tmp_path)).collect()
    good = sorted((r.chapter_index, r.n, r.title, r.kind, r.value) for r in rows if r.error is None)
    assert good == [(0, 0, "First", "heading", "One"), (0, 1, "First", "paragraph", "Some text"), (0, 2, "First", "image", "O/i/p.png"), (1, 0, "Two", "heading", "Two")]
    assert [r.book_id is not None for r in rows if r.error] == [True]


def test_chunks_spread_over_chapters(spark):
    rows = [(1, "b", c, p, f"叶修 {'叶修 ' * k}", c * 3 + p) for c, p, k in ((0, 0, 0), (0, 1, 5), (0, 2, 4), (1, 0, 1), (1, 1, 0), (1, 2, 2))]
    chunks = spark.createDataFrame(rows, "question_id int, book_id string, chapter_index int, paragraph_index int, text string, pos int")
    asked = spark.createDataFrame([(1, "叶修是谁")], "question_id int, question string")
    chosen = sorted((r.number, r.chapter_index, r.paragraph_index) for r in A.selected(chunks, asked, 5).collect())
    assert chosen == [(1, 0, 1), (2, 0, 2), (3, 1, 2), (4, 1, 0), (5, 0, 0)]


def test_streams_give_what_batches_give(spark, tmp_path):
    schema = "book_id string, chapter_index int, text string"
    spark.createDataFrame([("b1", 0, "of the"), ("b2", 0, "the")], schema).write.parquet(str(tmp_path / "in"))
    incremental.index_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "c1")).awaitTermination()
    found = lambda: {r.book_id for r in I.candidates(spark, str(tmp_path / "index"), "of the").collect()}
    assert found() == {"b1"}
    # chapters that come again are searched by their last text
    spark.createDataFrame([("b1", 0, "of it"), ("b2", 0, "of the")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.index_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "c1")).awaitTermination()
    assert found() == {"b2"}
    progress = "book_id string, ts timestamp, ratio double"
    for part, rows in enumerate(([("b1", "2024-01-01 00:00:00", 0.1), ("b1", "2024-01-02 00:00:00", 0.2)], [("b1", "2024-01-01 12:00:00", 0.9), ("b2", "2024-01-01 00:00:00", 0.5)])):
        spark.createDataFrame(rows, "book_id string, ts string, ratio double").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "progress"))
        incremental.progress_stream(spark.readStream.schema(progress).parquet(str(tmp_path / "progress")), str(tmp_path / "latest"), str(tmp_path / "c2")).awaitTermination()
        last = spark.read.parquet(str(tmp_path / "latest" / str(part)))
    assert {r.book_id: r.ratio for r in last.collect()} == {"b1": 0.2, "b2": 0.5}
