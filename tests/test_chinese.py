"""The rules for Chinese text on rows written out, with what has to come of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import chinese as C
from lectern.functions import titles as N
from lectern.operators import ask as A
from lectern.operators import chapters as H

_NUMERALS = ["一", "十", "十三", "二十", "一百二", "一百零五", "三千", "一万", "十二万三千四百五十六", "1024", "０７", "贰拾", "两", "一二三", "第", "", "零十", "二亿", "九十九亿"]

_NUMBERS = [1, 10, 13, 20, 102, 105, 3000, 10000, 123456, 1024, 7, 20, 2, 3, None, None, None, 200000000, None]

_HEADINGS = ["第一章 石符", "【第二章 觉醒】", "第三卷 远行", "楔子", "番外3 雪", "第四章，他离开了这座城", "第十二章 的确", "他说第五章很好看。", "第九章 走！快走", "", "第１０章：风起", "正文"]

_JUDGED = [
    (0, "accepted", 1, "CHAPTER", "石符"), (1, "accepted", 2, "CHAPTER", "觉醒"), (2, "accepted", 3, "VOLUME", "远行"), (3, "accepted", 0, "SPECIAL", ""), (4, "accepted", 3, "SPECIAL", "雪"),
    (5, "begins with punctuation", 4, "CHAPTER", "，他离开了这座城"), (6, "begins with a particle", 12, "CHAPTER", "的确"), (7, "not a heading", 0, "SPECIAL", ""), (8, "sentence end inside", 9, "CHAPTER", "走！快走"),
    (9, "blank", 0, "SPECIAL", ""), (10, "accepted", 10, "CHAPTER", "风起"), (11, "not a heading", 0, "SPECIAL", ""),
]

_BOOK = ["某某小说", "目录"] + [f"第{n}章 标题" for n in "一二三四五"] + ["", "这里是开篇之前的一段文字，写得比三十个字要长一些，好让它自己成为一章。", ""]
for _n, _t in (("一", "起"), ("二", "承"), ("九", "乱"), ("三", "转"), ("四", "合")):
    _BOOK += [f"第{_n}章 {_t}", "正文一行。", "正文又一行。", ""]
_BOOK += ["第二卷 远方", "卷首的话。", "第一章 再起", "正文。", "第二章 再承", "正文。"]

def _book_lines(spark):
    rows, at = [], 0
    for n, line in enumerate(_BOOK):
        size = len(f"{line}\n".encode())
        rows.append(("b1", n, at, at + size, line))
        at += size
    return spark.createDataFrame(rows, "book_id string, line_no long, start long, stop long, line string")


_SPLIT = [
    (0, 88, 213, "第五章 标题", None), (1, 213, 263, "第一章 起", None), (2, 263, 363, "第二章 承", None), (3, 363, 413, "第三章 转", None), (4, 413, 496, "第四章 合", None),
    (5, 496, 523, "第一章 再起", "第二卷 远方"), (6, 523, 550, "第二章 再承", "第二卷 远方"),
]

_HEADS = [
    (0, "01.txt", "《元尊》\n作者：天蚕土豆\n内容"), (1, "斗破苍穹（精校版全本）作者天蚕土豆TXT下载.txt", "没有标题的开头"), (2, "a.txt", "书名：《全职高手》（全本）\n作者: 蝴蝶蓝|全本"),
    (3, "x.txt", "『武动乾坤/作者:天蚕土豆』\n『状态:已完结』"), (4, "《作者之死》.txt", "作者：未知"), (5, ".txt", None), (6, "下载.epub", "作 者：欧·亨利 著"),
]

_TITLES = [(0, "元尊", "天蚕土豆"), (1, "斗破苍穹", None), (2, "全职高手", "蝴蝶蓝"), (3, "武动乾坤", "天蚕土豆"), (4, "作者之死", None), (5, ".txt", None), (6, "下载", "欧·亨利")]

_ENDS = ["（求收藏，求推荐票，麻烦大家了，谢谢第八章冲突", "第八章 冲突", "他在第一回合的交手中，便是败得如此的凄惨？", "没有标题", "他说第三章第四章 云起", "感谢第五章，风起", None]

_QUESTIONS = ["叶修是谁", "谁知道这件事", "药老是什么来历", "云岚宗在哪里？", "", "石符 有什么用", "怎么样"]

_TERMS = [
    (0, "叶修", "叶修", "修是|修是谁|叶修|叶修是|叶修是谁|是谁"),
    (1, "谁知道这件事", "谁知道这件事|谁知道这|谁知道|谁知|知道这件|知道这|道这件事|道这件|道这|件事", "件事|知道|知道这|知道这件|谁知|谁知道|谁知道这|这件|这件事|道这|道这件|道这件事"),
    (2, "药老来历", "药老来历|药老来|药老|老来历|老来|来历", "么来|么来历|什么|什么来|什么来历|是什|是什么|是什么来|来历|老是|老是什|老是什么|药老|药老是|药老是什"),
    (3, "云岚宗", "云岚宗|云岚|岚宗", "云岚|云岚宗|云岚宗在|哪里|在哪|在哪里|宗在|宗在哪|宗在哪里|岚宗|岚宗在|岚宗在哪"),
    (4, "", "", ""),
    (5, "石符 有什么用", "石符 有什么用|石符|么用", "么用|什么|什么用|有什|有什么|有什么用|石符"),
    (6, "样", "样", "么样|怎么|怎么样"),
]

_ANSWERS = [(1, "答案一[1]。没有出处。答案二[2][9]！", 3), (2, "没有引用。", 3), (3, "全是错的[7]。", 3), (4, None, 3), (5, "有[1]", 0), (6, "[2][1][2]好", 2)]

_VALIDATED = [(1, "答案一[1]。答案二[2]！", "ok", "1,2", "9"), (2, "", "invalid-citations", "", ""), (3, "", "invalid-citations", "", "7"), (4, "", "llm-error", "", ""), (5, "", "no-chunks", "", ""), (6, "[2][1][2]好", "ok", "2,1", "")]


def _rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_numbers(spark):
    rows = spark.createDataFrame(list(enumerate(_NUMERALS)), "i int, x string")
    assert [r[1] for r in _rows(rows.select("i", C.number(F.col("x"))), "i")] == _NUMBERS


def test_headings(spark):
    rows = spark.createDataFrame(list(enumerate(_HEADINGS)), "id int, line string").select("id", C.heading(F.col("line")).alias("h"))
    assert _rows(rows.select("id", "h.reason", "h.number", "h.kind", "h.title"), "id") == _JUDGED


def test_split(spark):
    lines = _book_lines(spark).cache()
    assert _rows(H.split(lines).select("chapter_index", "start", "stop", "title", "volume"), "chapter_index") == _SPLIT
    assert [tuple(r) for r in H.report(lines).collect()] == [("b1", 13, 0, 0, 4, 1, 2, 7, False)]


def test_titles_and_authors(spark):
    rows = spark.createDataFrame(_HEADS, "id int, file string, head string")
    assert _rows(rows.select("id", N.title(F.col("head"), F.col("file")), N.author(F.col("head"))), "id") == _TITLES


def test_inline_headings(spark):
    rows = spark.createDataFrame(list(enumerate(_ENDS)), "id int, line string").select("id", C.inline_heading(F.col("line")).alias("h"))
    found = _rows(rows.select("id", "h.cut", "h.heading.number", "h.heading.title"), "id")
    assert found == [(0, 18, 8, "冲突"), (1, None, None, None), (2, None, None, None), (3, None, None, None), (4, 2, 3, "第四章 云起"), (5, None, None, None), (6, None, None, None)]


def test_question_terms(spark):
    rows = spark.createDataFrame(list(enumerate(_QUESTIONS)), "id int, q string")
    assert _rows(rows.select("id", C.question_keyword(F.col("q")), F.array_join(C.term_ladder(F.col("q")), "|"), F.array_join(C.query_terms(F.col("q")), "|")), "id") == _TERMS


def test_answers(spark):
    checked = A.validated(spark.createDataFrame(_ANSWERS, "question_id int, raw string, n_chunks int"))
    assert _rows(checked.select("question_id", "answer", "outcome", F.array_join("refs", ","), F.array_join("invalid", ",")), "question_id") == _VALIDATED
