"""Column functions for Chinese text: numerals, chapter headings, questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import bound, strip, windows

# Numerals and units.
DIGITS = {
    "〇": 0, "○": 0, "零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9,
    "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9,
}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
TEN_THOUSAND, HUNDRED_MILLION = "万萬", "亿億"
MAX_INT = 2**31 - 1

# The shape of chapter headings.
MAX_LINE, MAX_TITLE = 40, 20
_BLANK = r"[\s　]*"
HEADING = (
    rf"^{_BLANK}(?:第{_BLANK}([0-9]{{1,7}}|[０-９]{{1,7}}|[〇○零一二三四五六七八九两壹贰叁肆伍陆柒捌玖十拾百佰千仟万萬亿億]{{1,12}}){_BLANK}([章节回卷部篇集幕])"
    rf"|(楔子|序章|序言|序幕|引子|前言|后记|尾声|终章|终篇|后序|番外|外传){_BLANK}([0-9０-９]{{1,3}}|[〇○零一二三四五六七八九十]{{1,4}})?)"
    rf"{_BLANK}[:：.·\-—－]?{_BLANK}([^\r\n]{{0,40}})$"
)
VOLUME_UNITS = "卷部篇"
SENTENCE_ENDS, TRAILING_ENDS = "。；;…‥", "！？!?"
BRACKETS = "【】[]{}（）()《》"
PARTICLES = "的着吧呢吗啊嘛哦呀"
CLAUSE_PUNCTUATION = "[，,、；;]"
PUNCTUATION_FIRST = "，。、；：！？…‥—～·"

# What is taken out of questions, in this order.
QUESTION_WORDS = [
    "是什么", "哪本书", "在哪里", "哪儿", "哪里", "第几章", "为什么", "怎么", "怎么样", "是谁", "是谁的", "哪个", "哪些",
    "多少", "什么时候", "有没有", "能否", "可以", "告诉",
]
QUESTION_PUNCTUATION = ["？", "?", "。", "，", "、", "！"]
MAX_TERMS, MIN_TERM, MAX_TERM = 12, 2, 4
FUNCTION_CHARACTERS = "这那个们的了着过是在和与就都也还又很更太最被把让给使对从到向为以于及或但却只才便再会能要说讲问答怎什哪如有无不没"
GENERIC_TERMS = [
    "这个", "那个", "这些", "那些", "这样", "那样", "这里", "那里", "一个", "一些", "一点", "一下", "一样", "一般", "一切", "一起",
    "什么", "怎么", "怎样", "如何", "为什么", "为何", "哪里", "哪儿", "哪个", "哪些", "是谁", "多少", "几个", "何时", "是否", "可否",
    "不是", "就是", "还是", "只是", "只有", "并不", "并非",
    "最后", "后来", "开始", "当初", "原本", "现在", "目前", "如今", "以后", "之后", "之前", "以前", "从此", "同时", "然后", "接着",
    "于是", "所以", "因此", "因为", "如果", "虽然", "但是", "不过", "可是", "而且", "并且", "或者", "已经", "正在", "曾经", "一直",
    "非常", "十分", "特别", "比较", "有些", "所有", "每个", "整个",
    "事情", "问题", "地方", "东西", "样子", "情况", "关系", "意思", "故事", "小说", "作者", "书名", "内容", "时候", "知道", "介绍",
    "说说", "讲讲", "问问", "帮我", "告诉", "回答", "喜欢", "发生", "出现", "看到", "认为", "觉得",
]


def _half_width(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def _value(character: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), character)


def number(text: Column) -> Column:
    """The number that ASCII, full-width or Chinese numerals stand for; null if they stand for none or for more than an int holds.

    A digit replaces the one before it, and a unit without a digit counts once.
    """
    return bound(_half_width(F.regexp_replace(text, r"[\s　]+", "")), _bare_number)


def _bare_number(bare: Column) -> Column:
    state = F.struct(F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("digit"), F.lit(False).alias("zero"), F.lit(False).alias("bad"))

    def step(a: Column, c: Column) -> Column:
        def to(done=None, part=None, digit=0, zero=False, bad=None) -> Column:
            parts = {"done": a.done if done is None else done, "part": a.part if part is None else part, "digit": digit, "zero": zero, "bad": a.bad if bad is None else bad}
            kinds = {"done": "long", "part": "long", "digit": "long", "zero": "boolean", "bad": "boolean"}
            return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(kinds[k]).alias(k) for k, v in parts.items()])

        digit, unit = _value(c, DIGITS), _value(c, UNITS)
        amount = F.when(a.digit == 0, F.lit(1)).otherwise(a.digit)
        return (
            F.when(digit.isNotNull(), to(digit=digit, zero=digit == 0))
            .when(unit.isNotNull(), to(part=a.part + amount * unit, bad=a.bad | a.zero))
            .when(c.isin(*TEN_THOUSAND), to(done=a.done + (a.part + a.digit) * 10_000, part=0))
            .when(c.isin(*HUNDRED_MILLION), to(done=(a.done + a.part + a.digit) * 100_000_000, part=0))
            .otherwise(to(bad=True))
        )

    characters = F.split(bare, "")
    folded = F.aggregate(characters, state, step, lambda a: F.when(~a.bad, a.done + a.part + a.digit))
    value = F.when(bare.rlike("^[0-9]+$"), bare.try_cast("long")).when(bare != "", folded)
    return bound(value, lambda v: F.when(v.between(0, MAX_INT), v).cast("int"))


def unwrapped(line: Column) -> Column:
    """Without brackets around the whole line, however many."""
    pairs = "|".join(rf"\{a}.*\{b}" if a.isascii() else f"{a}.*{b}" for a, b in zip(BRACKETS[::2], BRACKETS[1::2], strict=True))
    # a pair takes two characters, and longer lines are no headings
    turns = F.sequence(F.lit(1), F.lit(MAX_LINE // 2 + 1))
    return F.aggregate(turns, strip(line), lambda s, _: F.when(s.rlike(rf"(?s)^(?:{pairs})$"), strip(F.substr(s, F.lit(2), F.length(s) - 2))).otherwise(s))


def heading(line: Column) -> Column:
    """A struct: reason (accepted, or why a line is no chapter heading), number, raw_number, title, kind (CHAPTER, VOLUME, SPECIAL) and text."""
    return bound(unwrapped(line), lambda text: bound(F.array(*[F.regexp_extract(text, HEADING, i) for i in range(1, 6)]), lambda groups: _judged(line, text, groups)))


def _judged(line: Column, text: Column, groups: Column) -> Column:
    numeral, unit, special, special_number = (groups[i] for i in range(4))
    title = strip(F.regexp_replace(strip(groups[4]), r"^[:：.·\-—－ 　]+", ""))
    value = F.when(unit != "", number(numeral)).otherwise(F.coalesce(F.when(special_number != "", number(special_number)), F.lit(0)))
    return bound(F.struct(title.alias("title"), value.alias("value")), lambda own: _verdict(line, text, groups, own.title, own.value))


def _verdict(line: Column, text: Column, groups: Column, title: Column, value: Column) -> Column:
    numeral, unit, special, special_number = (groups[i] for i in range(4))
    kind = F.when(unit == "", "SPECIAL").when(unit.isin(*VOLUME_UNITS), "VOLUME").otherwise("CHAPTER")
    first = F.substring(title, 1, 1)
    reason = (
        F.when(line.isNull() | (text == ""), "blank")
        .when(F.length(text) > MAX_LINE, "line too long")
        .when(~text.rlike(HEADING), "not a heading")
        .when(F.length(title) > MAX_TITLE, "title too long")
        .when(text.rlike(f"[{SENTENCE_ENDS}]"), "ends a sentence")
        .when(text.rlike(rf"[{TRAILING_ENDS}][^ \t　]*[^ \t　{TRAILING_ENDS}]|[{TRAILING_ENDS}][ \t　]*[^ \t　]"), "sentence end inside")
        .when(first.isin(*PARTICLES), "begins with a particle")
        .when(first.isin(*PUNCTUATION_FIRST), "begins with punctuation")
        .when(value.isNull(), "no number")
        .otherwise("accepted")
    )
    raw = F.when(unit != "", numeral).otherwise(F.concat(special, special_number))
    return F.struct(reason.alias("reason"), value.alias("number"), raw.alias("raw_number"), title.alias("title"), kind.alias("kind"), text.alias("text"))


def is_numeral(text: Column) -> Column:
    """Whether a text consists of Chinese numerals and units alone, white space not allowed; false for none."""
    known = "".join([*DIGITS, *UNITS, TEN_THOUSAND, HUNDRED_MILLION])
    return F.coalesce(text.rlike(rf"^[{known}]+$"), F.lit(False))


def number_or(text: Column, fallback: int) -> Column:
    return F.coalesce(number(text), F.lit(fallback))


def inline_heading(line: Column) -> Column:
    """A chapter heading at the end of a line that begins with other text: a struct of cut (characters before it) and heading; null without one.

    Of the places of the last MAX_LINE characters that read 第, the first one that begins a heading
    whose title has no clause punctuation.
    """
    last = F.length(line)
    places = F.filter(F.sequence(F.greatest(last - MAX_LINE + 1, F.lit(2)), F.greatest(last, F.lit(2))), lambda i: F.substr(line, i, F.lit(1)) == "第")
    tried = F.transform(places, lambda i: F.struct((i - 1).alias("cut"), heading(F.substr(line, i)).alias("heading")))
    good = F.filter(tried, lambda x: (x.heading.reason == "accepted") & ~x.heading.title.rlike(CLAUSE_PUNCTUATION))
    # most lines have none
    return F.when(F.contains(line, F.lit("第")), F.get(good, F.lit(0)))


def question_keyword(question: Column) -> Column:
    """The question without question words and punctuation."""
    bare = reduce(lambda q, w: F.replace(q, F.lit(w), F.lit("")), QUESTION_WORDS, strip(F.coalesce(question, F.lit(""))))
    spaced = reduce(lambda q, p: F.replace(q, F.lit(p), F.lit(" ")), QUESTION_PUNCTUATION, bare)
    return strip(F.regexp_replace(spaced, r"[\s　]+", " "))


def term_ladder(question: Column) -> Column:
    """Terms to look for, in order: the whole keyword, then its pieces of 4 to 2 characters by place, longest first, noise left out."""
    keyword = question_keyword(question)
    last = F.length(keyword)
    places = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    pieces = F.flatten(F.transform(places, lambda i: F.filter(F.array(*[F.when(i + (n - 1) <= last, F.substr(keyword, i, F.lit(n))) for n in range(MAX_TERM, MIN_TERM - 1, -1)]), lambda p: p.isNotNull() & ~F.contains(p, F.lit(" ")))))
    telling = F.filter(pieces, lambda p: ~p.isin(*GENERIC_TERMS) & ~F.substring(p, 1, 1).isin(*FUNCTION_CHARACTERS))
    return F.when(keyword == "", F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(F.concat(F.array(keyword), telling)), 1, MAX_TERMS))


def query_terms(question: Column) -> Column:
    """Terms that score a paragraph, sorted: ASCII words of two characters or more, and all pairs, triples and fours of Han characters."""
    words = F.filter(F.regexp_extract_all(question, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    runs = F.regexp_extract_all(question, F.lit(r"[一-鿿]+"), F.lit(0))
    short = F.filter(runs, lambda r: F.length(r) <= 4)
    pieces = F.flatten(F.transform(runs, lambda r: F.concat(windows(r, 2), windows(r, 3), windows(r, 4))))
    return F.array_sort(F.array_distinct(F.concat(words, short, pieces)))
