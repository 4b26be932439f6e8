"""Queries of the rules for Chinese text, over rows of the given tables.

The tables hold no Chinese, so each row is given Chinese words made of its own values: numerals of
its id, headings with its source as title, a whole book of a source's documents. The SQL does not
build these words again; it says from the same values what has to come out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import chinese as C
from lectern.functions import text as X
from lectern.functions import titles as N
from lectern.operators import ask as A
from lectern.operators import chapters as H
from lectern.operators.ordinals import numbered

QUERIES: dict = {}
SQL: dict[str, str] = {}

_HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
#: The four digits, none of them zero, that a row's numeral has; and the number.
_digits = lambda: [F.expr(f"cast(1 + (doc_id div {9**k}) % 9 as int)") for k in (3, 2, 1, 0)]
_NUMBER = "(" + " + ".join(f"(1 + (doc_id // {9**k}) % 9) * {10**k}" for k in (3, 2, 1, 0)) + ")"


def _query(sql: str):
    def put(function):
        QUERIES[function.__name__], SQL[function.__name__] = function, sql
        return function

    return put


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numeral(ones: str = "一二三四五六七八九", units: str = "千百十") -> Column:
    digit = lambda d: F.substr(F.lit(ones), d, F.lit(1))
    return F.concat(*[x for d, unit in zip(_digits(), [*units, ""], strict=True) for x in (digit(d), F.lit(unit))])


def _ascii() -> Column:
    return F.concat(*[d.cast("string") for d in _digits()])


def _by_case(cases: list, key: str = "doc_id") -> Column:
    """The case whose turn it is by the row's id."""
    out = F
    for i, case in enumerate(cases):
        out = out.when(F.col(key) % len(cases) == i, case)
    return out


def _cases(n: int, values: list[str], key: str = "doc_id") -> str:
    return f"CASE {key} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@_query(f"""
    SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha FROM (
        SELECT doc_id, flatten(list_transform(regexp_extract_all(translate(text, 'etaoins.', '林动石符云岚宗。'), '{_HAN}+|[A-Za-z0-9]+'), lambda r:
            CASE WHEN regexp_matches(r, '^[A-Za-z0-9]') OR length(r) = 1 THEN [lower(r)]
                 ELSE list_transform(range(1, length(r)), lambda i: substr(r, CAST(i AS INTEGER), 2)) END)) AS t FROM documents)""")
def tokenize_chinese(spark, sf_dir):
    """Whole texts with eight of their signs made Chinese."""
    found = _table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.translate("text", "etaoins.", "林动石符云岚宗。")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha"))


@_query(f"SELECT doc_id, CAST(CASE WHEN v > 2147483647 THEN NULL ELSE v END AS INTEGER) AS number FROM (SELECT doc_id, {_cases(9, ['n', 'n', 'n', 'n', 'n', 'n * 10000 + n', 'n * 100000000', 'NULL', 'n % 10'])} AS v FROM (SELECT doc_id, {_NUMBER} AS n FROM documents))")
def chinese_numbers(spark, sf_dir):
    usual, last = _numeral(), F.substr(F.lit("一二三四五六七八九"), _digits()[3], F.lit(1))
    cases = [usual, _ascii(), F.translate(_ascii(), "0123456789", "０１２３４５６７８９"), _numeral("壹贰叁肆伍陆柒捌玖", "仟佰拾"), F.concat(F.lit(" "), F.substr(usual, F.lit(1), F.lit(2)), F.lit("　"), F.substr(usual, F.lit(3), F.lit(9))), F.concat(usual, F.lit("万"), usual), F.concat(usual, F.lit("亿")), F.concat(usual, F.lit("x")), F.concat(F.lit("三"), last)]
    return _table(spark, sf_dir, "documents").select("doc_id", C.number(_by_case(cases)).alias("number"))


_REASONS = ["accepted", "accepted", "accepted", "accepted", "begins with punctuation", "begins with a particle", "not a heading", "sentence end inside", "ends a sentence", "accepted", "title too long", "line too long", "not a heading"]


@_query(f"""
    SELECT doc_id, {_cases(13, [f"'{r}'" for r in _REASONS])} AS reason,
           CAST({_cases(13, ['n', 'n', 'n', '3', 'n', 'n', '0', 'n', 'n', 'n', 'n', 'n', '0'])} AS INTEGER) AS number,
           {_cases(13, ["'CHAPTER'", "'CHAPTER'", "'VOLUME'", "'SPECIAL'", "'CHAPTER'", "'CHAPTER'", "'SPECIAL'", "'CHAPTER'", "'CHAPTER'", "'CHAPTER'", "'CHAPTER'", "'CHAPTER'", "'SPECIAL'"])} AS kind,
           {_cases(13, ['source', 'source', 'source', 'source', "'，' || source", "'的' || source", "''", "source || '！快走'", "source || '。'", 'source', "repeat('长', 21)", "repeat('长', 31)", "''"])} AS title
    FROM (SELECT doc_id, source, {_NUMBER} AS n FROM documents)""")
def headings(spark, sf_dir):
    n, s = _numeral(), F.col("source")
    lit = F.lit
    cases = [
        F.concat(lit("第"), n, lit("章 "), s), F.concat(lit("【第"), _ascii(), lit("回："), s, lit("】")), F.concat(lit("　第"), n, lit("卷 "), s, lit("  ")), F.concat(lit("番外三 "), s),
        F.concat(lit("第"), n, lit("章，"), s), F.concat(lit("第"), n, lit("章 的"), s), F.concat(lit("他说第"), n, lit("章"), s), F.concat(lit("第"), n, lit("节 "), s, lit("！快走")),
        F.concat(lit("第"), n, lit("章 "), s, lit("。")), F.concat(lit("第 "), F.translate(_ascii(), "0123456789", "０１２３４５６７８９"), lit(" 章："), s), F.concat(lit("第"), n, lit("章 "), F.repeat(lit("长"), 21)),
        F.concat(lit("第"), n, lit("章 "), F.repeat(lit("长"), 31)), F.concat(lit("正文"), s),
    ]
    found = _table(spark, sf_dir, "documents").select("doc_id", C.heading(_by_case(cases)).alias("h"))
    return found.select("doc_id", "h.reason", "h.number", "h.kind", "h.title")


@_query(f"""
    SELECT doc_id, CAST({_cases(6, ['10', 'NULL', 'NULL', 'NULL', '2', 'NULL'])} AS INTEGER) AS cut, CAST({_cases(6, ['n', 'NULL', 'NULL', 'NULL', 'n', 'NULL'])} AS INTEGER) AS number,
           {_cases(6, ['source', 'NULL', 'NULL', 'NULL', "'第四章 ' || source", 'NULL'])} AS title
    FROM (SELECT doc_id, source, {_NUMBER} AS n FROM documents)""")
def inline_headings(spark, sf_dir):
    n, s, lit = _numeral(), F.col("source"), F.lit
    cases = [F.concat(lit("（求收藏，谢谢大家了第"), n, lit("章 "), s), F.concat(lit("第"), n, lit("章 "), s), F.concat(lit("他在第"), n, lit("章的交手中，便败了？"), s), s, F.concat(lit("他说第"), n, lit("章第四章 "), s), F.concat(lit("感谢第"), n, lit("章，"), s)]
    found = _table(spark, sf_dir, "documents").select("doc_id", C.inline_heading(_by_case(cases)).alias("h"))
    return found.select("doc_id", "h.cut", "h.heading.number", "h.heading.title")


# A book of each source: a document is a chapter of a heading and two lines; every 40 chapters make a volume, and in
# a volume some headings after the third bear the number 2 again, which breaks the order.
_VOLUME, _WRONG = 40, 7
_SPLIT = f"""
    WITH d AS (SELECT source AS book_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents),
    p AS (SELECT *, place % {_VOLUME} AS nth, place // {_VOLUME} + 1 AS volume, place % {_VOLUME} >= 3 AND doc_id % {_WRONG} = 0 AS wrong FROM d),
    t AS (SELECT *, '第' || (CASE WHEN wrong THEN 2 ELSE nth + 1 END) || '章 d' || doc_id AS title,
                 CASE WHEN nth = 0 THEN octet_length(encode('第' || volume || '卷 v' || volume || chr(10))) ELSE 0 END AS of_volume FROM p),
    b AS (SELECT *, of_volume + octet_length(encode(title || chr(10) || '正文 ' || doc_id || chr(10) || chr(10))) AS size FROM t),
    s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY book_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + of_volume AS start, sum(size) OVER (PARTITION BY book_id) AS total FROM b),
    k AS (SELECT *, count(*) OVER (PARTITION BY book_id) AS chapters FROM s WHERE NOT wrong)
"""


def _lines(spark, sf_dir):
    docs = numbered(_table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id"), "book_id", "doc_id", "place")
    nth, volume = F.col("place") % _VOLUME, (F.expr(f"place div {_VOLUME}") + 1).cast("string")
    number = F.when((nth >= 3) & (F.col("doc_id") % _WRONG == 0), 2).otherwise(nth + 1).cast("string")
    title = F.concat(F.lit("第"), number, F.lit("章 d"), "doc_id")
    own = F.array(F.when(nth == 0, F.concat(F.lit("第"), volume, F.lit("卷 v"), volume)), title, F.concat(F.lit("正文 "), "doc_id"), F.lit(""))
    rows = docs.select("book_id", "place", F.posexplode(own).alias("_n", "line")).filter("line is not null").withColumn("_turn", F.col("place") * 4 + F.col("_n")).withColumn("_size", (F.octet_length("line") + 1).cast("long"))
    placed = H.summed_before(numbered(rows, "book_id", "_turn", "line_no"), "book_id", "line_no", "_size", "start")
    return placed.select("book_id", "line_no", "start", (F.col("start") + F.col("_size")).alias("stop"), "line")


@_query(
    _SPLIT
    + """
    SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY place) - 1 AS chapter_index, CAST(start AS BIGINT) AS start,
           CAST(lead(start, 1, total) OVER (PARTITION BY book_id ORDER BY place) AS BIGINT) AS stop, title, '第' || volume || '卷 v' || volume AS volume
    FROM k WHERE chapters >= 3
    UNION ALL SELECT book_id, 0, 0, CAST(any_value(total) AS BIGINT), '全文', NULL FROM k WHERE chapters < 3 GROUP BY book_id"""
)
def split_chapters(spark, sf_dir):
    return H.split(_lines(spark, sf_dir))


@_query(
    _SPLIT
    + f"""
    SELECT book_id, count(*) + count(*) FILTER (nth = 0) AS headings, 0 AS inline, 0 AS rejected, 0 AS contents_dropped, count(*) FILTER (wrong) AS numbering_dropped,
           max(place) // {_VOLUME} + 1 AS segments, count(*) FILTER (NOT wrong) AS chapters, count(*) FILTER (NOT wrong) < 3 AS fallback
    FROM s GROUP BY book_id"""
)
def split_report(spark, sf_dir):
    return H.report(_lines(spark, sf_dir))


@_query(f"""
    SELECT doc_id, {_cases(6, ['source', 'source', 'source', "source || '/' || n", 'source', "'f' || doc_id"])} AS title, {_cases(6, ["'author' || n", 'NULL', "'author' || n", 'NULL', 'NULL', "'author' || n"])} AS author
    FROM (SELECT doc_id, source, {_NUMBER} AS n FROM documents)""")
def titles_and_authors(spark, sf_dir):
    s, n, lit = F.col("source"), _ascii(), F.lit
    heads = [
        F.concat(lit("《"), s, lit("》\n作者：author"), n, lit("\n内容")), lit("没有标题的开头"), F.concat(lit("书名：《"), s, lit("》（全本）\n作者: author"), n, lit("|全本")), lit(None).cast("string"),
        F.concat(lit("作者：未知")), F.concat(lit("作 者：author"), n, lit("\n")),
    ]
    files = [lit("01.txt"), F.concat(s, lit("（精校版全本）作者某某TXT下载.txt")), lit("a.txt"), F.concat(s, lit("/"), n, lit(".txt")), F.concat(lit("《"), s, lit("》.txt")), F.concat(lit("f"), F.col("doc_id"), lit(".epub"))]
    rows = _table(spark, sf_dir, "documents").select("doc_id", _by_case(heads).alias("head"), _by_case(files).alias("file"))
    return rows.select("doc_id", N.title(F.col("head"), F.col("file")).alias("title"), N.author(F.col("head")).alias("author"))


_NAME = "translate(CAST(doc_id AS VARCHAR), '0123456789', '林动石符云岚宗药叶炎')"
_WINDOWS = "list_filter(flatten(list_transform(range(1, length({0}) + 1), lambda i: list_transform([{1}], lambda n: CASE WHEN i + n - 1 <= length({0}) THEN substr({0}, CAST(i AS INTEGER), CAST(n AS INTEGER)) END))), lambda p: p IS NOT NULL)"


@_query(f"""
    WITH q AS (SELECT doc_id, name, name || CASE WHEN doc_id % 2 = 0 THEN '在哪里' ELSE '是谁' END AS run FROM (SELECT doc_id, {_NAME} AS name FROM documents)),
    l AS (SELECT *, list_concat([name], {_WINDOWS.format("name", "4, 3, 2")}) AS ladder, list_concat(CASE WHEN length(run) <= 4 THEN [run] ELSE [] END, {_WINDOWS.format("run", "2, 3, 4")}) AS terms FROM q)
    SELECT doc_id, name AS keyword, array_to_string(list_transform(list_filter(list_zip(ladder, range(1, len(ladder) + 1)), lambda p: list_position(ladder, p[1]) = p[2]), lambda p: p[1])[1:12], '|') AS ladder,
           array_to_string(list_sort(list_distinct(terms)), '|') AS terms FROM l""")
def question_terms(spark, sf_dir):
    name = F.translate(F.col("doc_id").cast("string"), "0123456789", "林动石符云岚宗药叶炎")
    question = F.concat(name, F.when(F.col("doc_id") % 2 == 0, F.lit("在哪里？")).otherwise(F.lit("是谁")))
    rows = _table(spark, sf_dir, "documents").select("doc_id", question.alias("question"))
    return rows.select("doc_id", C.question_keyword(F.col("question")).alias("keyword"), F.array_join(C.term_ladder(F.col("question")), "|").alias("ladder"), F.array_join(C.query_terms(F.col("question")), "|").alias("terms"))


_WORD = "(role || turn)"


@_query(f"""
    SELECT conv_id, turn, {_cases(6, [f"{_WORD} || '[1]。二' || {_WORD} || '[2]！'", "''", "''", "''", "''", f"'[2][1][2]' || {_WORD}"], 'turn')} AS answer,
           {_cases(6, ["'ok'", "'invalid-citations'", "'invalid-citations'", "'llm-error'", "'no-chunks'", "'ok'"], 'turn')} AS outcome,
           {_cases(6, ["'1,2'", "''", "''", "''", "''", "'2,1'"], 'turn')} AS refs, {_cases(6, ["CAST(turn + 9 AS VARCHAR)", "''", "'7'", "''", "''", "''"], 'turn')} AS invalid
    FROM conversations""")
def answers_validated(spark, sf_dir):
    w, lit = F.concat("role", "turn"), F.lit
    cases = [F.concat(w, lit("[1]。没有出处。二"), w, lit("[2]["), (F.col("turn") + 9).cast("string"), lit("]！")), F.concat(w, lit("没有引用。")), F.concat(w, lit("[7]。")), lit(None).cast("string"), F.concat(w, lit("[1]")), F.concat(lit("[2][1][2]"), w)]
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", _by_case(cases, "turn").alias("raw"), F.when(F.col("turn") % 6 == 4, 0).otherwise(3).alias("n_chunks"))
    checked = A.validated(turns)
    return checked.select("conv_id", "turn", "answer", "outcome", F.array_join("refs", ",").alias("refs"), F.array_join("invalid", ",").alias("invalid"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@_query(f"""
    SELECT question_id, sha256(CASE WHEN context IS NULL THEN {_quoted(A.NO_CONTEXT_PROMPT[0])} || question || {_quoted(A.NO_CONTEXT_PROMPT[1])}
                                    ELSE {_quoted(A.USER_PROMPT[0])} || context || {_quoted(A.USER_PROMPT[1])} || question || {_quoted(A.USER_PROMPT[2])} END) AS prompt_sha
    FROM (SELECT a.conv_id AS question_id, a.text AS question, '【片段1｜《' || a.conv_id || '》第 1 章第 2 段】' || chr(10) || b.text AS context
          FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 1 WHERE a.turn = 0)""")
def prompts_built(spark, sf_dir):
    """Each conversation's first turn as the question, the second one as the only chunk."""
    turns = _table(spark, sf_dir, "conversations")
    questions = turns.filter("turn = 0").select(F.col("conv_id").alias("question_id"), F.col("text").alias("question"))
    chosen = turns.filter("turn = 1").select(F.col("conv_id").alias("question_id"), F.col("conv_id").alias("book_id"), F.lit(0).alias("chapter_index"), F.lit(1).alias("paragraph_index"), F.lit(1).alias("number"), "text")
    built = A.prompts(questions, A.contexts(chosen))
    return built.select("question_id", F.sha2("user_prompt", 256).alias("prompt_sha"))


def _titled(spark, sf_dir):
    """Chapters that begin with a heading: their own, that of another title, or none; the heading comes after empty lines, or the title is missing."""
    line = F.concat(F.lit("第"), _numeral(), F.lit("章 "), F.col("source"))
    title = _by_case([line, F.lit("开篇"), F.lit(None).cast("string"), F.col("source"), line])
    text = F.coalesce("text", F.lit(""))
    body = _by_case([F.concat(line, F.lit("\n"), text), F.concat(line, F.lit("\n"), text), F.concat(line, F.lit("\n"), text), text, F.concat(F.lit("\n\u3000 "), line, F.lit(" \n\n"), text)])
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_index"), title.alias("title"), body.alias("text"))


_LINE = "'第' || " + " || ".join(f"substr('一二三四五六七八九', CAST(1 + (doc_id // {9**k}) % 9 AS INTEGER), 1) || '{unit}'" for k, unit in ((3, "千"), (2, "百"), (1, "十"), (0, ""))) + " || '章 ' || source"
_BLOCKS = f"""
    WITH d AS (SELECT *, {_LINE} AS line FROM documents),
    body AS (SELECT doc_id, source, 0 AS place, CASE WHEN doc_id % 5 IN (0, 4) THEN 'heading' ELSE 'paragraph' END AS kind, line AS value FROM d WHERE doc_id % 5 <> 3
             UNION ALL SELECT doc_id, source, unnest(range(1, len(string_split(text, chr(10))) + 1)), 'paragraph', trim(unnest(string_split(text, chr(10))), E' \\t\\r\\f\\v　') FROM d),
    blocks AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS n FROM body WHERE value <> '')
"""


@_query(_BLOCKS + "SELECT source AS book_id, doc_id AS chapter_index, n, kind, value FROM blocks")
def chapter_blocks(spark, sf_dir):
    return H.blocks(_titled(spark, sf_dir)).select("book_id", "chapter_index", "n", "kind", "value")


@_query(
    _BLOCKS
    + """
    SELECT source AS book_id, doc_id AS chapter_index, CAST(n - CAST(doc_id % 5 IN (0, 4) AS INTEGER) AS INTEGER) AS paragraph_index, sha256(value) AS text_sha,
           CASE WHEN doc_id % 5 IN (0, 4) THEN line WHEN doc_id % 5 = 1 THEN '开篇' WHEN doc_id % 5 = 2 THEN '' ELSE source END AS chapter_title
    FROM blocks JOIN (SELECT doc_id, line FROM d) USING (doc_id) WHERE kind = 'paragraph'"""
)
def paragraphs_titled(spark, sf_dir):
    """The paragraphs that answers are made of, with their chapter's title; headings are none of them."""
    return A.paragraphs(_titled(spark, sf_dir)).select("book_id", "chapter_index", "paragraph_index", F.sha2("text", 256).alias("text_sha"), "chapter_title")
