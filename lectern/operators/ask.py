"""Answers grounded in the books: recall, chunks, selection, context and the check of citations.

Every function takes many questions at once, told apart by question_id. The model itself is a
callable that is handed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import chinese as C
from lectern.functions import text as X
from lectern.operators import chapters as H
from lectern.operators import index, search
from lectern.operators.shared import once, stored

# Fixed values.
SYSTEM_PROMPT = """\
你是一个只依据给定原文作答的阅读助手。你面对的是中文小说的原文片段。

你必须遵守以下规则，这些规则没有例外：

1. 只能依据【原文片段】中的内容回答。不得使用你在训练中获得的任何知识，
   不得推测、不得补全、不得因为"通常是这样"就写出来。
2. 每个结论后面必须紧跟它依据的片段编号，格式为 [1]、[2]，可多个。
   没有编号的句子会被系统直接删除。
3. 如果原文片段里没有能回答问题的内容，就回答：
   「原文里没有提到。」
   并说明现有片段讲的是什么。不要为了给出答案而勉强作答。
4. 只根据片段内容作答，不要评价、不要扩展、不要给建议。
5. 用简体中文回答，简洁作答，不要复述整个片段。
"""
USER_PROMPT = ("【原文片段】\n", "\n\n---\n【用户问题】\n", "\n\n请依据上面的原文片段作答，并在每个结论后标注依据的片段编号。")
NO_CONTEXT_PROMPT = ("【原文片段】（本次没有召回到任何与问题相关的原文）\n\n用户问题：", "\n\n请只回答一句话：原文里没有提到。不要作答、不要推测、不要使用你自己的知识。")
MAX_CHAPTERS, HITS_A_TERM, MAX_CHUNKS = 4, 40, 200
MAX_CHUNK_CHARS, MAX_PER_CHAPTER, TOP_K = 1200, 2, 8
MAX_CITATIONS, EXCERPT_CHARS = 12, 120
#: Zones of the index that a term is looked for in at first; each further round so many times as many.
FIRST_ZONES, GROWTH = 4, 8
_CITATION = r"\[(\d+)\]"


def ladders(questions: DataFrame) -> DataFrame:
    """(question_id, place, term) of the terms to look for."""
    return questions.select("question_id", F.posexplode(C.term_ladder(F.col("question"))).alias("place", "term"))


def recall(terms: DataFrame, chapters: DataFrame) -> DataFrame:
    """(question_id, book_id, chapter_index): the first MAX_CHAPTERS chapters by the place of the first term that they hold.

    terms: at most MAX_TERMS rows for each question; they are broadcast, which bounds the
    questions that a call can take. Each term brings its first HITS_A_TERM chapters.
    """
    lowered = chapters.select("book_id", "chapter_index", F.lower("text").alias("_text"))
    found = lowered.join(F.broadcast(terms), F.contains(F.col("_text"), F.lower("term"))).drop("_text")
    order = Window.partitionBy("question_id", "place").orderBy("book_id", "chapter_index")
    hits = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= HITS_A_TERM)
    first = hits.groupBy("question_id", "book_id", "chapter_index").agg(F.min("place").alias("place"))
    chosen = Window.partitionBy("question_id").orderBy("place", "book_id", "chapter_index")
    return first.withColumn("_n", F.row_number().over(chosen)).filter(F.col("_n") <= MAX_CHAPTERS).drop("_n", "place")


def recall_by_index(spark: SparkSession, path: str, terms: DataFrame, texts: search.TextSource) -> DataFrame:
    """(question_id, book_id, chapter_index): the first MAX_CHAPTERS chapters by the place of the first term that an indexed search finds in them, for any number of questions.

    Each different term is looked for once. Zones that hold all of a term's tokens are known from
    the heads of blocks; they are gone through in order, GROWTH times as many each round, for the
    terms that have not enough hits yet: a question needs MAX_CHAPTERS chapters of a term beside as many
    that earlier terms may have brought. Only candidates' texts are asked for.
    """
    enough = min(HITS_A_TERM, 2 * MAX_CHAPTERS)
    wanted = terms.select("term").distinct().select("term", F.array_distinct(X.tokens(F.col("term"))).alias("_tokens"))
    tokens = once(wanted.select("term", F.size("_tokens").alias("n"), F.explode("_tokens").alias("token")))
    runs = index.live_runs(spark, path)
    blocks = index.blocks_of(spark, path, tokens.select("token").distinct())
    heads = tokens.join(blocks.select("token", "run", "turn", "zone", "first", "last"), "token").groupBy("term", "n", "run", "turn", "zone").agg(F.count("*").alias("_n"), F.max("first").alias("_first"), F.min("last").alias("_last"))
    # zones of one run are in the order of their chapters; those of several are taken all at once
    nth = F.row_number().over(Window.partitionBy("term").orderBy("zone")) if len(runs) == 1 else F.lit(1)
    zones = once(heads.filter((F.col("_n") == F.col("n")) & (F.col("_first") <= F.col("_last"))).select("term", "n", "run", "turn", "zone", nth.alias("nth")))
    hits, at, upto = spark.createDataFrame([], "term string, book_id string, chapter_index long"), 0, FIRST_ZONES
    todo = zones
    while not todo.isEmpty():
        now = todo.filter((F.col("nth") > at) & (F.col("nth") <= upto))
        found = once(index.met_by_term(spark, path, now.join(tokens.drop("n"), "term").join(blocks.select("token", "run", "zone", "gaps"), ["token", "run", "zone"])))
        held = texts(found).select("book_id", "chapter_index", F.lower("text").alias("_text"))
        hits = once(hits.unionByName(found.join(held, ["book_id", "chapter_index"]).filter(F.contains("_text", F.lower("term"))).select("term", "book_id", "chapter_index")))
        done = hits.groupBy("term").agg(F.count("*").alias("_hits")).filter(F.col("_hits") >= enough)
        at, upto = upto, upto * GROWTH
        todo = zones.filter(F.col("nth") > at).join(done, "term", "left_anti")
    nth_hit = F.row_number().over(Window.partitionBy("term").orderBy("book_id", "chapter_index"))
    first_hits = hits.withColumn("_n", nth_hit).filter(F.col("_n") <= enough).drop("_n")
    first = terms.join(first_hits, "term").groupBy("question_id", "book_id", "chapter_index").agg(F.min("place").alias("place"))
    chosen = Window.partitionBy("question_id").orderBy("place", "book_id", "chapter_index")
    return first.withColumn("_n", F.row_number().over(chosen)).filter(F.col("_n") <= MAX_CHAPTERS).drop("_n", "place")


def paragraphs(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_index, paragraph_index, text): lines that hold something, numbered in their chapter.

    Of chapters with a title the line that is their heading is no paragraph and takes no number;
    chapter_title is then added, empty where there is none.
    """
    if "title" in chapters.columns:
        own = H.blocks(chapters).filter("kind = 'paragraph'")
        return own.select("book_id", "chapter_index", "paragraph_index", F.col("value").alias("text"), F.coalesce("title", F.lit("")).alias("chapter_title"))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), X.strip), lambda line: line != "")
    return chapters.select("book_id", "chapter_index", F.posexplode(lines).alias("paragraph_index", "text"))


def chunks(recalled: DataFrame, chapters: DataFrame, most: int = MAX_CHUNKS) -> DataFrame:
    """The paragraphs of the recalled chapters with `pos`, their place in the question's chunks."""
    # stored, so that Spark knows whether it is small
    wanted = stored(recalled.select("book_id", "chapter_index").distinct(), "wanted")
    own = paragraphs(chapters.join(wanted, ["book_id", "chapter_index"], "left_semi"))
    joined = recalled.join(own, ["book_id", "chapter_index"])
    pos = F.row_number().over(Window.partitionBy("question_id").orderBy("book_id", "chapter_index", "paragraph_index")) - 1
    return joined.withColumn("pos", pos).filter(F.col("pos") < most)


def deduplicated(rows: DataFrame) -> DataFrame:
    """The first chunk of each paragraph."""
    order = Window.partitionBy("question_id", "book_id", "chapter_index", "paragraph_index").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def occurrences(text: Column, term: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def reranked(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds score, how often the question's terms are found, and rank, by score, then place. Overlapping terms count each."""
    asked = rows.join(questions.select("question_id", C.query_terms(F.col("question")).alias("_terms")), "question_id", "left")
    score = F.aggregate(F.coalesce("_terms", F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, t: a + occurrences(F.col("text"), t))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "pos"))
    return asked.withColumn("score", score).drop("_terms").withColumn("rank", rank)


def spread_over_chapters(ranked: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The first top_k chunks, numbered from 1 in `number`: of each chapter the best two, chapters by their best one; then the chapters' others."""
    chapter = Window.partitionBy("question_id", "book_id", "chapter_index")
    own = ranked.withColumn("_nth", F.row_number().over(chapter.orderBy("rank"))).withColumn("_first", F.min("rank").over(chapter))
    order = Window.partitionBy("question_id").orderBy((F.col("_nth") > MAX_PER_CHAPTER).cast("int"), "_first", "rank")
    return own.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= top_k).drop("_nth", "_first")


def selected(rows: DataFrame, questions: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Deduplicated, without empty chunks, long ones clipped, reranked, spread over chapters."""
    kept = deduplicated(rows.filter(F.col("pos") < MAX_CHUNKS)).withColumn("text", X.strip(F.col("text"))).filter("text <> ''")
    return spread_over_chapters(reranked(kept.withColumn("text", X.clip(F.col("text"), MAX_CHUNK_CHARS)), questions), top_k)


def short_ref(title: Column, chapter_index: Column, paragraph_index: Column) -> Column:
    return F.concat(F.lit("《"), title, F.lit("》第 "), (chapter_index + 1).cast("string"), F.lit(" 章第 "), (paragraph_index + 1).cast("string"), F.lit(" 段"))


def with_titles(chosen: DataFrame, books: DataFrame) -> DataFrame:
    """Adds book_title to chunks; books: book_id, title. A book without a title goes by its id."""
    names = books.select(F.col("book_id").alias("_of"), F.col("title").alias("_title"))
    return chosen.join(names, F.col("book_id") == F.col("_of"), "left").withColumn("book_title", F.coalesce("_title", F.col("book_id").cast("string"))).drop("_of", "_title")


def contexts(chosen: DataFrame) -> DataFrame:
    """(question_id, context): the chosen chunks (at most top_k a question) under numbered headers, by book_title if it is there."""
    ref = short_ref(F.col("book_title" if "book_title" in chosen.columns else "book_id").cast("string"), F.col("chapter_index"), F.col("paragraph_index"))
    block = F.concat(F.lit("【片段"), F.col("number").cast("string"), F.lit("｜"), ref, F.lit("】\n"), F.col("text"))
    return chosen.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", block.alias("block")))), lambda b: b.block), "\n\n").alias("context"))


def prompts(questions: DataFrame, context: DataFrame) -> DataFrame:
    """Adds context, system_prompt and user_prompt to questions: first the chunks, then the question; without chunks, that there are none."""
    joined = questions.join(context, "question_id", "left")
    asked = F.concat(F.lit(USER_PROMPT[0]), F.col("context"), F.lit(USER_PROMPT[1]), F.col("question"), F.lit(USER_PROMPT[2]))
    empty = F.concat(F.lit(NO_CONTEXT_PROMPT[0]), F.col("question"), F.lit(NO_CONTEXT_PROMPT[1]))
    return joined.withColumn("system_prompt", F.lit(SYSTEM_PROMPT)).withColumn("user_prompt", F.when(F.col("context").isNotNull(), asked).otherwise(empty))


def ask_coverage(questions: DataFrame, recalled: DataFrame) -> DataFrame:
    """(question_id, searched_books, indexed_books, hits): the books that were asked for, those with recalled chunks, and these chunks.

    questions: question_id and book_ids, an array.
    """
    found = recalled.groupBy("question_id").agg(F.count_distinct("book_id").alias("indexed_books"), F.count("*").alias("hits"))
    asked = questions.select("question_id", F.size(F.coalesce("book_ids", F.array().cast("array<string>"))).cast("long").alias("searched_books"))
    return asked.join(found, "question_id", "left").fillna(0, ["indexed_books", "hits"])


def citations(answer: Column) -> Column:
    """The first MAX_CITATIONS different numbers cited, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(_CITATION), F.lit(1)), lambda n: n.try_cast("int"))
    return F.slice(F.array_distinct(F.filter(found, lambda n: n.isNotNull())), 1, MAX_CITATIONS)


def without_invalid(answer: Column, n_chunks: Column) -> Column:
    """Without citations of chunks that are not there."""
    cited = F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(_CITATION), F.lit(1)))
    bad = F.filter(cited, lambda n: ~F.coalesce(n.try_cast("int").between(1, n_chunks), F.lit(False)))
    return F.aggregate(bad, F.coalesce(answer, F.lit("")), lambda a, n: F.replace(a, F.concat(F.lit("["), n, F.lit("]")), F.lit("")))


def cited_sentences(answer: Column, refs: Column) -> Column:
    """The sentences that cite one of refs; the whole answer if none does."""
    sentences = F.split(answer, "(?<=[。！？!?])")
    kept = F.filter(sentences, lambda s: F.exists(refs, lambda n: F.contains(s, F.concat(F.lit("["), n.cast("string"), F.lit("]")))))
    joined = X.strip(F.array_join(kept, ""))
    return F.when(joined == "", X.strip(answer)).otherwise(joined)


def validated(answers: DataFrame, configured: bool = True) -> DataFrame:
    """Adds refs, answer (empty without a valid citation), invalid (numbers cited that aren't there) and outcome.

    answers: question_id, raw, n_chunks (chunks handed to the model). Without a configured model no
    question is answered.
    """
    cleaned = without_invalid(F.col("raw"), F.col("n_chunks"))
    cited = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit(_CITATION), F.lit(1)), lambda n: n.try_cast("int")))
    bad = F.filter(cited, lambda n: ~n.between(1, F.col("n_chunks")))
    none = F.array().cast("array<int>")
    refs = F.when(F.col("n_chunks") > 0, citations(F.col("_clean"))).otherwise(none)
    shown = F.when(F.size("refs") > 0, cited_sentences(F.col("_clean"), F.col("refs"))).otherwise("")
    outcome = F.when(F.lit(not configured), "not-configured").when(F.col("n_chunks") == 0, "no-chunks").when(F.col("raw").isNull(), "llm-error").when(F.size("refs") == 0, "invalid-citations").otherwise("ok")
    invalid = F.when(F.col("n_chunks") > 0, bad).otherwise(none)
    return answers.withColumn("_clean", cleaned).withColumn("refs", refs).withColumn("answer", shown).withColumn("invalid", invalid).withColumn("outcome", outcome).drop("_clean")


def citation_rows(checked: DataFrame, chosen: DataFrame) -> DataFrame:
    """(question_id, number, book_id, chapter_index, paragraph_index, excerpt) of each citation that stands for a chunk, and its book_title and chapter_title if the chunks have them."""
    cited = checked.select("question_id", F.explode("refs").alias("number"))
    titles = [c for c in ("book_title", "chapter_title") if c in chosen.columns]
    return cited.join(chosen, ["question_id", "number"]).select("question_id", "number", "book_id", "chapter_index", "paragraph_index", *titles, X.clip(X.strip(F.col("text")), EXCERPT_CHARS).alias("excerpt"))


def ask(questions: DataFrame, chapters: DataFrame, model, top_k: int = TOP_K, books: DataFrame | None = None, index_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(validated answers, chosen chunks).

    index_path: an index of the chapters, to recall by; without one their texts are gone through.

    model(prompts) gives question_id and raw for the questions that have chunks, from what prompts()
    gives; None: no model is configured. books: book_id and title, for the chunks' headers.
    """
    terms = ladders(questions)
    recalled = recall(terms, chapters) if index_path is None else recall_by_index(questions.sparkSession, index_path, terms, search.texts_of(chapters))
    chosen = selected(chunks(recalled, chapters), questions, top_k)
    counted = chosen.groupBy("question_id").agg(F.count("*").alias("n_chunks"))
    counts = questions.select("question_id").join(counted, "question_id", "left").fillna(0, ["n_chunks"])
    if model is None:
        return validated(counts.withColumn("raw", F.lit(None).cast("string")), configured=False), chosen
    asked = prompts(questions, contexts(chosen if books is None else with_titles(chosen, books))).filter("context is not null")
    answers = counts.join(model(asked).select("question_id", "raw"), "question_id", "left")
    return validated(answers), chosen
