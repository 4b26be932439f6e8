"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them.

Everything here is DataFrame functions. Base spans are the leftmost non-overlapping matches of a
pattern per kind that pass its check. Matches come from regexp_extract_all, the gaps between them
from split with the same pattern, and positions are running sums of both.

Each base value is a protected entity. A term (a word of TERM_CHARS or more letters) in the same
sentence as an entity may give it away. The corpus says how much: with N distinct sentences, of
which n(t) hold the term, n(e) the entity and n(t, e) both, the term discloses
log2(N n(t, e) / (n(t) n(e))) of the log2(N / n(e)) bits that the entity carries. Terms that
disclose DISCLOSURE of an entity's bits are protected too, in that entity's sentences. An entity
found once is given away by what is rare enough to point to its sentence: by terms in at most the
(1 - DISCLOSURE)-th power of N sentences; common words stay. Only distinct sentences are counted,
so copies of a document neither prove nor disprove anything.

A sentence ends at a stop before white space or at a line's end, and may be as long as its text.
No pairs are needed where a term or an entity is in one sentence only: n(t, e) is 1 there, so that
counts of a sentence's entities decide. Others meet in a sentence only if the term is rare enough
to disclose the entity at all, which n(t) and n(e) tell before. A phone number over a stop and
white space is a base span that belongs to no sentence, and so has no terms.

Sanitised texts have a marker for each span: base values are removed for the kind's marker,
terms are generalised to what they look like, a name or a word.

Defined cases: a null or empty text has no spans and stays as it is; equal rows are treated
alike, and one by one; rows without doc_id are treated like others; no documents give no rows.
Columns other than the text, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import documents, identified, written

KINDS = ("email", "ip", "card", "phone", "term")
TERM_CHARS = 4
#: Share of an entity's information that a term has to give away.
DISCLOSURE = 0.9
#: Elements of an array, and characters of a text, that are worked through together.
BLOCK, CHUNK = 256, 4096

_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
_ORDERED = "array<struct<start:int,rank:bigint,end:int,kind:string,value:string>>"
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Each finds what the base pattern finds without trying a long run again from each of its characters. \G: where the last match ended.
#: Cards: runs of 14 to 19 digits with single separators, from their first digit to their last; other runs never count.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the pattern.
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(F.regexp_replace(value, r"[\x20-]", "")), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _sums_before(sizes: Column) -> Column:
    """For each of an array of integers the sum of those before it, by blocks, so that long arrays are not copied for each element."""
    running = lambda xs, size: F.aggregate(xs, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + size(x))))
    of_block = lambda xs, b: running(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)), lambda x: x)
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: of_block(xs, b))
    inner = lambda block: F.slice(block, F.lit(1), F.size(block) - 1)
    moved = lambda bs: F.zip_with(bs, running(bs, lambda block: F.element_at(block, -1)), lambda block, at: F.transform(inner(block), lambda x: x + at))
    whole = _with(sizes, lambda xs: _with(blocks(xs), lambda bs: F.flatten(F.slice(moved(bs), F.lit(1), F.size(bs)))))
    return F.when(F.size(sizes) > 0, whole).otherwise(F.array().cast("array<int>"))


def _found(text: Column, pattern: str, kind: str) -> Column:
    """(kind, start, end, value) of each match. Positions are in code points, ends exclusive."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda v, g: F.struct(F.length(g).alias("gap"), F.length(v).alias("own"), v.alias("value")))
    span = lambda x, at: F.struct(F.lit(kind).alias("kind"), (at + x.gap).alias("start"), (at + x.gap + x.own).alias("end"), x.value.alias("value"))
    return _with(F.filter(pairs, lambda x: x.value.isNotNull()), lambda xs: F.zip_with(xs, _sums_before(F.transform(xs, lambda x: x.gap + x.own)), span))


def _matches(text: Column, kind: str) -> Column:
    """The spans of a kind, failing ones dropped."""
    found = F.filter(_found(text, PATTERNS[kind], kind), lambda s: _passes(kind, s.value))
    hint = _HINTS[kind]
    there = F.contains(text, F.lit(hint)) if hint else text.rlike(PATTERNS[kind])
    return F.when(there, found).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """All base spans of a text: an array of (kind, start, end, value), kind by kind."""
    clean = F.coalesce(text, F.lit(""))
    return F.concat(*[_matches(clean, kind) for kind in KINDS[:4]])


def _order(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    listed = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.array_position(listed, s.kind).alias("rank"), s.end.alias("end"), s.kind.alias("kind"), s.value.alias("value")))
    return F.array_sort(keyed)


def digest(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(_order(spans), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


_WORD = rf"[\p{{L}}]{{{TERM_CHARS},}}"
#: Sentences with what ends them: one after the other they make up the text.
_SENTENCE = r"[^\n]*?(?:[.!?](?=\s|\z)|\n|\z)"


def _sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0))


def _bare(sentence: Column) -> Column:
    return F.trim(sentence, F.lit(" \t\r\n"))


def _terms(sentence: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(sentence, F.lit(_WORD), F.lit(0)), lambda w: F.lower(w)))


def _entities(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s.kind, F.lower(s.value))))


def risky_sentences(text: Column) -> Column:
    """(start, sentence, own) of each sentence with base spans; own: these, from the sentence's start."""
    placed = _with(_sentences(text), lambda xs: F.zip_with(xs, _sums_before(F.transform(xs, lambda x: F.length(x))), lambda x, at: F.struct(at.alias("start"), x.alias("sentence"), base_spans(x).alias("own"))))
    return F.filter(placed, lambda x: F.size(x.own) > 0)


class Counted(NamedTuple):
    """What the corpus says about the distinct sentences with base spans."""

    #: `sentence` (its key), `entity`, `n_entity` and `own`, the words of the entity itself; entities in every sentence carry nothing and are left out.
    entities: DataFrame
    #: `sentence`, `term` and `n_term`; only terms that are rare enough to disclose any entity.
    terms: DataFrame
    #: Distinct sentences of the corpus.
    total: float


def _key(sentence: Column) -> Column:
    return F.sha2(_bare(sentence), 256)


def counted(texts: DataFrame, risky: DataFrame) -> Counted:
    """texts: `text`, of all documents; risky: `sentence` and `own` of the sentences with base spans."""
    near = risky.select(_bare(F.col("sentence")).alias("sentence"), _entities(F.col("own")).alias("entities")).distinct()
    held = written(near.select(_key(F.col("sentence")).alias("sentence"), "entities", _terms(F.col("sentence")).alias("terms")), "pii-sentences")
    entities = held.select("sentence", F.explode("entities").alias("entity"))
    entities = written(entities.join(entities.groupBy("entity").agg(F.count("*").alias("n_entity")), "entity"), "pii-entities")
    # how many distinct sentences of the corpus hold each term; the empty term counts the sentences themselves
    every = texts.select(F.explode(_sentences(F.coalesce("text", F.lit("")))).alias("s")).select(_bare(F.col("s")).alias("s")).filter("s <> ''").distinct()
    spread = every.select(F.explode(F.concat(F.array(F.lit("")), _terms(F.col("s")))).alias("term"))
    counts = written(spread.groupBy("term").agg(F.count("*").alias("n_term")), "pii-counts")
    total = float(counts.filter("term = ''").agg(F.max("n_term")).first()[0] or 0)
    most = float(entities.agg(F.max("n_entity")).first()[0] or 0)
    # terms in more sentences than this disclose too little of any entity
    rare = counts.filter(_rare(F.col("n_term"), F.lit(most), total))
    terms = written(held.select("sentence", F.explode("terms").alias("term")).join(rare, "term"), "pii-rare")
    return Counted(entities.filter(F.col("n_entity") < total).withColumn("own", _terms(F.col("entity"))), terms, total)


def _rare(n_term: Column, n_entity: Column, total: float) -> Column:
    """Whether a term could disclose an entity, as n(t, e) is n(e) at most."""
    return F.log2(n_term) <= (1 - DISCLOSURE) * F.log2(F.lit(total)) + DISCLOSURE * F.log2(n_entity) + 1e-9


def _disclosing(pairs: DataFrame, total: float) -> DataFrame:
    """(entity, term, bits, share) of the pairs (one row for each sentence with both) that reach DISCLOSURE."""
    both = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both"))
    bits = F.log2(F.lit(total) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    carried = F.log2(F.lit(total) / F.col("n_entity"))
    return both.withColumn("bits", bits).withColumn("share", F.try_divide(bits, carried)).filter(F.col("share") >= DISCLOSURE).select("entity", "term", "bits", "share")


def _pairs(entities: DataFrame, terms: DataFrame, total: float) -> DataFrame:
    """Entities and terms of the same sentence, if the term may disclose the entity and is no word of it."""
    met = entities.join(terms, "sentence").filter(_rare(F.col("n_term"), F.col("n_entity"), total))
    return met.filter(~F.array_contains("own", F.col("term"))).select("sentence", "entity", "n_entity", "term", "n_term")


def disclosing_terms(texts: DataFrame, risky: DataFrame) -> DataFrame:
    """(entity, term, bits, share): every term that gives an entity away, for reports; texts and risky as in counted()."""
    entities, terms, total = counted(texts, risky)
    return _disclosing(_pairs(entities, terms, total), total)


def disclosed(known: Counted) -> DataFrame:
    """(sentence, term): the terms that give away an entity of their sentence, each once, without a row for each such entity."""
    entities, terms, total = known
    # a term of one sentence discloses all of each entity there; an entity of one sentence is disclosed by all that is rare enough
    once = F.col("n_entity") == 1
    there = entities.groupBy("sentence").agg(F.count("*").alias("n_any"), F.count_if(once).alias("n_once"))
    part = entities.select("sentence", "n_entity", F.explode("own").alias("term")).groupBy("sentence", "term").agg(F.count("*").alias("any_own"), F.count_if(once).alias("once_own"))
    placed = terms.join(there, "sentence").join(part, ["sentence", "term"], "left")
    left = lambda n, own: F.col(n) > F.coalesce(F.col(own), F.lit(0))
    single = placed.filter((F.col("n_term") == 1) & left("n_any", "any_own") | _rare(F.col("n_term"), F.lit(1.0), total) & left("n_once", "once_own"))
    pairs = written(_pairs(entities.filter(~once), terms.filter("n_term > 1"), total), "pii-pairs")
    several = pairs.join(_disclosing(pairs, total), ["entity", "term"], "left_semi")
    return single.select("sentence", "term").unionByName(several.select("sentence", "term")).distinct()


def _clear(terms: DataFrame, base: DataFrame) -> DataFrame:
    """The spans (`_at`, `kind`, `start`, `end`, `value`) of terms that no base span of their row overlaps."""
    both = terms.withColumn("base", F.lit(False)).unionByName(base.withColumn("base", F.lit(True)))
    # ends of base spans up to here, starts of base spans from here on; both frames take in equal starts
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(Window.partitionBy("_at").orderBy("start"))
    begun = F.min(F.when(F.col("base"), F.col("start"))).over(Window.partitionBy("_at").orderBy(F.desc("start")))
    free = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(begun, F.col("end")) >= F.col("end"))
    return both.withColumn("free", free).filter("free and not base").drop("free", "base")


def spans(rows: DataFrame, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """`_at`, `kept` (the columns in keep), `base` and `spans` (those and the disclosing terms', by start, then kind) of each row.

    rows: see identified().
    """
    named = rows.select("_at", F.struct(*[F.col(f"_row.`{c}`").alias(c) for c in keep]).alias("kept") if keep else F.lit(0).alias("kept"), F.coalesce(F.col(f"_row.`{text}`").cast("string"), F.lit("")).alias("text"))
    based = named.withColumn("base", base_spans(F.col("text")))
    risk = F.when(F.size("base") > 0, risky_sentences(F.col("text")))
    found = written(based.select("_at", "kept", "base", risk.alias("risky")), "pii")
    risky = found.select("_at", F.explode("risky").alias("r")).select("_at", "r.*")
    given = written(disclosed(counted(named.select("text"), risky)), "pii-terms")
    words = risky.select("_at", "start", _key(F.col("sentence")).alias("sentence"), F.explode(_found(F.col("sentence"), _WORD, "term")).alias("w"))
    met = words.withColumn("term", F.lower("w.value")).join(given, ["sentence", "term"], "left_semi")
    placed = met.select("_at", "w.kind", (F.col("w.start") + F.col("start")).alias("start"), (F.col("w.end") + F.col("start")).alias("end"), "w.value")
    clear = _clear(placed, found.select("_at", F.explode("base").alias("s")).select("_at", "s.*"))
    more = clear.groupBy(F.col("_at").alias("_of")).agg(F.collect_set(F.struct("kind", "start", "end", "value")).alias("more"))
    joined = found.join(more, found["_at"] == more["_of"], "left")
    return joined.select("_at", "kept", "base", _order(F.concat("base", F.coalesce("more", F.array().cast(_SPANS)))).alias("spans"))


def _marker(s: Column) -> Column:
    first = F.substring(s.value, 1, 1)
    return F.when(s.kind != "term", F.concat(F.lit("<"), F.upper(s.kind), F.lit(">"))).when(first != F.lower(first), F.lit("<NAME>")).otherwise(F.lit("<WORD>"))


def sanitised(text: Column, ordered: Column) -> Column:
    """The text with a marker for each span; of spans that overlap, the first is marked and the others' rest is removed with it.

    Texts are worked through by chunks of CHUNK characters, each with the spans that reach into it.
    """

    def step(chunk: Column, low: Column) -> Callable[[Column, Column], Column]:
        def take(a: Column, s: Column) -> Column:
            put = F.when(s.start < a.at, a.out).otherwise(F.concat(a.out, F.array(F.substr(chunk, a.at - low + 1, s.start - a.at), _marker(s))))
            return F.when(s.end <= a.at, a).otherwise(F.struct(s.end.alias("at"), put.alias("out")))

        return take

    def piece(chunk: Column, k: Column, spans: Column) -> Column:
        low = k * CHUNK
        inside = F.filter(spans, lambda s: (s.start < low + CHUNK) & (s.end > low))
        done = F.aggregate(inside, F.struct(low.alias("at"), F.array().cast("array<string>").alias("out")), step(chunk, low))
        return _with(done, lambda d: F.concat(F.array_join(d.out, ""), F.substr(chunk, d.at - low + 1, F.greatest(low + CHUNK - d.at, F.lit(0)))))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    whole = _with(ordered, lambda spans: F.array_join(F.transform(chunks, lambda c, k: piece(c, k, spans)), ""))
    return F.when(F.size(ordered) == 0, text).otherwise(whole)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(identified(documents(spark, sf_dir)), ("doc_id",))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("kept.doc_id", *map(count, KINDS[:4]), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their texts sanitised, and n_chars, if it is there, to match."""
    rows = identified(docs)
    # rows without spans are as they were; texts meet the spans of their own rows alone
    marked = spans(rows).filter(F.size("spans") > 0).select(F.col("_at").alias("_of"), "spans")
    found = rows.join(marked, F.col("_at") == F.col("_of"), "left").select("_row", F.coalesce("spans", F.array().cast(_ORDERED)).alias("_spans"))
    text = sanitised(F.col("_row.text"), F.col("_spans"))
    out = found.select("_row", "_spans", text.alias("_text"))
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    columns["text"] = F.col("_text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size("_spans") == 0, F.col("_row.n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[value.alias(c) for c, value in columns.items()])


QUERIES = {"op5_pii": query}
