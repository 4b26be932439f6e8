"""Disclosed information in plain loops, and that copies of a document neither prove nor disprove anything."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import pii
from lectern.llm.common import identified


def _shares(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    risky = docs.select(F.explode(pii.risky_sentences(F.coalesce("text", F.lit("")))).alias("r")).select("r.*")
    return {(r.entity, r.term): (round(r.bits, 9), round(r.share, 9)) for r in pii.disclosing_terms(docs, risky).collect()}


def _plain(texts):
    sentences = {s.strip(" \t\r\n") for t in texts for s in re.findall(r"[^\n]*?(?:[.!?](?=\s|\Z)|\n|\Z)", t or "")} - {""}
    words = {s: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", s)} for s in sentences}
    emails = {s: {f"email:{m.lower()}" for m in re.findall(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", s)} for s in sentences}
    out = {}
    for e in {e for es in emails.values() for e in es}:
        own = [s for s in sentences if e in emails[s]]
        for t in {w for s in own for w in words[s] if w not in e}:
            n_t, n_both = sum(t in w for w in words.values()), sum(t in words[s] for s in own)
            bits, carried = math.log2(len(sentences) * n_both / (n_t * len(own))), math.log2(len(sentences) / len(own))
            if carried and bits / carried >= pii.DISCLOSURE:
                out[e, t] = (round(bits, 9), round(bits / carried, 9))
    return out


def test_equals_plain_loops(spark):
    rng = random.Random(4)
    names = ["Zebulon", "Quirina", "Ottoline", "Balthasar"]
    texts = [None, "", "a@b.cd"]
    for i in range(200):
        words = [rng.choice(["plain", "line", "with", "some", "number", "writes"]) for _ in range(6)]
        if i % 10 == 0:
            words.insert(2, f"{rng.choice(names)} to box{i % 40}@mail.org, or to Common@mail.org")
        texts.append(" ".join(words) + rng.choice([".", "!\n", ". Another sentence here?", ""]))
    want = _plain(texts)
    assert want and any(n[1] == "zebulon" for n in want)
    assert _shares(spark, texts) == want


def _sentences_of(text):
    at = 0
    for s in re.findall(r"[^\n]*?(?:[.!?](?=\s|\Z)|\n|\Z)", text or ""):
        yield at, s
        at += len(s)


def _plain_spans(texts):
    """All spans of each text: e-mail addresses, and the words that give one of their sentence away."""
    given = _plain(texts)
    out = []
    for t in texts:
        spans = {(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t or "")}
        base = sorted(spans)
        for at, s in _sentences_of(t):
            own = {f"email:{m.lower()}" for m in re.findall(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", s)}
            for m in re.finditer(r"[^\W\d_]{4,}", s):
                low, high = at + m.start(), at + m.end()
                if any((e, m.group().lower()) in given for e in own) and not any(a < high and low < b for a, b, _ in base):
                    spans.add((low, high, "term"))
        out.append(",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans)))
    return out


def _texts_with_names(seed):
    rng = random.Random(seed)
    names = ["Zebulon", "Quirina", "Ottoline", "Balthasar", "Émerence"]
    texts = [None, "", "a@b.cd", "éabcd@mail.org and éabcd@mail.org"]
    for i in range(400):
        words = [rng.choice(["plain", "line", "with", "some", "number", "writes"]) for _ in range(rng.choice([3, 6, 400]))]
        if i % 5 == 0:
            for _ in range(rng.randrange(1, 5)):
                k = rng.randrange(40)
                put = [f"only{chr(97 + k // 10)}{chr(97 + k % 10)}", rng.choice(names), f"box{rng.choice([k, k, i])}@mail.org", rng.choice(["Common@mail.org", f"{rng.choice(names[:4])}@home.net"])]
                for word in rng.sample(put, rng.randrange(1, 5)):
                    words.insert(rng.randrange(len(words)), word)
        texts.append(" ".join(words) + rng.choice([".", "!\n", ". Another sentence here?", "", "\n😀 é "]))
    return texts + texts[20:25]


def test_all_positions_equal_plain_loops(spark):
    for seed in (1, 2):
        texts = _texts_with_names(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
        got = {r.doc_id: r.s for r in pii.spans(identified(docs), ("doc_id",)).select("kept.doc_id", pii.digest(F.col("spans")).alias("s")).collect()}
        want = _plain_spans(texts)
        assert sum(w.count("term") for w in want) > 30
        assert [got[i] for i in range(len(texts))] == want


def test_disclosed_are_the_terms_of_all_pairs(spark):
    texts = _texts_with_names(3)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    risky = docs.select(F.explode(pii.risky_sentences(F.coalesce("text", F.lit("")))).alias("r")).select("r.*")
    known = pii.counted(docs, risky)
    pairs = pii._pairs(known.entities, known.terms, known.total)
    every = pairs.join(pii.disclosing_terms(docs, risky), ["entity", "term"], "left_semi").select("sentence", "term").distinct()
    got = [tuple(r) for r in pii.disclosed(known).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in every.collect()}


def test_name_far_from_its_address_in_a_long_sentence(spark):
    other = [f"plain line {i} with number and writes" for i in range(300)]
    for gap in (5, 500, 50000):
        text = f"Zebulon asked that {'mail ' * (gap // 5)}go to zeb@wonder.org"
        docs = spark.createDataFrame(list(enumerate([text, *other])), "doc_id int, text string")
        found = pii.spans(identified(docs), ("doc_id",)).filter("kept.doc_id = 0").first().spans
        assert ("term", 0, 7) in {(s.kind, s.start, s.end) for s in found}, gap


def test_one_sentence_of_many_entities_and_terms(spark):
    word = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:05d}")
    n = 4000
    text = " ".join(f"x{i}@mail.org {word(i)}" for i in range(n))
    docs = spark.createDataFrame([(0, text)] + [(i, f"plain line {i}") for i in range(1, 200)], "doc_id int, text string")
    found = pii.spans(identified(docs), ("doc_id",)).filter("kept.doc_id = 0").first().spans
    assert sum(s.kind == "term" for s in found) == n and sum(s.kind == "email" for s in found) == n


def test_copies_change_nothing(spark):
    told = [f"Zebulon number {i} writes to zeb@wonder.org" for i in range(3)]
    other = [f"plain line {i} with number and writes" for i in range(300)]
    once = _shares(spark, told + other)
    assert once[("email:zeb@wonder.org", "zebulon")][1] == 1
    assert _shares(spark, told * 200 + other) == once
    assert _shares(spark, told + other * 20) == once
    assert _shares(spark, ["\n".join(told + other)]) == once


def test_entity_in_every_sentence_carries_nothing(spark):
    assert _shares(spark, [f"Zebulon number {i} writes to zeb@wonder.org" for i in range(3)]) == {}


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_sums_before(spark, n):
    sizes = [i * 7 % 11 for i in range(n)]
    got = spark.createDataFrame([(sizes,)], "x array<int>").select(pii._sums_before(F.col("x"))).first()[0]
    assert got == [sum(sizes[:i]) for i in range(n)]


def test_sentences_make_up_the_text(spark):
    texts = ["", "One. Two! Three", "a.b c.d. e\n\nf\n", "x" * 1000, ("word " * 300).strip(), "é😀. " * 90 + "\n"]
    for text, found in zip(texts, spark.createDataFrame([(t,) for t in texts], "t string").select(pii._sentences(F.col("t"))).collect()):
        assert "".join(found[0]) == text


def test_long_texts_are_sanitised_by_chunks(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("ab é😀\n") for _ in range(3 * pii.CHUNK + 17))
    cuts = sorted(rng.sample(range(len(text)), 200)) + [pii.CHUNK - 5]
    spans = sorted((a, min(len(text), a + rng.choice([1, 9, 200])), rng.choice(["email", "term"])) for a in cuts)
    want, at = [], 0
    for a, b, kind in spans:
        if b <= at:
            continue
        if a >= at:
            value = text[a:b]
            want += [text[at:a], "<EMAIL>" if kind == "email" else "<WORD>"]
        at = b
    want.append(text[at:])
    rows = [(text, [(a, 0, b, kind, text[a:b].lower()) for a, b, kind in spans])]
    got = spark.createDataFrame(rows, f"t string, s {pii._ORDERED}").select(pii.sanitised(F.col("t"), F.col("s"))).first()[0]
    assert got == "".join(want)
