"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the words found in
it, each with its beginnings of PREFIXES characters; the document's is their noisy-or, 1 - (1 - LEAK) * product of (1 - score). Only documents
have labels: the loss of the documents' scores is carried back through the noisy-or, so a toxic
document teaches the sentences that already look most toxic. The model then locates them.

The model is fitted on a bounded sample of labelled documents (SAMPLE of each label, by a hash of
doc_id, weighted back to the labels' shares); its words number at most the sample's. Scoring
reads whole texts.

Defined cases: a null or empty text has no sentences and scores LEAK; labels that are null or
repeated: null ones are left out, of repeated ones the largest counts; if one label is missing
altogether, every document scores that sample's share of toxic ones (0 without any labels);
rows that repeat a doc_id are scored one by one; a null doc_id is scored, never learnt from.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import crc32_mod, documents

HELD_OUT_MOD = 5
#: Labelled documents of each label that the model is fitted on, at most.
SAMPLE = 3000
LEAK = 1e-3
#: A word counts if it is in so many documents of the sample.
MIN_DOCUMENTS = 4
PREFIXES = (3, 4, 5, 6, 7)
#: Words and beginnings whose presence tells labels apart by at least this log-likelihood ratio get weights.
TELLING = 32.0
STEPS, RATE, L2 = 150, 0.1, 1e-4
#: Weights under this are dropped from the model.
SMALL = 0.02

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)]


class _Weights(dict):
    """Sums of weights by word, found as words come up."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        get = self.weights.get
        found = self[word] = sum(get(x, 0.0) for x in features(word))
        return found


class Model:
    def __init__(self, weights: dict[str, float], bias: float, constant: float | None = None) -> None:
        #: constant: if a label is missing, every document's score.
        self.weights, self.bias, self.constant = weights, bias, constant
        self.weigh = _Weights(weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias, self.constant)


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, words) of each sentence that has a word."""
    lowered = text.lower()
    same = len(lowered) == len(text)
    for m in _SENTENCE.finditer(lowered if same else text):
        if words := set(_WORD.findall(m[0] if same else m[0].lower())):
            yield m.start(), m.end(), words


def telling(seen: np.ndarray, n_documents: np.ndarray) -> np.ndarray:
    """Which features have a share of documents that differs between the labels beyond chance. seen: documents by label and feature."""
    every, together = n_documents.sum(), seen.sum(axis=0)
    ratio = np.zeros(seen.shape[1])
    for own, n in zip(seen, n_documents, strict=True):
        for k, both in ((own, together), (n - own, every - together)):
            expected = n * both / every
            ratio += 2 * np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(expected, 1e-12)), 0)
    return (together >= MIN_DOCUMENTS) & (ratio >= TELLING)


def _gather(at: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values[at[r]:at[r + 1]] of each row r one after the other, how many each has)."""
    sizes = at[rows + 1] - at[rows]
    first = np.cumsum(sizes) - sizes
    return values[np.arange(sizes.sum()) + np.repeat(at[rows] - first, sizes)], sizes


def fit(texts: Iterable[str], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Adam on the weighted log loss of the noisy-or. Words and features are held as numbers."""
    if not len(labels) or labels.min() == labels.max():
        return Model({}, 0.0, float(labels[0]) if len(labels) else 0.0)
    ids: dict[str, int] = {}
    words, in_sentence, in_doc = array("i"), array("i"), array("i")
    for text in texts:
        n = 0
        for _, _, found in sentences(text):
            words.extend([ids.setdefault(w, len(ids)) for w in sorted(found)])
            in_sentence.append(len(found))
            n += 1
        in_doc.append(n)
    names: dict[str, int] = {}
    of_word, ends = array("i"), array("q", [0])
    for w in ids:
        of_word.extend([names.setdefault(x, len(names)) for x in features(w)])
        ends.append(len(of_word))
    flat_words, sizes, bags = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (words, in_sentence, in_doc))
    own, at = np.frombuffer(of_word, np.int32) if len(of_word) else np.zeros(0, np.int32), np.frombuffer(ends, np.int64)
    word_ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(bags)])]
    seen = np.zeros((2, len(names)))
    for i, y in enumerate(labels.tolist()):
        seen[y, np.unique(_gather(at, own, np.unique(flat_words[word_ends[i] : word_ends[i + 1]]))[0])] += 1
    chosen = np.flatnonzero(telling(seen, np.bincount(labels, minlength=2)))
    column = np.full(len(names), -1, np.int64)
    column[chosen] = np.arange(len(chosen))
    used = column[own] >= 0
    own, at = column[own[used]], np.concatenate([[0], np.cumsum(used)])[at]
    flat, counts = _gather(at, own, flat_words)
    of_doc = np.repeat(np.arange(len(bags)), bags)
    of_sentence = np.repeat(np.repeat(np.arange(len(sizes)), sizes), counts)
    w, bias = np.zeros(len(chosen)), -5.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    scale = weights / weights.sum()
    for step in range(1, STEPS + 1):
        z = np.bincount(of_sentence, weights=w[flat], minlength=len(sizes)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(of_doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(bags)) + np.log1p(-LEAK)
        clean = np.exp(log_clean)
        pull = np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * scale
        dz = pull[of_doc] * p
        gradient = np.append(np.bincount(flat, weights=dz[of_sentence], minlength=len(chosen)) + L2 * w, dz.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w -= move[:-1]
        bias -= move[-1]
    listed = list(names)
    return Model({listed[k]: float(w[i]) for i, k in enumerate(chosen.tolist()) if abs(w[i]) >= SMALL}, float(bias))


def score_text(text: str, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """(the document's score, (start, end, score) of its sentences)."""
    if model.constant is not None:
        return model.constant, []
    weigh, found, log_clean = model.weigh, [], float(np.log1p(-LEAK))
    for start, end, words in sentences(text):
        z = model.bias + sum(map(weigh.__getitem__, sorted(words)))
        if z > -14:
            p = 1 / (1 + np.exp(-min(z, 30.0)))
            log_clean += float(np.log1p(-min(p, 1 - 1e-12)))
            found.append((start, end, float(p)))
    return float(-np.expm1(log_clean)), found


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model fitted on documents whose crc32(doc_id) modulo HELD_OUT_MOD is not 0."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc32_mod("doc_id", HELD_OUT_MOD) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("labelled")
    chosen = None
    for y in sorted(totals):
        some = known.filter(F.col("toxic") == y).orderBy(order, "labelled").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return Model({}, 0.0, 0.0)
    # 2 * SAMPLE rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), texts["id"] == chosen["labelled"]).groupBy("id", "toxic").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int64()), ("toxic", pa.int32()), ("text", pa.string())])).sort_by("id")
        toxic = own["toxic"].to_pylist()
        share = Counter(toxic)
        y = np.array([int(t > 0) for t in toxic], np.int64)
        model = fit((x.as_py() for x in own["text"]), y, np.array([totals[t] / share[t] for t in toxic]))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)])})

    # the sample is bounded, so it is learnt from in one task
    return pickle.loads(rows.select("id", "toxic", "text").repartition(1).mapInArrow(learn, "model binary").first()["model"])


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in keep, score, and the offending sentences (start, end, score), worst first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("sentences", spans)])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, located = [], []
            for x in batch.column(len(keep)):
                score, found = score_text(x.as_py() or "", shared.value)
                scores.append(score)
                bad = sorted((f for f in found if f[2] >= 0.5), key=lambda f: (-f[2], f[0]))
                located.append([{"start": a, "end": b, "score": p} for a, b, p in bad])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array(located, arrow)], [*keep, "score", "sentences"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs, model)
    return found.select("doc_id", (crc32_mod("doc_id", HELD_OUT_MOD) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_sentences"))


QUERIES = {"op3_toxicity": query}
