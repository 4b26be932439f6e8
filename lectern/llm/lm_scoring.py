"""Log-likelihood of whole documents under a gated recurrent language model.

Tokens are a text's words, A-Z lower-cased, and one end for each text. Three passes over the
documents, none of which moves a text over the network:

1. Counts of all tokens of the training documents.
2. Training. A bounded sample (WARM_DOCUMENTS, at most WARM_TOKENS tokens) gives a first model.
   Every partition goes on from it over all of its own training documents, by truncated
   backpropagation in numpy, and the partitions' models are averaged by their tokens, FAN at a
   time until one is left.
3. Scoring. The state starts at zero with each document and is carried through to its end, so
   the sum is the likelihood of the complete document.

The model predicts the VOCABULARY most frequent tokens and one symbol for all others through a
class-factored softmax, P(class) P(token | class), with classes of about equal sums of root
frequencies, mixed with PLAIN of their plain frequencies. What stands behind the symbol is spread by counts, (c + 1) over the sum of these for
all tokens outside the vocabulary and one for the unseen, so probabilities add up over any text.

Counts of tokens with a share of COMMON_SHARE or more are sent to the tasks (1 / COMMON_SHARE of
them at most); the counts of all others are joined to the documents that hold them.

Defined cases: a null or empty text is its end alone; rows that repeat a doc_id, and equal rows,
are scored one by one; a null doc_id hashes as the empty text; without training documents the
model is the untrained one and every count is 0; no documents give no rows. Extra columns are
left out of the result unless named in keep.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import words as W
from lectern.llm.common import crc32_mod, documents, written
from lectern.llm.tokenizing import parts

HELD_OUT_MOD, HELD_OUT = 7, 2
#: The end of a text; no word is empty.
END = ""
VOCABULARY = 2048
COMMON_SHARE = 1e-6
STATE, CLASSES = 24, 28
#: Steps that errors are carried back.
STEPS = 16
LANES, WARM_LANES = 256, 48
WARM_DOCUMENTS, WARM_TOKENS, WARM_ROUNDS = 1500, 1_200_000, 2
RATE = 0.1
#: Share of plain frequencies in the probability of a symbol, against overconfidence after little data.
PLAIN = 0.02
FAN = 64
#: Tokens whose output is worked out together when scoring.
OUTPUT_BLOCK = 1 << 15


class Lexicon:
    """Common tokens with their counts, the model's symbols and their classes."""

    def __init__(self, tokens: pa.Array, counts: np.ndarray, total: int, distinct: int, vocabulary: int = VOCABULARY) -> None:
        self.tokens, self.counts, self.total, self.distinct = tokens, counts, total, distinct
        order = np.lexsort((np.arange(len(counts)), -counts))[: vocabulary - 1]
        self.rest = float(total + distinct + 1 - (counts[order] + 1).sum()) if len(order) else float(total + distinct + 1)
        # one symbol is for all tokens outside of the vocabulary
        weight = np.append(counts[order] + 1.0, max(self.rest, 1.0))
        by_weight = np.argsort(-weight, kind="stable")
        symbol = np.empty(len(weight), np.int32)
        symbol[by_weight] = np.arange(len(weight), dtype=np.int32)
        self.unknown = int(symbol[-1])
        self.symbol = np.full(len(counts), self.unknown, np.int32)
        self.symbol[order] = symbol[:-1]
        self.weight = weight[by_weight]
        root = np.cumsum(np.sqrt(self.weight))
        of = np.minimum((root - np.sqrt(self.weight)) / root[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        self.class_of = np.unique(of, return_inverse=True)[1]
        self.bounds = np.append(np.flatnonzero(np.diff(self.class_of, prepend=-1)), len(weight))
        at = pc.index_in(pa.scalar(END, pa.large_string()), value_set=tokens).as_py() if len(tokens) else None
        self.end_at = -1 if at is None else at
        self.end = self.unknown if at is None else int(self.symbol[at])

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Where each token stands among the common ones, -1 if it doesn't."""
        return pc.fill_null(pc.index_in(distinct.cast(pa.large_string()), value_set=self.tokens), -1).to_numpy().astype(np.int64)

    def symbols(self, places: np.ndarray) -> np.ndarray:
        if not len(self.symbol):
            return np.full(len(places), self.unknown, np.int32)
        return np.where(places < 0, np.int32(self.unknown), self.symbol[places])


class Lanes(NamedTuple):
    """Documents laid end to end in lanes, step by step: step t takes places cut[t]:cut[t + 1], its lanes in order."""

    cut: np.ndarray
    inputs: np.ndarray
    targets: np.ndarray
    document: np.ndarray
    #: 0 where a document begins, else 1.
    keep: np.ndarray


def divided(offsets: np.ndarray, lanes: int) -> np.ndarray:
    """The offsets with documents longer than an even share of a lane cut at such shares, so that no lane goes on alone."""
    share = max(STEPS, -(-int(offsets[-1]) // lanes))
    return np.unique(np.concatenate([offsets, *(np.arange(a, b, share) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) if b - a > share)]))


def lay_out(symbols: np.ndarray, offsets: np.ndarray, end: int, lanes: int) -> Lanes:
    """symbols[offsets[i]:offsets[i + 1]]: document i, its end included."""
    length = np.diff(offsets)
    lanes = max(1, min(lanes, len(length)))
    loads = [(0, k) for k in range(lanes)]
    lane, begin = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for i in np.argsort(-length, kind="stable").tolist():
        load, k = loads[0]
        lane[i], begin[i] = k, load
        heapq.heapreplace(loads, (load + int(length[i]), k))
    total = np.zeros(lanes, np.int64)
    for load, k in loads:
        total[k] = load
    order = np.argsort(-total, kind="stable")
    rank = np.empty(lanes, np.int64)
    rank[order] = np.arange(lanes)
    total = total[order]
    steps = int(total[0]) if len(length) else 0
    active = np.searchsorted(-total, -np.arange(steps), side="left")
    cut = np.concatenate([[0], np.cumsum(active)])
    document = np.repeat(np.arange(len(length)), length)
    place = cut[begin[document] + np.arange(len(symbols)) - offsets[document]] + rank[lane[document]]
    previous = np.empty(len(symbols), np.int32)
    previous[1:] = symbols[:-1]
    first = offsets[:-1][length > 0]
    previous[first] = end
    keep = np.ones(len(symbols), np.float32)
    keep[first] = 0

    def moved(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[place] = x
        return out

    return Lanes(cut, moved(previous), moved(symbols.astype(np.int32)), moved(document), moved(keep))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    # an overflow gives the infinity whose inverse is right
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _exponentials(states: np.ndarray, weights: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exp(x), their sums by row, x at each row's target) of the logits x = states @ weights, a column of weights for each.

    States lie within -1 and 1. What lies within the bounds can neither overflow nor add up to zero, and small weights keep it there.
    """
    x = states @ weights
    if np.abs(weights).sum(axis=0).max() > 80:
        np.clip(x, -80, 80, out=x)
    picked = x[np.arange(len(targets)), targets]
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], np.float32), picked


def _log_probability(states: np.ndarray, weights: np.ndarray, targets: np.ndarray) -> np.ndarray:
    _, sums, picked = _exponentials(states, weights, targets)
    return picked.astype(np.float64) - np.log(sums)


def _error(states: np.ndarray, weights: np.ndarray, targets: np.ndarray, n: np.float32) -> np.ndarray:
    """The gradient of the loss, over n, by the logits."""
    x, sums, _ = _exponentials(states, weights, targets)
    x *= (1 / (sums * n))[:, None]
    x[np.arange(len(targets)), targets] -= 1 / n
    return x


class Model:
    """A GRU and its class-factored output layer; every parameter is a view of one flat array."""

    def __init__(self, lexicon: Lexicon, flat: np.ndarray | None = None) -> None:
        self.lexicon = lexicon
        k, c, h = len(lexicon.weight), len(lexicon.bounds) - 1, STATE
        # "input" holds what each symbol adds to the gates; the output's last weights go with a state of ones
        self.shapes = {"input": (k, 3 * h), "state": (h, 3 * h), "gate": (3 * h,), "classes": (h + 1, c), "words": (k, h + 1)}
        size = sum(int(np.prod(s)) for s in self.shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else flat
        self.of = self.views(self.flat)
        if flat is None:
            random = np.random.default_rng(7)
            for name, scale in (("input", 0.15), ("state", 0.2), ("classes", 0.05), ("words", 0.05)):
                self.of[name][:] = random.standard_normal(self.shapes[name]) * scale
            by_class = np.add.reduceat(lexicon.weight, lexicon.bounds[:-1])
            self.of["classes"][-1] = np.log(by_class / by_class.sum())
            self.of["words"][:, -1] = np.log(lexicon.weight / by_class[lexicon.class_of])

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    @np.errstate(over="ignore")
    def log_likelihood(self, x: Lanes, n_documents: int) -> np.ndarray:
        """Natural log-likelihood of each document."""
        p, h = self.of, np.zeros((int(x.cut[1]) if len(x.cut) > 1 else 0, STATE), np.float32)
        table = p["input"] + p["gate"]
        total = np.zeros(n_documents)
        low = 0
        hidden = np.ones((OUTPUT_BLOCK + LANES, STATE + 1), np.float32)
        for t in range(len(x.cut) - 1):
            a, b = int(x.cut[t]), int(x.cut[t + 1])
            h = h[: b - a] * x.keep[a:b, None]
            g, u = table[x.inputs[a:b]], h @ p["state"]
            g[:, : 2 * STATE] += u[:, : 2 * STATE]
            zr = _sigmoid(g[:, : 2 * STATE])
            new = np.tanh(g[:, 2 * STATE :] + zr[:, STATE:] * u[:, 2 * STATE :])
            h = new + zr[:, :STATE] * (h - new)
            hidden[a - low : b - low, :STATE] = h
            if b - low >= OUTPUT_BLOCK or t == len(x.cut) - 2:
                total += np.bincount(x.document[low:b], weights=self.output(hidden[: b - low], x.targets[low:b]), minlength=n_documents)
                low = b
        return total

    def output(self, hidden: np.ndarray, targets: np.ndarray) -> np.ndarray:
        p, lexicon = self.of, self.lexicon
        of = lexicon.class_of[targets]
        order = np.argsort(of.astype(np.int16), kind="stable")
        hidden, of, targets = hidden[order], of[order], targets[order]
        by_class = _log_probability(hidden, p["classes"], of)
        cut = np.searchsorted(of, np.arange(len(lexicon.bounds))).tolist()
        for k, (low, high) in enumerate(zip(lexicon.bounds[:-1].tolist(), lexicon.bounds[1:].tolist(), strict=True)):
            a, b = cut[k], cut[k + 1]
            if b > a and high - low > 1:
                by_class[a:b] += _log_probability(hidden[a:b], p["words"][low:high].T, targets[a:b] - low)
        plain = PLAIN * lexicon.weight / lexicon.weight.sum()
        found = np.empty(len(order))
        found[order] = np.log((1 - PLAIN) * np.exp(by_class) + plain[targets])
        return found


class Trainer:
    """Truncated backpropagation with per-parameter rates that shrink with the squares of past gradients."""

    def __init__(self, model: Model, squares: np.ndarray | None = None) -> None:
        self.model = model
        self.squares = np.full(len(model.flat), 1e-6, np.float32) if squares is None else squares
        self.past = model.views(self.squares)

    def move(self, name: str, gradient: np.ndarray, rows=slice(None)) -> None:
        past, value = self.past[name], self.model.of[name]
        step = gradient * gradient
        past[rows] += step
        np.sqrt(past[rows], out=step)
        np.divide(gradient, step, out=step)
        step *= RATE
        value[rows] -= step

    @np.errstate(over="ignore")
    def train(self, x: Lanes) -> None:
        """One pass over the lanes, window by window; the state is carried from window to window.

        Losses are divided by a full window's tokens, so that the last windows, which hold the ends of
        the longest documents alone, weigh no more than their tokens.
        """
        self.full = np.float32(max(1, int(x.cut[1]) if len(x.cut) > 1 else 0) * STEPS)
        h = np.zeros((int(x.cut[1]) if len(x.cut) > 1 else 0, STATE), np.float32)
        for t in range(0, len(x.cut) - 1, STEPS):
            h = self.window(x, t, min(t + STEPS, len(x.cut) - 1), h)

    def window(self, x: Lanes, begin: int, stop: int, h: np.ndarray) -> np.ndarray:
        p, base, size = self.model.of, int(x.cut[begin]), int(x.cut[stop] - x.cut[begin])
        cut = (x.cut[begin : stop + 1] - base).tolist()
        inputs, targets, keep = (v[base : base + size] for v in (x.inputs, x.targets, x.keep))
        gates = p["input"][inputs]
        gates += p["gate"]
        before, z, r, new, inner = (np.empty((size, STATE), np.float32) for _ in range(5))
        hidden = np.ones((size, STATE + 1), np.float32)
        for a, b in zip(cut, cut[1:], strict=False):
            h = h[: b - a] * keep[a:b, None]
            before[a:b] = h
            u = h @ p["state"]
            zr = _sigmoid(gates[a:b, : 2 * STATE] + u[:, : 2 * STATE])
            z[a:b], r[a:b], inner[a:b] = zr[:, :STATE], zr[:, STATE:], u[:, 2 * STATE :]
            new[a:b] = np.tanh(gates[a:b, 2 * STATE :] + r[a:b] * inner[a:b])
            h = new[a:b] + z[a:b] * (h - new[a:b])
            hidden[a:b, :STATE] = h
        pull = self.output(hidden, targets)[:, :STATE]
        # the gates' slopes, for all steps at once
        slope_z, slope_new, slope_r = (before - new) * z * (1 - z), (1 - z) * (1 - new * new), inner * r * (1 - r)
        for_input, for_state = np.empty((size, 3 * STATE), np.float32), np.empty((size, 3 * STATE), np.float32)
        carried = np.zeros((0, STATE), np.float32)
        back = np.ascontiguousarray(p["state"].T)
        for a, b in zip(cut[-2::-1], cut[:0:-1], strict=True):
            d = pull[a:b]
            d[: len(carried)] += carried
            out, dn = for_state[a:b], d * slope_new[a:b]
            out[:, :STATE], out[:, STATE : 2 * STATE], out[:, 2 * STATE :] = d * slope_z[a:b], dn * slope_r[a:b], dn * r[a:b]
            for_input[a:b, 2 * STATE :] = dn
            carried = (d * z[a:b] + out @ back) * keep[a:b, None]
        for_input[:, : 2 * STATE] = for_state[:, : 2 * STATE]
        self.move("state", before.T @ for_state)
        self.move("gate", for_input.sum(axis=0))
        order = np.argsort(inputs.astype(np.int16), kind="stable")
        used, first = np.unique(inputs[order], return_index=True)
        self.move("input", np.add.reduceat(for_input[order], first, axis=0), used)
        return h

    def output(self, hidden: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Trains the output layer; returns the mean loss's gradient by the states."""
        p, lexicon, n = self.model.of, self.model.lexicon, self.full
        of = lexicon.class_of[targets]
        order = np.argsort(of.astype(np.int16), kind="stable")
        hidden, of, targets = hidden[order], of[order], targets[order]
        error = _error(hidden, p["classes"], of, n)
        pull = error @ p["classes"].T
        self.move("classes", hidden.T @ error)
        cut = np.searchsorted(of, np.arange(len(lexicon.bounds))).tolist()
        for k, (low, high) in enumerate(zip(lexicon.bounds[:-1].tolist(), lexicon.bounds[1:].tolist(), strict=True)):
            a, b = cut[k], cut[k + 1]
            if b > a and high - low > 1:
                error = _error(hidden[a:b], p["words"][low:high].T, targets[a:b] - low, n)
                pull[a:b] += error @ p["words"][low:high]
                self.move("words", error.T @ hidden[a:b], slice(low, high))
        out = np.empty_like(pull)
        out[order] = pull
        return out


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(which distinct word each word is, distinct words, offsets by text)."""
    index, distinct, offsets = W.split_encoded(pc.ascii_lower(texts))
    return index, distinct.cast(pa.large_string()), offsets


def _with_ends(values: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(values, offsets[1:], end), offsets + np.arange(len(offsets))


def _training(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.filter(crc32_mod(doc_id, HELD_OUT_MOD) != HELD_OUT).select(F.col(text).alias("text"))


def token_counts(training: DataFrame) -> DataFrame:
    """(token, n) over the texts; a text's end is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in parts(batch, 0):
                index, distinct, _ = _tokens(texts)
                n = np.append(np.bincount(index, minlength=len(distinct)), len(texts)).astype(np.int64)
                names = pa.concat_arrays([distinct, pa.array([END], pa.large_string())])
                yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(n)], ["token", "n"])

    return training.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def lexicon_of(counts: DataFrame) -> Lexicon:
    """At most 1 / COMMON_SHARE tokens can have that share, and only these come to the driver."""
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = int(sums["total"] or 0), int(sums["distinct"])
    common = counts.filter(F.col("n") >= COMMON_SHARE * total).toArrow().sort_by([("n", "descending"), ("token", "ascending")])
    tokens = pa.concat_arrays([pa.array([], pa.large_string()), *(c.cast(pa.large_string()) for c in common["token"].chunks)])
    return Lexicon(tokens, common["n"].to_numpy().astype(np.int64), total, distinct)


_MODELS = "k long, tokens long, flat binary, squares binary"


def _trained(training: DataFrame, lexicon: Lexicon, start: tuple[bytes, bytes] | None, lanes: int, rounds: int, most: int | None) -> DataFrame:
    """A row per partition: its number, the tokens it has learnt from, and its model, trained on from `start`."""
    shared = training.sparkSession.sparkContext.broadcast((lexicon, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, start = shared.value
        flat, squares = (np.frombuffer(x, np.float32).copy() for x in start) if start else (None, None)
        trainer = Trainer(Model(lexicon, flat), squares)
        seen = 0
        for batch in batches:
            for _, texts in parts(batch, 0):
                if most is not None and seen >= most:
                    continue
                index, distinct, offsets = _tokens(texts)
                symbols, offsets = _with_ends(lexicon.symbols(lexicon.places(distinct))[index], offsets, lexicon.end)
                for _ in range(rounds):
                    trainer.train(lay_out(symbols, divided(offsets, lanes), lexicon.end, lanes))
                seen += len(symbols)
        row = [pa.array([TaskContext.get().partitionId()]), pa.array([seen]), pa.array([trainer.model.flat.tobytes()]), pa.array([trainer.squares.tobytes()])]
        yield pa.RecordBatch.from_arrays(row, ["k", "tokens", "flat", "squares"])

    return training.mapInArrow(run, _MODELS)


def _mean(table: pa.Table) -> pa.Table:
    tokens = table["tokens"].to_numpy()
    share = (tokens / tokens.sum() if tokens.sum() else np.full(len(tokens), 1 / len(tokens))).astype(np.float32)
    means = []
    for name in ("flat", "squares"):
        mean = None
        for x, w in zip(table[name], share, strict=True):
            own = np.frombuffer(x.as_py(), np.float32) * w
            mean = own if mean is None else mean + own
        means.append(mean.tobytes())
    return pa.table({"k": table["group"].slice(0, 1), "tokens": pa.array([int(tokens.sum())]), "flat": pa.array(means[:1]), "squares": pa.array(means[1:])})


def train(docs: DataFrame, lexicon: Lexicon, text: str = "text", doc_id: str = "doc_id") -> Model:
    """The mean of the partitions' models."""
    training = _training(docs, text, doc_id)
    # a bounded sample to begin with: the first by a hash, all of them if they are few
    order = F.xxhash64(doc_id, text)
    every = max(1, docs.count() // (2 * WARM_DOCUMENTS))
    sample = docs.filter(F.pmod(order, F.lit(every)) == 0).orderBy(order).limit(WARM_DOCUMENTS)
    warm = _trained(_training(sample, text, doc_id), lexicon, None, WARM_LANES, WARM_ROUNDS, WARM_TOKENS).first()
    start = (bytes(warm["flat"]), bytes(warm["squares"])) if warm else None
    models = written(_trained(training, lexicon, start, LANES, 1, None), "models")
    n = models.count()
    while n > 1:
        n = -(-n // FAN)
        models = models.withColumn("group", F.col("k") % n).groupBy("group").applyInArrow(_mean, _MODELS)
    last = models.first() or warm
    return Model(lexicon, np.frombuffer(bytes(last["flat"]), np.float32).copy() if last else None)


_LOG10 = float(np.log(10.0))


def scored(docs: DataFrame, counts: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in keep, n_tokens, n_known, base_score and score (log10 probabilities) of each whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.lexicon, model.flat))
    numbers = {"n_tokens": pa.int64(), "n_common": pa.int64(), "common_log": pa.float64(), "n_unknown": pa.int64(), "model_log": pa.float64()}
    rare_type = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))
    rare_spark = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([T.StructField("_at", T.LongType()), *(docs.schema[c] for c in keep), *(T.StructField(n, T.LongType() if t == pa.int64() else T.DoubleType()) for n, t in numbers.items()), T.StructField("rare", rare_spark)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, flat = shared.value
        own = Model(lexicon, flat)
        log_count = np.append(np.log10(lexicon.counts + 1.0), 0.0)
        outside = np.append(lexicon.symbol == lexicon.unknown, True)
        for batch in batches:
            for rows, texts in parts(batch, len(keep) + 1):
                n = len(texts)
                index, distinct, offsets = _tokens(texts)
                places = lexicon.places(distinct)
                document = np.repeat(np.arange(n), np.diff(offsets))
                is_rare = (places < 0)[index]
                pair, times = np.unique(document[is_rare] * max(1, len(distinct)) + index[is_rare], return_counts=True)
                of, token = np.divmod(pair, max(1, len(distinct)))
                rare = pa.StructArray.from_arrays([distinct.take(pa.array(token)).cast(pa.string()), pa.array(times.astype(np.int64))], ["token", "n"])
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), rare)
                all_places, all_offsets = _with_ends(places[index], offsets, lexicon.end_at)
                of_all = np.repeat(np.arange(n), np.diff(all_offsets))
                total = lambda weights: np.bincount(of_all, weights=weights, minlength=n)  # noqa: E731, B023
                x = lay_out(lexicon.symbols(all_places), all_offsets, lexicon.end, LANES)
                logs, unknown = log_count[all_places], outside[all_places]
                values = {
                    "n_tokens": np.diff(all_offsets),
                    "n_common": total(all_places >= 0).astype(np.int64),
                    "common_log": total(logs),
                    "n_unknown": total(unknown).astype(np.int64),
                    "model_log": own.log_likelihood(x, n) / _LOG10 + total(np.where(unknown, logs, 0.0)),
                }
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep) + 1], *(pa.array(values[k], t) for k, t in numbers.items()), rare.cast(rare_type)], schema.names)

    marked = docs.select(F.monotonically_increasing_id().alias("_at"), *keep, F.col(text).alias("_text"))
    found = written(marked.mapInArrow(run, schema), "scores")
    rare = found.select("_at", F.explode("rare").alias("r")).select("_at", "r.token", F.col("r.n").alias("times"))
    held = rare.join(counts, "token").groupBy(F.col("_at").alias("_of")).agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log"))
    joined = found.drop("rare").join(held, F.col("_at") == F.col("_of"), "left")
    rare_log, n_rare = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("n_rare", F.lit(0).cast("long"))
    lexicon = model.lexicon
    every = float(np.log10(float(lexicon.total + lexicon.distinct + 1)))
    rest = float(np.log10(max(lexicon.rest, 1.0)))
    return joined.select(
        *keep,
        "n_tokens",
        (F.col("n_common") + n_rare).alias("n_known"),
        (F.col("common_log") + rare_log - F.col("n_tokens") * every).alias("base_score"),
        (F.col("model_log") + rare_log - F.col("n_unknown") * rest).alias("score"),
    )


def score_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Model]:
    """Learns from the training documents and scores all."""
    counts = written(token_counts(_training(docs, text, doc_id)), "counts")
    model = train(docs, lexicon_of(counts), text, doc_id)
    return scored(docs, counts, model, keep, text), model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, model = score_documents(documents(spark, sf_dir))
    held_out = (crc32_mod("doc_id", HELD_OUT_MOD) == HELD_OUT).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", F.lit(model.lexicon.total).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op7_lm_scoring": query}
