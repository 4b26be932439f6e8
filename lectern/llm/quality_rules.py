"""Quality rules with host-level verdicts.

Each document is measured (words, symbols, repeated lines, repeated three-word windows) and
held against rules. Hard rules reject a document by themselves. Soft rules count per host:
a host's rate of soft failures is shrunk towards the corpus rate with a beta prior fitted to all
hosts by the method of moments. The host's verdict is how many soft rules a document of it may fail:
ALLOWED, one less if the shrunk rate is over RATIO times the prior's mean, one more if it is under
the mean by as much. The verdicts are joined back to the documents. What counts as bad is thus
measured against the corpus at hand; where hosts do not differ beyond chance, all shrink to the
mean and have the same verdict.

Defined cases: a null or empty text has no words and fails the hard rules; a null host is a host
of its own; equal rows, and rows that repeat a doc_id, are measured and counted one by one; no
documents give no rows and no hosts. Extra columns are kept out of the result of measure()
unless named in keep.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import documents, identified, written

MIN_WORDS = 50
MAX_REPEAT_SHARE = 0.5
#: Soft rules.
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINE_SHARE = 0.3
MEAN_WORD_CHARS = (3.0, 10.0)
SOFT_REPEAT_SHARE = 0.2
#: Soft rules that a document of an ordinary host may fail, and how far from the mean a host is no longer ordinary.
ALLOWED, RATIO = 1, 1.5

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure_text(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, _SPACES)) if words else 0
    n_symbols = sum(map(text.count, _SYMBOLS))
    n_lines = n_dup = 0
    seen = set()
    for line in text.split("\n"):
        if line.strip(_SPACES):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    return len(words), word_chars, n_symbols, n_lines, n_dup, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    if len(windows) >= len(words) - 2:
        return 0
    covered = upto = 0
    for i, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if windows[window] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), text: str = "text") -> DataFrame:
    """The columns in keep and the measures of each document's whole text."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(m, T.LongType()) for m in _MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure_text(x or "") for x in batch.column(len(keep)).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_MEASURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *_MEASURES])

    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def judge_documents(measured: DataFrame) -> DataFrame:
    """Adds base_failed (hard rules) and n_soft, the number of soft rules failed (all by a text without words)."""
    words = F.col("n_words")
    mean_chars = F.col("word_chars") / words
    soft = (
        F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * words,
        F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"),
        F.col("n_repeat_words") > SOFT_REPEAT_SHARE * words,
        ~mean_chars.between(*MEAN_WORD_CHARS),
    )
    n_soft = F.when(words == 0, len(soft)).otherwise(sum((rule.cast("int") for rule in soft), F.lit(0)))
    hard = (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT_SHARE) * words)
    return measured.withColumn("base_failed", hard).withColumn("n_soft", n_soft.cast("long"))


def judge_hosts(judged: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: n_docs, n_failed, the prior, the shrunk rate (host_rate) and the verdict (allowed).

    The prior's mean is the mean of the hosts' rates; its strength follows from their variance
    beyond what binomial noise of the hosts' sizes explains (none beyond: hosts are taken to
    be alike, and every host gets the mean).
    """
    hosts = judged.groupBy(host).agg(F.count("*").alias("n_docs"), F.count_if(F.col("n_soft") > 0).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    sums = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.var_pop(rate).alias("var"),
        F.avg(1 / F.col("n_docs")).alias("inverse_size"),
    ).first()
    mean = sums["mean"] or 0.0
    spread = mean * (1 - mean)
    between = max((sums["var"] or 0.0) - spread * (sums["inverse_size"] or 0.0), 1e-9)
    strength = max(spread / between - 1, 1.0)
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    verdict = ALLOWED - (shrunk > RATIO * mean).cast("int") + (RATIO * shrunk < mean).cast("int")
    return hosts.withColumn("prior_mean", F.lit(mean)).withColumn("prior_strength", F.lit(strength)).withColumn("host_rate", shrunk).withColumn("allowed", verdict.cast("long"))


def verdicts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), host: str = "source", text: str = "text") -> DataFrame:
    """Per document: the columns in keep, measures, base_failed, n_soft, host_rate, allowed and kept."""
    named = docs.withColumn("_host", F.col(host).cast("string"))
    judged = written(judge_documents(measure(named, (*keep, "_host"), text)), "quality")
    hosts = judge_hosts(judged, "_host").select(F.col("_host").alias("_of"), "host_rate", "allowed")
    joined = judged.join(hosts, judged["_host"].eqNullSafe(hosts["_of"]), "left").drop("_of", "_host")
    kept = ~F.col("base_failed") & (F.col("n_soft") <= F.col("allowed"))
    return joined.withColumn("kept", kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_soft", "allowed")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass."""
    rows = identified(docs)
    kept = verdicts(rows.select("_at", "_row.source", "_row.text"), ("_at",)).filter("kept").select("_at")
    return rows.join(kept, "_at", "left_semi").select("_row.*")


QUERIES = {"op6_quality_rules": query}

_WORD = r"'[^\x20\x09-\x0D]+'"
ORACLE_SQL = {
    "op6_quality_rules": f"""
    WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
    split AS (SELECT *, regexp_extract_all(t, {_WORD}) AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM texts),
    windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM
        (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM split))),
    repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM windows, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY rid),
    measured AS (SELECT rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM split LEFT JOIN repeated USING (rid)),
    judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * MAX_REPEAT_SHARE)} * n_words AS base_failed,
        CAST(CASE WHEN n_words = 0 THEN 4 ELSE CAST(n_symbols > CAST({MAX_SYMBOLS_PER_WORD} AS DOUBLE) * n_words AS INT) + CAST(n_dup_lines > CAST({MAX_DUP_LINE_SHARE} AS DOUBLE) * n_lines AS INT)
            + CAST(n_repeat_words > CAST({SOFT_REPEAT_SHARE} AS DOUBLE) * n_words AS INT) + CAST(word_chars / n_words NOT BETWEEN {MEAN_WORD_CHARS[0]} AND {MEAN_WORD_CHARS[1]} AS INT) END AS BIGINT) AS n_soft FROM measured),
    hosts AS (SELECT source, count(*) AS n_docs, CAST(count(*) FILTER (n_soft > 0) AS DOUBLE) AS n_failed FROM judged GROUP BY source),
    sums AS (SELECT sum(n_failed) / sum(n_docs) AS mean, var_pop(n_failed / n_docs) AS var, avg(1.0 / n_docs) AS inverse_size FROM hosts),
    prior AS (SELECT mean, greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inverse_size, 1e-9) - 1, 1.0) AS strength FROM sums),
    rates AS (SELECT source, mean, (n_failed + mean * strength) / (n_docs + strength) AS rate FROM hosts, prior),
    verdicts AS (SELECT source, CAST({ALLOWED} - CAST(rate > {RATIO} * mean AS INT) + CAST({RATIO} * rate < mean AS INT) AS BIGINT) AS allowed FROM rates)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_soft <= allowed AS kept, n_soft, allowed
    FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source"""
}
