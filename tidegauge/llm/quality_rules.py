"""Quality rules: a hashed n-gram log-likelihood ratio beside counting rules.

Byte n-grams are hashed into a fixed number of bins. Two multinomials, one from trusted
documents (``labels.quality = 1``) and one from the whole corpus, give every bin the log
of the ratio of its probabilities; a document's score is the mean over its n-grams, so
length does not count. Every document is kept whose score reaches a threshold: ``SLACK``
below the score that all but ``TRUSTED_LOSS`` of the trusted documents reach, of those that
pass the counting rules. Trusted scores under a fence, the median less ``SPREADS`` times its
distance from the lower quartile and less ``FENCE``, count as wrong labels and not for the
threshold. Nothing is drawn at random.

Both models are counted over all documents; what reaches the driver is one number per
bin and a histogram of trusted scores on a fixed grid, whatever the corpus holds.

Defined cases. Null text: empty; a text shorter than an n-gram has score 0 and passes the
threshold, if the counting rules let it. Without trusted documents every score passes. A
doc_id labelled several times is trusted if its smallest label is 1. Repeated rows count
as often as they are there. Further columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.llm import texts
from tidegauge.llm.common import broadcast_if_small, query, table

GRAM = 3
BIN_BITS = 16
BINS = 1 << BIN_BITS
SMOOTHING = 1.0
TRUSTED_LOSS = 0.0002
SLACK = 0.01
SPREADS, FENCE = 4, 0.5  # of four or more trusted documents, one wrong label moves no quartile far
GRID = 1000  # histogram cells per unit of score

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
REPEAT_WINDOW = 5

# So many labels (three numbers each, some 10 MB) are sent to every executor.
BROADCAST_ROWS = 400_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _bins(data: np.ndarray) -> np.ndarray:
    """Bin of the n-gram at every byte but the last ones."""
    count = max(0, len(data) - GRAM + 1)
    value = np.zeros(count, np.uint64)
    for k in range(GRAM):
        value = (value << np.uint64(8)) + data[k : k + count]
    return (texts.mix(value + np.uint64(1)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _grams(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all n-grams inside the texts, and how many each text has."""
    data, ends = texts.joined(held)
    bins = _bins(data)
    inside = np.ones(len(bins), bool)
    for back in range(GRAM):
        at = ends - 1 - back
        inside[at[(at >= 0) & (at < len(bins))]] = False
    return bins[inside], np.array([max(0, len(raw) - GRAM + 1) for raw in held])


def _spans(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with ``_trusted``."""
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("_quality")).filter("doc_id IS NOT NULL AND _quality = 1")
    known = broadcast_if_small(known.withColumnRenamed("doc_id", "_labelled"), BROADCAST_ROWS)
    met = docs.join(known, F.col("doc_id") == F.col("_labelled"), "left")
    return met.withColumn("_trusted", F.col("_labelled").isNotNull()).drop("_labelled", "_quality")


def gram_counts(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Count of every bin in all documents and in the trusted ones."""

    def run(batches):
        raw, trusted = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            marks = np.array(texts.column(batch, "_trusted"), bool)
            at = 0
            for held in texts.stretches(texts.column(batch, "text")):
                bins, sizes = _grams(held)
                raw += np.bincount(bins, minlength=BINS)
                trusted += np.bincount(bins[np.repeat(marks[at : at + len(held)], sizes)], minlength=BINS)
                at += len(held)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(trusted[some])], names=["bin", "raw", "trusted"])

    per_task = _marked(docs, labels).select("text", "_trusted").mapInArrow(run, "bin bigint, raw bigint, trusted bigint")
    rows = per_task.groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    raw, trusted = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    raw[rows["bin"]], trusted[rows["bin"]] = rows["raw"], rows["trusted"]
    return raw, trusted


def log_ratios(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    def log_share(counts: np.ndarray) -> np.ndarray:
        return np.log(counts + SMOOTHING) - np.log(counts.sum() + SMOOTHING * len(counts))

    return log_share(trusted) - log_share(raw)


def _scores(held: list[bytes], weights: np.ndarray) -> np.ndarray:
    bins, sizes = _grams(held)
    total = np.concatenate([[0.0], np.cumsum(weights[bins])])
    at = _spans(sizes)
    return (total[at[1:]] - total[at[:-1]]) / np.maximum(sizes, 1)


def score_threshold(docs: DataFrame, labels: DataFrame, weights: np.ndarray) -> float:
    """``SLACK`` below the grid score that nearly all trusted documents over the fence reach."""

    def run(batches):
        for batch in batches:
            for held in texts.stretches(texts.column(batch, "text")):
                found = _judged(held, weights, -np.inf)
                cells = np.floor(found["score"][found["kept"]] * GRID).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cells)], names=["cell"])

    trusted = _marked(docs, labels).filter("_trusted").select("text")
    cells = trusted.mapInArrow(run, "cell bigint").groupBy("cell").count().orderBy("cell").collect()
    fence = _fence([(c["cell"], c["count"]) for c in cells])
    cells = [c for c in cells if c["cell"] >= fence]
    allowed, below = TRUSTED_LOSS * sum(c["count"] for c in cells), 0
    for c in cells:
        below += c["count"]
        if below > allowed:
            return c["cell"] / GRID - SLACK
    return -np.inf


def _fence(cells: list[tuple[int, int]]) -> float:
    """The cell under which a trusted score is a wrong label, from ordered cells and counts."""
    if not cells:
        return -np.inf
    at, counts = (np.array(c) for c in zip(*cells))
    total = np.cumsum(counts)
    n = total[-1]
    median, quartile = (at[np.searchsorted(total, rank)] for rank in ((n + 1) // 2, n // 4 + 1))
    return float(median - SPREADS * (median - quartile) - FENCE * GRID)


_RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, score double, kept boolean"
)


def _per_text(mark: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mark)])
    return np.diff(total[np.concatenate([[0], ends])])


def _duplicate_lines(raw: bytes) -> int:
    seen, repeated = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    return repeated


def _repeated_words(words: texts.Words) -> np.ndarray:
    """Words of each text inside windows that it holds twice or more."""
    value, start = texts.windows(words, REPEAT_WINDOW)
    value = value ^ texts.mix(words.owner[start].astype(np.uint64) + np.uint64(1))
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    twice = np.zeros(len(value), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(covered, start[twice], 1)
    np.add.at(covered, start[twice] + REPEAT_WINDOW, -1)
    return _per_text(np.cumsum(covered[:-1]) > 0, words.first[1:])


def _judged(held: list[bytes], weights: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    data, ends = texts.joined(held)
    words = texts.words_of([raw.decode() for raw in held])
    n_words = np.diff(words.first)
    letters = ~texts._SPACE[data] & ((data & 0xC0) != 0x80)
    repeated = _repeated_words(words)
    score = _scores(held, weights)
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n_words)
    return {
        "n_words": n_words,
        "word_chars": _per_text(letters, ends),
        "n_symbols": _per_text(_SYMBOL[data], ends),
        "n_dup_lines": np.array([_duplicate_lines(raw) for raw in held]),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "score": score,
        "kept": ~failed & (np.floor(score * GRID) >= threshold * GRID),
    }


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of the bins and the threshold."""
    raw, trusted = gram_counts(docs, labels)
    weights = log_ratios(raw, trusted)
    return weights, score_threshold(docs, labels, weights) if trusted.any() else -np.inf


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with the counts, the score and ``kept``; columns of these names are replaced."""
    return _apply(docs, *fit(docs, labels))


def _apply(docs: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    new = [c.split()[0] for c in _RESULT.split(", ")]
    own = [c for c in docs.columns if c not in new]
    source = docs.select(*own)

    def run(batches):
        for batch in batches:
            yield from _judge_batch(batch, own, new, weights, threshold)

    return source.mapInArrow(run, StructType([*source.schema.fields, *StructType.fromDDL(_RESULT).fields]))


def _judge_batch(batch: pa.RecordBatch, own, new, weights, threshold) -> Iterator[pa.RecordBatch]:
    at = 0
    for held in texts.stretches(texts.column(batch, "text")):
        found = _judged(held, weights, threshold)
        part = batch.slice(at, len(held))
        yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[c]) for c in new)], names=[*own, *new])
        at += len(held)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected ones, all columns as they are."""
    whole = docs.select("text", F.struct("*").alias("_whole"))
    return _apply(whole, *fit(docs, labels)).filter("kept").select("_whole.*")


@query("op2_quality_rules")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).drop("text")
