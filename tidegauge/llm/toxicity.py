"""Toxicity by a weighted lexicon, matched over folded text by an Aho-Corasick automaton.

Texts and lexicon are folded alike: lower case, combining marks off, look-alike letters of
other alphabets and digit or sign substitutions onto Latin letters, ``l`` with ``i`` since
``1`` stands for both. Entries are stems: a word counts if it begins with one, unless it
stands in an exception phrase. The weights of all hits are summed, divided by a slowly
growing length of the text and mapped to 0 to 1 by a logistic curve.

Lexicon, exceptions and curve are learned from labelled training documents, at most
``MAX_LABELLED`` of them, those of smallest id hash. A stem comes in if it stands in
``MIN_SUPPORT`` places of toxic documents, in few of others, and in more than chance allows
(``MIN_EVIDENCE``); of stems that begin with each other the one of most evidence. Its weight
is the log of how much more often it stands in toxic text than in other text. Places count
by their neighbouring words, since copies of one toxic document share all their words: a
stem whose places are mostly the same is the copies' and not a toxic one. A phrase around a
stem is an exception if ``MIN_SUPPORT`` non-toxic documents hold it and toxic ones rarely
do.

Defined cases. Null and blank texts have no hits and get the score of an empty text.
Without toxic (or without other) training documents, or
without a stem, every score is 0. A null doc_id counts as the empty text
in the split. A doc_id labelled several times is toxic if one label says so. Repeated rows
give repeated results. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import texts
from tidegauge.llm.common import SPACES, crc32_of, query, table

MODULUS, HELD_OUT = 3, 1
MAX_LABELLED = 20_000
MIN_SUPPORT = 5
MIN_SHARE = 0.6  # of a stem's places that are toxic
MIN_EVIDENCE = 25.0  # a G statistic; by chance one stem in two millions reaches it
STEM_LENGTHS = range(4, 11)
THRESHOLD = 0.7

# Letters of other alphabets and signs that are read as Latin letters.
_LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "i", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l",
    "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l",
}


def _folding() -> dict[int, str | None]:
    """Folded character of every code point that changes, by the rule above."""
    table: dict[int, str | None] = {}
    for code in (*range(0x250), *range(0x370, 0x530), *range(0xFF01, 0xFF5F)):
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        table[code] = "".join(_LOOK_ALIKE.get(c, c) for c in plain).replace("l", "i")
    table |= dict.fromkeys((*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
    table |= dict.fromkeys((*range(9, 14), 0xA0, 0x2028, 0x2029), " ")
    return {k: v for k, v in table.items() if v != chr(k)}


FOLDING = _folding()
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.translate(FOLDING)


class Lexicon:
    """Folded stems with weights, exception phrases and the curve."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str] = frozenset(), slope: float = 1.0, offset: float = 0.0):
        self.weights, self.exceptions = weights, exceptions
        self.slope, self.offset = slope, offset
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def hits(self, folded: str) -> list[tuple[int, int, str]]:
        """Stems at the beginning of words outside exception phrases: start, end, stem."""
        if not self.weights:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for pattern in (*self.weights, *self.exceptions):
                self._automaton.add_word(pattern, pattern)
            self._automaton.make_automaton()
        found, excepted = [], []
        for last, pattern in self._automaton.iter(folded):
            start, end = last + 1 - len(pattern), last + 1
            if start and folded[start - 1].isalnum():
                continue
            if pattern in self.weights:
                found.append((start, end, pattern))
            elif not folded[end : end + 1].isalnum():
                excepted.append((start, end))
        if not excepted:
            return found
        return [h for h in found if not any(s <= h[0] and h[1] <= e for s, e in excepted)]

    def density(self, text: str | None) -> float:
        """Weight of the hits by the length of the text."""
        found = self.hits(fold(text)) if text else []
        if not found:
            return 0.0
        return sum(self.weights[w] for _, _, w in found) / (1 + math.log10(1 + len(text.split())))

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * self.density(text) + self.offset))))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Text and label of the training documents used, a bounded number."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    training = known.filter(F.pmod(crc32_of("doc_id"), F.lit(MODULUS)) != HELD_OUT)
    used = training.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    return docs.select("doc_id", "text").join(F.broadcast(used), "doc_id").select("text", F.col("toxic").cast("bigint").alias("toxic"))


def _pairs(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
    return zip((t or "" for t in texts.column(batch, "text")), texts.column(batch, "toxic"))


def _evidence(toxic, of, rate: float):
    """G statistic of ``toxic`` among ``of`` against a share of ``rate``, in Spark or not."""
    log = F.log if not isinstance(of, int) else lambda x: math.log(x)
    rest = of - toxic
    return 2 * (toxic * log(toxic / (of * rate)) + rest * log((rest + 1e-9) / (of * (1 - rate))))


def _stems(word: str) -> Iterator[str]:
    return (word[:n] for n in STEM_LENGTHS if n <= len(word))


def _candidates(rows: DataFrame, rate: float) -> list[str]:
    """Stems that toxic documents hold far more often than others, of most evidence."""

    def run(batches):
        for batch in batches:
            toxic, every = Counter(), Counter()
            for text, label in _rows(batch):
                held = {stem for word in set(_WORD.findall(fold(text))) for stem in _stems(word)}
                every.update(held)
                if label:
                    toxic.update(held)
            yield _pairs([(s, toxic[s], n) for s, n in every.items()], ["stem", "toxic", "docs"], [pa.string(), pa.int64(), pa.int64()])

    sums = rows.mapInArrow(run, "stem string, toxic bigint, docs bigint").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    able = sums.filter((F.col("toxic") >= MIN_SUPPORT) & (F.col("toxic") >= 2 * rate * F.col("docs")))
    told = able.withColumn("evidence", F.round(_evidence(F.col("toxic"), F.col("docs"), rate), 6)).filter(F.col("evidence") >= MIN_EVIDENCE)
    return [r["stem"] for r in told.orderBy(F.desc("evidence"), "stem").collect()]


def _weights(rows: DataFrame, candidates: list[str], rate: float, words: tuple[int, int]) -> dict[str, float]:
    """Weights of the stems chosen; ``words`` are those of toxic and of other documents."""
    known = frozenset(candidates)

    def run(batches):
        for batch in batches:
            out = []
            for text, toxic in _rows(batch):
                said = ["", *_WORD.findall(fold(text)), ""]
                out += {(stem, f"{said[i]} {said[i + 2]}", toxic) for i, word in enumerate(said[1:-1]) for stem in _stems(word) if stem in known}
            yield _pairs(out, ["stem", "place", "toxic"], [pa.string(), pa.string(), pa.int64()])

    places = rows.mapInArrow(run, "stem string, place string, toxic bigint").groupBy("stem", "place").agg(F.max("toxic").alias("toxic"), F.count("*").alias("n"))
    sums = places.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("places"), F.sum("n").alias("n")).collect()
    able = []
    for r in sums:
        toxic, of = r["toxic"], r["places"]
        if toxic >= MIN_SUPPORT and toxic >= MIN_SHARE * of and 2 * of >= r["n"]:
            evidence = _evidence(toxic, of, rate)
            if evidence >= MIN_EVIDENCE:
                able.append((-round(evidence, 6), -len(r["stem"]), r["stem"], toxic, of - toxic))
    chosen: dict[str, float] = {}
    for _, _, stem, toxic, other in sorted(able):
        if not any(stem.startswith(c) or c.startswith(stem) for c in chosen):
            chosen[stem] = math.log((toxic + 0.5) / words[0]) - math.log((other + 0.5) / words[1])
    return {stem: weight for stem, weight in chosen.items() if weight > 0}


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Phrases of a word with a stem and a neighbour that non-toxic documents share."""

    def run(batches):
        for batch in batches:
            out = []
            for text, toxic in _rows(batch):
                folded = fold(text)
                words = _WORD.findall(folded) if lexicon.hits(folded) else []
                marked = [lexicon.hits(w) != [] for w in words]
                near = {f"{words[i]} {words[i + 1]}" for i in range(len(marked) - 1) if marked[i] or marked[i + 1]}
                out += [(phrase, toxic) for phrase in near]
            yield _pairs(out, ["phrase", "toxic"], [pa.string(), pa.int64()])

    counts = rows.mapInArrow(run, "phrase string, toxic bigint").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("docs"))
    able = counts.filter((F.col("docs") - F.col("toxic") >= MIN_SUPPORT) & (F.col("toxic") <= 0.2 * F.col("docs")))
    return frozenset(r["phrase"] for r in able.select("phrase").collect())


def _curve(density: np.ndarray, toxic: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a slightly regularised logistic regression, by Newton steps."""
    x = np.column_stack([density, np.ones(len(density))])
    theta, penalty = np.zeros(2), np.diag([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        bend = (x * (count * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(bend, x.T @ (count * (toxic - p)) - penalty @ theta)
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon, exceptions and curve from the labelled training documents."""
    rows = _labelled(docs, labels)
    words = F.size(F.split(F.coalesce("text", F.lit("")), SPACES))
    size = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(words).alias("words")).collect()
    n, said = {r["toxic"] > 0: r["n"] for r in size}, {r["toxic"] > 0: r["words"] for r in size}
    if len(n) < 2:
        return Lexicon({})
    rate = n[True] / (n[True] + n[False])
    weights = _weights(rows, _candidates(rows, rate), rate, (said[True], said[False]))
    lexicon = Lexicon(weights)
    if not weights:
        return lexicon
    lexicon = Lexicon(weights, _exceptions(rows, lexicon))

    def run(batches):
        for batch in batches:
            out = [(lexicon.density(text), toxic) for text, toxic in _rows(batch)]
            yield _pairs(out, ["density", "toxic"], [pa.float64(), pa.int64()])

    told = rows.mapInArrow(run, "density double, toxic bigint").groupBy("density", "toxic").count().toPandas()
    told = told.sort_values(["density", "toxic"])
    slope, offset = _curve(told["density"].to_numpy(), told["toxic"].to_numpy(float), told["count"].to_numpy(float))
    return Lexicon(weights, lexicon.exceptions, slope, offset)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, predicted, hits`` of every text, hits being those that counted."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(texts.column(batch, "doc_id"), texts.column(batch, "text")):
                value = lexicon.score(text)
                out.append((doc_id, value, int(value >= THRESHOLD), len(lexicon.hits(fold(text))) if value > 0.5 else 0))
            yield _pairs(out, ["doc_id", "score", "predicted", "hits"], [pa.int64(), pa.float64(), pa.int32(), pa.int64()])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int, hits bigint")


@query("op9_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.pmod(crc32_of("doc_id"), F.lit(MODULUS)) == HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
