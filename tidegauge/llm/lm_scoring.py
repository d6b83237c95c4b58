"""Language-model scores by a weighted backoff automaton.

The model is a bigram model with a backoff to single words, smoothed by ``MASS`` words'
worth of the lower order: ``p(w | h) = (c(hw) + MASS * p(w)) / (c(h) + MASS)``, and
``p(w) = c(w) / (N + V)``, ``V / (N + V)`` for any word that training does not have. As an
automaton: every known word is a state, every known pair ``hw`` an arc from ``h`` to ``w``
that carries its log-probability; for any other word the failure arc of ``h`` leads to the
root, at the weight ``MASS / (c(h) + MASS)``, and the root has an arc for every word. A text
starts in the start state and ends with the end arc; one traversal from left to right
carries the state and adds up the weights.

The automaton of the corpus grows with it and is never in one place. Documents are read
in blocks of bounded size; a block asks for the counts of its own distinct words and pairs
(with how often its training documents hold them), the asked keys meet in hash ranges that
sum and answer, and with the answers each block builds the part of the automaton that its
texts can reach. Nothing but N, V and the number of training documents is global.

Blocks are made of the rows of an input partition in order, twice; the table must give the
same rows again, as files do. If it does not, a block finds no answers and the job fails.

Defined cases. Null text: empty, one end token. A null doc_id counts as the empty text in
the split. Without training documents every probability is 1. Repeated rows count as often
as they are there. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import texts
from tidegauge.llm.common import query, rows_of, table
from tidegauge.plans.registry import rounded, sql_round
from tidegauge.session import spread, staged

MASS = 200.0

# Text in one block, and in one hash range of keys. Both are what a task holds at once.
BLOCK_CHARS = 4_000_000
RANGE_CHARS = 4_000_000

MODULUS, HELD_OUT = 7, 2
_START = np.uint64(0x5354415254)
_END = np.uint64(0x454E44)
_LEFT, _RIGHT = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xA0761D6478BD642F)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS == HELD_OUT


class Tokens:
    """Token hashes of the texts of a block with the hashes of the pairs they end."""

    def __init__(self, said: list[str | None]):
        words = texts.words_of(said, lower=True)
        self.token = np.insert(words.hashes, words.first[1:], _END)
        self.size = np.diff(words.first) + 1
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.first] = _START
        self.before = before
        self.pair = texts.mix(before * _LEFT + self.token * _RIGHT)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, list]]:
    """Rows of a partition in order, in blocks: name, doc_ids, texts.

    The name tells the place and the content, so that answers can't go to other rows.
    """
    part, ids, said, size, number, mark = TaskContext.get().partitionId(), [], [], 0, 0, 0
    for batch in batches:
        for doc_id, text in zip(texts.column(batch, "doc_id"), texts.column(batch, "text")):
            ids.append(doc_id)
            said.append(text)
            size += len(text or "") + 1
            mark = zlib.crc32(f"{doc_id}:{text}".encode(), mark)
            if size >= BLOCK_CHARS:
                yield f"{part}:{number}:{mark}", ids, said
                ids, said, size, number = [], [], 0, number + 1
    if ids:
        yield f"{part}:{number}:{mark}", ids, said


def _planes(numbers: np.ndarray) -> bytes:
    """The bytes of sorted keys or of counts by their order, so that equal ones compress."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _counted(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how many of each the training documents hold."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[new], np.add.reduceat(training[order].astype(np.int64), new)


_ASK = "block string, pairs boolean, range int, keys binary, counts binary, docs bigint"


def _asked(docs: DataFrame, ranges: int) -> DataFrame:
    """Per block, kind and hash range: the distinct keys and their training counts."""

    def run(batches):
        for name, ids, said in _blocks(batches):
            tokens = Tokens(said)
            trained = np.array([not held_out(i) for i in ids])
            training = np.repeat(trained, tokens.size)
            out = []
            for pairs, keys in ((False, tokens.token), (True, tokens.pair)):
                found, counts = _counted(keys, training)
                place = ((found >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                edges = np.searchsorted(place, np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(edges)):
                    part = slice(edges[r], edges[r + 1])
                    out.append((name, pairs, int(r), _planes(found[part]), _planes(counts[part]), int(trained.sum())))
            columns = list(zip(*out))
            names = [c.split()[0] for c in _ASK.split(", ")]
            kinds = [pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return docs.mapInArrow(run, _ASK)


_ANSWER = "block string, pairs boolean, range int, totals binary, kinds bigint, tokens bigint"
_ANSWER_ARROW = pa.schema(
    [("block", pa.string()), ("pairs", pa.bool_()), ("range", pa.int32()), ("totals", pa.binary()), ("kinds", pa.int64()), ("tokens", pa.int64())]
)


def _answered(asked: DataFrame) -> DataFrame:
    """The training totals of all asked keys, in the order in which a block asked."""
    dealt = spread(asked.drop("docs"), "range", "pairs").sortWithinPartitions("range", "pairs", "block")

    def run(batches):
        for (r, pairs), rows in groupby(rows_of(batches), key=lambda x: (x["range"], x["pairs"])):
            rows = list(rows)
            keys = np.concatenate([_keys(x["keys"]) for x in rows])
            counts = np.concatenate([_keys(x["counts"]) for x in rows])
            known, back = np.unique(keys, return_inverse=True)
            total = np.bincount(back, weights=counts, minlength=len(known)).astype(np.int64)
            at = 0
            for x in rows:
                size = len(x["keys"]) // 8
                one = {
                    "block": x["block"], "pairs": pairs, "range": r, "totals": _planes(total[back[at : at + size]]),
                    "kinds": int((total > 0).sum()), "tokens": int(total.sum()),
                }
                at += size
                yield pa.RecordBatch.from_pylist([one], _ANSWER_ARROW)

    return dealt.mapInArrow(run, _ANSWER)


class Automaton:
    """The states and arcs that the texts of one block can reach.

    ``words`` and ``arcs`` are sorted keys; the last state is the root.
    """

    def __init__(self, words: np.ndarray, word_counts: np.ndarray, arcs: np.ndarray, arc_counts: np.ndarray, n: int, kinds: int, starts: int):
        self.words, self.arcs = words, arcs
        mass = max(n + kinds, 1)
        share = np.where(word_counts > 0, word_counts, kinds if n else 1) / mass
        self.known = word_counts > 0
        self.share = share
        self.root = np.log10(share)
        self.history = word_counts.astype(float)
        self.arc_counts = arc_counts
        self.starts = float(starts)

    def traverse(self, tokens: Tokens) -> np.ndarray:
        """Log-probability that every token adds on the way from the text's start."""
        word = np.searchsorted(self.words, tokens.token)
        arc = np.searchsorted(self.arcs, tokens.pair)
        # The state behind a token is its word's, carried on to the next token; behind an
        # unknown word it is the root, which has seen nothing and costs nothing to leave.
        behind = np.where(self.known[word], self.history[word], 0.0)
        state = np.empty(len(word))
        state[1:] = behind[:-1]
        state[tokens.first] = self.starts
        failure = np.where(state > 0, np.log10(MASS / (state + MASS)), 0.0)
        seen = self.arc_counts[arc]
        along = np.log10((seen + MASS * self.share[word]) / (state + MASS))
        return np.where(seen > 0, along, failure + self.root[word])


RESULT = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)


def score(docs: DataFrame) -> DataFrame:
    """Base and model scores of all texts; see the module for the two models."""
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.length("text") + 1).alias("n")).first()["n"] or 0
    ranges = max(1, math.ceil(total / RANGE_CHARS))
    asked = _asked(docs, ranges)
    answers = staged(_answered(asked), "answers")
    words = answers.filter("NOT pairs").groupBy("range").agg(F.max("kinds").alias("kinds"), F.max("tokens").alias("tokens"))
    sums = words.agg(F.sum("kinds").alias("kinds"), F.sum("tokens").alias("tokens")).first()
    kinds, n = sums["kinds"] or 0, sums["tokens"] or 0

    def named(batches):
        for name, ids, said in _blocks(batches):
            at = 0
            for held in range(0, len(ids), 512):
                part = slice(held, held + 512)
                yield pa.RecordBatch.from_pydict({"block": [name] * len(ids[part]), "doc_id": pa.array(ids[part], pa.int64()), "text": pa.array(said[part], pa.string())})
                at += 512

    rows = docs.mapInArrow(named, "block string, doc_id bigint, text string")
    starts = _training_texts(docs)

    def traverse(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(i) else int(i) for i in rows["doc_id"]]
        return _scored(ids, list(rows["text"]), told, n, kinds, starts)

    return rows.groupBy("block").cogroup(answers.select("block", "pairs", "range", "totals").groupBy("block")).applyInPandas(traverse, RESULT)


def _training_texts(docs: DataFrame) -> int:
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.filter(F.pmod(crc, F.lit(MODULUS)) != HELD_OUT).count()


def _scored(ids: list, said: list, told: pd.DataFrame, n: int, kinds: int, starts: int) -> pd.DataFrame:
    if not ids:
        raise RuntimeError("the table gave other rows when it was read again; write it first")
    tokens = Tokens([t if isinstance(t, str) else None for t in said])
    told = told.sort_values(["pairs", "range"])
    counts = {
        pairs: np.concatenate([_keys(t).astype(np.int64) for t in told.loc[told["pairs"] == pairs, "totals"]] or [np.empty(0, np.int64)])
        for pairs in (False, True)
    }
    words, arcs = np.unique(tokens.token), np.unique(tokens.pair)
    if len(words) != len(counts[False]) or len(arcs) != len(counts[True]):
        raise RuntimeError("the table gave other rows when it was read again; write it first")
    automaton = Automaton(words, counts[False], arcs, counts[True], n, kinds, starts)
    weight = automaton.traverse(tokens)
    c = counts[False][np.searchsorted(words, tokens.token)]
    base = np.log10((c + 1) / (n + kinds + 1))
    return pd.DataFrame(
        {
            "doc_id": pd.array(ids, "Int64"),
            "held_out": [held_out(i) for i in ids],
            "n_tokens": tokens.size,
            "n_known": np.add.reduceat((c > 0).astype(np.int64), tokens.first),
            "train_tokens": n,
            "base_score": np.add.reduceat(base, tokens.first),
            "score": np.add.reduceat(weight, tokens.first),
        }
    )


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a, b) & 255, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


@query(
    "op4_lm_scoring",
    f"""
    WITH docs AS (
        SELECT doc_id, xor({_CRC}, 4294967295) % {MODULUS} = {HELD_OUT} AS held_out,
            list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), ' end') AS w
        FROM documents
    ), tokens AS (
        SELECT doc_id, held_out, unnest(w) AS w, unnest(list_prepend(' start', w[:-2])) AS h FROM docs
    ), trained AS (SELECT * FROM tokens WHERE NOT held_out),
    one AS (SELECT w, count(*) AS c FROM trained GROUP BY w),
    two AS (SELECT h, w, count(*) AS c FROM trained GROUP BY h, w),
    before AS (SELECT h, count(*) AS c FROM trained GROUP BY h),
    total AS (SELECT sum(c)::DOUBLE AS n, count(*)::DOUBLE AS v FROM one)
    SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (one.c > 0) AS n_known, (any_value(n))::BIGINT AS train_tokens,
        {sql_round('sum(log10((coalesce(one.c, 0) + 1) / (n + v + 1)))')} AS base_score,
        {sql_round(f'sum(log10((coalesce(two.c, 0) + {MASS} * (coalesce(one.c, v) / (n + v))) / (coalesce(before.c, 0) + {MASS})))')} AS score
    FROM tokens JOIN total ON true LEFT JOIN one USING (w) LEFT JOIN two USING (h, w) LEFT JOIN before USING (h)
    GROUP BY doc_id, held_out""",
)
def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score(table(spark, sf_dir, "documents")), "base_score", "score")
