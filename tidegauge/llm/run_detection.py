"""Runs of repeated words, found by longest common extensions on suffix trees.

A run is a stretch of words with smallest period ``q`` and at least ``max(6, 4 * q)``
words that no neighbouring word extends keeping that period. Ukkonen's algorithm builds
the suffix tree of a stretch and of its reversal. An Euler tour of each tree leaves the
shallowest node between neighbouring leaves, and a table over powers of two answers the
lowest common ancestor of two leaves, the longest common extension, in constant time. The
candidates are the longest Lyndon words that start at each position, under the order of
the words and under its opposite: the root of every run is one of them. Each candidate is
extended in both directions and is a run if it becomes long enough.

Trees are built for zones, the stretches that can hold a run at all. In a run of period
``q`` every word behind the first ``q`` has an equal one at most ``q`` words before it, so
for each power of two ``D`` only places where some ``1.5 * D`` consecutive words have an
equal one at most ``D`` words before can hold a period in ``(D / 2, D]``. Zones are found on
word hashes of a whole batch at once, merged where they overlap, and contain every run
with both its neighbours' verdicts; ordinary prose has none.

Everything is local to a document: one pass, no shuffle, a hot source or a large group of
copies has no effect. Memory grows with the longest zone of one document, by some hundred
bytes a word.

Defined cases. Null text: no words, no runs, the digest of the empty text. Repeated rows
and null ids give one row each. The tie rule for the longest run is length, then start,
then period. Further columns are ignored by the query and kept by ``find_runs``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidegauge.llm import texts
from tidegauge.llm.common import query, table
from tidegauge.llm.lm_scoring import _CRC

MIN_WORDS, MIN_EXPONENT = 6, 4

Run = tuple[int, int, int]  # start, length, period


class SuffixTree:
    """Ukkonen's tree of a sequence of small integers, with constant-time extensions."""

    def __init__(self, letters: list[int]) -> None:
        self.size = len(letters)
        self.text = [*letters, -1]  # the end sorts before every letter in both orders
        self._build()
        self._tour()

    def _build(self) -> None:
        text, n = self.text, len(self.text)
        start, end, link, arcs = [0], [0], [0], [{}]  # node 0 is the root; end n is open
        node = edge = length = pending = 0
        for at in range(n):
            letter, last = text[at], 0
            pending += 1
            while pending:
                if not length:
                    edge = at
                child = arcs[node].get(text[edge])
                if child is None:
                    start.append(at), end.append(n), link.append(0), arcs.append(None)
                    arcs[node][text[edge]] = len(start) - 1
                    if last:
                        link[last] = node
                    last = node
                else:
                    span = min(end[child], at + 1) - start[child]
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    if text[start[child] + length] == letter:
                        if last:
                            link[last] = node
                        length += 1
                        break
                    middle = len(start)
                    start.append(start[child]), end.append(start[child] + length), link.append(0)
                    arcs.append({letter: middle + 1, text[start[child] + length]: child})
                    arcs[node][text[edge]] = middle
                    start[child] += length
                    start.append(at), end.append(n), link.append(0), arcs.append(None)
                    if last:
                        link[last] = middle
                    last = middle
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - pending + 1
        self._start, self._end, self._arcs = start, end, arcs

    def _tour(self) -> None:
        """Leaves in order, and the depth of the shallowest node between neighbours."""
        start, end, arcs, n = self._start, self._end, self._arcs, len(self.text)
        self._sorted = {}
        leaves, between, shallow = [], [], 0
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if node < 0:  # back in the parent, on the way to its next child
                shallow = min(shallow, depth)
                continue
            below = arcs[node]
            if below is None:
                leaves.append(n - depth)
                between.append(shallow)
                shallow = n
                continue
            order = [below[c] for c in sorted(below)]
            self._sorted[node] = order
            for child in reversed(order):
                stack.append((child, depth + end[child] - start[child]))
                stack.append((-1, depth))
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        rows = [np.array(between, np.int32)]
        step = 1
        while 2 * step <= n:
            rows.append(np.minimum(rows[-1][:-step], rows[-1][step:]))
            step *= 2
        self._table = rows

    def opposite_rank(self) -> np.ndarray:
        """Rank of the suffixes where greater letters come first; the end stays first."""
        start, end, arcs, n = self._start, self._end, self._arcs, len(self.text)
        leaves, stack = [], [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if arcs[node] is None:
                leaves.append(n - depth)
                continue
            order = self._sorted[node]
            last = -1 in arcs[node] and order[0]
            # The stack gives the last child first, so the ascending order is read backwards.
            for child in order[1:] if last else order:
                stack.append((child, depth + end[child] - start[child]))
            if last:
                stack.append((last, depth + end[last] - start[last]))
        rank = np.empty(n, np.int64)
        rank[leaves] = np.arange(n)
        return rank

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j``, ``i != j``."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self._table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def _lyndon(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at every position: up to the next smaller suffix."""
    ranks, n = rank.tolist(), len(rank) - 1
    smaller, stack = [0] * n, [n]
    for i in range(n - 1, -1, -1):
        while ranks[stack[-1]] > ranks[i]:
            stack.pop()
        smaller[i] = stack[-1] - i
        stack.append(i)
    return np.array(smaller, np.int64)


def runs(letters: list[int]) -> list[Run]:
    """All runs of a sequence of integers from 0, by start, then period."""
    n = len(letters)
    if n < MIN_WORDS:
        return []
    tree, back = SuffixTree(letters), SuffixTree(letters[::-1])
    found: set[Run] = set()
    for rank in (tree.rank, tree.opposite_rank()):
        period = _lyndon(rank)
        i = np.flatnonzero(MIN_EXPONENT * period <= n)
        p = period[i]
        ahead = tree.extension(i, i + p)
        behind = np.zeros(len(i), np.int64)
        inner = i > 0
        behind[inner] = back.extension(n - i[inner], n - i[inner] - p[inner])
        start, length = i - behind, behind + p + ahead
        long = length >= np.maximum(MIN_WORDS, MIN_EXPONENT * p)
        found.update(zip(start[long].tolist(), length[long].tolist(), p[long].tolist()))
    return sorted(found, key=lambda r: (r[0], r[2]))


def zones(hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of the batch, each inside one text, that can hold a run; disjoint."""
    n = len(hashes)
    if n < MIN_WORDS:
        return []
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    same = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    back = np.full(n, n, np.int64)  # words back to the last equal one of the text
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    found = []
    reach = 1
    while MIN_EXPONENT * (reach // 2 + 1) <= sizes.max() or reach == 1:
        near = np.concatenate([[False], back <= reach, [False]])
        edge = np.flatnonzero(near[1:] != near[:-1])
        begin, end = edge[0::2], edge[1::2]
        least = (MIN_EXPONENT - 1) * (reach // 2 + 1) if reach > 1 else MIN_WORDS - 1
        long = end - begin >= least
        begin, end = begin[long], end[long]
        found += zip(np.maximum(begin - reach, first[owner[begin]]).tolist(), end.tolist())
        reach *= 2
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(found):
        if merged and begin < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((begin, end))
    return merged


def _numbered(words: list[bytes]) -> list[int]:
    known = {w: k for k, w in enumerate(sorted(set(words)))}
    return [known[w] for w in words]


Change = Callable[[int | None, int], np.ndarray | None]


def _batch_runs(ids: list, said: list, change: Change | None) -> Iterator[tuple[list[bytes], list[Run]]]:
    """Words and runs of every text; ``change`` may put other word numbers in place."""
    held = [b"" if t is None else t.encode() for t in said]
    # Without an argument, bytes are split at the six characters that separate words.
    split = [raw.split() for raw in held]
    found = texts.words_of(said)
    hashes, first = found.hashes, found.first
    if change is not None:
        parts = []
        for k, words in enumerate(split):
            own = hashes[first[k] : first[k + 1]]
            at = change(ids[k], len(words))
            if at is not None:
                split[k] = [words[i] for i in at.tolist()]
                own = own[at]
            parts.append(own)
        hashes = np.concatenate(parts) if parts else hashes
    each: list[list[Run]] = [[] for _ in split]
    for begin, end in zones(hashes, first):
        k = int(np.searchsorted(first, begin, "right")) - 1
        at = begin - int(first[k])
        for start, length, period in runs(_numbered(split[k][at : at + end - begin])):
            each[k].append((at + start, length, period))
    yield from zip(split, each)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers after the change that the query's contract makes to a tenth of the ids."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run contains behind its first period."""
    if not found:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


RESULT = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _digest(doc_id: int | None, words: list[bytes], found: list[Run]) -> tuple:
    told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    exponent = None if n is None else 1000 * n // q
    text = b" ".join(collapsed(words, found))
    return doc_id, len(found), s, n, q, exponent, sha256(told.encode()).hexdigest(), sha256(text).hexdigest()


def run_digests(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """Number, longest and digests of the runs of every text, one row per document."""

    def run(batches):
        for batch in batches:
            ids = texts.column(batch, "doc_id")
            rows = [_digest(i, *found) for i, found in zip(ids, _batch_runs(ids, texts.column(batch, "text"), change))]
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in _NAMES]
            columns = zip(*rows) if rows else [[] for _ in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, RESULT)


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``runs``, the start, length and period of every run in words, and
    ``collapsed``, the text that is left when each run keeps its first period."""
    own = [c for c in docs.columns if c not in ("runs", "collapsed")]
    kind = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            rows = list(_batch_runs([None] * batch.num_rows, texts.column(batch, text), None))
            found = [[dict(zip(("start", "length", "period"), r)) for r in found] for _, found in rows]
            left = [b" ".join(collapsed(*row)).decode() for row in rows]
            spans = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, spans), pa.array(left, pa.string())], names=[*own, "runs", "collapsed"])

    kept = docs.select(*own)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("runs", kind), StructField("collapsed", StringType())]))


@query(
    "op11_run_detection",
    f"""
    WITH split AS (
        SELECT doc_id, xor({_CRC}, 4294967295) AS h,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ), planned AS (
        SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed, h // 10 AS g FROM split
    ), placed AS (
        SELECT *, CASE WHEN changed THEN g % n END AS a,
            CASE WHEN changed THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM planned
    ), docs AS (
        SELECT doc_id, n, CASE WHEN changed
            THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w
        FROM placed
    ), words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM docs),
    equal AS (
        SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM words x JOIN words y USING (doc_id, word)
        WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n
    ), islands AS (
        SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal
    ), long AS (
        SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island
        HAVING count(*) + q >= greatest(6, 4 * q)
    ), runs AS (SELECT doc_id, start, length, min(q) AS period FROM long GROUP BY doc_id, start, length),
    told AS (
        SELECT doc_id, count(*) AS n_runs, min_by((start, length, period), (-length, start, period)) AS best,
            string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said
        FROM runs GROUP BY doc_id
    ), dropped AS (
        SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
    ), kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS left_ FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
        1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256,
        sha256(coalesce(left_, '')) AS collapsed_sha256
    FROM docs LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)""",
)
def run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"), planted)
