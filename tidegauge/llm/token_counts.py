"""Exact token counts at every prefix of a text, by dynamic programming over its bytes.

The vocabulary is a byte-level BPE read from a ``tokenizers`` file. A sequence of tokens
is the encoding of its bytes exactly when every two neighbours are the encoding of their
own bytes, so the last token of every prefix follows from shorter prefixes: among the
tokens that end there, one alone stands validly behind the last token of what precedes
it. Its count is one more. This gives the count at every prefix in one pass; truncation
and budget questions are lookups and nothing is encoded again.

The tables run over one piece of the splitting pattern at a time and are kept per
distinct piece (bounded); a text joins those of its pieces. Where a prefix splits
otherwise than the whole text (a run of white space, a contraction or a special string
cut short) the entry is computed for the prefix.

Defined cases. Null text: empty, no tokens. Special strings inside a text count as one
token, as the library does by default. Repeated rows give repeated results, a null
doc_id stays null, further columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.common import query, rows_of, in_batches, table

VOCABULARY = "byte_bpe_50k.json"

# Tables of so many distinct pieces are kept by a worker; then it starts anew.
KEPT_PIECES = 300_000

# The white space of Unicode, which is what the vocabulary's splitting pattern means.
_WS = r"\x09-\x0D\x20\x85\xA0  -     　"
_PIECE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)
_RUN = regex.compile(rf"[{_WS}]{{2,}}(?=[^{_WS}])")


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of all prefixes, for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        model = spec["model"]

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._rank: dict[tuple[bytes, bytes], int] = {}
        self._split: dict[bytes, tuple[bytes, bytes, int]] = {}
        for i, (a, b) in enumerate(merges):
            left, right = raw(a), raw(b)
            self._rank[left, right] = i
            self._split.setdefault(left + right, (left, right, i))
        special = {t["content"] for t in spec["added_tokens"]}
        tokens = {raw(t) for t in model["vocab"] if t not in special}
        self._never = len(merges) + 1
        # What can stand at a border: each token with the pieces it is made of on that
        # side, and the rank of the merge that takes each piece away.
        self._right = {t: self._spine(t, 1) for t in tokens}
        self._left = {t: self._spine(t, 0) for t in tokens if self.merged(t) == [t]}
        self._longest = max(map(len, tokens))
        self._special = re.compile("|".join(sorted(map(re.escape, special), key=len, reverse=True))) if special else None
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._pieces: dict[str, bytes | None] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Encoding by the merge rules; used on two tokens at a time."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self._rank)
        while len(parts) > 1:
            ranks = [self._rank.get(pair, none) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        spine, taken = [], self._never
        while True:
            spine.append((token, taken))
            if token not in self._split:
                return spine
            taken = self._split[token][2]
            token = self._split[token][side]

    def _follows(self, before: bytes, token: bytes) -> bool:
        """Whether no merge over the border between two tokens comes before their own.

        A merge is possible while both pieces are there; of equal merges the left one
        comes first.
        """
        known = self._pairs.get((before, token))
        if known is None:
            if len(self._pairs) > KEPT_PIECES:
                self._pairs.clear()
            rank, never = self._rank, self._never
            known = True
            for a, a_taken in self._right[before]:
                for b, b_taken in self._left[token]:
                    r = rank.get((a, b), never)
                    if r < a_taken and r <= b_taken and r != never:
                        known = False
            self._pairs[before, token] = known
        return known

    def byte_prefixes(self, data: bytes) -> list[int]:
        """Count at every byte prefix of one piece, the empty one included."""
        counts, last, tokens, longest = [0], [b""], self._left, self._longest
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = data[start:end]
                if token in tokens and (not start or self._follows(last[start], token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts

    def _table(self, piece: str) -> list[int]:
        """Count at every character prefix of one piece."""
        data = piece.encode()
        counts = self.byte_prefixes(data)
        if len(data) != len(piece):  # an entry where a character ends
            counts = [n for n, byte in zip(counts[1:], [*data[1:], 0]) if byte & 0xC0 != 0x80]
        else:
            del counts[0]
        if len(piece) == 3 and piece[0] == "'" and piece in ("'re", "'ve", "'ll"):
            counts[1] = 2  # the mark and a letter are two pieces until the third comes
        return counts

    def _small(self, piece: str) -> bytes | None:
        if len(self._pieces) > KEPT_PIECES:
            self._pieces.clear()
        counts = self._table(piece)
        kept = bytes(counts) if max(counts) < 256 else None
        if len(piece) <= 64:
            self._pieces[piece] = kept
        return kept

    def prefixes(self, text: str) -> np.ndarray:
        """Count at every character prefix: entry i is that of ``text[: i + 1]``."""
        if self._special is None or not self._special.search(text):
            return self._ordinary(text)
        out, at, base = [], 0, 0
        for found in self._special.finditer(text):
            cut_short = self._ordinary(text[at : found.end() - 1])
            out.append(base + cut_short)
            plain = self._ordinary(text[at : found.start()])
            out[-1][: len(plain)] = base + plain
            base += (int(plain[-1]) if len(plain) else 0) + 1
            out.append(np.array([base]))
            at = found.end()
        out.append(base + self._ordinary(text[at:]))
        return np.concatenate(out)

    def _ordinary(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int64)
        pieces = _PIECE.findall(text)
        known = self._pieces
        small = [known[p] if p in known else self._small(p) for p in pieces]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if None in small:
            inner = np.concatenate([self._table(p) if s is None else np.frombuffer(s, np.uint8) for p, s in zip(pieces, small)])
        else:
            inner = np.frombuffer(b"".join(small), np.uint8)
        ends = np.cumsum(sizes)
        own = inner[ends - 1].astype(np.int64)
        before = np.cumsum(own) - own
        counts = inner + np.repeat(before, sizes)
        for run in _RUN.finditer(text):
            # The last white space starts the next piece, but ends this one in the prefix.
            start, end = run.span()
            counts[end - 1] = (counts[start - 1] if start else 0) + self._table(run[0])[-1]
        return counts


@lru_cache(maxsize=1)
def counter_of(path: str) -> PrefixCounter:
    """The worker's counter, whose tables later tasks find filled."""
    return PrefixCounter(path)


def cut_at(counts: np.ndarray, limit: int) -> int:
    """Length of the longest prefix of at most ``limit`` tokens."""
    fits = np.flatnonzero(counts <= limit)
    return int(fits[-1]) + 1 if len(fits) else 0


_ARROW = [
    ("doc_id", pa.int64()),
    ("n_bytes", pa.int64()),
    ("n_tokens", pa.int64()),
    ("over_limit", pa.bool_()),
    ("cut_chars", pa.int64()),
]
RESULT = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_chars bigint"


def token_counts(df: DataFrame, limit: int, path: str | None = None, prefixes: bool = False) -> DataFrame:
    """Bytes and tokens of every text, whether it is over ``limit`` and where to cut it.

    ``cut_chars`` is the length in characters of the longest prefix within the limit.
    With ``prefixes`` the counts of all prefixes come as an array. One pass, no shuffle;
    ``path`` is that of the vocabulary file, by default the installed one of each worker.
    """
    schema = pa.schema(_ARROW + ([("prefix_tokens", pa.list_(pa.int32()))] if prefixes else []))

    def run(batches):
        counter = counter_of(path or public_tokenizers.path(VOCABULARY))
        return in_batches(_counted(rows_of(batches), counter, limit, prefixes), schema)

    return df.select("doc_id", "text").mapInArrow(run, RESULT + (", prefix_tokens array<int>" if prefixes else ""))


def _counted(rows: Iterator[dict], counter: PrefixCounter, limit: int, prefixes: bool) -> Iterator[dict]:
    for row in rows:
        text = row["text"] or ""
        counts = counter.prefixes(text)
        total = int(counts[-1]) if len(counts) else 0
        out = {
            "doc_id": row["doc_id"],
            "n_bytes": len(text.encode()),
            "n_tokens": total,
            "over_limit": total > limit,
            "cut_chars": cut_at(counts, limit),
        }
        if prefixes:
            out["prefix_tokens"] = counts.astype(np.int32)
        yield out


@query("op3_token_counts")
def counted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), 1024)
