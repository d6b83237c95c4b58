"""Words, shingles and their hashes over batches of whole texts, as NumPy arrays.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``. Each word gets a
64-bit hash: a polynomial of its bytes modulo 2**64 under a fixed random byte table,
taken from running sums over the whole batch and finished by a bit mixer. Equal words
have equal hashes in every task; the number of words only costs array passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SEED = 20_240_229
_BASE = 0x9E3779B97F4A7C15 | 1
_BITS = (1 << 64) - 1


class Words(NamedTuple):
    """Hashes of all words of a batch; words of text i are ``hashes[first[i]:first[i + 1]]``."""

    hashes: np.ndarray
    first: np.ndarray
    owner: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finish that spreads all input bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _byte_table(lower: bool) -> np.ndarray:
    table = np.random.Generator(np.random.PCG64(_SEED)).integers(1, 1 << 63, 256, dtype=np.uint64)
    table = table * np.uint64(2) + np.uint64(1)
    if lower:
        table = table.copy()
        table[65:91] = table[97:123]
    return table


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown on demand and kept by the worker."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base & _BITS))
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

# Longest stretch of bytes that is hashed at once; a longer text simply makes one of its own.
STRETCH = 4_000_000


def stretches(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The encoded texts in order, in lists of some ``STRETCH`` bytes; a null is empty."""
    held, size = [], 0
    for text in texts:
        raw = b"" if text is None else text.encode()
        held.append(raw)
        size += len(raw) + 1
        if size >= STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, each closed by a line break, and where each one ends."""
    data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    return data, np.cumsum([len(raw) + 1 for raw in held])


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word and the byte behind it."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data]])))
    return edge[0::2], edge[1::2]


def words_of(texts: list[str | None], lower: bool = False) -> Words:
    """Word hashes of every text; null and blank texts have none."""
    parts = [_hashed(held, lower) for held in stretches(texts)]
    hashes = np.concatenate([h for h, _ in parts]) if parts else np.empty(0, np.uint64)
    sizes = np.concatenate([n for _, n in parts]) if parts else np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return Words(hashes, first, np.repeat(np.arange(len(sizes)), sizes))


def _hashed(held: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    data, ends = joined(held)
    start, end = word_edges(data)
    up, down = _power(len(data) + 1)
    total = np.cumsum(_byte_table(lower)[data] * up[: len(data)])
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    value = (total[end - 1] - before) * down[start]
    hashes = mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of all ``n``-word windows that lie inside one text."""
    h = words.hashes
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    count = len(h) - n + 1
    value = np.zeros(count, np.uint64)
    for k in range(n):
        value += h[k : k + count] * _MULTIPLIERS[k % 64]
    start = np.flatnonzero(words.owner[:count] == words.owner[n - 1 :])
    return mix(value[start]), start


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and owners of the windows; a text of 1 to ``n - 1`` words gives one, itself."""
    value, start = windows(words, n)
    owner = words.owner[start]
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        whole = np.array(
            [_sequence(words.hashes[words.first[i] : words.first[i + 1]]) for i in short], np.uint64
        )
        value, owner = np.concatenate([value, whole]), np.concatenate([owner, short])
    return value, owner


def _sequence(h: np.ndarray) -> np.uint64:
    return mix((h * _MULTIPLIERS[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))[0]


def distinct_sets(value: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of every owner, sorted; set i is ``values[first[i]:first[i + 1]]``."""
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n_texts + 1))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
