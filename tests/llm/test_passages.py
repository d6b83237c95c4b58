"""Substring dedup against a dictionary of all windows."""

import random
import re
from collections import Counter
from hashlib import sha256

import pytest

from tidegauge.llm import substring_dedup

from .conftest import DOCS, prose

WORD = r"[^\x20\x09-\x0D]+"
N = substring_dedup.WINDOW


def brute(texts):
    """Kept words of every text."""
    split = [re.findall(WORD, t or "") for t in texts]
    counts = Counter(tuple(w[i : i + N]) for w in split for i in range(len(w) - N + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - N + 1):
            if counts[tuple(w[i : i + N])] > 1:
                gone.update(range(i, i + N))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def brute_rows(rows):
    for r, kept in zip(rows, brute([r["text"] for r in rows])):
        n = len(re.findall(WORD, r["text"] or ""))
        yield (r["doc_id"], n, n - len(kept), sha256(" ".join(kept).encode()).hexdigest())


def shared(rng, count, passages):
    """Texts that share passages of every length around the window, also inside themselves."""
    out = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randrange(5)):
            parts.append(prose(rng, rng.randrange(60), 9_000))
            cut = rng.choice(passages).split()
            at = rng.randrange(20)
            parts.append(rng.choice([" ", "\n", " \t "]).join(cut[at : at + rng.randrange(80)]))
        out.append("  ".join(parts))
    return out


@pytest.fixture(scope="module")
def mixed(llm, docs):
    rng = random.Random(11)
    passages = [prose(rng, 90, 9_000) for _ in range(12)] + ["a b c d e f g h " * 12, "tick " * 90]
    texts = shared(rng, 150, passages)
    license_ = prose(rng, 20, 500)  # shorter than a window, in many documents
    texts += [f"{prose(rng, 40, 9_000)} {license_} {prose(rng, 40, 9_000)}" for _ in range(80)]
    rows = [(1_000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return docs.union(llm.createDataFrame(rows, DOCS)).repartition(4).cache()


def digests(df):
    return sorted((tuple(r) for r in substring_dedup.removal_digests(df).collect()), key=str)


def test_rows_match_brute_force(mixed):
    want = sorted(brute_rows(mixed.collect()), key=str)
    assert digests(mixed) == want
    assert sum(r[2] > 0 for r in want) > 100


@pytest.mark.parametrize("name,value", [("HOT", 2), ("SHARD_CHARS", 1), ("COMMON", 1), ("COMMON", 10**9), ("BROADCAST_ROWS", 0), ("FILTER_BITS", 7), ("LOOK", 100)])
def test_sizes_do_not_change_the_result(mixed, monkeypatch, name, value):
    want = digests(mixed)
    monkeypatch.setattr(substring_dedup, name, value)
    assert digests(mixed) == want


def test_rows_come_through_the_automaton(mixed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "located", lambda units: units.limit(0).selectExpr("h", "h AS g", "n", "CAST(NULL AS array<struct<a:int,b:int>>) AS places"))
    assert all(r[2] == 0 for r in digests(mixed))


def test_segments_hold_every_window_once():
    rng = random.Random(2)
    texts = [prose(rng, n, 50) for n in (0, 1, 34, 35, 36, 200, 3, 35)]
    plain = [t.encode() for t in texts]
    _, begin, end, owner, first = substring_dedup._anchors(plain)
    seen = Counter((o, i - first[o]) for b, e, o in zip(begin, end, owner) for i in range(b, e + 1))
    want = Counter((k, i) for k, t in enumerate(texts) for i in range(len(t.split()) - N + 1))
    assert seen == want


def test_removal_keeps_columns(llm, clashing, empty):
    extra = clashing.selectExpr("*", "1 AS h", "3 AS spans", "4 AS k1", "5 AS own", "6 AS g", "7 AS places", "8 AS segment")
    left = substring_dedup.remove_passages(extra)
    assert left.schema.names == extra.schema.names
    got, before = left.collect(), extra.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in before)
    want = {(r["doc_id"], " ".join(k)) for r, k in zip(before, brute([r["text"] for r in before]))}
    assert {(r["doc_id"], " ".join(re.findall(WORD, r["text"] or ""))) for r in got} == want
    assert all(r["shard"] == "mine" and r["spans"] == 3 and r["own"] == 5 for r in got)
    assert substring_dedup.remove_passages(empty).count() == 0 and digests(empty) == []
