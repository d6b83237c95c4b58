"""Run detection against a scan of every period, zones, odd texts."""

import random
import re
import zlib
from hashlib import sha256

import pytest

from tidegauge.llm import run_detection

from .conftest import DOCS

WORD = r"[^\x20\x09-\x0D]+"


def brute_runs(words):
    """Every period by itself: stretches of words equal to the one a period later."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(WORD, text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    exponent = best[1] and 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, exponent, sha256(told.encode()).hexdigest(), sha256(left.encode()).hexdigest())


@pytest.mark.parametrize("kinds", [1, 2, 3, 7])
def test_random_sequences(kinds):
    rng = random.Random(kinds)
    for _ in range(400):
        n = rng.randrange(90)
        words = [rng.randrange(kinds) for _ in range(n)]
        if n > 12 and rng.random() < 0.6:
            a = rng.randrange(n - 8)
            p = 1 + (n - a) // rng.randrange(3, 11)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        assert run_detection.runs(words) == brute_runs(words)


def test_zones_lose_no_run():
    rng = random.Random(3)
    texts = []
    for _ in range(200):
        n = rng.randrange(120)
        words = [str(rng.randrange(rng.choice([2, 9, 60]))) for _ in range(n)]
        at, q = rng.randrange(n + 1), rng.randrange(1, 9)
        texts.append(" ".join(words[:at] + words[at : at + q] * rng.randrange(6) + words[at:]))
    found = run_detection._batch_runs([None] * len(texts), texts, None)
    for text, (words, runs) in zip(texts, found):
        assert [w.decode() for w in words] == text.split() and runs == brute_runs(words)


def test_prose_has_no_zone():
    rng = random.Random(5)
    words = " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(5_000))
    found = run_detection.texts.words_of([words])
    assert sum(e - b for b, e in run_detection.zones(found.hashes, found.first)) < 100


def test_query_rows_match_brute_force(llm, docs):
    long = " ".join(f"v{i % 900}" for i in range(12_000))
    more = llm.createDataFrame([(i, f"a b c {i} " + "x y z " * (i % 7) + "\x85q\xa0r " * 9 + "end", "en", "s", 1) for i in range(100, 190)], DOCS)
    rows = docs.union(more).union(llm.createDataFrame([(200, long, None, None, None)], DOCS))
    got = sorted((tuple(r) for r in run_detection.run_digests(rows, run_detection.planted).collect()), key=str)
    want = sorted((brute_row(r["doc_id"], r["text"]) for r in rows.filter("length(text) < 100000 OR text IS NULL").collect()), key=str)
    known = {r[0] for r in want}
    assert [r for r in got if r[0] in known] == want and len(got) == rows.count()
    assert sum(r[1] for r in got) > 90


def test_a_long_run():
    words = list(range(1_000)) * 30
    assert run_detection.runs(words) == [(0, 30_000, 1_000)]


def test_spans_keep_columns(llm, clashing, empty):
    found = run_detection.find_runs(clashing)
    assert found.columns == [*clashing.columns, "runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == clashing.count() and all(r["shard"] == "mine" for r in rows)
    for r in rows:
        words = re.findall(WORD, r["text"] or "")
        if len(words) < 1_000:
            assert [tuple(s) for s in r["runs"]] == brute_runs(words)
    lines = next(r for r in rows if (r["text"] or "").startswith("same line"))
    assert lines["collapsed"] == "same line here again and again" or len(lines["runs"]) > 1
    again = found.select(*clashing.columns, "runs")
    assert run_detection.find_runs(again).columns == found.columns
    assert run_detection.find_runs(empty).count() == 0 and run_detection.run_digests(empty).count() == 0
