"""Quality rules, line dedup, near dedup and decontamination against plain Python."""

import random
import re
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest

from tidegauge.llm import decontamination, line_dedup, near_dedup, quality_rules

from .conftest import prose

WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


def plain(rows):
    return [tuple(r) for r in rows]


# ---- quality rules


def brute_quality(text):
    said = words(text)
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    count = Counter(tuple(said[i : i + 5]) for i in range(len(said) - 4))
    covered = {j for i in range(len(said) - 4) if count[tuple(said[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(said) < 10 or 100 * len(covered) > 20 * len(said)
    return len(said), sum(map(len, said)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(covered), failed


def brute_score(text, raw, trusted):
    grams = [(text or "").encode()[i : i + 3] for i in range(len((text or "").encode()) - 2)]
    bins = [int(quality_rules._bins(np.frombuffer(g, np.uint8))[0]) for g in grams]
    weights = quality_rules.log_ratios(raw, trusted)
    return sum(weights[b] for b in bins) / max(len(bins), 1)


def test_quality(llm, docs, empty, clashing):
    labels = llm.createDataFrame([(0, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    raw, trusted = quality_rules.gram_counts(docs, labels)
    rows = docs.collect()
    size = lambda t: max(0, len((t or "").encode()) - 2)
    assert raw.sum() == sum(size(r["text"]) for r in rows)
    assert trusted.sum() == sum(size(r["text"]) for r in rows if r["doc_id"] in (0, 1))
    by_id = {r["doc_id"]: r["text"] for r in rows}
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        counts = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert counts == brute_quality(by_id[r["doc_id"]])
        assert r["score"] == pytest.approx(brute_score(by_id[r["doc_id"]], raw, trusted), abs=1e-9)
        assert not (r["kept"] and r["base_failed"])
    assert all(r["kept"] for r in got if r["doc_id"] in (0, 1))
    assert quality_rules.keep_good(empty, labels).collect() == []
    kept = quality_rules.keep_good(clashing, labels)
    assert kept.columns == clashing.columns and kept.filter("score = 'mine'").count() == sum(r["kept"] for r in got)
    nobody = quality_rules.judge(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in nobody)


def test_one_wrong_label_does_not_move_the_threshold(llm):
    rng = random.Random(3)
    good = [(i, prose(rng, 60)) for i in range(40)]
    junk = [(100 + i, " ".join("".join(rng.choice("#@%&;~^") for _ in range(6)) for _ in range(60))) for i in range(40)]
    df = llm.createDataFrame(good + junk, "doc_id long, text string")
    for n in (4, 40):
        labels = llm.createDataFrame([(i, 1) for i in (*range(n), 100)], "doc_id long, quality int")
        kept = {r["doc_id"] for r in quality_rules.judge(df, labels).filter("kept").collect()}
        assert kept & set(range(n)) == set(range(n)) and not any(i >= 100 for i in kept)


# ---- line dedup


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) < line_dedup.MIN_WORDS or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_lines(rows):
    places = {}
    for doc_id, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if words(line):
                places[doc_id is not None, doc_id or 0, pos, tuple(words(line))] = None
    first = {}
    for *place, said in sorted(places):
        first.setdefault(said, tuple(place))
    found = {a for a in first for b in first if first[b] < first[a] and near(list(a), list(b))}
    out = []
    for doc_id, text in rows:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        kept, counts = [], [0, 0]
        for pos, line in enumerate(text.split("\n")):
            said = tuple(words(line))
            if said in found:
                counts[0] += 1
            elif said and first[said] != (doc_id is not None, doc_id or 0, pos):
                counts[1] += 1
            else:
                kept.append(line)
        out.append((doc_id, "\n".join(kept), *counts))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_lines(llm, docs, empty, clashing):
    columns = ["doc_id", "text", "n_near", "n_exact"]
    want = order(brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert order(plain(line_dedup.dedup_lines(docs).select(*columns).collect())) == want
    got = line_dedup.dedup_lines(clashing)
    assert order(plain(got.select(*columns).collect())) == want and got.filter("line = 'mine' and pos = 'mine'").count() == len(want)
    assert line_dedup.dedup_lines(empty).collect() == []


def test_edited_lines(llm):
    rng = random.Random(11)
    lines = [prose(rng, n, 30).split() for n in (4, 5, 6, 7, 12, 13, 40) for _ in range(3)]
    for said in list(lines):
        for _ in range(3):
            edited = list(said)
            for _ in range(rng.choice((1, 1, 2))):
                i = rng.randrange(len(edited))
                edited[i : i + 1] = rng.choice(([], ["new"], [edited[i], edited[i]], ["x", edited[i]]))
            lines.append(edited)
    rng.shuffle(lines)
    rows = [(i // 4, " ".join(line)) for i, line in enumerate(lines)]
    texts = {}
    for doc_id, line in rows:
        texts.setdefault(doc_id, []).append(line)
    rows = [(doc_id, "\n".join(said)) for doc_id, said in texts.items()]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    got = plain(line_dedup.dedup_lines(df).select("doc_id", "text", "n_near", "n_exact").collect())
    assert order(got) == order(brute_lines(rows)) and sum(r[2] for r in got) > 15


def test_many_and_shuffled_joins(llm, docs, monkeypatch):
    """Without broadcasts the joins go another way to the same result."""
    want = order(plain(line_dedup.dedup_lines(docs).select("doc_id", "text", "n_near", "n_exact").collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert order(plain(line_dedup.dedup_lines(docs).select("doc_id", "text", "n_near", "n_exact").collect())) == want


# ---- near dedup


def shingle_set(text, n):
    said = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]
    if 0 < len(said) < n:
        return {tuple(said)}
    return {tuple(said[i : i + n]) for i in range(len(said) - n + 1)}


def brute_groups(rows, n, percent=80):
    sets = [shingle_set(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


@pytest.mark.parametrize("n", [2, 5])
def test_groups(docs, n):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = plain(near_dedup.near_groups(docs, n).select("doc_id", "n_shingles", "component_id").collect())
    assert order(got) == order(brute_groups(rows, n))


@pytest.fixture(scope="module")
def copies(llm):
    """A large group of copies, each changed by another amount, with some just too far off."""
    rng = random.Random(5)
    rows = []
    for _ in range(4):
        origin = [f"q{rng.randrange(10**6)}" for _ in range(120)]
        for k in range(45):
            changed = list(origin)
            for i in rng.sample(range(120), k % 15):
                changed[i] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [near_dedup.BLOCK_SHINGLES, 700])
def test_large_groups_lose_no_link(llm, copies, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    df = llm.createDataFrame(copies, "doc_id long, text string").repartition(4)
    got = plain(near_dedup.near_groups(df, 2).select("doc_id", "n_shingles", "component_id").collect())
    assert order(got) == order(brute_groups(copies, 2))


def test_one_of_each_group_stays(docs, empty, clashing, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = brute_groups(rows, 5)
    want = {g[2] for g in groups}
    kept = near_dedup.dedup(clashing, 5)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert near_dedup.dedup(docs, 5).count() == len(want)
    assert near_dedup.dedup(empty, 5).collect() == []


def test_sketches_lose_no_pair_of_a_small_bucket(llm, monkeypatch):
    monkeypatch.setattr(near_dedup, "MARGIN", -0.2)  # no differing sample is allowed
    rng = random.Random(8)
    rows = []
    for _ in range(20):
        said = prose(rng, 100, 10**6).split()
        rows += [(len(rows), " ".join(said)), (len(rows) + 1, " ".join([*said[:95], *prose(rng, 5, 10**6).split()]))]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    got = plain(near_dedup.near_groups(df, 2).select("doc_id", "n_shingles", "component_id").collect())
    assert order(got) == order(brute_groups(rows, 2))


def test_sketches_keep_similar_pairs():
    """The estimate never rules out a similar pair, and rules out most dissimilar ones."""
    rng = np.random.default_rng(1)
    most = near_dedup.SKETCH_BITS / 2 * (1 - np.exp(-4 * 80 * (1 - 0.6) / near_dedup.SKETCH_BITS))

    def counts(shared, own):
        out = []
        for _ in range(200):
            common = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
            both = [np.concatenate([common, rng.integers(0, 1 << 63, own, dtype=np.uint64)]) for _ in range(2)]
            samples = near_dedup._minhashes(np.concatenate(both), np.array([0, shared + own]))
            a, b = near_dedup._odd_sketches(samples).view(np.uint64)
            out.append(int(np.bitwise_count(a ^ b).sum()))
        return np.array(out)

    assert (counts(400, 50) <= most).all()  # similarity 0.8
    assert (counts(100, 200) > most).mean() > 0.95  # similarity 0.2


# ---- decontamination


def brute_overlaps(docs, items):
    distinct = {}
    for item_id, text in items:
        said = tuple(words((text or "").lower()))
        if len(said) >= decontamination.SHORT:
            distinct[said] = min(item_id, distinct.get(said, item_id))
    for doc_id, text in docs:
        have, found = words((text or "").lower()), {}
        for said, item_id in distinct.items():
            for lag in range(-len(said), len(have)):
                equal = [q for q in range(len(said)) if 0 <= q + lag < len(have) and have[q + lag] == said[q]]
                if len(said) < decontamination.SPAN:
                    if len(equal) == len(said):
                        found[item_id] = len(said)
                    continue
                seeded = any(
                    q + lag >= 0 and q + lag + decontamination.SPAN <= len(have) and q + decontamination.SPAN <= len(said)
                    and any(all(q + p in set(equal) for p in mask) for mask in decontamination.MASKS)
                    for q in equal
                )
                window = min(decontamination.WINDOW, len(said))
                need = -(-window * decontamination.MATCHES // decontamination.WINDOW)
                dense = any(equal[k + need - 1] - equal[k] < window for k in range(len(equal) - need + 1))
                if seeded and dense:
                    found[item_id] = max(found.get(item_id, 0), len(equal))
        yield doc_id, bool(found), min(found) if found else None, len(found), max(found.values(), default=0)


def test_masks_reach_every_accepted_overlap():
    """All substitutions that the item's size allows, some of them as words cut off at the document's ends.

    Left out is where no equal word begins a mask, which can't happen from 15 words on.
    """
    span = decontamination.SPAN
    for n, most in ((15, 3), (14, 2), (13, 2), (12, 2)):
        for size in range(most + 1):
            for gone in combinations(range(n), size):
                for lead, trail in product(range(size + 1), repeat=2):
                    cut = {*range(lead), *range(n - trail, n)}
                    if lead + trail > n - span or not cut <= set(gone):
                        continue
                    starts = set(range(lead, n - trail - span + 1))
                    if starts <= set(gone):
                        assert n < 14
                        continue
                    assert any(not {s + p for p in mask} & set(gone) for mask in decontamination.MASKS for s in starts)


def test_overlaps_with_three_substitutions(llm):
    rng = random.Random(12)
    item = [f"w{i}" for i in range(15)]
    rows = []
    for gone in combinations(range(15), 3):
        said = ["other" if i in gone else w for i, w in enumerate(item)]
        rows.append((len(rows), f"{prose(rng, 9, 10**6)} {' '.join(said)} {prose(rng, 9, 10**6)}"))
    df = llm.createDataFrame(rows, "doc_id long, text string")
    bench = llm.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert decontamination.judge(df, bench).filter("contaminated and matched_words = 12").count() == len(rows)


def test_overlaps(llm, empty, monkeypatch):
    rng = random.Random(2)
    items = [(i, prose(rng, n, 500)) for i, n in enumerate((11, 12, 13, 15, 20, 40, 60))] + [(7, None), (8, ""), (9, None)]
    items += [(30, prose(rng, 5, 500)), (31, prose(rng, 8, 500)), (32, prose(rng, 4, 500))]
    items += [(20, items[4][1]), (3, items[3][1])]
    rows = []
    rows += [(800 + i, f"{prose(rng, 9)} {t.upper()} {prose(rng, 3)}") for i, t in items[10:13]]
    for item_id, text in [*items[:7], *items[10:13]]:
        for changes in (0, 1, 2, 4, 8):
            said = text.split()
            for i in rng.sample(range(len(said)), min(changes, len(said))):
                said[i] = "other"
            cut = rng.choice((0, 0, 3))
            rows.append((len(rows), f"{prose(rng, rng.randrange(20))} {' '.join(said[cut:]).upper()}\n{prose(rng, rng.randrange(9))}"))
    rows += [(900, None), (901, ""), (902, items[5][1]), (902, items[5][1]), (None, items[6][1] + " " + items[5][1])]
    assert {30, 31} <= {r[2] for r in brute_overlaps(rows, items)} and 32 not in {r[2] for r in brute_overlaps(rows, items)}
    df = llm.createDataFrame([(*r, "mine", 4) for r in rows], "doc_id long, text string, w string, item_id int")
    bench = llm.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "contaminated", "item_id", "n_items", "matched_words"]
    want = order(brute_overlaps(rows, items))
    assert order(plain(decontamination.judge(df, bench).select(*columns).collect())) == want
    clean = decontamination.decontaminate(df, bench)
    assert clean.columns == df.columns and clean.filter("item_id = 4").count() == sum(not r[1] for r in want)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert order(plain(decontamination.judge(df, bench).select(*columns).collect())) == want
    assert decontamination.judge(empty, bench).collect() == []
    assert not decontamination.judge(df, bench.limit(0)).filter("contaminated").collect()
