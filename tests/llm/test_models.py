"""Mixing, toxicity, secret scans and the pipeline."""

import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import mixing, near_dedup, secret_scan, toxicity

from .conftest import DOCS, prose

WORD = r"[^\x20\x09-\x0D]+"


# ---- mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > 2 * sizes[s]]
        for s in over or open_:
            target[s] = min(2 * sizes[s], weight[s] * share)
        if not over:
            return target
        open_ -= set(over)
        left -= sum(target[s] for s in over)
    return target


@pytest.mark.parametrize("block", [mixing.BLOCK_WORDS, 150])
def test_mix_meets_targets(docs, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", block)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 4_000)
    rows, mixed = mixing.mix_rows(docs)
    rows, copies = rows.collect(), mixed.collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(len(re.findall(WORD, r["text"] or "")))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] in texts[r["doc_id"]]
        sizes[r["source"]] += r["size"]
    by_row = {r["row"]: r for r in rows}
    each = defaultdict(int)
    for c in copies:
        each[c["row"]] += c["words"]
        taken[by_row[c["row"]]["source"]] += c["words"]
    targets = brute_targets(sizes)
    for source, size in sizes.items():
        assert taken[source] == pytest.approx(targets[source], abs=1)
    assert all(r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]] for r in rows)
    assert all(n <= 2 * by_row[row]["size"] for row, n in each.items())
    assert len({(c["row"], c["pass"]) for c in copies}) == len(copies)
    again = mixing.mix_rows(docs.repartition(5, "lang"))[1]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_key"], r["pass"], r["words"], r["shard"], r["shard_order"])
    assert sorted(map(key, again.collect())) == sorted(map(key, copies))
    if block < 1000:
        assert len({c["shard"] for c in copies}) > 5


def test_tree_deals_the_quotas_exactly(llm):
    blocks = llm.createDataFrame(
        [(s, b, 10, 1, 5 if b < 7 else -1) for s in range(3) for b in range(40 * s + 1)], "s int, block long, words long, passes int, left long"
    )
    quota = mixing.shard_quotas(blocks, 11).collect()
    want = {s: sum(2 if b < 7 else 1 for b in range(40 * s + 1)) for s in range(3)}
    units, per_shard = defaultdict(int), defaultdict(int)
    for q in quota:
        units[q["s"]] += q["units"]
        per_shard[q["shard"]] += q["units"]
    assert dict(units) == want and max(per_shard.values()) - min(per_shard.values()) <= 4
    dealt = mixing._shards_of_units(blocks, 11).collect()
    assert len({(d["s"], d["block"], d["pass"]) for d in dealt}) == len(dealt) == sum(want.values())


@pytest.mark.parametrize("sent", [mixing.BROADCAST_ROWS, 0])
def test_mixture_has_whole_texts(docs, empty, clashing, monkeypatch, sent):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", sent)
    by_key = defaultdict(set)
    for r in docs.collect():
        by_key[r["doc_id"]].add(r["text"])
    got = mixing.mix(clashing).collect()
    cut = [r for r in got if r["text"] not in by_key[r["doc_id"]]]
    assert len(cut) <= 4 and all(any((t or "").startswith(r["text"]) for t in by_key[r["doc_id"]]) for r in cut)
    assert all(len(re.findall(WORD, r["text"])) == r["words"] and r["size"] == "mine" for r in got)
    assert mixing.mix(empty).collect() == []


# ---- toxicity


def test_folding():
    fold = toxicity.fold
    assert fold("1D10T") == fold("Idiot") == fold("іdіоt") == fold("ｉｄｉｏｔ") == fold("i​d́iot")
    assert fold("l0ser") == fold("LOSER") and fold("$cum") == fold("scum") and fold("a\nb\tc") == "a b c"


def test_hits_and_exceptions():
    lexicon = toxicity.Lexicon({"trash": 5.0, "idiot": 5.0}, frozenset({"trash can"}))
    hits = lambda t: [h[2] for h in lexicon.hits(toxicity.fold(t))]
    assert hits("Trashy idiot, notrash TRASH") == ["trash", "idiot", "trash"]
    assert hits("a trash can, a trash canoe") == ["trash"] and hits("") == []
    assert lexicon.density("idiot " * 2) > lexicon.density("idiot " * 2 + "x " * 500) > lexicon.density("x") == lexicon.density(None) == 0


def test_learned_lexicon_on_held_out_documents(llm, empty, docs):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        said = prose(rng, rng.randrange(20, 200), 3000).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                said[rng.randrange(len(said))] = rng.choice(("grolling", "Gr0llest", "gro11s", "snarf", "SNARF,"))
        elif i % 40 == 1:
            said[5:7] = ["snarf", "museum"]
        rows.append((i, " ".join(said)))
        labels.append((i, int(toxic)))
    copied = " ".join(f"zzcopy{k}" for k in range(60))
    rows += [(1000 + i, f"{copied} gro11s x{i} snarf") for i in range(40)]
    labels += [(1000 + i, 1) for i in range(40)]
    rows += [(5000, None), (5001, ""), (None, "grolls snarf grolls")]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    told = llm.createDataFrame([*labels, (0, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(df, told)
    assert {w[:4] for w in lexicon.weights} == {"groi", "snar"} and "snarf museum" in lexicon.exceptions
    truth = dict(labels)
    got = toxicity.score(df, lexicon).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        if r["doc_id"] in truth:
            assert r["predicted"] == truth[r["doc_id"]]
    odd = {r["doc_id"]: r["predicted"] for r in got}
    assert (odd[5000], odd[5001], odd[None]) == (0, 0, 1)
    nothing = toxicity.learn(df, told.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.score(df, nothing).collect()} == {0.0}
    assert toxicity.score(empty, lexicon).collect() == []
    assert toxicity.score(docs, lexicon).count() == docs.count()


# ---- secret scans


def test_candidates():
    text = 'x password=abc12345 token = "0f3e9a77b2c1d0" me.1@mail.org see 10.20.30.40 and plainlongword\nKEY9KEY9KEY9.'
    found = [text[a:b] for a, b in secret_scan.candidates(text)]
    assert found == ["abc12345", "0f3e9a77b2c1d0", "me.1@mail.org", "10.20.30.40", "KEY9KEY9KEY9"]
    assert list(secret_scan.candidates("")) == []


def test_a_million_letters_are_scanned_in_no_time():
    began = time.perf_counter()
    assert list(secret_scan.candidates("acgt" * 250_000)) == []
    assert list(secret_scan.candidates("ab" * 100_000 + "7")) == [(0, 200_001)]
    many = "token=abcdef1 " * 20_000
    assert len(list(secret_scan.candidates(many))) == 20_000
    assert time.perf_counter() - began < 5


def test_secrets_beside_columns_of_the_same_names(clashing, docs):
    extra = clashing.selectExpr("*", "1 AS start", "2 AS size", "3 AS digest", "4 AS features", "5 AS probability", "6 AS p", "7 AS vector")
    rows = lambda df: sorted(map(str, secret_scan.scan_secrets(df).collect()))
    assert rows(extra) == rows(docs)


def test_forest_on_held_out_findings(llm, docs, empty):
    rng = random.Random(9)
    key = lambda n: "".join(rng.choice("abcdef0123456789") for _ in range(n))
    issued = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJKLM234567") for _ in range(16))
    rows = []
    for i in range(600):
        value = (f"password={key(18)}", f'token = "{key(40)}"', f"use {issued()} now", f"a{i}.7@mail3.example.com",
                 f"{rng.randrange(256)}.{rng.randrange(256)}.7.{i}", str(rng.randrange(10**15, 10**16)))[i % 6]
        rows.append((i, f"{prose(rng, 5)} {value} {prose(rng, 5)}"))
    df = llm.createDataFrame([*rows, (None, None), (700, "")], "doc_id long, text string").repartition(3)
    got = secret_scan.scan_secrets(df)
    assert [r["n"] for r in got.groupBy("is_secret").agg(F.count("*").alias("n")).orderBy("is_secret").collect()] == [300, 300]
    assert all(r["is_secret"] == (r["doc_id"] % 6 < 3) for r in got.collect())
    found = secret_scan.scan(df)
    unlabelled = secret_scan.judge(found, found.withColumn("label", F.lit(1)))
    assert unlabelled.filter("is_secret and probability = 1").count() == 600
    assert secret_scan.scan_secrets(empty).collect() == []
    assert secret_scan.scan_secrets(docs).columns == got.columns


def test_copies_do_not_fill_the_sample(llm, monkeypatch):
    monkeypatch.setattr(secret_scan, "MAX_FINDINGS", 40)
    vectors = [[float(i), *[float(i % 2)] * (len(secret_scan.FEATURES) - 1)] for i in range(20)]
    distinct = llm.createDataFrame([(v, i % 2) for i, v in enumerate(vectors)], "features array<double>, label int")
    first = distinct.orderBy(F.xxhash64("features")).limit(1)
    findings = distinct.union(first.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(60)))).drop("n"))
    judged = secret_scan.judge(distinct, findings).collect()
    assert all(r["is_secret"] == (r["label"] == 1) for r in judged)


# ---- pipeline


def test_pipeline(llm, docs, tmp_path):
    folder = str(tmp_path)
    rng = random.Random(6)
    item = prose(rng, 30, 10**6)
    good = [(100 + i, prose(rng, 80, 10**5), "en", f"src{i % 3}", 0) for i in range(30)]
    leaked = (200, f"{prose(rng, 40, 10**5)} {item} {prose(rng, 40, 10**5)}", "en", "src1", 0)
    said = prose(rng, 90, 10**5).split()
    copy = [(210 + i, " ".join([*said[: 40 + i], "x", *said[40 + i :]]) + f"\n{prose(rng, 3, 10**5)}", "en", "src2", 0) for i in (0, 1)]
    rows = docs.union(llm.createDataFrame([*good, leaked, *copy], DOCS))
    rows.write.parquet(f"{folder}/documents.parquet")
    llm.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    llm.createDataFrame([(r[0], 1, 0) for r in (*good, leaked, *copy)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    columns = docs.columns
    kept = llm.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(llm, kept, folder)
        seen[name] = {r["doc_id"] for r in kept.collect()}
        if name != "mixing":
            assert kept.columns == columns
    clean = {r[0] for r in good}
    assert all(clean <= ids for ids in list(seen.values())[:4])
    assert {18, 19, 20} & seen["quality_rules"] == set() and 200 in seen["near_dedup"] and 200 not in seen["decontamination"]
    assert len({210, 211} & seen["near_dedup"]) == 1
    linked = near_dedup.near_groups(rows, shingle=2).filter("not leads").select("doc_id").distinct()
    left = {r["doc_id"] for r in corpus_pipeline.near_copies(llm, rows, folder).collect()}
    assert left.isdisjoint({r["doc_id"] for r in linked.collect()}) and linked.count() > 2
    got = corpus_pipeline.run(llm, folder)
    assert {"pass", "words", "shard", "shard_order"} < set(got.columns)
    assert {r["doc_id"] for r in got.collect()} <= seen["decontamination"]
    empty = llm.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(llm, empty, folder).collect() == []
