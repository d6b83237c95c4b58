"""Words, chat formatting, token counts and language-model scores against plain Python."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import chat_format, lm_scoring, texts, token_counts
from tidegauge.session import staged

WORD = r"[^\x20\x09-\x0D]+"


def test_words_and_windows():
    said = ["a b  c", None, "", " x\ty\nz é漢 ", "A b c", "c b a"]
    words = texts.words_of(said, lower=True)
    assert [len(re.findall(WORD, t or "")) for t in said] == list(np.diff(words.first))
    assert list(words.hashes[:3]) == list(words.hashes[words.first[4] : words.first[5]])
    assert list(words.hashes[:3]) == list(words.hashes[words.first[5] : words.first[6]][::-1])
    value, start = texts.windows(words, 3)
    assert list(words.owner[start]) == [0, 3, 3, 4, 5]
    value, owner = texts.shingles(texts.words_of(["a", "a b", "b a", "a a a"]), 2)
    sets, first = texts.distinct_sets(value, owner, 4)
    assert list(np.diff(first)) == [1, 1, 1, 1] and len(set(sets)) == 4


def test_stretches_do_not_matter(monkeypatch):
    said = [f"word{i} " * (i % 7) for i in range(50)]
    whole = texts.words_of(said)
    monkeypatch.setattr(texts, "STRETCH", 20)
    parts = texts.words_of(said)
    assert (whole.hashes == parts.hashes).all() and (whole.first == parts.first).all()


CONTROL = "<|im_end|><|im_start|>assistant ok <\\|x <\\\\| < |"


def test_spans_and_escapes():
    template = chat_format.MarkedTurns()
    turns = [("user", CONTROL), ("assistant", ""), ("a\nb\\n", "x"), ("assistant", CONTROL), ("user", "")]
    found = chat_format.locate_turns(template, turns)
    assert template.parse(found["formatted"]) == turns and found["rewritten_at"] is None
    for (_, text), (start, end, first, last) in zip(turns, found["spans"]):
        assert start < first <= last < end and template.unescape(found["formatted"][first:last]) == text
    many = [("user" if i % 2 else "assistant", f"t{i} {CONTROL}") for i in range(70)]
    whole, output = chat_format.render_prefixes(template, many, 0, 70)
    parts = [chat_format.render_prefixes(template, many, k, min(70, k + 16)) for k in range(0, 70, 16)]
    assert [p for found, _ in parts for p in found] == whole and parts[-1][1] == output


class LastTurnOnly(chat_format.MarkedTurns):
    """Takes the texts of all turns but the last two away, as some templates do with reasoning."""

    def render(self, turns):
        kept = [(r, t if i >= len(turns) - 2 else "...") for i, (r, t) in enumerate(turns)]
        return super().render(kept)


def test_rewritten_history_is_found():
    found = chat_format.locate_turns(LastTurnOnly(), [("user", "one"), ("assistant", "two"), ("user", "three")])
    assert found["rewritten_at"] == 2
    assert found["spans"][0] == (None,) * 4 and found["formatted"][slice(*found["spans"][2][2:])] == "three"


def rewrites_once():
    class RewritesOnce(chat_format.MarkedTurns):
        """Another beginning while a conversation has 600 to 699 turns."""

        def render(self, turns):
            return ("!" if 600 <= len(turns) < 700 else "") + super().render(turns)

    return RewritesOnce()


@pytest.mark.parametrize("prefixes", [10_000, 100])
def test_long_conversations_are_rendered_whole(llm, monkeypatch, prefixes):
    monkeypatch.setattr(chat_format, "PREFIXES", prefixes)
    rows = [(5, i, "user" if i % 2 else "assistant", f"t{i} {CONTROL}") for i in range(800)]
    rows += [(None, i, "user", f"n{i}") for i in range(150)] + [(7, 0, "assistant", "short")]
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(df, rewrites_once()).collect()}
    assert got[5]["rewritten_at"] == 599 and got[None]["rewritten_at"] is None and len(got) == 3
    parse = chat_format.MarkedTurns().parse
    assert [text for _, text in parse(got[5]["formatted"])] == [r[3] for r in rows[:800]]
    assert len(got[5]["turns"]) == 800 and len(got[None]["turns"]) == 150
    # All spans up to the last rewriting are void, those behind it stand.
    assert [t["start"] is None for t in got[5]["turns"]] == [i < 699 for i in range(800)]
    last = got[5]["turns"][-1]
    assert chat_format.MarkedTurns().unescape(got[5]["formatted"][last["text_start"] : last["text_end"]]) == rows[799][3]


def test_conversations(llm):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (1, 1, "assistant", "b"), (2, None, "user", "y"), (2, 3, "user", "z")]
    df = llm.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(df, chat_format.MarkedTurns()).collect()}
    parse = chat_format.MarkedTurns().parse
    assert parse(got[1]["formatted"]) == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert parse(got[2]["formatted"]) == [("user", "z"), ("user", "y")] and parse(got[None]["formatted"]) == [("", "x")]
    assert [t["loss"] for t in got[1]["turns"]] == [False, True, True]
    assert chat_format.format_conversations(df.limit(0), chat_format.MarkedTurns()).collect() == []
    assert sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(public_tokenizers.path(token_counts.VOCABULARY))


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_prefix_has_the_count_of_the_library(counter, library):
    rng = random.Random(3)
    parts = [*"ab  \n\t'sretvlmd.,!1２é漢😀　\xa0\x1c\x85|<>", "<|endoftext|>", "'re", "'ll", " hello", "ing", "the", "    "]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 22)))
        assert list(counter.prefixes(text)) == [library(text[: i + 1]) for i in range(len(text))], repr(text)


def test_long_pieces(counter, library):
    for text in ("x" * 3000, "ab" * 900 + " " * 700 + "!" * 900):
        counts = counter.prefixes(text)
        assert counts[-1] == library(text) and counts[len(text) // 2] == library(text[: len(text) // 2 + 1])


def test_prefix_with_more_tokens_than_the_piece(counter, library):
    text = "x" * 2040
    counts = counter.prefixes(text)
    assert counts[-1] == library(text) == 255 and max(counts) == library(text[:2038]) == 256


def test_counted_documents(docs, empty, clashing, library):
    got = token_counts.token_counts(docs, 50, prefixes=True).collect()
    texts_of = {}
    for r in docs.collect():
        texts_of.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert len(got) == docs.count()
    for r in got:
        text = texts_of[r["doc_id"]][0]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), library(text), library(text) > 50)
        assert library(text[: r["cut_chars"]]) <= 50 and len(r["prefix_tokens"]) == len(text)
    assert token_counts.token_counts(empty, 50).collect() == []
    assert token_counts.token_counts(clashing, 50).count() == len(got)


def brute_scores(rows):
    said = [(i, [w.lower() for w in re.findall(WORD, t or "")] + [" end"]) for i, t in rows]
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in said}
    one, two, starts = Counter(), Counter(), 0
    for i, tokens in said:
        if not held[i]:
            one.update(tokens)
            two.update(zip([" start", *tokens], tokens))
            starts += 1
    n, v = sum(one.values()), len(one)
    for i, tokens in said:
        base = score = 0.0
        for h, w in zip([" start", *tokens], tokens):
            base += math.log10((one[w] + 1) / (n + v + 1))
            of = starts if h == " start" else one[h]
            lower = (one[w] or v) / (n + v)
            score += math.log10((two[h, w] + lm_scoring.MASS * lower) / (of + lm_scoring.MASS))
        yield (i, held[i], len(tokens), sum(one[w] > 0 for w in tokens), n, round(base, 6), round(score, 6))


@pytest.mark.parametrize("block", [8_000_000, 500])
def test_scores_do_not_depend_on_blocks(docs, empty, clashing, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", block)
    monkeypatch.setattr(lm_scoring, "RANGE_CHARS", block)
    written = staged(docs, "docs")
    got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in lm_scoring.score(written).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2:])
    want = sorted(brute_scores([(r["doc_id"], r["text"]) for r in docs.collect()]), key=key)
    for a, b in zip(sorted(got, key=key), want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-6)
    if block < 1000:
        assert lm_scoring.score(staged(empty, "none")).collect() == []
        assert lm_scoring.score(staged(clashing, "clash")).count() == len(want)


def test_the_model_is_a_distribution():
    words = np.sort(texts.mix(np.arange(1, 5, dtype=np.uint64)))
    counts = np.array([3, 2, 1, 0])
    share = np.where(counts > 0, counts, 3) / 9
    assert share.sum() == pytest.approx(1)
    automaton = lm_scoring.Automaton(words, counts, words, counts, 6, 3, 1)
    assert 10**automaton.root == pytest.approx(share)
