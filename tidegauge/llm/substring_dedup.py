"""Substring dedup: passages that recur anywhere, found by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document. Every word goes that is covered by
a window whose words also start anywhere else, in another document or the same.

1. *Recurring anchors.* The anchor of a window is the least hash among its ``GRAM``-word
   grams, the leftmost of equal ones, so equal windows have equal anchors. Consecutive
   windows mostly share theirs: some 8 % of the words are anchors. They are counted by
   hash, and a bit map of fixed size remembers the hashes found twice or more. A window
   that recurs has its bit set; further bits only cost work.
2. *Segments.* The consecutive windows of one anchor form a segment, at most 58 words.
   Documents are read again, and segments with their bit set go on as text. Equal ones
   are counted before they move. An anchor with more than ``HOT`` different segments is
   dealt window by window, where equal windows fall together again: no group remains that
   one task would have to hold.
3. *Automata.* Segments are dealt to shards by anchor. In a shard the recurring windows
   are confirmed word by word, consecutive ones make a phrase, the phrases are compiled
   into an Aho-Corasick automaton, and all segments of the shard stream through it. It
   reports every place of every phrase. A shard is closed after ``SHARD_CHARS``.
4. *Removal.* The places return to the documents by segment and are cut out there.

Hashes only choose what is compared; equality is decided on words. Places are joined back
by two independent 64-bit hashes of a segment and of a document.

Defined cases. Null or blank text: no words. Documents of fewer words than a window lose
nothing. Repeated rows are documents of their own, so their windows recur. Null ids are ids
like others. Words are bytes between white space, not folded in any way. ``remove_passages``
keeps further columns, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import texts
from tidegauge.llm.common import broadcast_if_small, query, rows_of, table
from tidegauge.session import staged

WINDOW, GRAM = 35, 12

# The map of recurring anchors is 2**FILTER_BITS bits, 8 MB, however many anchors there are;
# when it fills up at a very large size, more segments are compared, with the same result.
FILTER_BITS = 26

# An anchor with more different segments than this is dealt by window.
HOT = 2_000

# Segments of one automaton, in characters; a node of it takes some 40 bytes.
SHARD_CHARS = 600_000

# Segments counted so often are joined by a broadcast of their places, if they are few: the
# documents of a passage that a third of the rows share stay where they are.
COMMON, BROADCAST_ROWS = 500, 200_000

# Words looked at together in a very long text; windows over the border are in both looks.
LOOK = 1 << 22


def _words(said: list[str | None]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """Texts with words joined by one space, and all word hashes, stretch by stretch."""
    at = 0
    for held in texts.stretches(said):
        # Without an argument, bytes are split at the six characters that separate words.
        plain = [b" ".join(raw.split()) for raw in held]
        yield at, plain
        at += len(held)


def _anchors(plain: list[bytes], look: int = LOOK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a stretch: anchor hash, first window, last window, owner, and word starts."""
    hashes, sizes = texts._hashed(plain, False)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    found = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for begin in range(0, max(1, len(hashes)), look):
        part = hashes[begin : begin + look + WINDOW - 1]
        if len(part) < WINDOW:
            break
        for have, new in zip(found, _segments(part, begin, first)):
            have.append(new)
    anchor, begin, end = (np.concatenate(f) for f in found)
    return anchor, begin, end, np.searchsorted(first, begin, "right") - 1, first


def _segments(part: np.ndarray, begin: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows inside one text, with their first and last window."""
    grams = texts.windows(texts.Words(part, None, np.zeros(len(part), np.int8)), GRAM)[0]
    bits = np.uint64(23)  # places below 2**23 words, ties of 41 bits go to the left
    ranked = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    span, least = WINDOW - GRAM + 1, ranked
    step = 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    count = len(part) - WINDOW + 1
    least = np.minimum(least[:count], least[span - step : span - step + count])
    inside = np.ones(count, bool)
    for back in range(1, WINDOW):
        cut = first[1:-1] - begin - back
        inside[cut[(cut >= 0) & (cut < count)]] = False
    new = np.ones(count, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(inside & new)
    # A segment ends before the next one starts, or where its text has no further window.
    ends = np.concatenate([starts[1:], [count]])
    gaps = np.flatnonzero(~inside)
    if len(gaps) and len(starts):
        at = np.searchsorted(gaps, starts)
        ends = np.minimum(ends, np.append(gaps, count)[at])
    place = (least[starts] & np.uint64((1 << 23) - 1)).astype(np.int64)
    return grams[place], starts + begin, ends + begin - 1


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def recurring_anchors(docs: DataFrame) -> np.ndarray:
    """Bit map of the anchors found twice or more; its size does not depend on the corpus."""
    look = LOOK

    def run(batches):
        for batch in batches:
            for _, plain in _words(texts.column(batch, "text")):
                anchor, count = np.unique(_anchors(plain, look)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(anchor), pa.array(count)], names=["h", "n"])

    counts = docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    cells = (
        counts.filter("n >= 2")
        .select(F.shiftright(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 AS INT))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _known(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    slot = anchor >> np.uint64(65 - (64 * len(bits)).bit_length())
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def document_keys() -> tuple[Column, Column]:
    """Two hashes that stand for the id and the text of a document."""
    parts = [F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *parts).alias("k2")


SEGMENT = "k1 bigint, k2 bigint, at int, h bigint, segment string"


def candidate_segments(docs: DataFrame) -> DataFrame:
    """Segments whose anchor may recur, with the number of their first word."""
    bits = docs.sparkSession.sparkContext.broadcast(recurring_anchors(docs))
    look = LOOK

    def run(batches):
        for batch in batches:
            k1, k2 = (np.array(texts.column(batch, n), np.int64) for n in ("k1", "k2"))
            for base, plain in _words(texts.column(batch, "text")):
                anchor, begin, end, owner, first = _anchors(plain, look)
                kept = _known(bits.value, anchor)
                anchor, begin, end, owner = anchor[kept], begin[kept], end[kept], owner[kept]
                data, _ = texts.joined(plain)
                start, stop = texts.word_edges(data)
                raw = data.tobytes()
                cut = [raw[a:b].decode() for a, b in zip(start[begin].tolist(), stop[end + WINDOW - 1].tolist())]
                columns = [pa.array(k1[base + owner]), pa.array(k2[base + owner]), pa.array((begin - first[owner]).astype(np.int32)), _signed(anchor), pa.array(cut, pa.string())]
                whole = pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "at", "h", "segment"])
                for low in range(0, whole.num_rows, 4096):
                    yield whole.slice(low, 4096)

    return docs.select(*document_keys(), "text").mapInArrow(run, SEGMENT)


def _by_window(rows: DataFrame) -> DataFrame:
    """Segments of hot anchors as single windows; ``h`` becomes a hash of the window."""
    words = F.split("segment", " ")
    each = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w")))
    single = rows.withColumn("one", F.explode(each))
    if "at" in rows.columns:
        single = single.withColumn("at", (F.col("at") + F.col("one.i")).cast("int"))
    return single.withColumn("segment", F.col("one.w")).withColumn("h", F.xxhash64("segment")).drop("one")


def _confirmed(held: list[tuple[str, int]]) -> set[str]:
    """Phrases of one anchor: the longest stretches of windows that are there twice."""
    if len(held) == 1 and held[0][1] < 2:
        return set()
    split, counts = [], Counter()
    for segment, n in held:
        gaps = [-1, *(i for i, c in enumerate(segment) if c == " "), len(segment)] if len(held) > 1 or n < 2 else None
        windows = [segment] if gaps is None else [segment[gaps[i] + 1 : gaps[i + WINDOW]] for i in range(len(gaps) - WINDOW)]
        split.append((segment, gaps, windows))
        for w in windows:
            counts[w] += n
    phrases = set()
    for segment, gaps, windows in split:
        if gaps is None:
            phrases.add(segment)
            continue
        begin = None
        for i, w in enumerate([*windows, None]):
            if w is not None and counts[w] > 1:
                begin = i if begin is None else begin
            elif begin is not None:
                phrases.add(segment[gaps[begin] + 1 : gaps[i + WINDOW - 1]])
                begin = None
    return phrases


def _places(shard: list[tuple[int, list[tuple[str, int]]]]) -> Iterator[tuple[int, str, int, list[list[int]]]]:
    """Every segment of a shard that holds a phrase, with the words that phrases cover."""
    automaton = ahocorasick.Automaton()
    for _, held in shard:
        for phrase in _confirmed(held):
            automaton.add_word(f" {phrase} ", len(phrase) + 2)
    if not len(automaton):
        return
    automaton.make_automaton()
    for h, held in shard:
        for segment, n in held:
            covered: list[list[int]] = []
            for last, size in automaton.iter(f" {segment} "):
                begin, end = last - size + 1, last - 1  # in characters of the segment
                while covered and covered[-1][1] >= begin:
                    low, high = covered.pop()
                    begin, end = min(begin, low), max(end, high)
                covered.append([begin, end])
            if covered:
                yield h, segment, n, [[segment.count(" ", 0, b), segment.count(" ", 0, e) + 1] for b, e in covered]


def _shards(rows: Iterable[dict], chars: int) -> Iterator[list[tuple[int, list[tuple[str, int]]]]]:
    """Anchors in order with their segments, in lists of some ``chars`` characters."""
    shard, size = [], 0
    for row in rows:
        if not shard or shard[-1][0] != row["h"]:
            if size >= chars:
                yield shard
                shard, size = [], 0
            shard.append((row["h"], []))
        shard[-1][1].append((row["segment"], row["n"]))
        size += len(row["segment"])
    if shard:
        yield shard


PLACE = "h bigint, g bigint, n bigint, places array<struct<a:int,b:int>>"
_PLACE = pa.schema([("h", pa.int64()), ("segment", pa.string()), ("n", pa.int64()), ("places", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def located(units: DataFrame) -> DataFrame:
    """Places of all phrases in the segments ``h, segment, n``, by sharded automata."""
    chars = SHARD_CHARS

    def run(batches):
        out = []
        for shard in _shards(rows_of(batches), chars):
            for h, segment, n, spans in _places(shard):
                out.append({"h": h, "segment": segment, "n": n, "places": [{"a": a, "b": b} for a, b in spans]})
                if len(out) >= 2048:
                    yield pa.RecordBatch.from_pylist(out, _PLACE)
                    out = []
        yield pa.RecordBatch.from_pylist(out, _PLACE)

    dealt = units.repartition("h").sortWithinPartitions("h")
    found = dealt.mapInArrow(run, "h bigint, segment string, n bigint, places array<struct<a:int,b:int>>")
    return found.select("h", F.xxhash64(F.lit(3), "segment").alias("g"), "n", "places")


def passages(docs: DataFrame) -> DataFrame:
    """``k1, k2, spans``: word ranges of every document that recurring windows cover."""
    segments = staged(candidate_segments(docs), "segments")
    units = staged(segments.groupBy("h", "segment").agg(F.count("*").alias("n")), "units")
    crowded = units.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > HOT).select("h")
    crowded = staged(crowded, "crowded")
    hot = broadcast_if_small(crowded, BROADCAST_ROWS)
    split = _by_window(units.join(hot, "h", "left_semi")).groupBy("h", "segment").agg(F.sum("n").alias("n"))
    places = staged(located(units.join(hot, "h", "left_anti").unionByName(split)), "places")
    rows = segments.join(hot, "h", "left_anti").unionByName(_by_window(segments.join(hot, "h", "left_semi")))
    rows = rows.select("k1", "k2", "at", "h", F.xxhash64(F.lit(3), "segment").alias("g"))
    common = F.col("n") >= COMMON
    often = broadcast_if_small(places.filter(common).drop("n"), BROADCAST_ROWS)
    met = rows.join(often, ["h", "g"], "left")
    direct = met.filter("places IS NOT NULL")
    rest = met.filter("places IS NULL").drop("places").join(places.filter(~common).drop("n"), ["h", "g"])
    spans = direct.unionByName(rest).select("k1", "k2", F.explode("places").alias("p"), "at")
    spans = spans.select("k1", "k2", F.struct((F.col("at") + F.col("p.a")).alias("a"), (F.col("at") + F.col("p.b")).alias("b")).alias("s"))
    return spans.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))


def _kept(text: str | None, spans: list[dict] | None) -> tuple[int, int, str]:
    """Number of words, number of removed words, and the kept words joined by one space."""
    words = (text or "").encode().split()
    if not spans:
        return len(words), 0, b" ".join(words).decode()
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [s["a"] for s in spans], 1)
    np.add.at(change, [s["b"] for s in spans], -1)
    left = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
    return len(words), len(words) - len(left), b" ".join([words[i] for i in left]).decode()


def _with_spans(docs: DataFrame) -> DataFrame:
    """``own``, all columns of a document in one struct, with its text and ``spans``."""
    own = F.struct(*(F.col(c) for c in docs.columns)).alias("own")
    keyed = docs.select(*document_keys(), own)
    return keyed.join(passages(docs.select("doc_id", "text")), ["k1", "k2"], "left").select("own", F.col("own.text").alias("text"), "spans")


def remove_passages(docs: DataFrame) -> DataFrame:
    """All columns; ``text`` becomes the words that no recurring window covers, joined by
    one space, and a document that loses nothing keeps its text as it is."""
    kind = docs.schema["text"].dataType

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else _kept(t, list(s))[2] for t, s in zip(text, spans)], dtype=object)

    met = _with_spans(docs)
    new = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans")).cast(kind).alias("text")
    return met.select(*(new if c == "text" else F.col("own")[c].alias(c) for c in docs.columns))


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def removal_digests(docs: DataFrame) -> DataFrame:
    """What ``remove_passages`` leaves of every document, as counts and a digest."""

    def run(batches):
        for batch in batches:
            n, gone, left = [], [], []
            for text, spans in zip(texts.column(batch, "text"), texts.column(batch, "spans")):
                words, removed, kept = _kept(text, spans)
                n.append(words), gone.append(removed), left.append(sha256(kept.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    met = _with_spans(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"))
    return met.select(F.col("own.doc_id").alias("doc_id"), "text", "spans").mapInArrow(run, RESULT)


@query(
    "op12_substring_dedup",
    f"""
    WITH split AS (
        SELECT row_number() OVER () AS row_, doc_id,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ), places AS (
        SELECT row_, unnest(range(len(w) - {WINDOW - 1})) AS i,
            unnest(list_transform(range(len(w) - {WINDOW - 1}), lambda k: array_to_string(w[k + 1 : k + {WINDOW}], ' '))) AS said
        FROM split WHERE len(w) >= {WINDOW}
    ), twice AS (SELECT said FROM places GROUP BY said HAVING count(*) > 1),
    gone AS (
        SELECT DISTINCT row_, i + k AS i FROM (SELECT row_, i FROM places SEMI JOIN twice USING (said)), range({WINDOW}) t(k)
    ), words AS (SELECT row_, unnest(range(len(w))) AS i, unnest(w) AS word FROM split),
    left_ AS (
        SELECT row_, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS said
        FROM words ANTI JOIN gone USING (row_, i) GROUP BY row_
    )
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
    FROM split LEFT JOIN left_ USING (row_)""",
)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))
