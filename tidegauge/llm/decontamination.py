"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

Fixed masks pick some of the words of a window and ignore the others, so that a replaced
word spoils only the windows in which it is picked. The hashes of all benchmark windows
meet those of all document windows; a meeting fixes how the item lies along the document.
Along that alignment the words are compared one by one, and the overlap counts when
``WINDOW`` consecutive words of the item hold ``MATCHES`` equal ones. Words are
lower-cased runs between white space.

Items of ``SHORT`` words to fewer than a mask spans have one hash each, of all their words,
that meets the document's windows of the same length; they match where every word is equal.

Defined cases. Items of fewer than ``SHORT`` words are no evidence and never match. An item
that a mask spans matches nothing in documents of fewer words than that; those up to
``WINDOW`` words are compared as a whole, at the same share of equal words. Null texts have no words. Equal items are compared once and reported under
the smallest item_id. Rows that repeat id and text are one document. Further columns are
kept as they are. Empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACES, broadcast_if_small, query, table, text_hash
from tidegauge.session import staged

# Picked positions of each mask, five of twelve words, the first one always. Whatever words of
# an accepted window are replaced or beyond the document's ends, some mask picks none of them.
# Only items under fifteen words are missed, if no equal word begins twelve that lie along the
# document: the first of 12 words replaced, or two of 13 replaced or cut off at the ends.
MASKS = ((0, 1, 4, 6, 7), (0, 3, 8, 10, 11), (0, 2, 5, 6, 9), (0, 4, 5, 7, 9))
SPAN = 12
SHORT = 5
WINDOW = 15
MATCHES = 12

# So many rows of three numbers (some 20 MB) are sent to every executor; a longer table
# is joined by a shuffle.
BROADCAST_ROWS = 500_000

DOC = ["doc_id", "text_key"]


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")


def _seeds(hashes: Column) -> Column:
    """Seed keys of all windows, those of the first mask first; null without a window."""
    count = F.size(hashes) - SPAN

    def mask(number: int, picked: tuple[int, ...]) -> Column:
        return F.transform(
            F.sequence(F.lit(0), count),
            lambda i: F.xxhash64(F.lit(number), *(F.get(hashes, i + p) for p in picked)),
        )

    return F.when(count >= 0, F.concat(*(mask(m, picked) for m, picked in enumerate(MASKS))))


def _windows(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per window and mask: key and position of its first word."""
    hashed = rows.select(*keep, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    seeded = hashed.select(*keep, (F.size("h") - SPAN + 1).alias("n"), _seeds(F.col("h")).alias("seeds"))
    # The outer form: a plain explode adds a filter that would compute the seeds twice.
    every = seeded.select(*keep, "n", F.posexplode_outer("seeds").alias("at", "key")).filter(F.col("key").isNotNull())
    return every.select(*keep, F.pmod("at", "n").alias("at"), "key")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Distinct items with their words, under the smallest id."""
    items = benchmark.select("item_id", words("text").alias("w")).filter(F.size("w") >= SHORT)
    return items.groupBy("w").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_key, item_id, at, matched``: verified overlaps, ``at`` being the
    document's word that the item's first word falls on (negative if cut off)."""
    every = staged(benchmark_items(benchmark), "items")
    items, short = every.filter(F.size("w") >= SPAN), every.filter(F.size("w") < SPAN)
    seeds = _windows(items, "item_id").select("key", "item_id", F.col("at").alias("item_at")).distinct()
    docs = docs.select("doc_id", "text", text_hash().alias("text_key"))
    spoken = docs.select(*DOC, words("text").alias("w"))
    met = _windows(spoken, *DOC).join(broadcast_if_small(staged(seeds, "seeds"), BROADCAST_ROWS), "key")
    hits = met.select(*DOC, "item_id", (F.col("at") - F.col("item_at")).alias("at")).distinct()
    hits = staged(hits, "hits")
    lying = hits.groupBy(*DOC).agg(F.collect_list(F.struct("item_id", "at")).alias("hits"))
    lying = lying.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "hits")
    few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = docs.select(*DOC, "text").join(
        F.broadcast(lying) if few else lying,
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")),
    )
    found = found.select(*DOC, "hits", words("text").alias("w"))
    # From here on a hit carries the document's words under the longest item at most.
    one = found.select(*DOC, F.explode_outer("hits").alias("hit"), "w").select(*DOC, "hit.item_id", "hit.at", "w")
    sized = items.select("item_id", F.size("w").alias("size"))
    one = one.join(broadcast_if_small(sized, BROADCAST_ROWS), "item_id")
    under = F.slice("w", F.greatest("at", F.lit(0)) + 1, F.col("size"))
    one = one.select(*DOC, "item_id", "at", under.alias("under"))
    judged = one.join(items.select("item_id", F.col("w").alias("said")), "item_id").withColumn("equal", _equal_places())
    judged = judged.withColumn("matched", F.size("equal")).filter(_dense())
    judged = judged.select(*DOC, "item_id", "at", "matched").distinct()
    lengths = sorted(r[0] for r in short.select(F.size("w")).distinct().collect())  # SPAN - SHORT at most
    for length in lengths:
        judged = judged.unionByName(_equal_items(spoken, short.filter(F.size("w") == length), length))
    return judged


def _equal_items(spoken: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """Places where a document has all words of an item of ``length`` words."""

    def window(i: Column) -> Column:
        return F.xxhash64(F.lit(length), *(F.get("w", i + k) for k in range(length)))

    starts = F.sequence(F.lit(0), F.size("w") - length)
    hashed = spoken.select(*DOC, "w", F.when(F.size("w") >= length, F.transform(starts, window)).alias("h"))
    placed = hashed.select(*DOC, "w", F.posexplode_outer("h").alias("at", "key")).filter(F.col("key").isNotNull())
    placed = placed.select(*DOC, "at", "key", F.slice("w", F.col("at") + 1, length).alias("under"))
    known = items.select(window(F.lit(0)).alias("key"), "item_id", F.col("w").alias("said"))
    # A short item is a dozen words at most.
    met = placed.join(broadcast_if_small(known, BROADCAST_ROWS // 10), "key").filter(F.col("under") == F.col("said"))
    return met.select(*DOC, "item_id", "at", F.lit(length).alias("matched")).distinct()


def _equal_places() -> Column:
    """Positions in the item whose word equals the one of the document beside it."""
    skipped = F.greatest(-F.col("at"), F.lit(0))
    beside = F.slice("said", skipped + 1, F.size("said"))
    equal = F.zip_with("under", beside, lambda x, y: F.coalesce(x == y, F.lit(False)))
    places = F.transform(equal, lambda e, i: F.when(e, i))
    return F.filter(places, lambda p: p.isNotNull())


def _dense() -> Column:
    """Whether some window of the item has enough equal words."""
    window = F.least(F.lit(WINDOW), F.size("said"))
    need = F.ceil(window * MATCHES / WINDOW).cast("int")
    count = F.size("equal")
    ends = F.sequence(need - 1, F.greatest(count - 1, need - 1))
    return (count >= need) & F.exists(
        ends, lambda k: F.coalesce(F.get("equal", k) - F.get("equal", k - need + 1) < window, F.lit(False))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents with an overlap: smallest item, number of distinct items, most equal words."""
    found = overlaps(docs, benchmark)
    return found.groupBy(*DOC).agg(
        F.min("item_id").alias("item_id"),
        F.count_distinct("item_id").alias("n_items"),
        F.max("matched").alias("matched_words"),
    )


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``contaminated, item_id, n_items, matched_words``."""
    found = staged(contaminated(docs, benchmark), "contaminated")
    found = found.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    own = [c for c in docs.columns if c not in ("contaminated", "item_id", "n_items", "matched_words")]
    met = _keyed(docs.select(*own)).join(
        broadcast_if_small(found, BROADCAST_ROWS),
        F.col("_own.doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_text_key")),
        "left",
    )
    return met.select(
        "_own.*",
        F.col("_text_key").isNotNull().alias("contaminated"),
        "item_id",
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("matched_words", F.lit(0)).cast("bigint").alias("matched_words"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"))
    kept = _keyed(docs).join(
        broadcast_if_small(staged(found, "contaminated"), BROADCAST_ROWS),
        F.col("_own.doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_text_key")),
        "left_anti",
    )
    return kept.select("_own.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """All columns in one struct, whatever their names, beside the hash of the text."""
    return docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_own"), text_hash().alias("_key"))


def _sql_seeds(picked: tuple[int, ...]) -> str:
    return " || ' ' || ".join(f"w[i + {p + 1}]" for p in picked)


# The SQL twin seeds with masks of its own, which miss some overlaps that are found here.
_SQL_MASKS = ((0, 1, 2, 4, 7, 8, 10, 11), (0, 1, 3, 4, 5, 9, 10, 11))
_SQL_WORDS = "list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SQL_WINDOWS = " UNION ALL ".join(
    f"SELECT id, unnest(range(0, len(w) - {SPAN} + 1)) AS i, {m} AS mask, "
    f"unnest(list_transform(range(0, len(w) - {SPAN} + 1), lambda i: {_sql_seeds(picked)})) AS seed FROM {{0}}"
    for m, picked in enumerate(_SQL_MASKS)
)


@query(
    "op10_decontamination",
    f"""
    WITH said AS (SELECT doc_id AS id, {_SQL_WORDS} AS w FROM documents),
    items AS (
        SELECT min(item_id) AS id, w FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark)
        WHERE len(w) >= {SPAN} GROUP BY w
    ),
    item_seeds AS ({_SQL_WINDOWS.format('items')}),
    doc_seeds AS ({_SQL_WINDOWS.format('said')}),
    hits AS (
        SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.i - b.i AS lag
        FROM doc_seeds d JOIN item_seeds b USING (mask, seed)
    ),
    equal AS (
        SELECT doc_id, item_id, lag, list_filter(range(1, len(items.w) + 1),
            lambda q: q + lag >= 1 AND said.w[greatest(q + lag, 1)] IS NOT DISTINCT FROM items.w[q]) AS e, len(items.w) AS n
        FROM hits JOIN items ON items.id = item_id JOIN said ON said.id = doc_id
    ),
    brief AS (
        SELECT min(item_id) AS id, w FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark)
        WHERE len(w) BETWEEN {SHORT} AND {SPAN - 1} GROUP BY w
    ),
    found AS (
        SELECT DISTINCT said.id AS doc_id, brief.id AS item_id, len(brief.w) AS matched FROM brief JOIN said
        ON list_has_any(list_transform(range(1, len(said.w) - len(brief.w) + 2), lambda i: said.w[i : i + len(brief.w) - 1]), [brief.w])
        UNION ALL
        SELECT doc_id, item_id, len(e) AS matched FROM equal
        WHERE len(list_filter(range(1, len(e) + 1), lambda k:
            k >= ceil(least(n, {WINDOW}) * {MATCHES} / {WINDOW})
            AND e[k] - e[(k - ceil(least(n, {WINDOW}) * {MATCHES} / {WINDOW}) + 1)::BIGINT] < least(n, {WINDOW}))) > 0
    )
    SELECT documents.doc_id, count(found.doc_id) > 0 AS contaminated, min(item_id) AS item_id,
        count(DISTINCT item_id) AS n_items, coalesce(max(matched), 0) AS matched_words
    FROM documents LEFT JOIN found USING (doc_id) GROUP BY documents.doc_id""",
)
def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "benchmark")).drop("text")
