"""Line dedup by a deletion-neighbourhood join, in DataFrame functions alone.

A line is its sequence of words; two lines are near when one word put in, left out or
replaced turns one into the other. A near pair agrees after deleting one word at the same
place (or deleting it from the longer one), so every line emits its deletion variants as
hashed keys, equal keys meet, and the earliest line of a key stands for all others: any
two lines of a key are near, so no pairs are needed inside it. Each found line is then
verified against its earliest partner word by word.

Variants are emitted coarse to fine, so that a line costs a few keys and not one per
word. First a line leaves out either half; lines that share a half with another one leave
out each of ``PARTS`` parts; lines that share the rest then emit the single-word variants
of that part. Every step is complete: a near pair agrees outside the part that holds the
edit.

What stays: the earliest of equal lines and of near lines, by (doc_id, position); a line
with an earlier near line goes even if that one goes too. Near matches need
``MIN_WORDS`` words in the shorter line, so that one edit leaves four fifths; shorter
lines are compared for equality.

Defined cases. Lines are cut at ``\\n`` alone and compared by their words, so white space
does not count; blank lines stay. A null text stays null. A null doc_id comes first. The
same line at the same position of rows with one doc_id is one line, so a repeated row
stays as it is. Further columns are kept as they are. An empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACES, broadcast_if_small, query, table, text_hash
from tidegauge.session import staged

# The white space between words, as characters to trim.
_WHITE = " \t\n\x0b\x0c\r"
_BLACK = "[^\\x20\\x09-\\x0D]"

PARTS = 4
MIN_WORDS = 5

# A table of so many short fixed-width rows (some 30 MB) is sent to every executor; a
# longer one is joined by a shuffle.
BROADCAST_ROWS = 600_000

DOC = ["doc_id", "text_key"]


def words(line: Column) -> Column:
    """Words of a line that is not blank."""
    return F.split(spoken(line), " ")


def spoken(line: Column) -> Column:
    """The words of a line that is not blank, joined by one space; most lines are so already."""
    odd = [F.contains(line, F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c", "\r")]
    edges = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    plain = F.regexp_replace(F.trim(line, F.lit(_WHITE)), SPACES, " ")
    return F.when(reduce(or_, odd, edges), plain).otherwise(line)


def _half_keys() -> list[Column]:
    """Keys of either half, as the shorter (or equal) and as the longer line of a pair.

    The lines of a near pair agree on the half, measured on the shorter one, that does
    not hold the edit.
    """
    n, said, keys = F.col("n"), F.col("said"), []
    for extra in (0, 1):
        short = n - extra
        front = F.shiftright(short, 1)
        for side, count in enumerate((front, front - short)):
            half = F.call_function("substring_index", said, F.lit(" "), count)
            keys.append(F.when(short >= MIN_WORDS, F.xxhash64(short, F.lit(side), half)))
    return keys


def line_places(docs: DataFrame) -> DataFrame:
    """Every line that has words: its place, key, number of words and half keys.

    The blank test looks at the line and not at its words, and the outer explode adds no
    test: a filter on a computed column would compute it twice. Words are counted and halves
    cut in the joined text, which costs far less than an array of words for every line.
    """
    keyed = docs.select("doc_id", "text", text_hash().alias("text_key"))
    lines = keyed.select(*DOC, F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    said = lines.filter(F.rlike("line", F.lit(_BLACK))).select(*DOC, "pos", spoken(F.col("line")).alias("said"))
    gaps = F.octet_length("said") - F.octet_length(F.replace(F.col("said"), F.lit(" "), F.lit("")))
    sized = said.withColumn("n", gaps + 1)
    return sized.select(
        *DOC, "pos", "n", F.xxhash64("said").alias("line_key"), *(k.alias(f"half_{i}") for i, k in enumerate(_half_keys()))
    )


def _order() -> Column:
    """Place in the corpus as one number, which hash aggregation can hold."""
    return F.coalesce("doc_id", F.lit(-(1 << 63))).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")


def distinct_lines(places: DataFrame) -> DataFrame:
    """One row per distinct line: first place, number of words and its half keys."""
    halves = [F.min(f"half_{i}").alias(f"half_{i}") for i in range(4)]
    ordered = places.withColumn("place", _order())
    return ordered.groupBy("line_key", "n").agg(
        F.min("place").alias("place"), F.min_by("doc_id", "place").alias("doc_id"), F.min_by("pos", "place").alias("pos"), *halves
    )


def _shared(rows: DataFrame) -> DataFrame:
    """Keys that several rows have."""
    return rows.groupBy("key").count().filter("count > 1").select("key")


def near_links(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines with an earlier near line, by key, with the earliest one; verified."""
    emitted = lines.filter(F.col("n") > MIN_WORDS - 1).select(
        "line_key", F.explode_outer(F.array(*(f"half_{i}" for i in range(4)))).alias("key")
    ).filter(F.col("key").isNotNull())
    halves = staged(_shared(emitted), "half-keys")
    going = emitted.join(broadcast_if_small(halves, BROADCAST_ROWS), "key").select("line_key").distinct()
    # The words are read again for these lines alone, from their first place.
    wanted = staged(lines.join(going, "line_key").select("line_key", "doc_id", "pos", "place"), "line-candidates")
    found = staged(_with_words(docs, wanted), "line-words")
    slotted = found.select("line_key", "w", F.explode(F.array(*map(F.lit, range(2 * PARTS)))).alias("slot"))
    coarse = slotted.filter(_short() >= MIN_WORDS).select("line_key", "slot", _coarse_key().alias("key"))
    coarse = staged(coarse, "line-quarters")
    quarters = staged(_shared(coarse), "line-keys")
    slots = coarse.join(broadcast_if_small(quarters, BROADCAST_ROWS), "key").groupBy("line_key").agg(
        F.collect_list(F.struct("slot", "key")).alias("slots")
    )
    parted = found.join(slots, "line_key").select("line_key", "place", "w", F.explode_outer("slots").alias("s")).select(
        "line_key", "place", "w", "s.slot", F.col("s.key").alias("coarse")
    )
    regions = parted.select("line_key", "place", "coarse", _extra().alias("extra"), _region().alias("region"))
    counted = regions.select("*", F.explode_outer(_fine_numbers()).alias("number"))
    variants = staged(counted.select("line_key", "place", _fine_key().alias("key")), "line-variants")
    earliest = variants.groupBy("key").agg(
        F.min("place").alias("first"), F.min_by("line_key", "place").alias("earlier_key"), F.count("*").alias("c")
    ).filter("c > 1")
    linked = variants.join(earliest, "key").filter("first < place")
    pairs = linked.groupBy("line_key").agg(F.min_by("earlier_key", "first").alias("earlier_key"))
    said = found.select("line_key", "w")
    both = pairs.join(said, "line_key").join(
        said.select(F.col("line_key").alias("earlier_key"), F.col("w").alias("v")), "earlier_key"
    )
    return both.filter(within_one(F.col("w"), F.col("v"))).select("line_key", "earlier_key")


def _with_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Candidate lines with their words; the documents are exchanged only if there are many."""
    w = wanted.select(F.col("doc_id").alias("_d"), "pos", "place", "line_key")
    met = docs.select("doc_id", "text").join(broadcast_if_small(w, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("_d")))
    # The explode keeps the split from being repeated wherever the line is used.
    line = F.explode_outer(F.array(F.get(F.split("text", "\n"), F.col("pos")))).alias("line")
    said = met.select("line_key", "place", line).select("line_key", "place", words(F.col("line")).alias("w")).filter(F.xxhash64(F.array_join("w", " ")) == F.col("line_key"))
    return said.dropDuplicates(["line_key"])


def _bounds(short: Column, part: int | Column) -> tuple[Column, Column]:
    """Where a part of a line of ``short`` words begins and ends."""
    return F.floor(short * part / PARTS).cast("int"), F.floor(short * (part + 1) / PARTS).cast("int")


def _extra() -> Column:
    """A slot is a part, of the line as the shorter (or equal) or (1) as the longer one of a pair."""
    return F.when(F.col("slot") < PARTS, 0).otherwise(1)


def _short() -> Column:
    return F.size("w") - _extra()


def _coarse_key() -> Column:
    """Key of the line without the part of its slot.

    One expression for all slots: eight of them make a method that Java does not compile.
    """
    w, extra, short = F.col("w"), _extra(), _short()
    part = F.pmod("slot", F.lit(PARTS))
    start, end = _bounds(short, part)
    rest = F.concat(F.slice(w, F.lit(1), start), F.slice(w, end + extra + 1, F.size(w) - end - extra))
    return F.xxhash64(short, part, rest)


def _region() -> Column:
    """The words of the part that a coarse key left out."""
    extra = _extra()
    start, end = _bounds(_short(), F.pmod("slot", F.lit(PARTS)))
    return F.slice("w", start + 1, end - start + extra)


def _fine_numbers() -> Column:
    """Numbers of a part's variants: its words left out one by one, then, in the shorter (or
    equal) line of a pair, the places where a word may be missing. A part has a word at least.
    """
    size = F.size("region")
    return F.sequence(F.lit(0), F.when(F.col("extra") == 0, 2 * size).otherwise(size - 1))


def _fine_key() -> Column:
    """Key of one variant of a part; the coarse key stands for the rest of the line.

    It holds the number of words of the part that remain, so that a line with a word left
    out meets others of its length, and the shorter line as a whole.
    """
    region, number, size = F.col("region"), F.col("number"), F.size("region")
    without = F.concat(F.slice(region, F.lit(1), number), F.slice(region, number + 2, size))
    dropped = F.xxhash64("coarse", size - 1, number, without)
    return F.when(number < size, dropped).otherwise(F.xxhash64("coarse", size, number - size, region))


def within_one(a: Column, b: Column) -> Column:
    """Whether one word put in, left out or replaced turns ``a`` into ``b``."""
    longer = F.when(F.size(a) >= F.size(b), a).otherwise(b)
    shorter = F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differs = F.zip_with(shorter, F.slice(longer, F.lit(1), F.size(shorter)), lambda x, y: x != y)
    at = F.array_position(differs, True).cast("int")  # 1-based, 0 if none
    rest = F.size(longer) - at
    tail = F.slice(longer, at + 1, rest)
    return (
        F.when(at == 0, F.size(longer) - F.size(shorter) <= 1)
        .when(F.size(a) == F.size(b), tail == F.slice(shorter, at + 1, rest))
        .when(F.size(longer) - F.size(shorter) == 1, tail == F.slice(shorter, at, rest))
        .otherwise(False)
    )


def dropped_lines(docs: DataFrame) -> DataFrame:
    """Per document the positions of lines that go: ``doc_id, text_key, gone, n_near, n_exact``."""
    places = staged(line_places(docs), "line-places")
    lines = staged(distinct_lines(places), "lines")
    near = near_links(docs, lines).select("line_key", F.lit(True).alias("near"))
    fate = lines.select("line_key", F.col("doc_id").alias("first_doc"), F.col("pos").alias("first_pos")).join(near, "line_key", "left")
    judged = places.select("line_key", *DOC, "pos").join(fate, "line_key").withColumns({
        "near": F.coalesce("near", F.lit(False)),
        "later": ~(F.col("first_doc").eqNullSafe(F.col("doc_id")) & (F.col("first_pos") == F.col("pos"))),
    })
    return judged.filter("near or later").groupBy(*DOC).agg(
        F.collect_set("pos").alias("gone"),
        F.count_if(F.col("near")).alias("n_near"),
        F.count_if(~F.col("near")).alias("n_exact"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the shortened text and ``n_near``, ``n_exact`` lines taken out of it."""
    gone = dropped_lines(docs)
    kept = [F.col(f"d.{c}") for c in docs.columns if c not in ("text", "n_near", "n_exact")]
    keyed = docs.withColumn("_key", text_hash()).alias("d")
    met = keyed.join(
        gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d._key") == F.col("g.text_key")), "left"
    )
    lines = F.split(F.col("d.text"), "\n")

    def kept_lines(said: Column) -> Column:
        stay = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(said) - 1), F.col("g.gone")))
        return F.array_join(F.transform(stay, lambda i: said[i]), "\n")

    # As the element of an array, the split text gets a name in the function and is not split
    # again for every line.
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(F.transform(F.array(lines), kept_lines)[0])
    zero = F.lit(0).cast("bigint")
    return met.select(
        *kept, text.alias("text"), F.coalesce("g.n_near", zero).alias("n_near"), F.coalesce("g.n_exact", zero).alias("n_exact")
    )


_WORD_LIST = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@query(
    "op6_line_dedup",
    f"""
    WITH lines AS (
        SELECT doc_id, text, pos - 1 AS pos, line, {_WORD_LIST.format('line')} AS w
        FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
    ), spoken AS (SELECT * FROM lines WHERE len(w) > 0),
    firsts AS (SELECT w, min({{'d': doc_id, 'p': pos}}) AS place FROM spoken GROUP BY w),
    long AS (SELECT w, place, len(w) AS n, array_to_string(w, ' ') AS said FROM firsts WHERE len(w) >= {MIN_WORDS}),
    variants AS (
        SELECT w, place, n, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS v
        FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM long)
    ), same AS (SELECT n, i, v, min(place) AS earliest FROM variants GROUP BY n, i, v HAVING count(*) > 1),
    linked AS (
        SELECT variants.w FROM variants JOIN same USING (n, i, v) WHERE earliest < place
        UNION ALL
        SELECT CASE WHEN variants.place < long.place THEN long.w ELSE variants.w END
        FROM variants JOIN long ON variants.v = long.said
    ), near AS (SELECT DISTINCT w FROM linked),
    fate AS (
        SELECT spoken.doc_id, spoken.pos, near.w IS NOT NULL AS near,
               near.w IS NOT NULL OR firsts.place <> {{'d': spoken.doc_id, 'p': spoken.pos}} AS gone
        FROM spoken JOIN firsts USING (w) LEFT JOIN near USING (w)
    )
    SELECT lines.doc_id, count(*) AS n_lines,
        count(*) FILTER (coalesce(near, false)) AS n_near,
        count(*) FILTER (coalesce(gone AND NOT near, false)) AS n_exact,
        md5(coalesce(string_agg(line, chr(10) ORDER BY lines.pos) FILTER (NOT coalesce(gone, false)), '')) AS text_md5
    FROM lines LEFT JOIN fate USING (doc_id, pos) GROUP BY lines.doc_id
    UNION ALL SELECT doc_id, 0, 0, 0, md5('') FROM documents WHERE text IS NULL""",
)
def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint"))
    done = dedup_lines(counted)
    return done.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), "n_near", "n_exact", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
