"""MinHash near-dedup with odd sketches.

Every document's set of word shingles gives ``BANDS * ROWS`` MinHash samples. Samples of a
band make its bucket key, and all samples together are folded into an odd sketch: a bitmap
in which each sample flips one bit, so that the population count of the XOR of two
sketches tells how many samples differ, most precisely where few do. Documents that share
a bucket are candidates; in buckets of more than two, candidates whose sketches are clearly
below the threshold wait for step 3, and the rest is confirmed on the full sets. Links make
components.

Large groups of copies never become all pairs:

1. Documents with equal sets are one node from the start.
2. In every bucket all members are compared with one centre; the links found give labels.
3. In buckets that still hold several labels, the members outside the largest label are
   compared with all the others inside blocks of bounded size, which give out one link per
   pair of labels. So every pair of a bucket is linked, compared, or joined already.

A pair at similarity ``s`` shares no bucket with probability ``(1 - s**ROWS)**BANDS``:
3e-5 at 0.8, less above. Sketches add nothing to that.

Defined cases. Words are runs between white space, A-Z lower-cased. A text with fewer
words than a shingle is one shingle; one without words, or null, has an empty set and is
linked with nothing. Rows that repeat id and text are one document. A null doc_id is
linked like any other and leads a group only if all ids in it are null. Further columns
are ignored or kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import texts
from tidegauge.llm.common import broadcast_if_small, query, rows_of, table, text_hash
from tidegauge.llm.components import components
from tidegauge.session import spread, staged

BANDS = 20
ROWS = 4
SKETCH_BITS = 512

# Sketches estimate a similarity to about 0.05; a pair with the centre of a bucket of more
# than two waits for the comparison in blocks if its estimate is this far below the threshold.
MARGIN = 0.2

# Shingles in one block of a bucket (some 16 MB); a larger bucket is cut into blocks.
BLOCK_SHINGLES = 2_000_000

# So many fixed-width rows (some 20 MB) are sent to every executor.
BROADCAST_ROWS = 500_000

DOC = ["doc_id", "text_key"]
_SIGNATURE = "doc_id bigint, text_key bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch array<bigint>"


def _samples() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(8))
    k = BANDS * ROWS
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def _minhashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Smallest value of every non-empty set under each hash function: (samples, sets)."""
    factor, offset = _samples()
    out = np.empty((len(factor), len(first)), np.uint64)
    for k in range(len(factor)):
        out[k] = np.minimum.reduceat((values ^ offset[k]) * factor[k], first)
    return out


def _band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.empty((BANDS, samples.shape[1]), np.uint64)
    for band in range(BANDS):
        key = np.full(samples.shape[1], np.uint64(band + 1))
        for row in samples[band * ROWS : (band + 1) * ROWS]:
            key = texts.mix(key * np.uint64(31) + row)
        keys[band] = key
    return keys


def _odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: sample ``k`` flips the bit that its value hashes to."""
    number, sets = samples.shape
    salt = texts.mix(np.arange(1, number + 1, dtype=np.uint64))[:, None]
    place = (texts.mix(samples ^ salt) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = (np.arange(sets)[None, :] * SKETCH_BITS + place).ravel()
    bits = np.bincount(flat, minlength=sets * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(bits.reshape(sets, SKETCH_BITS), axis=1).view(np.int64)


def _lists(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Size and hash of every document's shingle set, its band keys and its odd sketch."""

    def run(batches):
        for batch in batches:
            said = texts.column(batch, "text")
            value, owner = texts.shingles(texts.words_of(said, lower=True), shingle)
            sets, first = texts.distinct_sets(value, owner, len(said))
            size = np.diff(first)
            full = np.flatnonzero(size)
            keys = np.zeros((len(said), 2), np.int64)
            bands = np.zeros((len(said), BANDS), np.int64)
            sketch = np.zeros((len(said), SKETCH_BITS // 64), np.int64)
            if len(full):
                at = first[full]
                keys[full, 0] = np.add.reduceat(sets, at).view(np.int64)
                keys[full, 1] = np.bitwise_xor.reduceat(texts.mix(sets), at).view(np.int64)
                samples = _minhashes(sets, at)
                bands[full] = np.ascontiguousarray(_band_keys(samples).T).view(np.int64)
                sketch[full] = _odd_sketches(samples)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(size.astype(np.int64)),
                    pa.array(keys[:, 0]),
                    pa.array(keys[:, 1]),
                    _lists(bands),
                    _lists(sketch),
                ],
                names=[c.split()[0] for c in _SIGNATURE.split(", ")],
            )

    return docs.select("doc_id", text_hash().alias("text_key"), "text").mapInArrow(run, _SIGNATURE)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``node`` and its sorted distinct shingles as packed 64-bit values."""

    def run(batches):
        for batch in batches:
            said = texts.column(batch, "text")
            value, owner = texts.shingles(texts.words_of(said, lower=True), shingle)
            sets, first = texts.distinct_sets(value, owner, len(said))
            packed = [sets[first[i] : first[i + 1]].tobytes() for i in range(len(said))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, shingles binary")


def _estimate_allows(a: str, b: str, percent: int) -> Column:
    """Whether the sketches leave the pair a chance of the threshold.

    Of ``k`` samples, ``d`` differing ones flip ``2 * d`` random bits; a population count
    at or above the expected one at ``threshold - MARGIN`` rules the pair out.
    """
    samples = BANDS * ROWS
    least = percent / 100 - MARGIN
    most = SKETCH_BITS / 2 * (1 - math.exp(-4 * samples * (1 - least) / SKETCH_BITS))
    differ = sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return differ <= F.lit(most)


def _similar(inter, size_a, size_b, percent: int):
    return 100 * inter >= percent * (size_a + size_b - inter)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``u, v`` whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v"
    )

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a"), batch.column("b")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                inter = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(_similar(inter, len(a), len(b), percent))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _size_allows(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _bucket_members(nodes: DataFrame, percent: int) -> DataFrame:
    """Members of buckets that hold several nodes: bucket, its size and centre, node.

    A set that can be similar to no other size than its own, 4 at 0.8, takes no part.
    """
    able = nodes.filter(F.col("n_shingles") * 100 >= percent * (F.col("n_shingles") + 1))
    member = able.select("node", "n_shingles", F.explode_outer("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("centre")).filter("members > 1")
    return staged(member.join(shared, "bucket"), "bucket-members")


def _star_links(member: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between members of a bucket and its centre."""
    pairs = member.filter("node <> centre").groupBy(F.col("centre").alias("u"), F.col("node").alias("v")).agg(
        F.min("members").alias("members")
    )
    facts = nodes.select("node", "n_shingles", "sketch")
    told = pairs.join(facts.toDF("u", "n_u", "sketch_u"), "u").join(facts.toDF("v", "n_v", "sketch_v"), "v")
    # What a sketch rules out is compared again in a larger bucket, but not in one of two.
    told = told.filter(
        _size_allows("n_u", "n_v", percent) & ((F.col("members") == 2) | _estimate_allows("sketch_u", "sketch_v", percent))
    )
    return _confirm(told.select("u", "v"), sets, percent)


def _rest_links(member: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets that hold several labels, by exact comparison in blocks."""
    told = member.filter("members > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = told.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    mixed = by_label.groupBy("bucket").agg(
        F.max_by("label", F.struct("c", "label")).alias("main"),
        F.sum("s").alias("s"),
        (F.sum("s") - F.max_by("s", F.struct("c", "label"))).alias("rest"),
        F.count("*").alias("labels"),
    ).filter("labels > 1")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_SHINGLES).cast("int")
    cut = told.select("bucket", "node", "label").join(
        mixed.select("bucket", "main", blocks("s").alias("n_all"), blocks("rest").alias("n_rest")), "bucket"
    )
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode_outer(F.sequence(F.lit(0), F.col(n) - 1))
    seen = cut.select("bucket", "node", "label", own("n_all").alias("x"), every("n_rest").alias("y"), F.lit(False).alias("asks"))
    asks = cut.filter("label <> main").select(
        "bucket", "node", "label", every("n_all").alias("x"), own("n_rest").alias("y"), F.lit(True).alias("asks")
    )
    cells = seen.union(asks).join(sets, "node")
    cells = spread(cells, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "asks", "node")

    def run(batches):
        found = _compare_cells(rows_of(batches), percent)
        while held := [pair for _, pair in zip(range(4096), found)]:
            yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in held], pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return cells.select("bucket", "x", "y", "asks", "node", "label", "shingles").mapInArrow(run, "u bigint, v bigint").distinct()


def _compare_cells(rows: Iterator[dict], percent: int) -> Iterator[tuple[int, int]]:
    for _, cell in groupby(rows, key=lambda r: (r["bucket"], r["x"], r["y"])):
        yield from _compare_cell(list(cell), percent)


def _compare_cell(cell: list[dict], percent: int) -> Iterator[tuple[int, int]]:
    """One link per pair of labels between the asking members and the others of a block."""
    seen = [r for r in cell if not r["asks"]]
    if not seen or len(seen) == len(cell):
        return
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in seen]
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, holder = values[order], np.repeat(np.arange(len(seen)), size)[order]
    parent: dict[int, int] = {}

    def top(label: int) -> int:
        while label in parent:
            label = parent[label]
        return label

    for asking in cell:
        if not asking["asks"]:
            continue
        own = np.frombuffer(asking["shingles"], np.uint64)
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        lengths = high - low
        places = np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        inter = np.bincount(holder[places], minlength=len(seen))
        for i in np.flatnonzero(_similar(inter, len(own), size, percent)):
            a, b = top(asking["label"]), top(seen[i]["label"])
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield min(asking["node"], seen[i]["node"]), max(asking["node"], seen[i]["node"])


def near_groups(docs: DataFrame, shingle: int, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_shingles, component_id and whether it leads.

    The leading document of a component has the smallest doc_id (then text_key).
    """
    rows = staged(signatures(docs, shingle), "signatures")
    key = ["set_a", "set_b", "n_shingles"]
    lead = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    groups = rows.filter("n_shingles > 0").groupBy(*key).agg(F.min(lead).alias("lead"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = staged(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
    member = _bucket_members(nodes, percent)
    wanted = member.select("node").distinct().join(nodes.select("node", "lead"), "node").select(
        "node", F.col("lead.doc_id").alias("_d"), F.col("lead.text_key").alias("_t")
    )
    wanted = broadcast_if_small(staged(wanted, "wanted"), BROADCAST_ROWS)
    said = docs.select("doc_id", text_hash().alias("_k"), "text").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_t"))
    )
    sets = staged(shingle_sets(said, shingle).dropDuplicates(["node"]) if _repeats(rows) else shingle_sets(said, shingle), "sets")
    links = staged(_star_links(member, nodes, sets, percent), "links")
    labels = components(links)
    more = staged(_rest_links(member, labels, nodes, sets, percent), "more-links")
    if more.limit(1).count():
        labels = components(links.union(more))
    led = nodes.join(labels, "node", "left").select(*key, "lead", F.coalesce("label", "node").alias("label"))
    leads = led.groupBy("label").agg(F.min("lead").alias("first"))
    named = led.join(leads, "label").select(*key, "first")
    met = rows.select(*DOC, *key).join(named, key, "left")
    alone = F.col("first").isNull()
    return met.select(
        *DOC,
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key")))).alias("leads"),
    )


def _repeats(rows: DataFrame) -> bool:
    """Whether some document is there in several rows."""
    return rows.groupBy(*DOC).count().filter("count > 1").limit(1).count() > 0


def dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near copies."""
    groups = staged(near_groups(docs, shingle, percent), "groups")
    gone = groups.filter("not leads").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).distinct()
    own = F.struct(*(F.col(c) for c in docs.columns)).alias("_own")
    keyed = docs.select(own, F.col("doc_id").alias("_i"), text_hash().alias("_k"))
    kept = keyed.join(
        broadcast_if_small(gone, BROADCAST_ROWS), F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_t")), "left_anti"
    )
    if _repeats(groups):
        kept = kept.dropDuplicates(["_i", "_k"])
    return kept.select("_own.*")


@query(
    "op8_near_dedup",
    """
    WITH RECURSIVE said AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ), shingled AS (
        SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 2
            THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS s FROM said
    ), sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i
        FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
    ), linked AS (
        SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)
    ), edges AS (SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked),
    reached(d, r) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT reached.d, edges.v FROM reached JOIN edges ON edges.u = reached.r
    ), grouped AS (SELECT d AS doc_id, min(r) AS component_id FROM reached GROUP BY d)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM grouped LEFT JOIN sizes USING (doc_id)""",
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"), shingle=2)
    return groups.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
