"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: the sources share a budget of words by weight; a target stops at ``MAX_PASSES``
times its source, and what is over is shared again by weight until none is above.

A source is permuted by a hash of its documents and cut, along that order, into blocks of
some ``BLOCK_WORDS`` words. Its target is a number of whole passes over all blocks and
one pass over the first ones; in the block where the target falls the documents are taken
in order, the last one cut at the word that meets it. These blocks are the source's exact
quota. A tree then deals the quotas to output shards: a node splits its shards into two
halves and draws, multivariate-hypergeometrically, how many blocks of each source the left
half gets, so the quotas are met exactly and every shard is a random mixture. Shards take
disjoint stretches of each source's permuted blocks, and shuffle their rows by hash.

Only sums per source and per block meet in one place. Running sums inside a source go
over blocks; over documents they run inside single blocks.

Defined cases. Size is the number of words, 0 for null and blank texts, which are never
taken. Sources stand in code point order, null last, and weigh ``WEIGHTS`` in turn.
Repeated rows are documents of their own; rows with equal ids are ordered by their text.
Reruns agree, on any partitioning. Further columns are kept. An empty table gives an empty mix.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACES, broadcast_if_small, query, table, text_hash
from tidegauge.session import staged

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_PASSES = 2
BLOCK_WORDS = 65_536
SHARD_WORDS = 4_000_000
SEED = 20_261

# So many copies (seven numbers each, some 30 MB) are sent to every executor to meet the
# texts there; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_WHITE = " \t\n\x0b\x0c\r"


def n_words(text: str) -> Column:
    trimmed = F.trim(text, F.lit(_WHITE))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("bigint")


def _hash60(value: Column) -> Column:
    """The first 60 bits of an MD5, as a number."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _id_text() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def sized(docs: DataFrame) -> DataFrame:
    """Rows with their size and place in the permutation, written once."""
    rows = docs.select("doc_id", text_hash().alias("text_key"), "source", n_words("text").alias("size"))
    return staged(rows.withColumns({"u": _hash60(_id_text()), "row": F.monotonically_increasing_id()}), "sized")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """One row per source: ``s`` (its rank), source, source_size, target.

    Sources that reach their limit are those of smallest limit per weight, so one pass in
    that order finds the level at which the others share the rest.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("s", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    turn = F.array(*(F.lit(w) for w in weights))
    ranked = ranked.withColumn("weight", F.get(turn, F.pmod("s", F.lit(len(weights)))))
    limited = ranked.withColumn("limit", F.col("source_size") * MAX_PASSES)
    order = Window.orderBy(F.col("limit") / F.col("weight"), "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total * budget - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(onward)
    levels = limited.withColumn("level", level)
    free = F.when(F.col("weight") * F.col("level") <= F.col("limit"), F.struct("s", "level"))
    first = F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = levels.withColumn("free", first)
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("weight") * F.col("free.level"), F.col("limit")))
    return met.select("s", "source", "source_size", target.cast("double").alias("target"))


def quotas(rows: DataFrame, goals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their block and the words that each pass takes; blocks with their words."""
    size, target = F.col("source_size"), F.col("target")
    passes = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("int")
    goals = goals.withColumns({"passes": passes, "n_blocks": F.greatest(F.ceil(size / BLOCK_WORDS), F.lit(1)).cast("bigint")})
    goals = goals.withColumn("rest", F.floor(target - F.col("passes") * size + 0.5).cast("bigint"))
    goals = staged(goals, "goals")
    met = rows.alias("r").join(goals.withColumnRenamed("source", "_source").alias("g"), F.col("r.source").eqNullSafe(F.col("_source")))
    block = F.shiftright(F.shiftright("u", 30) * F.col("n_blocks"), 30)
    dealt = met.withColumn("block", block).drop("_source")
    blocks = dealt.groupBy("s", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    earlier = Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("left", F.col("rest") - F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    blocks = staged(blocks, "blocks")
    # The one block of a source in which the last pass ends.
    ends = blocks.filter("left > 0 AND left < words").select("s", "block", F.col("left").alias("quota"))
    last = dealt.join(F.broadcast(ends), ["s", "block"])
    run = Window.partitionBy("s", "block").orderBy("u", F.asc_nulls_first("doc_id"), "text_key", "row")
    last = last.withColumn("upto", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = last.select("row", F.greatest(F.least("size", F.col("quota") - F.col("upto") + F.col("size")), F.lit(0)).alias("cut"))
    judged = dealt.join(blocks.select("s", "block", "left", "words"), ["s", "block"]).join(cut, "row", "left")
    partial = F.when(F.col("cut").isNotNull(), F.col("cut")).when(F.col("left") >= F.col("words"), F.col("size")).otherwise(F.lit(0))
    return judged.withColumn("partial", partial), blocks


def shard_quotas(blocks: DataFrame, shards: int) -> DataFrame:
    """``shard, s, units``: the splitting tree, one level of nodes at a time."""
    extra = F.when(F.col("left") > 0, 1).otherwise(0)
    counts = blocks.filter("words > 0").groupBy("s").agg(F.sum(F.col("passes") + extra).alias("units")).filter("units > 0")
    level = counts.select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "s", "units")

    def split(node: pd.DataFrame) -> pd.DataFrame:
        low, high = int(node["low"].iloc[0]), int(node["high"].iloc[0])
        if high - low < 2:
            return node
        node = node.sort_values("s")
        middle = (low + high) // 2
        units = node["units"].to_numpy(np.int64)
        taken = units.sum() * (middle - low) // (high - low)
        rng = np.random.Generator(np.random.PCG64([SEED, low, high]))
        left = rng.multivariate_hypergeometric(units, taken, method="marginals") if taken else units * 0
        halves = [node.assign(high=middle, units=left), node.assign(low=middle, units=units - left)]
        out = pd.concat(halves)
        return out[out["units"] > 0]

    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        level = level.groupBy("low", "high").applyInPandas(split, "low int, high int, s int, units bigint")
    return level.select(F.col("low").alias("shard"), "s", "units")


def _shards_of_units(blocks: DataFrame, shards: int) -> DataFrame:
    """``s, block, pass, shard``: disjoint stretches of every source's permuted blocks."""
    full = F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array())
    all_passes = F.when(F.col("left") > 0, F.concat(full, F.array("passes"))).otherwise(full)
    units = blocks.filter("words > 0").select("s", "block", F.explode_outer(all_passes).alias("pass")).filter("pass IS NOT NULL")
    name = F.concat_ws(":", F.lit(SEED), "s", "pass", "block")
    place = F.row_number().over(Window.partitionBy("s").orderBy(_hash60(name), "pass", "block"))
    units = units.withColumn("place", place)
    quota = staged(shard_quotas(blocks, shards), "shard-quotas")
    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("units").over(before), F.lit(0))
    ranges = quota.withColumn("start", start).select(
        "s", "shard", F.explode_outer(F.sequence(F.col("start") + 1, F.col("start") + F.col("units"))).alias("place")
    )
    return units.withColumn("place", F.col("place").cast("bigint")).join(ranges, ["s", "place"]).select("s", "block", "pass", "shard")


def mix_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET) -> tuple[DataFrame, DataFrame]:
    """All rows with size and target, and the mix: row, pass, words taken, shard, order."""
    rows = sized(docs)
    judged, blocks = quotas(rows, targets(rows, weights, budget))
    judged = staged(judged, "judged")
    planned = judged.agg(F.sum(F.col("passes") * F.col("size") + F.col("partial")).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(planned / SHARD_WORDS))
    full = F.when(F.col("passes") > 0, F.array_repeat(F.col("size"), F.col("passes"))).otherwise(F.array().cast("array<bigint>"))
    copies = judged.select("row", "doc_id", "text_key", "size", "s", "block", F.posexplode_outer(F.concat(full, F.array("partial"))).alias("pass", "words"))
    dealt = copies.filter("words > 0").join(_shards_of_units(blocks, shards), ["s", "block", "pass"])
    order = _hash60(F.concat_ws(":", F.lit(SEED), _id_text(), "pass"))
    mixed = dealt.select("row", "doc_id", "text_key", "size", "pass", "words", "shard", order.alias("shard_order"))
    return judged.select("row", "doc_id", "text_key", "source", "size", "source_size", "target"), mixed


def _first_words(text: str, words: int) -> str:
    end = 0
    for _, found in zip(range(words), re.finditer(r"[^\x20\x09-\x0D]+", text)):
        end = found.end()
    return text[:end]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """The mixture: columns of ``docs`` and ``pass, words, shard, shard_order``.

    Rows are dealt by shard and shuffled inside it; a text is whole but for the one of each
    source at which the target is met. Rows that repeat id and text give equal copies.
    """
    rows, mixed = mix_rows(docs, weights, budget)
    new = ["pass", "words", "shard", "shard_order"]
    own = [c for c in docs.columns if c not in new]
    # The documents' columns travel in a struct, so that none of their names meets one of ours.
    keyed = docs.select("doc_id", text_hash().alias("text_key"), F.struct(*own).alias("own"))
    if rows.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["doc_id", "text_key"])

    @F.pandas_udf("string")
    def cut(text: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([_first_words(t, w) for t, w in zip(text, words)])

    taken = staged(mixed.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "size", *new), "copies")

    def with_texts(copies: DataFrame) -> DataFrame:
        copies = broadcast_if_small(copies, BROADCAST_ROWS)
        return keyed.join(copies, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))

    whole = with_texts(taken.filter("words = size")).select("own.*", *new)
    short = with_texts(taken.filter("words < size"))
    short = short.withColumn("own", F.col("own").withField("text", cut("own.text", "words"))).select("own.*", *new)
    return whole.union(short).repartition("shard").sortWithinPartitions("shard", "shard_order", "doc_id", "pass")


@query(
    "op7_mixing",
    """
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
            ('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT AS u
        FROM documents
    ), sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM sums),
    weighed AS (SELECT *, CASE s % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM ranked),
    levels AS (
        SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, s
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY cap / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
        FROM weighed
    ), free AS (SELECT arg_min(level, cap / weight) AS level FROM levels WHERE weight * level <= cap),
    goals AS (
        SELECT source, source_size, least(cap::DOUBLE, weight * free.level) AS target FROM levels, free
    ), quota AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM goals
    ), running AS (
        SELECT doc_id, size, source_size, target, passes, floor(target - passes * source_size + 0.5)::BIGINT AS rest,
            sum(size) OVER (PARTITION BY sized.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
        FROM sized JOIN quota ON sized.source IS NOT DISTINCT FROM quota.source
    )
    SELECT doc_id, size, source_size, target,
        (passes * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
    FROM running""",
)
def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mixed = mix_rows(table(spark, sf_dir, "documents"))
    taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )
