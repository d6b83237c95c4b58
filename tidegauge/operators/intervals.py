"""Which of many overlapping intervals holds at a time: a sweep over sorted borders.

Intervals ``[start, end]`` on a microsecond axis become disjoint pieces, each with the interval
of greatest ``list_pos`` that covers it. The axis is cut where borders are dense. An interval
inside one cut goes to it as it is; a longer one leaves its head in its first cut, its tail
in its last, and covers those between through a binary tree of cuts, of which only the
winner of each node is kept. So a cut holds few rows, however many intervals run across
it, and is swept with a heap by one task. Rows then find their piece by time: against
few pieces by a broadcast join on ranges of some borders each, otherwise by the last
piece that begins before them, in one sort of the rows and pieces of a cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import staged

BORDERS = 50_000  # of intervals in one cut
ROWS = 500_000  # of the labelled table in one cut
BROADCAST_PIECES = 50_000  # pieces of five numbers, some 2 MB
RANGE = 32  # borders that a row of the broadcast join looks at
FAR = 1 << 62

# The winner of two intervals; the order of the fields decides.
ORDER = ("list_pos", "start", "end", "attack_id")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _cuts(points: DataFrame, column: str, count: int, size: int) -> list[float]:
    """Border times between parts of some ``size`` rows; they place rows and decide nothing."""
    parts = count // size
    if not parts:
        return []
    shares = [(i + 1) / (parts + 1) for i in range(parts)]
    return sorted(set(points.approxQuantile(column, shares, 0.2 / (parts + 1))))


def _placed(df: DataFrame, at: str, cuts: list[float], out: str) -> DataFrame:
    """``out``: number of the cut that a time is in."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    near = df.withColumn("_at", F.col(at).cast("double"))
    splits = [-float("inf"), *cuts, float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_at", outputCol="_in", handleInvalid="keep").transform(near)
    return placed.withColumn(out, F.col("_in").cast("int")).drop("_at", "_in")


def _nodes(first: Column, last: Column, levels: int) -> Column:
    """Nodes ``(level, place)`` of the binary tree of cuts that make up ``[first, last]``."""
    level = F.sequence(F.lit(0), F.lit(levels))

    def ends(k: Column) -> Column:
        # At every level the cuts not yet covered begin and end at multiples of its width.
        low = F.ceil(first / F.pow(F.lit(2.0), k)).cast("long")
        high = F.floor((last + 1) / F.pow(F.lit(2.0), k)).cast("long")  # one behind
        left = F.when((low < high) & (low % 2 == 1), low)
        right = F.when((low < high) & (high % 2 == 1) & ~((low % 2 == 1) & (high - 1 == low)), high - 1)
        return F.array(*(F.when(p.isNotNull(), F.struct(k.cast("int").alias("level"), p.alias("place"))) for p in (left, right)))

    return F.filter(F.flatten(F.transform(level, ends)), lambda n: n.isNotNull())


def _sweep(begin: np.ndarray, end: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Disjoint ``(begin, end, rank)`` of the greatest rank over half-open intervals."""
    order = np.argsort(begin, kind="stable")
    times = np.unique(np.concatenate([begin, end])).tolist()
    heap: list[tuple[int, int]] = []
    waiting, held = 0, None
    starts = begin[order].tolist()
    for i, at in enumerate(times):
        while waiting < len(order) and starts[waiting] == at:
            k = order[waiting]
            heapq.heappush(heap, (-int(rank[k]), int(end[k])))
            waiting += 1
        while heap and heap[0][1] <= at:
            heapq.heappop(heap)
        if held is not None and (not heap or -heap[0][0] != held[2]):
            yield held[0], at, held[2]
            held = None
        if heap and held is None:
            held = (at, None, -heap[0][0])
    if held is not None:
        yield held[0], times[-1], held[2]


def disjoint_pieces(intervals: DataFrame, key: Sequence[str], cuts: list[float]) -> DataFrame:
    """``*key, cut, a, b, attack_id``: half-open pieces ``[a, b)`` in microseconds, per cut.

    Intervals with a null border or an end before the start hold nowhere. At equal list
    positions the later start, then end, then the greater id wins.
    """
    key = list(key)
    known = intervals.select(
        *key, F.struct("list_pos", _micros(F.col("start")).alias("start"), _micros(F.col("end")).alias("end"), "attack_id").alias("w")
    ).filter("w.start <= w.end").select(*key, F.col("w.start").alias("a"), (F.col("w.end") + 1).alias("b"), "w")
    known = _placed(_placed(known, "a", cuts, "c1").withColumn("_z", F.col("b") - 1), "_z", cuts, "c2").drop("_z")
    best = F.max("w").alias("w")
    inside = known.filter("c1 = c2").groupBy(*key, F.col("c1").alias("cut"), "a", "b").agg(best)
    over = known.filter("c1 < c2")
    far = F.lit(FAR)
    heads = over.groupBy(*key, F.col("c1").alias("cut"), "a").agg(best).withColumn("b", far)
    tails = over.groupBy(*key, F.col("c2").alias("cut"), "b").agg(best).withColumn("a", -far)
    levels = max(1, len(cuts)).bit_length()
    nodes = over.filter("c2 > c1 + 1").select(*key, F.explode(_nodes(F.col("c1") + 1, F.col("c2") - 1, levels)).alias("n"), "w")
    nodes = nodes.groupBy(*key, "n.level", "n.place").agg(best)
    # Every cut below a node is under it: as many as the node is wide, and nodes are few.
    under = F.sequence(F.col("place") * F.pow(F.lit(2.0), F.col("level")).cast("long"), ((F.col("place") + 1) * F.pow(F.lit(2.0), F.col("level"))).cast("long") - 1)
    across = nodes.select(*key, F.explode(under.cast("array<int>")).alias("cut"), "w").groupBy(*key, "cut").agg(best)
    across = across.withColumns({"a": -far, "b": far})
    columns = [*key, "cut", "a", "b", "w"]
    rows = inside.select(*columns).unionByName(heads.select(*columns)).unionByName(tails.select(*columns)).unionByName(across.select(*columns))
    rows = rows.select(*key, "cut", "a", "b", *(F.col(f"w.{c}").alias(f"_{c}") for c in ORDER))
    kind = intervals.schema["attack_id"].dataType
    schema = T.StructType(
        [intervals.schema[k] for k in key]
        + [T.StructField("cut", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("attack_id", kind)]
    )

    def sweep(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([f"_{c}" for c in ORDER], kind="stable").reset_index(drop=True)
        pieces = list(_sweep(part["a"].to_numpy(np.int64), part["b"].to_numpy(np.int64), np.arange(len(part))))
        a, b, at = zip(*pieces)
        out = {k: [part[k].iloc[0]] * len(a) for k in key}
        ids = part["_attack_id"].iloc[list(at)].reset_index(drop=True)
        return pd.DataFrame({**out, "cut": part["cut"].iloc[0], "a": a, "b": b, "attack_id": ids})

    return rows.groupBy(*key, "cut").applyInPandas(sweep, schema)


def winning_interval(df: DataFrame, intervals: DataFrame, ts: str, key: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_hit``, a struct with the ``attack_id`` of the interval that holds, or null."""
    key = list(key)
    many = intervals.limit(BROADCAST_PIECES // 2 + 1).count() > BROADCAST_PIECES // 2
    points = intervals.select(F.explode(F.array(*(_micros(F.col(c)).cast("double") for c in ("start", "end")))).alias("p"))
    cuts = _cuts(points, "p", points.count(), BORDERS) if many else []
    if many or key:
        times = df.select(_micros(F.col(ts)).cast("double").alias("p"))
        cuts = sorted({*cuts, *_cuts(times, "p", times.count(), ROWS)})
        return _last_before(df, disjoint_pieces(intervals, key, cuts), ts, key, cuts)
    pieces = staged(disjoint_pieces(intervals, key, cuts).drop("cut"), "pieces")
    borders = pieces.select(F.explode(F.array(*(F.col(c).cast("double") for c in ("a", "b")))).alias("p"))
    ranges = _cuts(borders, "p", borders.count(), RANGE)
    split = _placed(_placed(pieces, "a", ranges, "r1").withColumn("_z", F.col("b") - 1), "_z", ranges, "r2").drop("_z")
    split = split.withColumn("_range", F.explode(F.sequence("r1", "r2"))).drop("r1", "r2").withColumn("_hit", F.struct("attack_id")).drop("attack_id")
    split = split.withColumnsRenamed({"a": "_a", "b": "_b"})
    # At most BROADCAST_PIECES pieces and as many more at the borders of ranges.
    rows = _placed(df.withColumn("_us", _micros(F.col(ts))), "_us", ranges, "_range")
    met = rows.join(F.broadcast(split), (rows["_range"] == split["_range"]) & (F.col("_a") <= F.col("_us")) & (F.col("_us") < F.col("_b")), "left")
    return met.select(*(rows[c] for c in df.columns), "_hit")


def _last_before(df: DataFrame, pieces: DataFrame, ts: str, key: list[str], cuts: list[float]) -> DataFrame:
    own = F.struct(*(F.col(c) for c in df.columns)).alias("_own")
    rows = _placed(df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), own, _micros(F.col(ts)).alias("_us")), "_us", cuts, "_cut")
    keys = [f"_k{i}" for i in range(len(key))]
    begins = pieces.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.lit(None).cast(rows.schema["_own"].dataType).alias("_own"),
        F.col("a").alias("_us"), F.col("cut").alias("_cut"), F.struct("b", "attack_id").alias("_piece"),
    )
    both = rows.withColumn("_piece", F.lit(None).cast(begins.schema["_piece"].dataType)).unionByName(begins)
    before = Window.partitionBy(*keys, "_cut").orderBy("_us", F.col("_own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_last", F.last("_piece", ignorenulls=True).over(before)).filter("_own IS NOT NULL")
    hit = F.when(F.col("_us") < F.col("_last.b"), F.struct(F.col("_last.attack_id").alias("attack_id")))
    return met.select("_own.*", hit.alias("_hit"))
