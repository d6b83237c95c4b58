"""Ordered operators over series of any length.

Every series carries a dense row index ``t``. Ordered work is cut into chunks
``t div CHUNK``; a chunk has at most CHUNK rows whatever the series length, so
no window ever holds a whole series. What crosses a chunk border is either a
few neighbour rows (``chunked(back=, ahead=)``) or a carry taken from a table
with one row per chunk. A scan first asks whether any series is longer than one
chunk (a filter on ``t``, answered by Parquet statistics); if none is, the
carry and its join are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from tidegauge.session import spread, staged

CHUNK = 65_536
RANK_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


# --------------------------------------------------------------------- index
def with_index(
    df: DataFrame, key: Sequence[str], ts: str, tiebreak: Sequence[str] = (), out: str = "t"
) -> DataFrame:
    """Dense row index per key in time order, without a whole-series sort.

    Row counts per minute and per day give the offset of each minute; rows are
    only numbered inside one (key, minute). A key has one row per timestamp
    (microseconds), so each of the three levels is bounded: days per series,
    1,440 minutes per day, and the rows of one minute.
    """
    key = list(key)
    rows = df.withColumn("_minute", F.date_trunc("minute", F.col(ts)))
    minutes = (
        rows.groupBy(*key, "_minute")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_day", F.to_date("_minute"))
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_day = before.partitionBy(*key, "_day").orderBy("_minute")
    days = (
        minutes.groupBy(*key, "_day")
        .agg(F.sum("_n").alias("_n"))
        .withColumn(
            "_day_start",
            F.coalesce(F.sum("_n").over(before.partitionBy(*key).orderBy("_day")), F.lit(0)),
        )
        .drop("_n")
    )
    offsets = (
        minutes.withColumn("_in_day", F.coalesce(F.sum("_n").over(in_day), F.lit(0)))
        .join(days, [*key, "_day"])
        .select(*key, "_minute", (F.col("_day_start") + F.col("_in_day")).alias("_offset"))
    )
    numbered = rows.withColumn(
        "_r",
        F.row_number().over(Window.partitionBy(*key, "_minute").orderBy(ts, *tiebreak)) - 1,
    )
    return (
        numbered.join(offsets, [*key, "_minute"])
        .withColumn(out, (F.col("_offset") + F.col("_r")).cast("long"))
        .drop("_minute", "_r", "_offset")
    )


def with_rank(
    df: DataFrame, key: Sequence[str], order: Sequence[str], out: str = "t"
) -> DataFrame:
    """Dense index per key for an order that is not a timestamp.

    Range partitioning splits a key of any size; positions inside a partition
    come from the sorted partition itself. The result is written once, so that
    both readers see the same partition borders.
    """
    key = list(key)
    ordered = [*key, *order]
    sorted_rows = staged(
        df.repartitionByRange(*ordered)
        .sortWithinPartitions(*ordered)
        .withColumn("_pos", F.monotonically_increasing_id()),
        "rank",
    ).withColumn("_part", F.shiftright("_pos", RANK_BITS))
    pieces = sorted_rows.groupBy(*key, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        sorted_rows.join(pieces.drop("_n"), [*key, "_part"])
        .withColumn(out, F.col("_pos") - F.col("_first") + F.col("_before"))
        .drop("_pos", "_part", "_first", "_before")
    )


# -------------------------------------------------------------------- chunks
def chunked(df: DataFrame, t: str = "t", back: int = 0, ahead: int = 0, size: int = CHUNK) -> DataFrame:
    """Add ``_chunk`` and ``_own``; copy border rows to the neighbour chunk.

    ``back`` rows of the previous chunk and ``ahead`` rows of the next one are
    visible to each chunk as rows with ``_own`` false.
    """
    if max(back, ahead) > size:
        raise ValueError("a neighbourhood must fit in one chunk")
    home = F.floor(F.col(t) / size).cast("long")
    if not back and not ahead:
        return df.withColumn("_chunk", home).withColumn("_own", F.lit(True))
    place = F.pmod(F.col(t), F.lit(size))
    targets = [home]
    if back:
        targets.append(F.when(place >= size - back, home + 1))
    if ahead:
        targets.append(F.when(place < ahead, home - 1))
    return df.withColumn("_chunk", F.explode(F.array_compact(F.array(*targets)))).withColumn(
        "_own", F.col("_chunk") == home
    )


def chunk_window(key: Sequence[str], t: str = "t", descending: bool = False) -> WindowSpec:
    order = F.col(t).desc() if descending else F.col(t).asc()
    return Window.partitionBy(*key, "_chunk").orderBy(order)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_chunk")


def with_lag(
    df: DataFrame, key: Sequence[str], lags: dict[str, tuple[str, int]], t: str = "t"
) -> DataFrame:
    """Add ``out = column at t - k`` for each ``out: (column, k)``."""
    reach = max(k for _, k in lags.values())
    rows = chunked(df, t, back=reach)
    w = chunk_window(key, t)
    rows = rows.select("*", *[F.lag(c, k).over(w).alias(out) for out, (c, k) in lags.items()])
    return own_rows(rows)


def trailing_lists(
    df: DataFrame, key: Sequence[str], length: int, lists: dict[str, Column | str], t: str = "t",
    end: int = 0, wide: bool = False,
) -> DataFrame:
    """Add ``collect_list`` of each column over rows ``[t-length+1+end, t+end]``, ``end <= 0``.

    ``wide`` keeps the exchange at full width for costly work on the lists.
    """
    rows = chunked(df, t, back=length - 1 - end)
    if wide:
        rows = spread(rows, *key, "_chunk")
    w = chunk_window(key, t).rowsBetween(end - length + 1, end)
    cols = [
        F.collect_list(F.col(c) if isinstance(c, str) else c).over(w).alias(out)
        for out, c in lists.items()
    ]
    return own_rows(rows.select("*", *cols))


# --------------------------------------------------------------------- scans
def fits_chunk(df: DataFrame, t: str = "t", size: int = CHUNK) -> bool:
    """True when no series has more than ``size`` rows."""
    return df.filter(F.col(t) >= size).isEmpty()


def longest_series(df: DataFrame, t: str = "t") -> int:
    """Rows of the longest series, to hand to several scans over the same rows."""
    top = df.agg(F.max(t)).first()[0]
    return 0 if top is None else int(top) + 1


def _short(df: DataFrame, t: str, size: int, longest: int | None) -> bool:
    return fits_chunk(df, t, size) if longest is None else longest <= size


def _carry_join(rows: DataFrame, ends: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(ends, [*key, "_chunk"], "left")


def fill(
    df: DataFrame, key: Sequence[str], cols: dict[str, str], t: str = "t", backward: bool = False,
    size: int = CHUNK, longest: int | None = None,
) -> DataFrame:
    """Add ``out`` = last non-null value at or before ``t`` (first at or after if backward)."""
    key = list(key)
    rows = chunked(df, t, size=size)
    local = chunk_window(key, t, backward).rowsBetween(Window.unboundedPreceding, 0)
    if _short(df, t, size, longest):
        return rows.select(
            "*", *[F.last(c, ignorenulls=True).over(local).alias(o) for o, c in cols.items()]
        ).drop("_chunk", "_own")
    pick = F.min_by if backward else F.max_by
    ends = rows.groupBy(*key, "_chunk").agg(
        *[
            pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(t))).alias(f"_end_{out}")
            for out, c in cols.items()
        ]
    )
    order = F.col("_chunk").desc() if backward else F.col("_chunk").asc()
    past = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *key,
        "_chunk",
        *[F.last(f"_end_{o}", ignorenulls=True).over(past).alias(f"_carry_{o}") for o in cols],
    )
    rows = rows.select(
        "*", *[F.last(c, ignorenulls=True).over(local).alias(f"_local_{o}") for o, c in cols.items()]
    )
    joined = _carry_join(rows, ends, key)
    for o in cols:
        joined = joined.withColumn(o, F.coalesce(f"_local_{o}", f"_carry_{o}"))
    drop = [f"_{p}_{o}" for p in ("local", "carry") for o in cols]
    return joined.drop("_chunk", "_own", *drop)


def prefix_sum(
    df: DataFrame, key: Sequence[str], sums: dict[str, Column], t: str = "t", size: int = CHUNK,
    longest: int | None = None,
) -> DataFrame:
    """Add running sums up to and including ``t``."""
    key = list(key)
    rows = chunked(df, t, size=size)
    local = chunk_window(key, t).rowsBetween(Window.unboundedPreceding, 0)
    if _short(df, t, size, longest):
        return rows.select("*", *[F.sum(x).over(local).alias(o) for o, x in sums.items()]).drop(
            "_chunk", "_own"
        )
    ends = rows.groupBy(*key, "_chunk").agg(
        *[F.sum(x).alias(f"_end_{o}") for o, x in sums.items()]
    )
    past = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *key, "_chunk",
        *[F.coalesce(F.sum(f"_end_{o}").over(past), F.lit(0)).alias(f"_carry_{o}") for o in sums],
    )
    rows = rows.select("*", *[F.sum(x).over(local).alias(f"_local_{o}") for o, x in sums.items()])
    joined = _carry_join(rows, ends, key)
    for o in sums:
        joined = joined.withColumn(o, F.col(f"_local_{o}") + F.col(f"_carry_{o}"))
    drop = [f"_{p}_{o}" for p in ("local", "carry") for o in sums]
    return joined.drop("_chunk", "_own", *drop)


def reindexed(df: DataFrame, key: Sequence[str], t: str = "t") -> DataFrame:
    """Renumber ``t`` densely after rows were filtered out."""
    out = prefix_sum(df, key, {"_dense": F.lit(1)}, t)
    return out.withColumn(t, (F.col("_dense") - 1).cast("long")).drop("_dense")


def reflected_sum(
    df: DataFrame, key: Sequence[str], increments: dict[str, Column], t: str = "t", size: int = CHUNK,
    longest: int | None = None,
) -> DataFrame:
    """``S = max(0, S + x)`` from S = 0, for several increments at once.

    Inside a chunk ``S = C - min(0, min C)`` with ``C`` the running sum. Over a
    chunk the map is ``S -> max(A, S + B)``, and such maps compose by the same
    two windows over the table of chunks.
    """
    key = list(key)
    rows = chunked(df, t, size=size)
    w = chunk_window(key, t).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(x).over(w).alias(f"_c_{o}") for o, x in increments.items()])
    rows = rows.select(
        "*",
        *[
            (F.col(f"_c_{o}") - F.least(F.lit(0.0), F.min(f"_c_{o}").over(w))).alias(f"_s_{o}")
            for o in increments
        ],
    )
    if _short(df, t, size, longest):
        return rows.withColumnsRenamed({f"_s_{o}": o for o in increments}).drop(
            "_chunk", "_own", *[f"_c_{o}" for o in increments]
        )
    ends = rows.groupBy(*key, "_chunk").agg(
        *[F.max_by(f"_s_{o}", t).alias(f"_a_{o}") for o in increments],
        *[F.max_by(f"_c_{o}", t).alias(f"_b_{o}") for o in increments],
    )
    upto = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select("*", *[F.sum(f"_b_{o}").over(upto).alias(f"_p_{o}") for o in increments])
    ends = ends.select(
        *key,
        "_chunk",
        *[
            (F.col(f"_p_{o}") + F.max(F.col(f"_a_{o}") - F.col(f"_p_{o}")).over(upto)).alias(f"_z_{o}")
            for o in increments
        ],
    ).withColumn("_chunk", F.col("_chunk") + 1)
    joined = _carry_join(rows, ends, key)
    for o in increments:
        joined = joined.withColumn(
            o,
            F.greatest(
                F.col(f"_s_{o}"), F.coalesce(f"_z_{o}", F.lit(0.0)) + F.col(f"_c_{o}")
            ),
        )
    drop = [f"_{p}_{o}" for p in "csz" for o in increments]
    return joined.drop("_chunk", "_own", *drop)


def geometric_scan(
    df: DataFrame, key: Sequence[str], inputs: dict[str, Column], rho: float, t: str = "t",
    longest: int | None = None,
) -> DataFrame:
    """``s_t = rho * s_{t-1} + x_t`` from s = 0, with ``0 <= rho <= 1`` and dense ``t``.

    A block is short enough that ``rho ** -length`` stays a normal double. When
    the state of the block before the previous one has faded below 1e-140, the
    carry is the previous block's end; else the block ends are scanned again.
    """
    key = list(key)
    if not 0.0 <= rho <= 1.0:
        raise ValueError("rho must be in [0, 1]")
    if rho == 0.0:
        return df.select("*", *[x.alias(o) for o, x in inputs.items()])
    if rho == 1.0:
        return prefix_sum(df, key, inputs, t, longest=longest)
    length = max(1, min(CHUNK, int(150 * math.log(10) / -math.log(rho))))
    rows = chunked(df, t, size=length)
    place = F.pmod(F.col(t), F.lit(length)).cast("double")
    w = chunk_window(key, t).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "*",
        *[
            (F.sum(x * F.pow(F.lit(rho), -place)).over(w) * F.pow(F.lit(rho), place)).alias(f"_s_{o}")
            for o, x in inputs.items()
        ],
    )
    if _short(df, t, length, longest):
        return rows.withColumnsRenamed({f"_s_{o}": o for o in inputs}).drop("_chunk", "_own")
    ends = rows.groupBy(*key, "_chunk").agg(
        *[F.max_by(f"_s_{o}", t).alias(f"_z_{o}") for o in inputs]
    )
    ratio = rho**length
    if ratio > 1e-140:
        ends = geometric_scan(
            ends.withColumnRenamed("_chunk", "_block"),
            key, {f"_y_{o}": F.col(f"_z_{o}") for o in inputs}, ratio, "_block",
        )
        ends = ends.select(*key, F.col("_block").alias("_chunk"), *[F.col(f"_y_{o}").alias(f"_z_{o}") for o in inputs])
    ends = ends.withColumn("_chunk", F.col("_chunk") + 1)
    joined = _carry_join(rows, ends, key)
    for o in inputs:
        joined = joined.withColumn(
            o,
            F.col(f"_s_{o}") + F.pow(F.lit(rho), place + 1) * F.coalesce(f"_z_{o}", F.lit(0.0)),
        )
    drop = [f"_{p}_{o}" for p in "sz" for o in inputs]
    return joined.drop("_chunk", "_own", *drop)


def geometric(x: np.ndarray, rho: float, start: float) -> np.ndarray:
    """``s = rho * s + x`` over an array from ``start``, in passes that double their reach."""
    s = x.astype(float)
    if len(s):
        s[0] += rho * start
    reach, power = 1, rho
    while reach < len(s) and power:
        s[reach:] = s[reach:] + power * s[:-reach]
        reach, power = 2 * reach, power * power
    return s


Step = Callable[
    [dict[str, np.ndarray], "list[float] | None"], "tuple[dict[str, np.ndarray], list[float]]"
]


def _run_sorted(
    rows: DataFrame, key: list[str], group: list[str], step: Step, fields: Sequence[T.StructField], t: str
) -> DataFrame:
    """Run ``step`` over each ``group`` in ``t`` order; ``_in``, if present, is its start state.

    Rows are sorted inside hash partitions and stream through in Arrow batches. A
    group that spans batches goes on with its state, so none is held whole and
    short series cost no call each. ``_end`` is the state after a piece.
    """
    schema = T.StructType(
        [rows.schema[c] for c in dict.fromkeys([*key, *group, t])]
        + list(fields)
        + [T.StructField("_end", T.ArrayType(T.DoubleType()))]
    )
    kept = [f.name for f in schema.fields[: -len(fields) - 1]]
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf[group]
            begins = np.flatnonzero((ids != ids.shift()).any(axis=1).to_numpy())
            columns = {c: pdf[c].to_numpy() for c in pdf.columns}
            results = {n: [] for n in names}
            ends = [None] * len(pdf)
            for begin, end in zip(begins, [*begins[1:], len(pdf)]):
                mine = tuple(columns[c][begin] for c in group)
                if mine != current:
                    current = mine
                    start = columns["_in"][begin] if "_in" in columns else None
                    state = None if start is None else [float(v) for v in start]
                out, state = step({c: v[begin:end] for c, v in columns.items()}, state)
                for n in names:
                    results[n].append(out[n])
                ends[end - 1] = [float(v) for v in state]
            rows_out = {c: columns[c] for c in kept}
            rows_out.update({n: np.concatenate(parts) for n, parts in results.items()})
            yield pd.DataFrame(rows_out).assign(_end=ends)

    return spread(rows, *group).sortWithinPartitions(*group, t).mapInPandas(run, schema)


def feedback_scan(
    df: DataFrame, key: Sequence[str], step: Step, fields: Sequence[T.StructField], t: str = "t", size: int = CHUNK
) -> DataFrame:
    """Recurrence whose state feeds back into its input (CUSUM with reset).

    ``step(columns, state)`` runs a piece of one series in ``t`` order and returns its
    output arrays and the end state; ``state=None`` is the series start. Chunks first
    run in parallel from the start state, then those whose true incoming state differs from
    the one used run again. Most states forget their start (they return to zero), so this
    settles most series; what a key still has wrong from some chunk on streams through one
    task in order. That makes three passes at most, and the sequential result in any case.
    No pass writes again what an earlier one got right: each appends its chunks under its
    number, and the last pass over a chunk counts. Returns key, ``t`` and ``fields``.
    """
    key = list(key)
    result = [*key, t, *[f.name for f in fields]]
    if fits_chunk(df, t, size):
        return _run_sorted(df, key, key, step, fields, t).select(*result)

    group = [*key, "_chunk"]
    rows = staged(chunked(df, t, size=size).drop("_own"), "chunks")
    passes = [staged(_run_sorted(rows, key, group, step, fields, t), "scan")]
    ends = passes[0].filter("_end IS NOT NULL").groupBy(*group).agg(F.max_by("_end", t).alias("_end"))
    ends = staged(ends.withColumn("_used", F.lit(None).cast("array<double>")).withColumn("_pass", F.lit(0)), "ends")

    stale = _stale(ends, key, group)
    if not stale.isEmpty():
        again = staged(_run_sorted(rows.join(stale, group), key, group, step, fields, t), "scan")
        passes.append(again)
        better = again.filter("_end IS NOT NULL").groupBy(*group).agg(F.max_by("_end", t).alias("_end"))
        better = better.join(stale.withColumnRenamed("_in", "_used"), group).withColumn("_pass", F.lit(1))
        ends = staged(ends.join(stale.select(*group), group, "left_anti").unionByName(better), "ends")
        stale = _stale(ends, key, group)
    if len(passes) > 1 and not stale.isEmpty():
        # The first wrong chunk of a key has the right state before it, and so has all that follows.
        first = stale.groupBy(*key).agg(F.min("_chunk").alias("_from"), F.min_by("_in", "_chunk").alias("_in"))
        first = staged(first, "tails")
        tails = rows.join(first, key).filter(F.col("_chunk") >= F.col("_from")).drop("_from")
        passes.append(staged(_run_sorted(tails, key, key, step, fields, t).withColumn("_chunk", F.floor(F.col(t) / size).cast("long")), "scan"))
        last = ends.join(first.select(*key, "_from"), key, "left")
        ends = last.withColumn("_pass", F.when(F.col("_chunk") >= F.col("_from"), 2).otherwise(F.col("_pass")))
    if len(passes) == 1:
        return passes[0].select(*result)
    valid = staged(ends.select(*group, "_pass"), "passes")
    parts = [p.join(valid.filter(F.col("_pass") == i), group, "left_semi").select(*result) for i, p in enumerate(passes)]
    return reduce(DataFrame.unionByName, parts)


def _stale(ends: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """Chunks that ran from another state than the one before them left, with that state."""
    incoming = ends.select(*key, (F.col("_chunk") + 1).alias("_chunk"), F.col("_end").alias("_in"))
    wrong = ends.join(incoming, group).filter(~F.col("_used").eqNullSafe(F.col("_in")))
    return staged(wrong.select(*group, "_in"), "stale")


def with_runs(
    df: DataFrame, key: Sequence[str], flag: Column, t: str = "t", longest: int | None = None
) -> DataFrame:
    """Add ``run_start``: first ``t`` of the maximal run of true flags a row is in, else null."""
    rows = with_lag(df.withColumn("_flag", flag), key, {"_before": ("_flag", 1)}, t)
    starts = F.when(F.col("_flag") & ~F.coalesce("_before", F.lit(False)), F.col(t))
    if longest is None and fits_chunk(df, t):
        longest = CHUNK
    rows = fill(rows.withColumn("_start", starts), key, {"run_start": "_start"}, t, longest=longest)
    return rows.withColumn("run_start", F.when(F.col("_flag"), F.col("run_start"))).drop(
        "_flag", "_before", "_start"
    )
