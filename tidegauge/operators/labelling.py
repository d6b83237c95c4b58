"""Attack intervals, labels, splits, blocks and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.operators.intervals import winning_interval
from tidegauge.operators.ordered import with_rank

LEAF = 16_384
DAY = "INTERVAL 1 DAY"


def synthesize_ts(df: DataFrame, date_col: str, order: Sequence[str], step_seconds: int = 1, out: str = "timestamp") -> DataFrame:
    """``date`` plus one step per row in arrival order, restarting with every date."""
    rows = with_rank(df, [date_col], order, "_place")
    start = F.unix_timestamp(F.col(date_col).cast("timestamp"))
    ts = F.timestamp_seconds(start + F.col("_place") * step_seconds)
    return rows.withColumn(out, ts).drop("_place")


def normalize_intervals(
    intervals: DataFrame, data_start: Column | None = None, fixes: dict[str, str] | None = None
) -> DataFrame:
    """Clean an attack list ``(start, end, attack_id, list_pos)``.

    Rows with nulls go; ``fixes`` maps wrong dates to right ones; an end at or before
    its start belongs to the next day; a start less than 365 days before the data
    moves, with its end, one year on.
    """
    rows = intervals.dropna(subset=["start", "end", "attack_id"])
    for wrong, right in (fixes or {}).items():
        shift = F.datediff(F.lit(right).cast("date"), F.lit(wrong).cast("date"))
        day = F.make_dt_interval(shift)
        hit = F.to_date("start") == F.lit(wrong).cast("date")
        rows = rows.withColumns(
            {
                "end": F.when(hit, F.col("end") + day).otherwise(F.col("end")),
                "start": F.when(hit, F.col("start") + day).otherwise(F.col("start")),
            }
        )
    rows = rows.withColumn(
        "end", F.when(F.col("end") <= F.col("start"), F.col("end") + F.expr(DAY)).otherwise(F.col("end"))
    )
    if data_start is None:
        return rows
    gap = F.unix_timestamp(data_start.cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))
    early = (gap > 0) & (gap < 365 * 86_400)
    year = F.expr("INTERVAL 1 YEAR")
    return rows.withColumns(
        {
            "start": F.when(early, F.col("start") + year).otherwise(F.col("start")),
            "end": F.when(early, F.col("end") + year).otherwise(F.col("end")),
        }
    )


def label_by_intervals(df: DataFrame, intervals: DataFrame, ts: str = "timestamp", key: Sequence[str] = ()) -> DataFrame:
    """``label`` 1 and ``attack_id`` where ``start <= ts <= end``; the last interval in the list wins.

    Intervals, of any number and overlap, are first made disjoint, so a row meets one at most.
    """
    joined = winning_interval(df, intervals, ts, key)
    return joined.withColumns(
        {"label": F.col("_hit").isNotNull().cast("byte"), "attack_id": F.col("_hit.attack_id").cast("int")}
    ).drop("_hit")


def label_from_flag(df: DataFrame, flag: str) -> DataFrame:
    """Positive flags are attacks and their id; anything else is normal."""
    on = F.coalesce(F.col(flag) > 0, F.lit(False))
    return df.withColumns({"label": on.cast("byte"), "attack_id": F.when(on, F.col(flag)).cast("int")})


def label_from_phases(df: DataFrame, attack: str, phases: Sequence[str]) -> DataFrame:
    """Attack id as a bit mask of the phase flags, first phase highest; null on normal rows."""
    mask = F.lit(0)
    for p in phases:
        mask = mask * 2 + F.col(p).cast("int")
    on = F.col(attack).cast("int") == 1
    return df.withColumns({"label": F.col(attack).cast("byte"), "attack_id": F.when(on, mask).cast("int")})


def chrono_split(
    df: DataFrame, key: Sequence[str], *, last_n: int | None = None, last_frac: float | None = None,
    first_frac: float | None = None, cutoff: str | None = None, t: str = "t", ts: str = "timestamp",
) -> DataFrame:
    """Add ``split`` train or val by exactly one rule; ``t`` is the dense index."""
    rules = [r for r in (last_n, last_frac, first_frac, cutoff) if r is not None]
    if len(rules) != 1:
        raise ValueError("give exactly one split rule")
    if cutoff is not None:
        late = F.col(ts) >= F.lit(cutoff).cast("timestamp_ntz")
        return df.withColumn("split", F.when(late, "val").otherwise("train"))
    n = F.col("_n")
    if last_n is not None:
        border = n - last_n
    elif last_frac is not None:
        border = n - F.floor(n * last_frac)
    else:
        border = F.floor(n * first_frac)
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(sizes, list(key)).withColumn(
        "split", F.when(F.col(t) >= border, "val").otherwise("train")
    ).drop("_n")


def boundary_guard(train: DataFrame, val: DataFrame, key: Sequence[str], ts: str = "timestamp", gap_seconds: float = 0.0) -> DataFrame:
    """Validation rows later than the last train row of their series by more than ``gap_seconds``.

    The guard acts where validation begins at or before that row; a series that begins after it
    keeps all its rows, whatever the gap.
    """
    last = train.groupBy(*key).agg(F.max(ts).alias("_last"))
    first = val.groupBy(*key).agg(F.min(ts).alias("_first"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    late = micros(ts) > micros("_last") + int(gap_seconds * 1_000_000)
    apart = F.col("_last").isNull() | (F.col("_first") > F.col("_last"))
    met = val.join(last, list(key), "left").join(first, list(key), "left")
    return met.filter(apart | late).select(*val.columns)


def assign_blocks(df: DataFrame, blocks: Sequence[tuple[str, str, int, int]], t: str = "t", held_out: Sequence[str] = ()) -> DataFrame:
    """Add ``block`` from named half-open ranges ``(name, split, start, stop)``.

    Blocks are a fixed short list, so they become one CASE; rows outside every block
    and rows of ``held_out`` blocks go by a filter on split and index that reaches
    the scan.
    """
    name = F.lit(None).cast("string")
    read = F.lit(False)
    for block, split, start, stop in blocks:
        if stop <= start:
            raise ValueError(f"block {block} is empty")
        here = (F.col("split") == split) & (F.col(t) >= start) & (F.col(t) < stop)
        name = F.when(here, block).otherwise(name)
        if block not in held_out:
            read = read | here
    return df.filter(read).withColumn("block", name)


def audit_blocks(blocks: DataFrame, cadence_seconds: int) -> DataFrame:
    """Check a block table ``(name, split, row_start, row_stop, start, end)`` in list order ``pos``.

    One row per block with the three findings; the table has one row per block.
    """
    epoch = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    rows = blocks.withColumns({"_s": epoch("start"), "_e": epoch("end")})
    order, in_split = Window.orderBy("pos"), Window.partitionBy("split").orderBy("pos")
    length = F.col("row_stop") - F.col("row_start")
    return rows.select(
        "name", "split",
        (F.col("_e") == F.col("_s") + (length - 1) * cadence_seconds).alias("length_matches"),
        F.coalesce(F.col("_s") == F.lag("_e").over(order) + cadence_seconds, F.lit(True)).alias("follows_previous"),
        F.coalesce(F.col("row_start") == F.lag("row_stop").over(in_split), F.lit(True)).alias("contiguous_rows"),
    )


def series_fingerprint(df: DataFrame, key: Sequence[str], value: str, t: str = "t") -> DataFrame:
    """SHA-256 of the ordered values and their number, per key.

    Values are hashed in leaves of at most LEAF rows, leaf digests again, three
    levels in all, so no task holds a whole series.
    """
    key = list(key)
    level = df.select(*key, F.col(t).alias("_i"), F.col(value).cast("string").alias("_d"), F.lit(1).cast("long").alias("_n"))
    for _ in range(3):
        parts = F.sort_array(F.collect_list(F.struct("_i", "_d")))
        level = (
            level.withColumn("_leaf", F.floor(F.col("_i") / LEAF))
            .groupBy(*key, "_leaf")
            .agg(
                F.sha2(F.concat_ws(",", F.transform(parts, lambda p: F.coalesce(p["_d"], F.lit("null")))), 256).alias("_d"),
                F.sum("_n").alias("_n"),
            )
            .withColumnRenamed("_leaf", "_i")
        )
    return level.select(*key, F.sha2(F.concat_ws(":", F.col("_n").cast("string"), "_d"), 256).alias("fingerprint"), F.col("_n").alias("rows"))
