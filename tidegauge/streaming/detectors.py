"""Online detectors as keyed state over a stream of readings, in event time.

Rows of a key wait in its state until the watermark has passed them, and are then scored in
time order, so disorder within the delay changes nothing. A row that is older than the
watermark when it arrives is late: it is returned with empty results and counted in
``late_rows``, the number of late rows of the key so far. Rows without a time are left out. Keys
share the state of one of ``GROUPS`` groups. A detector's memory is the rows and keys of one
group between two watermarks; limit the rows by the source's rate options. ``Closing``
scores what still waits when a stream is known to have ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidegauge.operators.ordered import Step, geometric
from tidegauge.operators.scores import ADAPTIVE_FIELDS, RESET_FIELDS, adaptive_step, reset_step
from tidegauge.session import new_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Keys are told apart by a hash and share the state of their group: calls of the state cost
# milliseconds, which short series would pay one by one. It stays the same for a stream's life.
GROUPS = 512
# The keys of a group in the order they came, and of each the detector's state and late rows.
_STATE = T.StructType(
    [
        T.StructField("keys", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("values", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("late", T.ArrayType(T.LongType())),
        T.StructField("timer", T.LongType()),
    ]
)
# A run of waiting rows sorted by time: the places of their keys, their times and columns, as the
# bytes of NumPy arrays.
_RUN = T.StructType(
    [
        T.StructField("places", T.BinaryType()),
        T.StructField("micros", T.BinaryType()),
        T.StructField("columns", T.ArrayType(T.BinaryType())),
    ]
)
END = "9999-01-01"  # the time of the row that declares a stream complete


def _bytes(places: np.ndarray, times: np.ndarray, held: list[np.ndarray]) -> tuple:
    return places.tobytes(), times.tobytes(), [h.tobytes() for h in held]


class OrderedProcessor(StatefulProcessor):
    """Runs a step function over the rows of each key in time order, as the watermark passes."""

    def __init__(self, step: Step, key: list[str], ts: str, columns: list[str], fields: list[str]) -> None:
        self.step, self.key, self.ts, self.columns, self.fields = step, key, ts, columns, fields

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.runs = handle.getListState("runs", _RUN)

    def _known(self) -> tuple[list[tuple], list[list[float] | None], list[int], int | None]:
        if not self.state.exists():
            return [], [], [], None
        keys, values, late, timer = self.state.get()
        return [tuple(k) for k in keys], list(values), list(late), timer

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        border = timerValues.getCurrentWatermarkInMs() * 1000
        keys, values, late, timer = self._known()
        known = {k: i for i, k in enumerate(keys)}
        earliest, refused = None, []
        for chunk in rows:
            micros = chunk[self.ts].to_numpy(np.int64)
            names = zip(*(chunk[k].tolist() for k in self.key))
            places = np.array([known.setdefault(n, len(known)) for n in names], dtype=np.int64)
            fresh = micros >= border
            if not fresh.all():
                refused.append((places[~fresh], micros[~fresh]))
            if fresh.any():
                order = np.flatnonzero(fresh)[np.argsort(micros[fresh], kind="stable")]
                times = micros[order]
                held = [chunk[c].to_numpy(float)[order] for c in self.columns]
                self.runs.appendValue(_bytes(places[order], times, held))
                earliest = int(times[0]) if earliest is None else min(earliest, int(times[0]))
        keys = list(known)
        values += [None] * (len(keys) - len(values))
        late += [0] * (len(keys) - len(late))
        for places, _ in refused:
            for place in places.tolist():
                late[place] += 1
        self.state.update(([list(k) for k in keys], values, late, self._timer(timer, earliest)))
        for places, micros in refused:
            empty = {f: pd.Series([None] * len(places), dtype=object) for f in self.fields}
            yield self._rows(keys, late, places, micros, empty)

    def _rows(self, keys: list[tuple], late: list[int], places: np.ndarray, micros: np.ndarray, out: dict) -> pd.DataFrame:
        ids = {c: [keys[p][i] for p in places.tolist()] for i, c in enumerate(self.key)}
        return pd.DataFrame({**ids, self.ts: micros, **out, "late_rows": np.array(late)[places]})

    def _timer(self, timer: int | None, earliest: int | None) -> int | None:
        """One timer a group, for the millisecond in which its first waiting row is passed."""
        if earliest is None or (timer is not None and timer <= earliest // 1000 + 1):
            return timer
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(earliest // 1000 + 1)
        return earliest // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        border = timerValues.getCurrentWatermarkInMs() * 1000
        keys, values, late, _ = self._known()
        due, waiting = [], []
        for places, times, columns in self.runs.get():
            places, times = np.frombuffer(places, dtype=np.int64), np.frombuffer(times, dtype=np.int64)
            held = [np.frombuffer(c, dtype=float) for c in columns]
            passed = int(np.searchsorted(times, border))
            if passed:
                due.append([x[:passed] for x in (places, times, *held)])
            if passed < len(times):
                waiting.append([x[passed:] for x in (places, times, *held)])
        if waiting:
            self.runs.put([_bytes(p, t, held) for p, t, *held in waiting])
        else:
            self.runs.clear()
        first = min((int(t[0]) for _, t, *_ in waiting), default=None)
        if due:
            places, times, *held = (np.concatenate(parts) for parts in zip(*due))
            order = np.lexsort((*held[::-1], times, places))
            places, times, held = places[order], times[order], [h[order] for h in held]
            starts = np.flatnonzero(np.diff(places, prepend=-1)).tolist()
            done = []
            for start, end in zip(starts, [*starts[1:], len(places)]):
                place = int(places[start])
                out, state = self.step({c: h[start:end] for c, h in zip(self.columns, held)}, values[place])
                values[place] = [float(v) for v in state]
                done.append(out)
            yield self._rows(keys, late, places, times, {f: np.concatenate([out[f] for out in done]) for f in self.fields})
        self.state.update(([list(k) for k in keys], values, late, self._timer(None, first)))

    def close(self) -> None:
        pass


def _run(stream: DataFrame, key: Sequence[str], step: Step, ts: str, fields: Sequence[T.StructField], delay: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = T.StructType(
        [T.StructField(k, T.StringType()) for k in key]
        + [T.StructField(ts, T.LongType())]
        + list(fields)
        + [T.StructField("late_rows", T.LongType())]
    )
    columns = [f.name for f in stream.schema if isinstance(f.dataType, T.NumericType) and f.name not in key]
    # The watermark is kept on a copy that goes no further: rows of a column that carries it
    # are dropped by Spark when they are late, and would not be counted. The row of ``Closing``
    # moves the watermark and goes no further either.
    rows = stream.withColumn("_event", F.col(ts)).withWatermark("_event", delay)
    rows = rows.filter(F.col("_event") < F.lit(END).cast("timestamp"))
    # Keys travel as text, which pandas leaves as it is where some are null, times as microseconds.
    names = [F.col(k).cast("string").alias(k) for k in key]
    group = F.pmod(F.xxhash64(*names), F.lit(GROUPS)).alias("_group")
    processor = OrderedProcessor(step, list(key), ts, columns, [f.name for f in fields])
    out = rows.select(group, *names, F.unix_micros(F.col(ts).cast("timestamp")).alias(ts), *columns).groupBy("_group").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    typed = {k: F.col(k).cast(stream.schema[k].dataType) for k in key}
    return out.withColumns({**typed, ts: F.timestamp_micros(ts).cast(stream.schema[ts].dataType)})


class Closing:
    """A stream that can be declared complete, so that no row is left waiting.

    ``rows`` is the stream with a second source beside it. After a run over all there is,
    ``close`` puts one row of a far time there; the next run from the same checkpoint moves
    the watermark past every row that waits.
    """

    def __init__(self, stream: DataFrame, ts: str = "ts") -> None:
        self.spark, self.ts = stream.sparkSession, ts
        self.folder = new_path(self.spark, "stream-end")
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in stream.schema])
        self.spark.createDataFrame([], self.schema).write.parquet(self.folder)
        ends = self.spark.readStream.schema(self.schema).parquet(self.folder)
        self.rows = stream.unionByName(ends)

    def close(self) -> None:
        kind = self.schema[self.ts].dataType
        row = [F.lit(END).cast(kind).alias(f.name) if f.name == self.ts else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).select(*row).write.mode("append").parquet(self.folder)


def stream_cusum(stream: DataFrame, key: Sequence[str], y: str, mu0: str, k: str, h: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """CUSUM with reset per key; the statistic before and after the reset, and the alarm."""
    return _run(stream, key, reset_step(y, mu0, k, h), ts, RESET_FIELDS, delay)


def stream_adaptive_cusum(
    stream: DataFrame, key: Sequence[str], y: str, mean: str, std: str, gate: str, alpha: str, ts: str = "ts",
    slack: float = 0.5, limit: float = 5.0, delay: str = "1 hour",
) -> DataFrame:
    """Gated adaptive CUSUM per key."""
    step = adaptive_step(y, mean, std, gate, alpha, slack, limit)
    return _run(stream, key, step, ts, ADAPTIVE_FIELDS, delay)


def ewma_step(y: str, alpha: float) -> Step:
    """EWMA from zero and first difference; state ``[ewma, last value]``."""

    def step(columns: dict[str, np.ndarray], state: list[float] | None):
        x = columns[y].astype(float)
        level, before = state if state else (0.0, x[0])
        levels = geometric(alpha * x, 1.0 - alpha, level)
        return {"ewma": np.abs(levels), "residual": np.diff(x, prepend=before)}, [float(levels[-1]), float(x[-1])]

    return step


def stream_ewma(stream: DataFrame, key: Sequence[str], y: str, alpha: float = 0.2, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """EWMA score and persistence residual per key."""
    fields = [T.StructField("ewma", T.DoubleType()), T.StructField("residual", T.DoubleType())]
    return _run(stream, key, ewma_step(y, alpha), ts, fields, delay)


def stream_activation(
    stream: DataFrame, active: str, ts: str = "ts", cadence: str = "1 hour", length: str = "1 day", delay: str = "0 seconds"
) -> DataFrame:
    """Share of active cells and of timesteps with any active cell per tumbling window.

    A timestep is one ``cadence``; both levels are event-time windows under one watermark.
    """
    steps = (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, cadence).alias("step"))
        .agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col(active).cast("int")).alias("on"))
    )
    windows = steps.groupBy(F.window(F.window_time("step"), length)).agg(
        F.sum("cells").alias("cells"), F.sum("on").alias("on"), F.count(F.lit(1)).alias("steps"),
        F.sum((F.col("on") > 0).cast("int")).alias("active_steps"),
    )
    return windows.select(
        F.col("window.start").alias("window_start"),
        "cells", "steps",
        (F.col("on") / F.col("cells")).alias("active_cell_fraction"),
        (F.col("active_steps") / F.col("steps")).alias("active_timestep_fraction"),
    )


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """File stream over the Parquet files of one table in a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", f"{name}*.parquet")
        .parquet(folder)
    )


def run_available(
    stream: DataFrame, mode: str = "append", closing: Closing | None = None, arrivals: Sequence[Callable[[], None]] = ()
) -> DataFrame:
    """Process what is there now into a Parquet sink and return the written rows.

    Each of ``arrivals`` brings further input, which the next run processes from the same
    checkpoint. With ``closing``, the stream is declared complete and the rest is scored too.
    """
    spark = stream.sparkSession
    out, marks = new_path(spark, "stream-out"), new_path(spark, "stream-marks")
    for arrive in [*(arrivals or [lambda: None]), *([closing.close] if closing else [])]:
        arrive()
        query = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", out)
            .option("checkpointLocation", marks)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
