"""Registered queries of this subpackage, table access and small shared steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Python tasks get whole texts in batches of at most so many rows, so that a batch of
# ordinary documents is a few megabytes and one of very long ones still fits a worker.
BATCH_ROWS = 512

#: Runs of these characters separate words; a word is a run of any others.
SPACES = "[\\x20\\x09-\\x0D]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the equal statement over the same tables."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def prepare(spark: SparkSession) -> SparkSession:
    """Library settings, and batches that keep a Python worker small."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: str = "text") -> Column:
    """With the id, the identity of a document: rows that repeat both are one document."""
    return F.xxhash64(F.lit(7), F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def crc32_of(col: str) -> Column:
    """CRC-32 of the decimal text of an integer column; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Ask for a broadcast only after counting: a longer table is joined by shuffling.

    ``max_rows`` must bound the size, so ``df`` should have a few fixed-width columns.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def in_batches(rows: Iterable[dict], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
