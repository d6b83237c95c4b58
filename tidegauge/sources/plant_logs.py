"""Delimited plant logs: reading, timestamps and bad readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Timestamp layouts of the plant logs.
TIMESTAMP_FORMATS = {
    "day_first_12h": "d/M/yyyy h:mm:ss a",
    "month_first_split": "M/d/yyyy h:mm:ss.SSS a",
    "day_first_hour": "d/M/yy H",
    "iso_seconds": "yyyy-MM-dd HH:mm:ss",
    "iso_fraction": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}
MAX_BANNER = 100


def read_plant_csv(
    spark: SparkSession, path: str | list[str], sep: str = ",", skip: int = 0, strip_prefix: str = ""
) -> DataFrame:
    """All-string rows of a delimited log with cleaned column names.

    ``skip`` banner lines precede the header of the first file. The lines are read as splittable text;
    banner and header lines are dropped by content, so every file may repeat them.
    """
    if not 0 <= skip <= MAX_BANNER:
        raise ValueError(f"skip must be between 0 and {MAX_BANNER}")
    lines = spark.read.text(path)
    first = path[0] if isinstance(path, list) else sorted(lines.inputFiles())[0]
    top = [r[0] for r in spark.read.text(first).take(skip + 1)]
    if len(top) <= skip:
        raise ValueError("the log has no header line")
    names = [n.strip().strip('"').replace(strip_prefix, "").strip() for n in top[skip].split(sep)]
    body = lines.filter(~F.col("value").isin(top) & (F.length(F.trim("value")) > 0))
    return body.select(F.from_csv("value", _ddl(names), {"sep": sep}).alias("r")).select("r.*")


def _ddl(names: Sequence[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` STRING" for n in names)


def parse_ts(df: DataFrame, layout: str, *cols: str, out: str = "timestamp") -> DataFrame:
    """Parse one or more text columns, joined by a blank, into a zone-free timestamp."""
    text = F.concat_ws(" ", *[F.trim(F.col(f"`{c}`")) for c in cols])
    parsed = F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMATS[layout]))
    return df.withColumn(out, parsed.cast("timestamp_ntz"))


def epoch_seconds(df: DataFrame, ts: str = "timestamp", out: str = "epoch") -> DataFrame:
    return df.withColumn(out, F.unix_timestamp(F.col(ts).cast("timestamp")))


def coerce_tags(df: DataFrame, tags: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric tag columns from ``tag.Pv``, ``tag.Status`` or ``tag``; text that is no number becomes null."""
    chosen = []
    for tag in tags:
        source = next((c for c in (f"{tag}.Pv", f"{tag}.Status", tag) if c in df.columns), None)
        if source is None:
            raise KeyError(f"no column for tag {tag!r}")
        text = F.regexp_replace(F.col(f"`{source}`").cast("string"), r"(?i)bad\s*input", "")
        chosen.append(F.trim(text).try_cast("double").alias(tag))
    return df.select(*[F.col(f"`{c}`") for c in keep], *chosen)


def concat_files(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of files with the same columns, matched by name."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out
