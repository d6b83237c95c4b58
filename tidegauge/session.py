"""Session settings, shared work folder and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A join on the series key leaves hash(series) partitioning, which Spark would
# otherwise accept for a window on (series, chunk) and so keep a hot series in
# one task. Requiring all cluster keys makes the chunk part of the exchange.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = 8, app: str = "tidegauge") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_folder(spark: SparkSession) -> str:
    """Shared folder for written intermediates, from ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster
    without it is refused, since a machine-local path is lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tidegauge-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# All intermediates of one run lie in one folder, which goes with the session.
RUN = f"run-{uuid.uuid4().hex}"
_made: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    folder = f"{work_folder(spark)}/{RUN}"
    if folder not in _made:
        _made.add(folder)
        atexit.register(_remove_at_exit, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove_work(spark: SparkSession) -> None:
    """Delete the intermediates of this run; DataFrames that read them end with it."""
    _remove(spark, f"{work_folder(spark)}/{RUN}")


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped context can't reach its file system
        _remove(spark, folder)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage: write once as Parquet and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` ahead of costly Python work.

    The exchange is the one the following grouping or window needs anyway; naming
    its size keeps it from being merged into few tasks because its bytes are few.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
