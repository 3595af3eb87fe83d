"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set what results depend on: UTC days, and adaptive plans for skew."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cpus: int | str = "*", app: str = "tablescope") -> SparkSession:
    """Single-machine session for tests and benchmarks."""
    partitions = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="run-wh-"))
    )
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors see: the one named in ``spark.checkpoint.dir``.

    Where none is set, a folder of its own serves a local master; on a cluster
    that would be one machine's disk, so it is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    master = context.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    folder = tempfile.mkdtemp(prefix="run-shared-")
    context.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to several tasks a core.

    A file of one row group is read by one task; where a narrow row causes much
    work afterwards, moving it first is cheap.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def stored(df: DataFrame) -> DataFrame:
    """An intermediate result that several jobs read, written once as Parquet.

    Readers get only the columns and rows they ask for, and nothing is lost
    with an executor.  The files stay until the shared folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
