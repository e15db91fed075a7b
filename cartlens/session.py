"""Session settings and the folder that every executor can reach."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cartlens", **conf) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings win elsewhere."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables.

    A cluster names it in `spark.checkpoint.dir`, or a program with `setCheckpointDir`.
    Only a local master may fall back to a temporary folder, because there every
    task runs on this machine.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = spark.conf.get("cartlens.shared.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="cartlens-")
        owner = os.getpid()
        atexit.register(lambda: os.getpid() == owner and shutil.rmtree(folder, ignore_errors=True))
        spark.conf.set("cartlens.shared.dir", folder)
    return folder


def freeze(df: DataFrame) -> DataFrame:
    """Compute `df` once and cut its lineage, so that later steps neither rescan
    the fact table nor lose the rows with an executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def store(df: DataFrame, folder: str) -> DataFrame:
    """Like `freeze`, as Parquet in a folder of its own: a later step reads the columns it needs."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder, wherever it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
