"""Tables that several steps read, kept where every executor finds them again."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cartlens.session import delete, shared_folder

# Rows of one Arrow batch. A batch of whole texts lies in memory three times: as rows, as the JVM's buffers, and in the worker.
ROWS_PER_BATCH = 1000
# Bytes of one Arrow batch; a longer row is a batch of its own.
BYTES_PER_BATCH = 16_000_000


def bound_batches(spark: SparkSession) -> None:
    """Let the session send at most ROWS_PER_BATCH rows at once to a Python worker; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


_recorders: list[list[str]] = []


def new_folder(spark: SparkSession, what: str) -> str:
    """An unused folder in the shared one."""
    folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    for made in _recorders:
        made.append(folder)
    return folder


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that are named inside."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def kept(df: DataFrame, what: str) -> DataFrame:
    """`df` written once as Parquet and read back: later steps read its columns
    from the shared folder, whatever executor is lost."""
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete what `kept` wrote for each of the frames, which have had their last reader."""
    for df in frames:
        for place in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            delete(df.sparkSession, place)


def sweep(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints of frames that nobody holds any more.

    Spark deletes them when the driver's garbage collection finds their frames unused, which a driver with much free memory puts
    off while the executors' disks fill."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, Python workers get batches of at most ROWS_PER_BATCH rows and BYTES_PER_BATCH bytes; then the session is as before."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS_PER_BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES_PER_BATCH}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, most in wanted.items():
        if before[key] is None or not before[key].isdigit() or not 0 < int(before[key]) <= most:
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
