"""Daily ingest as a stream of newly landed drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartlens.sources.landing import read_days, replace_days, stream_landing
from cartlens.sources.published import PublishedSales


def start_daily_ingest(
    spark: SparkSession,
    landing: str,
    table: str | PublishedSales,
    checkpoint: str,
    status: str | None = None,
    array: bool = False,
    quarantine: str | None = None,
) -> StreamingQuery:
    """Load all days for which something landed since the last run, then stop.

    A batch only tells which days are touched. These are read again in full, so a
    drop that is seen in two batches is loaded whole, and an older drop that comes late
    does not replace a newer one: the table ends as `backfill` would leave it. A batch
    that is run again replaces the same days and the same status folder.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        touched = {row["date"] for row in batch.select("date").distinct().collect()}
        days = replace_days(read_days(spark, landing, touched, array), table, quarantine)
        if status is not None:
            (
                days.withColumn("batch", F.lit(batch_id))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch")
                .parquet(status)
            )

    return (
        stream_landing(spark, landing, array)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
