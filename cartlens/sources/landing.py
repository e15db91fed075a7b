"""Landed day files and their load into the sales table.

Layout: `<landing>/date=YYYY-MM-DD/drop=<id>/*.json`. One drop is one complete
delivery of a day, moved in as one folder; a day sent again gets a higher drop id. Ids are
compared as numbers where they are numbers, else as text (numbers win). Files hold
JSON lines, or one JSON array each with `array=True`.

Rules, per requested day:
- the newest drop without a bad row replaces all stored rows of the day;
- a day whose drops all have bad rows is reported as failed and keeps its old rows;
- a day without rows is reported as empty and keeps its old rows;
- rows that carry another date than the requested one are kept out.

The write is one job over many days. With a PublishedSales as the table, all days of a load change at once or not at all, and
a load that another one has overtaken stops. With a plain folder it is not a transaction, neither across days nor for one: a
crash between the removal of a day's old files and the move of its new ones loses the day until the
load is run again, which restores it from the landing; two loads of the same day must not run at once there.
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.session import freeze, shared_folder
from cartlens.sources.arrays import read_arrays
from cartlens.sources.published import PublishedSales
from cartlens.sources.sales import write_sales
from cartlens.sources.schema import LANDED, LANDED_FIELDS, RECORD, SALES

# Number ranges of the stored columns.
WHOLE_NUMBERS = {
    "client_id": "bigint",
    "purchase_time_as_seconds_from_midnight": "int",
    "product_id": "bigint",
    "quantity": "smallint",
    "price_per_item": "int",
    "discount_per_item": "int",
}


def read_landing(
    spark: SparkSession, landing: str, array: bool = False, start: date | None = None, end: date | None = None
) -> DataFrame:
    """All landed rows, or those of the days from `start` to `end`, whose folders alone are listed."""
    if start is None:
        return _rows_of(spark, landing, array, lambda day: True)
    return _rows_of(spark, landing, array, lambda day: start <= day <= end)


def read_days(spark: SparkSession, landing: str, days: set[date], array: bool = False) -> DataFrame:
    """Everything that has landed for the given days."""
    return _rows_of(spark, landing, array, days.__contains__)


def _rows_of(spark: SparkSession, landing: str, array: bool, wanted) -> DataFrame:
    paths = [f"{landing}/{name}" for name, day in _day_folders(spark, landing) if wanted(day)]
    if not paths:
        return spark.createDataFrame([], LANDED)
    if array:
        return read_arrays(spark, paths, landing, RECORD, "date date, drop string").select(*LANDED.names)
    return _reader(spark.read).option("basePath", landing).json(paths)


def _day_folders(spark: SparkSession, landing: str) -> list[tuple[str, date]]:
    """Names and days of the folders directly below the landing."""
    files, path = _file_system(spark, landing)
    found = []
    for status in files.listStatus(path) if files.exists(path) else ():
        name = status.getPath().getName()
        if name.startswith("date="):
            found.append((name, date.fromisoformat(name.removeprefix("date="))))
    return found


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stream_landing(spark: SparkSession, landing: str, array: bool = False) -> DataFrame:
    # A batch of arrays only tells which days are touched, so the files need not be parsed.
    if array:
        return spark.readStream.schema("value string, date date, drop string").text(landing)
    return _reader(spark.readStream).json(landing)


def _reader(reader):
    return (
        reader.schema(LANDED)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    )


def land(rows: DataFrame, landing: str, drop: str) -> None:
    """Write rows that have a `date` column as one drop per day."""
    coming = f"{landing}/_coming-{uuid.uuid4().hex}"
    (
        rows.select(*LANDED_FIELDS, "date", F.lit(drop).alias("drop"))
        .hint("rebalance", "date")
        .write.partitionBy("date", "drop")
        .json(coming)
    )
    _move_in(rows.sparkSession, coming, landing)


def land_arrays(rows: DataFrame, landing: str, drop: str) -> None:
    """Like `land`, with the whole day in one file that holds one JSON array, which one task writes object by object."""
    coming = f"{landing}/_coming-{uuid.uuid4().hex}"
    day = Window.partitionBy("date").orderBy("json")
    begins = F.when(F.row_number().over(day) == 1, "[").otherwise(",")
    ends = F.when(F.lead("json").over(day).isNull(), "]").otherwise("")
    (
        rows.select("date", F.to_json(F.struct(*LANDED_FIELDS)).alias("json"))
        .select("date", F.lit(drop).alias("drop"), F.concat(begins, "json", ends).alias("value"))
        .write.partitionBy("date", "drop")
        .text(coming)
    )
    _move_in(rows.sparkSession, coming, landing)


def _move_in(spark: SparkSession, coming: str, landing: str) -> None:
    """Move every drop from a hidden folder into place, as one folder where the drop is new."""
    files, hidden = _file_system(spark, coming)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for day in files.listStatus(hidden):
        if not day.isDirectory():
            continue
        target_day = path(f"{landing}/{day.getPath().getName()}")
        files.mkdirs(target_day)
        for drop in files.listStatus(day.getPath()):
            target = path(target_day, drop.getPath().getName())
            if not files.exists(target):
                files.rename(drop.getPath(), target)
                continue
            for part in files.listStatus(drop.getPath()):
                files.rename(part.getPath(), path(target, part.getPath().getName()))
    files.delete(hidden, True)


def typed(landed: DataFrame) -> DataFrame:
    """Typed sales rows plus `date`, `drop` and `good` (every value was usable).

    Whole numbers drop a fraction, as 2.7 becomes 2. Only the gender and the
    total may be missing.
    """
    columns = {
        name: F.col(name).try_cast("decimal(38,10)").try_cast(kind)
        for name, kind in WHOLE_NUMBERS.items()
    }
    day = F.col("purchase_datetime").try_cast("timestamp_ntz").cast("date")
    total = F.col("total_price").try_cast("decimal(18,2)")
    good = F.col("_corrupt_record").isNull() & day.isNotNull()
    for column in columns.values():
        good = good & column.isNotNull()
    good = good & (F.coalesce(F.length("gender"), F.lit(0)) <= 1)
    good = good & (total.isNotNull() | F.col("total_price").isNull())
    values = {**columns, "gender": F.col("gender"), "purchase_date": day, "total_price": total}
    fields = [values[f.name].cast(f.dataType).alias(f.name) for f in SALES.fields]
    return landed.select("date", "drop", good.alias("good"), *fields)


def drop_status(staged: DataFrame) -> DataFrame:
    """One row per day with the drop to load: NULL drop where none is free of bad rows."""
    stray = F.col("good") & (F.col("purchase_date") != F.col("date"))
    per_drop = staged.groupBy("date", "drop").agg(
        F.count("*").alias("received"),
        F.count_if(~F.col("good")).alias("bad"),
        F.count_if(stray).alias("stray"),
    )
    number = F.col("drop").try_cast("decimal(38,0)").alias("number")
    usable = F.when(F.col("bad") == 0, F.struct(number, "drop", "received", "stray"))
    return (
        per_drop.groupBy("date")
        .agg(F.max(usable).alias("best"), F.max(F.struct(number, "drop", "received")).alias("newest"))
        .select(
            "date",
            F.col("best.drop").alias("drop"),
            F.coalesce("best.received", "newest.received").alias("received"),
            F.coalesce("best.stray", F.lit(0)).alias("quarantined"),
            F.coalesce(F.col("best.received") - F.col("best.stray"), F.lit(0)).alias("loaded"),
        )
        .withColumn(
            "status",
            F.when(F.col("drop").isNull(), "failed")
            .when(F.col("loaded") == 0, "quarantined")
            .otherwise("loaded"),
        )
    )


def replace_days(landed: DataFrame, table: str | PublishedSales, quarantine: str | None = None) -> DataFrame:
    """Load every day found in `landed`; returns the status per day.

    The text is parsed once into a staged copy, so that judging and writing see
    the same rows even if a file changes meanwhile.
    """
    spark = landed.sparkSession
    started = table.version() if isinstance(table, PublishedSales) else None
    folder = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    try:
        typed(landed).write.parquet(folder)
        staged = spark.read.parquet(folder)
        status = freeze(drop_status(staged))
        days = status.where("drop is not null").select("date", "drop")
        chosen = staged.join(days, ["date", "drop"], "left_semi")
        if quarantine is not None:
            (
                chosen.where(F.col("purchase_date") != F.col("date"))
                .drop("good")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("date")
                .parquet(quarantine)
            )
        rows = chosen.where(F.col("purchase_date") == F.col("date"))
        if started is None:
            write_sales(rows, table)
        else:
            table.replace(rows, started)
    finally:
        files, path = _file_system(spark, folder)
        files.delete(path, True)
    return status


def backfill(
    spark: SparkSession,
    landing: str,
    table: str | PublishedSales,
    start: date,
    end: date,
    array: bool = False,
    quarantine: str | None = None,
) -> DataFrame:
    """Load all days from `start` to `end` (both included), each on its own merits.

    Returns one row per requested day: date, received, quarantined, loaded, status.
    """
    status = replace_days(read_landing(spark, landing, array, start, end), table, quarantine)
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("received", "quarantined", "loaded")]
    return (
        requested_days(spark, start, end)
        .join(status, "date", "left")
        .select("date", *counts, F.coalesce("status", F.lit("empty")).alias("status"))
        .orderBy("date")
    )


def requested_days(spark: SparkSession, start: date, end: date) -> DataFrame:
    steps = spark.range((end - start).days + 1)
    return steps.select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))


def load_day(spark: SparkSession, landing: str, table: str | PublishedSales, day: date | None = None, **options) -> DataFrame:
    """Load one day, yesterday by default. Raises when the day could not be loaded."""
    day = day or date.today() - timedelta(days=1)
    status = backfill(spark, landing, table, day, day, **options)
    if status.first()["status"] == "failed":
        raise ValueError(f"{day}: day not loaded, its drops contain unusable rows")
    return status
