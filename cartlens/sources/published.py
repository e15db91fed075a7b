"""A sales table whose days change all at once.

Layout below the table's folder:

  <part>/load=<id>/purchase_date=<day>/*.parquet   rows that one load wrote, never changed afterwards
  manifests/<number>                               one line "<day> <load> <rows>" for every day of the table

A load writes its rows to folders of its own. It becomes visible with one rename of a file with the next number, which fails if
there is such a file already. A reader takes the last manifest and reads the folders it names, so it sees the days of one
version, whole, while loads come and go; a load that stops at any point before the rename has changed nothing. A load that
finds a newer version than it started from stops with StaleLoad and is to be run again.

Besides the rows, `sales`, a table can keep further parts that are made from the rows of one day each. They are written by the same
load from the rows that it has just stored, so they change with their days in the same rename.

The rename must not replace files: HDFS and Hadoop's other file systems with a FileContext of their own keep to that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.sources.schema import SALES

DIGITS = 20


class StaleLoad(RuntimeError):
    """Another load was published since this one started."""


@dataclass(frozen=True)
class Version:
    """The load and the number of rows of every day of the table."""

    number: int = 0
    days: Mapping[date, tuple[str, int]] = field(default_factory=dict)

    def within(self, start: date | None, end: date | None) -> dict[date, str]:
        """The loads of the days from `start` up to, but not including, `end`."""
        return {
            day: load
            for day, (load, _) in self.days.items()
            if (start is None or start <= day) and (end is None or day < end)
        }


@dataclass(frozen=True)
class Part:
    """Rows made from the sales of single days: the schema with purchase_date, and how they are made."""

    schema: T.StructType
    build: Callable[[DataFrame], DataFrame]


class PublishedSales:
    def __init__(self, spark: SparkSession, path: str, parts: Mapping[str, Part] | None = None):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), dict(parts or {})

    # Reading

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        files, folder = _file_system(spark, f"{path}/manifests")
        return files.exists(folder)

    def numbers(self) -> list[int]:
        """The numbers of all versions that can still be read."""
        files, folder = _file_system(self.spark, f"{self.path}/manifests")
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(name) for name in names if name.isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, the last one by default; a table without any is version 0."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return Version()
        text = self._read_text(f"{self.path}/manifests/{number:0{DIGITS}}")
        lines = [line.split(" ") for line in text.splitlines()]
        return Version(number, {date.fromisoformat(day): (load, int(rows)) for day, load, rows in lines})

    def read(
        self,
        start: date | None = None,
        end: date | None = None,
        part: str = "sales",
        version: Version | None = None,
    ) -> DataFrame:
        """The rows of one version. Only the folders of the days from `start` up to `end` are listed and read."""
        days = (version or self.version()).within(start, end)
        schema = self._schema(part)
        if not days:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{part}/load={load}/purchase_date={day}" for day, load in sorted(days.items())]
        return self._reader(part).parquet(*paths).select(*schema.names)

    def load_range(self, version: Version | None = None) -> DataFrame:
        """First day, last day and row count of the table, from the manifest alone."""
        days = (version or self.version()).days
        row = min(days, default=None), max(days, default=None), sum(rows for _, rows in days.values())
        return self.spark.createDataFrame([row], "min_date date, max_date date, rows_count bigint")

    def rows_per_day(self, start: date, end: date, version: Version | None = None) -> DataFrame:
        """Row count of every day with rows, from the manifest alone."""
        found = version or self.version()
        rows = [(day, found.days[day][1]) for day in sorted(found.within(start, end))]
        return self.spark.createDataFrame(rows, "purchase_date date, rows_count bigint")

    def _schema(self, part: str) -> T.StructType:
        return SALES if part == "sales" else self.parts[part].schema

    def _reader(self, part: str):
        schema = T.StructType([*self._schema(part).fields, T.StructField("load", T.StringType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}")

    # Writing

    def replace(self, sales: DataFrame, started: Version | None = None) -> Version:
        """Replace exactly the days that occur in `sales`. `started` is the version on which the choice of rows rests."""
        started = started or self.version()
        load = self.stage(sales)
        days = self.staged_days(load)
        if not days:
            return started
        return self.publish(Version(started.number + 1, {**started.days, **days}))

    def stage(self, sales: DataFrame) -> str:
        """Write the rows and what is made of them, still invisible; returns the load."""
        load = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"
        self._write(sales, "sales", load)
        for name, part in self.parts.items():
            stored = self._reader("sales").parquet(f"{self.path}/sales/load={load}").select(*SALES.names)
            self._write(part.build(stored), name, load)
        return load

    def _write(self, rows: DataFrame, part: str, load: str) -> None:
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self._schema(part).fields])
        sales_files(typed.hint("rebalance", "purchase_date")).parquet(f"{self.path}/{part}/load={load}")

    def staged_days(self, load: str) -> dict[date, tuple[str, int]]:
        """The days that a load has written, with their row counts, which come from the footers of its files."""
        stored = self._reader("sales").parquet(f"{self.path}/sales/load={load}")
        counts = stored.groupBy("purchase_date").agg(F.count("*").alias("n")).collect()
        return {row["purchase_date"]: (load, row["n"]) for row in counts}

    def publish(self, new: Version) -> Version:
        """Make `new` the version that readers find."""
        lines = [f"{day} {load} {rows}\n" for day, (load, rows) in sorted(new.days.items())]
        coming = f"{self.path}/manifests/_coming-{uuid.uuid4().hex}"
        self._write_text(coming, "".join(lines))
        self._rename(coming, f"{self.path}/manifests/{new.number:0{DIGITS}}")
        return new

    def vacuum(self, keep: int = 2, hours: float = 24) -> list[str]:
        """Delete what none of the last `keep` versions names: older manifests, and loads that were last changed `hours`
        ago, so that those still at work stay. Returns the loads. Readers of an older version lose their files."""
        numbers = self.numbers()
        named = {load for n in numbers[-keep:] for load, _ in self.version(n).days.values()}
        files, folder = _file_system(self.spark, f"{self.path}/manifests")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for number in numbers[:-keep]:
            files.delete(path(folder, f"{number:0{DIGITS}}"), False)
        latest = datetime.now(timezone.utc).timestamp() * 1000 - hours * 3_600_000
        gone = set()
        for part in ("sales", *self.parts):
            top = path(f"{self.path}/{part}")
            for status in files.listStatus(top) if files.exists(top) else ():
                load = status.getPath().getName().removeprefix("load=")
                if load not in named and status.getModificationTime() <= latest:
                    files.delete(status.getPath(), True)
                    gone.add(load)
        return sorted(gone)

    # Files

    def _read_text(self, name: str) -> str:
        files, path = _file_system(self.spark, name)
        stream = files.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        files, path = _file_system(self.spark, name)
        files.mkdirs(path.getParent())
        stream = files.create(path, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _rename(self, source: str, target: str) -> None:
        """Move a file to a name that nothing has yet."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(target)
        context = hadoop.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(hadoop.Path(source), path, options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                raise StaleLoad(f"{target} is there already; run the load again") from None
            raise


def sales_files(rows: DataFrame) -> DataFrameWriter:
    """A writer of one folder per day. Files with products are sorted by product, so that row groups hold short ranges of them, and
    have Bloom filters on product_id: who looks for a few products reads few row groups."""
    if "product_id" not in rows.columns:
        return rows.write.partitionBy("purchase_date")
    return (
        rows.sortWithinPartitions("purchase_date", "product_id")
        .write.partitionBy("purchase_date")
        .option("parquet.bloom.filter.enabled#product_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
    )


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
