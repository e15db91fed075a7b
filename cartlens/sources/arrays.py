"""JSON arrays read by many tasks.

A file that holds one array of objects, on one line or on many, is read as text that is cut at every closing brace. Spark splits such
a file by bytes, so a piece of text knows neither whether it begins inside a string nor how many braces are open. Both follow from the pieces
before it: quotes switch between inside and outside, so the state of a piece is a parity of quotes, and the depth is a sum that depends on that
state. Each piece tells its quotes and its braces for both states, each byte range adds them up, a running
sum over the ranges of a file (one row each) gives the state at the start of every range, and the sums inside a range do the rest.
An escape never crosses a cut, since it would use up the brace.

Most objects are one piece. Those with braces in strings or with nested objects are several, put together by the place of the first,
also across ranges. No row holds more than one object of the array.

A file must be '[', objects with ',' between them, and ']'. An object that cannot be parsed gives a row with _corrupt_record, and so does a file of
another form; an empty file has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IN_ORDER = ("range", "row")


def _pieces(spark: SparkSession, paths: list[str], base: str, partitions: str) -> DataFrame:
    """file, range (its first byte), row (in the order of a range), text without the closing brace, and the folder's columns."""
    reader = spark.read.schema(f"value string, {partitions}").option("basePath", base).option("lineSep", "}")
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("text"),
        *[x.split(" ")[0] for x in partitions.split(", ")],
    )


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def _told(pieces: DataFrame) -> DataFrame:
    """Adds `quotes` (0 or 1) and the braces opened outside of strings if the piece begins outside (`out`) or inside (`ins`) of one."""
    plain = F.regexp_replace("text", r"(?s)\\(.|$)", "")
    strings = r'(?s)"[^"]*("|$)'
    after_first = F.when(plain.contains('"'), F.regexp_replace(plain, r'(?s)^[^"]*"', "")).otherwise(F.lit(""))
    return pieces.withColumns(
        {
            "quotes": (_count(plain, '"') % 2).cast("int"),
            "out": _count(F.regexp_replace(plain, strings, ""), "{"),
            "ins": _count(F.regexp_replace(after_first, strings, ""), "{"),
        }
    )


def _in_range(told: DataFrame) -> DataFrame:
    """Adds `upto`: the parity of the quotes before a piece in its range."""
    earlier = Window.partitionBy("file", "range").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return told.withColumn("upto", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)


def _delta(state: Column) -> Column:
    """What a piece and the brace behind it add to the depth, if it begins in this state (1: inside a string)."""
    closes = F.when((state + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    return F.when(state == 0, F.col("out")).otherwise(F.col("ins")) - closes


def _starts(told: DataFrame) -> DataFrame:
    """State and depth at the start of every range of every file."""
    ranges = (
        _in_range(told.drop("text"))
        .groupBy("file", "range")
        .agg(
            (F.sum("quotes") % 2).alias("quotes"),
            F.sum(_delta(F.col("upto"))).alias("out"),
            F.sum(_delta(1 - F.col("upto"))).alias("ins"),
        )
    )
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn("state", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
        .withColumn("adds", F.when(F.col("state") == 0, F.col("out")).otherwise(F.col("ins")))
        .withColumn("depth", F.coalesce(F.sum("adds").over(earlier), F.lit(0)))
        .select("file", "range", "state", "depth")
    )


def read_arrays(spark: SparkSession, paths: list[str], base: str, fields: T.StructType, partitions: str) -> DataFrame:
    """The objects of all array files below `paths`: `fields`, _corrupt_record and the columns of the folders."""
    folders = [x.split(" ")[0] for x in partitions.split(", ")]
    told = _told(_pieces(spark, paths, base, partitions))
    inside = Window.partitionBy("file", "range").orderBy("row")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        _in_range(told)
        .join(_starts(told).toDF("file", "range", "state", "begins"), ["file", "range"])
        .withColumn("state", (F.col("state") + F.col("upto")) % 2)
        .withColumn("delta", _delta(F.col("state")))
        .withColumn("after", F.col("begins") + F.sum("delta").over(upto))
        .withColumn("before", F.col("after") - F.col("delta"))
    )
    # Between objects the depth is 0; what follows the last object has no brace behind it, and so seems to close one too many.
    first = (F.col("before") == 0) & (F.col("state") == 0)
    last = (F.col("after") <= 0) & ((F.col("state") + F.col("quotes")) % 2 == 0)
    marked = placed.select(
        "file", "range", "row", "text", *folders, first.alias("first"), last.alias("last"), (F.col("after") < 0).alias("rest")
    )
    whole = marked.where("first and last").select("file", "range", "row", *folders, "rest", "text")
    # Pieces of the others belong to the last first piece up to them, which may stand in an earlier range.
    parts = marked.where("not (first and last)").withColumn("here", F.max(F.when(F.col("first"), F.col("row"))).over(upto))
    open_ = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        parts.groupBy("file", "range")
        .agg(F.max("here").alias("own"))
        .withColumn("own", F.when(F.col("own").isNotNull(), F.struct("range", F.col("own").alias("row"))))
        .withColumn("carried", F.last("own", ignorenulls=True).over(open_))
        .select("file", "range", "carried")
    )
    joined = (
        parts.join(carried, ["file", "range"])
        .withColumn("start", F.coalesce(F.when(F.col("here").isNotNull(), F.struct("range", F.col("here").alias("row"))), "carried"))
        .groupBy("file", "start", *folders)
        .agg(F.sort_array(F.collect_list(F.struct("range", "row", "text"))).alias("pieces"), F.bool_or("rest").alias("rest"))
        .select(
            "file", F.col("pieces")[0]["range"].alias("range"), F.col("pieces")[0]["row"].alias("row"), *folders, "rest",
            F.expr("array_join(transform(pieces, x -> x.text), '}')").alias("text"),
        )
    )
    found = whole.unionByName(joined).withColumn("sign", F.regexp_extract("text", r"(?s)^\s*([\[,])\s*\{", 1))
    schema = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    json = F.concat(F.regexp_replace("text", r"(?s)^\s*[\[,]\s*", ""), F.lit("}"))
    parsed = F.from_json(json, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    objects = (
        found.where("not rest")
        .withColumn("object", parsed)
        .select(
            *[F.col(f"object.{f.name}").alias(f.name) for f in fields.fields],
            F.when(F.col("sign") == "", F.col("text")).otherwise(F.col("object._corrupt_record")).alias("_corrupt_record"),
            *folders,
        )
    )
    ends = F.col("rest") & F.col("text").rlike(r"(?s)^\s*(\[\s*)?\]\s*$")
    alone = F.col("rest") & F.col("text").rlike(r"(?s)^\s*\[\s*\]\s*$")
    opened = (F.col("sign") == "[") | alone
    files = (
        found.groupBy("file", *folders)
        .agg(
            F.count_if(ends).alias("ends"),
            F.count_if("rest").alias("rests"),
            F.count_if(opened).alias("opened"),
            F.min_by(opened, F.struct(*IN_ORDER)).alias("begins"),
            F.max_by("rest", F.struct(*IN_ORDER)).alias("stops"),
        )
        .where("not (ends = 1 and rests = 1 and opened = 1 and begins and stops)")
    )
    broken = files.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields.fields], F.concat(F.lit("not an array: "), "file").alias("_corrupt_record"), *folders
    )
    return objects.unionByName(broken)
