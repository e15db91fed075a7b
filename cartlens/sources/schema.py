"""Column layout of the sales table and of landed day files."""

from __future__ import annotations

from pyspark.sql import types as T

SALES = T.StructType(
    [
        T.StructField("client_id", T.LongType()),
        T.StructField("gender", T.StringType()),
        T.StructField("purchase_date", T.DateType()),
        T.StructField("purchase_time_as_seconds_from_midnight", T.IntegerType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("price_per_item", T.LongType()),
        T.StructField("discount_per_item", T.LongType()),
        T.StructField("total_price", T.DecimalType(18, 2)),
    ]
)

# Field names of a landed JSON record.
LANDED_FIELDS = (
    "client_id",
    "gender",
    "purchase_datetime",
    "purchase_time_as_seconds_from_midnight",
    "product_id",
    "quantity",
    "price_per_item",
    "discount_per_item",
    "total_price",
)

# Everything is read as text, so that one bad value is seen and judged instead of
# being nulled by the reader. `date` and `drop` come from the folder names.
RECORD = T.StructType([T.StructField(name, T.StringType()) for name in LANDED_FIELDS])
LANDED = T.StructType(
    RECORD.fields
    + [
        T.StructField("_corrupt_record", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("drop", T.StringType()),
    ]
)
