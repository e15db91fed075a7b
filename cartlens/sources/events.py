"""The `events` table seen as day deliveries of the sales source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def day_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Landed records with their delivery `date`.

    The source closes its day at 23:00, so later events come with the next
    day's delivery and carry a stray date. A value of zero is sent as the text
    'n/a' and spoils the delivery it is in.
    """
    events = spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")
    return events.selectExpr(
        "cast(ts + interval 1 hour as date) as date",
        "user_id as client_id",
        "left(event_type, 1) as gender",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") as purchase_datetime",
        "hour(ts) * 3600 + minute(ts) * 60 + cast(floor(second(ts)) as int)"
        " as purchase_time_as_seconds_from_midnight",
        "cast(get_json_object(props, '$.k') as bigint) as product_id",
        "1 as quantity",
        "if(value = 0, 'n/a', cast(cast(floor(value + 0.5D) as int) as string)) as price_per_item",
        "0 as discount_per_item",
        "value as total_price",
        "event_type",
    )
