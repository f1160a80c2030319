"""Card transactions derived from the ``events`` table.

The events of 30 days are compressed 300 times, into 2 h 24 min, to be dense enough for windows of
minutes; the other columns follow from the event's id, user, type, value and props.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.schemas import TRANSACTION

# Fixed values of the mapping.
ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
COMPRESSION = 300
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions plus ``raw_time``, the uncompressed time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "*", "cast(get_json_object(props, '$.k') as int) as k", "cast(ts as timestamp) as raw_time"
    )
    return events.selectExpr(
        "cast(event_id as string) as txn_id",
        "'CARD-' || user_id as card_id",
        "'ACC-' || user_id as account_id",
        "if(k % 3 = 0, cast(floor(value * 200 / 1000) * 1000 as double), round(value * 200, 2)) as amount",
        "'INR' as currency",
        "if(k = 98, null, 'MER-' || (event_id * 7919 % 50)) as merchant_id",
        "event_type as merchant_cat",
        "'TRM-' || (user_id - user_id % 8 + k % 8) as terminal_id",
        "case when k = 99 then null when k < 90 then 'IN' when k < 95 then 'AE' else 'US' end as country",
        "cast(null as string) as city",
        "case event_type when 'purchase' then 'PURCHASE' when 'signup' then 'TRANSFER' else 'WITHDRAWAL' end as txn_type",
        "case k % 4 when 0 then 'ATM' when 1 then 'POS' when 2 then 'ONLINE' else 'MOBILE' end as channel",
        "if(event_type = 'error', 'DECLINED', 'APPROVED') as txn_status",
        f"timestamp_micros({ORIGIN_US} + (unix_micros(raw_time) - {ORIGIN_US}) div {COMPRESSION}) as event_time",
        "raw_time",
    )


def messages(txns: DataFrame) -> DataFrame:
    """The transactions as source records (``value``, ``timestamp``), two in fifty unparseable."""
    ordinal = F.col("txn_id").cast("long") % 50
    body = F.to_json(F.struct(*TRANSACTION.fieldNames()), {"timestampFormat": TIME_FORMAT})
    return txns.select(
        F.col("card_id").alias("key"),
        F.when(ordinal == 0, "not json").when(ordinal == 1, '{"amount":1}').otherwise(body).alias("value"),
        F.col("event_time").alias("timestamp"),
        "txn_id",
    )
