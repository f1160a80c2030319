"""Input and output contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(ddl: dict[str, T.DataType], required: set[str]) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in ddl.items()])


_S, _D, _I, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()

# Fixed field names and types of a transaction message.
TRANSACTION = _struct(
    {
        "txn_id": _S,
        "card_id": _S,
        "account_id": _S,
        "amount": _D,
        "currency": _S,
        "merchant_id": _S,
        "merchant_cat": _S,
        "terminal_id": _S,
        "country": _S,
        "city": _S,
        "txn_type": _S,
        "channel": _S,
        "txn_status": _S,
        "event_time": _TS,
    },
    required={"txn_id", "card_id", "amount", "event_time"},
)

# Fixed field names and types of an alert.
ALERT = _struct(
    {
        "card_id": _S,
        "window_start": _TS,
        "window_end": _TS,
        "txn_count": _I,
        "total_amount": _D,
        "rule_triggered": _S,
        "risk_score": _I,
        "alert_time": _TS,
    },
    required={
        "card_id",
        "window_start",
        "window_end",
        "txn_count",
        "total_amount",
        "rule_triggered",
        "risk_score",
        "alert_time",
    },
)

# What every rule returns; alert_time is stamped on streams, alert_id on merged alerts.
ALERT_COLUMNS = [f.name for f in ALERT.fields if f.name != "alert_time"]


def to_alert_contract(df: DataFrame, closing: bool = False) -> DataFrame:
    """Exactly the alert columns, in order and with the contract's types (and ``closes_at`` where asked for)."""
    types = {f.name: f.dataType for f in ALERT.fields}
    more = ["closes_at"] if closing else []  # uncast, for its watermark
    return df.select(*[F.col(c).cast(types[c]).alias(c) for c in ALERT_COLUMNS], *more)


def with_instant_event_time(df: DataFrame) -> DataFrame:
    """Read a zone-less ``event_time`` as UTC; a column that is already an instant stays untouched.

    The column is only replaced when needed because replacing it would lose a watermark.
    """
    if isinstance(df.schema["event_time"].dataType, T.TimestampNTZType):
        return df.withColumn("event_time", F.col("event_time").cast("timestamp"))
    return df
