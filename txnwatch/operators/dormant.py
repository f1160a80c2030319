"""The list of dormant cards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_activity(history: DataFrame, as_of: Column, time_column: str = "event_time") -> DataFrame:
    """Per card the time of its last activity before ``as_of``, reduced before the shuffle."""
    at = F.col(time_column).cast("timestamp")
    return history.where(at < as_of).groupBy("card_id").agg(F.max(at).alias("last_activity"))


def merged_activity(state: DataFrame, day: DataFrame) -> DataFrame:
    """Last activities with those of one more day; any day may be merged again, and in any order.

    A join on the card, not an aggregation of both: where ``state`` is bucketed by card only the day is
    shuffled. Rows without a card belong to no list and are left out.
    """
    later = F.greatest(F.col("s.last_activity"), F.col("d.last_activity"))
    known, new = state.where("card_id is not null").alias("s"), day.where("card_id is not null").alias("d")
    joined = known.join(new, F.col("s.card_id") == F.col("d.card_id"), "full_outer")
    return joined.select(F.coalesce("s.card_id", "d.card_id").alias("card_id"), later.alias("last_activity"))


def dormant_list(
    history: DataFrame, as_of: Column | datetime | str, days: int = 30, time_column: str = "event_time"
) -> DataFrame:
    """Cards of the history whose last activity before ``as_of`` is more than ``days`` old.

    The maximum is reduced before the shuffle, one row per task and card.
    """
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return quiet_since(last_activity(history, as_of, time_column), as_of, days)


def quiet_since(activity: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The cards whose last activity is more than ``days`` before ``as_of``."""
    return activity.where(F.col("last_activity") < as_of - F.make_dt_interval(F.lit(days)))
