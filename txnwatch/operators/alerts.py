"""Operators on alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed score limits of the triage tiers.
BLOCK_FROM = 90
REVIEW_FROM = 70


def alert_slot(bucket_seconds: int = 3600) -> Column:
    """What of the start time goes into the alert id.

    Alerts on single rows keep their exact time. Overlapping windows of one burst share an id as
    long as they start in the same bucket.
    """
    bucket = F.floor(F.unix_timestamp("window_start") / bucket_seconds)
    on_row = F.col("window_end") <= F.col("window_start")
    return F.when(on_row, F.col("window_start").cast("string")).otherwise(bucket.cast("string"))


def with_alert_id(alerts: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Add ``alert_id``, the same for the same card, rule and time slot in every run.

    The slot is text in the session's time zone, so sessions must agree on it (UTC).
    """
    if bucket_seconds <= 0:
        raise ValueError("bucket_seconds must be positive")
    return alerts.withColumn(
        "alert_id", F.md5(F.concat_ws("|", "card_id", "rule_triggered", alert_slot(bucket_seconds)))
    )


def alert_triage(alerts: DataFrame) -> DataFrame:
    """Add ``triage``: block, review or monitor, by score."""
    score = F.col("risk_score")
    tier = F.when(score >= BLOCK_FROM, "block").when(score >= REVIEW_FROM, "review").otherwise("monitor")
    return alerts.withColumn("triage", tier)


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """One alert per ``alert_id``: the earliest window, then the smallest of the other columns.

    A plain ``dropDuplicates`` would keep whichever came first in that run. Taking a minimum
    reduces every task's alerts before the shuffle, so many copies of one id do no harm.
    """
    order = ["window_start", "window_end"]
    rest = [c for c in alerts.columns if c not in order + ["alert_id"]]
    return (
        alerts.groupBy("alert_id")
        .agg(F.min(F.struct(*order, *rest)).alias("first"))
        .select("alert_id", "first.*")
        .select(*alerts.columns)
    )


def first_alerts(alerts: DataFrame, within: str = "2 hours", time_column: str = "window_start") -> DataFrame:
    """One alert per ``alert_id`` on a stream, for sinks that have no table to look into.

    Only ids younger than the watermark are remembered. Alerts of one id start less than
    ``bucket_seconds`` apart, so with ``within`` at least that long an alert whose id is forgotten is
    itself behind the watermark and dropped: no id passes twice, across restarts as well. An alert that
    comes later than ``within`` behind the newest one is dropped whether or not its id was seen.
    """
    return alerts.withWatermark(time_column, within).dropDuplicatesWithinWatermark(["alert_id"])


def card_risk_rollup(alerts: DataFrame) -> DataFrame:
    """All signals on a card together; there are only twelve rules, so their set stays small."""
    fired = F.collect_set("rule_triggered")
    return alerts.groupBy("card_id").agg(
        F.size(fired).alias("rules_fired"),
        F.array_join(F.sort_array(fired), ",").alias("rules"),
        F.count(F.lit(1)).alias("alerts"),
        F.max("risk_score").alias("max_risk"),
        F.sum("risk_score").alias("risk_sum"),
        F.min("window_start").alias("first_seen"),
        F.max("window_end").alias("last_seen"),
    )


def card_risk_by_period(alerts: DataFrame, period: str = "1 day", time_column: str = "closes_at") -> DataFrame:
    """``card_risk_rollup`` per card and period of the alerts' time; also on streams, once a period is over.

    On the streams of ``evaluate(.., closing=True)`` this is an aggregation of aggregations: ``closes_at``
    carries their watermark on. An alert belongs to the period in which its window (or row) closes.
    """
    fired = F.collect_set("rule_triggered")  # at most as many values as there are rules
    return (
        alerts.groupBy(F.window(time_column, period).alias("period"), "card_id")
        .agg(
            F.size(fired).alias("rules_fired"),
            F.array_join(F.sort_array(fired), ",").alias("rules"),
            F.count(F.lit(1)).alias("alerts"),
            F.max("risk_score").alias("max_risk"),
            F.sum("risk_score").alias("risk_sum"),
            F.min("window_start").alias("first_seen"),
            F.max("window_end").alias("last_seen"),
        )
        .select(F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), "*")
        .drop("period")
    )


def alerts_by_rule(alerts: DataFrame, rule: str, until: Column | str, days: int = 7) -> DataFrame:
    """Alerts of one rule from the ``days`` before ``until``.

    On a table written with ``streaming.sinks`` or ``streaming.jobs`` only that rule's partition
    is read.
    """
    until = F.to_timestamp(F.lit(until)) if isinstance(until, str) else until
    start = F.col("window_start")
    return alerts.where(
        (F.col("rule_triggered") == rule)
        & (start >= until - F.make_dt_interval(F.lit(days)))
        & (start < until)
    )


def _latency() -> Column:
    """Seconds from the end of the window (or the transaction) to detection."""
    return (F.unix_micros("alert_time") - F.unix_micros("window_end")) / 1_000_000


def detection_latency(alerts: DataFrame) -> DataFrame:
    """Seconds to detection, per rule.

    ``median_seconds`` is approximate for rules with many alerts: its rank is off by at most one in 10,000
    (the accuracy that ``percentile_approx`` has unless told otherwise), and exact below that many alerts.
    """
    return (
        alerts.select("rule_triggered", _latency().alias("latency"))
        .groupBy("rule_triggered")
        .agg(
            F.count(F.lit(1)).alias("alerts"),
            F.avg("latency").alias("avg_seconds"),
            F.percentile_approx("latency", 0.5).alias("median_seconds"),
            F.max("latency").alias("max_seconds"),
        )
    )


# Size of a latency sketch, and the error in rank (a share of all alerts) that its quantiles keep with 99 % chance.
SKETCH_SIZE = 400
SKETCH_RANK_ERROR = 0.01


def latency_sketches(alerts: DataFrame) -> DataFrame:
    """What latency quantiles need, per rule and day of the window's end: a few kilobytes, however many alerts.

    Rows of this form are kept as a table, one day added at a time, and merged when asked.
    """
    day = F.to_date("window_end").alias("alert_day")
    return (
        alerts.select("rule_triggered", day, _latency().alias("latency"))
        .groupBy("rule_triggered", "alert_day")
        .agg(
            F.count("latency").alias("alerts"),
            F.sum("latency").alias("total_seconds"),
            F.max("latency").alias("max_seconds"),
            F.kll_sketch_agg_double("latency", SKETCH_SIZE).alias("sketch"),
        )
    )


def merged_latency(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Latency per rule over all the days of ``sketches``; counts, means and maxima are exact.

    A quantile's true rank differs from the one asked for by at most ``SKETCH_RANK_ERROR`` of all alerts, with a
    chance of 99 %, whether sketches were merged or made in one pass; it is exact while a rule has fewer alerts
    than the sketch keeps.
    """
    merged = sketches.groupBy("rule_triggered").agg(
        F.sum("alerts").alias("alerts"),
        (F.sum("total_seconds") / F.sum("alerts")).alias("avg_seconds"),
        F.max("max_seconds").alias("max_seconds"),
        F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"),
    )
    ranks = {q: f"p{q * 100:g}_seconds".replace(".", "_") for q in quantiles}
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for q, name in ranks.items()]
    return merged.select("rule_triggered", "alerts", "avg_seconds", "max_seconds", *at)
