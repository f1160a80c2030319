"""Where alerts and rejected messages go.

Format and options are arguments throughout, so the same functions write to a message topic, to
files, or to memory and console while developing.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from txnwatch.operators.alerts import dedup_alerts
from txnwatch.sources.ingest import dead_letters
from txnwatch.streaming import versions

log = logging.getLogger(__name__)

# Fixed field order of an alert message.
MESSAGE_FIELDS = [
    "alert_id",
    "card_id",
    "rule_triggered",
    "risk_score",
    "txn_count",
    "total_amount",
    "window_start",
    "window_end",
    "alert_time",
]
MICROSECONDS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def alert_records(alerts: DataFrame, precise: bool = False, fields: list[str] | None = None) -> DataFrame:
    """Alerts as (key, JSON value). Times have milliseconds, or microseconds if ``precise``.

    A message has all of ``MESSAGE_FIELDS``, or the ``fields`` asked for; one that the alerts lack raises.
    """
    fields = MESSAGE_FIELDS if fields is None else fields
    missing = [f for f in fields if f not in alerts.columns]
    if missing:
        raise ValueError(f"alerts lack message fields: {missing}")
    body = F.to_json(F.struct(*fields), MICROSECONDS if precise else {})
    return alerts.select(F.col("card_id").alias("key"), body.alias("value"))


def kafka_sink_options(servers: str, topic: str, **more: str) -> dict:
    return {"kafka.bootstrap.servers": servers, "topic": topic, **more}


def publish_alerts(
    alerts: DataFrame,
    fmt: str,
    options: dict,
    checkpoint: str,
    trigger: dict | None = None,
    mode: str = "update",
    precise: bool = False,
) -> StreamingQuery:
    """Alert messages. In update mode a window is sent again whenever it changes."""
    return _start(alert_records(alerts, precise).writeStream.outputMode(mode), fmt, options, checkpoint, trigger, "10 seconds")


def store_alerts(
    alerts: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    fmt: str = "parquet",
    retention: str | None = None,
) -> StreamingQuery:
    """Alert table partitioned by rule, each window once it is complete.

    Every batch adds small files. ``streaming.compaction`` moves them into few; with ``retention`` (as "7 days")
    files older than that, which must have been compacted by then, leave the sink's list.
    """
    writer = alerts.writeStream.outputMode("append").partitionBy("rule_triggered")
    options = {"path": path, **({"retention": retention} if retention else {})}
    return _start(writer, fmt, options, checkpoint, trigger, "60 seconds")


def publish_dead_letters(
    parsed: DataFrame, fmt: str, options: dict, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Messages that are no transaction, unchanged."""
    return _start(dead_letters(parsed).writeStream.outputMode("append"), fmt, options, checkpoint, trigger, "30 seconds")


def show_alerts(
    alerts: DataFrame, checkpoint: str, trigger: dict | None = None, rows: int = 20
) -> StreamingQuery:
    """Changed alerts on the console; ``rows`` is only how many of them are printed."""
    options = {"truncate": "false", "numRows": str(rows)}
    return _start(alerts.writeStream.outputMode("update"), "console", options, checkpoint, trigger, "10 seconds")


def store_first_alerts(
    alerts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "append",
    bucket_seconds: int = 3600,
) -> StreamingQuery:
    """Alert table with one row per ``alert_id``, for consumers that act once per id.

    Ids are looked up in the table itself, not in stream state, so they are remembered for as long
    as the table is kept, and a batch that is run again after a failure finds what it already
    wrote. The table is partitioned by the bucket of time that is part of the id (``bucket_seconds``
    as given to ``all_alerts``), so equal ids lie in one partition whatever the bucket, and only the
    partitions of the batch are read. In update mode the first state seen of a window is the one kept.
    """
    bucket = F.floor(F.unix_micros("window_start") / (1_000_000 * bucket_seconds))

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = dedup_alerts(batch).withColumn("id_bucket", bucket).persist()
        try:
            new = fresh
            if versions.exists(spark, path):
                span = fresh.agg(F.min("id_bucket").alias("since"), F.max("id_bucket").alias("until")).first()
                stored = spark.read.schema(fresh.schema).parquet(path)
                at = F.col("id_bucket")
                stored = stored.where(at.between(F.lit(span.since), F.lit(span.until)) | at.isNull())
                new = fresh.join(stored.select("alert_id"), "alert_id", "left_anti")
            new.write.mode("append").partitionBy("id_bucket").parquet(path)
        finally:
            fresh.unpersist()

    return _start(alerts.writeStream.outputMode(mode).foreachBatch(write), None, {}, checkpoint, trigger, "60 seconds")


def stop_all(queries: list[StreamingQuery]) -> list[StreamingQuery]:
    """Stop every query, whatever happens to the others; returns those that did not stop."""
    failed = []
    for query in queries:
        try:
            query.stop()
        except Exception as error:
            log.error("query %s did not stop: %s", query.id, error)
            failed.append(query)
    return failed


def _start(
    writer: DataStreamWriter, fmt: str | None, options: dict, checkpoint: str, trigger: dict | None, every: str
) -> StreamingQuery:
    writer = writer.options(**options).option("checkpointLocation", checkpoint)
    if fmt is not None:
        writer = writer.format(fmt)
    return writer.trigger(**(trigger or {"processingTime": every})).start()

