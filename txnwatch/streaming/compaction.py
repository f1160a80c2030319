"""Few and even files for a stored alert table, while its stream and its readers go on.

The stream's table is left as it is. Alerts detected in batches before its newest one are complete (batches
of a query follow each other, and all alerts of a batch have one ``alert_time``), so they are rewritten,
once, into files of even size, and a pointer that names the time up to which this was done is published. A
reader takes what was detected before that time from the rewritten files and the rest from the stream's
table: every alert once, before, during and after a compaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.streaming import versions


def compact_alerts(spark: SparkSession, live: str, compacted: str) -> bool:
    """Rewrite what was detected since the last compaction, but for the newest batch; False if there is nothing.

    Each compaction reads only the rows since the one before. One writer at a time.
    """
    rows = spark.read.parquet(live)
    until = rows.agg(F.max("alert_time").alias("t")).first()["t"]
    last = versions.newest(spark, compacted)
    closed = _between(rows, last["until"] if last else None, until)
    if until is None or closed.isEmpty():
        return False
    version = versions.new_version()
    even = closed.hint("rebalance", "rule_triggered").withColumn("version", F.lit(version))
    even.write.mode("append").partitionBy("version", "rule_triggered").parquet(f"{compacted}/alerts")
    versions.publish(spark, compacted, version, until=until, parts=[*(last["parts"] if last else []), version])
    return True


def stored_alerts(spark: SparkSession, live: str, compacted: str) -> DataFrame:
    """All alerts of a table that is compacted, in the columns of the stream's table."""
    rows = spark.read.parquet(live)
    last = versions.newest(spark, compacted)
    if last is None:
        return rows
    parts = spark.read.parquet(f"{compacted}/alerts").where(F.col("version").isin(list(last["parts"])))
    return parts.select(*rows.columns).unionByName(_between(rows, last["until"], None))


def _between(rows: DataFrame, since, until) -> DataFrame:
    """Rows detected from ``since`` on and before ``until``; a filter that prunes by the files' statistics."""
    at = F.col("alert_time")
    rows = rows if since is None else rows.where(at >= F.lit(since))
    return rows if until is None else rows.where(at < F.lit(until))
