"""The jobs: alert table from a transaction table, the live job, the nightly card list."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txnwatch.operators.alerts import card_risk_by_period, first_alerts
from txnwatch.operators.dormant import dormant_list, last_activity, merged_activity, quiet_since
from txnwatch.operators.specs import SINGLE_INPUT_RULES
from txnwatch.plans.evaluate import all_alerts, evaluate, stream_alerts, with_alert_time
from txnwatch.sources import ingest
from txnwatch.streaming import sinks, versions

log = logging.getLogger(__name__)


def require_utc(spark: SparkSession) -> None:
    """Local hours and the time text in alert ids are taken in the session's zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")


def checkpoint_root(spark: SparkSession, given: str | None = None) -> str:
    """Where stream progress is kept: what is asked for, else the folder the cluster names."""
    root = given or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("no checkpoint folder: pass one or set spark.checkpoint.dir")
    return root.rstrip("/")


def stored_dormant_cards(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The stored card list, or None (and a warning) where it cannot be read."""
    if path is None:
        return None
    try:
        return current_dormant_cards(spark, path)
    except Exception as error:
        log.warning("no dormant card list at %s: %s", path, error)
        return None


def write_dormant_list(history: DataFrame, as_of, path: str, days: int = 30, time_column: str = "event_time") -> None:
    """The nightly job behind the dormant-card rule, from the whole history.

    Each list is a version of its own below ``path``; the newest few are kept (``versions``).
    """
    _publish_cards(dormant_list(history, as_of, days, time_column), path, versions.new_version(), ["cards"])


def update_dormant_list(
    day: DataFrame, as_of, path: str, days: int = 30, time_column: str = "event_time", buckets: int | None = None
) -> None:
    """The nightly job from one more day: reads the day and the last activities as of the day before, not the history.

    The first call is given the history so far. The last activity of every card is kept bucketed by card below
    ``path``, a version per night, so that merging shuffles the day alone. The number of buckets is that of
    the first call, by default ``spark.sql.shuffle.partitions``: with fewer Spark prefers to shuffle the state as
    well. A day that is merged twice changes nothing. The card list that follows is published with its
    activities by one pointer. Rows without a card are left out.
    """
    spark = day.sparkSession
    until = F.lit(as_of).cast("timestamp")
    today = last_activity(day, until, time_column).where("card_id is not null")
    before = versions.newest(spark, path)
    if before is None:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        merged, names = today.repartition(buckets, "card_id"), []
    elif "buckets" not in before or before["buckets"] is None:
        raise ValueError(f"the list at {path} was made from a whole history and has no activities to merge with")
    else:
        buckets = before["buckets"]
        names = [_activity_table(spark, path, before["version"], buckets)]
        merged = merged_activity(spark.table(names[0]), today)
    version = versions.new_version()
    names.append(_activity_table(spark, path, version, buckets))
    merged.write.insertInto(names[-1])
    cards = quiet_since(spark.table(names[-1]), until, days)
    _publish_cards(cards, path, version, ["cards", "activity"], buckets=buckets)
    for name in names:
        spark.sql(f"DROP TABLE {name}")  # the name only: the files belong to the folder


def _activity_table(spark: SparkSession, path: str, version: str, buckets: int) -> str:
    """A name for the bucketed files of a version."""
    name = f"card_activity_{version}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (card_id STRING, last_activity TIMESTAMP) USING parquet "
        f"CLUSTERED BY (card_id) SORTED BY (card_id) INTO {int(buckets)} BUCKETS LOCATION '{path}/activity/version={version}'"
    )
    return name


def _publish_cards(cards: DataFrame, path: str, version: str, tables: list[str], **facts) -> None:
    spark = cards.sparkSession
    cards.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/cards")
    versions.publish(spark, path, version, **facts)
    versions.tidy(spark, path, tables)


def current_dormant_cards(spark: SparkSession, path: str) -> DataFrame:
    """The newest list of the nightly jobs, or a plain table of cards at ``path``; raises where there is none."""
    newest = versions.newest(spark, path)
    if newest is None:
        return ingest.dormant_cards(spark, path)
    cards = spark.read.schema("card_id string, version string").parquet(f"{path}/cards")
    return cards.where(F.col("version") == newest["version"]).select("card_id").distinct()


def write_alerts(txns: DataFrame, path: str, mode: str = "append", **rules) -> DataFrame:
    """Run the rules over a table and store the alerts by rule; returns the stored table.

    Whatever needs the alerts reads them from there instead of running the rules again. The
    rebalance gives files of even size: small rules share no task's leftovers, big ones are split.
    """
    spark = txns.sparkSession
    require_utc(spark)
    alerts = with_alert_time(all_alerts(txns, **rules))
    alerts.hint("rebalance", "rule_triggered").write.mode(mode).partitionBy("rule_triggered").parquet(path)
    return spark.read.parquet(path)


def start_live(
    messages: DataFrame,
    alert_sink: tuple[str, dict],
    dead_letter_sink: tuple[str, dict],
    table_path: str,
    checkpoints: str | None = None,
    dormant_path: str | None = None,
    trigger: dict | None = None,
    precise: bool = False,
    alert_mode: str = "update",
    **rules,
) -> list[StreamingQuery]:
    """Messages to alerts: one query each for alert messages, alert table and dead letters.

    Each query has its own checkpoint, so one that fails is restarted alone. ``trigger`` replaces
    the queries' own intervals. Rules that cannot run are left out, each known by name (``skipped=[]``).
    """
    spark = messages.sparkSession
    require_utc(spark)
    root = checkpoint_root(spark, checkpoints)
    parsed = ingest.parse(messages)
    rules = {"dormant": stored_dormant_cards(spark, dormant_path), **rules}
    # Changed windows for messages, whole windows for the table.
    changing, whole = (stream_alerts(ingest.good_rows(parsed), mode=mode, **rules) for mode in (alert_mode, "append"))
    started: list[StreamingQuery] = []
    try:
        started.append(
            sinks.publish_alerts(changing, *alert_sink, f"{root}/alert-messages", trigger, alert_mode, precise)
        )
        started.append(sinks.store_alerts(whole, table_path, f"{root}/alert-table", trigger))
        started.append(sinks.publish_dead_letters(parsed, *dead_letter_sink, f"{root}/dead-letters", trigger))
    except Exception:
        sinks.stop_all(started)
        raise
    return started


def start_first_alerts(
    messages: DataFrame,
    sink: tuple[str, dict],
    checkpoints: str | None = None,
    within: str = "2 hours",
    trigger: dict | None = None,
) -> StreamingQuery:
    """From a topic of alert messages, where an id comes again whenever its windows change, to one message per id."""
    spark = messages.sparkSession
    require_utc(spark)
    first = first_alerts(ingest.alert_messages(messages), within)
    checkpoint = f"{checkpoint_root(spark, checkpoints)}/first-alerts"
    return sinks.publish_alerts(first, *sink, checkpoint, trigger, "append", precise=True)


def start_card_rollup(
    messages: DataFrame,
    path: str,
    checkpoints: str | None = None,
    period: str = "1 day",
    trigger: dict | None = None,
    **rules,
) -> StreamingQuery:
    """All signals on a card together, per period, straight from the messages: no detour over the alert table.

    The window rules' aggregations feed a second one, which the watermark reaches through ``closes_at``.
    """
    spark = messages.sparkSession
    require_utc(spark)
    alerts = stream_alerts(ingest.good_rows(ingest.parse(messages)), mode="append", closing=True, **rules)
    writer = card_risk_by_period(alerts, period).writeStream.outputMode("append")
    checkpoint = f"{checkpoint_root(spark, checkpoints)}/card-rollup"
    return sinks._start(writer, "parquet", {"path": path}, checkpoint, trigger, "60 seconds")


def start_dormant_watch(
    messages: DataFrame, dormant_path: str, table_path: str, checkpoints: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Dormant-card alerts with the card list as it is stored at the time of each batch.

    A list that is joined to the stream keeps the files it had at the start; here the nightly list
    takes effect without a restart. A batch whose list cannot be read fails and is run again. The
    table is partitioned by day and only appended to; rows carry the run (one per checkpoint) and the
    batch they came from, so a batch that is run again finds what it already stored.
    """
    spark = messages.sparkSession
    require_utc(spark)
    run = _run_id(spark, f"{checkpoint_root(spark, checkpoints)}/dormant-watch-run")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        listed = current_dormant_cards(session, dormant_path)
        alerts = with_alert_time(all_alerts(batch, rules=["dormant_card"], dormant=listed)).withColumns(
            {"run": F.lit(run), "batch": F.lit(number), "alert_day": F.to_date("window_start")}
        )
        if versions.exists(session, table_path):
            # Only the days of this batch, which are partitions, can hold what it stored when it ran before.
            span = batch.agg(F.to_date(F.min("event_time")).alias("since"), F.to_date(F.max("event_time")).alias("until")).first()
            before = session.read.schema(alerts.schema).parquet(table_path)
            at = F.col("alert_day")
            before = before.where(at.between(F.lit(span.since), F.lit(span.until)) | at.isNull())
            mine = before.where((F.col("run") == run) & (F.col("batch") == number)).select("alert_id")
            alerts = alerts.join(mine, "alert_id", "left_anti").select(alerts.columns)
        if not alerts.isEmpty():
            alerts.write.mode("append").partitionBy("alert_day").parquet(table_path)

    good = ingest.good_rows(ingest.parse(messages))
    writer = good.writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{checkpoint_root(spark, checkpoints)}/dormant-watch"
    )
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def _run_id(spark: SparkSession, path: str) -> str:
    """An id that belongs to a checkpoint folder: made once, found again after a restart."""
    if not versions.exists(spark, path):
        spark.range(1).select(F.lit(versions.new_version()).alias("run")).write.parquet(path)
    return spark.read.parquet(path).first()["run"]


def start_console(
    messages: DataFrame, checkpoints: str | None = None, trigger: dict | None = None, watermark: str = "2 minutes", **rules
) -> StreamingQuery:
    """For development: changed alerts on the console, no ids, unparseable messages dropped."""
    spark = messages.sparkSession
    good = ingest.good_rows(ingest.parse(messages)).withWatermark("event_time", watermark)
    alerts = with_alert_time(evaluate(good, **{"rules": SINGLE_INPUT_RULES, "mode": "update", **rules}))
    return sinks.show_alerts(alerts, f"{checkpoint_root(spark, checkpoints)}/console", trigger)


def run_until_any_ends(spark: SparkSession, queries: list[StreamingQuery]) -> None:
    """Block until one of ``queries`` ends or fails, then stop the others.

    Other queries of the session do not matter, neither those that ended before nor those that run on.
    """
    try:
        while all(q.isActive for q in queries):
            for q in queries:
                q.awaitTermination(1)
        for q in queries:
            if q.exception() is not None:
                raise q.exception()
    finally:
        sinks.stop_all(queries)
