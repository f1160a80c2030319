"""Streams without a broker: text files as source, memory and files as sinks."""

import json
import os
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F
from samples import table, txn
from test_against_brute_force import TUNED, random_rows
from txnwatch.operators.rules import build_rules, velocity_check
from txnwatch.operators.specs import SINGLE_INPUT_RULES, WINDOW_RULES
from txnwatch.plans.evaluate import evaluate, stream_alerts, with_alert_time
from txnwatch.schemas import TRANSACTION
from txnwatch.sources import ingest
from txnwatch.streaming import jobs, sinks

ONCE = {"availableNow": True}


class Inbox:
    """A folder of message files; the source takes them in the order they were added."""

    def __init__(self, path):
        self.path, self.n = path, 0
        path.mkdir()

    def add(self, rows, raw=()):
        lines = [
            json.dumps({**r, "event_time": r["event_time"] and r["event_time"].isoformat(timespec="microseconds")})
            for r in rows
        ]
        file = self.path / f"{self.n:04d}.txt"
        file.write_text("\n".join([*lines, *raw]) + "\n")
        os.utime(file, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    def stream(self, spark):
        return ingest.message_stream(
            spark, "text", {"maxFilesPerTrigger": "1"}, schema="value string", path=str(self.path)
        )

    def transactions(self, spark):
        return ingest.good_rows(ingest.parse(self.stream(spark)))


@pytest.fixture
def inbox(tmp_path):
    return Inbox(tmp_path / "inbox")


def to_memory(df, tmp_path, mode):
    name = f"m{uuid.uuid4().hex}"
    return name, (
        df.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name))
        .trigger(**ONCE)
        .start()
    )


def finish(*queries):
    for q in queries:
        q.awaitTermination(240)
        assert q.exception() is None


def flush():
    """Rows far ahead: the first closes all earlier windows, the second lets them be emitted."""
    return [[txn(card="FLUSH", at=90_000 + i)] for i in range(2)]


def without_flush(df):
    return df.where("card_id <> 'FLUSH'")


def rounded(df):
    return df.withColumn("total_amount", F.round("total_amount", 2))


def same_rows(a, b):
    columns = a.columns
    a, b = a.persist(), b.select(columns).persist()
    try:
        return a.count() == b.count() > 0 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    finally:
        a.unpersist()
        b.unpersist()


def test_stream_equals_table(spark, inbox, tmp_path):
    rows = sorted(random_rows(5, 600), key=lambda r: r["event_time"])
    rows = [{**r, "card_id": r["card_id"] or "NONE"} for r in rows]
    for part in (rows[:200], rows[200:400], rows[400:], *flush()):
        inbox.add(part)
    txns = table(spark, rows)
    dormant = spark.createDataFrame([("A",)], "card_id string")
    params = {**TUNED, "unusual_hour_start": 12, "unusual_hour_end": 13}
    expected = rounded(evaluate(txns, params, dormant=dormant))
    # Built once per query: two queries must not share a stateful processor.
    whole, changed = (stream_alerts(inbox.transactions(spark), params, dormant=dormant, mode=m) for m in ("append", "update"))
    closed, q1 = to_memory(whole, tmp_path, "append")
    changing, q2 = to_memory(changed, tmp_path, "update")
    finish(q1, q2)
    got = rounded(without_flush(spark.table(closed)))
    assert got.columns == [*expected.columns, "alert_id", "alert_time"]
    assert got.select("rule_triggered").distinct().count() == 12
    assert same_rows(expected, got)
    # update mode shows every alert's final state, among earlier ones
    missing = expected.distinct().exceptAll(rounded(spark.table(changing)).select(expected.columns).distinct())
    assert missing.count() == 0


def test_every_rule_starts_alone(spark, inbox, tmp_path):
    inbox.add([txn(at=i, country=c) for i, c in enumerate(["IN", "US"])])
    txns = inbox.transactions(spark).withWatermark("event_time", "2 minutes")
    started = {n: to_memory(rule(txns), tmp_path, "update") for n, rule in build_rules().items()}
    finish(*[q for _, q in started.values()])
    assert set(started) == set(SINGLE_INPUT_RULES)
    assert spark.table(started["geo_velocity"][0]).count() == 6


def test_late_rows(spark, inbox, tmp_path):
    inbox.add([txn(at=1200 + i, amount=40_000.0) for i in range(7)])
    inbox.add([txn(card="X", at=3000)])
    inbox.add([txn(card="X", at=3120)])
    inbox.add([txn(at=1230, amount=50_000.0)])
    inbox.add([txn(card="X", at=3540)])
    names = ["velocity_check", "high_value_single"]
    name, q = to_memory(stream_alerts(inbox.transactions(spark), rules=names), tmp_path, "append")
    finish(q)
    out = spark.table(name).where("card_id = 'C1'")
    # too late for its windows, but a row rule has none
    assert {r.txn_count for r in out.where("rule_triggered = 'HIGH_VELOCITY'").collect()} == {7}
    assert out.where("rule_triggered = 'HIGH_VALUE_SINGLE_TXN'").count() == 8


def test_live_job_and_restart(spark, inbox, tmp_path):
    rows = sorted(random_rows(9, 200), key=lambda r: r["event_time"])
    rows = [{**r, "card_id": r["card_id"] or "NONE"} for r in rows]
    path = lambda n: str(tmp_path / n)
    spark.createDataFrame([("A",), ("A",)], "card_id string").write.parquet(path("dormant"))

    def run():
        queries = jobs.start_live(
            inbox.stream(spark),
            alert_sink=("json", {"path": path("messages")}),
            dead_letter_sink=("json", {"path": path("dead")}),
            table_path=path("table"),
            checkpoints=path("checkpoints"),
            dormant_path=path("dormant"),
            trigger=ONCE,
            alert_mode="append",  # files take no updates
        )
        finish(*queries)
        assert sinks.stop_all(queries) == []

    inbox.add(rows[:120], raw=["not json", ""])
    run()
    inbox.add(rows[120:], raw=['{"amount":1}'])
    for part in flush():
        inbox.add(part)
    run()
    dormant = spark.createDataFrame([("A",)], "card_id string")
    expected = rounded(evaluate(table(spark, rows), dormant=dormant))
    stored = without_flush(spark.read.parquet(path("table")))
    assert same_rows(expected, rounded(stored))
    assert (tmp_path / "table" / "rule_triggered=DORMANT_CARD").is_dir()
    messages = spark.read.json(path("messages"))
    assert messages.count() >= expected.count() and set(messages.columns) == {"key", "value"}
    dead = {r.value for r in spark.read.schema("key string, value string").json(path("dead")).collect()}
    assert dead == {"not json", "", '{"amount":1}'}


def test_one_row_per_alert_id(spark, inbox, tmp_path):
    def run():
        alerts = stream_alerts(inbox.transactions(spark), rules=["velocity_check"])
        finish(sinks.store_first_alerts(alerts, str(tmp_path / "first"), str(tmp_path / "ck"), ONCE, mode="update"))
        return spark.read.parquet(str(tmp_path / "first"))

    inbox.add([txn(at=1800 + i) for i in range(8)])
    assert run().count() == 1
    inbox.add([txn(at=1830 + i) for i in range(8)])  # the same windows again, and later ones
    inbox.add([txn(card="C2", at=1860 + i) for i in range(8)])
    out = run()
    assert out.count() == out.select("alert_id").distinct().count() == 2


def test_dormant_watch_sees_a_new_list(spark, inbox, tmp_path):
    listed, out = str(tmp_path / "dormant"), str(tmp_path / "out")

    def run(card):
        spark.createDataFrame([(card,)], "card_id string").write.mode("overwrite").parquet(listed)
        finish(jobs.start_dormant_watch(inbox.stream(spark), listed, out, str(tmp_path / "ck"), ONCE))
        return sorted(r.card_id for r in spark.read.parquet(out).collect())

    inbox.add([txn(card="A"), txn(card="B")])
    assert run("A") == ["A"]
    inbox.add([txn(card="A", at=5), txn(card="B", at=6)])
    assert run("B") == ["A", "B"]
    assert "alert_id" in spark.read.parquet(out).columns


def test_dormant_watch_loses_nothing(spark, inbox, tmp_path):
    listed, out = str(tmp_path / "dormant"), str(tmp_path / "out")

    def run(checkpoint):
        finish(jobs.start_dormant_watch(inbox.stream(spark), listed, out, str(tmp_path / checkpoint), ONCE))
        return sorted(r.card_id for r in spark.read.parquet(out).collect())

    inbox.add([txn(card="A")])
    with pytest.raises(Exception):  # no list yet: the batch fails
        run("ck")
    history = table(spark, [txn(card="A", at=-90 * 86400), txn(card="B")])
    jobs.write_dormant_list(history, "2026-01-02 00:00:00", listed)
    assert run("ck") == ["A"]  # and is run again
    jobs.write_dormant_list(table(spark, [txn(card="B", at=-90 * 86400)]), "2026-01-02 00:00:00", listed)
    inbox.add([txn(card="A", at=5), txn(card="B", at=6)])
    assert run("ck") == ["A", "B"]
    assert run("ck") == ["A", "B"]
    assert run("other") == ["A", "B", "B"]  # a new checkpoint reads all again and adds, never replaces


def test_run_loop_ignores_other_queries(spark, inbox, tmp_path):
    inbox.add([txn()])
    finish(to_memory(velocity_check(inbox.transactions(spark)), tmp_path, "update")[1])
    writer = inbox.transactions(spark).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "b"))
    query = writer.trigger(processingTime="1 second").start()
    done = threading.Event()

    def loop():
        jobs.run_until_any_ends(spark, [query])
        done.set()

    threading.Thread(target=loop, daemon=True).start()
    assert not done.wait(3) and query.isActive
    query.stop()
    assert done.wait(10)


def test_dlq_rate_on_a_stream(spark, inbox, tmp_path):
    inbox.add([txn()])
    messages = inbox.stream(spark).withColumn("timestamp", F.current_timestamp())
    rate = ingest.dlq_rate(ingest.parse(messages))
    finish(to_memory(rate, tmp_path, "append")[1])


def test_console_job_and_rate_source(spark, inbox, tmp_path):
    inbox.add([txn(at=i) for i in range(7)])
    console = jobs.start_console(inbox.stream(spark), str(tmp_path / "ck"), ONCE, rules=["velocity_check"])
    finish(console)
    assert sum(p["numInputRows"] for p in console.recentProgress) == 7

    rate = ingest.message_stream(spark, "rate", {"rowsPerSecond": "50"})
    fixed = {f.name: F.lit("X").alias(f.name) for f in TRANSACTION}
    fixed |= {"txn_id": F.col("value").cast("string").alias("txn_id"), "amount": F.lit(1.0).alias("amount")}
    fixed["event_time"] = F.col("timestamp").alias("event_time")
    txns = rate.select(*fixed.values()).withWatermark("event_time", "2 minutes")
    alerts = with_alert_time(velocity_check(txns))
    q = (
        alerts.writeStream.format("memory").queryName("rate_alerts").outputMode("update")
        .option("checkpointLocation", str(tmp_path / "rate")).trigger(processingTime="1 second").start()
    )
    try:
        deadline = time.time() + 90
        while time.time() < deadline and not spark.table("rate_alerts").count():
            time.sleep(1)
        assert q.exception() is None and spark.table("rate_alerts").count() > 0
    finally:
        q.stop()


def test_state_stores_are_shared(spark, inbox, tmp_path):
    inbox.add([txn(at=i) for i in range(3)])
    name, q = to_memory(stream_alerts(inbox.transactions(spark)), tmp_path, "update")
    finish(q)
    assert len(WINDOW_RULES) == 9
    assert len(q.lastProgress["stateOperators"]) == 5


def test_job_settings(spark, tmp_path):
    assert jobs.checkpoint_root(spark, "/x/") == "/x"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        assert jobs.checkpoint_root(spark) == shared.rstrip("/")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            jobs.checkpoint_root(spark)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        with pytest.raises(ValueError, match="UTC"):
            jobs.require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
