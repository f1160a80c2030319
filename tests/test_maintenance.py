"""Card list by days, alert table compaction, latency sketches, late rows, state and recovery."""

import random
import threading

import pytest
from pyspark.sql import functions as F
from samples import NOON, table, txn
from test_streaming import ONCE, finish, flush, inbox, rounded, same_rows, to_memory, without_flush  # noqa: F401
from txnwatch.operators.alerts import (
    SKETCH_RANK_ERROR,
    detection_latency,
    latency_sketches,
    merged_latency,
)
from txnwatch.operators.dormant import dormant_list, last_activity, merged_activity
from txnwatch.plans.evaluate import evaluate, stream_alerts
from txnwatch.streaming import compaction, jobs, monitor, sinks, versions

DAY = 86_400


def pairs(df):
    return sorted((r.card_id, r.last_activity) for r in df.collect())


def test_thirty_days_merged_equal_the_whole_history(spark, tmp_path):
    rng = random.Random(4)
    path = str(tmp_path / "list")
    days = [
        [txn(card=f"C{rng.randint(0, 40 + d)}", at=d * DAY + rng.randrange(DAY // 2)) for _ in range(rng.randint(0, 25))]
        for d in range(31)
    ]
    start = NOON.replace(hour=0)
    for d, rows in enumerate(days):
        as_of = start.replace(month=1, day=1).timestamp() + (d + 1) * DAY + DAY // 2
        as_of = spark.sql(f"select timestamp_seconds({int(as_of)}) as t").first().t
        today = table(spark, rows)
        if d == 0:
            jobs.update_dormant_list(today, as_of, path, days=7, buckets=4)
        else:
            jobs.update_dormant_list(today, as_of, path, days=7)
    jobs.update_dormant_list(table(spark, days[3]), as_of, path, days=7)  # once more, and out of order
    history = table(spark, [r for rows in days for r in rows])
    expected = dormant_list(history, as_of, days=7)
    got = jobs.current_dormant_cards(spark, path)
    assert sorted(r.card_id for r in got.collect()) == sorted(r.card_id for r in expected.collect())
    newest = versions.newest(spark, path)
    activity = spark.read.parquet(f"{path}/activity/version={newest['version']}")
    assert pairs(activity) == pairs(last_activity(history, F.lit(as_of)))
    # old versions go, with their pointers
    assert len(list((tmp_path / "list" / "activity").glob("version=*"))) == 3
    assert spark.read.parquet(f"{path}/pointer").count() == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("card_activity")]


def test_merging_a_day_shuffles_the_day_alone(spark, tmp_path):
    path = str(tmp_path / "list")
    first = table(spark, [txn(card=f"C{i}", at=i) for i in range(50)])
    jobs.update_dormant_list(first, "2026-02-01 00:00:00", path, buckets=4)
    day_path = str(tmp_path / "day")
    table(spark, [txn(card="C1", at=DAY)]).write.parquet(day_path)
    day = last_activity(spark.read.parquet(day_path), F.lit("2026-02-02").cast("timestamp"))
    name = jobs._activity_table(spark, path, versions.newest(spark, path)["version"], 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merged_activity(spark.table(name), day)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql(f"DROP TABLE {name}")
    # the left side comes first in the text: nothing lies between the join and the stored activities
    assert plan.count("FileScan") == 2 and "Exchange" not in plan[: plan.index("Bucketed: true")]
    assert plan.count("Exchange") == 2  # the day: summed up, then dealt to the buckets


def test_a_list_without_activities_is_not_merged_with(spark, tmp_path):
    rows = table(spark, [txn(card="A")])
    jobs.write_dormant_list(rows, "2026-03-01 00:00:00", str(tmp_path / "l"))
    with pytest.raises(ValueError, match="whole history"):
        jobs.update_dormant_list(rows, "2026-03-02 00:00:00", str(tmp_path / "l"))
    assert [r.card_id for r in jobs.current_dormant_cards(spark, str(tmp_path / "l")).collect()] == ["A"]


def test_compaction_while_a_stream_and_a_reader_go_on(spark, inbox, tmp_path):  # noqa: F811
    live, compacted = str(tmp_path / "live"), str(tmp_path / "compacted")

    def batch(i):
        inbox.add([txn(card=f"C{i}", at=i * 10 + k, amount=40_000.0, channel="ONLINE") for k in range(4)])
        alerts = stream_alerts(inbox.transactions(spark), rules=["high_value_single", "unusual_hour"], params={"unusual_hour_start": 12, "unusual_hour_end": 13})
        finish(sinks.store_alerts(alerts, live, str(tmp_path / "ck"), ONCE))

    def rows():
        return sorted(map(str, compaction.stored_alerts(spark, live, compacted).collect()))

    def all_rows():
        return sorted(map(str, spark.read.parquet(live).collect()))

    for i in range(4):
        batch(i)
    assert rows() == all_rows()
    reader = compaction.stored_alerts(spark, live, compacted)  # looked the table up before the swap
    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            seen.append(len(rows()))

    thread = threading.Thread(target=read)
    thread.start()
    assert compaction.compact_alerts(spark, live, compacted)
    done.set()
    thread.join()
    assert set(seen) <= {len(all_rows())}
    assert rows() == all_rows() == sorted(map(str, reader.collect()))
    assert not compaction.compact_alerts(spark, live, compacted)  # the newest batch alone stays
    for i in range(4, 7):
        batch(i)
    assert rows() == all_rows()
    assert compaction.compact_alerts(spark, live, compacted)
    assert rows() == all_rows() and len(rows()) == 7 * 8
    few = list((tmp_path / "compacted" / "alerts").rglob("part-*.parquet"))
    many = list((tmp_path / "live").rglob("part-*.parquet"))
    assert len(few) <= 4 < 14 <= len(many)


def latency_table(spark, n=20_000):
    """Alerts of two rules over four days, with latencies from a skewed distribution."""
    end = "timestamp_seconds(1767225600 + id % 4 * 86400 + id % 1000)"
    rule = "if(id % 10 = 0, 'RARE', 'COMMON')"
    seconds = "pow(1.0 + pmod(xxhash64(id), 100000) / 10000, 3)"
    return spark.range(n).selectExpr(
        f"{rule} as rule_triggered", f"{end} as window_end",
        f"timestamp_micros(unix_micros({end}) + cast({seconds} * 1000000 as bigint)) as alert_time",
    )


def test_merged_sketches_keep_their_error(spark, tmp_path):
    alerts = latency_table(spark)
    path = str(tmp_path / "sketches")
    for day in range(4):
        mine = alerts.where(f"to_date(window_end) = date'2026-01-01' + {day}")
        latency_sketches(mine).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 6  # four days of one rule, two of the other
    merged = {r.rule_triggered: r for r in merged_latency(stored, (0.01, 0.5, 0.99)).collect()}
    one_pass = {r.rule_triggered: r for r in merged_latency(latency_sketches(alerts), (0.5,)).collect()}
    exact = {r.rule_triggered: r for r in detection_latency(alerts).collect()}
    for rule, m in merged.items():
        assert m.alerts == exact[rule].alerts and m.max_seconds == exact[rule].max_seconds
        assert abs(m.avg_seconds - exact[rule].avg_seconds) < 1e-6
        values = sorted(r.x for r in alerts.where(F.col("rule_triggered") == rule).selectExpr(
            "(unix_micros(alert_time) - unix_micros(window_end)) / 1000000 as x").collect())
        for q, at in ((0.01, m.p1_seconds), (0.5, m.p50_seconds), (0.99, m.p99_seconds), (0.5, one_pass[rule].p50_seconds)):
            rank = sum(v <= at for v in values) / len(values)
            assert abs(rank - q) <= SKETCH_RANK_ERROR + 1 / len(values)
    # few alerts: exact
    few = alerts.limit(101).withColumn("rule_triggered", F.lit("ONE")).persist()
    got, truth = merged_latency(latency_sketches(few), (0.5,)).first(), detection_latency(few).first()
    assert got.p50_seconds == truth.median_seconds
    few.unpersist()
    assert merged_latency(latency_sketches(alerts.limit(0))).collect() == []


def test_late_rows_are_counted(spark, inbox, tmp_path):  # noqa: F811
    late = monitor.LateRows()
    spark.streams.addListener(late)
    try:
        inbox.add([txn(at=1200 + i, txn_status="DECLINED") for i in range(7)])
        inbox.add([txn(card="X", at=6000)])
        inbox.add([txn(card="X", at=6120)])
        inbox.add([txn(at=1230), txn(card="X", at=6125)])  # one is late
        inbox.add([txn(card="X", at=6540)])
        alerts = stream_alerts(inbox.transactions(spark), rules=["velocity_check", "declined_then_approved"])
        name, q = to_memory(alerts, tmp_path, "append")
        finish(q)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(50):  # progress reaches Python a little later
            if late.rows(str(q.id)):
                break
            threading.Event().wait(0.2)
        assert late.rows(str(q.id)) == 1 and late.totals()[name] == 1
        windows = [n for (_, operator), n in late.by_operator(str(q.id)).items() if not operator.startswith("transform")]
        assert windows == [5]  # the same row, in five windows of velocity_check
    finally:
        spark.streams.removeListener(late)


def test_state_is_read_back_and_a_restart_goes_on(spark, inbox, tmp_path):  # noqa: F811
    rng = random.Random(6)
    rows = [
        txn(card=rng.choice("AB"), at=i * 20, amount=rng.choice([1000.0, 9500.0]), channel=rng.choice(["ONLINE", "POS"]),
            country=rng.choice(["IN", "US"]), merchant_id=f"M{i % 7}", txn_status=rng.choice(["DECLINED", "APPROVED"]))
        for i in range(120)
    ]
    checkpoint, out = str(tmp_path / "ck"), str(tmp_path / "out")

    def run():
        alerts = stream_alerts(inbox.transactions(spark))
        finish(sinks.store_alerts(alerts, out, checkpoint, ONCE))

    inbox.add(rows[:60])
    run()
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "RocksDB" in provider
    assert list((tmp_path / "ck" / "state").rglob("*.changelog"))
    state = monitor.state_rows(spark, checkpoint)
    kept = {r["operator"]: r["n"] for r in state.groupBy("operator").agg(F.count("*").alias("n")).collect()}
    assert len(kept) == 5 and all(kept.values())
    (panes,) = {r.variable for r in state.where("variable is not null").select("variable").distinct().collect()}
    assert panes == "panes" and state.where("variable = 'panes'").where("value like '%declines%'").count() == 2
    inbox.add(rows[60:])
    for part in flush():
        inbox.add(part)
    run()
    assert same_rows(rounded(evaluate(table(spark, rows))), rounded(without_flush(spark.read.parquet(out))))
