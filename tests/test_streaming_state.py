"""State of streams: bounded sequences, rules that Spark refuses, idempotent messages, roll-ups, recovery."""

import random

import pytest
from pyspark.sql import functions as F
from samples import table, txn
from test_streaming import ONCE, finish, flush, inbox, rounded, same_rows, to_memory, without_flush  # noqa: F401
from txnwatch.operators.rules import declined_then_approved
from txnwatch.plans.evaluate import evaluate, stream_alerts
from txnwatch.streaming import jobs

TEN_MINUTE_RULES = ["cnp_spike", "declined_then_approved", "round_amount_structuring"]


def declines(seed, n, cards=4, seconds=5400):
    rng = random.Random(seed)
    kinds = ["DECLINED", "DECLINED", "APPROVED", "REVERSED"]
    return [
        txn(
            card=rng.choice("ABCD"[:cards]),
            at=rng.randrange(seconds * 4) / 4,
            amount=rng.choice([500.0, 1000.0, 1234.5]),
            channel=rng.choice(["ONLINE", "POS"]),
            txn_status=rng.choice(kinds),
            txn_id=f"T{i}",
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("count", [1, 2, 4])
def test_sequence_rule_equals_table_on_shuffled_files(spark, inbox, tmp_path, count):  # noqa: F811
    rows = declines(count, 700)
    rows += [dict(rows[0]), dict(rows[1])]  # the same transaction twice
    shuffled = random.Random(1).sample(rows, len(rows))
    for i in range(0, len(shuffled), 250):
        inbox.add(shuffled[i : i + 250])
    for part in flush():
        inbox.add(part)
    params = {"decline_min_count": count, "cnp_spike_txns": 4}
    expected = rounded(evaluate(table(spark, rows), params, rules=TEN_MINUTE_RULES))
    alerts = stream_alerts(inbox.transactions(spark), params, rules=TEN_MINUTE_RULES, watermark="3 hours")
    name, q = to_memory(alerts, tmp_path, "append")
    finish(q)
    got = rounded(without_flush(spark.table(name)))
    assert {r[0] for r in got.select("rule_triggered").distinct().collect()} == {
        "CNP_SPIKE", "DECLINED_THEN_APPROVED", "ROUND_AMOUNT_STRUCTURING",
    }
    assert same_rows(expected, got)


def test_changed_windows_are_sent_at_once(spark, inbox, tmp_path):  # noqa: F811
    inbox.add([txn(at=1, txn_status="DECLINED"), txn(at=2, txn_status="DECLINED")])
    inbox.add([txn(at=3)])
    alerts = stream_alerts(inbox.transactions(spark), rules=["declined_then_approved"], mode="update")
    name, q = to_memory(alerts, tmp_path, "update")
    finish(q)
    out = spark.table(name).collect()
    assert len(out) == 5 and {r.txn_count for r in out} == {3}


def test_state_is_bounded_by_declines_and_panes(spark, inbox, tmp_path):  # noqa: F811
    hot = [txn(card="HOT", at=i / 100, txn_status="DECLINED") for i in range(50_000)]  # 500 s: five panes
    random.Random(2).shuffle(hot)
    inbox.add(hot[:25_000])
    inbox.add(hot[25_000:] + [txn(card="HOT", at=501)])
    checkpoint = tmp_path / "bounded"
    alerts = declined_then_approved(inbox.transactions(spark).withWatermark("event_time", "1 hour"), {"decline_min_count": 3})
    writer = alerts.writeStream.format("noop").outputMode("append").option("checkpointLocation", str(checkpoint))
    finish(writer.trigger(**ONCE).start())
    state = spark.read.format("statestore").option("stateVarName", "panes").load(str(checkpoint)).collect()
    (panes,) = [r.value["panes"] for r in state if r.key["card_id"] == "HOT"]
    assert len(panes) == 5 and all(len(p.declines) == 3 for p in panes)
    assert sum(p.sums[0].n for p in panes) == 50_001
    assert [p.declines[0] for p in panes] == [p.start for p in panes]

    for part in flush():  # the watermark passes: nothing is left of the card
        inbox.add(part)
    writer = alerts.writeStream.format("noop").outputMode("append").option("checkpointLocation", str(checkpoint))
    finish(writer.trigger(**ONCE).start())
    state = spark.read.format("statestore").option("stateVarName", "panes").load(str(checkpoint)).collect()
    assert {r.key["card_id"] for r in state} == {"FLUSH"}


def counts_distinct(txns):
    """A rule that builds, but that no stream may run."""
    window = F.window("event_time", "5 minutes").alias("w")
    counted = txns.groupBy(window, "card_id").agg(F.countDistinct("merchant_id").alias("n"), F.sum("amount").alias("total"))
    return counted.selectExpr(
        "card_id", "w.start as window_start", "w.end as window_end", "cast(n as int) as txn_count",
        "total as total_amount", "'DISTINCT' as rule_triggered", "1 as risk_score",
    )


def test_a_rule_that_spark_refuses_stops_no_other(spark, inbox, tmp_path):  # noqa: F811
    inbox.add([txn(at=i, amount=40_000.0) for i in range(7)])
    skipped = []
    queries = jobs.start_live(
        inbox.stream(spark),
        alert_sink=("noop", {}),
        dead_letter_sink=("noop", {}),
        table_path=str(tmp_path / "table"),
        checkpoints=str(tmp_path / "ck"),
        trigger=ONCE,
        extra_rules={"distinct_merchants": counts_distinct, "unreadable": lambda txns: txns.select("no_such_column")},
        skipped=skipped,
    )
    finish(*queries)
    assert skipped == ["distinct_merchants", "unreadable"]
    stored = spark.read.parquet(str(tmp_path / "table"))
    assert stored.where("rule_triggered = 'HIGH_VALUE_SINGLE_TXN'").count() == 7
    # on tables the same rule is fine
    assert evaluate(table(spark, [txn()]), rules=[], extra_rules={"d": counts_distinct}).count() == 1


def test_refused_rules_raise_on_request(spark, inbox):  # noqa: F811
    txns = inbox.transactions(spark).withWatermark("event_time", "1 minute")
    alerts = evaluate(txns, rules=["velocity_check"], extra_rules={"d": counts_distinct}, on_error="raise")
    with pytest.raises(Exception, match="[Dd]istinct"):
        alerts.writeStream.format("noop").outputMode("append").start()


def test_one_message_per_id_on_a_topic(spark, inbox, tmp_path):  # noqa: F811
    """Alert messages of a live job, consumed from where they were published: changed windows send an id again."""
    topic, out, checkpoints = str(tmp_path / "topic"), str(tmp_path / "out"), str(tmp_path / "ck")

    def publish():
        alerts = stream_alerts(inbox.transactions(spark), rules=["velocity_check", "high_value_single"], mode="update")

        def write(batch, _):  # files take no updates
            from txnwatch.streaming.sinks import alert_records

            alert_records(batch, precise=True).write.mode("append").json(topic)

        writer = alerts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "live"))
        finish(writer.trigger(**ONCE).start())

    def consume():
        messages = spark.readStream.schema("key string, value string").json(topic)
        query = jobs.start_first_alerts(messages, ("json", {"path": out}), checkpoints, trigger=ONCE)
        finish(query)
        sent = spark.read.schema("key string, value string").json(out)
        ids = [r[0] for r in sent.select(F.get_json_object("value", "$.alert_id")).collect()]
        return ids, query.lastProgress["stateOperators"][0]["numRowsTotal"]

    inbox.add([txn(at=i, amount=40_000.0 if i == 3 else 5.0) for i in range(8)])
    inbox.add([txn(at=20 + i) for i in range(8)])  # the same windows again
    publish()
    ids, state = consume()
    assert len(ids) == len(set(ids)) == 3 and state == 3  # two hours' buckets and a row
    inbox.add([txn(at=40 + i) for i in range(8)])
    publish()
    assert sorted(consume()[0]) == sorted(ids)  # after a restart too
    assert spark.read.json(topic).count() > 10

    inbox.add([txn(at=50_000 + i, card="C2") for i in range(8)])
    publish()
    consume()
    inbox.add([txn(at=90_000 + i, card="C3") for i in range(8)])
    publish()
    later, state = consume()
    assert len(later) == len(set(later)) and set(ids) < set(later)
    assert state <= 2 * 2  # what lies behind the watermark is forgotten


def test_live_card_rollup_equals_the_stored_alerts(spark, inbox, tmp_path):  # noqa: F811
    from test_against_brute_force import TUNED, random_rows
    from txnwatch.operators.alerts import card_risk_by_period, card_risk_rollup

    rows = sorted(random_rows(12, 400), key=lambda r: r["event_time"])
    rows = [{**r, "card_id": r["card_id"] or "NONE"} for r in rows]
    for part in (rows[:150], rows[150:], *flush()):
        inbox.add(part)
    inbox.add([txn(card="FLUSH", at=200_000)])
    inbox.add([txn(card="FLUSH", at=200_001)])
    dormant = spark.createDataFrame([("A",)], "card_id string")
    query = jobs.start_card_rollup(
        inbox.stream(spark), str(tmp_path / "rollup"), str(tmp_path / "ck"), trigger=ONCE, params=TUNED, dormant=dormant
    )
    finish(query)
    got = without_flush(spark.read.parquet(str(tmp_path / "rollup")))
    alerts = evaluate(table(spark, rows), TUNED, dormant=dormant, closing=True)
    assert same_rows(card_risk_by_period(alerts), got)
    # all of it lies within one day, so the period's roll-up is the whole one
    assert got.select("period_start").distinct().count() == 1
    assert same_rows(card_risk_rollup(alerts), got.drop("period_start", "period_end"))
    assert {r[0] for r in got.selectExpr("rules_fired").collect()} != {1}
