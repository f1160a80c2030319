import json

import pytest

from samples import table, txn
from txnwatch.operators import rules
from txnwatch.schemas import TRANSACTION
from txnwatch.sources import fixtures, ingest
from txnwatch.streaming.sinks import MESSAGE_FIELDS, alert_records, kafka_sink_options

FULL = {
    "txn_id": "a",
    "card_id": "C1",
    "amount": 40_000.0,
    "event_time": "2026-01-01T12:00:00.123456+00:00",
    "country": "IN",
}


def parsed(spark, values):
    return ingest.parse(spark.createDataFrame([(v,) for v in values], "value string"))


def test_good_and_bad(spark):
    good = [
        json.dumps(FULL),
        json.dumps({**FULL, "txn_id": "b", "amount": "abc"}),
        json.dumps({**FULL, "txn_id": "d", "event_time": "bad"}),
        json.dumps({**FULL, "txn_id": 5}),
    ]
    bad = ['{"amount":2}', "not json", "[]", "", None, '{"txn_id":"x","amo']
    out = parsed(spark, good + bad)
    assert out.columns == [*TRANSACTION.fieldNames(), "raw_value"]
    rows = {r.txn_id: r for r in ingest.good_rows(out).collect()}
    assert set(rows) == {"a", "b", "d", "5"}
    assert rows["b"].amount is None and rows["b"].card_id == "C1"
    assert rows["d"].event_time is None and rows["a"].event_time.microsecond == 123456
    letters = ingest.dead_letters(out).collect()
    assert {r.key for r in letters} == {"parse_failure"}
    assert sorted([r.value or "" for r in letters]) == sorted([b or "" for b in bad])


def test_bytes_and_source_time(spark):
    raw = spark.sql(
        "select cast('not json' as binary) value, timestamp'2026-01-01 12:00:10' timestamp union all "
        "select cast('[]' as binary), timestamp'2026-01-01 12:00:59' union all "
        "select cast('{\"txn_id\":\"1\"}' as binary), timestamp'2026-01-01 12:00:59' union all "
        "select cast('x' as binary), timestamp'2026-01-01 12:01:00'"
    )
    out = ingest.parse(raw)
    rate = {r.minute.minute: r.bad_messages for r in ingest.dlq_rate(out).collect()}
    assert rate == {0: 2, 1: 1} and ingest.good_rows(out).count() == 1


def test_not_a_number(spark):
    out = parsed(spark, ['{"txn_id":"n","card_id":"C1","amount":NaN}'])
    assert rules.high_value_single(out).count() == 1


def test_messages_round_trip(spark):
    txns = table(spark, [txn(txn_id=str(i), at=i, merchant_id=None, amount=0.1 + i) for i in range(2, 8)])
    back = ingest.good_rows(ingest.parse(fixtures.messages(txns))).select(*TRANSACTION.fieldNames())
    assert back.exceptAll(txns).count() == 0 and back.count() == 6


def test_alert_records(spark):
    alerts = rules.high_value_single(parsed(spark, [json.dumps(FULL)]))
    alerts = alerts.selectExpr("*", "'id' alert_id", "timestamp'2026-01-01 12:01:00' alert_time")
    with pytest.raises(ValueError, match="alert_id"):
        alert_records(alerts.drop("alert_id"))
    row = alert_records(alerts).first()
    assert row.key == "C1" and list(json.loads(row.value)) == MESSAGE_FIELDS
    assert json.loads(row.value)["window_start"] == "2026-01-01T12:00:00.123Z"
    assert json.loads(alert_records(alerts, precise=True).first().value)["window_start"] == "2026-01-01T12:00:00.123456Z"


def test_kafka_options():
    assert ingest.kafka_options("b:1", "in") == {
        "kafka.bootstrap.servers": "b:1",
        "subscribe": "in",
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": "10000",
    }
    secure = ingest.kafka_options("b:1", "in", "earliest", 5, **{"kafka.security.protocol": "SASL_SSL"})
    assert (secure["startingOffsets"], secure["kafka.security.protocol"]) == ("earliest", "SASL_SSL")
    assert kafka_sink_options("b:1", "out") == {"kafka.bootstrap.servers": "b:1", "topic": "out"}
