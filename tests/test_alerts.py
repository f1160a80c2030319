import logging

import pytest
from pyspark.errors import AnalysisException
from samples import NOON, table, txn
from txnwatch import ALERT, ALERT_COLUMNS, TRANSACTION, build_rules, evaluate
from txnwatch.operators import rules
from txnwatch.operators.alerts import (
    alert_triage,
    alerts_by_rule,
    card_risk_rollup,
    dedup_alerts,
    detection_latency,
    with_alert_id,
)
from txnwatch.operators.dormant import dormant_list
from txnwatch.plans.evaluate import all_alerts
from txnwatch.streaming import jobs

MID = 1800  # half past, so that a burst's windows all start in the same hour


def test_contracts():
    assert len(TRANSACTION) == 14 and TRANSACTION["amount"].dataType.typeName() == "double"
    assert [f.name for f in TRANSACTION if not f.nullable] == ["txn_id", "card_id", "amount", "event_time"]
    assert ALERT_COLUMNS == [f.name for f in ALERT][:7] and not any(f.nullable for f in ALERT)


def test_every_rule_returns_the_contract(spark):
    txns = table(spark, [])
    types = [(f.name, f.dataType) for f in ALERT][:7]
    for name, rule in build_rules().items():
        assert [(f.name, f.dataType) for f in rule(txns).schema] == types, name
        assert rule.__name__ == name
    assert len(build_rules()) == 11
    assert [(f.name, f.dataType) for f in rules.dormant_card(txns, txns).schema] == types
    assert [(f.name, f.dataType) for f in evaluate(txns, dormant=txns).schema] == types


def test_alert_ids(spark):
    burst = lambda card, start: [txn(card=card, at=start + 10 * i) for i in range(8)]
    rows = burst("mid", MID) + burst("edge", 0) + burst("other", MID)
    rows += [txn(card="row", at=a, amount=40_000.0) for a in (0, 5, 5)] + [txn(card="null", at=None, amount=40_000.0)]
    txns = table(spark, rows)
    out = all_alerts(txns, rules=["velocity_check", "high_value_single"])
    ids = {}
    for r in out.collect():
        ids.setdefault(r.card_id, []).append(r.alert_id)
    assert len(ids["mid"]) > 1 and len(set(ids["mid"])) == 1
    assert len(set(ids["edge"])) == 2
    assert not set(ids["mid"]) & set(ids["other"])
    assert len(ids["row"]) == 3 and len(set(ids["row"])) == 2
    import hashlib

    assert ids["null"] == [hashlib.md5(b"null|HIGH_VALUE_SINGLE_TXN").hexdigest()]
    finer = with_alert_id(evaluate(txns, rules=["velocity_check"]), bucket_seconds=60)
    assert finer.where("card_id = 'mid'").select("alert_id").distinct().count() > 1
    with pytest.raises(ValueError):
        with_alert_id(out, 0)


def test_operators_on_alerts(spark):
    def alert(card, minute, rule, score, total=1.0):
        start = NOON.replace(minute=minute)
        return (card, start, start.replace(minute=minute + 5), 6, total, rule, score)

    rows = [
        alert("C1", 30, "HIGH_VELOCITY", 85),
        alert("C1", 31, "HIGH_VELOCITY", 85),
        alert("C1", 31, "GEO_VELOCITY", 95),
        alert("C2", 30, "UNUSUAL_HOUR", 50),
        alert("C2", 30, "ROUND", 70),
        alert("C2", 30, "HIGH_WINDOW_AMOUNT", 90),
    ]
    alerts = with_alert_id(spark.createDataFrame(rows, ALERT_DDL))
    tiers = {r.risk_score: r.triage for r in alert_triage(alerts).collect()}
    assert tiers == {50: "monitor", 70: "review", 85: "review", 90: "block", 95: "block"}

    first = dedup_alerts(alerts)
    assert first.columns == alerts.columns and first.count() == 5
    assert first.where("rule_triggered = 'HIGH_VELOCITY'").first().window_start.minute == 30

    cards = {r.card_id: r for r in card_risk_rollup(alerts).collect()}
    assert (cards["C1"].rules_fired, cards["C1"].rules, cards["C1"].alerts) == (2, "GEO_VELOCITY,HIGH_VELOCITY", 3)
    assert (cards["C1"].max_risk, cards["C1"].risk_sum, cards["C2"].rules_fired) == (95, 265, 3)

    assert alerts_by_rule(alerts, "HIGH_VELOCITY", "2026-01-01 12:31:00").count() == 1
    assert alerts_by_rule(alerts, "HIGH_VELOCITY", "2026-01-09 12:31:00").count() == 0

    timed = alerts.selectExpr("*", "window_end + interval 90 seconds as alert_time")
    assert {r.avg_seconds for r in detection_latency(timed).collect()} == {90.0}


ALERT_DDL = (
    "card_id string, window_start timestamp, window_end timestamp, txn_count int, total_amount double, "
    "rule_triggered string, risk_score int"
)


def test_a_broken_rule_is_left_out(spark, caplog):
    txns = table(spark, [txn(amount=40_000.0)])

    def broken(df):
        return df.select("no_such_column")

    with caplog.at_level(logging.ERROR):
        skipped = []
        out = evaluate(
            txns, rules=["high_value_single"], extra_rules={"broken": broken}, on_error="skip", skipped=skipped
        )
    assert skipped == ["broken"]
    assert out.count() == 1 and "broken" in caplog.text
    # an input without a column that some rules need
    out = evaluate(txns.drop("country", "terminal_id"), on_error="skip")
    assert {r.rule_triggered for r in out.collect()} == {"HIGH_VALUE_SINGLE_TXN"}
    with pytest.raises(ValueError, match="no rule"):
        evaluate(txns, rules=[], extra_rules={"broken": broken}, on_error="skip")
    with pytest.raises(ValueError, match="unknown rules"):
        evaluate(txns, rules=["nope"])


def test_tables_are_strict(spark, tmp_path):
    txns = table(spark, [txn(amount=40_000.0)])
    with pytest.raises(AnalysisException):
        evaluate(txns, rules=["high_value_single"], extra_rules={"broken": lambda df: df.select("no_such_column")})
    with pytest.raises(AnalysisException):
        jobs.write_alerts(txns.drop("country"), str(tmp_path / "alerts"))


def test_an_extra_rule_joins_in(spark):
    txns = table(spark, [txn(amount=40_000.0)])
    out = evaluate(txns, rules=["high_value_single"], extra_rules={"again": rules.high_value_single})
    assert out.count() == 2


def test_zoneless_times_are_utc(spark):
    txns = table(spark, [txn(amount=40_000.0)])
    naive = txns.withColumn("event_time", txns.event_time.cast("timestamp_ntz"))
    assert rules.high_value_single(naive).collect() == rules.high_value_single(txns).collect()


def test_dormant_list(spark):
    rows = [txn(card="old", at=-40 * 86400), txn(card="back", at=-40 * 86400), txn(card="back"), txn(card="new", at=-86400)]
    out = dormant_list(table(spark, rows), "2026-01-02 00:00:00").collect()
    assert [r.card_id for r in out] == ["old"]


def test_alert_table(spark, tmp_path):
    rows = [txn(at=i, amount=40_000.0) for i in range(6)]
    stored = jobs.write_alerts(table(spark, rows), str(tmp_path / "alerts"))
    assert (tmp_path / "alerts" / "rule_triggered=HIGH_VELOCITY").is_dir()
    assert stored.where("rule_triggered = 'HIGH_VALUE_SINGLE_TXN'").count() == 6
    audit = alerts_by_rule(stored, "HIGH_VELOCITY", "2026-01-02 00:00:00")
    plan = audit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rule_triggered" in plan and audit.count() == 5
    assert detection_latency(stored).count() == stored.select("rule_triggered").distinct().count()

    jobs.write_dormant_list(table(spark, rows), "2026-03-01 00:00:00", str(tmp_path / "dormant"))
    assert [r.card_id for r in jobs.stored_dormant_cards(spark, str(tmp_path / "dormant")).collect()] == ["C1"]
    assert jobs.stored_dormant_cards(spark, str(tmp_path / "missing")) is None
    assert "alert_time" in stored.columns
