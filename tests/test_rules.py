"""Each rule at and around its limits. All cases of a rule share one run: a card per case."""

from datetime import datetime, timezone

import pytest
from samples import table, txn
from txnwatch.operators import rules


def at(hour, minute=0, second=0):
    return datetime(2026, 1, 1, hour, minute, second, tzinfo=timezone.utc)


def every(seconds, n, **fields):
    return [dict(at=i * seconds, **fields) for i in range(n)]


def statuses(letters, gap=60):
    names = {"D": "DECLINED", "A": "APPROVED"}
    return [dict(at=i * gap, txn_status=names[s]) for i, s in enumerate(letters)]


# rule -> case -> (rows, fires)
CASES = {
    "velocity_check": {
        "six": (every(30, 6), True),
        "five": (every(30, 5), False),
        "six spread over an hour": (every(600, 6), False),
    },
    "high_value_single": {
        "above": ([dict(amount=35_000.0)], True),
        "equal": ([dict(amount=30_000.0)], False),
        "small": ([dict()], False),
        "null amount": ([dict(amount=None)], False),
        "not a number": ([dict(amount=float("nan"))], True),
    },
    "high_window_amount": {
        "above": (every(30, 4, amount=15_000.0), True),
        "below": (every(30, 4, amount=10_000.0), False),
        "equal": (every(30, 5, amount=10_000.0), False),
    },
    "geo_velocity": {
        "two countries": ([dict(), dict(at=300, country="US")], True),
        "three countries": ([dict(country=c, at=60 * i) for i, c in enumerate(["IN", "AE", "GB"])], True),
        "one country": (every(60, 4), False),
        "null is no country": ([dict(), dict(at=60, country=None)], False),
        "empty text is one": ([dict(), dict(at=60, country="")], True),
        "half an hour apart": ([dict(), dict(at=1800, country="US")], False),
    },
    "unusual_hour": {
        "night": ([dict(at=at(2, 30), amount=10_000.0)], True),
        "first second": ([dict(at=at(1), amount=10_000.0)], True),
        "before": ([dict(at=at(0, 59, 59), amount=10_000.0)], False),
        "last second": ([dict(at=at(3, 59, 59), amount=10_000.0)], True),
        "after": ([dict(at=at(4), amount=10_000.0)], False),
        "noon": ([dict(amount=10_000.0)], False),
        "equal amount": ([dict(at=at(2), amount=5_000.0)], False),
        "small amount": ([dict(at=at(2), amount=100.0)], False),
    },
    "round_amount_structuring": {
        "three": (every(60, 3, amount=5_000.0), True),
        "two": (every(60, 2, amount=5_000.0), False),
        "not round": (every(60, 5, amount=5_432.0), False),
        "zero and negative": ([dict(amount=a, at=i) for i, a in enumerate([0.0, -1_000.0, 2_000.0])], True),
    },
    "rapid_merchant_switch": {
        "five": ([dict(at=30 * i, merchant_id=f"M{i}") for i in range(5)], True),
        "four": ([dict(at=30 * i, merchant_id=f"M{i}") for i in range(4)], False),
        "one, often": (every(20, 10), False),
        "null is no merchant": ([dict(at=30 * i, merchant_id=f"M{i}" if i else None) for i in range(5)], False),
        "five, but not in one window": ([dict(at=75 * i, merchant_id=f"M{i}") for i in range(5)], False),
    },
    "cnp_spike": {
        "four online": (every(60, 4, channel="ONLINE"), True),
        "three online": (every(60, 3, channel="ONLINE"), False),
        "at machines": (every(60, 5, channel="ATM"), False),
        "null channel": (every(60, 5, channel=None), False),
    },
    "sub_threshold_structuring": {
        "five": (every(120, 5, amount=9_500.0), True),
        "four": (every(120, 4, amount=9_500.0), False),
        "low end": (every(120, 5, amount=9_000.0), True),
        "high end": (every(120, 5, amount=10_000.0), False),
        "above": (every(120, 5, amount=10_500.0), False),
        "below": (every(120, 5, amount=8_000.0), False),
    },
    "declined_then_approved": {
        "D D A": (statuses("DDA"), True),
        "A D D A": (statuses("ADDA"), True),
        "D D D": (statuses("DDD"), False),
        "A A A": (statuses("AAA"), False),
        "D A": (statuses("DA"), False),
        "A D D": (statuses("ADD"), False),
        "D A D": (statuses("DAD"), False),
        "approval at the time of the last decline": (statuses("DDA", gap=0), False),
        "both declines at once": ([dict(txn_status="DECLINED")] * 2 + [dict(at=1)], True),
    },
}


@pytest.mark.parametrize("rule", CASES)
def test_rule(spark, rule):
    cases = CASES[rule]
    rows = [txn(card=name, **{"at": 0, **fields}) for name, (given, _) in cases.items() for fields in given]
    out = getattr(rules, rule)(table(spark, rows)).collect()
    assert {r.card_id for r in out} == {name for name, (_, fires) in cases.items() if fires}


def test_counts_cover_only_the_rows_of_the_rule(spark):
    rows = [txn(at=i, channel="ONLINE", amount=10.0) for i in range(4)] + [txn(at=5, amount=99.0)]
    out = rules.cnp_spike(table(spark, rows)).collect()
    assert len(out) == 5  # one alert per covering window
    assert {(r.txn_count, r.total_amount, r.risk_score) for r in out} == {(4, 40.0, 65)}
    # null amounts and null ids
    rows = [txn(at=i, amount=None if i else 7.0) for i in range(6)] + [txn(at=9, txn_id=None, amount=1.0)]
    out = rules.velocity_check(table(spark, rows)).collect()
    assert {(r.txn_count, r.total_amount) for r in out} == {(6, 8.0)}


def test_terminals(spark):
    rows = [txn(card=f"C{i}", at=60 * i, terminal_id="six") for i in range(6)]
    rows += [txn(card=f"D{i}", at=60 * i, terminal_id="five") for i in range(5)]
    rows += [txn(card="E", at=20 * i, terminal_id="same") for i in range(10)]
    rows += [txn(card=f"F{i}", at=10 * i, terminal_id=None, channel="ONLINE") for i in range(7)]
    out = rules.multi_card_terminal(table(spark, rows)).collect()
    # six cards of one terminal, and those without a terminal as one group; the largest card stands for them
    assert {r.card_id for r in out} == {"C5", "F6"}
    assert {r.txn_count for r in out if r.card_id == "C5"} == {6}


def test_dormant_cards(spark):
    txns = table(spark, [txn(card="C1", amount=1.0), txn(card="C1", at=5), txn(card="C2"), txn(card="C1", at=None)])
    listed = spark.createDataFrame([("C1",), ("C1",), ("C9",)], "card_id string")
    out = rules.dormant_card(txns, listed).collect()
    assert [(r.card_id, r.txn_count, r.rule_triggered) for r in out] == [("C1", 1, "DORMANT_CARD")] * 3
    assert sum(r.window_start is None for r in out) == 1
    assert rules.dormant_card(txns, listed.where("false")).count() == 0


def test_local_hour(spark):
    txns = table(spark, [txn(card="21h", at=at(21), amount=9_000.0), txn(card="2h", at=at(2, 30), amount=9_000.0)])
    india = {"unusual_hour_timezone": "Asia/Kolkata"}
    assert [r.card_id for r in rules.unusual_hour(txns, india).collect()] == ["21h"]


def test_windows_are_half_open_and_aligned(spark):
    rows = [txn(at=at(12, 0, 59)) for _ in range(6)] + [txn(card="B", at=at(12, 1)) for _ in range(6)]
    out = rules.velocity_check(table(spark, rows)).collect()
    starts = {c: sorted(r.window_start.strftime("%H:%M") for r in out if r.card_id == c) for c in ("C1", "B")}
    assert starts["C1"] == ["11:56", "11:57", "11:58", "11:59", "12:00"]
    assert starts["B"] == ["11:57", "11:58", "11:59", "12:00", "12:01"]


def test_before_1970(spark):
    rows = [txn(at=datetime(1969, 12, 31, 23, 59, 30, tzinfo=timezone.utc)) for _ in range(6)]
    out = rules.velocity_check(table(spark, rows)).selectExpr("cast(window_start as string) s").collect()
    assert min(r.s for r in out) == "1969-12-31 23:55:00" and len(out) == 5


def test_null_event_time(spark):
    txns = table(spark, [txn(at=None, amount=40_000.0) for _ in range(7)])
    assert rules.velocity_check(txns).count() == 0
    out = rules.high_value_single(txns).collect()
    assert len(out) == 7 and out[0].window_start is None


def test_tuned_rules(spark):
    rows = [txn(at=i, country=c, txn_status=s) for i, (c, s) in enumerate(zip(["IN", "US", "AE"], ["DECLINED", "APPROVED", "APPROVED"]))]
    txns = table(spark, rows)
    assert rules.velocity_check(txns, {"velocity_txn_limit": 2}).count() == 5
    assert rules.geo_velocity(txns, {"geo_velocity_countries": 4}).count() == 0
    assert rules.geo_velocity(txns, {"geo_velocity_countries": 3}).count() == 6
    assert rules.declined_then_approved(txns, {"decline_min_count": 1}).count() == 5
