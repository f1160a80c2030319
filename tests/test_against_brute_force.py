"""Fused and single evaluation against a plain Python evaluation of the rules on random rows."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from samples import NOON, table, txn
from txnwatch.operators import rules as single
from txnwatch.operators.specs import RULES, WINDOW_RULES
from txnwatch.params import resolve
from txnwatch.plans.evaluate import evaluate

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
SHAPE = {
    "velocity_check": (5, 1),
    "high_window_amount": (5, 1),
    "rapid_merchant_switch": (5, 1),
    "geo_velocity": (30, 5),
    "round_amount_structuring": (10, 2),
    "cnp_spike": (10, 2),
    "multi_card_terminal": (10, 2),
    "declined_then_approved": (10, 2),
    "sub_threshold_structuring": (60, 5),
}
TUNED = {
    "velocity_txn_limit": 3,
    "geo_velocity_countries": 3,
    "rapid_merchant_distinct": 2,
    "multi_card_terminal": 2,
    "sub_threshold_min_txns": 2,
    "decline_min_count": 3,
    "cnp_spike_txns": 1,
    "round_amount_min_txns": 1,
}


def random_rows(seed, n=900):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        hot = rng.random() < 0.4  # one card, and one missing terminal, hold a large share
        rows.append(
            txn(
                card="HOT" if hot else rng.choice(["A", "B", "C", "D", None]),
                at=NOON + timedelta(microseconds=rng.choice([rng.randrange(7_200_000_000), rng.randrange(120) * 60_000_000])),
                amount=rng.choice([None, 0.0, 1_000.0, 5_000.0, 9_250.5, 9_999.75, 20_000.25, 31_000.0]),
                merchant_id=rng.choice([None, "", *[f"M{i}" for i in range(6)]]),
                terminal_id=None if hot else rng.choice(["T1", "T2"]),
                country=rng.choice(["IN"] * 8 + ["US", "AE", None]),
                channel=rng.choice(["ONLINE", "POS", None]),
                txn_status=rng.choice(["APPROVED", "DECLINED", "DECLINED", None]),
            )
        )
    return rows


def brute_force(rows, name, p):
    minutes, slide = SHAPE[name]
    groups = {}
    for r in rows:
        if name == "round_amount_structuring" and (r["amount"] is None or r["amount"] % p["round_amount_modulo"]):
            continue
        if name == "cnp_spike" and r["channel"] != "ONLINE":
            continue
        if name == "sub_threshold_structuring" and not (
            r["amount"] is not None and p["sub_threshold_low"] <= r["amount"] < p["sub_threshold_high"]
        ):
            continue
        newest = (r["event_time"] - EPOCH) // timedelta(minutes=slide)
        key = r["terminal_id"] if name == "multi_card_terminal" else r["card_id"]
        for i in range(minutes // slide):
            groups.setdefault((key, EPOCH + timedelta(minutes=slide * (newest - i))), []).append(r)
    out = Counter()
    for (key, start), g in groups.items():
        amounts = [r["amount"] for r in g if r["amount"] is not None]
        total = round(sum(amounts), 2) if amounts else None
        declines = sorted(r["event_time"] for r in g if r["txn_status"] == "DECLINED")
        approvals = [r["event_time"] for r in g if r["txn_status"] == "APPROVED"]

        def distinct(column):
            return len({r[column] for r in g} - {None})

        fires = {
            "velocity_check": lambda: len(g) > p["velocity_txn_limit"],
            "high_window_amount": lambda: total is not None and total > p["velocity_window_amount"],
            "rapid_merchant_switch": lambda: distinct("merchant_id") > p["rapid_merchant_distinct"],
            "geo_velocity": lambda: distinct("country") >= p["geo_velocity_countries"],
            "round_amount_structuring": lambda: len(g) >= p["round_amount_min_txns"],
            "cnp_spike": lambda: len(g) > p["cnp_spike_txns"],
            "multi_card_terminal": lambda: distinct("card_id") > p["multi_card_terminal"],
            "sub_threshold_structuring": lambda: len(g) >= p["sub_threshold_min_txns"],
            "declined_then_approved": lambda: (
                len(declines) >= p["decline_min_count"]
                and bool(approvals)
                and max(approvals) > declines[p["decline_min_count"] - 1]
            ),
        }[name]()
        if fires:
            card = key if name != "multi_card_terminal" else max(r["card_id"] for r in g if r["card_id"])
            out[(RULES[name].label, card, start.replace(tzinfo=None), len(g), total)] += 1
    return out


def collected(df):
    return Counter(
        (r.rule_triggered, r.card_id, r.window_start, r.txn_count, None if r.total_amount is None else round(r.total_amount, 2))
        for r in df.collect()
    )


@pytest.mark.parametrize("params", [None, TUNED], ids=["defaults", "tuned"])
def test_fused_rules(spark, params):
    rows = random_rows(7 if params else 11)
    expected = sum((brute_force(rows, n, resolve(params)) for n in WINDOW_RULES), Counter())
    assert len({k[0] for k in expected}) >= 8
    assert collected(evaluate(table(spark, rows), params, rules=WINDOW_RULES)) == expected


@pytest.mark.parametrize("name", ["rapid_merchant_switch", "multi_card_terminal", "sub_threshold_structuring", "declined_then_approved"])
def test_single_rules(spark, name):
    rows = random_rows(3, 500)
    assert collected(getattr(single, name)(table(spark, rows), TUNED)) == brute_force(rows, name, resolve(TUNED))


@pytest.mark.parametrize(
    "names",
    [
        ("geo_velocity", "rapid_merchant_switch"),
        ("velocity_check", "declined_then_approved"),
        ("cnp_spike", "sub_threshold_structuring"),
        ("round_amount_structuring", "cnp_spike"),
        ("sub_threshold_structuring", "geo_velocity", "multi_card_terminal"),
    ],
    ids="+".join,
)
def test_some_rules_together(spark, names):
    rows = random_rows(21, 500)
    expected = sum((brute_force(rows, n, resolve(TUNED)) for n in names), Counter())
    assert collected(evaluate(table(spark, rows), TUNED, rules=names)) == expected
