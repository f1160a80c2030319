"""The twelve rules as data: which rows count, over which window, and what makes them fire.

Conditions are SQL text with the parameters' names in braces. A rule says nothing about execution. ``plans.panes`` (tables) and ``plans.live`` (streams) work out
the columns a rule's ``fires`` condition reads, for any number of rules at once:

``<slice>_n`` / ``<slice>_total``   transactions and amount of the rows in the rule's slice
``distinct_<column>``               distinct non-null values of a column
``last_approval`` / ``nth_decline`` latest approval, and time of the Nth decline, in the window
"""

from __future__ import annotations

from dataclasses import dataclass

from txnwatch.functions.buckets import Sliding

# Fixed window lengths and slides, in minutes.
FIVE_MINUTES = Sliding(5, 1)
TEN_MINUTES = Sliding(10, 2)
HALF_HOUR = Sliding(30, 5)
ONE_HOUR = Sliding(60, 5)

# Row conditions of the slices a rule may count over.
SLICES: dict[str, str] = {
    "all": "true",
    "round": "amount % {round_amount_modulo} = 0",
    "online": "channel = 'ONLINE'",
    "band": "amount >= {sub_threshold_low} and amount < {sub_threshold_high}",
}


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    score: int
    fires: str | None = None  # condition on a row, or on a window's measures
    window: Sliding | None = None  # None: decided on each row alone
    key: str = "card_id"
    slice: str = "all"
    distinct: str | None = None  # column whose distinct values are compared ...
    distinct_limit: str | None = None  # ... with this parameter
    sequence: bool = False  # needs last_approval and nth_decline

    def condition(self, params: dict) -> str:
        return self.fires.format(**params)


_LOCAL_HOUR = "hour(from_utc_timestamp(event_time, '{unusual_hour_timezone}'))"

# Labels and scores are fixed values.
RULES: dict[str, Rule] = {
    r.name: r
    for r in (
        Rule(
            "velocity_check",
            "HIGH_VELOCITY",
            85,
            "all_n > {velocity_txn_limit}",
            FIVE_MINUTES,
        ),
        Rule(
            "high_value_single",
            "HIGH_VALUE_SINGLE_TXN",
            80,
            "amount > {high_value_single}",
        ),
        Rule(
            "high_window_amount",
            "HIGH_WINDOW_AMOUNT",
            90,
            "all_total > {velocity_window_amount}",
            FIVE_MINUTES,
        ),
        Rule(
            "geo_velocity",
            "GEO_VELOCITY",
            95,
            "distinct_country >= {geo_velocity_countries}",
            HALF_HOUR,
            distinct="country",
            distinct_limit="geo_velocity_countries",
        ),
        Rule(
            "unusual_hour",
            "UNUSUAL_HOUR",
            50,
            f"{_LOCAL_HOUR} >= {{unusual_hour_start}} and {_LOCAL_HOUR} < {{unusual_hour_end}} "
            "and amount > {unusual_hour_min_amount}",
        ),
        Rule(
            "round_amount_structuring",
            "ROUND_AMOUNT_STRUCTURING",
            75,
            "round_n >= {round_amount_min_txns}",
            TEN_MINUTES,
            slice="round",
        ),
        Rule(
            "rapid_merchant_switch",
            "RAPID_MERCHANT_SWITCH",
            70,
            "distinct_merchant_id > {rapid_merchant_distinct}",
            FIVE_MINUTES,
            distinct="merchant_id",
            distinct_limit="rapid_merchant_distinct",
        ),
        Rule(
            "cnp_spike",
            "CNP_SPIKE",
            65,
            "online_n > {cnp_spike_txns}",
            TEN_MINUTES,
            slice="online",
        ),
        Rule(
            "multi_card_terminal",
            "MULTI_CARD_TERMINAL",
            80,
            "distinct_card_id > {multi_card_terminal}",
            TEN_MINUTES,
            key="terminal_id",
            distinct="card_id",
            distinct_limit="multi_card_terminal",
        ),
        Rule("dormant_card", "DORMANT_CARD", 60),
        Rule(
            "sub_threshold_structuring",
            "SUB_THRESHOLD_STRUCT",
            85,
            "band_n >= {sub_threshold_min_txns}",
            ONE_HOUR,
            slice="band",
        ),
        Rule(
            "declined_then_approved",
            "DECLINED_THEN_APPROVED",
            90,
            # Enough declines before the last approval; both sides are null when there are none.
            "last_approval > nth_decline",
            TEN_MINUTES,
            sequence=True,
        ),
    )
}

ROW_RULES = [n for n, r in RULES.items() if r.fires is not None and r.window is None]
WINDOW_RULES = [n for n, r in RULES.items() if r.window is not None]
# Rules that need nothing but the transactions.
SINGLE_INPUT_RULES = [n for n, r in RULES.items() if r.fires is not None]


def slice_condition(name: str, params: dict) -> str:
    return SLICES[name].format(**params)


def slices_of(rules: list[Rule]) -> list[str]:
    return sorted({r.slice for r in rules})


def windows_of(rules: list[Rule]) -> list[Sliding]:
    return sorted({r.window for r in rules}, key=lambda w: (w.minutes, w.slide))
