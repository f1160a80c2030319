"""One function per rule, for tables and streams alike: transactions in, alerts out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from txnwatch.operators.specs import RULES, SINGLE_INPUT_RULES
from txnwatch.params import resolve
from txnwatch.plans.evaluate import single_rule


def velocity_check(txns: DataFrame, params: dict | None = None) -> DataFrame:
    """More than ``velocity_txn_limit`` transactions of a card in 5 minutes."""
    return single_rule("velocity_check", txns, params)


def high_value_single(txns: DataFrame, params: dict | None = None) -> DataFrame:
    """A transaction above ``high_value_single``."""
    return single_rule("high_value_single", txns, params)


def high_window_amount(txns: DataFrame, params: dict | None = None) -> DataFrame:
    """More than ``velocity_window_amount`` spent with a card in 5 minutes."""
    return single_rule("high_window_amount", txns, params)


def geo_velocity(txns: DataFrame, params: dict | None = None) -> DataFrame:
    """A card in at least ``geo_velocity_countries`` countries within 30 minutes."""
    return single_rule("geo_velocity", txns, params)


def unusual_hour(txns: DataFrame, params: dict | None = None) -> DataFrame:
    """Above ``unusual_hour_min_amount`` from hour ``_start`` up to, not including, hour ``_end``."""
    return single_rule("unusual_hour", txns, params)


def round_amount_structuring(txns: DataFrame, params: dict | None = None) -> DataFrame:
    """At least ``round_amount_min_txns`` multiples of ``round_amount_modulo`` in 10 minutes."""
    return single_rule("round_amount_structuring", txns, params)


def rapid_merchant_switch(txns: DataFrame, params: dict | None = None) -> DataFrame:
    """A card at more than ``rapid_merchant_distinct`` merchants within 5 minutes."""
    return single_rule("rapid_merchant_switch", txns, params)


def cnp_spike(txns: DataFrame, params: dict | None = None) -> DataFrame:
    """More than ``cnp_spike_txns`` online transactions of a card in 10 minutes."""
    return single_rule("cnp_spike", txns, params)


def multi_card_terminal(txns: DataFrame, params: dict | None = None) -> DataFrame:
    """More than ``multi_card_terminal`` cards at a terminal within 10 minutes.

    The alert carries the largest card id of the window. Rows without a terminal form one group.
    """
    return single_rule("multi_card_terminal", txns, params)


def dormant_card(txns: DataFrame, dormant: DataFrame) -> DataFrame:
    """Every transaction of a card in the ``dormant`` list."""
    return single_rule("dormant_card", txns, None, dormant=dormant)


def sub_threshold_structuring(txns: DataFrame, params: dict | None = None) -> DataFrame:
    """At least ``sub_threshold_min_txns`` amounts in ``[low, high)`` within an hour."""
    return single_rule("sub_threshold_structuring", txns, params)


def declined_then_approved(txns: DataFrame, params: dict | None = None) -> DataFrame:
    """``decline_min_count`` declines of a card and then an approval, within 10 minutes."""
    return single_rule("declined_then_approved", txns, params)


class BoundRule:
    """A rule with its parameters, which are checked once, here."""

    def __init__(self, name: str, params: dict | None) -> None:
        self.spec, self.params = RULES[name], resolve(params)
        self.__name__, self.__doc__ = name, f"Alerts of {self.spec.label}."

    def __call__(self, txns: DataFrame) -> DataFrame:
        return single_rule(self.spec.name, txns, self.params)


def build_rules(params: dict | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The rules that need only transactions, by name, with ``params`` bound."""
    return {name: BoundRule(name, params) for name in SINGLE_INPUT_RULES}
