"""Aggregates that are the same on tables and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnwatch.functions.buckets import EVENT_MICROS
from txnwatch.operators.specs import Rule, slice_condition, slices_of


def totals(key: str, rules: list[Rule], params: dict) -> dict[str, str]:
    """SQL of the aggregates over rows that add up from panes to windows, by name.

    With only one slice the rows are expected to be filtered already.
    """
    slices = slices_of(rules)
    out = {}
    for s in slices:
        if s == "all" or len(slices) == 1:
            out[f"{s}_n"], out[f"{s}_total"] = "count(txn_id)", "sum(amount)"
        else:
            inside = slice_condition(s, params)
            out[f"{s}_n"] = f"count(case when {inside} then txn_id end)"
            out[f"{s}_total"] = f"sum(case when {inside} then amount end)"
    if any(r.sequence for r in rules):
        out["last_approval"] = f"max(case when txn_status = 'APPROVED' then {EVENT_MICROS} end)"
    if key != "card_id":
        out["top_card"] = "max(card_id)"
    return out


def named(measures: dict[str, str]) -> list[Column]:
    return [F.expr(f"{sql} as {name}") for name, sql in measures.items()]
