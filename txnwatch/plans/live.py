"""Sliding-window measures on streams.

A stream allows one aggregation between source and sink in update mode, so rows go straight into
Spark's event-time windows; all rules that share key and window share one aggregation and one
state store. Windows of a rule on the order of events are kept by ``plans.sequences`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from txnwatch.functions.distinct import distinct_up_to
from txnwatch.operators.specs import Rule, slice_condition, slices_of
from txnwatch.plans import sequences
from txnwatch.plans.totals import named, totals


def window_measures(txns: DataFrame, rules: list[Rule], params: dict, mode: str) -> DataFrame:
    """The columns of ``panes.window_measures`` for rules of one key and one window."""
    if any(r.sequence for r in rules):
        sequences.use_rocksdb(txns.sparkSession)
        return sequences.window_measures(txns, rules, params, mode)
    (key,) = {r.key for r in rules}
    (window,) = {r.window for r in rules}
    slices = slices_of(rules)
    rows = txns
    if "all" not in slices:  # rows that no rule counts make no state
        rows = rows.where(" or ".join(f"({slice_condition(s, params)})" for s in slices))

    measures = totals(key, rules, params)
    for r in rules:
        if r.distinct:
            measures[f"distinct_{r.distinct}"] = distinct_up_to(r.distinct, params[r.distinct_limit])
    return (
        rows.groupBy(window.column.alias("window"), key)
        .agg(*named(measures))
        .selectExpr("*", "window.start as window_start", "window.end as window_end", "window_time(window) as closes_at")
    )
