"""From measured rows or windows to alert rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.specs import Rule, slices_of, windows_of


def row_alerts(txns: DataFrame, rules: list[Rule], params: dict, closing: bool = False) -> DataFrame:
    """Alerts of the rules that look at one transaction at a time: no shuffle, no state."""
    fired = {r: r.condition(params) for r in rules}
    closes = "event_time" if closing else None
    return _alerts(txns, fired, "card_id", "event_time", "event_time", {"all": ("1", "amount")}, closes)


def row_and_dormant_alerts(txns: DataFrame, rules: list[Rule], params: dict, rule: Rule, dormant: DataFrame, closing: bool) -> DataFrame:
    """``row_alerts`` and ``dormant_alerts`` from one scan, the card list as a flag on every row.

    The list is made distinct first, so the join gives each row once. It is sized by the planner, as above.
    """
    listed = dormant.select("card_id").distinct().withColumn("listed", F.lit(True))
    flagged = txns.select("card_id", "event_time", "amount").join(listed, "card_id", "left_outer")
    return row_alerts(flagged, [*rules, replace(rule, fires="coalesce(listed, false)")], params, closing)


def window_alerts(measures: DataFrame, rules: list[Rule], params: dict, closing: bool = False) -> DataFrame:
    """Alerts of the window rules of one key, from one row of measures per key and window.

    ``shape`` tells windows of different length or slide apart.
    """
    windows = windows_of(rules)
    fired = {}
    for r in rules:
        condition = r.condition(params)
        fired[r] = f"shape = {windows.index(r.window)} and ({condition})" if len(windows) > 1 else condition
    counted = {s: (f"{s}_n", f"{s}_total") for s in slices_of(rules)}
    card = "card_id" if rules[0].key == "card_id" else "top_card"
    return _alerts(measures, fired, card, "window_start", "window_end", counted, "closes_at" if closing else None)


def dormant_alerts(txns: DataFrame, rule: Rule, dormant: DataFrame, closing: bool = False) -> DataFrame:
    """Every transaction of a listed card.

    A semi-join, so a card listed twice does not double its alerts. No broadcast hint: the list
    grows with the customer base. The planner broadcasts it while its size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond, where adaptive execution splits
    the partition of a hot card.
    """
    listed = txns.join(dormant.select("card_id"), "card_id", "left_semi")
    return row_alerts(listed, [replace(rule, fires="true")], {}, closing)


def _alerts(
    df: DataFrame,
    fired: dict[Rule, str],
    card: str,
    start: str,
    end: str,
    counted: dict[str, tuple[str, str]],
    closes: str | None = None,
) -> DataFrame:
    """One alert per row of ``df`` and rule that fires on it, in a single pass.

    ``closes`` is a column that carries a stream's watermark beyond the alerts.
    """
    rules = list(fired)
    if len(rules) == 1:
        hits = df.where(fired[rules[0]])
        count, total = counted[rules[0].slice]
        label, score = f"'{rules[0].label}'", str(rules[0].score)
    else:
        # Rows that fire nothing, nearly all of them, are dropped before the fan-out. What is
        # fanned out is the rule's number: whole alerts would make far more code per row.
        numbers = ", ".join(f"case when {condition} then {i} end" for i, condition in enumerate(fired.values()))
        hits = df.where(" or ".join(f"({c})" for c in fired.values()))
        hits = hits.selectExpr("*", f"explode(array({numbers})) as rule").where("rule is not null")
        count, total = (_by_rule([(counted[r.slice][part]) for r in rules]) for part in (0, 1))
        label = f"get(array({', '.join(repr(r.label) for r in rules)}), rule)"
        score = f"get(array({', '.join(str(r.score) for r in rules)}), rule)"
    return hits.selectExpr(
        f"{card} as card_id",
        f"{start} as window_start",
        f"{end} as window_end",
        f"cast({count} as int) as txn_count",
        f"cast({total} as double) as total_amount",
        f"{label} as rule_triggered",
        f"{score} as risk_score",
        *([f"{closes} as closes_at"] if closes else []),
    )


def _by_rule(columns: list[str]) -> str:
    """The column that belongs to ``rule``."""
    cases = []
    for column in sorted(set(columns)):
        numbers = ", ".join(str(i) for i, c in enumerate(columns) if c == column)
        cases.append(f"when rule in ({numbers}) then {column}")
    return f"case {' '.join(cases)} end"
