"""Run any set of rules over transactions, on a table or on a stream."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.alerts import with_alert_id
from txnwatch.operators.specs import RULES, SINGLE_INPUT_RULES, Rule
from txnwatch.params import resolve
from txnwatch.plans import emit, live, panes, trial
from txnwatch.schemas import to_alert_contract, with_instant_event_time

log = logging.getLogger(__name__)

WATERMARK = "2 minutes"


def evaluate(
    txns: DataFrame,
    params: dict | None = None,
    rules: Iterable[str] | None = None,
    dormant: DataFrame | None = None,
    extra_rules: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    on_error: str | None = None,
    skipped: list[str] | None = None,
    mode: str | None = None,
    closing: bool = False,
) -> DataFrame:
    """Alerts of the named rules (default: all), in the alert contract.

    Without a ``dormant`` card list the dormant-card rule is left out. ``extra_rules`` are further
    functions from transactions to alerts. With ``on_error="raise"``, the default on tables, a rule that
    cannot be built raises; with "skip", the default on streams, it is logged and its name is added to
    ``skipped`` where given, and the others go on. On streams that holds also for a rule that Spark refuses
    to start in output ``mode`` (None: in both), which is tried beforehand (``plans.trial``).

    ``closing`` adds ``closes_at``, the last instant of a window (to a microsecond before its end) or the row's
    time. On streams it carries the watermark, which the other times do not, into a further aggregation; extra
    rules have to bring it themselves.
    """
    skip = txns.isStreaming if on_error is None else {"skip": True, "raise": False}[on_error]
    params = resolve(params)
    names = list(RULES) if rules is None else list(rules)
    unknown = sorted(set(names) - set(RULES))
    if unknown:
        raise ValueError(f"unknown rules: {unknown}")
    if "dormant_card" in names and dormant is None:
        log.warning("dormant_card left out: no card list given")
        names = [n for n in names if n != "dormant_card"]
    txns = with_instant_event_time(txns)
    extra = dict(extra_rules or {})

    def build(source: DataFrame, chosen: list[tuple[str, str]]) -> DataFrame:
        own = [name for kind, name in chosen if kind == "rule"]
        listed = dormant if "dormant_card" in own else None
        branches = _fused(source, [RULES[n] for n in own if n in SINGLE_INPUT_RULES], params, mode or "append", closing, listed)
        branches += [to_alert_contract(extra[name](source), closing) for kind, name in chosen if kind == "extra"]
        return reduce(DataFrame.unionByName, branches)

    chosen = [("rule", n) for n in names] + [("extra", n) for n in extra]
    if skip and chosen:
        chosen = _startable(txns, chosen, build, mode, [] if skipped is None else skipped)
    if not chosen:
        raise ValueError("no rule could be built on this input")
    return build(txns, chosen)


def single_rule(
    name: str, txns: DataFrame, params: dict | None = None, dormant: DataFrame | None = None
) -> DataFrame:
    """Alerts of one rule; what is wrong with it is raised."""
    params = resolve(params)
    txns = with_instant_event_time(txns)
    if name == "dormant_card":
        return emit.dormant_alerts(txns, RULES[name], dormant)
    return _fused(txns, [RULES[name]], params)[0]


def all_alerts(txns: DataFrame, *args, bucket_seconds: int = 3600, **kwargs) -> DataFrame:
    """``evaluate`` with the deterministic alert id."""
    return with_alert_id(evaluate(txns, *args, **kwargs), bucket_seconds)


def stream_alerts(txns: DataFrame, *args, watermark: str = WATERMARK, **kwargs) -> DataFrame:
    """``all_alerts`` on a stream of transactions, stamped with the time of detection.

    The watermark is set once, on the shared input: window rules drop rows that are later than
    that, row rules have no state and keep them. Give ``mode="update"`` for a sink that takes changed
    windows; the default, whole windows, goes to sinks of both modes.
    """
    watermarked = with_instant_event_time(txns).withWatermark("event_time", watermark)
    return with_alert_time(all_alerts(watermarked, *args, **kwargs))


def with_alert_time(alerts: DataFrame) -> DataFrame:
    """Time of detection: one value per query or micro-batch."""
    return alerts.withColumn("alert_time", F.current_timestamp())


def _fused(
    txns: DataFrame,
    rules: list[Rule],
    params: dict,
    mode: str = "append",
    closing: bool = False,
    dormant: DataFrame | None = None,
) -> list[DataFrame]:
    branches = []
    row_rules = [r for r in rules if r.window is None]
    if row_rules and dormant is not None and not txns.isStreaming:
        rule = RULES["dormant_card"]
        branches.append(emit.row_and_dormant_alerts(txns, row_rules, params, rule, dormant, closing))
        row_rules, dormant = [], None
    if dormant is not None:
        branches.append(emit.dormant_alerts(txns, RULES["dormant_card"], dormant, closing))
    if row_rules:
        branches.append(emit.row_alerts(txns, row_rules, params, closing))

    def shared(r: Rule):
        return (r.key, r.window.minutes, r.window.slide) if txns.isStreaming else r.key

    windowed = sorted((r for r in rules if r.window is not None), key=shared)
    for _, group in groupby(windowed, key=shared):
        group = list(group)
        if txns.isStreaming:
            measures = live.window_measures(txns, group, params, mode)
        else:
            measures = panes.window_measures(txns, group, params)
            if closing:
                measures = measures.withColumn("closes_at", F.expr("window_end - interval 1 microsecond"))
        branches.append(emit.window_alerts(measures, group, params, closing))
    return branches


def _startable(
    txns: DataFrame, chosen: list[tuple[str, str]], build: Callable[..., DataFrame], mode: str | None, dropped: list[str]
) -> list[tuple[str, str]]:
    """The rules that can be built and, on a stream, started; the others are logged and added to ``dropped``.

    All are tried together first, and one by one only if that fails.
    """
    source = trial.idle_copy(txns) if txns.isStreaming else txns

    def error(some: list[tuple[str, str]]) -> Exception | None:
        try:
            built = build(source, some)
            if txns.isStreaming:
                trial.start_and_stop(built, [mode] if mode else ["append", "update"])
        except Exception as refused:  # one broken rule must not stop the others
            return refused
        return None

    if error(chosen) is None:
        return chosen
    good = []
    for kind, name in chosen:
        refused = error([(kind, name)])
        if refused is None:
            good.append((kind, name))
        else:
            log.error("rule %s skipped: %s", name, refused)
            if name not in dropped:
                dropped.append(name)
    return good
