"""Suspicious-card-activity detection on Spark tables and streams."""

from txnwatch.operators.alerts import (
    alert_triage,
    alerts_by_rule,
    card_risk_rollup,
    dedup_alerts,
    detection_latency,
    with_alert_id,
)
from txnwatch.operators.dormant import dormant_list
from txnwatch.operators.rules import build_rules
from txnwatch.params import DEFAULTS, resolve
from txnwatch.plans.evaluate import all_alerts, evaluate, stream_alerts
from txnwatch.schemas import ALERT, ALERT_COLUMNS, TRANSACTION

__all__ = [
    "ALERT",
    "ALERT_COLUMNS",
    "DEFAULTS",
    "TRANSACTION",
    "alert_triage",
    "alerts_by_rule",
    "all_alerts",
    "build_rules",
    "card_risk_rollup",
    "dedup_alerts",
    "detection_latency",
    "dormant_list",
    "evaluate",
    "resolve",
    "stream_alerts",
    "with_alert_id",
]
