"""Queries and their SQL twins, over card transactions derived from the ``events`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import txnwatch as tw
from txnwatch.operators import rules
from txnwatch.sources import fixtures, ingest
from txnwatch.streaming.sinks import MESSAGE_FIELDS, alert_records

try:  # the training-data operators are an addition that may be taken away
    import corpus_pipeline
    from txnwatch.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "txnwatch.llm"):
        raise
    corpus_pipeline = llm = None

# The fixture's hours are 00:00 to 02:24 UTC, 05:30 to 07:54 in India, 19:00 to 21:24 in New York.
INDIA = {"unusual_hour_timezone": "Asia/Kolkata", "unusual_hour_start": 6, "unusual_hour_end": 7}
# Fixed days of the dormant-card example, in uncompressed time.
HISTORY_END = "2024-01-26 00:00:00"
QUIET_DAYS = 1
STRICT = {
    "velocity_txn_limit": 7,
    "high_value_single": 45_000,
    "velocity_window_amount": 120_000,
    "geo_velocity_countries": 3,
    "unusual_hour_start": 19,
    "unusual_hour_end": 21,
    "unusual_hour_min_amount": 20_000,
    "unusual_hour_timezone": "America/New_York",
    "round_amount_modulo": 5_000,
    "round_amount_min_txns": 2,
    "rapid_merchant_distinct": 6,
    "cnp_spike_txns": 4,
    "multi_card_terminal": 6,
    "sub_threshold_low": 8_000,
    "sub_threshold_high": 11_000,
    "sub_threshold_min_txns": 4,
    "decline_min_count": 3,
}


def _txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Windows, hours and ids are defined in UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return fixtures.transactions(spark, sf_dir)


def _dormant_example(txns: DataFrame) -> tuple[DataFrame, DataFrame]:
    later = txns.where(F.col("raw_time") >= F.lit(HISTORY_END).cast("timestamp"))
    return later, tw.dormant_list(txns, HISTORY_END, days=QUIET_DAYS, time_column="raw_time")


def _comparable(df: DataFrame) -> DataFrame:
    """Naive UTC times and amounts in cents, so both engines print the same values."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind == "timestamp":
            column = column.cast("timestamp_ntz")
        elif name in ("total_amount", "amount"):
            column = F.round(column, 2)
        columns.append(column.alias(name))
    return df.select(*columns)


def _every_alert(spark: SparkSession, sf_dir: str, params: dict | None = None) -> DataFrame:
    txns = _txns(spark, sf_dir)
    return tw.all_alerts(txns, params, dormant=_dormant_example(txns)[1])


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse(fixtures.messages(_txns(spark, sf_dir)))


def _with_fixed_detection(alerts: DataFrame) -> DataFrame:
    """Detection a known number of seconds after the end of the window."""
    seconds = F.pmod(F.unix_seconds("window_start"), F.lit(60)) + 5
    return alerts.withColumn("alert_time", F.timestamp_seconds(F.unix_seconds("window_end") + seconds))


def entry(spark: SparkSession) -> DataFrame:
    return _comparable(_every_alert(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def rule(name: str, params: dict | None = None):
        return lambda spark, sf_dir: _comparable(getattr(rules, name)(_txns(spark, sf_dir), params))

    def on_alerts(operator: Callable[[DataFrame], DataFrame]):
        return lambda spark, sf_dir: _comparable(operator(_every_alert(spark, sf_dir)))

    def on_messages(operator: Callable[[DataFrame], DataFrame]):
        return lambda spark, sf_dir: _comparable(operator(_parsed(spark, sf_dir)))

    single = {name: rule(name) for name in tw.build_rules()}
    return {
        **single,
        "unusual_hour_tz": rule("unusual_hour", INDIA),
        "dormant_card": lambda s, d: _comparable(rules.dormant_card(*_dormant_example(_txns(s, d)))),
        "dormant_list": lambda s, d: _comparable(_dormant_example(_txns(s, d))[1]),
        "transactions": lambda s, d: _comparable(_txns(s, d)),
        "alert_contract": lambda s, d: _comparable(tw.evaluate(_txns(s, d), dormant=_dormant_example(_txns(s, d))[1])),
        "alert_id": on_alerts(lambda a: a.select("card_id", "window_start", "rule_triggered", "alert_id")),
        "detection_latency": on_alerts(lambda a: tw.detection_latency(_with_fixed_detection(a))),
        "all_alerts": on_alerts(lambda a: a),
        "all_alerts_strict": lambda s, d: _comparable(_every_alert(s, d, STRICT)),
        "alert_triage": on_alerts(tw.alert_triage),
        "alert_dedup": on_alerts(tw.dedup_alerts),
        "card_risk_rollup": on_alerts(tw.card_risk_rollup),
        "alerts_by_rule": lambda s, d: _comparable(
            tw.alerts_by_rule(
                tw.all_alerts(_txns(s, d), rules=["geo_velocity"]), "GEO_VELOCITY", "2024-01-01 01:30:00", days=7
            )
        ),
        "alert_json": lambda s, d: alert_records(
            _every_alert(s, d).withColumn("total_amount", F.round("total_amount", 2)),
            fields=[f for f in MESSAGE_FIELDS if f != "alert_time"],
        ).select("key", *_json_fields("value")),
        "parse_good": on_messages(lambda p: ingest.good_rows(p).drop("raw_value", "source_time")),
        "parse_bad": on_messages(ingest.dead_letters),
        "dlq_rate": on_messages(ingest.dlq_rate),
        **({**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {}),
    }


def _json_fields(column: str) -> list:
    """The payload, field by field: the two engines print doubles differently."""
    text = [
        F.get_json_object(column, f"$.{f}").alias(f)
        for f in ("alert_id", "card_id", "rule_triggered", "window_start", "window_end")
    ]
    numbers = [F.get_json_object(column, f"$.{f}").cast("int").alias(f) for f in ("risk_score", "txn_count")]
    return [*text, *numbers, F.get_json_object(column, "$.total_amount").cast("double").alias("total_amount")]


# --- SQL ------------------------------------------------------------------------------------------

TXNS_SQL = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
txns AS (
  SELECT CAST(event_id AS VARCHAR) AS txn_id,
         'CARD-' || user_id AS card_id,
         'ACC-' || user_id AS account_id,
         CASE WHEN k % 3 = 0 THEN floor(value * 200 / 1000) * 1000 ELSE round(value * 200, 2) END AS amount,
         'INR' AS currency,
         CASE WHEN k = 98 THEN NULL ELSE 'MER-' || ((event_id * 7919) % 50) END AS merchant_id,
         event_type AS merchant_cat,
         'TRM-' || (user_id - user_id % 8 + k % 8) AS terminal_id,
         CASE WHEN k = 99 THEN NULL WHEN k < 90 THEN 'IN' WHEN k < 95 THEN 'AE' ELSE 'US' END AS country,
         CAST(NULL AS VARCHAR) AS city,
         CASE event_type WHEN 'purchase' THEN 'PURCHASE' WHEN 'signup' THEN 'TRANSFER'
              ELSE 'WITHDRAWAL' END AS txn_type,
         CASE k % 4 WHEN 0 THEN 'ATM' WHEN 1 THEN 'POS' WHEN 2 THEN 'ONLINE' ELSE 'MOBILE' END AS channel,
         CASE WHEN event_type = 'error' THEN 'DECLINED' ELSE 'APPROVED' END AS txn_status,
         make_timestamp(CAST(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 300 AS BIGINT)) AS event_time,
         CAST(ts AS TIMESTAMP) AS raw_time
  FROM e)"""

# Fixed labels and scores, as in the rules.
_SCORES = {
    "HIGH_VELOCITY": 85,
    "HIGH_VALUE_SINGLE_TXN": 80,
    "HIGH_WINDOW_AMOUNT": 90,
    "GEO_VELOCITY": 95,
    "UNUSUAL_HOUR": 50,
    "ROUND_AMOUNT_STRUCTURING": 75,
    "RAPID_MERCHANT_SWITCH": 70,
    "CNP_SPIKE": 65,
    "MULTI_CARD_TERMINAL": 80,
    "DORMANT_CARD": 60,
    "SUB_THRESHOLD_STRUCT": 85,
    "DECLINED_THEN_APPROVED": 90,
}


def _window_rule_sql(label, minutes, slide, having, where="TRUE", key="card_id", card="card_id") -> str:
    return f"""
SELECT {card} AS card_id, ws AS window_start, ws + INTERVAL '{minutes} minutes' AS window_end,
       CAST(count(txn_id) AS INTEGER) AS txn_count, round(sum(amount), 2) AS total_amount,
       '{label}' AS rule_triggered, CAST({_SCORES[label]} AS INTEGER) AS risk_score
FROM (SELECT t.*, time_bucket(INTERVAL '{slide} minutes', event_time) - i * INTERVAL '{slide} minutes' AS ws
      FROM txns t, range({minutes // slide}) r(i) WHERE {where})
GROUP BY {key}, ws HAVING {having}"""


def _row_rule_sql(label, where, source="txns") -> str:
    return f"""
SELECT card_id, event_time AS window_start, event_time AS window_end, CAST(1 AS INTEGER) AS txn_count,
       round(amount, 2) AS total_amount, '{label}' AS rule_triggered,
       CAST({_SCORES[label]} AS INTEGER) AS risk_score
FROM {source} WHERE {where}"""


# The rules' published default numbers, stated here once more: the SQL does not ask the library.
_LITERALS = {
    "velocity_txn_limit": 5,
    "velocity_window_amount": 50000,
    "high_value_single": 30000,
    "geo_velocity_countries": 2,
    "unusual_hour_start": 1,
    "unusual_hour_end": 4,
    "unusual_hour_min_amount": 5000,
    "unusual_hour_timezone": "UTC",
    "round_amount_modulo": 1000,
    "round_amount_min_txns": 3,
    "rapid_merchant_distinct": 4,
    "cnp_spike_txns": 3,
    "multi_card_terminal": 5,
    "sub_threshold_low": 9000,
    "sub_threshold_high": 10000,
    "sub_threshold_min_txns": 5,
    "decline_min_count": 2,
}


def _rules_sql(overrides: dict | None = None) -> dict[str, str]:
    p = {**_LITERALS, **(overrides or {})}
    hour = f"hour(timezone('{p['unusual_hour_timezone']}', timezone('UTC', event_time)))"
    n = p["decline_min_count"]
    return {
        "velocity_check": _window_rule_sql("HIGH_VELOCITY", 5, 1, f"count(txn_id) > {p['velocity_txn_limit']}"),
        "high_value_single": _row_rule_sql("HIGH_VALUE_SINGLE_TXN", f"amount > {p['high_value_single']}"),
        "high_window_amount": _window_rule_sql(
            "HIGH_WINDOW_AMOUNT", 5, 1, f"sum(amount) > {p['velocity_window_amount']}"
        ),
        "geo_velocity": _window_rule_sql(
            "GEO_VELOCITY", 30, 5, f"count(DISTINCT country) >= {p['geo_velocity_countries']}"
        ),
        "unusual_hour": _row_rule_sql(
            "UNUSUAL_HOUR",
            f"{hour} >= {p['unusual_hour_start']} AND {hour} < {p['unusual_hour_end']} "
            f"AND amount > {p['unusual_hour_min_amount']}",
        ),
        "round_amount_structuring": _window_rule_sql(
            "ROUND_AMOUNT_STRUCTURING",
            10,
            2,
            f"count(txn_id) >= {p['round_amount_min_txns']}",
            where=f"amount % {p['round_amount_modulo']} = 0",
        ),
        "rapid_merchant_switch": _window_rule_sql(
            "RAPID_MERCHANT_SWITCH", 5, 1, f"count(DISTINCT merchant_id) > {p['rapid_merchant_distinct']}"
        ),
        "cnp_spike": _window_rule_sql(
            "CNP_SPIKE", 10, 2, f"count(txn_id) > {p['cnp_spike_txns']}", where="channel = 'ONLINE'"
        ),
        "multi_card_terminal": _window_rule_sql(
            "MULTI_CARD_TERMINAL",
            10,
            2,
            f"count(DISTINCT card_id) > {p['multi_card_terminal']}",
            key="terminal_id",
            card="max(card_id)",
        ),
        "sub_threshold_structuring": _window_rule_sql(
            "SUB_THRESHOLD_STRUCT",
            60,
            5,
            f"count(txn_id) >= {p['sub_threshold_min_txns']}",
            where=f"amount >= {p['sub_threshold_low']} AND amount < {p['sub_threshold_high']}",
        ),
        "declined_then_approved": _window_rule_sql(
            "DECLINED_THEN_APPROVED",
            10,
            2,
            f"count(*) FILTER (txn_status = 'DECLINED') >= {n} AND count(*) FILTER (txn_status = 'APPROVED') >= 1 "
            "AND max(event_time) FILTER (txn_status = 'APPROVED') > "
            f"list_sort(list(event_time) FILTER (txn_status = 'DECLINED'))[{n}]",
        ),
    }


DORMANT_SQL = f"""
dormant AS (
  SELECT card_id, max(raw_time) AS last_activity FROM txns WHERE raw_time < TIMESTAMP '{HISTORY_END}'
  GROUP BY card_id HAVING max(raw_time) < TIMESTAMP '{HISTORY_END}' - INTERVAL '{QUIET_DAYS} days')"""

_LISTED = "card_id IN (SELECT card_id FROM dormant)"
_ID_SQL = """md5(concat_ws('|', card_id, rule_triggered,
    CASE WHEN window_end <= window_start THEN {text}
         ELSE CAST(epoch_us(window_start) // 1000000 // 3600 AS VARCHAR) END)) AS alert_id"""
# Timestamp text without trailing zeros of the fraction.
_TIME_TEXT = (
    "CASE WHEN epoch_us(window_start) % 1000000 = 0 THEN strftime(window_start, '%Y-%m-%d %H:%M:%S') "
    "ELSE rtrim(strftime(window_start, '%Y-%m-%d %H:%M:%S.%f'), '0') END"
)
_WITH_ID = _ID_SQL.format(text=_TIME_TEXT)


def _alerts_cte(overrides: dict | None = None, only: list[str] | None = None) -> str:
    parts = _rules_sql(overrides)
    if only is None:
        selected = [*parts.values(), _row_rule_sql("DORMANT_CARD", _LISTED)]
    else:
        selected = [parts[name] for name in only]
    union = "\nUNION ALL\n".join(selected)
    dormant = f"{DORMANT_SQL},\n" if only is None else ""
    return f"WITH {TXNS_SQL},{dormant}\nbare AS ({union}),\nalerts AS (SELECT *, {_WITH_ID} FROM bare)\n"


def oracle_sql() -> dict[str, str]:
    txn_columns = ", ".join(f.name for f in tw.TRANSACTION.fields)
    iso = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
    return {
        **{name: f"WITH {TXNS_SQL}{sql}" for name, sql in _rules_sql().items()},
        "unusual_hour_tz": f"WITH {TXNS_SQL}{_rules_sql(INDIA)['unusual_hour']}",
        "dormant_card": f"WITH {TXNS_SQL},{DORMANT_SQL}"
        + _row_rule_sql("DORMANT_CARD", f"raw_time >= TIMESTAMP '{HISTORY_END}' AND {_LISTED}"),
        "dormant_list": f"WITH {TXNS_SQL},{DORMANT_SQL} SELECT * FROM dormant",
        "transactions": f"WITH {TXNS_SQL} SELECT {txn_columns}, raw_time FROM txns",
        "alert_contract": _alerts_cte() + "SELECT * FROM bare",
        "alert_id": _alerts_cte() + "SELECT card_id, window_start, rule_triggered, alert_id FROM alerts",
        "detection_latency": _alerts_cte()
        + "SELECT rule_triggered, count(*) AS alerts, avg(latency) AS avg_seconds, "
        "quantile_disc(latency, 0.5) AS median_seconds, max(latency) AS max_seconds FROM (SELECT rule_triggered, "
        "(epoch_us(window_end) // 1000000 + epoch_us(window_start) // 1000000 % 60 + 5 - epoch_us(window_end) / 1000000.0) "
        "AS latency FROM alerts) GROUP BY rule_triggered",
        "all_alerts": _alerts_cte() + "SELECT * FROM alerts",
        "all_alerts_strict": _alerts_cte(STRICT) + "SELECT * FROM alerts",
        "alert_triage": _alerts_cte()
        + "SELECT *, CASE WHEN risk_score >= 90 THEN 'block' WHEN risk_score >= 70 THEN 'review' "
        "ELSE 'monitor' END AS triage FROM alerts",
        "alert_dedup": _alerts_cte()
        + "SELECT * FROM alerts QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY window_start, window_end, "
        "card_id, txn_count, total_amount, rule_triggered, risk_score) = 1",
        "card_risk_rollup": _alerts_cte()
        + "SELECT card_id, CAST(count(DISTINCT rule_triggered) AS INTEGER) AS rules_fired, "
        "string_agg(DISTINCT rule_triggered, ',' ORDER BY rule_triggered) AS rules, count(*) AS alerts, "
        "max(risk_score) AS max_risk, CAST(sum(risk_score) AS BIGINT) AS risk_sum, "
        "min(window_start) AS first_seen, max(window_end) AS last_seen FROM alerts GROUP BY card_id",
        "alerts_by_rule": _alerts_cte(only=["geo_velocity"])
        + "SELECT * FROM alerts WHERE rule_triggered = 'GEO_VELOCITY' "
        "AND window_start >= TIMESTAMP '2024-01-01 01:30:00' - INTERVAL '7 days' "
        "AND window_start < TIMESTAMP '2024-01-01 01:30:00'",
        "alert_json": _alerts_cte()
        + f"SELECT card_id AS key, alert_id, card_id, rule_triggered, {iso.format('window_start')} AS window_start, "
        f"{iso.format('window_end')} AS window_end, risk_score, txn_count, total_amount FROM alerts",
        "parse_good": f"WITH {TXNS_SQL} SELECT {txn_columns} FROM txns WHERE CAST(txn_id AS BIGINT) % 50 > 1",
        "parse_bad": f"WITH {TXNS_SQL} SELECT 'parse_failure' AS key, CASE CAST(txn_id AS BIGINT) % 50 "
        "WHEN 0 THEN 'not json' ELSE '{\"amount\":1}' END AS value "
        "FROM txns WHERE CAST(txn_id AS BIGINT) % 50 <= 1",
        "dlq_rate": f"WITH {TXNS_SQL} SELECT date_trunc('minute', event_time) AS minute, count(*) AS bad_messages "
        "FROM txns WHERE CAST(txn_id AS BIGINT) % 50 <= 1 GROUP BY 1",
        **(llm.ORACLE_SQL if llm else {}),
        **({"pipeline": corpus_pipeline.ORACLE_SQL} if llm and corpus_pipeline.ORACLE_SQL else {}),
    }
