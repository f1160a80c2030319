"""Small hand-made transactions."""

from datetime import datetime, timedelta, timezone
from itertools import count

from txnwatch.schemas import TRANSACTION

NOON = datetime(2026, 1, 1, 12, 0, tzinfo=timezone.utc)
_ids = count()


def txn(card="C1", at=0, amount=500.0, **fields):
    """One transaction, ``at`` seconds after noon (or at a given time)."""
    row = {
        "txn_id": f"T{next(_ids)}",
        "card_id": card,
        "account_id": f"A-{card}",
        "amount": amount,
        "currency": "INR",
        "merchant_id": "M1",
        "merchant_cat": "5411",
        "terminal_id": "T1",
        "country": "IN",
        "city": "Pune",
        "txn_type": "PURCHASE",
        "channel": "POS",
        "txn_status": "APPROVED",
        "event_time": at if at is None or isinstance(at, datetime) else NOON + timedelta(seconds=at),
    }
    return {**row, **fields}


def table(spark, rows):
    """All columns nullable, as after parsing."""
    nullable = type(TRANSACTION)([type(f)(f.name, f.dataType, True) for f in TRANSACTION.fields])
    return spark.createDataFrame([tuple(r[n] for n in nullable.fieldNames()) for r in rows], nullable)
