"""Hand-made logs: D(n) is 2025-01-01 UTC plus n days."""

from datetime import datetime, timedelta, timezone

EPOCH = datetime(2025, 1, 1, tzinfo=timezone.utc)
US = timedelta(microseconds=1)

LABEL = ("id string, is_fraud boolean, valid_from timestamp, valid_to timestamp, "
         "system_from timestamp, seq int, op string")
TXN = ("id string, account_id string, txn_ts timestamp, amount double, category string, country string, "
       "valid_from timestamp, valid_to timestamp, system_from timestamp, seq int, op string")
ACCOUNT = ("id string, name string, home_country string, tier string, "
           "valid_from timestamp, valid_to timestamp, system_from timestamp, seq int, op string")
PENDING = ("id string, account_id string, txn_ts timestamp, due timestamp, "
           "valid_from timestamp, valid_to timestamp, system_from timestamp, seq int, op string")


def D(n):
    return EPOCH + timedelta(days=n)


def utc(ts):
    return None if ts is None else ts.astimezone(timezone.utc)


def label(tid, fraud, commit, valid_from=None, valid_to=None, seq=0, op="put"):
    return (tid, fraud, commit if valid_from is None else valid_from, valid_to, commit, seq, op)


def txn(tid, account, ts, amount=100.0, country="GB", commit=None, category="retail", seq=0):
    return (tid, account, ts, amount, category, country, ts, None, commit or ts, seq, "put")


def account(aid, country="GB", valid_from=None, valid_to=None, commit=None, name="n", tier="standard", seq=0):
    valid_from = valid_from or D(-1)
    return (aid, name, country, tier, valid_from, valid_to, commit or valid_from, seq, "put")


def pending(tid, account_id, ts, due, commit=None, op="put"):
    return (tid, account_id, ts, due, ts if op == "put" else commit, None, commit or ts, 0, op)
