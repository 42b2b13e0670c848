"""Decision rules and feature arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that results depend on.
MIN_OBSERVATIONS = 5
Z_LIMIT = 8.0
FRAUD_THRESHOLD = 0.5
SCORE_MOVE = 5e-4
CASE_DELTA = 0.02


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zscore(amount, mean, std, n) -> Column:
    """Deviation from the trailing baseline; 0 without a usable one, clipped otherwise."""
    amount, mean, std, n = map(_col, (amount, mean, std, n))
    usable = (n >= MIN_OBSERVATIONS) & (std > 0)
    z = (amount - mean) / F.nullif(std, F.lit(0.0))
    clipped = F.least(F.lit(Z_LIMIT), F.greatest(F.lit(-Z_LIMIT), z))
    return F.when(usable, clipped).otherwise(F.lit(0.0))


def foreign_flag(home, country) -> Column:
    return F.when(_col(home) != _col(country), 1).otherwise(0)


def as_flag(condition) -> Column:
    return F.when(_col(condition), 1).otherwise(0)


def recorded_state(is_fraud, pending_id) -> Column:
    """fraud once confirmed, pending while a chargeback is in flight, else legit."""
    return (F.when(_col(is_fraud), "fraud")
            .when(_col(pending_id).isNotNull(), "pending")
            .otherwise("legit"))


def verdict(prob) -> Column:
    return F.when(_col(prob) >= FRAUD_THRESHOLD, "fraud").otherwise("legit")


def logistic(logit) -> Column:
    return 1 / (1 + F.exp(-_col(logit)))


def rounded(value) -> Column:
    """Six decimals; the nudge makes exact half-way values fall the same way everywhere."""
    return F.round(_col(value) + 1e-9, 6)
