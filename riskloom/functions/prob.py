"""Column expressions on probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGIT_EPS = 1e-7
SHIFT_EPS = 1e-9


def finite(c: Column) -> Column:
    """True where ``c`` is neither NULL, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def logit(p: Column, eps: float = LOGIT_EPS) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def inv_logit(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def safe_div(num: Column, den: Column) -> Column:
    """Quotient in double, NULL for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(safe_div(num, den), F.lit(0.0))


def log_odds(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def shift_prevalence(p: Column, sample_prev: Column, target_prev: Column) -> Column:
    """Move the intercept of ``p`` from one prevalence to another.

    A prevalence outside (0, 1) leaves ``p`` as it is.
    """
    valid = (
        (sample_prev > 0) & (sample_prev < 1) & (target_prev > 0) & (target_prev < 1)
    )
    q = clip(p, SHIFT_EPS, 1.0 - SHIFT_EPS)
    delta = log_odds(target_prev) - log_odds(sample_prev)
    return F.when(F.coalesce(valid, F.lit(False)), inv_logit(log_odds(q) + delta)).otherwise(p)
