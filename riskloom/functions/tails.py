"""Tail probabilities of normal, t, F and Kolmogorov–Smirnov statistics.

Spark SQL has no such functions. They are applied to aggregated rows (one per
feature or comparison) in vectorised UDFs; the series below are evaluated for a
whole Arrow batch at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2.0))


def normal_upper(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(z / math.sqrt(2.0))


def regularized_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) by the continued fraction, on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    u = np.clip(np.where(swap, 1.0 - x, x), 0.0, 1.0)
    with np.errstate(all="ignore"):
        front = np.exp(
            _lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(u) + q * np.log1p(-u)
        )
        tiny = 1e-300
        d = 1.0 - (p + q) * u / (p + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c, h = np.ones_like(d), d.copy()
        for m in range(1, 400):
            even = m * (q - m) * u / ((p + 2 * m - 1.0) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1.0))
            for term in (even, odd):
                d = 1.0 + term * d
                d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1.0 + term / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1.0), initial=0.0) < 1e-15:
                break
        value = np.where(u <= 0.0, 0.0, front * h / p)
    return np.where(swap, 1.0 - value, value)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return regularized_beta(df / 2.0, np.full_like(df, 0.5), df / (df + t * t))


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return regularized_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_quantile(prob: float, df: float) -> float:
    """Quantile of Student's t by bisection (for interval half-widths)."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2.0
        upper = 1.0 - float(t_two_sided(np.array([mid]), np.array([df]))[0]) / 2.0
        low, high = (mid, high) if upper < prob else (low, mid)
    return (low + high) / 2.0


def ks_two_sided(d: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Asymptotic two-sample Kolmogorov–Smirnov tail."""
    d, n, m = (np.asarray(v, dtype=float) for v in (d, n, m))
    lam = d * np.sqrt(n * m / (n + m))
    k = np.arange(1, 101)[:, None]
    sums = 2.0 * np.sum((-1.0) ** (k - 1) * np.exp(-2.0 * k * k * lam[None, :] ** 2), axis=0)
    return np.clip(np.where(lam < 0.04, 1.0, sums), 0.0, 1.0)


def _guarded(fn, *series: pd.Series) -> pd.Series:
    """Apply to rows whose arguments are all present; the others stay NULL."""
    frame = pd.concat(series, axis=1).astype(float)
    ok = frame.notna().all(axis=1).to_numpy()
    out = np.full(len(frame), np.nan)
    if ok.any():
        out[ok] = fn(*[frame.iloc[:, i].to_numpy()[ok] for i in range(frame.shape[1])])
    return pd.Series(out, dtype="Float64").where(~np.isnan(out))


def _column(fn, *args: Column) -> Column:
    def run1(a: pd.Series) -> pd.Series:
        return _guarded(fn, a)

    def run2(a: pd.Series, b: pd.Series) -> pd.Series:
        return _guarded(fn, a, b)

    def run3(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _guarded(fn, a, b, c)

    chosen = {1: run1, 2: run2, 3: run3}[len(args)]
    return F.pandas_udf(chosen, "double")(*[a.cast("double") for a in args])


def normal_p(z: Column) -> Column:
    return _column(normal_two_sided, z)


def normal_upper_p(z: Column) -> Column:
    return _column(normal_upper, z)


def t_p(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_upper, f, d1, d2)


def ks_p(d: Column, n: Column, m: Column) -> Column:
    return _column(ks_two_sided, d, n, m)


def t_quantile_column(df: Column, prob: float = 0.975) -> Column:
    def quantiles(d: np.ndarray) -> np.ndarray:
        return np.array([t_quantile(prob, v) if v > 0 else np.nan for v in d])

    return _column(quantiles, df)
