"""Special functions of the negative binomial, vectorised; no library of them is needed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Coefficients of Stirling's series, B(2k) / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series from 10 on, and by its recurrence below."""
    x = np.asarray(x, np.float64)
    steps = np.where(x < 10, np.ceil(10 - np.minimum(x, 10)), 0.0)
    product = np.ones_like(x)
    for k in range(10):
        product *= np.where(k < steps, x + k, 1.0)
    z = x + steps
    inverse = 1 / (z * z)
    series = np.zeros_like(z)
    for c in reversed(STIRLING):
        series = series * inverse + c
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series / z - np.log(product)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified Lentz method; rows leave as they converge."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    out, left = np.empty_like(x), np.arange(len(x))
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + step * d)
            c = safe(1 + step / c)
            h *= d * c
        done = np.abs(d * c - 1) < 1e-15
        if done.any():
            out[left[done]] = h[done]
            left, a, b, x, c, d, h = (v[~done] for v in (left, a, b, x, c, d, h))
            if not len(left):
                break
    out[left] = h
    return out


def log_beta_tail(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the regularised incomplete beta function I_p(a, b), without underflow."""
    p, a, b = (np.asarray(v, np.float64) for v in (p, a, b))
    front = a * np.log(p) + b * np.log1p(-p) - (lgamma(a) + lgamma(b) - lgamma(a + b))
    low = p < (a + 1) / (a + b + 2)
    out = np.empty_like(front)
    if low.any():
        out[low] = front[low] - np.log(a[low]) + np.log(_beta_fraction(a[low], b[low], p[low]))
    if (high := ~low).any():
        other = front[high] - np.log(b[high]) + np.log(_beta_fraction(b[high], a[high], 1 - p[high]))
        out[high] = np.log1p(-np.minimum(np.exp(other), 1 - 1e-16))
    return np.minimum(out, 0.0)


def nb_log_tail(x: np.ndarray, r: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Natural logarithm of P(X >= floor(x)) for a negative binomial of mean r * p / (1 - p)."""
    x, r, p = np.broadcast_arrays(np.floor(np.asarray(x, np.float64)), np.asarray(r, np.float64), np.asarray(p, np.float64))
    out = np.zeros(x.shape)
    ask = (x > 0) & np.isfinite(r) & np.isfinite(p)
    if ask.any():
        out[ask] = log_beta_tail(p[ask], x[ask], r[ask])
    return out


def nb_isf(q: float, r: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The least whole x with P(X > x) <= q, by bisection."""
    r, p = np.asarray(r, np.float64), np.asarray(p, np.float64)
    lo = np.full(r.shape, -1.0)
    hi = np.maximum(1.0, np.ceil(r * p / (1 - p)))
    while (far := nb_log_tail(hi + 1, r, p) > math.log(q)).any():
        hi = np.where(far, hi * 2, hi)
    while ((hi - lo) > 1).any():
        mid = np.floor((lo + hi) / 2)
        above = nb_log_tail(mid + 1, r, p) > math.log(q)
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return hi


@F.pandas_udf(DoubleType())
def _neglog10_tail(x: pd.Series, r: pd.Series, p: pd.Series) -> pd.Series:
    known = r.notna() & p.notna()
    out = pd.Series(np.nan, index=x.index).where(~known, 0.0)
    if known.any():
        out[known] = np.abs(nb_log_tail(x[known].fillna(0).to_numpy(), r[known].to_numpy(), p[known].to_numpy()) / math.log(10))
    return out  # NaN is null behind Arrow


def neglog10_tail(x: Column, r: Column, p: Column) -> Column:
    """-log10 P(X >= floor(x)); 0 for null or non-positive x, null without parameters."""
    return _neglog10_tail(x.cast("double"), r.cast("double"), p.cast("double"))


def isf(q: float, r: Column, p: Column) -> Column:
    """The upper quantile of the negative binomial; null without parameters."""

    @F.pandas_udf(DoubleType())
    def run(r: pd.Series, p: pd.Series) -> pd.Series:
        known = r.notna() & p.notna()
        out = pd.Series([None] * len(r), index=r.index, dtype=object)
        if known.any():
            out[known] = nb_isf(q, r[known].to_numpy(), p[known].to_numpy())
        return out

    return run(r.cast("double"), p.cast("double"))
