"""Two-sample statistics as columns; p-values from a small vectorised kernel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or ``default`` where b is zero or null."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(default))


def pooled_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Standardised mean difference (0 for groups under 2 or without spread)."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.coalesce(F.when((n1 >= 2) & (n2 >= 2) & (pooled >= 1e-12), (m1 - m2) / pooled), F.lit(0.0))


def welch(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> tuple[Column, Column]:
    """t and degrees of freedom for unequal variances (0, null when undefined)."""
    a, b = v1 / n1, v2 / n2
    ok = (n1 >= 2) & (n2 >= 2) & (a + b > 0)
    t = F.when(ok, (m1 - m2) / F.sqrt(a + b)).otherwise(0.0)
    df = F.when(ok, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)))
    return F.coalesce(t, F.lit(0.0)), df


def d_standard_error(d: Column, n1: Column, n2: Column) -> Column:
    var = (n1 + n2) / (n1 * n2) + d * d / (2.0 * (n1 + n2 - 2.0))
    return F.coalesce(F.when((n1 > 1) & (n2 > 1) & (n1 + n2 > 2), F.sqrt(F.greatest(var, F.lit(0.0)))), F.lit(0.0))


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log B(a, b); for a large argument by the Stirling remainders, so that nothing large cancels."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    lg = np.vectorize(math.lgamma, otypes=[float])

    def remainder(x: np.ndarray) -> np.ndarray:  # log gamma minus Stirling's formula, for x >= 10
        y = 1.0 / (x * x)
        return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x

    with np.errstate(invalid="ignore", divide="ignore"):
        direct = lg(a) + lg(b) - lg(a + b)
        # log gamma(large) - log gamma(small + large)
        ratio = small - (large - 0.5) * np.log1p(small / large) - small * np.log(small + large) + remainder(large) - remainder(small + large)
    return np.where(large < 10, direct, lg(small) + ratio)


def _betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function at x = 1 - y by its continued fraction, until no term changes it."""
    flip = x > (a + 1.0) / (a + b + 2.0)
    a, b, x, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, y, x), np.where(flip, x, y)
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    m = 0
    while True:
        m += 1
        before = h
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if not (np.abs(h - before) > 4e-16 * np.abs(h)).any():
            break
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) + b * np.log(y) - _log_beta(a, b)) / a
    value = front * h
    return np.where(flip, 1.0 - value, value)


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.ones_like(t)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0) & (t != 0)
    if ok.any():
        square = t[ok] ** 2
        out[ok] = _betainc(df[ok] / 2.0, np.full(ok.sum(), 0.5), df[ok] / (df[ok] + square), square / (df[ok] + square))
    return out


def normal_sf(z: np.ndarray) -> np.ndarray:
    """P(Z >= z) for the standard normal."""
    return np.array([0.5 * math.erfc(v / math.sqrt(2.0)) if v == v else 1.0 for v in np.asarray(z, float)])


def p_student(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def kernel(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(student_two_sided(t.to_numpy(float), df.to_numpy(float)))
    return kernel(t, df)


def p_normal(z: Column) -> Column:
    @F.pandas_udf("double")
    def kernel(z: pd.Series) -> pd.Series:
        return pd.Series(normal_sf(z.to_numpy(float)))
    return kernel(z)
