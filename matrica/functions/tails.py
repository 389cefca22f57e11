"""Tail probabilities as vectorised functions and Arrow-backed Spark columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def norm_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def norm_ppf(p: float) -> float:
    """Inverse normal by bisection and Newton steps."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - float(norm_sf(mid)) < p else (lo, mid)
    return (lo + hi) / 2


def betainc(a, b, x, terms: int = 400):
    """Regularised incomplete beta by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        tiny = 1e-300
        c = np.ones_like(y)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, terms):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                f = f * d * c
        out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * f))
    return np.where(flip, 1 - out, out)


def gammainc_upper(a, x, terms: int = 500):
    """Regularised upper incomplete gamma: series below a + 1, fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        scale = np.exp(a * np.log(x) - x - _lgamma(a))
        term = 1 / a
        total = term.copy()
        for k in range(1, terms):
            term = term * x / (a + k)
            total = total + term
        b = x + 1 - a
        c = np.full_like(x, 1e300)
        d = 1 / b
        h = d.copy()
        for k in range(1, terms):
            an = -k * (k - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
        out = np.where(x < a + 1, 1 - scale * total, scale * h)
    return np.where(x <= 0, 1.0, np.clip(out, 0, 1))


def t_sf2(t, df):
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2):
    f = np.asarray(f, float)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f))


def chi2_sf(x, df):
    return gammainc_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def hypergeom_sf(a: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= a) for draws without replacement."""
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    top = min(marked, drawn)
    low = max(a, 0, drawn - (total - marked))
    if a <= max(0, drawn - (total - marked)):
        return 1.0
    return min(1.0, sum(math.exp(lc(marked, k) + lc(total - marked, drawn - k) - lc(total, drawn)) for k in range(low, top + 1)))


def binom_two_sided(k: int, n: int) -> float:
    """Exact two-sided test of a fair coin."""
    k = min(k, n - k)
    return min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)))


def mwu_exact_sf2(u: float, n1: int, n2: int) -> float:
    """Exact two-sided Mann-Whitney tail without ties."""
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1
    for i in range(1, n1 + 1):  # product of (1 - q^(n2+i)) / (1 - q^i)
        up = np.zeros_like(counts)
        up[:] = counts
        if n2 + i <= n1 * n2:
            up[n2 + i :] -= counts[: len(counts) - n2 - i]
        for j in range(i, len(up)):
            up[j] += up[j - i]
        counts = up
    p = counts / counts.sum()
    top = max(u, n1 * n2 - u)
    return float(min(1.0, 2 * p[int(math.ceil(top - 1e-9)) :].sum()))


def _udf(fn, n: int):
    if n == 1:
        @F.pandas_udf("double")
        def one(a: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(float)))
        return one
    if n == 2:
        @F.pandas_udf("double")
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(float), b.to_numpy(float)))
        return two

    @F.pandas_udf("double")
    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(fn(a.to_numpy(float), b.to_numpy(float), c.to_numpy(float)))
    return three


def norm_sf2_col(z: Column) -> Column:
    return _udf(lambda x: 2 * norm_sf(np.abs(x)), 1)(z.cast("double"))


def t_sf2_col(t: Column, df: Column) -> Column:
    return _udf(t_sf2, 2)(t.cast("double"), df.cast("double"))


def f_sf_col(f: Column, d1: Column, d2: Column) -> Column:
    return _udf(f_sf, 3)(f.cast("double"), d1.cast("double"), d2.cast("double"))


def chi2_sf_col(x: Column, df: Column) -> Column:
    return _udf(chi2_sf, 2)(x.cast("double"), df.cast("double"))
