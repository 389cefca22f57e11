"""Normality statistics of one sample: Shapiro-Wilk and Anderson-Darling."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from matrica.functions.tails import norm_ppf, norm_sf

# Polynomials of Royston (1995), algorithm AS R94, constant term first.
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_MEAN_SMALL = (0.5440, -0.39978, 0.025054, -0.0006714)
_SD_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)
_MEAN_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915)
_SD_LARGE = (-0.4803, -0.082676, 0.0030302)
#: Fixed value: Anderson-Darling critical value at 5 % when mean and variance are estimated (Stephens 1974).
_AD_5 = 0.787


def _poly(c: tuple[float, ...], x: float) -> float:
    return sum(k * x**i for i, k in enumerate(c))


@lru_cache(maxsize=32)
def _scores(n: int) -> tuple[float, ...]:
    """Approximate normal order statistics of a sample of ``n``."""
    return tuple(norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """W and its p-value; NaN for fewer than three or equal values."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[-1] - x[0] < 1e-19:
        return math.nan, math.nan
    m = np.array(_scores(n))
    mm = float(m @ m)
    a = np.zeros(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        u = 1 / math.sqrt(n)
        last = m[-1] / math.sqrt(mm) + _poly(_C1, u)
        if n > 5:
            prev = m[-2] / math.sqrt(mm) + _poly(_C2, u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = prev, -prev
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
        a[-1], a[0] = last, -last
    d = x - x.mean()
    w = min(1.0, float((a @ x) ** 2 / (d @ d)))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, log_n = math.log(max(1 - w, 1e-300)), math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-99
        y, mean, sd = -math.log(g - y), _poly(_MEAN_SMALL, n), math.exp(_poly(_SD_SMALL, n))
    else:
        mean, sd = _poly(_MEAN_LARGE, log_n), math.exp(_poly(_SD_LARGE, log_n))
    return w, float(norm_sf((y - mean) / sd))


def anderson(x: np.ndarray) -> tuple[float, float]:
    """A^2 for the normal with estimated parameters, and the 5 % critical value at this size."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[-1] == x[0]:
        return math.nan, math.nan
    z = (x - x.mean()) / x.std(ddof=1)
    low, high = np.log(np.maximum(norm_sf(-z), 1e-300)), np.log(np.maximum(norm_sf(z), 1e-300))
    i = np.arange(1, n + 1)
    return float(-n - ((2 * i - 1) / n * (low + high[::-1])).sum()), _AD_5 / (1 + 4 / n - 25 / n**2)
