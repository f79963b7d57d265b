"""Tail probabilities for p-values (no scipy in the image).

Incomplete gamma and beta functions from the formulas of the NIST Digital
Library of Mathematical Functions (8.7.1, 8.9.2, 8.17.22); continued
fractions are evaluated from the innermost term outwards, with twice as many
terms until two results agree.  Scalars run on the driver, a handful per
test; :func:`log_norm_cdf` is for arrays inside tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return _NORMAL.cdf(x)


def norm_sf(x: float) -> float:
    return math.erfc(x / math.sqrt(2.0)) / 2


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def _settled(value: Callable[[int], float]) -> float:
    """``value(terms)`` for 16, 32, 64 ... terms until it no longer changes."""
    terms, last = 16, value(16)
    while terms < 1 << 20:
        terms *= 2
        now = value(terms)
        if abs(now - last) <= 4e-16 * abs(now):
            return now
        last = now
    return last


def _nested(steps: Iterable[tuple[float, float]], inner: float) -> float:
    """``b1 + a1 / (b2 + a2 / (...))``; the steps come innermost first."""
    for a, b in steps:
        inner = b + a / inner
    return inner


def gammainc_upper(a: float, x: float) -> float:
    """Q(a, x), the regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x > a + 1:
        def fraction(terms: int) -> float:
            # x + (1-a)/(1 + 1/(x + (2-a)/(1 + 2/(x + ...))))
            value = x
            for k in range(terms, 0, -1):
                value = x + (k - a) / (1 + k / value)
            return value
        return front / _settled(fraction)
    # lower function: sum of x^k / (a (a+1) ... (a+k))
    def series(terms: int) -> float:
        ratios = x / (a + np.arange(1, terms))
        return float((1 + np.cumprod(ratios).sum()) / a)
    return 1.0 - front * _settled(series)


def chi2_sf(x: float, df: float) -> float:
    if x is None or math.isnan(x):
        return float("nan")
    return gammainc_upper(df / 2.0, x / 2.0)


def betainc(a: float, b: float, x: float) -> float:
    """I_x(a, b), the regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x * (a + b + 2) > a + 1:  # the fraction converges fast on the other side
        return 1.0 - betainc(b, a, 1.0 - x)

    def coefficient(k: int) -> float:
        m, odd = divmod(k, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    whole = _settled(lambda terms: _nested(((coefficient(k), 1.0) for k in range(terms, 0, -1)), 1.0))
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta) / (a * whole)


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or math.isnan(t) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def log_norm_cdf(z: np.ndarray) -> np.ndarray:
    """log of the normal distribution function, exact far into the lower tail.

    Around the centre from the alternating-free series of erf, in the tails from
    the continued fraction of the upper tail, whose logarithm never underflows.
    """
    z = np.asarray(z, dtype=np.float64)
    out = np.full(z.shape, np.nan)
    mid = np.abs(z) < 3
    x = z[mid]
    term = x.copy()
    total = term.copy()
    for k in range(1, 60):  # phi(x) (x + x^3/3 + x^5/15 + ...)
        term = term * x * x / (2 * k + 1)
        total = total + term
    out[mid] = np.log(0.5 + total * np.exp(-x * x / 2) / math.sqrt(2 * math.pi))
    far = np.abs(z) >= 3
    x = np.abs(z[far])
    value = x.copy()
    for k in range(80, 0, -1):  # x + 1/(x + 2/(x + 3/(x + ...)))
        value = x + k / value
    log_tail = -x * x / 2 - math.log(2 * math.pi) / 2 - np.log(value)
    out[far] = np.where(z[far] < 0, log_tail, np.log1p(-np.exp(log_tail)))
    return out


#: Upper limits of p and the significance codes of summary tables.
SIGNIFICANCE = ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "."))


def stars(p: float) -> str:
    """Significance code of a p-value."""
    if p is None or math.isnan(p):
        return ""
    return next((code for limit, code in SIGNIFICANCE if p < limit), "")
