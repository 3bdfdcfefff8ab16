"""Tail probabilities of the t, F and chi-square distributions for a handful of test statistics.

Scalars on the driver only: the statistics themselves come out of Spark aggregations.  Continued
fraction and series forms as in Abramowitz & Stegun (26.5, 6.5) and Lentz's evaluation scheme.
"""

from __future__ import annotations

import math

_TINY = 1e-300
_STOP = 1e-15


def _lentz(first: float, terms, c: float = 1.0 / _TINY) -> float:
    """Evaluate 1/(first + a1/(b1 + a2/(b2 + ...))) from its (a, b) pairs; ``c`` is the leading numerator ratio."""
    d = 1.0 / first
    out = d
    for a, b in terms:
        d = b + a * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + a / c
        c = c if abs(c) > _TINY else _TINY
        step = c * d
        out *= step
        if abs(step - 1.0) < _STOP:
            break
    return out


def _beta_terms(a: float, b: float, x: float):
    for m in range(1, 5000):
        yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(b, a, 1.0 - x)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    first = 1.0 - (a + b) * x / (a + 1.0)
    return math.exp(log_front) / a * _lentz(first if abs(first) > _TINY else _TINY, _beta_terms(a, b, x), c=1.0)


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * _STOP:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * math.exp(log_front)
    terms = ((-i * (i - a), x + 2 * i + 1.0 - a) for i in range(1, 5000))
    return math.exp(log_front) * _lentz(x + 1.0 - a, terms)


def t_tail(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def t_tail_greater(t: float, df: float) -> float:
    """P(T >= t)."""
    half = t_tail(t, df) / 2.0
    return half if t >= 0 else 1.0 - half


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f)."""
    return 1.0 if f <= 0 else beta_cdf(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_tail(x: float, df: float) -> float:
    """P(X >= x)."""
    return gamma_tail(df / 2.0, x / 2.0)


def correlation_p(r: float, n: float) -> float:
    """Two-sided p of a correlation through its t transform."""
    if n <= 2 or r != r:
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    return t_tail(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)
