"""Tail probabilities for statistics that Spark has already reduced to a few scalars."""

from __future__ import annotations

import math
from statistics import NormalDist

_TINY = 1e-300


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b), by Lentz's continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    f = c = 1.0
    d = 0.0
    for step in range(0, 2000):
        m = step // 2
        if step == 0:
            numerator = 1.0
        elif step % 2 == 0:
            numerator = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            numerator = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + numerator * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + numerator / c
        c = c if abs(c) > _TINY else _TINY
        f *= c * d
        if step and abs(1.0 - c * d) < 1e-15:
            break
    return math.exp(log_front) * (f - 1.0) / a


def t_two_sided(t: float, dof: float) -> float:
    if dof <= 0:
        return math.nan
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def pearson_p(r: float | None, dof: float) -> float | None:
    """Two-sided p of a correlation coefficient with ``dof`` degrees of freedom."""
    if r is None or dof <= 0:
        return None
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt(dof / (1.0 - r * r)), dof)


def f_upper(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)
