"""Distributions and small list functions."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_p_value(t: float, dof: float) -> float:
    """Two-sided."""
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def correlation_p_value(r: float | None, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs; NaN if there is none or n < 3."""
    if r is None or math.isnan(r) or n < 3:
        return math.nan
    if abs(r) >= 1:
        return 0.0
    return t_p_value(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def strings(text: str) -> list[str]:
    """Comma-separated strings, trimmed."""
    return [s.strip() for s in text.split(",")]


def integers(text: str) -> list[int]:
    """Comma-separated integers; ValueError for anything else."""
    return [int(s) for s in strings(text)]
