"""Tail probabilities of t, F and chi-squared, from continued fractions and series."""

from __future__ import annotations

import math

TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > TINY else TINY)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > TINY else TINY)
            c = 1 + step / c
            c = c if abs(c) > TINY else TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def upper_gamma(a: float, x: float) -> float:
    """The regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1 / TINY
    d = 1 / b
    h = d
    for i in range(1, 1000):
        b += 2
        d = 1 / (-i * (i - a) * d + b)
        c = b - i * (i - a) / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return upper_gamma(df / 2, x / 2)


def welch(groups: list[tuple[int, float, float]]) -> float | None:
    """p of Welch's test for equal means from (n, mean, variance) of two groups or more; None if it isn't defined."""
    if len(groups) < 2 or any(n < 2 or not v > 0 for n, _, v in groups):
        return None
    if len(groups) == 2:
        (n, m, v), (k, q, w) = groups
        a, b = v / n, w / k
        return t_two_sided((m - q) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n - 1) + b * b / (k - 1)))
    weights = [n / v for n, _, v in groups]
    total, k = sum(weights), len(groups)
    mean = sum(w * m for w, (_, m, _) in zip(weights, groups, strict=True)) / total
    spread = sum((1 - w / total) ** 2 / (n - 1) for w, (n, _, _) in zip(weights, groups, strict=True))
    between = sum(w * (m - mean) ** 2 for w, (_, m, _) in zip(weights, groups, strict=True)) / (k - 1)
    return f_upper(between / (1 + 2 * (k - 2) / (k * k - 1) * spread), k - 1, (k * k - 1) / (3 * spread))


def chi_squared(table: list[list[int]]) -> float | None:
    """p of the test for independence; 2 x 2 tables with the continuity correction. None if it isn't defined."""
    rows = [r for r in table if sum(r)]
    keep = [j for j in range(len(rows[0]) if rows else 0) if sum(r[j] for r in rows)]
    cells = [[r[j] for j in keep] for r in rows]
    if len(cells) < 2 or len(keep) < 2:
        return None
    down, across = [sum(r) for r in cells], [sum(c) for c in zip(*cells, strict=True)]
    total = sum(down)
    expected = [[a * b / total for b in across] for a in down]
    gaps = [abs(o - e) for r, x in zip(cells, expected, strict=True) for o, e in zip(r, x, strict=True)]
    correction = min(0.5, *gaps) if len(cells) == len(keep) == 2 else 0.0
    flat = [e for x in expected for e in x]
    return chi2_upper(sum((g - correction) ** 2 / e for g, e in zip(gaps, flat, strict=True)), (len(cells) - 1) * (len(keep) - 1))
