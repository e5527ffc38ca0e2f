"""Special functions on numpy arrays, for a few rows of counts each."""

from __future__ import annotations

import math


def _stirling_rest(n: float) -> float:
    """ln n! less Stirling's formula: a table's worth of exact logarithms for small n, the series beyond."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n > 0 else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * m)) / m) / m) / m) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x without loss where x is near the mean."""
    d, v = x - mean, (x - mean) / (x + mean)
    if abs(d) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    total, term, j = d * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def even_binomial(k: int, n: int) -> float:
    """P(X = k) of n fair draws, by saddle-point expansion: relative precision stays at some 1e-14 for any n."""
    if k in (0, n):
        return math.exp(n * math.log(0.5))
    log = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - _deviance(k, n / 2) - _deviance(n - k, n / 2)
    return math.exp(log) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def even_binomial_tail(k: int, n: int) -> float:
    """P(X <= k) of n fair draws for k < n / 2: the regularised incomplete beta function I(1/2; n - k, k + 1) by its continued fraction, in constant memory."""
    a, b, x, tiny = float(n - k), float(k + 1), 0.5, 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out, m = d, 0
    while True:
        m += 1
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15 or m > 10_000_000:
            return even_binomial(k, n) * out / 2


def paired_sign_test(only_a: int, only_b: int) -> float:
    """Two-sided exact p of discordant pairs: twice the smaller tail, 1 without any or where both are equal."""
    n, k = only_a + only_b, min(only_a, only_b)
    if n == 0 or 2 * k >= n - 1:
        return 1.0
    return min(1.0, 2 * even_binomial_tail(k, n))
