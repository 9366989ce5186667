"""The heat kernel's scalars: orders and Chebyshev coefficients. A few dozen numbers, computed on the driver."""

from __future__ import annotations

from math import ceil, exp, lgamma, log


def choose_order(t: float) -> int:
    """Terms that keep the truncation far below what a ranking can show."""
    return min(90, ceil(2.2 * t) + 16)


def bessel_i(k: int, t: float) -> float:
    """Modified Bessel function of the first kind, by its series in logarithms."""
    if t == 0:
        return 1.0 if k == 0 else 0.0
    half, total, m = log(t / 2), 0.0, 0
    while True:
        term = exp((2 * m + k) * half - lgamma(m + 1) - lgamma(m + k + 1))
        total += term
        if m > t and term < total * 1e-18:
            return total
        m += 1


def coefficient(k: int, t: float) -> float:
    """Of the k-th Chebyshev polynomial in exp(-t (1 + M))."""
    return exp(-t) * bessel_i(k, t) * (1 if k == 0 else 2 * (-1) ** k)


def coefficients(t: float, order: int | None = None) -> list[float]:
    return [coefficient(k, t) for k in range((choose_order(t) if order is None else order) + 1)]
