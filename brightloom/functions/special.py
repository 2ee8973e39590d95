"""Special functions for p-values, from published series and fractions."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _bisect(f, low: float, high: float, target: float) -> float:
    """x in [low, high] with f(x) = target, for a rising f."""
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if f(mid) < target else (low, mid)
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("p must lie in (0, 1)")
    return _bisect(normal_cdf, -40, 40, p)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 500):
        for k in (0, 1):
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if not k else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / ((num * d + b) or tiny)
        c = (b + num / c) or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - scale * out


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    cdf = lambda x: 1 - t_two_sided(x, df) / 2 if x >= 0 else t_two_sided(x, df) / 2
    return _bisect(cdf, -1e6, 1e6, p)


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return 1 - gamma_inc(df / 2, x / 2)


def kolmogorov_upper(z: float) -> float:
    """P(K > z) of the Kolmogorov distribution."""
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * z) ** 2) for k in range(1, 101))))
