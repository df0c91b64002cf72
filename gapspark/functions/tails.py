"""Tail probabilities on the driver, for statistics that the engine has already reduced to a few numbers."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_upper(t: float, df: float) -> float:
    p = t_two_sided(t, df) / 2
    return p if t >= 0 else 1 - p


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_upper(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def mann_whitney_p(u: float, n1: int, n2: int, tie_sum: float = 0.0) -> float:
    """Two-sided: exact for small samples without ties, else the normal approximation with tie and continuity corrections."""
    if tie_sum == 0 and min(n1, n2) <= 8:
        counts = {0: 1}  # ways to reach each U, by the recurrence over the larger sample
        table = [[{0: 1} for _ in range(n2 + 1)] for _ in range(n1 + 1)]
        for i in range(1, n1 + 1):
            for j in range(1, n2 + 1):
                counts = dict(table[i][j - 1])
                for v, c in table[i - 1][j].items():
                    counts[v + j] = counts.get(v + j, 0) + c
                table[i][j] = counts
        total = sum(table[n1][n2].values())
        high = max(u, n1 * n2 - u)
        return min(1.0, 2 * sum(c for v, c in table[n1][n2].items() if v >= high) / total)
    n = n1 + n2
    spread = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie_sum / (n * (n - 1))))
    if spread == 0:
        return 1.0
    return min(1.0, normal_two_sided(max(0.0, (abs(u - n1 * n2 / 2) - 0.5)) / spread))


def holm(p: list[float]) -> list[float]:
    order, out, worst = sorted(range(len(p)), key=lambda i: p[i]), [0.0] * len(p), 0.0
    for k, i in enumerate(order):
        worst = max(worst, min(1.0, (len(p) - k) * p[i]))
        out[i] = worst
    return out
