"""Tail probabilities and quantiles of the tests used on result tables.

Counting and ranking happen in Spark; these turn a handful of aggregated rows into p-values.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=4096)
def binomial_two_sided(k: int, n: int) -> float:
    """P(at least as uneven a split as k of n) for a fair coin."""
    if n == 0:
        return 1.0
    low = min(k, n - k)
    if 2 * low == n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) - n * math.log(2))
    total, i = 0.0, low
    while i >= 0 and term > total * 1e-18:
        total += term
        term *= i / (n - i + 1)
        i -= 1
    return min(1.0, 2 * total)


def hypergeometric_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of [[a, b], [c, d]]: the tables no likelier than the one seen."""
    row, column, n = a + b, a + c, a + b + c + d
    low, high = max(0, row + column - n), min(row, column)
    x = np.arange(low, high, dtype=float)
    steps = np.log((row - x) * (column - x)) - np.log((x + 1) * (n - row - column + x + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    p /= p.sum()
    return float(min(1.0, p[p <= p[a - low] * (1 + 1e-7)].sum()))


def signed_rank_two_sided(w: float, n: int, ties: float) -> float:
    """Wilcoxon signed-rank p-value: exact up to 50 pairs without ties, else the normal limit with the
    tie correction. ``ties`` is the sum of t^3 - t over groups of equal differences."""
    if n <= 50 and ties == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for rank in range(1, n + 1):
            moved = ways.copy()
            moved[rank:] += ways[:-rank]
            ways = moved
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    z = (w - n * (n + 1) / 4) / spread
    return math.erfc(abs(z) / math.sqrt(2))


def _t_tail(t: float, df: int) -> float:
    """P(T > t) for t > 0, from the incomplete beta function's continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        result = d
        for m in range(1, 500):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            delta = 1.0
            for term in (even, odd):
                d = 1 + term * d
                c = 1 + term / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                delta = c * d
                result *= delta
            if abs(delta - 1) < 1e-15:
                break
        return result

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    inside = front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b
    return inside / 2


@lru_cache(maxsize=4096)
def t_quantile(p: float, df: int) -> float:
    """The p-quantile (p > 0.5) of Student's t with df degrees of freedom."""
    if df > 1_000_000:
        return NormalDist().inv_cdf(p)
    low, high = 0.0, 1e9 if df < 3 else 1e4
    for _ in range(200):
        middle = (low + high) / 2
        if _t_tail(middle, df) > 1 - p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided(int(a), int(b)) for a, b in zip(k, n)])


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_two_sided(*(int(x) for x in row)) for row in zip(a, b, c, d)])


@F.pandas_udf(DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_two_sided(float(x), int(y), float(z)) if y > 0 else 1.0 for x, y, z in zip(w, n, ties)])


@F.pandas_udf(DoubleType())
def t_975(df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(0.975, int(x)) if x >= 1 else float("nan") for x in df])
