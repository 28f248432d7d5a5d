"""Interval and tail functions on the driver, for statistics that have one row for a report or a site."""

from __future__ import annotations

import math
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlake import constants as C


def wilson_lower(k: Column, n: Column, z: float = C.WILSON_Z95) -> Column:
    """One-sided lower Wilson bound of k of n, 0 where n is 0, never below 0."""
    p = F.try_divide(k.cast("double"), n)
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), bound)).otherwise(0.0)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # the continued fraction 1 / (1 + s1 / (1 + s2 / ...)), evaluated by its convergents' ratios
    fix = lambda v: v if abs(v) > 1e-300 else 1e-300
    c, d = 1.0, 1.0 / fix(1.0 - (a + b) * x / (a + 1.0))
    out = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for s in (even, odd):
            d, c = 1.0 / fix(1.0 + s * d), fix(1.0 + s / c)
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


def beta_quantile(q: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(mid, a, b) < q else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, level: float) -> tuple[float, float]:
    """Exact two-sided interval of a share with error `level`; 0 and 1 at the ends."""
    low = beta_quantile(level / 2, k, n - k + 1) if k > 0 else 0.0
    high = beta_quantile(1 - level / 2, k + 1, n - k) if k < n else 1.0
    return low, high


def binomial_exceedance(n: int, alpha: float) -> float:
    """The chance that more than alpha * n of n trials fail when each does with probability alpha."""
    k = math.floor(alpha * n + 1e-9)
    return incomplete_beta(alpha, k + 1, n - k) if k < n else 0.0


def odds_ratio(q: float, c0: float, c1: float, pi_s: float) -> float:
    """Target to source odds of the positive class from the predicted-positive rate and the head's error rates."""
    clip = lambda v: min(max(v, C.PI_CLIP), 1.0 - C.PI_CLIP)
    t, s = clip((q - c0) / (c1 - c0)), clip(pi_s)
    return (t / (1.0 - t)) / (s / (1.0 - s))


def odds_ratio_box(q: tuple[float, float], c0: tuple[float, float], c1: tuple[float, float], pi_s: tuple[float, float]) -> tuple[float, float]:
    """The least and largest odds ratio over the corners of a box."""
    corners = [odds_ratio(*corner) for corner in product(q, c0, c1, pi_s)]
    return min(corners), max(corners)


def odds_ratio_of(q: Column, c0: Column, c1: Column, pi_s: Column) -> Column:
    """odds_ratio as an expression."""
    clip = lambda v: F.least(F.greatest(v, F.lit(C.PI_CLIP)), F.lit(1.0 - C.PI_CLIP))
    t, s = clip((q - c0) / (c1 - c0)), clip(pi_s)
    return (t / (1.0 - t)) / (s / (1.0 - s))


def odds_ratio_ends(q: tuple[Column, Column], c0: tuple[Column, Column], c1: tuple[Column, Column], pi_s: tuple[Column, Column]) -> tuple[Column, Column]:
    """odds_ratio_box as expressions: the least and the largest odds ratio over the corners of a box."""
    corners = [odds_ratio_of(*corner) for corner in product(q, c0, c1, pi_s)]
    return F.least(*corners), F.greatest(*corners)


def beta_tails(x, a, b):
    """The regularised incomplete beta function over arrays, by the same continued fraction for all entries at once."""
    import numpy as np

    x, a, b = (np.array(v, float) for v in np.broadcast_arrays(x, a, b))
    swap = x > (a + 1.0) / (a + b + 2.0)
    y, p, q = np.where(swap, 1.0 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    inside = (x > 0.0) & (x < 1.0)
    y = np.where(inside, y, 0.5)
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    logs = (gamma(p + q) - gamma(p) - gamma(q)).astype(float) + p * np.log(y) + q * np.log1p(-y)
    fix = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(y), 1.0 / fix(1.0 - (p + q) * y / (p + 1.0))
    out = d.copy()
    open_ = np.ones(y.shape, bool)
    for m in range(1, 2000):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        for s in (even, odd):
            d, c = 1.0 / fix(1.0 + s * d), fix(1.0 + s / c)
            out = np.where(open_, out * c * d, out)
        open_ &= np.abs(c * d - 1.0) >= 1e-15
        if not open_.any():
            break
    tail = np.exp(logs) / p * out
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, np.where(swap, 1.0 - tail, tail)))


def beta_quantiles(level, a, b):
    """Quantiles of beta distributions over arrays, by halving."""
    import numpy as np

    level, a, b = (np.array(v, float) for v in np.broadcast_arrays(level, a, b))
    low, high = np.zeros_like(level), np.ones_like(level)
    for _ in range(70):
        mid = (low + high) / 2
        under = beta_tails(mid, a, b) < level
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def clopper_pearson_ends(k: Column, n: Column, level: float) -> Column:
    """Struct (lo, hi): the exact two-sided interval of k of n with error `level`, rows taken batch by batch; NULL where either is."""
    @F.pandas_udf("lo double, hi double")
    def run(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        import numpy as np

        known = (k.notna() & n.notna()).to_numpy()
        own, all_ = (v.to_numpy(float, na_value=np.nan)[known] for v in (k, n))
        lo, hi = np.full(len(known), np.nan), np.full(len(known), np.nan)
        lo[known] = np.where(own > 0, beta_quantiles(level / 2, np.maximum(own, 1), all_ - own + 1), 0.0)
        hi[known] = np.where(own < all_, beta_quantiles(1 - level / 2, own + 1, np.maximum(all_ - own, 1)), 1.0)
        return pd.DataFrame({"lo": pd.Series(lo).where(known), "hi": pd.Series(hi).where(known)})

    return run(k, n)


def binomial_exceedances(n: Column, alpha: Column | float) -> Column:
    """The chance that more than alpha * n of n trials fail when each does with probability alpha, rows taken batch by batch."""
    @F.pandas_udf("double")
    def run(n: pd.Series, alpha: pd.Series) -> pd.Series:
        import numpy as np

        size, p = n.to_numpy(float, na_value=np.nan), alpha.to_numpy(float, na_value=np.nan)
        known = ~(np.isnan(size) | np.isnan(p))
        out = np.full(len(size), np.nan)
        k = np.floor(p[known] * size[known] + 1e-9)
        out[known] = np.where(k < size[known], beta_tails(p[known], k + 1, np.maximum(size[known] - k, 1)), 0.0)
        return pd.Series(out).where(known)

    return run(n, alpha if isinstance(alpha, Column) else F.lit(float(alpha)))
