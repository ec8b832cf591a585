"""Probability tails Spark has no function for, as Arrow-batched column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def hypergeometric_tail(k: pd.Series, population: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    """P(X >= k) for ``drawn`` draws from ``population`` items, ``marked`` of which count."""
    import numpy as np

    k, big, m, n = (s.to_numpy(dtype="int64") for s in (k, population, marked, drawn))
    if len(k) == 0:
        return pd.Series([], dtype="float64")
    least = np.maximum(0, n - (big - m))
    low, high = np.maximum(k, least), np.minimum(m, n)
    out = np.where(k <= least, 1.0, 0.0)
    todo = np.flatnonzero((k > least) & (low <= high))
    if len(todo):
        out[todo] = np.minimum(1.0, _hypergeometric_sum(*(v[todo].astype("float64") for v in (low, high, big, m, n))))
    return pd.Series(out)


def _hypergeometric_sum(low, high, big, m, n):
    """Sum of the terms ``low`` to ``high``: out from the largest one by term ratios, until nothing changes."""
    import numpy as np

    top = np.clip(np.floor((n + 1) * (m + 1) / (big + 2)), low, high)
    choose = lambda a, b: _ln_factorial(a) - _ln_factorial(b) - _ln_factorial(a - b)
    peak = np.exp(choose(m, top) + choose(big - m, n - top) - choose(big, n))
    total = np.ones_like(peak)
    for up in (True, False):
        at, term = top.copy(), np.ones_like(peak)
        rows = np.flatnonzero(at < high) if up else np.flatnonzero(at > low)
        while len(rows):  # a settled row leaves the loop, so its value does not depend on its batch
            i, mm, nn, rest = at[rows], m[rows], n[rows], (big - m - n)[rows]
            ratio = (mm - i) * (nn - i) / ((i + 1) * (rest + i + 1)) if up else i * (rest + i) / ((mm - i + 1) * (nn - i + 1))
            term[rows] *= ratio
            before = total[rows]
            total[rows] += term[rows]
            at[rows] += 1 if up else -1
            inside = at[rows] < high[rows] if up else at[rows] > low[rows]
            rows = rows[(total[rows] != before) & inside]
    return peak * total


def _ln_factorial(n):
    """ln n! by Stirling's series, after a shift of small arguments."""
    import numpy as np

    x = n + 1.0
    shift = np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        shift = np.where(small, shift + np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1, x)
    inverse = 1 / (x * x)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


@F.pandas_udf(T.DoubleType())
def student_t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t: the regularised incomplete beta at df/(df+t^2); null where
    undefined."""
    import numpy as np

    t_values = t.to_numpy(dtype="float64")
    nu = df.to_numpy(dtype="float64")
    out = np.full(len(t_values), np.nan)
    ok = np.isfinite(t_values) & np.isfinite(nu) & (nu > 0)
    if ok.any():
        out[ok] = _beta_tail(nu[ok] / 2.0, nu[ok] / (nu[ok] + t_values[ok] ** 2))
    out[np.isinf(t_values) & np.isfinite(nu)] = 0.0
    return pd.Series(out)


def _beta_tail(a, x):
    """I_x(a, 1/2) by Lentz's continued fraction, on arrays."""
    import numpy as np
    from math import lgamma

    b = 0.5
    swap = x > (a + 1.0) / (a + b + 2.0)
    p = np.where(swap, b, a)
    q = np.where(swap, a, b)
    z = np.where(swap, 1.0 - x, x)
    ln_gamma = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(ln_gamma(p + q) - ln_gamma(p) - ln_gamma(q) + p * np.log(z) + q * np.log1p(-z))
    tiny = 1e-300
    clip = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(z)
    d = 1.0 / clip(1.0 - (p + q) * z / (p + 1.0))
    h = d.copy()
    open_ = np.ones(z.shape, dtype=bool)  # a settled element stays as it is, whatever its batch does
    for m in range(1, 400):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1.0 / clip(1.0 + even * d)
        c = clip(1.0 + even / c)
        h = np.where(open_, h * d * c, h)
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1.0 / clip(1.0 + odd * d)
        c = clip(1.0 + odd / c)
        step = d * c
        h = np.where(open_, h * step, h)
        open_ &= np.abs(step - 1.0) >= 1e-15
        if not open_.any():
            break
    value = np.where(z <= 0, 0.0, front * h / p)
    return np.clip(np.where(swap, 1.0 - value, value), 0.0, 1.0)
