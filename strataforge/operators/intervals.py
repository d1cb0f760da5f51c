"""Exact binomial intervals of any number of rows, from the inverse of the incomplete beta function on whole vectors.

The function comes from its continued fraction or, with a parameter beyond FRACTION, from Gauss-Legendre nodes over the nearer tail; the
factor in front is a deviance from the mean, so that nothing large cancels. The inverse takes Newton steps inside a bracket.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Beyond this the continued fraction would need more than some hundred terms.
FRACTION = 3_000
#: Deviations of a tail that are integrated, and nodes for them.
TAIL, NODES = 40.0, 200
_HALF_LOG_2PI = 0.9189385332046727
_AT, _WEIGHT = np.polynomial.legendre.leggauss(NODES)


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    """ln gamma(z) less Stirling's main terms."""
    r = 1 / (z * z)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z
    small = z < 16
    if small.any():
        series[small] = [lgamma(v) - ((v - 0.5) * np.log(v) - v + _HALF_LOG_2PI) for v in z[small].tolist()]
    return series


def log_kernel(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of x^a (1 - x)^b / B(a, b)."""
    both = a + b
    away = x - a / both
    with np.errstate(divide="ignore"):
        deviance = a * np.log1p(away * both / a) + b * np.log1p(-away * both / b)
    return deviance + 0.5 * np.log(a * (b / both)) - _HALF_LOG_2PI + _stirling_rest(both) - _stirling_rest(a) - _stirling_rest(b)


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction by Lentz's method; it converges fast for x below (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    far = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / far(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / far(1 + term * d), far(1 + term / c)
            step = c * d
            out *= step
        if (np.abs(step - 1) < 1e-15).all():
            break
    return out


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """I_x(a, b) for 0 < x < 1 and parameters of at least 1."""
    out = np.empty_like(x)
    upper = x > a / (a + b)  # the tail above is the shorter one
    near = np.maximum(a, b) <= FRACTION
    for flip in (False, True):
        own = near & (upper == flip)
        if own.any():
            p, q, y = (b[own], a[own], 1 - x[own]) if flip else (a[own], b[own], x[own])
            tail = np.exp(log_kernel(x[own], a[own], b[own])) * _fraction(y, p, q) / p
            out[own] = 1 - tail if flip else tail
    far = np.flatnonzero(~near)
    if len(far):
        p, q, y = a[far, None], b[far, None], x[far, None]
        wide = TAIL * np.sqrt(p / (p + q) * (q / (p + q)) / (p + q + 1))
        end = np.where(upper[far, None], np.minimum(1.0, y + wide), np.maximum(0.0, y - wide))
        at = y + (end - y) * (_AT + 1) / 2
        full = np.broadcast_to(p, at.shape), np.broadcast_to(q, at.shape)
        values = np.exp(log_kernel(at.ravel(), full[0].ravel(), full[1].ravel())).reshape(at.shape) / (at * (1 - at))
        tail = np.abs(end - y)[:, 0] / 2 * (values @ _WEIGHT)
        out[far] = np.where(upper[far], 1 - tail, tail)
    return out


def beta_quantile(wanted: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with I_x(a, b) = wanted."""
    a, b = a.astype(float), b.astype(float)
    low, high = np.zeros(len(a)), np.ones(len(a))
    x, open_ = a / (a + b), np.arange(len(a))
    for _ in range(200):
        p, q, y = a[open_], b[open_], x[open_]
        miss = incomplete_beta(y, p, q) - wanted
        high[open_] = np.where(miss > 0, y, high[open_])
        low[open_] = np.where(miss > 0, low[open_], y)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            step = y - miss * y * (1 - y) / np.exp(log_kernel(y, p, q))
        inside = (step >= low[open_]) & (step <= high[open_])
        then = np.where(inside, step, (low[open_] + high[open_]) / 2)
        x[open_] = then
        open_ = open_[(np.abs(then - y) > 4e-16 * y) & (miss != 0)]
        if not len(open_):
            break
    return x


def binomial_bounds(hits: np.ndarray, rows: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Clopper-Pearson bounds; without rows not a number."""
    half = (1 - confidence) / 2
    lower, upper = np.where(rows > 0, 0.0, np.nan), np.where(rows > 0, 1.0, np.nan)
    some, short = (rows > 0) & (hits > 0), (rows > 0) & (hits < rows)
    lower[some] = beta_quantile(half, hits[some], rows[some] - hits[some] + 1)
    upper[short] = beta_quantile(1 - half, hits[short] + 1, rows[short] - hits[short])
    return lower, upper


def clopper_pearson(table: DataFrame, hits: str, rows: str, confidence: float = 0.95) -> DataFrame:
    """`table` with exact bounds (lower, upper) of hits / rows; null where there are no rows."""

    def bounds(k, n):
        lower, upper = binomial_bounds(k.fillna(0).to_numpy(float), n.fillna(0).to_numpy(float), confidence)
        return pd.DataFrame({"lower": lower, "upper": upper})

    bounds.__annotations__ = {"k": pd.Series, "n": pd.Series, "return": pd.DataFrame}
    found = table.withColumn("b_", F.pandas_udf(bounds, "lower double, upper double")(F.col(hits), F.col(rows)))
    there = F.col(rows) > 0
    return found.withColumns({c: F.when(there, F.col(f"b_.{c}")) for c in ("lower", "upper")}).drop("b_")
