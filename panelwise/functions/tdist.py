"""Two-sided Student t p-value, vectorised; applied to one row per pair of series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def _lgamma(z: np.ndarray) -> np.ndarray:
    from math import lgamma

    return np.array([lgamma(v) for v in z])


def two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) = I_x(df/2, 1/2) with x = df / (df + t^2)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    x = df / (df + t * t)
    a, b = df / 2.0, np.full_like(df, 0.5)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        direct = front * _beta_fraction(a, b, x) / a
        mirror = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    p = np.where(x < (a + 1.0) / (a + b + 2.0), direct, mirror)
    return np.where(t == 0, 1.0, np.clip(p, 0.0, 1.0))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = two_sided(t[ok].to_numpy(), df[ok].to_numpy())
    return out
