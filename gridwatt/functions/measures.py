"""Anomalies, bands, hinges, interpolation and distribution tails as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Multiplier into the display unit, by variable family.
UNIT_SCALE = {"tt": 1.0, "wnd": 0.001, "spv": 0.001, "rre": 1.0}

REGIME_THRESHOLD = 1.0
REGIME_LEAD_FACTOR = -0.018774217528098960


def anomaly(value: Column, normal: Column) -> Column:
    return value - normal


def anomaly_pct(value: Column, normal: Column) -> Column:
    """Percent above or below normal; NULL for a zero or missing normal."""
    return (F.try_divide(value, normal) - 1) * 100


def scale_units(value: Column, family: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, k in UNIT_SCALE.items():
        out = F.when(family == name, value * k).otherwise(out)
    return out


def high_low(z: Column, threshold: float) -> Column:
    return F.when(z >= threshold, "High").when(z <= -threshold, "Low").when(z.isNotNull(), "Neutral")


def band(x: Column, low: float, high: float, names: tuple[str, str, str]) -> Column:
    """Name of the band below, between and above two bounds, both bounds outside the middle."""
    return F.when(x >= high, names[2]).when(x <= low, names[0]).when(x.isNotNull(), names[1])


def cold_hinge(temp: Column, knot: Column | float) -> Column:
    k = knot if isinstance(knot, Column) else F.lit(knot)
    return F.greatest(k - temp, F.lit(0.0))


def hot_hinge(temp: Column, knot: Column | float) -> Column:
    k = knot if isinstance(knot, Column) else F.lit(knot)
    return F.greatest(temp - k, F.lit(0.0))


def harmonics(doy: Column, n: int) -> dict[str, Column]:
    out = {}
    for h in range(1, n + 1):
        angle = doy * (2 * math.pi * h / 365.25)
        out[f"sin{h}"], out[f"cos{h}"] = F.sin(angle), F.cos(angle)
    return out


def interp_grid(knots: Sequence[float], values: Column, at: Column) -> Column:
    """Linear interpolation of ``values`` (an array over ``knots``), flat beyond both ends."""
    def v(i: int) -> Column:
        return F.get(values, i)

    out = F.when(at <= knots[0], v(0))
    for i in range(1, len(knots)):
        lo, hi = float(knots[i - 1]), float(knots[i])
        out = out.when(at <= hi, v(i - 1) + (v(i) - v(i - 1)) * ((at - lo) / (hi - lo)))
    return out.otherwise(v(len(knots) - 1))


def regime_threshold(lead: Column) -> Column:
    return F.lit(REGIME_THRESHOLD) + lead * F.lit(REGIME_LEAD_FACTOR)


# ---------------------------------------------------------------------------
# Student-t and binomial tails (Spark has no such functions)
# ---------------------------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    """lgamma, once for each distinct value: degrees of freedom repeat over the rows."""
    values, place = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in values])[place]


def _inc_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, element-wise."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(t) + q * np.log1p(-t)) / p
    tiny = 1e-300
    c = np.ones_like(t)
    d = 1 - (p + q) * t / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 200):
        for num in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
    res = np.where(t <= 0, 0.0, front * out)
    return np.where(swap, 1 - res, res)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a Student-t statistic; NULL where either input is."""
    ok = t.notna() & df.notna() & (df > 0)
    out = np.full(len(t), np.nan)
    tt, v = t[ok].to_numpy(float), df[ok].to_numpy(float)
    if len(tt):
        out[ok.to_numpy()] = _inc_beta(v / 2, np.full_like(v, 0.5), v / (v + tt * tt))
    return pd.Series(out).where(~np.isnan(out), None)


@F.pandas_udf(T.DoubleType())
def binomial_upper(k: pd.Series, n: pd.Series) -> pd.Series:
    """P(X >= k) of n fair coin tosses."""
    ok = k.notna() & n.notna() & (n > 0)
    out = np.full(len(k), np.nan)
    kk, nn = k[ok].to_numpy(float), n[ok].to_numpy(float)
    if len(kk):
        p = _inc_beta(np.maximum(kk, 1), nn - kk + 1, np.full_like(kk, 0.5))
        out[ok.to_numpy()] = np.where(kk <= 0, 1.0, p)
    return pd.Series(out).where(~np.isnan(out), None)
