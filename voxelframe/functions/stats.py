"""Distribution functions and random-number primitives, vectorised."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_fraction(a: float, b: float, x: np.ndarray, terms: int = 300) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b) by its continued fraction (Lentz)."""
    x = np.asarray(x, float)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, terms + 1):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.abs(d * c - 1).max(initial=0) < 1e-15:
            break
    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    with np.errstate(divide="ignore"):
        front = np.exp(scale + p * np.log(y) + q * np.log1p(-y)) / p
    return np.where(swap, 1 - front * h, front * h)


def t_tail(t: np.ndarray, dof: float) -> np.ndarray:
    """P(T > abs(t)) of Student's t."""
    t = np.asarray(t, float)
    return 0.5 * beta_fraction(dof / 2, 0.5, dof / (dof + t * t))


def f_tail(f: np.ndarray, d1: float, d2: float) -> np.ndarray:
    """P(F > f) of Fisher's F; 1 below 0."""
    f = np.maximum(np.asarray(f, float), 0.0)
    return beta_fraction(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def gamma_fraction(a: float, x: np.ndarray, terms: int = 2000) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x): a series below a + 1, a continued fraction (Lentz) above."""
    x = np.maximum(np.asarray(x, float), 0.0)
    low = x < a + 1
    y = np.where(low, x, 0.0)
    term = total = np.full(x.shape, 1 / a)
    for k in range(1, terms):
        term = term * y / (a + k)
        total = total + term
        if np.abs(term).max(initial=0) < 1e-17 * np.abs(total).max(initial=1):
            break
    z, tiny = np.where(low, a + 2, x), 1e-300
    b = z + 1 - a
    c, d = np.full(x.shape, 1 / tiny), 1 / b
    h = d.copy()
    for k in range(1, terms):
        top = -k * (k - a)
        b = b + 2
        d = 1 / np.where(np.abs(top * d + b) < tiny, tiny, top * d + b)
        c = np.where(np.abs(b + top / c) < tiny, tiny, b + top / c)
        h = h * d * c
        if np.abs(d * c - 1).max(initial=0) < 1e-15:
            break
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) - x - math.lgamma(a))
        above = 1 - np.exp(a * np.log(z) - z - math.lgamma(a)) * h
    return np.where(low, front * total, above)


def chi2_tail(x: np.ndarray, dof: float) -> np.ndarray:
    """P(X > x) of chi squared."""
    return 1 - gamma_fraction(dof / 2, np.asarray(x, float) / 2)


def inverse_tail(tail, p: np.ndarray, low: float = 0.0, high: float = 1e6, steps: int = 200) -> np.ndarray:
    """x with tail(x) = p of a falling ``tail``, by bisection between ``low`` and ``high``."""
    p = np.asarray(p, float)
    a, b = np.full(p.shape, low), np.full(p.shape, high)
    for _ in range(steps):
        mid = (a + b) / 2
        over = tail(mid) > p
        a, b = np.where(over, mid, a), np.where(over, b, mid)
    return (a + b) / 2


def column_of(f, *columns: Column) -> Column:
    """A vectorised function of doubles over columns; null where any is."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        arrays = [s.to_numpy(float, na_value=np.nan) for s in series]
        known = np.isfinite(np.stack(arrays)).all(axis=0)
        out = np.full(len(known), np.nan)
        if known.any():
            out[known] = f(*(a[known] for a in arrays))
        return pd.Series(out).where(known, None)

    return run(*(c.cast("double") for c in columns))


def t_to_z(t: Column, dof: float) -> Column:
    """z of the same tail probability as t; null stays null; tails below the smallest double stop there."""
    quantile = np.vectorize(NormalDist().inv_cdf, otypes=[float])

    @F.pandas_udf("double")
    def convert(s: pd.Series) -> pd.Series:
        v = s.to_numpy(float, na_value=np.nan)
        known = np.isfinite(v)
        out = np.full(len(v), np.nan)
        if known.any():
            out[known] = -np.sign(v[known]) * quantile(np.clip(t_tail(v[known], dof), 1e-307, 0.5))
        return pd.Series(out).where(known, None)

    return convert(t.cast("double"))


def lehmer(seed: int, n: int) -> np.ndarray:
    """n uniforms in (0, 1) of the multiplicative generator with factor 16807 modulo 2**31 - 1."""
    out, x = np.empty(n), seed
    for i in range(n):
        x = x * 16807 % 2147483647
        out[i] = x / 2147483647
    return out


def box_muller(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def inverse_gamma(a: float, b: float, normals: np.ndarray) -> np.ndarray:
    """2 b over sums of 2 round(a) squared normals: as many draws as ``normals`` has such groups."""
    k = 2 * round(a)
    n = len(normals) // k
    return 2 * b / (np.asarray(normals[: n * k], float).reshape(n, k) ** 2).sum(axis=1)
