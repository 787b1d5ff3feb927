"""Design matrices: event boxcars, low-pass filter, haemodynamic response, contrasts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINE = 100  # samples of a boxcar for each volume


def boxcar(events: DataFrame, tr: float, times: int, strict: bool = False) -> DataFrame:
    """(i, v) at FINE samples a volume: each event (idx, onset, duration, value) sets its samples; a later one overwrites. ``strict``: events past the end raise."""
    start = F.round(F.col("onset") * FINE / tr).cast("long")
    length = F.round(F.col("duration") * FINE / tr).cast("long")
    spans = events.select("idx", "value", start.alias("s"), (start + length - 1).alias("e")).where("e >= s")
    if strict and spans.where(F.col("e") >= times * FINE).limit(1).count():
        raise ValueError("an event ends after the run")
    spans = spans.where((F.col("s") < times * FINE) & (F.col("e") >= 0))
    cells = spans.select("idx", "value", F.explode(F.sequence(F.greatest("s", F.lit(0)), F.least("e", F.lit(times * FINE - 1)))).alias("i"))
    return cells.groupBy("i").agg(F.max_by("value", "idx").alias("v"))


def lowpass_kernel(tr: float, taps: int = 151) -> np.ndarray:
    """Gaussian of sigma 150 / 2.354 / TR samples, summing to 1."""
    sigma = 150.0 / 2.354 / tr
    x = np.arange(taps) - (taps - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def convolve(signal: DataFrame, kernel: np.ndarray, length: int) -> DataFrame:
    """Zero-padded convolution of (i, v), centred; rows only where the signal reaches."""
    half = len(kernel) // 2
    spark = signal.sparkSession
    table = spark.createDataFrame([(int(k) - half, float(w)) for k, w in enumerate(kernel) if w], "o int, w double")
    out = signal.join(F.broadcast(table)).select((F.col("i") + F.col("o")).alias("i"), (F.col("v") * F.col("w")).alias("p"))
    return out.where(F.col("i").between(0, length - 1)).groupBy("i").agg(F.sum("p").alias("v"))


def downsample(signal: DataFrame, factor: int = FINE) -> DataFrame:
    return signal.where(F.col("i") % factor == 0).select((F.col("i") / factor).cast("int").alias("t"), "v")


def sampled(signal: DataFrame, times: int, factor: int = FINE) -> np.ndarray:
    """A boxcar's value at each volume, 0 where it has none: ``times`` numbers."""
    out = np.zeros(times)
    for r in downsample(signal, factor).where(F.col("t").between(0, times - 1)).collect():
        out[r["t"]] = r["v"]
    return out


def hrf(tr: float, seconds: float = 32.0, peak: float = 6.0, under: float = 16.0, ratio: float = 6.0) -> np.ndarray:
    """The published double-gamma response, sampled at TR, summing to 1 (our choice of parameters)."""
    t = np.arange(0, seconds + 1e-9, tr)
    pdf = lambda a: np.where(t > 0, np.maximum(t, 1e-12) ** (a - 1) * np.exp(-t) / math.gamma(a), 0.0)
    h = pdf(peak) - pdf(under) / ratio
    return h / h.sum()


def temporal_derivative(x: np.ndarray) -> np.ndarray:
    """Backward difference, 0 at the start."""
    return np.concatenate([[0.0], np.diff(x)])


def demean(x: np.ndarray, constant: tuple[int, ...] = ()) -> np.ndarray:
    out = x - x.mean(axis=0)
    for c in constant:
        out[:, c] = x[:, c]
    return out


def pseudo_inverse(x: np.ndarray) -> np.ndarray:
    return np.linalg.inv(x.T @ x) @ x.T


def t_scalar(x: np.ndarray, c: np.ndarray) -> float:
    return float(c @ np.linalg.inv(x.T @ x) @ c)


def f_matrix(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    if np.linalg.matrix_rank(c) < len(c):
        raise ValueError("contrasts must have full row rank")
    return np.linalg.inv(c @ np.linalg.inv(x.T @ x) @ c.T)


def total_regressors(r: int, derivatives: bool, detrend: int, runs: int, motion: bool, global_mean: bool) -> int:
    return r * (1 + derivatives) + detrend * runs + 6 * motion + int(global_mean)


def partition(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Effective and nuisance parts of a design for contrast rows c."""
    c = np.atleast_2d(c)
    _, s, vt = np.linalg.svd(c)
    null = vt[(s > 1e-12).sum() :].T
    d = np.linalg.inv(x.T @ x)
    w1 = x @ d @ c.T @ np.linalg.inv(c @ d @ c.T)
    cv = null - c.T @ np.linalg.inv(c @ d @ c.T) @ c @ d @ null
    return w1, x @ d @ cv @ np.linalg.inv(cv.T @ d @ cv)


def with_nuisance(x: np.ndarray, c: np.ndarray, *blocks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The design with nuisance columns (trends, motion, global mean) appended, and contrasts padded with zeros for them."""
    blocks = [np.asarray(b, float).reshape(len(x), -1) for b in blocks if b is not None]
    c = np.atleast_2d(c)
    return np.column_stack([x, *blocks]), np.pad(c, ((0, 0), (0, sum(b.shape[1] for b in blocks))))


def run_blocks(per_run: list[np.ndarray]) -> np.ndarray:
    """Regressors of each run in columns of their own, zero in the other runs."""
    out = np.zeros((sum(len(b) for b in per_run), sum(b.shape[1] for b in per_run)))
    t = k = 0
    for b in per_run:
        out[t : t + len(b), k : k + b.shape[1]] = b
        t, k = t + len(b), k + b.shape[1]
    return out
