"""Series along t: slice timing, autocorrelation, whitening, detrending."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import VOXEL

#: Acquisition orders by number.
PATTERNS = {"up": 1, "down": 2, "up_interleaved": 3, "down_interleaved": 4}


def by_time(keys: list[str] | None = None):
    return Window.partitionBy(*(keys or VOXEL)).orderBy("t")


def slice_deltas(depth: int, pattern: str | list[float], tr: float, reference: int | None = None) -> list[float]:
    """Shift of each slice in volumes: (time of the reference slice - time of the slice) / TR. A list gives the times themselves, in seconds."""
    if isinstance(pattern, list):
        times = pattern
    else:
        order = list(range(depth))
        if "interleaved" in pattern:
            order = order[::2] + order[1::2]
        if pattern.startswith("down"):
            order = [depth - 1 - z for z in order]
        times = [0.0] * depth
        for k, z in enumerate(order):
            times[z] = k * tr / depth
    ref = times[round(depth / 2) if reference is None else reference]
    return [(ref - s) / tr for s in times]


def slice_timing(df: DataFrame, deltas: DataFrame, times: int) -> DataFrame:
    """Shift each slice's series by its ``delta`` with a four-point cubic; ends repeat."""
    w = by_time()
    at = lambda k: F.coalesce(F.lag("v", k).over(w) if k > 0 else F.lead("v", -k).over(w), F.first("v").over(w) if k > 0 else F.last("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    df = df.join(F.broadcast(deltas), "z")
    back2, back1, on1, on2 = at(2), at(1), at(-1), at(-2)
    df = df.withColumns({"q0": back2, "q1": back1, "q2": F.col("v"), "q3": on1, "q4": on2})
    ahead = F.col("delta") > 0
    p = [F.when(ahead, F.col(a)).otherwise(F.col(b)) for a, b in (("q1", "q0"), ("q2", "q1"), ("q3", "q2"), ("q4", "q3"))]
    d = F.when(ahead, F.col("delta")).otherwise(1 + F.col("delta"))
    a0 = p[3] - p[2] - p[0] + p[1]
    a1 = p[0] - p[1] - a0
    got = ((a0 * d + a1) * d + (p[2] - p[0])) * d + p[1]
    return df.select(*VOXEL, "t", F.when(F.col("delta") == 0, F.col("v")).otherwise(got).alias("v"))


def lag_products(df: DataFrame, times: int, order: int = 4, invalid: int = 0, keys: list[str] | None = None) -> DataFrame:
    """c0..c_order: sums of v[t] v[t - k], each over T - 1 - k - invalid; the mean stays."""
    w = by_time(keys)
    lagged = df.withColumns({f"l{k}": F.lag("v", k).over(w) for k in range(1, order + 1)}).withColumn("l0", F.col("v"))
    return lagged.groupBy(*(keys or VOXEL)).agg(*((F.sum(F.when(F.col("t") >= invalid + k, F.col("v") * F.col(f"l{k}"))) / (times - 1 - k - invalid)).alias(f"c{k}") for k in range(order + 1)))


def solve_ar(c: DataFrame, order: int = 4, ridge: float = 0.001, keys: list[str] | None = None) -> DataFrame:
    """a1..a_order from lag products: R a = r, with ``ridge`` added off the diagonal; all 0 where c0 is 0."""
    keys = keys or VOXEL
    names = [f"a{k}" for k in range(1, order + 1)]

    def run(batches):
        for pdf in batches:
            cs = pdf[[f"c{k}" for k in range(order + 1)]].to_numpy(float)
            ok = cs[:, 0] != 0
            r = cs[:, 1:] / np.where(ok, cs[:, 0], 1)[:, None]
            full = np.concatenate([np.ones((len(r), 1)), r], axis=1)
            lag = np.abs(np.subtract.outer(np.arange(order), np.arange(order)))
            m = full[:, lag] + ridge * (lag > 0)
            a = np.zeros_like(r)
            if ok.any():
                a[ok] = np.linalg.solve(m[ok], r[ok][:, :, None])[:, :, 0]
            yield pd.concat([pdf[keys], pd.DataFrame(a, columns=names, index=pdf.index)], axis=1)

    kinds = dict(c.dtypes)
    return c.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + "".join(f", {n} double" for n in names))


def whiten(df: DataFrame, ar: DataFrame, order: int = 4) -> DataFrame:
    """v[t] - sum of a_k v[t - k], over the lags that exist."""
    w = by_time()
    got = df.join(ar, VOXEL)
    out: Column = F.col("v")
    for k in range(1, order + 1):
        out = out - F.coalesce(F.col(f"a{k}") * F.lag("v", k).over(w), F.lit(0.0))
    return got.select(*VOXEL, "t", out.alias("v"))


def inverse_whiten(white: DataFrame, ar: DataFrame, order: int = 4, perm: list[int] | None = None) -> DataFrame:
    """The recursion y[t] = sum of a_k y[t - k] + w[perm[t]], one array a voxel."""
    packed = white.groupBy(*VOXEL).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s")).join(ar, VOXEL)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            w = np.array([[e["v"] for e in s] for s in pdf["s"]])
            if perm is not None:
                w = w[:, perm]
            a = pdf[[f"a{k}" for k in range(1, order + 1)]].to_numpy(float)
            y = np.zeros_like(w)
            for t in range(w.shape[1]):
                y[:, t] = w[:, t] + sum(a[:, k - 1] * y[:, t - k] for k in range(1, min(order, t) + 1))
            n, times = w.shape
            yield pd.DataFrame({**{k: np.repeat(pdf[k].to_numpy(), times) for k in VOXEL}, "t": np.tile(np.arange(times), n), "v": y.ravel()})

    return packed.mapInPandas(run, "x int, y int, z int, t int, v double")


def trends(times: int, count: int = 4) -> np.ndarray:
    """T x count: 1, t, t**2, t**3 around the middle, each scaled by its own largest value."""
    t = np.arange(times) - (times - 1) / 2
    t = t / max(np.abs(t).max(), 1)
    cols = [np.ones(times)] + [t**k / np.abs(t**k).max() for k in range(1, count)]
    return np.stack(cols, axis=1)
