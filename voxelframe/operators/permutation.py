"""Permutation inference: statistics under sign flips and permuted designs, null distributions, p-maps.

A voxel's series is packed into one row; each batch of rows is multiplied with
permuted designs, a chunk of permutations at a time, so permutations cost arithmetic,
not rows: what leaves a task is one maximum for each permutation. A statistic takes
(voxels x subjects, part of the table of permutations or signs) and gives voxels x part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .design import pseudo_inverse, t_scalar
from .glm import pack
from .grid import VOXEL
from .spatial import cluster_stats, clusters

#: Permutations that one array of statistics holds.
CHUNK = 128


def sign_table(n: int, count: int, seed: int = 0) -> np.ndarray:
    """count x n signs, the identity first; every combination once if there are no more than ``count``."""
    if 2**n <= count:
        return 1 - 2 * ((np.arange(2**n)[:, None] >> np.arange(n)) & 1)
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 2, (count, n)) * 2 - 1
    out[0] = 1
    return out


def permutation_table(n: int, count: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.stack([rng.permutation(n) for _ in range(count)])
    out[0] = np.arange(n)
    return out


def classify(x: np.ndarray, c: np.ndarray) -> str:
    """mean, two_sample or correlation, by the number of different values of X c."""
    k = len(np.unique(np.round(x @ np.asarray(c, float).T, 9)))
    return "mean" if k == 1 else "two_sample" if k == 2 else "correlation"


def plans(x: np.ndarray, contrasts: np.ndarray, wanted: int, joint: bool = False) -> list[tuple[str, int]]:
    """(kind, number of permutations) of each contrast; ``joint``: of the F of them all, by the values of all contrasts together. A mean has a single one."""
    out = []
    for c in [contrasts] if joint else [c[None] for c in np.atleast_2d(contrasts)]:
        kind = classify(x, c)
        values = np.round(x @ c.T, 9)
        group = int((values == np.unique(values, axis=0)[-1]).all(axis=1).sum())
        out.append((kind, 1 if kind == "mean" else int(min(wanted, most_permutations(kind, len(x), group) + 0.5))))
    return out


def most_permutations(kind: str, n: int, n1: int | None = None) -> float:
    if kind == "mean":
        return 2.0**n
    log = math.lgamma(n + 1)
    if kind == "two_sample":
        log -= math.lgamma(n1 + 1) + math.lgamma(n - n1 + 1)
    return math.exp(log) if log < 700 else math.inf


def group_mean_t(ys: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """voxels x permutations: mean over sd / sqrt(N), after flips; 0 for no variance."""
    n = ys.shape[1]
    mean = ys @ signs.T / n
    var = ((ys**2).sum(axis=1, keepdims=True) - n * mean**2) / (n - 1)
    return np.where(var > 1e-12, mean / np.sqrt(np.maximum(var, 1e-300) / n), 0.0)


def design_t(ys: np.ndarray, x: np.ndarray, c: np.ndarray, perms: np.ndarray) -> np.ndarray:
    """voxels x permutations: t of contrast c with the design's rows permuted; variance over N - R."""
    n, r = x.shape
    p, s, total = pseudo_inverse(x), t_scalar(x, c), (ys**2).sum(axis=1)
    out = np.empty((len(ys), len(perms)))
    for k, perm in enumerate(perms):
        b = ys @ p[:, perm].T
        e2 = total - np.einsum("vr,vr->v", b @ (x.T @ x), b)
        var = e2 / (n - r)
        out[:, k] = np.where(var > 1e-12, (b @ c) / np.sqrt(np.maximum(var, 1e-300) * s), 0.0)
    return out


def design_f(ys: np.ndarray, x: np.ndarray, c: np.ndarray, perms: np.ndarray) -> np.ndarray:
    """As :func:`design_t`, for the F of contrast rows c."""
    from .design import f_matrix

    n, r = x.shape
    c = np.atleast_2d(c)
    p, m, total = pseudo_inverse(x), f_matrix(x, c), (ys**2).sum(axis=1)
    out = np.empty((len(ys), len(perms)))
    for k, perm in enumerate(perms):
        b = ys @ p[:, perm].T
        var = (total - np.einsum("vr,vr->v", b @ (x.T @ x), b)) / (n - r)
        cb = b @ c.T
        out[:, k] = np.where(var > 1e-12, np.einsum("vi,ij,vj->v", cb, m, cb) / np.maximum(var * len(c), 1e-300), 0.0)
    return out


def _parts(table: np.ndarray, chunk: int):
    return ((at, table[at : at + chunk]) for at in range(0, len(table), chunk))


def null_of_max(df: DataFrame, statistic, table: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """(p, max_stat): the largest statistic over voxels of each permutation of ``table``."""

    def run(batches):
        best = np.full(len(table), -np.inf)
        for pdf in batches:
            if len(pdf):
                ys = np.array(pdf["ys"].tolist())
                for at, part in _parts(table, chunk):
                    best[at : at + chunk] = np.maximum(best[at : at + chunk], statistic(ys, part).max(axis=0))
        if np.isfinite(best).all():
            yield pd.DataFrame({"p": np.arange(len(best), dtype=np.int32), "max_stat": best})

    return pack(df).select("ys").mapInPandas(run, "p int, max_stat double").groupBy("p").agg(F.max("max_stat").alias("max_stat"))


def permuted_maps(df: DataFrame, statistic, table: np.ndarray, above: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """(p, x, y, z, v): the statistics, those over ``above`` only if it is given."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                ys = np.array(pdf["ys"].tolist())
                for at, part in _parts(table, chunk):
                    s = statistic(ys, part)
                    i, k = np.nonzero(s > above) if above is not None else map(np.ravel, np.indices(s.shape))
                    yield pd.DataFrame({"p": (k + at).astype(np.int32), **{a: pdf[a].to_numpy()[i] for a in VOXEL}, "v": s[i, k]})

    return pack(df).mapInPandas(run, "p int, x int, y int, z int, v double")


def null_of_clusters(df: DataFrame, statistic, table: np.ndarray, level: float, width: int, height: int, what: str = "size") -> DataFrame:
    """(p, max_stat): size or mass of each permutation's largest cluster over ``level``, 0 if it has none."""
    stats = cluster_stats(clusters(permuted_maps(df, statistic, table, level), level, width, height, ["p"]), ["p"])
    every = df.sparkSession.range(len(table)).select(F.col("id").cast("int").alias("p"))
    return every.join(stats.groupBy("p").agg(F.max(what).cast("double").alias("m")), "p", "left").select("p", F.coalesce("m", F.lit(0.0)).alias("max_stat"))


def cluster_map(df: DataFrame, statistic, level: float, width: int, height: int, what: str = "size") -> DataFrame:
    """(x, y, z, v) of every voxel: size or mass of the cluster that it is in, 0 below ``level``. ``statistic``: voxels x subjects -> voxels x 1."""
    first = permuted_maps(df, lambda ys, _: statistic(ys), np.zeros((1, 1))).drop("p")
    lab = clusters(first, level, width, height)
    sized = lab.join(cluster_stats(lab), "cluster").select(*VOXEL, F.col(what).cast("double").alias("s"))
    return first.select(*VOXEL).join(sized, VOXEL, "left").select(*VOXEL, F.coalesce("s", F.lit(0.0)).alias("v"))


def p_map(stats: DataFrame, null: DataFrame, value: str = "v") -> DataFrame:
    """Adds one_minus_p: the share of the null strictly below, by binary search. The null holds one number a permutation."""
    levels = np.sort(np.array([r[0] for r in null.select("max_stat").collect()], float))

    @F.pandas_udf("double")
    def below(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(levels, v.to_numpy(float), "left") / max(len(levels), 1))

    return stats.withColumn("one_minus_p", below(F.col(value)))


def significance_level(null: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The sorted null's entry at round((1 - alpha) P), counted from 1."""
    packed = null.agg(F.sort_array(F.collect_list("max_stat")).alias("null"))
    return packed.select(F.element_at("null", F.round(F.size("null") * (1 - alpha)).cast("int")).alias("level"))


# ------------------------------------------------------------------ first level


def first_level_t(ys: np.ndarray, x: np.ndarray, c: np.ndarray, perms: np.ndarray) -> np.ndarray:
    """voxels x permutations: t of contrast c on permuted series; variance of the residuals around their mean, over T - 1."""
    p, s = pseudo_inverse(x), t_scalar(x, c)
    out = np.empty((len(ys), len(perms)))
    for k, perm in enumerate(perms):
        b = ys[:, perm] @ p.T
        var = (ys[:, perm] - b @ x.T).var(axis=1, ddof=1)
        out[:, k] = np.where(var > 1e-12, (b @ c) / np.sqrt(np.maximum(var, 1e-300) * s), 0.0)
    return out


def first_level_f(ys: np.ndarray, x: np.ndarray, c: np.ndarray, perms: np.ndarray) -> np.ndarray:
    """As :func:`first_level_t`, for the F of contrast rows c."""
    from .design import f_matrix

    c = np.atleast_2d(c)
    p, m = pseudo_inverse(x), f_matrix(x, c)
    out = np.empty((len(ys), len(perms)))
    for k, perm in enumerate(perms):
        b = ys[:, perm] @ p.T
        var = (ys[:, perm] - b @ x.T).var(axis=1, ddof=1)
        cb = b @ c.T
        out[:, k] = np.where(var > 1e-12, np.einsum("vi,ij,vj->v", cb, m, cb) / np.maximum(var * len(c), 1e-300), 0.0)
    return out


def recolour(white: np.ndarray, ar: np.ndarray) -> np.ndarray:
    """Series with AR coefficients ``ar`` (voxels x order) from white ones: y[t] = sum of a_k y[t - k] + w[t]."""
    y = np.zeros_like(white)
    for t in range(white.shape[1]):
        y[:, t] = white[:, t] + sum(ar[:, k - 1] * y[:, t - k] for k in range(1, min(ar.shape[1], t) + 1))
    return y


def exchangeable_null(white: DataFrame, ar: DataFrame, x: np.ndarray, c: np.ndarray, perms: np.ndarray, order: int = 4) -> DataFrame:
    """(p, max_stat) of first-level t: whitened residuals are permuted, coloured again by their voxel's coefficients, and fitted."""
    packed = pack(white).join(ar, VOXEL).select("ys", *(f"a{k}" for k in range(1, order + 1)))

    def run(batches):
        best = np.full(len(perms), -np.inf)
        for pdf in batches:
            if len(pdf):
                w, a = np.array(pdf["ys"].tolist()), pdf[[f"a{k}" for k in range(1, order + 1)]].to_numpy(float)
                for k, perm in enumerate(perms):
                    best[k] = max(best[k], first_level_t(recolour(w[:, perm], a), x, c, np.arange(w.shape[1])[None]).max())
        if np.isfinite(best).all():
            yield pd.DataFrame({"p": np.arange(len(perms), dtype=np.int32), "max_stat": best})

    return packed.mapInPandas(run, "p int, max_stat double").groupBy("p").agg(F.max("max_stat").alias("max_stat"))
