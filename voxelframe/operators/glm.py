"""Voxel-wise general linear models on (x, y, z, t, v) rows.

The design is small, so its pseudo-inverse and contrast scalars are computed once
on the driver and sent along as expressions of a packed row: a voxel's series is
gathered once (one shuffle), and betas, residual sums and statistics are
projections of that array. No row is multiplied by the number of regressors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .design import f_matrix, pseudo_inverse, t_scalar
from .grid import VOXEL
from .temporal import lag_products, solve_ar


def pack(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a voxel: ``ys``, its values in order of t."""
    rows = df.groupBy(*(keys or VOXEL)).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s"))
    return rows.select(*(keys or VOXEL), F.transform("s", lambda e: e["v"]).alias("ys"))


def _constants(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def dot(ys: Column, values) -> Column:
    """Inner product of an array column with constants."""
    return F.aggregate(F.zip_with(ys, _constants(values), lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)


def betas(df: DataFrame, x: np.ndarray, censor: np.ndarray | None = None, keys=None) -> DataFrame:
    """b0.. by voxel, with ``ys``; censored volumes (weight 0) don't count."""
    p = pseudo_inverse(x) * (1.0 if censor is None else censor)
    packed = pack(df, keys)
    return packed.select("*", *(dot(F.col("ys"), p[r]).alias(f"b{r}") for r in range(x.shape[1])))


def copes(fit: DataFrame, contrasts: np.ndarray) -> DataFrame:
    return fit.select("*", *(_combine(c).alias(f"c{k}") for k, c in enumerate(np.atleast_2d(contrasts))))


def _combine(weights) -> Column:
    total = F.lit(0.0)
    for r, w in enumerate(weights):
        total = total + F.col(f"b{r}") * float(w)
    return total


def residuals(fit: DataFrame, x: np.ndarray) -> DataFrame:
    """Adds ``es``: y - X b in order of t."""
    fitted = F.array(*(_combine(row) for row in x))
    return fit.withColumn("es", F.zip_with("ys", fitted, lambda y, f: y - f))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, e: s + e)


def variance(res: DataFrame, times: int, regressors: int, mode: str, censor: np.ndarray | None = None) -> DataFrame:
    """Adds ``var``. Modes: ``first`` (around the mean, T - 1, censored volumes left out of the sums but not of T),
    ``second_t`` (no mean, N - R), ``second_f`` (around the mean, N - R - 1)."""
    w = _constants(np.ones(times) if censor is None else censor)
    if mode == "second_t":
        return res.withColumn("var", _sum(F.transform("es", lambda e: e * e)) / float(times - regressors))
    mean = _sum(F.zip_with("es", w, lambda e, k: e * k)) / float(times)
    res = res.withColumn("mean_e", mean)
    total = _sum(F.zip_with("es", w, lambda e, k: (e - F.col("mean_e")) * (e - F.col("mean_e")) * k))
    return res.withColumn("var", total / float(times - 1 if mode == "first" else times - regressors - 1)).drop("mean_e")


def t_map(df: DataFrame, x: np.ndarray, c: np.ndarray, mode: str = "second_t", censor=None, keys=None) -> DataFrame:
    """(x, y, z, cope, var, stat); 0 where the variance is."""
    fit = variance(residuals(betas(df, x, censor, keys), x), *x.shape, mode, censor)
    cope = _combine(c)
    stat = F.when(F.col("var") > 0, cope / F.sqrt(F.col("var") * t_scalar(x, np.asarray(c, float)))).otherwise(0.0)
    return fit.select(*(keys or VOXEL), cope.alias("cope"), "var", stat.alias("stat"))


def f_map(df: DataFrame, x: np.ndarray, c: np.ndarray, mode: str = "second_f", censor=None, keys=None) -> DataFrame:
    m = f_matrix(x, np.atleast_2d(c))
    fit = copes(variance(residuals(betas(df, x, censor, keys), x), *x.shape, mode, censor), c)
    form = sum((F.col(f"c{i}") * F.col(f"c{j}") * float(m[i, j]) for i in range(len(m)) for j in range(len(m))), F.lit(0.0))
    stat = F.when(F.col("var") > 0, form / (F.col("var") * float(len(m)))).otherwise(0.0)
    return fit.select(*(keys or VOXEL), "var", stat.alias("stat"))


def detrend(df: DataFrame, x: np.ndarray) -> DataFrame:
    """Residuals as rows again."""
    res = residuals(betas(df, x), x)
    return res.select(*VOXEL, F.posexplode("es").alias("t", "v"))


def transform_data(df: DataFrame, m: np.ndarray) -> DataFrame:
    """Row mix: y' = M y."""
    packed = pack(df)
    return packed.select(*VOXEL, F.posexplode(F.array(*(dot(F.col("ys"), row) for row in m))).alias("t", "v"))


def map_series(df: DataFrame, f) -> DataFrame:
    """Each voxel's series through ``f``, which takes and gives an array in order of t."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                out = np.stack([f(np.asarray(ys, float)) for ys in pdf["ys"]])
                yield pd.DataFrame({**{k: np.repeat(pdf[k].to_numpy(), out.shape[1]) for k in VOXEL}, "t": np.tile(np.arange(out.shape[1], dtype=np.int32), len(out)), "v": out.ravel()})

    return pack(df).mapInPandas(run, "x int, y int, z int, t int, v double")


def unexplained(df: DataFrame, x: np.ndarray, b: DataFrame) -> DataFrame:
    """Rows of y - X b for betas (x, y, z, b0, ...) that come from elsewhere."""
    res = residuals(pack(df).join(b, VOXEL), x)
    return res.select(*VOXEL, F.posexplode("es").alias("t", "v"))


def estimate_ar(df: DataFrame, x: np.ndarray, times: int, iterations: int = 1, smooth=None, invalid: int = 4) -> DataFrame:
    """(x, y, z, a1..a4) of the errors.

    Each iteration takes the residuals of the data as they came, by betas of the
    whitened model (at first of the plain one), estimates the coefficients from them and smooths
    their maps if asked.
    """
    ar = None
    for _ in range(iterations):
        left = detrend(df, x) if ar is None else unexplained(df, x, voxel_betas(df, x, ar, invalid))
        ar = solve_ar(lag_products(left, times))
        if smooth is not None:
            ar = smooth(ar)
    return ar


def cochrane_orcutt(df: DataFrame, x: np.ndarray, c: np.ndarray, times: int, iterations: int = 1, smooth=None, invalid: int = 4) -> DataFrame:
    """First-level t-map with AR(4) errors: data and design are whitened by voxel and fitted without the first volumes."""
    ar = estimate_ar(df, x, times, iterations, smooth, invalid)
    return whitened_maps(df, x, np.atleast_2d(np.asarray(c, float)), ar, invalid).select(*VOXEL, F.col("c0").alias("cope"), F.col("t0").alias("stat"))


def _whitened(pdf: pd.DataFrame, x: np.ndarray, invalid: int) -> tuple[np.ndarray, np.ndarray]:
    """Series and designs of a batch, whitened by the voxels' own AR(4) coefficients, without the first volumes."""
    ys, a = np.array(pdf["ys"].tolist()), pdf[["a1", "a2", "a3", "a4"]].to_numpy(float)
    wy, wx = ys.copy(), np.repeat(x[None], len(ys), axis=0).astype(float)
    for k in range(1, 5):
        wy[:, k:] -= a[:, k - 1, None] * ys[:, :-k]
        wx[:, k:] -= a[:, k - 1, None, None] * x[None, :-k]
    return wy[:, invalid:], wx[:, invalid:]


def whitened_maps(df: DataFrame, x: np.ndarray, contrasts: np.ndarray, ar: DataFrame, invalid: int = 4) -> DataFrame:
    """(x, y, z, b0.., c0.., t0.., var, a1..a4): betas, contrasts, t and residual variance of data and design whitened by voxel."""
    r, n = x.shape[1], len(contrasts)
    names = [*(f"b{k}" for k in range(r)), *(f"c{k}" for k in range(n)), *(f"t{k}" for k in range(n)), "var", "a1", "a2", "a3", "a4"]

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            wy, wx = _whitened(pdf, x, invalid)
            inv = np.linalg.pinv(np.einsum("vtr,vts->vrs", wx, wx))
            b = np.einsum("vrs,vts,vt->vr", inv, wx, wy)
            e = wy - np.einsum("vtr,vr->vt", wx, b)
            e = e - e.sum(axis=1, keepdims=True) / e.shape[1]
            var = (e**2).sum(axis=1) / (e.shape[1] - 1)
            cope = b @ contrasts.T
            scale = var[:, None] * np.einsum("nr,vrs,ns->vn", contrasts, inv, contrasts)
            stat = np.where(scale > 0, cope / np.sqrt(np.where(scale > 0, scale, 1)), 0.0)
            table = np.column_stack([b, cope, stat, var, pdf[["a1", "a2", "a3", "a4"]].to_numpy(float)])
            yield pd.concat([pdf[VOXEL], pd.DataFrame(table, columns=names, index=pdf.index)], axis=1)

    return pack(df).join(ar, VOXEL).mapInPandas(run, "x int, y int, z int" + "".join(f", {k} double" for k in names))


#: What each choice of outputs writes: betas, contrasts and their t, or both.
OUTPUTS = {"betas": "b", "contrasts": "ct", "both": "bct"}


def select_outputs(maps: DataFrame, outputs: str = "both") -> DataFrame:
    """(x, y, z, map, v): the maps that a choice of :data:`OUTPUTS` asks for, one row a voxel and map."""
    kinds = OUTPUTS[outputs]
    wanted = [c for c in maps.columns if c[0] in kinds and c[1:].isdigit()]
    return maps.select(*VOXEL, F.inline(F.array(*(F.struct(F.lit(c).alias("map"), F.col(c).cast("double").alias("v")) for c in wanted))))


def voxel_betas(df: DataFrame, x: np.ndarray, ar: DataFrame, invalid: int = 4) -> DataFrame:
    """(x, y, z, b0, ...): betas of data and design whitened by the voxel's own AR coefficients, without the first volumes."""
    r = x.shape[1]

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            wy, wx = _whitened(pdf, x, invalid)
            b = np.einsum("vrt,vt->vr", np.linalg.pinv(wx), wy)
            yield pd.DataFrame({**{k: pdf[k] for k in VOXEL}, **{f"b{k}": b[:, k] for k in range(r)}})

    return pack(df).join(ar, VOXEL).mapInPandas(run, "x int, y int, z int" + "".join(f", b{k} double" for k in range(r)))
