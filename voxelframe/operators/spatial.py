"""Smoothing, resampling, cropping and clusters of volumes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import VOXEL


def gaussian(fwhm: float, voxel: float = 1.0, taps: int = 9) -> np.ndarray:
    s = fwhm / 2.354 / voxel
    x = np.arange(taps) - (taps - 1) / 2
    k = np.exp(-(x**2) / (2 * s**2))
    return k / k.sum()


def smooth_axis(df: DataFrame, axis: str, kernel: np.ndarray, keys: list[str], values: list[str]) -> DataFrame:
    """Zero-padded convolution along one axis of a dense grid: one window a line, no repeated rows."""
    w = Window.partitionBy(*(k for k in keys if k != axis)).orderBy(axis)
    half = len(kernel) // 2
    out = {}
    for v in values:
        total: Column = F.lit(0.0)
        for k, weight in enumerate(kernel):
            o = k - half
            at = F.col(v) if o == 0 else F.lag(v, o).over(w) if o > 0 else F.lead(v, -o).over(w)
            total = total + F.coalesce(at, F.lit(0.0)) * float(weight)
        out[v] = total
    return df.withColumns(out)


def smooth(df: DataFrame, kernel: np.ndarray, certainty: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Normalised separable smoothing in the order y, x, z: smoothed v * certainty over smoothed certainty, 0 where that is 0."""
    keys = keys or [*VOXEL, *(["t"] if "t" in df.columns else [])]
    if certainty is None:
        df = df.withColumn("m", F.lit(1.0))
    else:
        df = df.join(certainty, VOXEL, "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    df = df.select(*keys, (F.col("v") * F.col("m")).alias("v"), "m")
    for axis in ("y", "x", "z"):
        df = smooth_axis(df, axis, kernel, keys, ["v", "m"])
    return df.select(*keys, F.when(F.col("m") != 0, F.col("v") / F.col("m")).otherwise(0.0).alias("v"))


# ------------------------------------------------------------------ resampling


def smooth_maps(maps: DataFrame, names: list[str], kernel: np.ndarray, certainty: DataFrame) -> DataFrame:
    """Normalised smoothing of several maps (x, y, z, names) in one pass over the grid, all by one certainty m."""
    df = maps.join(certainty, VOXEL, "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    df = df.select(*VOXEL, *((F.col(n) * F.col("m")).alias(n) for n in names), "m")
    for axis in ("y", "x", "z"):
        df = smooth_axis(df, axis, kernel, VOXEL, [*names, "m"])
    return df.select(*VOXEL, *(F.when(F.col("m") != 0, F.col(n) / F.col("m")).otherwise(0.0).alias(n) for n in names))


def _clamp(c: Column, size: int) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(float(size - 1)))


def bspline(d: Column) -> list[Column]:
    """Weights of the four cubic B-spline taps at fraction d."""
    one = 1 - d
    return [one * one * one / 6, (4 + 3 * d * d * (d - 2)) / 6, (4 + 3 * one * one * (one - 2)) / 6, d * d * d / 6]


def gather(source: DataFrame, targets: DataFrame, size: tuple[int, int, int], mode: str = "linear", names: tuple[str, ...] = ("v",)) -> DataFrame:
    """Values of ``source``, one map or several, at fractional places (sx, sy, sz) of each target voxel; places are clamped to the edge.

    A target makes 1, 8 or 64 weighted taps, joined by cell and summed.
    """
    t = targets.select(*VOXEL, *(_clamp(F.col(f"s{k}"), n).alias(f"s{k}") for k, n in zip(VOXEL, size)))
    if mode == "nearest":
        rows = t.select(*VOXEL, *(F.floor(F.col(f"s{k}") + 0.5).cast("int").alias(f"i{k}") for k in VOXEL), F.lit(1.0).alias("w"))
    else:
        # One axis after the other: 2 or 4 taps each, so that the generated code stays small.
        rows = t
        for k, n in zip(VOXEL, size):
            d = F.col(f"s{k}") - F.floor(f"s{k}")
            taps = [(0, 1 - d), (1, d)] if mode == "linear" else list(zip((-1, 0, 1, 2), bspline(d)))
            cell = lambda o, k=k, n=n: F.least(F.greatest(F.floor(f"s{k}").cast("int") + o, F.lit(0)), F.lit(n - 1))
            rows = rows.select("*", F.inline(F.array(*(F.struct(cell(o).alias(f"i{k}"), w.alias(f"w{k}")) for o, w in taps))))
        rows = rows.select(*VOXEL, "ix", "iy", "iz", (F.col("wx") * F.col("wy") * F.col("wz")).alias("w"))
    src = source.select(*(F.col(k).alias(f"i{k}") for k in VOXEL), *names)
    return rows.join(src, ["ix", "iy", "iz"]).groupBy(*VOXEL).agg(*(F.sum(F.col(v) * F.col("w")).alias(v) for v in names))


def affine_places(cells: DataFrame, p, size: tuple[int, int, int]) -> DataFrame:
    """Source places of an affine of 12 parameters: v + t + P (v - centre); all 0 is the identity."""
    c = [(n - 1) / 2 for n in size]
    out = []
    for r, k in enumerate(VOXEL):
        move = sum((float(p[3 + 3 * r + j]) * (F.col(o) - c[j]) for j, o in enumerate(VOXEL)), F.lit(float(p[r])))
        out.append((F.col(k) + move).alias(f"s{k}"))
    return cells.select(*VOXEL, *out)


def field_places(field: DataFrame) -> DataFrame:
    return field.select(*VOXEL, *((F.col(k) + F.col(f"u{k}")).alias(f"s{k}") for k in VOXEL))


def registered_places(cells: DataFrame, p, size: tuple[int, int, int], field: DataFrame | None = None) -> DataFrame:
    """Source places of an affine followed, if given, by a displacement field (ux, uy, uz): the field names places in the affine's result."""
    if field is None:
        return affine_places(cells, p, size)
    moved = field_places(field)
    c = [(n - 1) / 2 for n in size]
    out = []
    for r, k in enumerate(VOXEL):
        move = sum((float(p[3 + 3 * r + j]) * (F.col(f"s{o}") - c[j]) for j, o in enumerate(VOXEL)), F.lit(float(p[r])))
        out.append((F.col(f"s{k}") + move).alias(f"s{k}"))
    return cells.join(moved, VOXEL).select(*VOXEL, *out)


def transform_results(maps: DataFrame, p, size: tuple[int, int, int], field: DataFrame | None = None, mode: str = "linear") -> DataFrame:
    """Result maps (x, y, z, and any number of columns) brought to the reference by one set of taps."""
    names = tuple(c for c in maps.columns if c not in VOXEL)
    return gather(maps, registered_places(maps.select(*VOXEL), p, size, field), size, mode, names)


def mask_original(df: DataFrame, mask: DataFrame, p, size: tuple[int, int, int]) -> DataFrame:
    """The input in its own space, kept where a mask of reference space, moved back by the inverse affine, is 1; 0 elsewhere."""
    from .registration import invert

    back = gather(mask.withColumnRenamed("m", "v"), affine_places(mask.select(*VOXEL), invert(p), size), size, "nearest")
    return df.join(back.withColumnRenamed("v", "m"), VOXEL).withColumn("v", F.when(F.col("m") == 1.0, F.col("v")).otherwise(0.0)).drop("m")


def scale_places(cells: DataFrame, ratio: tuple[float, float, float]) -> DataFrame:
    return cells.select(*VOXEL, *((F.col(k) * float(r)).alias(f"s{k}") for k, r in zip(VOXEL, ratio)))


def add_affine(field: DataFrame, p, size: tuple[int, int, int]) -> DataFrame:
    """A displacement field plus an affine's displacement."""
    c = [(n - 1) / 2 for n in size]
    move = [sum((float(p[3 + 3 * r + j]) * (F.col(o) - c[j]) for j, o in enumerate(VOXEL)), F.lit(float(p[r]))) for r in range(3)]
    return field.select(*VOXEL, *((F.col(f"u{k}") + move[r]).alias(f"u{k}") for r, k in enumerate(VOXEL)))


def fit_grid(df: DataFrame, size: tuple[int, int, int], to: tuple[int, int, int], z_cut: int = 0, z_bottom: bool = False) -> DataFrame:
    """Crop or pad, centred; ``z_bottom`` takes the whole difference, plus a cut, from the low slices."""
    off = [round((n - m) / 2 - 1e-9) for n, m in zip(size, to)]
    if z_bottom:
        off[2] = (size[2] - to[2]) + z_cut
    moved = df.select(*((F.col(k) - off[j]).cast("int").alias(k) for j, k in enumerate(VOXEL)), "v")
    for k, n in zip(VOXEL, to):
        moved = moved.where(F.col(k).between(0, n - 1))
    return moved


# ------------------------------------------------------------------ clusters


def _label(x, y, z):
    """Least memory index of each 26-connected component, by pointer jumping over the cells given."""
    size = (x.max() + 1, y.max() + 1, z.max() + 1)
    cell = x + y * size[0] + z * size[0] * size[1]
    order = np.argsort(cell)
    sorted_cells = cell[order]
    edges = []
    for dx, dy, dz in ((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (c, b, a) > (0, 0, 0)):
        nx, ny, nz = x + dx, y + dy, z + dz
        ok = (nx >= 0) & (nx < size[0]) & (ny >= 0) & (ny < size[1]) & (nz < size[2])
        n = nx + ny * size[0] + nz * size[0] * size[1]
        at = np.minimum(np.searchsorted(sorted_cells, n), len(order) - 1)
        hit = np.flatnonzero(ok & (sorted_cells[at] == n))
        edges.append(np.stack([hit, order[at[hit]]]))
    a, b = np.concatenate(edges, axis=1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    lab = rank.copy()
    while True:
        least = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[order[new]]  # follow the chain
        if (new == lab).all():
            return order[lab]
        lab = new


def clusters(df: DataFrame, level: float, width: int, height: int, keys: list[str] | None = None) -> DataFrame:
    """Voxels over ``level`` with ``cluster``: the least memory index of their 26-connected component. Each image (``keys``) is one group of at most a volume."""
    keys = keys or []
    over = df.where(F.col("v") > level).select(*keys, *VOXEL, "v")
    kinds = dict(over.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, *VOXEL, "v"]) + ", cluster long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, z = (pdf[k].to_numpy(np.int64) for k in VOXEL)
        head = _label(x, y, z)
        return pdf.assign(cluster=x[head] + y[head] * width + z[head] * width * height)

    return over.groupBy(*keys, *([] if keys else [F.lit(0).alias("one")])).applyInPandas(lambda pdf: run(pdf.drop(columns=["one"], errors="ignore")), schema)


def cluster_stats(labelled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Size and mass of each cluster."""
    return labelled.groupBy(*(keys or []), "cluster").agg(F.count("*").alias("size"), F.sum("v").alias("mass"))


def tfce(df: DataFrame, levels: list[float], width: int, height: int) -> DataFrame:
    """Sum over levels h of sqrt(extent) h**2, for each voxel over the lowest level. Every level is one image of its own, so levels are labelled side by side."""
    hs = F.array(*(F.lit(float(h)) for h in levels))
    images = df.select("*", F.explode(hs).alias("h")).where(F.col("v") > F.col("h"))
    lab = clusters(images, -float("inf"), width, height, ["h"])
    sized = lab.join(cluster_stats(lab, ["h"]).select("h", "cluster", "size"), ["h", "cluster"])
    return sized.groupBy(*VOXEL).agg(F.sum(F.sqrt("size") * F.col("h") * F.col("h")).alias("v"))


def centre_mass(df: DataFrame, size: tuple[int, int, int], mode: str = "linear") -> DataFrame:
    """The volume moved so that its centre of mass lies in the middle of the grid."""
    total = F.sum("v")
    centre = df.agg(*((F.sum(F.col(k) * F.col("v")) / total).alias(f"m{k}") for k in VOXEL))
    places = df.select(*VOXEL).join(F.broadcast(centre))  # one row
    return gather(df, places.select(*VOXEL, *((F.col(k) + F.col(f"m{k}") - (n - 1) / 2).alias(f"s{k}") for k, n in zip(VOXEL, size))), size, mode)
