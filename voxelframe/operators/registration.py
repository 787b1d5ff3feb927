"""Phase-based registration: quadrature filters, phase differences, normal equations, affine algebra, motion correction.

Filters are built here from published formulas (log-normal radial functions);
each volume of a series is one group, so series scale over volumes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import VOXEL


def quadrature_filters(size: int = 7, directions=((1, 0, 0), (0, 1, 0), (0, 0, 1)), centre: float = np.pi / 3, octaves: float = 2.0) -> np.ndarray:
    """Complex filters (direction, z, y, x) from log-normal radial functions over half spaces."""
    n = 4 * size + 1
    f = np.fft.fftshift(np.fft.fftfreq(n)) * 2 * np.pi
    w, v, u = np.meshgrid(f, f, f, indexing="ij")
    r = np.sqrt(u**2 + v**2 + w**2)
    r[r == 0] = 1e-9
    radial = np.exp(-4 / np.log(2) / octaves**2 * np.log(r / centre) ** 2)
    out = []
    for d in np.asarray(directions, float):
        d = d / np.linalg.norm(d)
        cos = (u * d[0] + v * d[1] + w * d[2]) / r
        k = np.fft.fftshift(np.fft.ifftn(np.fft.ifftshift(radial * np.where(cos > 0, cos**2, 0))))
        h = (n - size) // 2
        out.append(k[h : h + size, h : h + size, h : h + size])
    return np.stack(out)


def filter_volume(vol: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Zero-padded 'same' convolution of (z, y, x) with each filter."""
    shape = [a + b - 1 for a, b in zip(vol.shape, filters.shape[1:])]
    spec = np.fft.fftn(vol, shape, (0, 1, 2))
    h = [k // 2 for k in filters.shape[1:]]
    out = []
    for f in filters:
        full = np.fft.ifftn(spec * np.fft.fftn(f, shape, (0, 1, 2)))
        out.append(full[h[0] : h[0] + vol.shape[0], h[1] : h[1] + vol.shape[1], h[2] : h[2] + vol.shape[2]])
    return np.stack(out)


# ------------------------------------------------------------------ relational steps over (re1, im1, re2, im2)


def phase(re1="re1", im1="im1", re2="re2", im2="im2") -> tuple[Column, Column]:
    """(difference, certainty) of two filter responses."""
    a, b, c, d = (F.col(k) for k in (re1, im1, re2, im2))
    re, im = a * c + b * d, b * c - a * d
    diff = F.atan2(im, re)
    return diff, F.hypot(re, im) * F.cos(diff / 2) ** 2


def phase_gradient(df: DataFrame, axis: str) -> DataFrame:
    """Angle of the summed products of neighbours along ``axis`` in both volumes; only where both neighbours exist."""
    w = Window.partitionBy(*(k for k in VOXEL if k != axis)).orderBy(axis)
    re, im = F.lit(0.0), F.lit(0.0)
    for k in ("1", "2"):
        a, b = F.col(f"re{k}"), F.col(f"im{k}")
        na, nb = F.lead(f"re{k}").over(w), F.lead(f"im{k}").over(w)
        pa, pb = F.lag(f"re{k}").over(w), F.lag(f"im{k}").over(w)
        re = re + na * a + nb * b + a * pa + b * pb
        im = im + nb * a - na * b + b * pa - a * pb
    return df.select(*VOXEL, F.atan2(im, re).alias("g")).where("g is not null")


def normal_equations(df: DataFrame) -> DataFrame:
    """One row of the distinct sums for A and h over rows (x, y, z centred; axis 0-2; g, d, c): c g g q and c g d l for monomials of each axis."""
    sums = []
    lin = {"1": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "z": F.col("z")}
    quad = {"1": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "z": F.col("z"), "xx": F.col("x") ** 2, "xy": F.col("x") * F.col("y"), "xz": F.col("x") * F.col("z"), "yy": F.col("y") ** 2, "yz": F.col("y") * F.col("z"), "zz": F.col("z") ** 2}
    for axis in range(3):
        on = F.when(F.col("axis") == axis, F.col("c")).otherwise(0.0)
        sums += [F.sum(on * F.col("g") * F.col("g") * q).alias(f"a{axis}_{k}") for k, q in quad.items()]
        sums += [F.sum(on * F.col("g") * F.col("d") * q).alias(f"h{axis}_{k}") for k, q in lin.items()]
    return df.agg(*sums)


def solve_affine(row) -> np.ndarray:
    """12 parameters from the sums of :func:`normal_equations`."""
    a, h = np.zeros((12, 12)), np.zeros(12)
    names = ["1", "x", "y", "z"]
    pair = lambda i, j: "".join(sorted(k for k in (names[i], names[j]) if k != "1")) or "1"
    for axis in range(3):
        place = [axis, 3 + 3 * axis, 4 + 3 * axis, 5 + 3 * axis]
        for i in range(4):
            h[place[i]] = row[f"h{axis}_{names[i]}"]
            for j in range(4):
                a[place[i], place[j]] = row[f"a{axis}_{pair(i, j)}"]
    return solve_system(a, h)


def solve_system(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The least solution of A p = h: directions that the filters don't see stay 0."""
    return np.linalg.lstsq(a, h, rcond=1e-9)[0]


def tensor_norm() -> Column:
    s = lambda k: F.col(k) * F.col(k)
    return F.sqrt(s("t11") + s("t22") + s("t33") + 2 * (s("t12") + s("t13") + s("t23")))


def displacement_update() -> tuple[Column, Column, Column]:
    """Solution of a symmetric 3 x 3 system (a11..a33) u = (h1, h2, h3) by cofactors; 0 for a singular one."""
    a, b, c, d, e, f = (F.col(k) for k in ("a11", "a12", "a13", "a22", "a23", "a33"))
    h1, h2, h3 = F.col("h1"), F.col("h2"), F.col("h3")
    m11, m12, m13 = d * f - e * e, c * e - b * f, b * e - c * d
    m22, m23, m33 = a * f - c * c, b * c - a * e, a * d - b * b
    det = a * m11 + b * m12 + c * m13
    safe = F.when(F.abs(det) > 1e-12, det)
    solve = lambda p, q, r: F.coalesce((p * h1 + q * h2 + r * h3) / safe, F.lit(0.0))
    return solve(m11, m12, m13), solve(m12, m22, m23), solve(m13, m23, m33)


# ------------------------------------------------------------------ affine algebra on the driver


def to_matrix(p) -> np.ndarray:
    m = np.eye(4)
    m[:3, :3] += np.asarray(p[3:], float).reshape(3, 3)
    m[:3, 3] = p[:3]
    return m


def from_matrix(m: np.ndarray) -> np.ndarray:
    return np.concatenate([m[:3, 3], (m[:3, :3] - np.eye(3)).ravel()])


def compose(p, q) -> np.ndarray:
    return from_matrix(to_matrix(p) @ to_matrix(q))


def invert(p) -> np.ndarray:
    return from_matrix(np.linalg.inv(to_matrix(p)))


def next_scale(p) -> np.ndarray:
    out = np.asarray(p, float).copy()
    out[:3] *= 2
    return out


def rigid(p) -> np.ndarray:
    """The nearest rotation in place of the linear part."""
    m = to_matrix(p)
    u, _, vt = np.linalg.svd(m[:3, :3])
    m[:3, :3] = u @ vt
    return from_matrix(m)


def rotations(p) -> np.ndarray:
    """Angles in degrees about x, y and z."""
    r = to_matrix(p)[:3, :3]
    return np.degrees([np.arctan2(r[2, 1], r[2, 2]), np.arctan2(-r[2, 0], np.hypot(r[2, 1], r[2, 2])), np.arctan2(r[1, 0], r[0, 0])])


def resample(vol: np.ndarray, p) -> np.ndarray:
    """Trilinear values of (z, y, x) at the places of an affine; the edge repeats."""
    z, y, x = np.meshgrid(*(np.arange(n, dtype=float) for n in vol.shape), indexing="ij")
    c = [(n - 1) / 2 for n in vol.shape[::-1]]
    m = np.asarray(p[3:], float).reshape(3, 3)
    d = [x - c[0], y - c[1], z - c[2]]
    s = [g + p[r] + sum(m[r, j] * d[j] for j in range(3)) for r, g in enumerate((x, y, z))]
    s = [np.clip(g, 0, n - 1) for g, n in zip(s, vol.shape[::-1])]
    i = [np.minimum(np.floor(g).astype(int), max(n - 2, 0)) for g, n in zip(s, vol.shape[::-1])]
    f = [g - k for g, k in zip(s, i)]
    out = np.zeros_like(vol, float)
    for a in (0, 1):
        for b in (0, 1):
            for e in (0, 1):
                w = (f[0] if a else 1 - f[0]) * (f[1] if b else 1 - f[1]) * (f[2] if e else 1 - f[2])
                out += w * vol[np.minimum(i[2] + e, vol.shape[0] - 1), np.minimum(i[1] + b, vol.shape[1] - 1), np.minimum(i[0] + a, vol.shape[2] - 1)]
    return out


def align(moving: np.ndarray, fixed: np.ndarray, filters: np.ndarray, iterations: int = 5, kind: str = "rigid") -> np.ndarray:
    """Affine parameters that bring ``moving`` to ``fixed``."""
    p, q1 = np.zeros(12), filter_volume(fixed, filters)
    margin = (filters.shape[1] - 1) // 2
    m = [min(margin, (n - 1) // 3) for n in fixed.shape]
    core = tuple(slice(k, n - k) for k, n in zip(m, fixed.shape))
    z, y, x = np.meshgrid(*(np.arange(n) - (n - 1) / 2 for n in fixed.shape), indexing="ij")
    base = [g[core].ravel() for g in (np.ones_like(x), x, y, z)]
    for _ in range(iterations):
        q2 = filter_volume(resample(moving, p), filters)
        a, h = np.zeros((12, 12)), np.zeros(12)
        for axis, dim in enumerate((2, 1, 0)):
            prod = q1[axis] * np.conj(q2[axis])
            diff = np.angle(prod)
            cert = np.abs(prod) * np.cos(diff / 2) ** 2
            grad = np.zeros(fixed.shape, complex)
            for q in (q1[axis], q2[axis]):
                ahead, here = np.moveaxis(q, dim, 0)[1:], np.moveaxis(q, dim, 0)[:-1]
                step = ahead * np.conj(here)
                view = np.moveaxis(grad, dim, 0)
                view[1:] += step
                view[:-1] += step
            g, d, c = np.angle(grad)[core].ravel(), diff[core].ravel(), cert[core].ravel()
            rows = np.stack([b * g for b in base])
            place = [axis, 3 + 3 * axis, 4 + 3 * axis, 5 + 3 * axis]
            a[np.ix_(place, place)] += (rows * c) @ rows.T
            h[place] += (rows * c) @ d
        step = solve_system(a, h)
        if kind == "translation":
            step[3:] = 0
        p = p + step
        if kind == "rigid":
            p = rigid(p)
    return p


def motion_correct(df: DataFrame, size: tuple[int, int, int], reference: DataFrame | None = None, iterations: int = 5, filter_size: int = 7) -> DataFrame:
    """(t, x, y, z, v, p0..p5): every volume rigidly aligned to the reference (volume 0), with its translations and rotations; volumes are independent groups."""
    ref = (reference if reference is not None else df.where("t = 0")).select(*VOXEL, "v").toPandas()  # one volume: bounded
    fixed = np.zeros(size[::-1])
    fixed[ref["z"], ref["y"], ref["x"]] = ref["v"]
    filters = quadrature_filters(filter_size)
    shared, known = df.sparkSession.sparkContext.broadcast((fixed, filters)), reference is not None  # one volume and its filters
    schema = "t int, x int, y int, z int, v double" + "".join(f", p{k} double" for k in range(6))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vol = np.zeros(size[::-1])
        vol[pdf["z"], pdf["y"], pdf["x"]] = pdf["v"]
        same = not known and int(pdf["t"].iloc[0]) == 0
        fixed, filters = shared.value
        p = np.zeros(12) if same else align(vol, fixed, filters, iterations)
        out = vol if same else resample(vol, p)
        z, y, x = (g.ravel().astype(np.int32) for g in np.meshgrid(*(np.arange(n) for n in size[::-1]), indexing="ij"))
        moves = [*p[:3], *rotations(p)]
        return pd.DataFrame({"t": np.int32(pdf["t"].iloc[0]), "x": x, "y": y, "z": z, "v": out.ravel(), **{f"p{k}": float(m) for k, m in enumerate(moves)}})

    return df.groupBy("t").applyInPandas(run, schema)


def motion_lines(p) -> str:
    """One line of the parameter file: columns 4, -3, 5, -2, -0, -1."""
    return " ".join(f"{s * p[k]:.6f}" for s, k in ((1, 4), (-1, 3), (1, 5), (-1, 2), (-1, 0), (-1, 1)))


def scaling(factors) -> np.ndarray:
    """Affine parameters that magnify by ``factors``: source places shrink by their inverse."""
    return from_matrix(np.diag([*(1 / np.asarray(factors, float)), 1.0]))


# ------------------------------------------------------------------ filtering and structure tensors

_G = (1 + 5**0.5) / 2
#: Six directions through the vertices of an icosahedron.
SIX = np.array([(1, 0, _G), (-1, 0, _G), (_G, 1, 0), (_G, -1, 0), (0, _G, 1), (0, _G, -1)]) / np.sqrt(1 + _G**2)


def projection_tensors(directions=SIX) -> np.ndarray:
    """(filter, 3, 3): the dual tensors 5/4 n n' - 1/4 I."""
    n = np.asarray(directions, float)
    return 1.25 * n[:, :, None] * n[:, None, :] - 0.25 * np.eye(3)


def filter_series(df: DataFrame, size: tuple[int, int, int], filters: np.ndarray) -> DataFrame:
    """(t, x, y, z, f, re, im): every volume's responses; a volume is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vol = np.zeros(size[::-1])
        vol[pdf["z"], pdf["y"], pdf["x"]] = pdf["v"]
        q = filter_volume(vol, filters)
        f, z, y, x = (g.ravel().astype(np.int32) for g in np.meshgrid(*(np.arange(n) for n in q.shape), indexing="ij"))
        return pd.DataFrame({"t": np.int32(pdf["t"].iloc[0]), "x": x, "y": y, "z": z, "f": f, "re": q.real.ravel(), "im": q.imag.ravel()})

    return df.groupBy("t").applyInPandas(run, "t int, x int, y int, z int, f int, re double, im double")


_PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def _table(values: np.ndarray) -> Column:
    """A constant for each filter, picked by column f."""
    return F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("f") + 1)


def structure_tensor(responses: DataFrame, directions=SIX) -> DataFrame:
    """(t, x, y, z, t11 .. t33): magnitudes times projection tensors, summed over filters."""
    m = projection_tensors(directions)
    size = F.hypot("re", "im")
    return responses.groupBy("t", *VOXEL).agg(*(F.sum(size * _table(m[:, i, j])).alias(f"t{i + 1}{j + 1}") for i, j in _PAIRS))


def field_equations(pairs: DataFrame, directions=SIX) -> DataFrame:
    """(x, y, z, a11 .. a33, h1 .. h3) over rows (x, y, z, f, re1, im1, re2, im2, t11 .. t33): sums over filters of c T T and c d T T n."""
    n = np.asarray(directions, float)
    re, im = F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2"), F.col("im1") * F.col("re2") - F.col("re1") * F.col("im2")
    rows = pairs.withColumn("d", F.atan2(im, re)).withColumn("c", F.sqrt(F.hypot(re, im)) * F.cos(F.col("d") / 2) ** 2)
    t = lambda i, j: F.col(f"t{min(i, j) + 1}{max(i, j) + 1}")
    square = {(i, j): t(i, 0) * t(0, j) + t(i, 1) * t(1, j) + t(i, 2) * t(2, j) for i in range(3) for j in range(3)}
    a = [F.sum(F.col("c") * square[i, j]).alias(f"a{i + 1}{j + 1}") for i, j in _PAIRS]
    h = [F.sum(F.col("c") * F.col("d") * sum(square[i, j] * _table(n[:, j]) for j in range(3))).alias(f"h{i + 1}") for i in range(3)]
    return rows.groupBy(*VOXEL).agg(*a, *h)


# ------------------------------------------------------------------ several scales


def shrink(vol: np.ndarray, times: int) -> np.ndarray:
    """Halved ``times`` times: means of 2 x 2 x 2 cells, the edge repeated where a size is odd."""
    for _ in range(times):
        vol = np.pad(vol, [(0, n % 2) for n in vol.shape], mode="edge")
        vol = vol.reshape(vol.shape[0] // 2, 2, vol.shape[1] // 2, 2, vol.shape[2] // 2, 2).mean(axis=(1, 3, 5))
    return vol


def align_scales(moving: np.ndarray, fixed: np.ndarray, filters: np.ndarray, scales: int = 3, iterations: int = 10, kind: str = "affine") -> np.ndarray:
    """Affine parameters from the coarsest of ``scales`` (each half the next) to the full grid."""
    p = np.zeros(12)
    for k in range(scales - 1, -1, -1):
        small, target = shrink(moving, k), shrink(fixed, k)
        if min(target.shape) >= 2:
            p = compose(p, align(resample(small, p), target, filters, iterations, kind))
        if k:
            p = next_scale(p)
    return rigid(p) if kind == "rigid" else p


def warp(vol: np.ndarray, field: np.ndarray) -> np.ndarray:
    """Trilinear values of (z, y, x) at v + u(v); field: (3, z, y, x) of x, y and z displacements; the edge repeats."""
    z, y, x = np.meshgrid(*(np.arange(n, dtype=float) for n in vol.shape), indexing="ij")
    s = [np.clip(g + u, 0, n - 1) for g, u, n in zip((x, y, z), field, vol.shape[::-1])]
    i = [np.minimum(np.floor(g).astype(int), max(n - 2, 0)) for g, n in zip(s, vol.shape[::-1])]
    f = [g - k for g, k in zip(s, i)]
    out = np.zeros(vol.shape)
    for o in np.ndindex(2, 2, 2):
        w = np.prod([f[k] if o[k] else 1 - f[k] for k in range(3)], axis=0)
        at = [np.minimum(i[k] + o[k], n - 1) for k, n in enumerate(vol.shape[::-1])]
        out += w * vol[at[2], at[1], at[0]]
    return out


def blur(vol: np.ndarray, sigma: float) -> np.ndarray:
    """Normalised Gaussian smoothing of the last three axes."""
    for axis in (-3, -2, -1):
        n = vol.shape[axis]
        k = np.exp(-(np.subtract.outer(np.arange(n), np.arange(n)) ** 2) / (2 * sigma**2))
        vol = np.moveaxis(np.moveaxis(vol, axis, -1) @ (k / k.sum(axis=1, keepdims=True)).T, -1, axis)
    return vol


def align_field(moving: np.ndarray, fixed: np.ndarray, filters: np.ndarray, directions=SIX, scales: int = 2, iterations: int = 5, sigma: float = 5.0) -> np.ndarray:
    """Displacements (3, z, y, x) that bring ``moving`` to ``fixed``: tensor-weighted phase differences, Gaussian-regularised, coarse to fine."""
    n, m = np.asarray(directions, float), projection_tensors(directions)
    field = None
    for k in range(scales - 1, -1, -1):
        small, target = shrink(moving, k), shrink(fixed, k)
        if field is None:
            field = np.zeros((3, *target.shape))
        else:
            up = [np.minimum(np.arange(s) // 2, f - 1) for s, f in zip(target.shape, field.shape[1:])]
            field = 2 * field[np.ix_(range(3), *up)]
        q1 = filter_volume(target, filters)
        for _ in range(iterations):
            q2 = filter_volume(warp(small, field), filters)
            t = blur(np.einsum("fzyx,fij->ijzyx", np.abs(q2), m), 1.0)
            t = t / max(np.sqrt((t**2).sum(axis=(0, 1))).max(), 1e-12)
            square = np.einsum("ikzyx,kjzyx->ijzyx", t, t)
            prod = q1 * np.conj(q2)
            diff = np.angle(prod)
            c = np.sqrt(np.abs(prod)) * np.cos(diff / 2) ** 2
            a = blur(np.einsum("fzyx,ijzyx->ijzyx", c, square), sigma)
            h = blur(np.einsum("fzyx,fzyx,ijzyx,fj->izyx", c, diff, square, n), sigma)
            a = np.moveaxis(a, (0, 1), (-2, -1))
            a = a + np.eye(3) * (1e-3 * np.trace(a, axis1=-2, axis2=-1)[..., None, None] + 1e-12)
            field = field + blur(np.moveaxis(np.linalg.solve(a, np.moveaxis(h, 0, -1)[..., None])[..., 0], -1, 0), sigma / 5)
    return field


def register_images(df: DataFrame, reference: DataFrame, size: tuple[int, int, int], linear: bool = True, scales: int = 3, iterations: int = 10, field_iterations: int = 5, filter_size: int = 7, sigma: float = 5.0) -> DataFrame:
    """(t, x, y, z, v, ux, uy, uz): every image t brought to one reference, first by an affine, then by a displacement field; images are independent groups."""
    ref = reference.select(*VOXEL, "v").toPandas()  # one volume: bounded
    fixed = np.zeros(size[::-1])
    fixed[ref["z"], ref["y"], ref["x"]] = ref["v"]
    shared = df.sparkSession.sparkContext.broadcast((fixed, quadrature_filters(filter_size), quadrature_filters(filter_size, SIX)))  # one volume

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fixed, three, six = shared.value
        vol = np.zeros(size[::-1])
        vol[pdf["z"], pdf["y"], pdf["x"]] = pdf["v"]
        z, y, x = np.meshgrid(*(np.arange(n) for n in size[::-1]), indexing="ij")
        p = align_scales(vol, fixed, three, scales, iterations) if linear else np.zeros(12)
        u = align_field(resample(vol, p), fixed, six, SIX, min(scales, 2), field_iterations, sigma) if field_iterations else np.zeros((3, *vol.shape))
        # One displacement for both steps: the affine at the places that the field names.
        c, mat = [(n - 1) / 2 for n in size], np.asarray(p[3:]).reshape(3, 3)
        s = [g + d for g, d in zip((x, y, z), u)]
        total = np.stack([u[r] + p[r] + sum(mat[r, j] * (s[j] - c[j]) for j in range(3)) for r in range(3)])
        out = warp(vol, total)
        return pd.DataFrame({"t": np.int32(pdf["t"].iloc[0]), **{k: g.ravel().astype(np.int32) for k, g in zip("xyz", (x, y, z))}, "v": out.ravel(), **{f"u{k}": total[r].ravel() for r, k in enumerate("xyz")}})

    return df.groupBy("t").applyInPandas(run, "t int, x int, y int, z int, v double, ux double, uy double, uz double")


# ------------------------------------------------------------------ functional to anatomical


def to_grid(vol: np.ndarray, voxel, target_voxel, target_shape) -> np.ndarray:
    """(z, y, x) resampled to another voxel size and cropped or padded, centred, to another grid."""
    ratio = np.asarray(target_voxel, float)[::-1] / np.asarray(voxel, float)[::-1]
    places = [np.clip((np.arange(n) - (n - 1) / 2) * k + (m - 1) / 2, -1, m) for n, k, m in zip(target_shape, ratio, vol.shape)]
    inside = [(g >= -0.5) & (g <= m - 0.5) for g, m in zip(places, vol.shape)]
    out = vol
    for axis, g in enumerate(places):
        g = np.clip(g, 0, vol.shape[axis] - 1)
        i = np.minimum(np.floor(g).astype(int), max(vol.shape[axis] - 2, 0))
        f = (g - i).reshape([-1 if a == axis else 1 for a in range(3)])
        out = np.take(out, i, axis) * (1 - f) + np.take(out, np.minimum(i + 1, vol.shape[axis] - 1), axis) * f
    return out * inside[0][:, None, None] * inside[1][None, :, None] * inside[2][None, None, :]


def segment(vol: np.ndarray, share: float = 0.9) -> np.ndarray:
    """The head alone: voxels over ``share`` of the mean."""
    return np.where(vol > share * vol.mean(), vol, 0.0)


def tensor_size(vol: np.ndarray, filters: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Norm of the smoothed local structure tensor: the same edges whatever the contrast."""
    q = filter_volume(vol, filters)
    t = blur(np.einsum("fzyx,fij->ijzyx", np.abs(q), projection_tensors()), sigma)
    return np.sqrt((t**2).sum(axis=(0, 1)))


def epi_to_t1(epi: np.ndarray, t1: np.ndarray, epi_voxel, t1_voxel, filter_size: int = 7, scales: int = 2, iterations: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, aligned volume): a functional volume brought to an anatomical one.

    The functional volume is segmented and brought to the anatomical grid. Contrasts
    differ, so all alignments work on tensor magnitudes: a translation first, then a rigid
    motion, then an affine whose rotation is kept.
    """
    three, six = quadrature_filters(filter_size), quadrature_filters(filter_size, SIX)
    start = to_grid(segment(epi), epi_voxel, t1_voxel, t1.shape)
    fixed, moving = tensor_size(t1, six), tensor_size(start, six)
    fixed, moving = fixed / max(fixed.max(), 1e-12), moving / max(moving.max(), 1e-12)
    p = np.zeros(12)
    for kind in ("translation", "rigid", "affine"):
        p = compose(p, align_scales(resample(moving, p), fixed, three, scales, iterations, kind))
    p = rigid(p)
    return p, resample(start, p)
