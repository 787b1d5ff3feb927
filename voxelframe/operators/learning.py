"""Searchlight classification, principal and independent components, Gibbs sampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import VOXEL

CENSORED = 9999
#: The voxel, its faces' and its edges' neighbours.
NEIGHBOURS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if abs(a) + abs(b) + abs(c) <= 2]


def searchlight(packed: DataFrame, classes: list[int], size: tuple[int, int, int], rate: float = 0.01, epochs: int = 20) -> DataFrame:
    """(x, y, z, accuracy): leave-one-out accuracy of a linear unit on each voxel's 19 series; 0 on the border. ``packed``: (x, y, z, ys), dense."""
    inner = packed
    for k, n in zip(VOXEL, size):
        inner = inner.where(F.col(k).between(1, n - 2))
    offsets = F.array(*(F.struct(*(F.lit(o).alias(f"d{k}") for k, o in zip(VOXEL, off)), F.lit(i).alias("i")) for i, off in enumerate(NEIGHBOURS)))
    taps = inner.select(*VOXEL, F.inline(offsets)).select(*VOXEL, "i", *((F.col(k) + F.col(f"d{k}")).alias(f"n{k}") for k in VOXEL))
    near = packed.select(*(F.col(k).alias(f"n{k}") for k in VOXEL), "ys")
    features = taps.join(near, ["nx", "ny", "nz"]).groupBy(*VOXEL).agg(F.sort_array(F.collect_list(F.struct("i", "ys"))).alias("f"))
    y = np.array(classes)
    use = np.flatnonzero(y != CENSORED)
    d = np.where(y[use] == 0, 1.0, -1.0)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array([[e["ys"] for e in f] for f in pdf["f"]])[:, :, use]
            x = np.concatenate([x, np.ones((len(x), 1, len(use)))], axis=1)
            right = np.zeros(len(x))
            for out in range(len(use)):
                train = np.delete(np.arange(len(use)), out)
                w = np.zeros(x.shape[:2])
                for _ in range(epochs):
                    err = np.einsum("vft,vf->vt", x[:, :, train], w) - d[train]
                    w -= rate / len(use) * np.einsum("vft,vt->vf", x[:, :, train], err)
                right += (np.einsum("vf,vf->v", x[:, :, out], w) > 0) == (d[out] > 0)
            yield pd.DataFrame({**{k: pdf[k] for k in VOXEL}, "accuracy": right / len(use)})

    inside = features.mapInPandas(run, "x int, y int, z int, accuracy double")
    return packed.select(*VOXEL).join(inside, VOXEL, "left").select(*VOXEL, F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def _sum_arrays(parts: DataFrame) -> np.ndarray:
    """Sum of arrays ``a``, one a task, element by element."""
    rows = parts.select(F.posexplode("a").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["k"])])


def gram(vectors: DataFrame, column: str = "f") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of array rows: partial sums by batch, one small matrix a task."""

    def run(batches):
        n, s, g = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf[column].tolist(), float)
                n, s, g = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    parts = vectors.select(column).mapInPandas(run, "n long, s array<double>, g array<double>")
    sums = _sum_arrays(parts.select(F.concat(F.array(F.col("n").cast("double")), "s", "g").alias("a")))
    if not len(sums):
        return 0, np.zeros(0), np.zeros((0, 0))
    # 1 + k + k * k numbers for k components.
    k = (math.isqrt(4 * len(sums) - 3) - 1) // 2
    total, s, g = int(sums[0]), sums[1 : k + 1], sums[k + 1 :].reshape(k, k)
    mean = s / total
    return total, mean, (g - total * np.outer(mean, mean)) / max(total - 1, 1)


def pca(vectors: DataFrame, share: float = 0.8, column: str = "f") -> dict:
    """Components that hold ``share`` of the variance: mean, values, rows of ``components`` and the ``whiten`` matrix."""
    n, mean, cov = gram(vectors, column)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12)) + 1
    axes = axes[:, :k] * np.where(axes[np.abs(axes[:, :k]).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    return {"n": n, "mean": mean, "values": values[:k], "components": axes.T, "whiten": axes.T / np.sqrt(values[:k])[:, None], "share": float(values[:k].sum() / values.sum())}


def project(vectors: DataFrame, matrix: np.ndarray, mean: np.ndarray, keys: list[str], column: str = "f", out: str = "s") -> DataFrame:
    kinds = dict(vectors.dtypes)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf[column].tolist(), float)
                yield pdf[keys].assign(**{out: list((x - mean) @ matrix.T)})

    return vectors.select(*keys, column).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {out} array<double>")


def infomax_rows(whitened: DataFrame, k: int, column: str = "s", steps: int = 256, rate: float = 0.1, stop: float = 1e-4) -> np.ndarray:
    """Unmixing matrix of whitened rows of length ``k``, however many: every step's natural gradient is a sum over all rows, k * k numbers a task."""
    w, b = np.eye(k), np.zeros((k, 1))
    rows = whitened.select(column).persist()
    try:
        n = rows.count()
        for _ in range(steps if n else 0):

            def run(batches, w=w, b=b):
                g, m = np.zeros((k, k)), np.zeros(k)
                for pdf in batches:
                    if len(pdf):
                        u = w @ np.array(pdf[column].tolist(), float).T + b
                        y = 1 - 2 / (1 + np.exp(-np.clip(u, -500, 500)))
                        g, m = g + y @ u.T, m + y.sum(axis=1)
                yield pd.DataFrame({"a": [[*g.ravel().tolist(), *m.tolist()]]})

            sums = _sum_arrays(rows.mapInPandas(run, "a array<double>"))
            step = rate * (np.eye(k) + sums[: k * k].reshape(k, k) / n) @ w
            w, b = w + step, b + rate * sums[k * k :, None] / n
            if np.abs(step).max() < stop:
                break
    finally:
        rows.unpersist()
    return w


def infomax(x: np.ndarray, seed: int = 0, steps: int = 512, stop: float = 1e-6) -> np.ndarray:
    """Unmixing matrix of whitened rows x (k x n) by block updates with an annealed rate."""
    k, n = x.shape
    w, b, rate = np.eye(k), np.zeros((k, 1)), 0.005 / max(np.log(k), 0.1)
    block, rng = max(1, int(np.sqrt(n / 3))), np.random.default_rng(seed)
    old_step, old = None, w.copy()
    for _ in range(steps):
        order = rng.permutation(n)
        for at in range(0, n - block + 1, block):
            u = w @ x[:, order[at : at + block]] + b
            y = 1 - 2 / (1 + np.exp(-np.clip(u, -500, 500)))
            w = w + rate * (block * np.eye(k) + y @ u.T) @ w
            b = b + rate * y.sum(axis=1, keepdims=True)
            if np.abs(w).max() > 1e8:
                w, b, rate, old, old_step = np.eye(k), np.zeros((k, 1)), rate * 0.8, np.eye(k), None
                break
        else:
            step = w - old
            change = float((step**2).sum())
            if change <= stop:
                break
            if old_step is not None:
                cos = (step * old_step).sum() / max(np.sqrt(change * (old_step**2).sum()), 1e-300)
                if np.degrees(np.arccos(np.clip(cos, -1, 1))) > 60:
                    rate *= 0.9
            old_step, old = step, w.copy()
    return w


def _bits(voxel: np.ndarray, step: int, lane: int, seed: int) -> np.ndarray:
    """64 bits for each (voxel, step, lane): a counter through the splitmix finaliser, so a draw depends on nothing else."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = voxel * u(0x9E3779B97F4A7C15) + u(((seed * 1_000_003 + step) * 4096 + lane) % (1 << 64)) * u(0xD1342543DE82EF95)
        x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))


class Draws:
    """Uniforms, normals and gammas of many voxels at a time; each call takes the next lanes of a step."""

    def __init__(self, voxel: np.ndarray, seed: int):
        self.voxel, self.seed, self.step, self.lane = voxel.astype(np.uint64), seed, 0, 0

    def next_step(self) -> None:
        self.step, self.lane = self.step + 1, 0

    def lanes_from(self, lane: int) -> None:
        """Each kind of draw has lanes of its own: how often one rejects moves no other."""
        self.lane = lane

    def uniform(self) -> np.ndarray:
        self.lane += 1
        return ((_bits(self.voxel, self.step, self.lane, self.seed) >> np.uint64(11)).astype(float) + 0.5) / 2**53

    def normal(self) -> np.ndarray:
        from ..functions.stats import box_muller

        return box_muller(self.uniform(), self.uniform())

    def gamma(self, shape: float) -> np.ndarray:
        """Marsaglia and Tsang's squeeze for a shape over 1; voxels that reject draw again."""
        d = shape - 1 / 3
        out, left = np.full(len(self.voxel), d), np.ones(len(self.voxel), bool)
        for _ in range(64):
            n, u = self.normal(), self.uniform()
            v = (1 + n / np.sqrt(9 * d)) ** 3
            safe = np.where(v > 0, v, 1.0)
            good = left & (v > 0) & (np.log(u) < n * n / 2 + d - d * safe + d * np.log(safe))
            out[good] = (d * safe)[good]
            left &= ~good
            if not left.any():
                break
        return out


def gibbs(packed: DataFrame, x: np.ndarray, draws: int = 1000, burn: int = 100, seed: int = 1, tau: float = 1000.0, a0: float = 0.01, b0: float = 0.01) -> DataFrame:
    """Two-regressor model with AR(1) errors, by voxel: shares of draws with b1 > 0, b2 > 0, b1 < 0, b2 < 0, b1 > b2, b2 > b1, and the last draw.

    All voxels of a batch are drawn together, in closed form. Draws depend on the
    voxel and the seed only, not on the batch.
    """
    if x.shape[1] != 2:
        raise ValueError("two regressors are needed")

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            y = np.array(pdf["ys"].tolist(), float)
            vx, vy, vz = (pdf[k].to_numpy(np.int64) for k in VOXEL)
            rng = Draws((vx << 42) ^ (vy << 21) ^ vz, seed)
            n = y.shape[1]
            # Sums that whitening by rho needs: of lag 0 at either end, and of lag 1.
            xa, xb, ya, yb = x[1:], x[:-1], y[:, 1:], y[:, :-1]
            xx = [xa.T @ xa, xa.T @ xb + xb.T @ xa, xb.T @ xb]
            dot = lambda p, q: (p[:, :, None] * q).sum(axis=1)  # noqa: E731  row by row, so that no batch rounds otherwise
            xy = [dot(ya, xa), dot(ya, xb) + dot(yb, xa), dot(yb, xb)]
            rho, beta, s2 = np.zeros(len(y)), np.zeros((len(y), 2)), np.ones(len(y))
            counts = np.zeros((6, len(y)))
            for i in range(draws + burn):
                rng.next_step()
                r = y - beta[:, :1] * x[:, 0] - beta[:, 1:] * x[:, 1]
                r11, r00, r01 = (r[:, 1:] ** 2).sum(1), (r[:, :-1] ** 2).sum(1), (r[:, 1:] * r[:, :-1]).sum(1)
                s2 = (b0 + (r11 - 2 * rho * r01 + rho**2 * r00) / 2) / rng.gamma(a0 + (n - 1) / 2)
                a, b, c = (sum(w * m[j] for w, m in zip((1.0, -rho, rho**2), xx)) for j in ((0, 0), (0, 1), (1, 1)))
                a, b, c = a / s2 + 1 / tau, b / s2, c / s2 + 1 / tau
                h = [(xy[0][:, j] - rho * xy[1][:, j] + rho**2 * xy[2][:, j]) / s2 for j in (0, 1)]
                det = a * c - b * b
                # Cholesky factor of the 2 x 2 inverse.
                l11 = np.sqrt(c / det)
                l21, l22 = -b / det / l11, np.sqrt(1 / c)
                rng.lanes_from(256)
                z1, z2 = rng.normal(), rng.normal()
                beta = np.stack([(c * h[0] - b * h[1]) / det + l11 * z1, (a * h[1] - b * h[0]) / det + l21 * z1 + l22 * z2], axis=1)
                r = y - beta[:, :1] * x[:, 0] - beta[:, 1:] * x[:, 1]
                rng.lanes_from(512)
                pr = (r[:, :-1] ** 2).sum(1) / s2 + 1.0
                mean, new, left = (r[:, :-1] * r[:, 1:]).sum(1) / s2 / pr, np.zeros(len(y)), np.ones(len(y), bool)
                for _ in range(100):
                    new = np.where(left, mean + rng.normal() / np.sqrt(pr), new)
                    left &= np.abs(new) >= 1
                    if not left.any():
                        break
                rho = np.where(left, np.clip(new, -0.99, 0.99), new)
                if i >= burn:
                    p, q = beta[:, 0], beta[:, 1]
                    counts += np.stack([p > 0, q > 0, p < 0, q < 0, p > q, q > p])
            names = ("p1", "p2", "n1", "n2", "p12", "p21")
            yield pd.DataFrame({**{k: pdf[k] for k in VOXEL}, **dict(zip(names, counts / draws)), "b1": beta[:, 0], "b2": beta[:, 1], "rho": rho})

    return packed.mapInPandas(run, "x int, y int, z int, p1 double, p2 double, n1 double, n2 double, p12 double, p21 double, b1 double, b2 double, rho double")
