"""Whole analyses composed of the operators: the first level from raw volumes to results in reference space, and command-like interfaces."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import glm, grid, registration, spatial, temporal
from ..operators.grid import VOXEL


class StageTimes:
    """Seconds of each stage: a stage's table is written through ``keep`` (say, to Parquet) or, without it, planned only."""

    def __init__(self, keep: Callable[[DataFrame, str], DataFrame] | None = None):
        self.keep, self.seconds = keep, {}

    def stage(self, name: str, f: Callable[[], DataFrame]) -> DataFrame:
        began = time.time()
        out = f()
        if self.keep is not None:
            out = self.keep(out, name)
        self.seconds[name] = time.time() - began
        return out


@dataclass
class FirstLevel:
    """Slice timing, motion correction, smoothing, a GLM with AR(4) errors and the transform of its maps; a step whose setting is None is left out."""

    size: tuple[int, int, int]
    design: np.ndarray
    contrasts: np.ndarray
    deltas: list[float] | None = None
    motion: bool = True
    kernel: np.ndarray | None = None
    ar_kernel: np.ndarray | None = None
    iterations: int = 1
    outputs: str = "both"
    affine: np.ndarray | None = None

    def preprocess(self, df: DataFrame, mask: DataFrame | None = None, times: StageTimes | None = None) -> DataFrame:
        times = times or StageTimes()
        n = len(self.design)
        if self.deltas is not None:
            table = df.sparkSession.createDataFrame(list(enumerate(map(float, self.deltas))), "z int, delta double")
            df = times.stage("slice_timing", lambda d=df: temporal.slice_timing(d, table, n))
        if self.motion:
            df = times.stage("motion_correction", lambda d=df: registration.motion_correct(d, self.size).select(*VOXEL, "t", "v"))
        if self.kernel is not None:
            df = times.stage("smoothing", lambda d=df: spatial.smooth(d, self.kernel, mask))
        return df

    def run(self, df: DataFrame, mask: DataFrame, times: StageTimes | None = None) -> dict[str, DataFrame]:
        """``data``, the preprocessed series; ``maps`` and ``results`` of the fit inside the mask; ``reference``, the results where the affine takes them. ``outputs`` may stop after ``preprocess`` or give the residuals of ``regress``."""
        times = times or StageTimes()
        data = self.preprocess(df, mask, times)
        if self.outputs == "preprocess":
            return {"data": data}
        if self.outputs == "regress":
            return {"data": data, "residuals": times.stage("regression", lambda: glm.detrend(data, self.design))}
        blur = (lambda ar: spatial.smooth_maps(ar, ["a1", "a2", "a3", "a4"], self.ar_kernel, mask)) if self.ar_kernel is not None else (lambda ar: ar)
        inside = grid.apply_mask(data, mask)

        def fit() -> DataFrame:
            ar = glm.estimate_ar(inside, self.design, len(self.design), self.iterations, blur)
            return glm.whitened_maps(inside, self.design, np.atleast_2d(np.asarray(self.contrasts, float)), ar)

        maps = times.stage("model", fit)
        out = {"data": data, "maps": maps, "results": glm.select_outputs(maps, self.outputs)}
        if self.affine is not None:
            names = [c for c in maps.columns if c not in VOXEL]
            whole = mask.select(*VOXEL).join(maps, VOXEL, "left").fillna(0.0, names)
            out["reference"] = times.stage("transform", lambda: spatial.transform_results(whole, self.affine, self.size))
        return out


# ------------------------------------------------------------------ interfaces


@dataclass
class RegisterTwoVolumes:
    """One volume to another: linear, then non-linear; masks of the result or of the input."""

    iterations_linear: int = 10
    iterations_nonlinear: int = 5
    sigma: float = 5.0
    scales: int = 3
    mask: DataFrame | None = None

    def run(self, volume: DataFrame, reference: DataFrame, size: tuple[int, int, int]) -> dict[str, DataFrame]:
        one = volume if "t" in volume.columns else volume.withColumn("t", F.lit(0))
        steps = {"linear": 0, "nonlinear": self.iterations_nonlinear}
        out = {k: registration.register_images(one, reference, size, True, self.scales, self.iterations_linear, n, sigma=self.sigma) for k, n in steps.items() if k == "linear" or n}
        if self.mask is not None:
            out["masked"] = grid.apply_mask(out["nonlinear" if self.iterations_nonlinear else "linear"], self.mask, dense=True)
        return out


@dataclass
class Smoothing:
    """Smoothing by a Gaussian of ``fwhm`` millimetres, inside a mask that is given or made."""

    fwhm: float = 6.0
    voxel: float = 1.0
    mask: DataFrame | None = None
    automask: bool = False

    def run(self, volumes: DataFrame) -> dict[str, DataFrame]:
        kernel = spatial.gaussian(self.fwhm, self.voxel)
        mask = self.mask
        if self.automask:
            first = volumes.where("t = 0").drop("t") if "t" in volumes.columns else volumes
            mask = grid.auto_mask(first, spatial.smooth(first, kernel))
        return {"smoothed": spatial.smooth(volumes, kernel, mask), **({"mask": mask} if mask is not None else {})}


@dataclass
class MotionCorrection:
    """All volumes to the first or to another one; the parameters a volume."""

    iterations: int = 5
    reference: DataFrame | None = None

    def run(self, series: DataFrame, size: tuple[int, int, int]) -> dict[str, DataFrame]:
        got = registration.motion_correct(series, size, self.reference, self.iterations)
        names = [f"p{k}" for k in range(6)]
        return {"corrected": got.select(*VOXEL, "t", "v"), "parameters": got.groupBy("t").agg(*(F.max(k).alias(k) for k in names))}
