"""Volumes that arrive while they are measured: running sums as Structured Streaming aggregations.

State is one row a key (a volume, or a voxel), whatever the stream's length;
sums are merged, so late and repeated micro-batches cost nothing more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import VOXEL


def roi_mean(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """(t, v) of a stream (x, y, z, t, v): each volume's mean inside a static mask."""
    inside = mask.where("m = 1.0").select(*VOXEL)
    return cells.join(inside, VOXEL).groupBy("t").agg(F.avg("v").alias("v"))


def running_betas(cells: DataFrame, design: DataFrame) -> DataFrame:
    """(x, y, z, xy0, ...): sums of regressor times value over the volumes seen so far; ``design``: a static (t, x0, ...)."""
    names = [c for c in design.columns if c != "t"]
    return cells.join(design, "t").groupBy(*VOXEL).agg(*(F.sum(F.col("v") * F.col(c)).alias(f"xy{c[1:]}") for c in names))
