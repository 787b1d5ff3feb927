"""Volume queries on a grid of 70,000 voxels, a hundred times that of the others, so that their cost is arithmetic and not that of starting jobs.

They join those of ``queries``, ``further`` and ``results`` in the same tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glm, permutation, spatial
from ..operators.grid import VOXEL
from . import results  # noqa: F401
from .queries import KERNEL, KSQL, QUERIES, SQL, C, D, T, X, _rounded, query, r, series, series_sql, smooth_sql, t_sql, VOX

__all__ = ["QUERIES", "SQL"]

WIDTH, HEIGHT = 100, 100
BIG = series_sql(WIDTH, HEIGHT)
CELLS = WIDTH * HEIGHT * D * T


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir, WIDTH, HEIGHT)


def signs(count: int) -> np.ndarray:
    """A rule for any number of sign flips: the first is none."""
    p, s = np.arange(count)[:, None], np.arange(T)[None]
    out = np.where((s * 7 + p * 13 + s * p % 5 + p // 64 * (s % 3)) % 2 == 1, 1, -1)
    out[0] = 1
    return out


FEW = 64
_SIGNS = f"(SELECT a.range AS p, b.range AS t, CASE WHEN a.range = 0 OR (b.range * 7 + a.range * 13 + b.range * a.range % 5) % 2 = 1 THEN 1 ELSE -1 END AS w FROM range({FEW}) a, range({T}) b) AS sg"


@query(f"WITH {BIG}, {smooth_sql('vox', 's', 't', KSQL=KSQL, size=(WIDTH, HEIGHT, D))} SELECT x, y, z, t, round(v, 5) + 0.0 AS v FROM s")
def f1_smoothing_large(spark, d):
    return spatial.smooth(vox(spark, d), KERNEL).withColumn("v", r("v", 5))


@query(t_sql("second_t").replace(VOX, BIG))
def k7_second_level_t_large(spark, d):
    return _rounded(glm.t_map(vox(spark, d), X, C, "second_t"))


def _centred(spark, d) -> DataFrame:
    v = vox(spark, d)
    mean = v.agg((F.sum("v") / CELLS).alias("mean"))
    return v.join(F.broadcast(mean)).select(*VOXEL, "t", (F.col("v") - F.col("mean")).alias("v"))


@query(
    f"WITH {BIG}, cen AS (SELECT x, y, z, t, v - (SELECT sum(v) FROM vox) / {CELLS} AS v FROM vox), fl AS (SELECT p, x, y, z, sum(v * w) / {T} AS b, sum(v * v) AS ss FROM cen JOIN {_SIGNS} USING (t) GROUP BY p, x, y, z) "
    f"SELECT CAST(p AS INT) AS p, round(max(CASE WHEN (ss - {T} * b * b) / {T - 1} > 1e-12 THEN b / sqrt((ss - {T} * b * b) / {T - 1} / {T}) ELSE 0 END), 5) AS max_stat FROM fl GROUP BY p"
)
def p10_null_of_max_large(spark, d):
    return permutation.null_of_max(_centred(spark, d), permutation.group_mean_t, signs(FEW)).withColumn("max_stat", r("max_stat", 5))


def ten_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null distribution of 10,000 permutations over all voxels: for the benchmark."""
    return permutation.null_of_max(_centred(spark, sf_dir), permutation.group_mean_t, signs(10_000))
