"""Volumes as rows (x, y, z[, t], v): element-wise algebra, masks, reductions, regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VOXEL = ["x", "y", "z"]
OUTSIDE = 0.001  # what a thresholded mask holds where the value is too low


def grid(spark: SparkSession, width: int, height: int, depth: int, times: int | None = None) -> DataFrame:
    """Every cell of a volume, or of a series of ``times`` volumes."""
    n = width * height * depth * (times or 1)
    i = F.col("id")
    cols = [(i % width).cast("int").alias("x"), (F.floor(i / width) % height).cast("int").alias("y"), (F.floor(i / (width * height)) % depth).cast("int").alias("z")]
    if times:
        cols.append(F.floor(i / (width * height * depth)).cast("int").alias("t"))
    return spark.range(n).select(*cols)


def densify(cells: DataFrame, on: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Every cell of ``on``; cells without a row hold 0."""
    return on.join(cells, keys, "left").select(*keys, F.coalesce(F.col(value), F.lit(0.0)).alias(value))


def apply_mask(df: DataFrame, mask: DataFrame, dense: bool = False) -> DataFrame:
    """Rows whose mask is exactly 1; with ``dense`` all rows, 0 outside."""
    inside = mask.where("m = 1.0").select(*VOXEL, F.lit(True).alias("inside"))
    if not dense:
        return df.join(inside.drop("inside"), VOXEL, "left_semi")
    return df.join(inside, VOXEL, "left").withColumn("v", F.when(F.col("inside"), F.col("v")).otherwise(0.0)).drop("inside")


def threshold(df: DataFrame, level: float | Column) -> DataFrame:
    return df.withColumn("v", F.when(F.col("v") > level, 1.0).otherwise(OUTSIDE))


def combine(a: DataFrame, b: DataFrame, op, keys: list[str] | None = None) -> DataFrame:
    """op(value of a, value of b) on equal cells: sums, differences, products."""
    keys = keys or VOXEL
    return a.join(b.withColumnRenamed("v", "v2"), keys).select(*keys, op(F.col("v"), F.col("v2")).alias("v"))


def logistic(v: Column) -> Column:
    """1 - 2 / (1 + e**-v)."""
    return 1 - 2 / (1 + F.exp(-v))


def identity(spark: SparkSession, n: int) -> DataFrame:
    i = F.floor(F.col("id") / n)
    return spark.range(n * n).select(i.cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"), F.when(i == F.col("id") % n, 1.0).otherwise(0.0).alias("v"))


def submatrix(m: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Rows and columns first..last, numbered anew from 0."""
    return m.where(F.col("i").between(*rows) & F.col("j").between(*cols)).select((F.col("i") - rows[0]).alias("i"), (F.col("j") - cols[0]).alias("j"), "v")


def permute_columns(m: DataFrame, order: list[int]) -> DataFrame:
    """Column j of the result is column order[j]."""
    place = F.create_map(*(F.lit(x) for j, o in enumerate(order) for x in (o, j)))
    return m.select("i", place[F.col("j")].cast("int").alias("j"), "v")


def series(keys: list[str] | None = None):
    return Window.partitionBy(*(keys or VOXEL))


def remove_mean(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.withColumn("v", F.col("v") - F.avg("v").over(series(keys)))


def zscore(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sample deviation; a constant series becomes 0."""
    w = series(keys)
    sd = F.stddev_samp("v").over(w)
    return df.withColumn("v", F.when(sd > 0, (F.col("v") - F.avg("v").over(w)) / sd).otherwise(0.0))


def sphere(cells: DataFrame, centre: tuple[float, float, float], radius: float, size: tuple[int, int, int], voxel=(1.0, 1.0, 1.0), in_mm: bool = False, flip: bool = True) -> DataFrame:
    """1 within ``radius`` of ``centre``, else 0. In millimetres both are divided by or measured in voxel sizes; x and y count from the far side."""
    c = [centre[k] / voxel[k] if in_mm else centre[k] for k in range(3)]
    if flip:
        c[0], c[1] = size[0] - c[0] - 1, size[1] - c[1] - 1
    step = voxel if in_mm else (1.0, 1.0, 1.0)
    d2 = sum((((F.col(k) - float(c[j])) * float(step[j])) ** 2 for j, k in enumerate(VOXEL)), F.lit(0.0))
    return cells.select(*VOXEL, F.when(F.sqrt(d2) <= radius, 1.0).otherwise(0.0).alias("m"))


def auto_mask(first: DataFrame, smoothed: DataFrame, share: float = 0.9) -> DataFrame:
    """1 where the first volume passes ``share`` of the mean of its smoothed copy."""
    level = smoothed.agg((F.avg("v") * share).alias("level"))
    return first.join(F.broadcast(level)).select(*VOXEL, F.when(F.col("v") > F.col("level"), 1.0).otherwise(0.0).alias("m"))


# ------------------------------------------------------------------ reductions


def sums_by_level(df: DataFrame) -> DataFrame:
    """Sums over x by (y, z), over y by z, and of all."""
    return df.rollup("z", "y").agg(F.sum("v").alias("total"))


def extrema(df: DataFrame) -> DataFrame:
    return df.agg(F.max("v").alias("most"), F.min("v").alias("least"))


def roi_mean(df: DataFrame, mask: DataFrame) -> DataFrame:
    return apply_mask(df, mask).groupBy("t").agg(F.avg("v").alias("v"))


def centre_of_mass(df: DataFrame) -> DataFrame:
    return df.agg(*((F.sum(F.col(k) * F.col("v")) / F.sum("v")).alias(f"c{k}") for k in VOXEL))


def number_voxels(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Inside voxels, numbered from 0 in memory order: by slice first, so no task numbers a whole volume."""
    inside = mask.where("m = 1.0").select(*VOXEL)
    before = inside.groupBy("z").count().withColumn("offset", F.sum("count").over(Window.orderBy("z").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("z").orderBy("y", "x")) - 1
    return inside.join(before.select("z", F.coalesce("offset", F.lit(0)).alias("offset")), "z").select(*VOXEL, (own + F.col("offset")).cast("long").alias("number"))


def most_displaced(params: DataFrame) -> DataFrame:
    """The largest sum of absolute parameters p0..p5 and the volume it belongs to."""
    total = reduce(lambda a, b: a + b, (F.abs(f"p{k}") for k in range(6)))
    return params.select("t", total.alias("d")).agg(F.max("d").alias("displacement"), F.max_by("t", F.struct("d", -F.col("t"))).alias("t"))
