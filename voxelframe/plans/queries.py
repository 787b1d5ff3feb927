"""Queries of the volume operators over the driver's tables, each with SQL for the same result where SQL can say it.

The series is ``lineitem`` on a grid of 10 x 10 x 7 voxels and 24 volumes: a
cell's value is the quantity summed over its rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import design, glm, grid, learning, permutation, registration, spatial, temporal
from ..operators.grid import VOXEL

W, H, D, T = SIZE_T = (10, 10, 7, 24)
SIZE = (W, H, D)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def num(x: float) -> str:
    s = repr(float(x))
    return s if "e" in s else s + "e0"


def values(rows, name: str) -> str:
    """A SQL table of constants."""
    return "(VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, np.integer)) else num(x) for x in row) + ")" for row in rows) + f") AS {name}"


# ------------------------------------------------------------------ the series


def series(spark: SparkSession, sf_dir: str, width: int, height: int) -> DataFrame:
    """Quantities of ``lineitem`` on a grid of width x height x D voxels and T volumes."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1
    raw = li.select((F.col("l_partkey") % width).cast("int").alias("x"), (F.col("l_suppkey") % height).cast("int").alias("y"), (F.col("l_linenumber") - 1).cast("int").alias("z"), (month % T).cast("int").alias("t"), "l_quantity")
    raw = raw.groupBy(*VOXEL, "t").agg(F.sum("l_quantity").alias("v"))
    return grid.densify(raw, grid.grid(spark, width, height, D, T), [*VOXEL, "t"])


def series_sql(width: int, height: int) -> str:
    return f"""raw AS (SELECT CAST(l_partkey % {width} AS INT) AS x, CAST(l_suppkey % {height} AS INT) AS y, CAST(l_linenumber - 1 AS INT) AS z,
  CAST(((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1) % {T} AS INT) AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
vox AS (SELECT g.x, g.y, g.z, g.t, coalesce(raw.v, 0.0::DOUBLE) AS v FROM
  (SELECT CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, CAST(c.range AS INT) AS z, CAST(d.range AS INT) AS t FROM range({width}) a, range({height}) b, range({D}) c, range({T}) d) g
  LEFT JOIN raw ON g.x = raw.x AND g.y = raw.y AND g.z = raw.z AND g.t = raw.t)"""


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir, W, H)


VOX = series_sql(W, H)
MASK = f"""tot AS (SELECT sum(v) AS s FROM vox), mask AS (SELECT x, y, z, CASE WHEN sum(v) * {10 * W * H * D} > 9 * max(tot.s) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM vox, tot GROUP BY x, y, z)"""


def brain(v: DataFrame) -> DataFrame:
    total = v.agg(F.sum("v").alias("s"))
    sums = v.groupBy(*VOXEL).agg(F.sum("v").alias("sv")).join(F.broadcast(total))
    return sums.select(*VOXEL, F.when(F.col("sv") * (10 * W * H * D) > 9 * F.col("s"), 1.0).otherwise(0.0).alias("m"))


def volume(v: DataFrame, t: int) -> DataFrame:
    return v.where(F.col("t") == t).select(*VOXEL, "v")


V0, V1 = "v0 AS (SELECT x, y, z, v FROM vox WHERE t = 0)", "v1 AS (SELECT x, y, z, v FROM vox WHERE t = 1)"
MEAN = "mean AS (SELECT x, y, z, sum(v) AS v FROM vox GROUP BY x, y, z)"


def summed(v: DataFrame) -> DataFrame:
    return v.groupBy(*VOXEL).agg(F.sum("v").alias("v"))


# ------------------------------------------------------------------ element-wise


@query(f"WITH {VOX}, {MASK} SELECT vox.x, vox.y, vox.z, t, CASE WHEN m = 1.0 THEN v ELSE 0.0::DOUBLE END AS v FROM vox JOIN mask USING (x, y, z)")
def e1_apply_mask(spark, d):
    v = vox(spark, d)
    return grid.apply_mask(v, brain(v), dense=True)


@query(f"WITH {VOX}, {V0} SELECT x, y, z, CASE WHEN v > 20 THEN 1.0::DOUBLE ELSE 0.001::DOUBLE END AS v FROM v0")
def e2_threshold_mask(spark, d):
    return grid.threshold(volume(vox(spark, d), 0), 20.0)


@query(f"WITH {VOX} SELECT x, y, z, t, v + 2.5 AS v FROM vox")
def e3_add_scalar(spark, d):
    return vox(spark, d).withColumn("v", F.col("v") + 2.5)


def _two(op):
    return lambda spark, d: (lambda v: grid.combine(volume(v, 0), volume(v, 1), op))(vox(spark, d))


for _n, _op, _s in (("e4_add_volumes", lambda a, b: a + b, "+"), ("e5_subtract_volumes", lambda a, b: a - b, "-"), ("e7_multiply_volumes", lambda a, b: a * b, "*")):
    QUERIES[_n] = _two(_op)
    SQL[_n] = f"WITH {VOX}, {V0}, {V1} SELECT x, y, z, v0.v {_s} v1.v AS v FROM v0 JOIN v1 USING (x, y, z)"


@query(f"WITH {VOX} SELECT x, y, z, t, v * 0.5 AS v FROM vox")
def e6_multiply_scalar(spark, d):
    return vox(spark, d).withColumn("v", F.col("v") * 0.5)


@query(f"SELECT CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, CAST(c.range AS INT) AS z, 7.0::DOUBLE AS v FROM range({W}) a, range({H}) b, range({D}) c")
def e8_fill(spark, d):
    return grid.grid(spark, W, H, D).withColumn("v", F.lit(7.0))


@query(f"WITH {VOX}, {V0}, {V1} SELECT x, y, z, round(sqrt(v0.v * v0.v + v1.v * v1.v), 6) AS v FROM v0 JOIN v1 USING (x, y, z)")
def e9_magnitude(spark, d):
    v = vox(spark, d)
    return grid.combine(volume(v, 0), volume(v, 1), lambda a, b: r(F.hypot(a, b)))


@query(f"WITH {VOX} SELECT x, y, z, t, round(1 - 2 / (1 + exp(-v / 100)), 6) AS v FROM vox")
def e10_logistic(spark, d):
    return vox(spark, d).withColumn("v", r(grid.logistic(F.col("v") / 100)))


@query("SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, CASE WHEN a.range = b.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(12) a, range(12) b")
def e11_identity(spark, d):
    return grid.identity(spark, 12)


def matrix(spark, d):
    return volume(vox(spark, d), 0).where("z = 0").select(F.col("x").alias("i"), F.col("y").alias("j"), "v")


MATRIX = f"{VOX}, mat AS (SELECT x AS i, y AS j, v FROM vox WHERE t = 0 AND z = 0)"


@query(f"WITH {MATRIX} SELECT i - 2 AS i, j - 3 AS j, v FROM mat WHERE i BETWEEN 2 AND 6 AND j BETWEEN 3 AND 5")
def e12_submatrix(spark, d):
    return grid.submatrix(matrix(spark, d), (2, 6), (3, 5))


@query(f"WITH {MATRIX} SELECT i, CAST((j * 7 + 3) % 10 AS INT) AS j, v FROM mat")
def e13_permute_columns(spark, d):
    return grid.permute_columns(matrix(spark, d), [o for _, o in sorted(((j * 7 + 3) % 10, j) for j in range(10))])


@query(f"WITH {VOX} SELECT x, y, z, t, round(v - avg(v) OVER (PARTITION BY x, y, z), 6) + 0.0 AS v FROM vox")
def e14_remove_mean(spark, d):
    return grid.remove_mean(vox(spark, d)).withColumn("v", r("v"))


@query(f"WITH {VOX} SELECT x, y, z, t, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM vox")
def e15_cast(spark, d):
    return vox(spark, d).withColumn("v", F.col("v").cast("float").cast("double"))


@query(f"WITH {VOX} SELECT x, y, z, t, CASE WHEN stddev_samp(v) OVER w > 0 THEN round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) + 0.0 ELSE 0.0 END AS v FROM vox WINDOW w AS (PARTITION BY x, y, z)")
def e16_zscore(spark, d):
    return grid.zscore(vox(spark, d)).withColumn("v", r("v"))


@query(f"WITH {VOX}, {V0} SELECT x, y, z, CASE WHEN sqrt((x - {W - 1 - 4}) ^ 2 + (y - {H - 1 - 3}) ^ 2 + (z - 2) ^ 2) <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM v0")
def e17_sphere(spark, d):
    return grid.sphere(grid.grid(spark, W, H, D), (4, 3, 2), 3.0, SIZE)


KERNEL = spatial.gaussian(5.5, 2.0)


def bell_sql(sigma: str, taps: int) -> str:
    """A Gaussian of ``taps`` taps that sums to 1, as a table k (o, w)."""
    o = f"(range - {taps // 2})"
    return f"(SELECT {o} AS o, exp(-{o} * {o} / (2 * ({sigma}) ^ 2)) / sum(exp(-{o} * {o} / (2 * ({sigma}) ^ 2))) OVER () AS w FROM range({taps})) AS k"


KSQL = bell_sql("5.5e0 / 2.354 / 2", 9)


def smooth_sql(source: str, name: str, keys: str = "", mask: str | None = None, KSQL: str = KSQL, size: tuple[int, int, int] = SIZE) -> str:
    """CTEs that end in ``name`` (x, y, z, keys, v), normalised smoothing of ``source``."""
    w, h, d = size
    k = f", {keys}" if keys else ""
    m = "coalesce(mask.m, 0.0)" if mask else "1.0::DOUBLE"
    out = f"{name}0 AS (SELECT x, y, z{k}, v * {m} AS v, {m} AS m FROM {source}" + (" LEFT JOIN mask USING (x, y, z)" if mask else "") + ")"
    for step, (axis, size) in enumerate((("y", h), ("x", w), ("z", d))):
        cells = ", ".join(f"{a} + k.o AS {a}" if a == axis else a for a in "xyz")
        out += f", {name}{step + 1} AS (SELECT x, y, z{k}, sum(v) AS v, sum(m) AS m FROM (SELECT {cells}{k}, v * k.w AS v, m * k.w AS m FROM {name}{step}, {KSQL}) WHERE {axis} BETWEEN 0 AND {size - 1} GROUP BY ALL)"
    return out + f", {name} AS (SELECT x, y, z{k}, CASE WHEN m <> 0 THEN v / m ELSE 0.0::DOUBLE END AS v FROM {name}3)"


@query(f"WITH {VOX}, {V0}, {smooth_sql('v0', 's')} SELECT v0.x, v0.y, v0.z, CASE WHEN v0.v > (SELECT avg(v) * 0.9 FROM s) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM v0")
def e18_auto_mask(spark, d):
    v = volume(vox(spark, d), 0)
    return grid.auto_mask(v, spatial.smooth(v, KERNEL))


# ------------------------------------------------------------------ reductions


@query(f"WITH {VOX} SELECT coalesce(z, -1) AS z, coalesce(y, -1) AS y, sum(v) AS total FROM vox GROUP BY ROLLUP (z, y)")
def a1_sums(spark, d):
    return grid.sums_by_level(vox(spark, d)).select(F.coalesce("z", F.lit(-1)).alias("z"), F.coalesce("y", F.lit(-1)).alias("y"), "total")


@query(f"WITH {VOX} SELECT y, z, t, max(v) AS most FROM vox GROUP BY y, z, t")
def a2_line_max(spark, d):
    return vox(spark, d).groupBy("y", "z", "t").agg(F.max("v").alias("most"))


@query(f"WITH {VOX}, {MASK} SELECT max(v) AS most FROM vox JOIN mask USING (x, y, z) WHERE m = 1.0")
def a3_masked_max(spark, d):
    v = vox(spark, d)
    return grid.apply_mask(v, brain(v)).agg(F.max("v").alias("most"))


@query(f"WITH {VOX} SELECT max(v) AS most, min(v) AS least FROM vox")
def a4_extrema(spark, d):
    return grid.extrema(vox(spark, d))


@query(f"WITH {VOX}, roi AS (SELECT x, y, z FROM vox WHERE t = 0 AND sqrt((x - 5) ^ 2 + (y - 5) ^ 2 + (z - 3) ^ 2) <= 2) SELECT t, round(avg(v), 6) AS v FROM vox JOIN roi USING (x, y, z) GROUP BY t")
def a5_roi_mean(spark, d):
    m = grid.sphere(grid.grid(spark, W, H, D), (5, 5, 3), 2.0, SIZE, flip=False)
    return grid.roi_mean(vox(spark, d), m).withColumn("v", r("v"))


@query(f"WITH {VOX}, {MASK} SELECT t, round(avg(v), 6) AS v FROM vox JOIN mask USING (x, y, z) WHERE m = 1.0 GROUP BY t")
def a6_global_mean(spark, d):
    v = vox(spark, d)
    return grid.roi_mean(v, brain(v)).withColumn("v", r("v"))


@query(f"WITH {VOX}, {V0} SELECT round(sum(x * v) / sum(v), 6) AS cx, round(sum(y * v) / sum(v), 6) AS cy, round(sum(z * v) / sum(v), 6) AS cz FROM v0")
def a7_centre_of_mass(spark, d):
    c = grid.centre_of_mass(volume(vox(spark, d), 0))
    return c.select(*(r(k).alias(k) for k in c.columns))


@query(f"WITH {VOX}, {MASK} SELECT x, y, z, row_number() OVER (ORDER BY z, y, x) - 1 AS number FROM mask WHERE m = 1.0")
def a11_voxel_number(spark, d):
    return grid.number_voxels(brain(vox(spark, d)), W, H)


@query(f"WITH {VOX}, p AS (SELECT t, sum(abs(s)) / 1000 AS d FROM (SELECT t, x % 6 AS k, sum(v * (y - 4)) AS s FROM vox GROUP BY t, x % 6) GROUP BY t) SELECT max(d) AS displacement, CAST(min(t) FILTER (WHERE d = (SELECT max(d) FROM p)) AS INT) AS t FROM p")
def a12_most_displaced(spark, d):
    v = vox(spark, d).withColumn("v", F.col("v") * (F.col("y") - 4))
    p = v.groupBy("t").agg(*(F.sum(F.when(F.col("x") % 6 == k, F.col("v")).otherwise(0.0)).alias(f"p{k}") for k in range(6)))
    out = grid.most_displaced(p)
    return out.select((F.col("displacement") / 1000).alias("displacement"), "t")


@query(f"WITH {VOX}, {MEAN} SELECT count(*) FILTER (WHERE v > (SELECT avg(v) * 1.2 FROM mean)) AS significant, count(*) AS voxels FROM mean")
def a13_significant_voxels(spark, d):
    m = summed(vox(spark, d))
    level = m.agg((F.avg("v") * 1.2).alias("level"))
    return m.join(F.broadcast(level)).agg(F.count(F.when(F.col("v") > F.col("level"), 1)).alias("significant"), F.count("*").alias("voxels"))


# ------------------------------------------------------------------ temporal

DELTAS = temporal.slice_deltas(D, "up_interleaved", 2.0)
# Even slices come first, then odd ones, a seventh of TR apart; slice 4, the third to be taken, is the reference.
DELTA_SQL = f"(SELECT range AS z, (2 - CASE WHEN range % 2 = 0 THEN range // 2 ELSE {(D + 1) // 2} + range // 2 END) / {D}e0 AS d FROM range({D})) AS dl"


@query(f"SELECT CAST(z AS INT) AS z, round(d, 6) + 0.0 AS delta FROM {DELTA_SQL}")
def w2_slice_deltas(spark, d):
    return spark.createDataFrame(list(enumerate(DELTAS)), "z int, delta double").withColumn("delta", r("delta"))


_AT = "coalesce({f}(v, {k}) OVER w, {e}(v) OVER (PARTITION BY x, y, z ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_LAG = [_AT.format(f="lag", k=2, e="first"), _AT.format(f="lag", k=1, e="first"), "v", _AT.format(f="lead", k=1, e="last"), _AT.format(f="lead", k=2, e="last")]


@query(
    f"""WITH {VOX}, q AS (SELECT x, y, z, t, dl.d, v, {', '.join(f'{e} AS q{i}' for i, e in enumerate(_LAG))} FROM vox JOIN {DELTA_SQL} USING (z) WINDOW w AS (PARTITION BY x, y, z ORDER BY t)),
p AS (SELECT x, y, z, t, v, d AS delta, CASE WHEN d > 0 THEN d ELSE 1 + d END AS d, {', '.join(f'CASE WHEN d > 0 THEN q{i + 1} ELSE q{i} END AS p{i}' for i in range(4))} FROM q)
SELECT x, y, z, t, CASE WHEN delta = 0 THEN v ELSE round((((p3 - p2 - p0 + p1) * d + (p0 - p1 - (p3 - p2 - p0 + p1))) * d + (p2 - p0)) * d + p1, 6) + 0.0 END AS v FROM p"""
)
def w1_slice_timing(spark, d):
    dl = spark.createDataFrame(list(enumerate(DELTAS)), "z int, delta double")
    return temporal.slice_timing(vox(spark, d), dl, T).withColumn("v", r("v"))


@query(f"WITH {VOX}, l AS (SELECT x, y, z, v, t, v AS l0, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2, lag(v, 3) OVER w AS l3, lag(v, 4) OVER w AS l4 FROM vox WINDOW w AS (PARTITION BY x, y, z ORDER BY t)) SELECT x, y, z, {', '.join(f'round(sum(v * l{k}) / {T - 1 - k}, 6) AS c{k}' for k in range(5))} FROM l GROUP BY x, y, z")
def w3_lag_products(spark, d):
    c = temporal.lag_products(vox(spark, d), T)
    return c.select(*VOXEL, *(r(f"c{k}").alias(f"c{k}") for k in range(5)))


def ar_sql(source: str, name: str, ridge: str = "0.001e0") -> str:
    """CTEs that end in ``name`` (x, y, z, a1..a4): lag products of ``source`` (x, y, z, t, v), their 4 x 4 equations, eliminated step by step."""
    n = range(1, 5)
    lags = ", ".join(f"lag(v, {k}) OVER w AS l{k}" for k in n)
    sums = ", ".join(f"sum(v * l{k}) / {T - 1 - k} AS c{k}" for k in n)
    entry = lambda i, j: "1e0" if i == j else f"c{abs(i - j)} / c0 + {ridge}"
    out = [f"{name}l AS (SELECT x, y, z, v, {lags} FROM {source} WINDOW w AS (PARTITION BY x, y, z ORDER BY t))", f"{name}c AS (SELECT x, y, z, sum(v * v) / {T - 1} AS c0, {sums} FROM {name}l GROUP BY x, y, z)"]
    cells = ", ".join([f"{entry(i, j)} AS m{i}{j}" for i in n for j in n] + [f"c{i} / c0 AS r{i}" for i in n])
    out.append(f"{name}0 AS (SELECT x, y, z, {cells} FROM {name}c WHERE c0 <> 0)")
    for k in (1, 2, 3):
        rest = [f"m{i}{j} - m{i}{k} / m{k}{k} * m{k}{j} AS m{i}{j}" for i in n for j in n if i > k and j > k] + [f"r{i} - m{i}{k} / m{k}{k} * r{k} AS r{i}" for i in n if i > k]
        same = [f"m{i}{j}" for i in n for j in n if i <= k and j >= i] + [f"r{i}" for i in n if i <= k]
        out.append(f"{name}{k} AS (SELECT x, y, z, {', '.join(same + rest)} FROM {name}{k - 1})")
    last = f"{name}3"
    for i in (4, 3, 2, 1):
        known = "".join(f" - m{i}{j} * a{j}" for j in range(i + 1, 5))
        out.append(f"{name}s{i} AS (SELECT *, (r{i}{known}) / m{i}{i} AS a{i} FROM {last})")
        last = f"{name}s{i}"
    out.append(f"{name} AS (SELECT c.x, c.y, c.z, {', '.join(f'coalesce(a{k}, 0.0) AS a{k}' for k in n)} FROM {name}c c LEFT JOIN {last} USING (x, y, z))")
    return ", ".join(out)


@query(f"WITH {VOX}, cv AS (SELECT x, y, z, t, v - avg(v) OVER (PARTITION BY x, y, z) AS v FROM vox), {ar_sql('cv', 'ar')} SELECT x, y, z, {', '.join(f'round(a{k}, 6) + 0.0 AS a{k}' for k in range(1, 5))} FROM ar")
def w3_ar_coefficients(spark, d):
    v = grid.remove_mean(vox(spark, d))
    return _rounded(temporal.solve_ar(temporal.lag_products(v, T)))


_AR = (0.4, -0.2, 0.1, 0.05)


@query(f"WITH {VOX} SELECT x, y, z, t, round(v" + "".join(f" - coalesce({num(a)} * lag(v, {k}) OVER w, 0)" for k, a in enumerate(_AR, 1)) + ", 6) + 0.0 AS v FROM vox WINDOW w AS (PARTITION BY x, y, z ORDER BY t)")
def w4_whiten(spark, d):
    v = vox(spark, d)
    ar = grid.grid(spark, W, H, D).select(*VOXEL, *(F.lit(a).alias(f"a{k}") for k, a in enumerate(_AR, 1)))
    return temporal.whiten(v, ar).withColumn("v", r("v"))


@query(f"WITH {VOX} SELECT x, y, z, t, v FROM vox")
def w5_inverse_whiten(spark, d):
    """Whitening and its inverse, which give the series back."""
    v = vox(spark, d)
    ar = grid.grid(spark, W, H, D).select(*VOXEL, *(F.lit(a).alias(f"a{k}") for k, a in enumerate(_AR, 1)))
    return temporal.inverse_whiten(temporal.whiten(v, ar), ar).withColumn("v", r("v"))


@query(f"WITH {VOX} SELECT x, y, z, t, v - coalesce(lag(v) OVER (PARTITION BY x, y, z ORDER BY t), v) AS v FROM vox")
def w7_derivative(spark, d):
    """The derivative of each voxel's series, as that of a regressor."""
    from ..operators import glm as models

    return models.map_series(vox(spark, d), design.temporal_derivative)


# ------------------------------------------------------------------ design

TASK = np.array([float(t // 4 % 2) for t in range(T)])
X = np.column_stack([TASK, temporal.trends(T, 2)])
PINV = design.pseudo_inverse(X)
C = np.array([1.0, 0.0, 0.0])
CF = np.array([[1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
X_SQL = f"(SELECT CAST(range AS INT) AS t, CAST(range // 4 % 2 AS DOUBLE) AS x0, 1.0::DOUBLE AS x1, (range - {(T - 1) / 2}e0) / {(T - 1) / 2}e0 AS x2 FROM range({T})) AS x"


def adjugate(m: str = "s") -> tuple[list[str], str]:
    """The entries (00, 01, 02, 11, 12, 22) of a symmetric 3 x 3 matrix's adjugate, and its determinant."""
    a, b, c, d, e, f = (f"{m}{k}" for k in ("00", "01", "02", "11", "12", "22"))
    adj = [f"({d} * {f} - {e} * {e})", f"({c} * {e} - {b} * {f})", f"({b} * {e} - {c} * {d})", f"({a} * {f} - {c} * {c})", f"({b} * {c} - {a} * {e})", f"({a} * {d} - {b} * {b})"]
    return adj, f"({a} * {adj[0]} + {b} * {adj[1]} + {c} * {adj[2]})"


_PAIR = ("00", "01", "02", "11", "12", "22")


def pinv_sql(source: str, where: str = "TRUE") -> str:
    """The pseudo-inverse of the design in ``source`` (t, x0, x1, x2), as a table p (t, p0, p1, p2)."""
    adj, det = adjugate()
    at = dict(zip(_PAIR, adj))
    rows = [" + ".join(f"{at[f'{min(i, j)}{max(i, j)}']} * x{j}" for j in range(3)) for i in range(3)]
    sums = ", ".join(f"sum(x{k[0]} * x{k[1]}) AS s{k}" for k in _PAIR)
    return f"(WITH xx AS (SELECT * FROM {source} WHERE {where}), ss AS (SELECT {sums} FROM xx) SELECT t, {', '.join(f'({r}) / {det} AS p{i}' for i, r in enumerate(rows))} FROM xx, ss) AS p"


P_SQL = pinv_sql(X_SQL)
RUN = 240


def events(spark, d):
    """All events as (idx, onset, duration, value): every 40 minutes are a second."""
    e = spark.read.parquet(f"{d}/events.parquet")
    first = e.agg(F.min("ts").alias("first"))
    e = e.join(F.broadcast(first)).withColumn("s", F.unix_timestamp("ts") - F.unix_timestamp("first"))
    return e.select(F.col("event_id").alias("idx"), (F.floor(F.col("s") / 2400).cast("double") % RUN).alias("onset"), (F.col("event_id") % 5).cast("double").alias("duration"), (1 + F.col("event_id") % 3).cast("double").alias("value"))


EVENTS = f"""ev0 AS (SELECT *, floor(epoch(ts))::BIGINT - min(floor(epoch(ts))::BIGINT) OVER () AS s, event_id AS idx FROM events),
ev AS (SELECT idx, CAST((s // 2400) % {RUN} AS DOUBLE) AS onset, CAST(event_id % 5 AS DOUBLE) AS duration, CAST(1 + event_id % 3 AS DOUBLE) AS value FROM ev0),
sp AS (SELECT idx, value, CAST(round(onset * 100 / 2) AS BIGINT) AS s, CAST(round(duration * 100 / 2) AS BIGINT) AS n FROM ev),
box AS (SELECT i, max_by(value, idx) AS v FROM (SELECT idx, value, unnest(range(s, least(s + n, {RUN // 2 * 100}))) AS i FROM sp WHERE n > 0) GROUP BY i)"""


@query(f"WITH {EVENTS} SELECT i, v FROM box")
def g1_boxcar(spark, d):
    return design.boxcar(events(spark, d), 2.0, RUN // 2)


LOW = design.lowpass_kernel(2.0)


@query(f"WITH {EVENTS} SELECT i, round(sum(p), 6) AS v FROM (SELECT i + k.o AS i, v * k.w AS p FROM box, {bell_sql('150e0 / 2.354 / 2', 151)}) WHERE i BETWEEN 0 AND {RUN // 2 * 100 - 1} GROUP BY i")
def g2_lowpass(spark, d):
    return design.convolve(design.boxcar(events(spark, d), 2.0, RUN // 2), LOW, RUN // 2 * 100).withColumn("v", r("v"))


@query(f"WITH {EVENTS} SELECT CAST(i // 100 AS INT) AS t, v FROM box WHERE i % 100 = 0")
def g3_downsample(spark, d):
    return design.downsample(design.boxcar(events(spark, d), 2.0, RUN // 2))


HRF = design.hrf(2.0)
_RESPONSE = "(s ^ 5 / factorial(5) - s ^ 15 / factorial(15) / 6) * exp(-s)"
HRF_SQL = f"(SELECT o, h / sum(h) OVER () AS w FROM (SELECT range AS o, 2e0 * range AS s, {_RESPONSE} AS h FROM range(17)) WHERE h <> 0) AS k"


@query(f"WITH {EVENTS}, ds AS (SELECT CAST(i // 100 AS INT) AS t, v FROM box WHERE i % 100 = 0) SELECT i, round(sum(p), 6) + 0.0 AS v FROM (SELECT CAST(t + k.o AS INT) AS i, v * k.w AS p FROM ds, {HRF_SQL}) WHERE i < {RUN // 2} GROUP BY i")
def g4_hrf(spark, d):
    ds = design.downsample(design.boxcar(events(spark, d), 2.0, RUN // 2)).withColumnRenamed("t", "i")
    padded = np.concatenate([np.zeros(len(HRF) - 1), HRF])  # causal
    return design.convolve(ds, padded, RUN // 2).withColumn("v", r("v"))


@query(f"WITH n AS (SELECT CAST(range AS INT) AS t, (range - {(T - 1) / 2}) / {(T - 1) / 2} AS s FROM range({T})) SELECT t, 1.0::DOUBLE AS d0, round(s, 6) AS d1, round(s ^ 2, 6) AS d2, round(s ^ 3, 6) AS d3 FROM n")
def g5_trends(spark, d):
    df = spark.createDataFrame([(t, *map(float, row)) for t, row in enumerate(temporal.trends(T))], "t int, d0 double, d1 double, d2 double, d3 double")
    return df.select("t", "d0", *(r(k).alias(k) for k in ("d1", "d2", "d3")))


@query(f"WITH {EVENTS}, ds AS (SELECT CAST(range AS INT) AS t, coalesce(v, 0.0) AS v FROM range({RUN // 2}) g LEFT JOIN (SELECT i // 100 AS t, v FROM box WHERE i % 100 = 0) b ON b.t = g.range) SELECT t, round(v - avg(v) OVER (), 6) + 0.0 AS v FROM ds")
def g7_demean(spark, d):
    full = design.sampled(design.boxcar(events(spark, d), 2.0, RUN // 2), RUN // 2)
    got = design.demean(full[:, None])[:, 0]
    return spark.createDataFrame([(t, float(v)) for t, v in enumerate(got)], "t int, v double").select("t", r("v").alias("v"))


# ------------------------------------------------------------------ linear models

FIT = f"""fit AS (SELECT x, y, z, {', '.join(f'sum(v * p{k}) AS b{k}' for k in range(3))} FROM vox JOIN {P_SQL} USING (t) GROUP BY x, y, z),
res AS (SELECT vox.x AS x, vox.y AS y, vox.z AS z, t, v - (b0 * x0 + b1 * x1 + b2 * x2) AS e FROM vox JOIN fit USING (x, y, z) JOIN {X_SQL} USING (t)),
va AS (SELECT x, y, z, sum(e * e) AS ss, sum(e) AS se FROM res GROUP BY x, y, z)"""
_VAR = {"first": f"((ss - se * se / {T}) / {T - 1})", "second_t": f"(ss / {T - 3})", "second_f": f"((ss - se * se / {T}) / {T - 4})"}
_TS = f"(SELECT sum(p0 * p0) FROM {P_SQL})"
_QUAD = f"FROM (SELECT sum(p0 * p0) AS a, sum(p0 * p2) AS b, sum(p2 * p2) AS c FROM {P_SQL})"
#: The inverse of the two contrasts' covariance factors.
FM00, FM01, FM11 = (f"(SELECT {k} / (a * c - b * b) {_QUAD})" for k in ("c", "-b", "a"))


def t_sql(mode: str) -> str:
    return f"WITH {VOX}, {FIT} SELECT x, y, z, round(b0, 6) + 0.0 AS cope, round({_VAR[mode]}, 6) AS var, CASE WHEN {_VAR[mode]} > 0 THEN round(b0 / sqrt({_VAR[mode]} * {_TS}), 6) + 0.0 ELSE 0.0 END AS stat FROM fit JOIN va USING (x, y, z)"


def f_sql(mode: str) -> str:
    form = f"(b0 * b0 * {FM00} + 2 * b0 * b2 * {FM01} + b2 * b2 * {FM11})"
    return f"WITH {VOX}, {FIT} SELECT x, y, z, round({_VAR[mode]}, 6) AS var, CASE WHEN {_VAR[mode]} > 0 THEN round({form} / ({_VAR[mode]} * 2), 6) ELSE 0.0 END AS stat FROM fit JOIN va USING (x, y, z)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r(k).alias(k) if t == "double" else k for k, t in df.dtypes))


@query(f"WITH {VOX}, {FIT} SELECT x, y, z, round(b0, 6) + 0.0 AS b0, round(b1, 6) + 0.0 AS b1, round(b2, 6) + 0.0 AS b2 FROM fit")
def k1_betas(spark, d):
    return _rounded(glm.betas(vox(spark, d), X).drop("ys"))


@query(f"WITH {VOX}, {FIT} SELECT x, y, z, round(b0, 6) + 0.0 AS c0, round(b2, 6) + 0.0 AS c1 FROM fit")
def k2_copes(spark, d):
    return _rounded(glm.copes(glm.betas(vox(spark, d), X), CF).select(*VOXEL, "c0", "c1"))


@query(f"WITH {VOX}, {FIT} SELECT x, y, z, CAST(t AS INT) AS t, round(e, 6) + 0.0 AS v FROM res")
def k4_residuals(spark, d):
    return _rounded(glm.detrend(vox(spark, d), X))


@query(t_sql("first"))
def k5_first_level_t(spark, d):
    return _rounded(glm.t_map(vox(spark, d), X, C, "first"))


@query(f_sql("first"))
def k6_first_level_f(spark, d):
    return _rounded(glm.f_map(vox(spark, d), X, CF, "first"))


@query(t_sql("second_t"))
def k7_second_level_t(spark, d):
    return _rounded(glm.t_map(vox(spark, d), X, C, "second_t"))


@query(f_sql("second_f"))
def k8_second_level_f(spark, d):
    return _rounded(glm.f_map(vox(spark, d), X, CF, "second_f"))


MIX = np.eye(T) - X[:, 1:] @ np.linalg.pinv(X[:, 1:])
# The mean and a centred line don't overlap, so what they explain is a sum.
_XT = X_SQL.removesuffix("AS x")
MIX_SQL = f"(SELECT a.t AS i, b.t, CASE WHEN a.t = b.t THEN 1 ELSE 0 END - 1e0 / {T} - a.x2 * b.x2 / (SELECT sum(x2 * x2) FROM {X_SQL}) AS w FROM {_XT} AS a, {_XT} AS b) AS m"


@query(f"WITH {VOX} SELECT x, y, z, CAST(m.i AS INT) AS t, round(sum(v * m.w), 6) + 0.0 AS v FROM vox JOIN {MIX_SQL} USING (t) GROUP BY x, y, z, m.i")
def k9_transform_data(spark, d):
    return _rounded(glm.transform_data(vox(spark, d), MIX))


def _k11_sql(final: str = "", smoothed: bool = True) -> str:
    """First-level betas and t with the voxels' own AR coefficients; ``final`` replaces the last SELECT."""
    lags = ", ".join(f"lag(x{i}, {k}, 0e0) OVER (ORDER BY t) AS x{i}l{k}" for i in range(3) for k in range(1, 5))
    white = lambda v, lag: v + "".join(f" - a{k} * {lag(k)}" for k in range(1, 5))
    wx = ", ".join(f"{white(f'x{i}', lambda k, i=i: f'x{i}l{k}')} AS w{i}" for i in range(3))
    adj, det = adjugate()
    at = dict(zip(_PAIR, adj))
    b = ", ".join("(" + " + ".join(f"{at[f'{min(i, j)}{max(i, j)}']} * h{j}" for j in range(3)) + f") / {det} AS b{i}" for i in range(3))
    maps = ", ".join(smooth_sql(f"m{k}", f"q{k}_", mask="mask", KSQL=bell_sql("6e0 / 2.354 / 2", 9)) for k in range(1, 5))
    return f"""WITH {VOX}, {MASK}, {FIT}, re AS (SELECT x, y, z, t, e AS v FROM res), {ar_sql('re', 'ar')}, {', '.join(f'm{k} AS (SELECT x, y, z, a{k} AS v FROM ar)' for k in range(1, 5))}, {maps},
sm AS (SELECT x, y, z, {', '.join(f'q{k}_.v AS a{k}' for k in range(1, 5))} FROM q1_ JOIN q2_ USING (x, y, z) JOIN q3_ USING (x, y, z) JOIN q4_ USING (x, y, z)),
xl AS (SELECT *, {lags} FROM {X_SQL}), vl AS (SELECT x, y, z, t, v, {', '.join(f'lag(v, {k}, 0e0) OVER w AS v{k}' for k in range(1, 5))} FROM vox WINDOW w AS (PARTITION BY x, y, z ORDER BY t)),
wh AS (SELECT vl.x, vl.y, vl.z, vl.t, {white('v', lambda k: f'v{k}')} AS wy, {wx} FROM vl JOIN {'sm' if smoothed else 'ar'} sm ON sm.x = vl.x AND sm.y = vl.y AND sm.z = vl.z JOIN xl ON xl.t = vl.t WHERE vl.t >= 4),
su AS (SELECT x, y, z, {', '.join(f'sum(w{k[0]} * w{k[1]}) AS s{k}' for k in _PAIR)}, {', '.join(f'sum(w{i} * wy) AS h{i}' for i in range(3))} FROM wh GROUP BY x, y, z),
be AS (SELECT x, y, z, {b}, {adj[0]} / {det} AS i00 FROM su),
er AS (SELECT x, y, z, var_samp(wy - b0 * w0 - b1 * w1 - b2 * w2) AS var FROM wh JOIN be USING (x, y, z) GROUP BY x, y, z)
""" + (final or "SELECT x, y, z, round(b0, 5) + 0.0 AS cope, CASE WHEN var > 0 THEN round(b0 / sqrt(var * i00), 5) + 0.0 ELSE 0.0 END AS stat FROM be JOIN er USING (x, y, z)")


@query(_k11_sql())
def k11_cochrane_orcutt(spark, d):
    v = vox(spark, d)
    certain = brain(v)
    names = ["a1", "a2", "a3", "a4"]
    got = glm.cochrane_orcutt(v, X, C, T, 1, lambda ar: spatial.smooth_maps(ar, names, spatial.gaussian(6.0, 2.0), certain))
    return got.select(*VOXEL, r("cope", 5).alias("cope"), r("stat", 5).alias("stat"))


# ------------------------------------------------------------------ permutation

SIGNS = np.array([[1] * T] + [[1 if (s * 7 + p * 13 + s * p % 5) % 2 else -1 for s in range(T)] for p in range(1, 32)])
PERMS = np.array([[s for s in range(T)]] + [[(s * 5 + 7 * p) % T for s in range(T)] for p in range(1, 16)])
SIGN_SQL = f"(SELECT a.range AS p, b.range AS t, CASE WHEN a.range = 0 OR (b.range * 7 + a.range * 13 + b.range * a.range % 5) % 2 = 1 THEN 1 ELSE -1 END AS w FROM range({len(SIGNS)}) a, range({T}) b) AS sg"
PERM_SQL = f"(SELECT a.range AS p, b.range AS t, CASE WHEN a.range = 0 THEN b.range ELSE (b.range * 5 + 7 * a.range) % {T} END AS s FROM range({len(PERMS)}) a, range({T}) b) AS pm"
FLIP = f"""cen AS (SELECT x, y, z, t, v - (SELECT sum(v) FROM vox) / {W * H * D * T} AS v FROM vox),
fl AS (SELECT p, x, y, z, sum(v * w) / {T} AS b, sum(v * v) AS ss FROM cen JOIN {SIGN_SQL} USING (t) GROUP BY p, x, y, z),
tv AS (SELECT p, x, y, z, b / sqrt((ss - {T} * b * b) / {T - 1} / {T}) AS v FROM fl)"""


def centred(v: DataFrame) -> DataFrame:
    mean = v.agg((F.sum("v") / (W * H * D * T)).alias("mean"))
    return v.join(F.broadcast(mean)).select(*VOXEL, "t", (F.col("v") - F.col("mean")).alias("v"))


@query(f"WITH {VOX}, {FLIP} SELECT CAST(p AS INT) AS p, x, y, z, round(v, 6) + 0.0 AS v FROM tv")
def p1_sign_flip_t(spark, d):
    return _rounded(permutation.permuted_maps(centred(vox(spark, d)), permutation.group_mean_t, SIGNS))


_PX = f"(SELECT pm.p, pm.t, x0, x1, x2, p0, p1, p2 FROM {PERM_SQL} JOIN {X_SQL} ON x.t = pm.s JOIN {P_SQL} ON p.t = pm.s)"
PERM = f"""px AS (SELECT * FROM {_PX}), pf AS (SELECT p, x, y, z, sum(v * p0) AS b0, sum(v * p1) AS b1, sum(v * p2) AS b2 FROM vox JOIN px USING (t) GROUP BY p, x, y, z),
pe AS (SELECT pf.p, vox.x, vox.y, vox.z, b0, b1, b2, sum((v - b0 * x0 - b1 * x1 - b2 * x2) ^ 2) / {T - 3} AS var FROM vox JOIN pf USING (x, y, z) JOIN px ON px.p = pf.p AND px.t = vox.t GROUP BY ALL)"""


@query(f"WITH {VOX}, {PERM} SELECT CAST(p AS INT) AS p, x, y, z, round(b0 / sqrt(var * {_TS}), 5) + 0.0 AS v FROM pe")
def p2_permuted_t(spark, d):
    out = permutation.permuted_maps(vox(spark, d), lambda ys, part: permutation.design_t(ys, X, C, part), PERMS)
    return out.withColumn("v", r("v", 5))


@query(f"WITH {VOX}, {PERM} SELECT CAST(p AS INT) AS p, x, y, z, round((b0 * b0 * {FM00} + 2 * b0 * b2 * {FM01} + b2 * b2 * {FM11}) / (var * 2), 5) AS v FROM pe")
def p3_permuted_f(spark, d):
    out = permutation.permuted_maps(vox(spark, d), lambda ys, part: permutation.design_f(ys, X, CF, part), PERMS)
    return out.withColumn("v", r("v", 5))


def null(spark, d):
    return permutation.null_of_max(centred(vox(spark, d)), permutation.group_mean_t, SIGNS)


@query(f"WITH {VOX}, {FLIP} SELECT CAST(p AS INT) AS p, round(max(v), 6) AS max_stat FROM tv GROUP BY p")
def p10_null_of_max(spark, d):
    return _rounded(null(spark, d))


_R = "round(v, 6)"


@query(f"WITH {VOX}, {FLIP}, nl AS (SELECT p, round(max(v), 6) AS m FROM tv GROUP BY p) SELECT x, y, z, round(v, 6) + 0.0 AS v, (SELECT count(*) FROM nl WHERE nl.m < round(tv.v, 6)) / {len(SIGNS)}.0::DOUBLE AS one_minus_p FROM tv WHERE p = 0")
def p11_p_map(spark, d):
    stats = _rounded(permutation.permuted_maps(centred(vox(spark, d)), permutation.group_mean_t, SIGNS[:1])).drop("p")
    return permutation.p_map(stats, _rounded(null(spark, d)))


_FOUND = f"""sd AS (SELECT p, x, y, z, v, x + y * {W} + z * {W * H} AS id FROM tv WHERE v > 1.0),
ed AS (SELECT a.p, a.id AS a, b.id AS b FROM sd a JOIN sd b ON a.p = b.p AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
rc AS (SELECT p, id AS a, id AS b FROM sd UNION SELECT rc.p, rc.a, ed.b FROM rc JOIN ed ON rc.p = ed.p AND rc.b = ed.a),
lb AS (SELECT p, a AS id, min(b) AS cluster FROM rc GROUP BY p, a),
st AS (SELECT p, cluster, count(*) AS size, sum(v) AS mass FROM sd JOIN lb USING (p, id) GROUP BY p, cluster),
nl AS (SELECT range AS p, round(coalesce(max(what), 0.0), 6) AS m FROM range({len(SIGNS)}) LEFT JOIN st ON st.p = range GROUP BY range),
one AS (SELECT x, y, z, round(coalesce(what, 0.0), 6) AS v FROM tv LEFT JOIN (SELECT sd.x, sd.y, sd.z, what FROM sd JOIN lb USING (p, id) JOIN st USING (p, cluster) WHERE sd.p = 0) USING (x, y, z) WHERE tv.p = 0)"""


def _cluster_p_sql(what: str) -> str:
    return f"WITH RECURSIVE {VOX}, {FLIP}, {_FOUND.replace('what', what)} SELECT x, y, z, v, (SELECT count(*) FROM nl WHERE nl.m < one.v) / {len(SIGNS)}.0::DOUBLE AS one_minus_p FROM one"


def _cluster_p(spark, d, what):
    """Every voxel: 0 below the level, else the size or mass of its cluster, against the largest of each permutation."""
    v, statistic = centred(vox(spark, d)), permutation.group_mean_t
    null = permutation.null_of_clusters(v, statistic, SIGNS, 1.0, W, H, what)
    sized = permutation.cluster_map(v, lambda ys: statistic(ys, SIGNS[:1]), 1.0, W, H, what)
    return permutation.p_map(_rounded(sized), _rounded(null))


@query(_cluster_p_sql("size"))
def p12_extent_p_map(spark, d):
    return _cluster_p(spark, d, "size")


@query(_cluster_p_sql("mass"))
def p13_mass_p_map(spark, d):
    return _cluster_p(spark, d, "mass")


@query(f"WITH {VOX}, {FLIP}, nl AS (SELECT max(v) AS m, row_number() OVER (ORDER BY max(v)) AS k FROM tv GROUP BY p) SELECT round(m, 6) AS level FROM nl WHERE k = {round(0.95 * len(SIGNS))}")
def p14_significance_level(spark, d):
    return _rounded(permutation.significance_level(null(spark, d)))


# ------------------------------------------------------------------ clusters

SEEDS = f"{MEAN}, lv AS (SELECT avg(v) * 1.15 AS h FROM mean), seed AS (SELECT x, y, z, v, CAST(x + y * {W} + z * {W * H} AS BIGINT) AS id FROM mean, lv WHERE v > h)"
COMP = """edge AS (SELECT a.id AS a, b.id AS b FROM seed a JOIN seed b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
reach AS (SELECT id AS a, id AS b FROM seed UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
lab AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a)"""


def _clustered(spark, d):
    m = summed(vox(spark, d))
    level = m.agg(F.avg("v") * 1.15).first()[0]
    return spatial.clusters(m, level, W, H)


@query(f"WITH {VOX}, {SEEDS} SELECT mean.x, mean.y, mean.z, coalesce(seed.id, {3 * W * H * D}) AS label FROM mean LEFT JOIN seed USING (x, y, z)")
def c1_seed_labels(spark, d):
    m = summed(vox(spark, d))
    level = m.agg((F.avg("v") * 1.15).alias("level"))
    own = (F.col("x") + F.col("y") * W + F.col("z") * W * H).cast("long")
    return m.join(F.broadcast(level)).select(*VOXEL, F.when(F.col("v") > F.col("level"), own).otherwise(F.lit(3 * W * H * D).cast("long")).alias("label"))


@query(f"WITH RECURSIVE {VOX}, {SEEDS}, {COMP} SELECT x, y, z, v, cluster FROM seed JOIN lab USING (id)")
def c2_clusters(spark, d):
    return _clustered(spark, d)


@query(f"WITH RECURSIVE {VOX}, {SEEDS}, {COMP} SELECT cluster, count(*) AS size, sum(v) AS mass FROM seed JOIN lab USING (id) GROUP BY cluster")
def a8_cluster_sizes(spark, d):
    return spatial.cluster_stats(_clustered(spark, d))


@query(f"WITH RECURSIVE {VOX}, {SEEDS}, {COMP} SELECT max(n) AS largest FROM (SELECT count(*) AS n FROM seed JOIN lab USING (id) GROUP BY cluster)")
def a10_largest_cluster(spark, d):
    return spatial.cluster_stats(_clustered(spark, d)).agg(F.max("size").alias("largest"))


_TFCE = f"""hs AS (SELECT range AS k, (SELECT avg(v) FROM mean) + range * ((SELECT max(v) FROM mean) - (SELECT avg(v) FROM mean)) / 5 AS h FROM range(5)),
sd AS (SELECT k, h, x, y, z, x + y * {W} + z * {W * H} AS id FROM mean, hs WHERE v > h),
ed AS (SELECT a.k, a.id AS a, b.id AS b FROM sd a JOIN sd b ON a.k = b.k AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
rc AS (SELECT k, id AS a, id AS b FROM sd UNION SELECT rc.k, rc.a, ed.b FROM rc JOIN ed ON rc.k = ed.k AND rc.b = ed.a),
lb AS (SELECT k, a AS id, count(*) AS extent FROM rc GROUP BY k, a)"""


@query(f"WITH RECURSIVE {VOX}, {MEAN}, {_TFCE} SELECT x, y, z, round(sum(sqrt(extent) * h * h) / 1e6, 5) AS v FROM sd JOIN lb USING (k, id) GROUP BY x, y, z")
def p15_tfce(spark, d):
    m = summed(vox(spark, d))
    low, high = m.agg(F.avg("v"), F.max("v")).first()
    got = spatial.tfce(m, [low + k * (high - low) / 5 for k in range(5)], W, H)
    return got.select(*VOXEL, F.round(F.col("v") / 1e6, 5).alias("v"))


# ------------------------------------------------------------------ spatial


@query(f"WITH {VOX}, {smooth_sql('vox', 's', 't')} SELECT x, y, z, t, round(v, 6) AS v FROM s")
def f1_smoothing(spark, d):
    return _rounded(spatial.smooth(vox(spark, d), KERNEL))


@query(f"SELECT CAST(o AS INT) AS o, round(w, 9) AS w FROM {KSQL}")
def f2_gaussian(spark, d):
    return spark.createDataFrame([(k - 4, float(w)) for k, w in enumerate(KERNEL)], "o int, w double").withColumn("w", F.round("w", 9))


@query(f"WITH {VOX}, {MASK}, {V0}, {smooth_sql('v0', 's', mask='mask')} SELECT x, y, z, round(v, 6) AS v FROM s")
def f3_normalised_smoothing(spark, d):
    v = vox(spark, d)
    return _rounded(spatial.smooth(volume(v, 0), KERNEL, brain(v)))


#: Multiples of pi / 3, so that no result lies on a rounding tie.
AFFINE = tuple(k * np.pi / 3 for k in (0.51, -0.25, 0.3, 0.05, 0.01, 0.0, -0.02, 0.03, 0.0, 0.0, 0.01, -0.04))


def gather_sql(places: str, taps: int = 2) -> str:
    """Trilinear or nearest values of v0 at CTE ``pl`` (x, y, z, sx, sy, sz)."""
    clamp = ", ".join(f"least(greatest(s{k}, 0.0), {n - 1}.0) AS s{k}" for k, n in zip("xyz", SIZE))
    if taps == 1:
        cells = ", ".join(f"CAST(floor(s{k} + 0.5) AS INT) AS i{k}" for k in "xyz") + ", 1.0::DOUBLE AS w"
        return f"pl AS ({places}), pc AS (SELECT x, y, z, {clamp} FROM pl), tp AS (SELECT x, y, z, {cells} FROM pc)"
    if taps == 2:
        offsets = "(SELECT a.range AS ox, b.range AS oy, c.range AS oz FROM range(2) a, range(2) b, range(2) c)"
        weight = " * ".join(f"(CASE WHEN o{k} = 1 THEN s{k} - floor(s{k}) ELSE 1 - (s{k} - floor(s{k})) END)" for k in "xyz")
    else:
        offsets = "(SELECT a.range - 1 AS ox, b.range - 1 AS oy, c.range - 1 AS oz FROM range(4) a, range(4) b, range(4) c)"
        d = {k: f"(s{k} - floor(s{k}))" for k in "xyz"}
        weight = " * ".join(f"(CASE o{k} WHEN -1 THEN (1 - {d[k]}) ^ 3 / 6 WHEN 0 THEN (4 + 3 * {d[k]} ^ 2 * ({d[k]} - 2)) / 6 WHEN 1 THEN (4 + 3 * (1 - {d[k]}) ^ 2 * ((1 - {d[k]}) - 2)) / 6 ELSE {d[k]} ^ 3 / 6 END)" for k in "xyz")
    cells = ", ".join(f"CAST(least(greatest(floor(s{k}) + o{k}, 0), {n - 1}) AS INT) AS i{k}" for k, n in zip("xyz", SIZE))
    return f"pl AS ({places}), pc AS (SELECT x, y, z, {clamp} FROM pl), tp AS (SELECT x, y, z, {cells}, {weight} AS w FROM pc, {offsets})"


_GATHER = " SELECT tp.x, tp.y, tp.z, round(sum(v0.v * w), 6) + 0.0 AS v FROM tp JOIN v0 ON tp.ix = v0.x AND tp.iy = v0.y AND tp.iz = v0.z GROUP BY tp.x, tp.y, tp.z"
_MOVE = ", ".join(f"{k} + {num(AFFINE[i])} + " + " + ".join(f"{num(AFFINE[3 + 3 * i + j])} * ({o} - {(n - 1) / 2})" for j, (o, n) in enumerate(zip("xyz", SIZE))) + f" AS s{k}" for i, k in enumerate("xyz"))


def _affine(mode):
    def run(spark, d):
        places = spatial.affine_places(grid.grid(spark, W, H, D), AFFINE, SIZE)
        return _rounded(spatial.gather(volume(vox(spark, d), 0), places, SIZE, mode))

    return run


for _n, _mode, _taps in (("r9_affine_nearest", "nearest", 1), ("r9_affine_trilinear", "linear", 2), ("r9_affine_cubic", "cubic", 4)):
    QUERIES[_n] = _affine(_mode)
    SQL[_n] = f"WITH {VOX}, {V0}, {gather_sql(f'SELECT x, y, z, {_MOVE} FROM v0', _taps)}" + _GATHER

_FIELD = {"x": "0.1 * y - 0.4", "y": "0.2 * z", "z": "0.05 * x"}


def field(spark):
    c = grid.grid(spark, W, H, D)
    return c.select(*VOXEL, *(F.expr(e.replace("0.1", "0.1D").replace("0.4", "0.4D").replace("0.2", "0.2D").replace("0.05", "0.05D")).alias(f"u{k}") for k, e in _FIELD.items()))


_FPLACE = ", ".join(f"{k} + ({e}) AS s{k}" for k, e in _FIELD.items()).replace("0.1 ", "0.1e0 ").replace("0.4", "0.4e0").replace("0.2 ", "0.2e0 ").replace("0.05 ", "0.05e0 ")


@query(f"WITH {VOX}, {V0}, {gather_sql(f'SELECT x, y, z, {_FPLACE} FROM v0')}" + _GATHER)
def r10_field_trilinear(spark, d):
    return _rounded(spatial.gather(volume(vox(spark, d), 0), spatial.field_places(field(spark)), SIZE))


@query(f"WITH g AS (SELECT CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, CAST(c.range AS INT) AS z FROM range({W}) a, range({H}) b, range({D}) c), s AS (SELECT x, y, z, {_MOVE}, {', '.join(f'{e} AS u{k}' for k, e in _FIELD.items())} FROM g) SELECT x, y, z, {', '.join(f'round(u{k} + s{k} - {k}, 6) + 0.0 AS u{k}' for k in 'xyz')} FROM s")
def r11_add_affine(spark, d):
    return _rounded(spatial.add_affine(field(spark), AFFINE, SIZE))


@query(f"WITH {VOX}, {V0}, {gather_sql('SELECT x, y, z, x * 0.5e0 AS sx, y * 0.75e0 AS sy, z * 0.9e0 AS sz FROM v0')}" + _GATHER)
def r12_rescale(spark, d):
    return _rounded(spatial.gather(volume(vox(spark, d), 0), spatial.scale_places(grid.grid(spark, W, H, D), (0.5, 0.75, 0.9)), SIZE))


@query(f"WITH {VOX}, {V0} SELECT x - 1 AS x, y - 2 AS y, z - 2 AS z, v FROM v0 WHERE x BETWEEN 1 AND 8 AND y BETWEEN 2 AND 7 AND z >= 2")
def r13_crop(spark, d):
    return spatial.fit_grid(volume(vox(spark, d), 0), SIZE, (8, 6, 5), z_bottom=True)


# ------------------------------------------------------------------ registration


def _complex(spark, d):
    v = vox(spark, d)
    out = None
    for t, name in ((0, "re1"), (1, "im1"), (2, "re2"), (3, "im2")):
        part = volume(v, t).withColumn("v", F.col("v") - 10).withColumnRenamed("v", name)
        out = part if out is None else out.join(part, VOXEL)
    return out


CPX = "cx AS (SELECT x, y, z, " + ", ".join(f"max(v - 10) FILTER (WHERE t = {t}) AS {n}" for t, n in ((0, "re1"), (1, "im1"), (2, "re2"), (3, "im2"))) + " FROM vox WHERE t < 4 GROUP BY x, y, z)"
PHASE = f"{CPX}, pq AS (SELECT *, re1 * re2 + im1 * im2 AS pr, im1 * re2 - re1 * im2 AS pi FROM cx), ph AS (SELECT x, y, z, atan2(pi, pr) AS d, sqrt(pr * pr + pi * pi) * cos(atan2(pi, pr) / 2) ^ 2 AS c FROM pq)"


@query(f"WITH {VOX}, {PHASE} SELECT x, y, z, round(d, 6) + 0.0 AS d, round(c, 6) + 0.0 AS c FROM ph")
def r1_phase(spark, d):
    diff, cert = registration.phase()
    return _rounded(_complex(spark, d).select(*VOXEL, diff.alias("d"), cert.alias("c")))


def _grad_sql(axis: str) -> str:
    others = ", ".join(k for k in "xyz" if k != axis)
    re, im = [], []
    for k in "12":
        a, b, na, nb, pa, pb = f"re{k}", f"im{k}", f"lead(re{k}) OVER w", f"lead(im{k}) OVER w", f"lag(re{k}) OVER w", f"lag(im{k}) OVER w"
        re.append(f"{na} * {a} + {nb} * {b} + {a} * {pa} + {b} * {pb}")
        im.append(f"{nb} * {a} - {na} * {b} + {b} * {pa} - {a} * {pb}")
    return f"SELECT x, y, z, atan2({' + '.join(im)}, {' + '.join(re)}) AS g FROM cx WINDOW w AS (PARTITION BY {others} ORDER BY {axis})"


@query(f"WITH {VOX}, {CPX}, g AS ({_grad_sql('x')}) SELECT x, y, z, round(g, 6) + 0.0 AS g FROM g WHERE g IS NOT NULL")
def r2_phase_gradient(spark, d):
    return _rounded(registration.phase_gradient(_complex(spark, d), "x"))


_SUMS = [f"round(sum(CASE WHEN axis = {a} THEN c ELSE 0 END * g * g * ({q})), 3) AS a{a}_{n}" for a in range(3) for n, q in (("1", "1"), ("x", "x"), ("y", "y"), ("z", "z"), ("xx", "x*x"), ("xy", "x*y"), ("xz", "x*z"), ("yy", "y*y"), ("yz", "y*z"), ("zz", "z*z"))]
_SUMS += [f"round(sum(CASE WHEN axis = {a} THEN c ELSE 0 END * g * d * ({q})), 3) + 0.0 AS h{a}_{n}" for a in range(3) for n, q in (("1", "1"), ("x", "x"), ("y", "y"), ("z", "z"))]


@query(f"WITH {VOX}, {PHASE}, " + ", ".join(f"g{i} AS ({_grad_sql(k)})" for i, k in enumerate("xyz")) + ", al AS (" + " UNION ALL ".join(f"SELECT {i} AS axis, * FROM g{i} WHERE g IS NOT NULL" for i in range(3)) + f"), rows AS (SELECT axis, x - {(W - 1) / 2}::DOUBLE AS x, y - {(H - 1) / 2}::DOUBLE AS y, z - {(D - 1) / 2}::DOUBLE AS z, g, d, c / 1000 AS c FROM al JOIN ph USING (x, y, z)) SELECT {', '.join(_SUMS)} FROM rows")
def r3_normal_equations(spark, d):
    c = _complex(spark, d)
    diff, cert = registration.phase()
    ph = c.select(*VOXEL, diff.alias("d"), (cert / 1000).alias("c"))
    rows = None
    for i, k in enumerate(VOXEL):
        part = registration.phase_gradient(c, k).join(ph, VOXEL).withColumn("axis", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.select("axis", "g", "d", "c", *((F.col(k) - (n - 1) / 2).alias(k) for k, n in zip(VOXEL, SIZE)))
    out = registration.normal_equations(rows)
    return out.select(*((F.round(k, 3) + 0.0).alias(k) for k in out.columns))


def _six(spark, d, names):
    v = vox(spark, d)
    return v.where("t < 9").groupBy(*VOXEL).agg(*(F.max(F.when(F.col("t") == t, F.col("v"))).alias(n) for t, n in enumerate(names)))


def _six_sql(names):
    return "sx AS (SELECT x, y, z, " + ", ".join(f"max(v) FILTER (WHERE t = {t}) AS {n}" for t, n in enumerate(names)) + " FROM vox WHERE t < 9 GROUP BY x, y, z)"


_TN = ("t11", "t12", "t13", "t22", "t23", "t33")


@query(f"WITH {VOX}, {_six_sql(_TN)} SELECT x, y, z, round(sqrt(t11 * t11 + t22 * t22 + t33 * t33 + 2 * (t12 * t12 + t13 * t13 + t23 * t23)), 6) AS norm FROM sx")
def r6_tensor_norm(spark, d):
    return _rounded(_six(spark, d, _TN).select(*VOXEL, registration.tensor_norm().alias("norm")))


_SN = ("a11", "a12", "a13", "a22", "a23", "a33", "h1", "h2", "h3")
_DET = "(a11 * (a22 * a33 - a23 * a23) + a12 * (a13 * a23 - a12 * a33) + a13 * (a12 * a23 - a13 * a22))"


@query(
    f"WITH {VOX}, {_six_sql(_SN)}, dt AS (SELECT *, {_DET} AS det FROM (SELECT x, y, z, a11 + 200 AS a11, a12, a13, a22 + 200 AS a22, a23, a33 + 200 AS a33, h1, h2, h3 FROM sx)) SELECT x, y, z, "
    + ", ".join(
        f"round(coalesce((({p}) * h1 + ({q}) * h2 + ({s}) * h3) / CASE WHEN abs(det) > 1e-12 THEN det END, 0.0), 6) + 0.0 AS {n}"
        for n, p, q, s in (
            ("ux", "a22 * a33 - a23 * a23", "a13 * a23 - a12 * a33", "a12 * a23 - a13 * a22"),
            ("uy", "a13 * a23 - a12 * a33", "a11 * a33 - a13 * a13", "a12 * a13 - a11 * a23"),
            ("uz", "a12 * a23 - a13 * a22", "a12 * a13 - a11 * a23", "a11 * a22 - a12 * a12"),
        )
    )
    + " FROM dt"
)
def r8_displacement_update(spark, d):
    s = _six(spark, d, _SN)
    s = s.withColumns({k: F.col(k) + 200 for k in ("a11", "a22", "a33")})
    ux, uy, uz = registration.displacement_update()
    return _rounded(s.select(*VOXEL, ux.alias("ux"), uy.alias("uy"), uz.alias("uz")))


@query()
def r17_motion_correction(spark, d):
    v = vox(spark, d)
    out = registration.motion_correct(v, SIZE)
    return out.groupBy("t").agg(F.avg("v").alias("v"), *(F.max(f"p{k}").alias(f"p{k}") for k in range(6)))


# ------------------------------------------------------------------ learning


@query()
def m1_pca(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    p = learning.pca(e, 0.8)
    return learning.project(e, p["whiten"], p["mean"], ["vec_id"]).select("vec_id", F.posexplode("s").alias("component", "score"))


_DIMS = "f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS k FROM embeddings), c AS (SELECT a.k AS i, b.k AS j, covar_samp(a.v, b.v) AS c FROM f a JOIN f b USING (vec_id) GROUP BY a.k, b.k)"


@query(f"WITH {_DIMS} SELECT count(DISTINCT i) AS components, round(sum(c) FILTER (WHERE i = j), 6) AS total, round(sum(c * c), 6) AS squares FROM c")
def m1_variances(spark, d):
    """All components: their number, the sum of their variances (the covariance's trace) and that of the squares (its norm)."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    v = learning.pca(e, 1.0)["values"]
    return spark.createDataFrame([(len(v), round(float(v.sum()), 6), round(float((v**2).sum()), 6))], "components bigint, total double, squares double")


@query()
def m2_ica(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    p = learning.pca(e, 0.8)
    w = learning.infomax_rows(learning.project(e, p["whiten"], p["mean"], ["vec_id"]), len(p["values"]))
    return learning.project(e, w @ p["whiten"], p["mean"], ["vec_id"]).select("vec_id", F.posexplode("s").alias("component", "source"))


def _m4_sql(epochs: int = 20) -> str:
    """Leave-one-out training, an epoch a pair of tables: errors of each left-out volume's weights, then the weights after one step."""
    inner = " AND ".join(f"v.{k} BETWEEN 1 AND {n - 2}" for k, n in zip("xyz", SIZE))
    zs = "CASE WHEN stddev_samp(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_samp(v) OVER w ELSE 0.0 END"
    steps = [f"w0 AS MATERIALIZED (SELECT DISTINCT x, y, z, i, range AS o, 0e0 AS w FROM ft, range({T}))"]
    for k in range(epochs):
        steps.append(f"e{k} AS MATERIALIZED (SELECT x, y, z, o, t, sum(w * v) - any_value(d) AS e FROM w{k} JOIN ft USING (x, y, z, i) WHERE t <> o GROUP BY x, y, z, o, t)")
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT x, y, z, i, o, any_value(w) - 0.01 / {T} * sum(e * v) AS w FROM w{k} JOIN ft USING (x, y, z, i) JOIN e{k} USING (x, y, z, o, t) GROUP BY x, y, z, i, o)")
    return f"""WITH {VOX}, zs AS (SELECT x, y, z, t, {zs} AS v, CASE WHEN t // 4 % 2 = 0 THEN 1 ELSE -1 END AS d FROM vox WINDOW w AS (PARTITION BY x, y, z)),
nb AS (SELECT a.range - 1 AS dx, b.range - 1 AS dy, c.range - 1 AS dz, row_number() OVER () AS i FROM range(3) a, range(3) b, range(3) c WHERE abs(a.range - 1) + abs(b.range - 1) + abs(c.range - 1) <= 2),
ft AS MATERIALIZED (SELECT v.x, v.y, v.z, i, n.t, n.v, n.d FROM (SELECT DISTINCT x, y, z FROM vox) v, nb JOIN zs n ON n.x = v.x + dx AND n.y = v.y + dy AND n.z = v.z + dz WHERE {inner} UNION ALL SELECT x, y, z, 0, t, 1e0, d FROM zs v WHERE {inner}),
{', '.join(steps)},
ok AS (SELECT x, y, z, o, (sum(w * v) > 0) = (any_value(d) > 0) AS hit FROM w{epochs} JOIN ft USING (x, y, z, i) WHERE t = o GROUP BY x, y, z, o),
ac AS (SELECT x, y, z, count(*) FILTER (WHERE hit) / {T} AS accuracy FROM ok GROUP BY x, y, z)
SELECT v.x, v.y, v.z, round(coalesce(accuracy, 0.0), 6) AS accuracy FROM (SELECT DISTINCT x, y, z FROM vox) v LEFT JOIN ac USING (x, y, z)"""


@query(_m4_sql())
def m4_searchlight(spark, d):
    packed = glm.pack(grid.zscore(vox(spark, d)))
    return _rounded(learning.searchlight(packed, [int(t // 4 % 2) for t in range(T)], SIZE))


@query()
def m5_gibbs(spark, d):
    return learning.gibbs(glm.pack(grid.zscore(vox(spark, d))), X[:, :2] - [[0.5, 0]], draws=1000, burn=100)


@query(f"WITH {VOX} SELECT x, y, max(v) AS v FROM vox WHERE t = 0 GROUP BY x, y")
def v1_projection(spark, d):
    """Maximum-intensity projection along z."""
    return volume(vox(spark, d), 0).groupBy("x", "y").agg(F.max("v").alias("v"))


@query(f"WITH {VOX} SELECT x, y, CAST(least(greatest((v + 1) * 2, 0), 255) AS INT) AS v FROM vox WHERE t = 0 AND z = 3")
def v2_slice(spark, d):
    return volume(vox(spark, d), 0).where("z = 3").select("x", "y", F.least(F.greatest((F.col("v") + 1) * 2, F.lit(0.0)), F.lit(255.0)).cast("int").alias("v"))

