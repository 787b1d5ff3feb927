"""More queries of the volume operators: nuisance handling, first-level permutation, filtering, affine algebra, registration over scales.

They join those of ``queries`` in the same tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import design, glm, grid, permutation, registration, spatial, temporal
from ..operators.grid import VOXEL
from ..sources import text
from .queries import (
    _AR, _GATHER, _TS, _VAR, AFFINE, C, CF, CPX, FIT, FM00, FM01, FM11, P_SQL, PERM_SQL, PERMS, PINV, QUERIES, SIZE, SQL, TASK, V0, VOX, X, X_SQL, D, H, T, W,
    _complex, _grad_sql, _rounded, ar_sql, field, gather_sql, num, pinv_sql, query, r, summed, values, volume, vox,
)

__all__ = ["QUERIES", "SQL"]

# ------------------------------------------------------------------ nuisance and contrasts

_TREND = temporal.trends(T, 4)
# Powers of a centred time, made orthogonal: odd and even ones don't overlap.
_ORTHO = f"""n AS (SELECT range AS t, (range - {(T - 1) / 2}e0) / {(T - 1) / 2}e0 AS s FROM range({T})), m AS (SELECT avg(s ^ 2) AS m2, sum(s ^ 4) / sum(s ^ 2) AS k FROM n),
q AS (SELECT t, 1e0 AS q0, s AS q1, s ^ 2 - m2 AS q2, s ^ 3 - k * s AS q3 FROM n, m), z AS (SELECT {', '.join(f'sum(q{k} * q{k}) AS z{k}' for k in range(4))} FROM q)"""


@query(
    f"WITH {VOX}, {_ORTHO}, f AS (SELECT x, y, z, {', '.join(f'sum(v * q{k}) / any_value(z{k}) AS b{k}' for k in range(4))} FROM vox JOIN q USING (t), (SELECT {', '.join(f'z{k}' for k in range(4))} FROM z) zz GROUP BY x, y, z) "
    f"SELECT x, y, z, t, round(v - ({' + '.join(f'b{k} * q{k}' for k in range(4))}), 6) + 0.0 AS v FROM vox JOIN f USING (x, y, z) JOIN q USING (t)"
)
def w6_detrend(spark, d):
    return _rounded(glm.detrend(vox(spark, d), _TREND))


@query(f"WITH {VOX}, {FIT}, g AS (SELECT t, avg(v) AS v FROM vox GROUP BY t) SELECT CAST(t AS INT) AS t, round(x0, 9) + 0.0 AS task, round(g.v, 6) AS global_mean FROM g JOIN {X_SQL} USING (t)")
def g6_nuisance(spark, d):
    """The task regressor and the global mean that is appended to the design."""
    means = vox(spark, d).groupBy("t").agg(F.avg("v").alias("v")).orderBy("t").toPandas()["v"].to_numpy()  # one number a volume
    x, _ = design.with_nuisance(TASK[:, None], np.array([1.0]), means)
    return spark.createDataFrame([(t, float(round(a, 9)), float(b)) for t, (a, b) in enumerate(x)], "t int, task double, global_mean double").withColumn("global_mean", r("global_mean"))


def _matrix(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "i int, j int, v double")


_EYE3 = "SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, CASE WHEN a.range = b.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range({0}) a, range({0}) b"


def _product(a, b):
    right = b.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("v").alias("w"))
    return _rounded(a.join(right, F.col("j") == F.col("k")).groupBy("i", F.col("l").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v")))


@query(_EYE3.format(3))
def g8_pseudo_inverse(spark, d):
    """The pseudo-inverse times its design: the identity."""
    return _product(_matrix(spark, PINV), _matrix(spark, X))


@query(f"SELECT round(sum(p0 * p0), 9) AS v FROM {P_SQL}")
def g9_t_scalar(spark, d):
    return spark.createDataFrame([(design.t_scalar(X, C),)], "v double").select(F.round("v", 9).alias("v"))


@query(f"WITH m AS (SELECT sum(p0 * p0) AS a, sum(p0 * p2) AS b, sum(p2 * p2) AS c FROM {P_SQL}) SELECT round(c / (a * c - b * b), 6) AS m00, round(-b / (a * c - b * b), 6) + 0.0 AS m01, round(a / (a * c - b * b), 6) AS m11 FROM m")
def g10_f_matrix(spark, d):
    m = design.f_matrix(X, CF)
    return _rounded(spark.createDataFrame([(float(m[0, 0]), float(m[0, 1]), float(m[1, 1]))], "m00 double, m01 double, m11 double"))


_SETUPS = "FROM range(1, 4) a, range(2) b, range(5) c, range(1, 4) d, range(2) e, range(2) f"


@query(f"SELECT a.range AS r, b.range AS derivatives, c.range AS trends, d.range AS runs, e.range AS motion, f.range AS global_mean, a.range * CASE WHEN b.range = 1 THEN 2 ELSE 1 END + c.range * d.range + CASE WHEN e.range = 1 THEN 6 ELSE 0 END + f.range AS n {_SETUPS}")
def g12_total_regressors(spark, d):
    """The columns of every design that a first-level analysis may set up."""
    from itertools import product

    rows = [(*map(int, k), int(design.total_regressors(k[0], bool(k[1]), k[2], k[3], bool(k[4]), bool(k[5])))) for k in product(range(1, 4), range(2), range(5), range(1, 4), range(2), range(2))]
    return spark.createDataFrame(rows, "r bigint, derivatives bigint, trends bigint, runs bigint, motion bigint, global_mean bigint, n bigint")


@query(f"WITH {VOX}, {FIT} SELECT x, y, z, round(b0, 6) + 0.0 AS effective FROM fit")
def k10_partitioned_design(spark, d):
    """The effective part's beta in the partitioned design, which is the contrast of the whole one."""
    effective, nuisance = design.partition(X, C)
    return _rounded(glm.betas(vox(spark, d), np.column_stack([effective, nuisance])).select(*VOXEL, F.col("b0").alias("effective")))


def _constant_ar(spark):
    return grid.grid(spark, W, H, D).select(*VOXEL, *(F.lit(a).alias(f"a{k}") for k, a in enumerate(_AR, 1)))


# The design whitened as the data are, without the four volumes that lack lags.
_WX_SQL = f"(SELECT t, {', '.join(f'x{i}' + ''.join(f' - coalesce({num(a)} * lag(x{i}, {k}) OVER (ORDER BY t), 0)' for k, a in enumerate(_AR, 1)) + f' AS x{i}' for i in range(3))} FROM {X_SQL})"
_WHITE = "wh AS (SELECT x, y, z, t, v" + "".join(f" - coalesce({num(a)} * lag(v, {k}) OVER w, 0)" for k, a in enumerate(_AR, 1)) + " AS v FROM vox WINDOW w AS (PARTITION BY x, y, z ORDER BY t))"


@query(f"WITH {VOX}, {_WHITE} SELECT x, y, z, {', '.join(f'round(sum(v * p{k}), 6) + 0.0 AS b{k}' for k in range(3))} FROM wh JOIN {pinv_sql(_WX_SQL, 't >= 4')} USING (t) GROUP BY x, y, z")
def k3_first_level_betas(spark, d):
    return _rounded(glm.voxel_betas(vox(spark, d), X, _constant_ar(spark)))


# ------------------------------------------------------------------ permutation

_SERIES = f"""pv AS (SELECT p, x, y, z, pm.t AS t, v FROM vox JOIN {PERM_SQL} ON vox.t = pm.s),
pf AS (SELECT p, x, y, z, sum(v * p0) AS b0, sum(v * p1) AS b1, sum(v * p2) AS b2 FROM pv JOIN {P_SQL} USING (t) GROUP BY p, x, y, z),
pe AS (SELECT p, x, y, z, b0, b2, var_samp(v - b0 * x0 - b1 * x1 - b2 * x2) AS var FROM pv JOIN pf USING (p, x, y, z) JOIN {X_SQL} USING (t) GROUP BY p, x, y, z, b0, b2)"""


@query(f"WITH {VOX}, {_SERIES} SELECT CAST(p AS INT) AS p, x, y, z, round(b0 / sqrt(var * {_TS}), 5) + 0.0 AS v FROM pe")
def p4_first_level_t(spark, d):
    return permutation.permuted_maps(vox(spark, d), lambda ys, part: permutation.first_level_t(ys, X, C, part), PERMS).withColumn("v", r("v", 5))


@query(f"WITH {VOX}, {_SERIES} SELECT CAST(p AS INT) AS p, x, y, z, round((b0 * b0 * {FM00} + 2 * b0 * b2 * {FM01} + b2 * b2 * {FM11}) / (var * 2), 5) + 0.0 AS v FROM pe")
def p5_first_level_f(spark, d):
    return permutation.permuted_maps(vox(spark, d), lambda ys, part: permutation.first_level_f(ys, X, CF, part), PERMS).withColumn("v", r("v", 5))


#: A group design over the nations, and contrasts: the mean, two groups, a slope, and both of those.
_GROUP = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 1.0, 1.0]]
_XC = " UNION ALL ".join(f"SELECT {k} AS contrast, {c[0]} + {c[1]} * CASE WHEN n_regionkey = 0 THEN 1 ELSE 0 END + {c[2]} * n_nationkey AS v FROM nation" for k, c in enumerate(_GROUP))
_KIND = "CASE count(DISTINCT v) WHEN 1 THEN 'mean' WHEN 2 THEN 'two_sample' ELSE 'correlation' END"


@query(
    f"WITH xc AS ({_XC}), k AS (SELECT contrast, {_KIND} AS kind FROM xc GROUP BY contrast UNION ALL SELECT -1, {_KIND} FROM xc WHERE contrast IN (0, 1)), g AS (SELECT count(*) AS n, count(*) FILTER (WHERE n_regionkey = 0) AS n1 FROM nation) "
    "SELECT CAST(contrast AS INT) AS contrast, kind, CASE kind WHEN 'mean' THEN 1 ELSE CAST(least(10000, CASE kind WHEN 'two_sample' THEN factorial(n::INT)::DOUBLE / factorial(n1::INT)::DOUBLE / factorial((n - n1)::INT)::DOUBLE ELSE factorial(n::INT)::DOUBLE END) AS BIGINT) END AS permutations FROM k, g"
)
def p6_classify(spark, d):
    """Kind and number of permutations of each contrast, and of an F of the first two (contrast -1)."""
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_regionkey", "n_nationkey").orderBy("n_nationkey").collect()  # the group's subjects
    x = np.array([[1.0, float(a == 0), float(b)] for a, b in rows])
    got = [(k, *plan) for k, plan in enumerate(permutation.plans(x, np.array(_GROUP), 10_000))] + [(-1, *permutation.plans(x, np.array(_GROUP[:2]), 10_000, joint=True)[0])]
    return spark.createDataFrame(got, "contrast int, kind string, permutations bigint")


@query("SELECT kind, n, round(c, 3) AS most FROM (SELECT 'mean' AS kind, range AS n, 2.0::DOUBLE ^ range AS c FROM range(2, 13) UNION ALL SELECT 'correlation', range, factorial(range::INT)::DOUBLE FROM range(2, 13) UNION ALL SELECT 'two_sample', range, factorial(range::INT)::DOUBLE / factorial((range // 2)::INT)::DOUBLE / factorial((range - range // 2)::INT)::DOUBLE FROM range(2, 13))")
def p7_most_permutations(spark, d):
    rows = [(k, n, float(round(permutation.most_permutations(k, n, n // 2), 3))) for k in ("mean", "two_sample", "correlation") for n in range(2, 13)]
    return spark.createDataFrame(rows, "kind string, n bigint, most double")


@query("SELECT CAST(a.range AS INT) AS p, CAST(b.range AS INT) AS s, CAST(1 - 2 * ((a.range >> b.range) & 1) AS INT) AS sign FROM range(64) a, range(6) b")
def p8_all_sign_flips(spark, d):
    t = permutation.sign_table(6, 64)
    return spark.createDataFrame([(p, s, int(t[p, s])) for p in range(64) for s in range(6)], "p int, s int, sign int")


_COLOUR = f"""dt AS (SELECT x, y, z, t, v - ({' + '.join(f'b{k} * q{k}' for k in range(4))}) AS v FROM vox JOIN (SELECT x, y, z, {', '.join(f'sum(v * q{k}) / any_value(z{k}) AS b{k}' for k in range(4))} FROM vox JOIN q USING (t), (SELECT {', '.join(f'z{k}' for k in range(4))} FROM z) zz GROUP BY x, y, z) f USING (x, y, z) JOIN q USING (t)),
{ar_sql('dt', 'ar')},
wl AS (SELECT x, y, z, t, v, {', '.join(f'lag(v, {k}, 0e0) OVER w AS l{k}' for k in range(1, 5))} FROM dt WINDOW w AS (PARTITION BY x, y, z ORDER BY t)),
wt AS (SELECT x, y, z, t, v - a1 * l1 - a2 * l2 - a3 * l3 - a4 * l4 AS v FROM wl JOIN ar USING (x, y, z)),
rc AS (SELECT pm.p, x, y, z, 0::BIGINT AS t, v AS y0, 0e0 AS y1, 0e0 AS y2, 0e0 AS y3 FROM wt JOIN {PERM_SQL} ON wt.t = pm.s WHERE pm.t = 0 UNION ALL
SELECT rc.p, rc.x, rc.y, rc.z, rc.t + 1, wt.v + a1 * y0 + a2 * y1 + a3 * y2 + a4 * y3, y0, y1, y2 FROM rc JOIN {PERM_SQL} ON pm.p = rc.p AND pm.t = rc.t + 1 JOIN wt ON wt.t = pm.s AND wt.x = rc.x AND wt.y = rc.y AND wt.z = rc.z JOIN ar ON ar.x = rc.x AND ar.y = rc.y AND ar.z = rc.z),
pf AS (SELECT p, x, y, z, sum(y0 * p0) AS b0, sum(y0 * p1) AS b1, sum(y0 * p2) AS b2 FROM rc JOIN (SELECT t, p0, p1, p2 FROM {P_SQL}) USING (t) GROUP BY p, x, y, z),
pe AS (SELECT p, x, y, z, b0, var_samp(y0 - b0 * x0 - b1 * x1 - b2 * x2) AS var FROM rc JOIN pf USING (p, x, y, z) JOIN {X_SQL} USING (t) GROUP BY p, x, y, z, b0)"""


@query(f"WITH RECURSIVE {VOX}, {_ORTHO}, {_COLOUR} SELECT CAST(p AS INT) AS p, round(max(b0 / sqrt(var * {_TS})), 5) AS max_stat FROM pe GROUP BY p")
def p9_first_level_null(spark, d):
    """Detrend, estimate, whiten, permute, colour again, fit: the null of the largest t."""
    v = glm.detrend(vox(spark, d), _TREND)
    ar = temporal.solve_ar(temporal.lag_products(v, T))
    return permutation.exchangeable_null(temporal.whiten(v, ar), ar, X, C, PERMS).withColumn("max_stat", r("max_stat", 5))


# ------------------------------------------------------------------ filtering, tensors

_THREE = registration.quadrature_filters(3)
# The filters by their definition: a discrete Fourier sum over 13 frequencies an axis, a log-normal radius around pi / 3 of two octaves, a squared cosine on one side.
_FSQL = f"""fq AS (SELECT (range - 6) * 2 * pi() / 13 AS w FROM range(13)), sp AS (SELECT a.w AS u, b.w AS v, c.w AS w, sqrt(a.w ^ 2 + b.w ^ 2 + c.w ^ 2) AS r FROM fq a, fq b, fq c WHERE a.w <> 0 OR b.w <> 0 OR c.w <> 0),
rd AS (SELECT *, exp(-(ln(r / (pi() / 3)) ^ 2) / ln(2)) AS g FROM sp), dr AS (SELECT f, u, v, w, g * greatest(CASE f WHEN 0 THEN u WHEN 1 THEN v ELSE w END / r, 0) ^ 2 AS h FROM rd, range(3) q(f)),
ps AS (SELECT a.range - 1 AS dx, b.range - 1 AS dy, c.range - 1 AS dz FROM range(3) a, range(3) b, range(3) c),
fl AS (SELECT f, dx, dy, dz, sum(h * cos(u * dx + v * dy + w * dz)) / 2197 AS re, sum(h * sin(u * dx + v * dy + w * dz)) / 2197 AS im FROM dr, ps WHERE h > 0 GROUP BY ALL)"""


@query(f"WITH {VOX}, {_FSQL} SELECT CAST(t AS INT) AS t, x + dx AS x, y + dy AS y, z + dz AS z, CAST(f AS INT) AS f, round(sum(vox.v * re), 5) + 0.0 AS re, round(sum(vox.v * im), 5) + 0.0 AS im FROM vox, fl WHERE x + dx BETWEEN 0 AND {W - 1} AND y + dy BETWEEN 0 AND {H - 1} AND z + dz BETWEEN 0 AND {D - 1} GROUP BY ALL")
def f4_quadrature(spark, d):
    got = registration.filter_series(vox(spark, d), SIZE, _THREE)
    return got.withColumns({k: F.round(k, 5) + 0.0 for k in ("re", "im")})


_IJ = [(i, j) for i in range(3) for j in range(i, 3)]
# Six responses from six pairs of volumes.
_RESP = f"rs AS (SELECT x, y, z, CAST(t % 6 AS INT) AS f, max(v - 10) FILTER (WHERE t < 6) AS re, max(v - 10) FILTER (WHERE t BETWEEN 6 AND 11) AS im, max(v - 9) FILTER (WHERE t BETWEEN 12 AND 17) AS re2, max(v - 9) FILTER (WHERE t >= 18) AS im2 FROM vox GROUP BY x, y, z, t % 6)"
_GOLD = "(1 + sqrt(5)) / 2"
_UNIT = f"sqrt(1 + ({_GOLD}) ^ 2)"
_VERTICES = [("1", "0", _GOLD), ("-1", "0", _GOLD), (_GOLD, "1", "0"), (_GOLD, "-1", "0"), ("0", _GOLD, "1"), ("0", _GOLD, "-1")]
_MSQL = "(SELECT f, n1, n2, n3, " + ", ".join(f"1.25 * n{i + 1} * n{j + 1}" + " - 0.25" * (i == j) + f" AS m{i + 1}{j + 1}" for i, j in _IJ) + " FROM (VALUES " + ", ".join(f"({f}, " + ", ".join(f"({c}) / {_UNIT}" for c in v) + ")" for f, v in enumerate(_VERTICES)) + ") v(f, n1, n2, n3)) AS mt"


def _responses(spark, d):
    at = lambda a, b, shift: F.max(F.when(F.col("t").between(a, b), F.col("v") - shift))
    return vox(spark, d).groupBy(*VOXEL, (F.col("t") % 6).cast("int").alias("f")).agg(at(0, 5, 10).alias("re"), at(6, 11, 10).alias("im"), at(12, 17, 9).alias("re2"), at(18, 23, 9).alias("im2"))


_TENSOR = f"st AS (SELECT x, y, z, {', '.join(f'sum(sqrt(re * re + im * im) * m{i + 1}{j + 1}) AS t{i + 1}{j + 1}' for i, j in _IJ)} FROM rs JOIN {_MSQL} USING (f) GROUP BY x, y, z)"


@query(f"WITH {VOX}, {_RESP}, {_TENSOR} SELECT 0 AS t, x, y, z, {', '.join(f'round(t{i + 1}{j + 1}, 5) + 0.0 AS t{i + 1}{j + 1}' for i, j in _IJ)} FROM st")
def r5_structure_tensor(spark, d):
    got = registration.structure_tensor(_responses(spark, d).withColumn("t", F.lit(0)))
    return got.select("t", *VOXEL, *((F.round(k, 5) + 0.0).alias(k) for k in got.columns[4:]))


def _t(i, j):
    return f"t{min(i, j) + 1}{max(i, j) + 1}"


_SQ = {(i, j): "(" + " + ".join(f"{_t(i, k)} * {_t(k, j)}" for k in range(3)) + ")" for i in range(3) for j in range(3)}
_NONLINEAR = [f"round(sum(c * {_SQ[i, j]}) / 1e6, 4) + 0.0 AS a{i + 1}{j + 1}" for i, j in _IJ]
_NONLINEAR += [f"round(sum(c * d * ({' + '.join(f'{_SQ[i, j]} * n{j + 1}' for j in range(3))})) / 1e6, 4) + 0.0 AS h{i + 1}" for i in range(3)]


@query(f"WITH {VOX}, {_RESP}, {_TENSOR}, ph AS (SELECT x, y, z, f, atan2(im * re2 - re * im2, re * re2 + im * im2) AS d, sqrt(re * re + im * im) * sqrt(re2 * re2 + im2 * im2) AS q FROM rs), cc AS (SELECT *, sqrt(q) * cos(d / 2) ^ 2 AS c FROM ph) SELECT x, y, z, {', '.join(_NONLINEAR)} FROM cc JOIN st USING (x, y, z) JOIN {_MSQL} USING (f) GROUP BY x, y, z")
def r7_nonlinear_equations(spark, d):
    q = _responses(spark, d)
    tensor = registration.structure_tensor(q.withColumn("t", F.lit(0))).drop("t")
    pairs = q.select(*VOXEL, "f", F.col("re").alias("re1"), F.col("im").alias("im1"), "re2", "im2").join(tensor, VOXEL)
    got = registration.field_equations(pairs)
    return got.select(*VOXEL, *((F.round(F.col(k) / 1e6, 4) + 0.0).alias(k) for k in got.columns[3:]))


for _axis in "yz":

    def _gradient(spark, d, axis=_axis):
        return _rounded(registration.phase_gradient(_complex(spark, d), axis))

    QUERIES[f"r2_phase_gradient_{_axis}"] = _gradient
    SQL[f"r2_phase_gradient_{_axis}"] = f"WITH {VOX}, {CPX}, g AS ({_grad_sql(_axis)}) SELECT x, y, z, round(g, 6) + 0.0 AS g FROM g WHERE g IS NOT NULL"


# ------------------------------------------------------------------ resampling and affine algebra

_SCALES = tuple(k * np.pi / 3 for k in (0.51, 0.71, 0.83))
_SPLACE = ", ".join(f"{k} * {num(s)} AS s{k}" for k, s in zip("xyz", _SCALES))
_FIELD_ODD = ", ".join(f"{k} + ({e}) * {num(np.pi / 3)} AS s{k}" for k, e in (("x", "0.1e0 * y - 0.4e0"), ("y", "0.2e0 * z"), ("z", "0.05e0 * x")))
for _mode, _taps in (("nearest", 1), ("cubic", 4)):

    def _by_field(spark, d, mode=_mode):
        f = field(spark)
        f = f.select(*VOXEL, *((F.col(f"u{k}") * float(np.pi / 3)).alias(f"u{k}") for k in VOXEL))
        return _rounded(spatial.gather(volume(vox(spark, d), 0), spatial.field_places(f), SIZE, mode))

    def _by_scale(spark, d, mode=_mode):
        return _rounded(spatial.gather(volume(vox(spark, d), 0), spatial.scale_places(grid.grid(spark, W, H, D), _SCALES), SIZE, mode))

    QUERIES[f"r10_field_{_mode}"], SQL[f"r10_field_{_mode}"] = _by_field, f"WITH {VOX}, {V0}, {gather_sql(f'SELECT x, y, z, {_FIELD_ODD} FROM v0', _taps)}" + _GATHER
    QUERIES[f"r12_rescale_{_mode}"], SQL[f"r12_rescale_{_mode}"] = _by_scale, f"WITH {VOX}, {V0}, {gather_sql(f'SELECT x, y, z, {_SPLACE} FROM v0', _taps)}" + _GATHER


@query(_EYE3.format(4))
def r20_inverse_affine(spark, d):
    """An affine combined with its inverse: the identity."""
    return _product(_matrix(spark, registration.to_matrix(AFFINE)), _matrix(spark, registration.to_matrix(registration.invert(AFFINE))))


_OTHER = registration.scaling((2.0, 1.0, 0.5))
_MSQL4 = [values([(i, j, v) for i, row in enumerate(registration.to_matrix(p)) for j, v in enumerate(row)], f"{n}(i, j, v)") for n, p in (("a", AFFINE), ("b", _OTHER))]


@query(f"SELECT CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM {_MSQL4[0]} JOIN {_MSQL4[1]} ON a.j = b.i GROUP BY a.i, b.j")
def r19_combine_affines(spark, d):
    return _rounded(_matrix(spark, registration.to_matrix(registration.compose(AFFINE, _OTHER))))


@query(f"WITH {VOX}, {V0}, cm AS (SELECT {', '.join(f'sum({k} * v) / sum(v) - {(n - 1) / 2} AS m{k}' for k, n in zip('xyz', SIZE))} FROM v0), {gather_sql('SELECT x, y, z, ' + ', '.join(f'{k} + m{k} AS s{k}' for k in 'xyz') + ' FROM v0, cm')}" + _GATHER)
def r22_centre_mass(spark, d):
    return _rounded(spatial.centre_mass(volume(vox(spark, d), 0), SIZE))


@query()
def r15_registration(spark, d):
    """All volumes brought to their sum: affine over three scales, then a displacement field."""
    v = vox(spark, d)
    got = registration.register_images(v, summed(v), SIZE)
    return got.groupBy("t").agg(*(F.round(F.avg(k), 6).alias(k) for k in ("v", "ux", "uy", "uz")))


# ------------------------------------------------------------------ runs and scores


@query(f"WITH {VOX} SELECT x, y, z, CAST(t + CASE WHEN x < 5 THEN 0 ELSE {T} END AS INT) AS t, v FROM vox")
def s20_concatenate_runs(spark, d):
    runs = vox(spark, d).withColumn("run", F.when(F.col("x") < 5, 1).otherwise(2))
    return text.concatenate_runs(runs, {1: T, 2: T}).select(*VOXEL, F.col("t").cast("int").alias("t"), "v")


def _s19_sql(dof: int = T - 3, steps: int = 6) -> str:
    """The share within t in closed form (odd degrees of freedom), and the z that holds the same share, by Newton steps on the normal's series."""
    terms, weight = ["1e0"], "1e0"
    for j in range(1, (dof - 1) // 2):
        weight += f" * {2 * j} / {2 * j + 1}"
        terms.append(f"{weight} * cos(th) ^ {2 * j}")
    share = f"2 / pi() * (th + sin(th) * cos(th) * ({' + '.join(terms)}))"
    series = "list_sum([exp((2 * k + 1) * ln(greatest(z, 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) FOR k IN range(90)])"
    bell = "(exp(-(z * z) / 2) / sqrt(2 * pi()))"
    newton = ", ".join(f"z{k} AS (SELECT vx, vy, vz, s, a, z - ({bell} * {series} - a / 2) / {bell} AS z FROM z{k - 1})" for k in range(1, steps + 1))
    return f"""t AS (SELECT x AS vx, y AS vy, z AS vz, sign(b0) AS s, abs(b0) / sqrt({_VAR['second_t']} * {_TS}) AS t FROM fit JOIN va USING (x, y, z) WHERE {_VAR['second_t']} > 0),
th AS (SELECT vx, vy, vz, s, t, atan(t / sqrt({dof})) AS th FROM t), z0 AS (SELECT vx, vy, vz, s, {share} AS a, t * (1 - 1 / {4 * dof}.0) / sqrt(1 + t * t / {2 * dof}.0) AS z FROM th), {newton}
SELECT vx AS x, vy AS y, vz AS z, round(s * z, 6) + 0.0 AS z_score FROM z{steps}"""


@query(f"WITH {VOX}, {FIT}, {_s19_sql()}")
def s19_t_to_z(spark, d):
    got = glm.t_map(vox(spark, d), X, C, "second_t")
    return got.select(*VOXEL, (F.round(stats.t_to_z(F.col("stat"), T - 3), 6) + 0.0).alias("z_score"))


@query("WITH RECURSIVE g AS (SELECT 0 AS i, 12345::BIGINT * 16807 % 2147483647 AS s UNION ALL SELECT i + 1, s * 16807 % 2147483647 FROM g WHERE i < 99) SELECT CAST(i AS INT) AS i, round(s / 2147483647.0::DOUBLE, 12) AS u FROM g")
def m6_lehmer(spark, d):
    return spark.createDataFrame([(i, float(u)) for i, u in enumerate(stats.lehmer(12345, 100))], "i int, u double").select("i", F.round("u", 12).alias("u"))
