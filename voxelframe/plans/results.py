"""Queries of whole results: voxel-wise whitened designs, output selection, transforms and masks in either space, tails, text dumps.

They join those of ``queries`` and ``further`` in the same tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import glm, grid, registration, spatial
from ..operators.grid import VOXEL
from ..sources import text
from . import further  # noqa: F401
from .queries import (
    _TS, _VAR, AFFINE, C, CF, FIT, FM00, FM01, FM11, MASK, QUERIES, SIZE, SQL, V0, VOX, X, X_SQL, D, H, T, W,
    _complex, _k11_sql, _rounded, brain, field, gather_sql, num, query, r, volume, vox,
)

__all__ = ["QUERIES", "SQL"]

# ------------------------------------------------------------------ models


@query(_k11_sql("SELECT x, y, z, round(b0, 5) + 0.0 AS b0, round(b1, 5) + 0.0 AS b1, round(b2, 5) + 0.0 AS b2 FROM be", smoothed=False))
def g11_voxel_designs(spark, d):
    """Betas of designs whitened by each voxel's own, unsmoothed coefficients."""
    v = vox(spark, d)
    got = glm.voxel_betas(v, X, glm.estimate_ar(v, X, T))
    return got.select(*VOXEL, *(r(f"b{k}", 5).alias(f"b{k}") for k in range(3)))


_STAT = f"CASE WHEN {_VAR['first']} > 0 THEN b0 / sqrt({_VAR['first']} * {_TS}) ELSE 0.0 END"


@query(f"WITH {VOX}, {FIT}, al AS (SELECT * FROM fit JOIN va USING (x, y, z)) " + " UNION ALL ".join(f"SELECT x, y, z, '{n}' AS map, round({e}, 6) + 0.0 AS v FROM al" for n, e in (("b0", "b0"), ("b1", "b1"), ("b2", "b2"), ("c0", "b0"), ("t0", _STAT))))
def k12_outputs(spark, d):
    """Betas, contrasts and their t as one table of maps."""
    v = vox(spark, d)
    fit, stat = glm.betas(v, X).drop("ys"), glm.t_map(v, X, C, "first")
    return _rounded(glm.select_outputs(fit.join(stat.select(*VOXEL, F.col("cope").alias("c0"), F.col("stat").alias("t0")), VOXEL), "both"))


# ------------------------------------------------------------------ transforms

_PLACES = ", ".join(f"{k} + ({e}) AS s{k}" for k, e in (("x", "0.1e0 * y - 0.4e0"), ("y", "0.2e0 * z"), ("z", "0.05e0 * x")))
_THEN = ", ".join(f"s{k} + {num(AFFINE[i])} + " + " + ".join(f"{num(AFFINE[3 + 3 * i + j])} * (s{o} - {(n - 1) / 2})" for j, (o, n) in enumerate(zip("xyz", SIZE))) + f" AS s{k}" for i, k in enumerate("xyz"))


@query(f"WITH {VOX}, {FIT}, fp AS (SELECT x, y, z, {_PLACES} FROM fit), {gather_sql(f'SELECT x, y, z, {_THEN} FROM fp')} SELECT tp.x, tp.y, tp.z, {', '.join(f'round(sum(f.b{k} * w), 6) + 0.0 AS b{k}' for k in range(3))} FROM tp JOIN fit f ON tp.ix = f.x AND tp.iy = f.y AND tp.iz = f.z GROUP BY tp.x, tp.y, tp.z")
def r23_transform_results(spark, d):
    """All betas brought to the reference by a field and an affine, with one set of taps."""
    maps = glm.betas(vox(spark, d), X).drop("ys")
    return _rounded(spatial.transform_results(maps, AFFINE, SIZE, field(spark)))


_BACK = registration.invert(AFFINE)
_RETURN = ", ".join(f"{k} + {num(_BACK[i])} + " + " + ".join(f"{num(_BACK[3 + 3 * i + j])} * ({o} - {(n - 1) / 2})" for j, (o, n) in enumerate(zip("xyz", SIZE))) + f" AS s{k}" for i, k in enumerate("xyz"))


@query(f"WITH {VOX}, {MASK}, {V0}, {gather_sql(f'SELECT x, y, z, {_RETURN} FROM v0', 1)}, mo AS (SELECT tp.x, tp.y, tp.z, mask.m FROM tp JOIN mask ON tp.ix = mask.x AND tp.iy = mask.y AND tp.iz = mask.z) SELECT x, y, z, CASE WHEN m = 1.0 THEN v ELSE 0.0::DOUBLE END AS v FROM v0 JOIN mo USING (x, y, z)")
def r21_mask_original(spark, d):
    """The input kept where the reference's mask, taken back by the inverse affine, is 1."""
    v = vox(spark, d)
    return spatial.mask_original(volume(v, 0), brain(v), AFFINE, SIZE)


_FACTORS = (1.3, 0.9, 1.1)
_SCALED = ", ".join(f"{(n - 1) / 2} + ({k} - {(n - 1) / 2}) / {f}e0 AS s{k}" for k, n, f in zip("xyz", SIZE, _FACTORS))


@query(f"WITH {VOX}, {V0}, {gather_sql(f'SELECT x, y, z, {_SCALED} FROM v0')} SELECT tp.x, tp.y, tp.z, round(sum(v0.v * w), 5) + 0.0 AS v FROM tp JOIN v0 ON tp.ix = v0.x AND tp.iy = v0.y AND tp.iz = v0.z GROUP BY tp.x, tp.y, tp.z")
def r18_scaling(spark, d):
    places = spatial.affine_places(grid.grid(spark, W, H, D), registration.scaling(_FACTORS), SIZE)
    return spatial.gather(volume(vox(spark, d), 0), places, SIZE).withColumn("v", r("v", 5))


def _equations(spark, d):
    c = _complex(spark, d)
    diff, cert = registration.phase()
    ph = c.select(*VOXEL, diff.alias("d"), (cert / 1000).alias("c"))
    rows = None
    for i, k in enumerate(VOXEL):
        part = registration.phase_gradient(c, k).join(ph, VOXEL).withColumn("axis", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.select("axis", "g", "d", "c", *((F.col(k) - (n - 1) / 2).alias(k) for k, n in zip(VOXEL, SIZE)))
    return registration.normal_equations(rows)


_R3 = SQL["r3_normal_equations"]


@query(f"WITH e AS ({_R3}) " + " UNION ALL ".join(f"SELECT '{a}{n}' AS equation, round(h{a}_{n}, 2) + 0.0 AS h FROM e" for a in range(3) for n in "1xyz"))
def r4_affine_solution(spark, d):
    """The solved 12 parameters put back into the normal equations: their right-hand sides."""
    row = _equations(spark, d).first()  # one row of sums
    p = registration.solve_affine(row)
    pair = lambda i, j: "".join(sorted(k for k in ("1xyz"[i], "1xyz"[j]) if k != "1")) or "1"
    got = [(f"{a}{'1xyz'[i]}", float(sum(row[f"a{a}_{pair(i, j)}"] * p[a if j == 0 else 2 + 3 * a + j] for j in range(4)))) for a in range(3) for i in range(4)]
    return spark.createDataFrame(got, "equation string, h double").select("equation", (F.round("h", 2) + 0.0).alias("h"))


# ------------------------------------------------------------------ tails


@query(f"WITH {VOX}, {FIT}, s AS (SELECT x, y, z, greatest((b0 * b0 * {FM00} + 2 * b0 * b2 * {FM01} + b2 * b2 * {FM11}) / ({_VAR['second_f']} * 2), 0) AS f FROM fit JOIN va USING (x, y, z)) SELECT x, y, z, round((1 + 2 * f / 20) ^ (-10), 9) AS tail, round(exp(-f) * (1 + f), 9) AS chi2_tail, round(f, 5) AS back FROM s")
def s25_tails(spark, d):
    """Tails of F with 2 and 20 degrees of freedom, of chi squared with 4 (of 2 F), and the F that the tail leads back to."""
    got = glm.f_map(vox(spark, d), X, CF, "second_f").select(*VOXEL, F.greatest("stat", F.lit(0.0)).alias("f"))
    tail = stats.column_of(lambda f: stats.f_tail(f, 2, 20), F.col("f"))
    got = got.withColumn("tail", tail).withColumn("chi2_tail", stats.column_of(lambda f: stats.chi2_tail(2 * f, 4), F.col("f")))
    back = stats.column_of(lambda p: stats.inverse_tail(lambda f: stats.f_tail(f, 2, 20), p, 0.0, 1e4), F.col("tail"))
    return got.select(*VOXEL, F.round("tail", 9).alias("tail"), F.round("chi2_tail", 9).alias("chi2_tail"), F.round(back, 5).alias("back"))


_LEHMER = "g AS (SELECT 0 AS i, 12345::BIGINT * 16807 % 2147483647 AS s UNION ALL SELECT i + 1, s * 16807 % 2147483647 FROM g WHERE i < 599)"


@query(f"WITH RECURSIVE {_LEHMER}, u AS (SELECT i // 2 AS k, s / 2147483647.0::DOUBLE AS u, lead(s) OVER (ORDER BY i) / 2147483647.0::DOUBLE AS v, i FROM g), n AS (SELECT k, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z FROM u WHERE i % 2 = 0) SELECT CAST(k // 6 AS INT) AS i, round(2 * 1.5 / sum(z * z), 9) AS v FROM n GROUP BY k // 6")
def m6_inverse_gamma(spark, d):
    """Fifty draws of shape 3 and scale 1.5 from 300 normals."""
    u = stats.lehmer(12345, 600)
    got = stats.inverse_gamma(3.0, 1.5, stats.box_muller(u[::2], u[1::2]))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(got)], "i int, v double").withColumn("v", F.round("v", 9))


# ------------------------------------------------------------------ text and runs


@query(f"SELECT t, printf('%.6f  %.6f  %.6f  ', x0, x1, x2) AS line FROM {X_SQL}")
def s22_design_dump(spark, d):
    return spark.createDataFrame(list(enumerate(text.design_lines(X))), "t int, line string")


_SIX = ", ".join(f"sum(CASE WHEN x % 6 = {k} THEN v * (y - 4) ELSE 0 END) / 1000 AS p{k}" for k in range(6))


@query(f"WITH {VOX}, p AS (SELECT t, {_SIX} FROM vox GROUP BY t) SELECT t, printf('%.6f %.6f %.6f %.6f %.6f %.6f', p4, -p3, p5, -p2, -p0, -p1) AS line FROM p")
def s23_motion_dump(spark, d):
    v = vox(spark, d)
    p = v.groupBy("t").agg(*((F.sum(F.when(F.col("x") % 6 == k, F.col("v") * (F.col("y") - 4)).otherwise(0.0)) / 1000).alias(f"p{k}") for k in range(6)))
    rows = sorted((row["t"], registration.motion_lines([row[f"p{k}"] for k in range(6)])) for row in p.collect())  # one row a volume
    return spark.createDataFrame(rows, "t int, line string")


_TABLE = "e AS (SELECT CAST(user_id % 7 AS INT) AS run, event_type AS trial_type, CAST(floor(epoch(ts))::BIGINT % 600 AS DOUBLE) AS onset, CAST(event_id % 5 AS DOUBLE) AS duration, 1.0::DOUBLE AS value FROM events)"


@query(f"WITH {_TABLE}, r AS (SELECT CAST(range AS INT) AS run FROM range(9)), c AS (SELECT DISTINCT trial_type FROM e), f AS (SELECT r.run, c.trial_type, count(onset) AS n, round(sum(onset), 3) AS onsets FROM r CROSS JOIN c LEFT JOIN e USING (run, trial_type) GROUP BY ALL) SELECT run, trial_type, 'NumEvents ' || n AS head, n AS lines, coalesce(onsets, 0.0) AS onsets FROM f")
def s17_condition_files(spark, d):
    """An event file for every run and condition; runs 7 and 8 have none of any. Its head, number of lines and sum of onsets."""
    e = spark.read.parquet(f"{d}/events.parquet").select(
        (F.col("user_id") % 7).cast("int").alias("run"), F.col("event_type").alias("trial_type"), (F.unix_timestamp("ts") % 600).cast("double").alias("onset"), (F.col("event_id") % 5).cast("double").alias("duration"), F.lit(1.0).alias("value")
    )
    runs, conditions = spark.range(9).select(F.col("id").cast("int").alias("run")), e.select("trial_type").distinct()
    files = text.condition_files(text.pad_conditions(e, runs, conditions))
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.startswith("NumEvents"))
    onsets = F.aggregate(lines, F.lit(0.0), lambda s, x: s + F.split(x, " ")[0].cast("double"))
    return files.select("run", "trial_type", F.split("text", "\n")[0].alias("head"), F.size(lines).cast("bigint").alias("lines"), F.round(onsets, 3).alias("onsets"))
