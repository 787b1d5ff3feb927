"""Queries of the sources and sinks: tables go out as the files that a reader takes, and come back through it.

They join those of ``large`` and the modules before it in the same tables.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import permutation, registration
from ..operators.grid import VOXEL
from ..sources import nifti, text
from . import large  # noqa: F401
from .queries import AFFINE, PERM_SQL, QUERIES, SIZE_T, SQL, T, VOX, X, X_SQL, query, r, volume, vox

__all__ = ["QUERIES", "SQL"]


def folder(spark: SparkSession) -> Path:
    """A new folder under spark.checkpoint.dir if that is a mounted one, else a temporary one of this machine (local mode)."""
    given = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or "").removeprefix("file://")
    out = Path(given) / f"files-{uuid.uuid4().hex}" if given.startswith("/") else Path(tempfile.mkdtemp(prefix="voxelframe-files-"))
    out.mkdir(parents=True, exist_ok=True)
    return out


def _table(spark, m, names: str, key: str = "t"):
    m = np.asarray(m, float)
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(m)], f"{key} int, " + ", ".join(f"{n} double" for n in names.split()))


def _lines(rows) -> str:
    return "".join(" ".join(map(repr, map(float, row))) + "\n" for row in rows)


# ------------------------------------------------------------------ images


@query(f"WITH {VOX} SELECT x, y, z, t, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM vox")
def s1_nifti(spark, d):
    """The series written as a compressed image of 32-bit floats and read again (S1, S2)."""
    at = folder(spark)
    nifti.write(vox(spark, d).withColumn("image", F.lit("series.nii.gz")), str(at), SIZE_T).count()
    return nifti.read(spark, f"file://{at}/series.nii.gz").select(*VOXEL, "t", "v")


@query(f"WITH {VOX} SELECT x, y, z, max(CAST(v AS FLOAT)) FILTER (WHERE t = 0)::DOUBLE AS ux, max(CAST(v AS FLOAT)) FILTER (WHERE t = 1)::DOUBLE AS uy, max(CAST(v AS FLOAT)) FILTER (WHERE t = 2)::DOUBLE AS uz FROM vox GROUP BY x, y, z")
def s15_displacement(spark, d):
    """Three volumes as the files of a displacement field."""
    at, v, parts = folder(spark), vox(spark, d), []
    for t, name in enumerate(("x.nii", "y.nii", "z.nii")):
        nifti.write(volume(v, t).withColumn("t", F.lit(0)).withColumn("image", F.lit(name)), str(at), (*SIZE_T[:3], 1)).count()
        parts.append(nifti.read(spark, f"file://{at}/{name}"))
    return text.displacement(*parts)


@query(f"WITH {VOX} SELECT x, y, z, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM vox WHERE t = 3")
def s24_raw_floats(spark, d):
    at, rows = folder(spark), volume(vox(spark, d), 3).orderBy("z", "y", "x").toPandas()  # one volume
    rows["v"].to_numpy("<f4").tofile(at / "v.raw")
    got = text.raw_floats(spark, f"file://{at}/v.raw", SIZE_T[:3])
    return got.select(*(F.col(f"i{k}").alias(n) for k, n in enumerate(VOXEL)), "v")


# ------------------------------------------------------------------ designs

_X6 = f"SELECT t, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) + 0.0 AS x2 FROM {X_SQL}"


@query(_X6)
def s4_design(spark, d):
    at = folder(spark) / "design.txt"
    text.write_design(str(at), X)
    at.write_text(f"NumRegressors {X.shape[1]}\n{at.read_text()}")
    return _table(spark, text.design(str(at)), "x0 x1 x2").withColumn("x2", F.col("x2") + 0.0)


@query("SELECT CAST(n_nationkey AS INT) AS subject, 1e0 AS x0, CASE WHEN n_regionkey = 0 THEN 1e0 ELSE 0e0 END AS x1 FROM nation")
def s5_group_design(spark, d):
    at = folder(spark) / "group.txt"
    regions = [row[0] for row in spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").select("n_regionkey").collect()]  # the subjects
    at.write_text(f"NumRegressors 2\nNumSubjects {len(regions)}\n" + _lines((1, k == 0) for k in regions))
    return _table(spark, text.design(str(at), subjects=True), "x0 x1", "subject")


_KINDS = ("click", "error", "purchase", "signup", "view")
_ON = "CAST(floor(epoch(ts))::BIGINT % 230 AS DOUBLE) AS onset, CAST(event_id % 5 AS DOUBLE) AS duration, CAST(1 + event_id % 3 AS DOUBLE) AS value"


def _events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", "event_type", (F.unix_timestamp("ts") % 230).cast("double").alias("onset"), (F.col("event_id") % 5).cast("double").alias("duration"), (1 + F.col("event_id") % 3).cast("double").alias("value"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS INT) AS idx, {_ON} FROM events")
def s7_events(spark, d):
    at = str(folder(spark) / "events.txt")
    text.write_events(_events(spark, d), at, "event_id")
    return text.events(spark, at)


_SAMPLES = " UNION ALL ".join(
    f"SELECT {k} AS r, i // 100 AS t, max_by(value, event_id) AS v FROM (SELECT event_id, value, unnest(range(CAST(round(onset * 50) AS BIGINT), CAST(round((onset + duration) * 50) AS BIGINT))) AS i FROM ev WHERE event_type = '{n}') WHERE i % 100 = 0 GROUP BY i"
    for k, n in enumerate(_KINDS)
)


@query(f"WITH ev AS (SELECT event_id, event_type, {_ON} FROM events), s AS ({_SAMPLES}) SELECT CAST(range AS INT) AS t, {', '.join(f'coalesce(max(v) FILTER (WHERE r = {k}), 0e0) AS r{k}' for k in range(len(_KINDS)))} FROM range(120) LEFT JOIN s ON s.t = range GROUP BY range")
def s6_regressor_list(spark, d):
    """A list of five event files, one a kind of event, as the design that it stands for."""
    at, e = folder(spark), _events(spark, d)
    for n in _KINDS:
        text.write_events(e.where(F.col("event_type") == n), str(at / f"{n}.txt"), "event_id")
    (at / "list.txt").write_text(f"NumRegressors {len(_KINDS)}\n" + "\n".join(f"{n}.txt" for n in _KINDS))
    return _table(spark, text.regressors(spark, str(at / "list.txt"), 2.0, 120), " ".join(f"r{k}" for k in range(len(_KINDS))))


@query(f"WITH {VOX} SELECT CAST(t AS INT) AS t, round(avg(v), 6) AS v FROM vox GROUP BY t")
def s8_raw_regressor(spark, d):
    at = folder(spark) / "raw.txt"
    means = vox(spark, d).groupBy("t").agg(F.avg("v").alias("v")).orderBy("t").collect()  # one number a volume
    at.write_text(_lines([(row["v"],) for row in means]))
    return _table(spark, text.column(str(at), T)[:, None], "v").withColumn("v", r("v"))


@query("SELECT CAST(a.range AS INT) AS contrast, CAST(b.range AS INT) AS regressor, CASE WHEN a.range = b.range THEN 1e0 WHEN a.range + 1 = b.range THEN -1e0 ELSE 0e0 END AS v FROM range(2) a, range(3) b")
def s9_contrasts(spark, d):
    at = folder(spark) / "contrasts.txt"
    at.write_text("NumRegressors 3\nNumContrasts 2\n" + _lines(np.eye(3)[:2] - np.eye(3, k=1)[:2]))
    c = text.contrasts(str(at), 3)
    return spark.createDataFrame([(i, j, float(c[i, j])) for i in range(2) for j in range(3)], "contrast int, regressor int, v double")


_SIX = ", ".join(f"sum(CASE WHEN x % 6 = {k} THEN v ELSE 0 END) / 1000 AS p{k}" for k in range(6))


@query(f"WITH {VOX}, p AS (SELECT t, {_SIX} FROM vox GROUP BY t) SELECT CAST(t AS INT) AS t, {', '.join(f'round(p{k}, 6) AS p{k}' for k in range(6))} FROM p")
def s10_motion_regressors(spark, d):
    at = folder(spark) / "motion.txt"
    p = vox(spark, d).groupBy("t").agg(*((F.sum(F.when(F.col("x") % 6 == k, F.col("v")).otherwise(0.0)) / 1000).alias(f"p{k}") for k in range(6))).orderBy("t").collect()  # one row a volume
    at.write_text(_lines(row[1:] for row in p))
    got = _table(spark, text.motion(str(at), T), " ".join(f"p{k}" for k in range(6)))
    return got.select("t", *(r(f"p{k}").alias(f"p{k}") for k in range(6)))


@query("SELECT CAST(range AS INT) AS z, round(range * 0.25e0, 6) AS seconds FROM range(7)")
def s11_slice_times(spark, d):
    at = folder(spark) / "times.txt"
    at.write_text("".join(f"{250 * z}\n" for z in range(7)))
    return _table(spark, np.array(text.slice_times(str(at), 7, 2.0))[:, None], "seconds", "z")


@query(f"SELECT CAST(p AS INT) AS p, CAST(t AS INT) AS t, CAST(s AS INT) AS s, CAST(1 - 2 * ((p >> (t % 4)::BIGINT) & 1) AS INT) AS sign FROM {PERM_SQL}")
def s12_permutation_files(spark, d):
    """Permutations, counted from 1 in their file, and signs."""
    from .queries import PERMS

    at = folder(spark)
    text.write_vectors(str(at / "perms.txt"), PERMS)
    text.write_vectors(str(at / "signs.txt"), permutation.sign_table(4, 16)[:, np.arange(T) % 4], one_based=False)
    p, s = text.permutations(str(at / "perms.txt"), count=len(PERMS), subjects=T), text.signs(str(at / "signs.txt"), 16, T)
    return spark.createDataFrame([(i, t, int(p[i, t]), int(s[i, t])) for i in range(len(PERMS)) for t in range(T)], "p int, t int, s int, sign int")


@query(f"SELECT CAST(range AS INT) AS t, CAST(CASE WHEN range % 6 = 5 THEN 9999 ELSE range // 4 % 2 END AS INT) AS class FROM range({T})")
def s13_classes(spark, d):
    at = folder(spark) / "classes.txt"
    at.write_text(f"NumVolumes {T}\n" + "\n".join(str(9999 if t % 6 == 5 else t // 4 % 2) for t in range(T)))
    return spark.createDataFrame(list(enumerate(text.classes(str(at)))), "t int, class int")


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {float(v):.12f}e0)" for k, v in enumerate(AFFINE)) + ") a(k, v)")
def s14_affine_file(spark, d):
    at = folder(spark) / "affine.txt"
    np.savetxt(at, registration.to_matrix(AFFINE), fmt="%.15f")
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(text.affine(str(at)))], "k int, v double").withColumn("v", F.round("v", 12))


@query(f"SELECT replace(event_type, '/', '') AS trial_type, count(*) AS n, sum(onset) AS onsets, sum(duration) AS durations, sum(value) AS vals FROM (SELECT event_type, {_ON} FROM events) GROUP BY ALL")
def s16_bids_events(spark, d):
    """An event table with a height column; names come back without slashes and with underscores."""
    at = folder(spark)
    e = _events(spark, d).select("onset", "duration", F.concat(F.lit("/ "), "event_type").alias("trial_type"), F.col("value").alias("height"))
    e.write.csv(f"file://{at}/table", sep="\t", header=True)
    got = text.bids_events(spark, f"file://{at}/table", height="height")
    return got.groupBy(F.regexp_replace("trial_type", "^_", "").alias("trial_type")).agg(F.count("*").alias("n"), F.sum("onset").alias("onsets"), F.sum("duration").alias("durations"), F.sum("value").alias("vals"))


@query(f"WITH x AS ({_X6}) SELECT 0 AS regressor, t, x0 AS value FROM x UNION ALL SELECT 1, t, x1 FROM x UNION ALL SELECT 2, t, x2 FROM x")
def s18_matrix_columns(spark, d):
    at = folder(spark) / "design.mat"
    at.write_text(f"/NumWaves 3\n/NumPoints {T}\n/Matrix\n" + "\n".join(text.design_lines(X)) + "\n")
    return text.matrix_columns(spark, str(at)).withColumn("value", F.col("value") + 0.0)


@query(f"{SQL['p10_null_of_max']}")
def s21_distribution(spark, d):
    """The null distribution as text, one value a line in order of its permutations, and back."""
    at = folder(spark)
    text.write_distribution(QUERIES["p10_null_of_max"](spark, d), f"file://{at}/null")
    values = [float(row.value) for row in spark.read.text(f"file://{at}/null").collect()]  # one a permutation, a single file
    return spark.createDataFrame(list(enumerate(values)), "p int, max_stat double")
