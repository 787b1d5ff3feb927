import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelframe.functions import stats
from voxelframe.operators import design, permutation, registration
from voxelframe.sources import text
from voxelframe.streaming import series


def cells(spark, vol, t=0):
    z, y, x = (g.ravel() for g in np.meshgrid(*(np.arange(n) for n in vol.shape), indexing="ij"))
    pdf = pd.DataFrame({"x": x, "y": y, "z": z, "t": t, "v": vol.ravel().astype(float)}).astype({k: "int32" for k in "xyzt"})
    return spark.createDataFrame(pdf)


def blob(centre, size=(12, 14, 16), width=2.5):
    z, y, x = np.meshgrid(*(np.arange(n) for n in size), indexing="ij")
    return sum(np.exp(-((x - centre[0] - a) ** 2 + (y - centre[1] - b) ** 2 + (z - centre[2] - c) ** 2) / (2 * width**2)) for a, b, c in ((0, 0, 0), (4, -3, 2), (-3, 3, -2)))


@pytest.mark.parametrize("dof", [1, 2, 4])
def test_t_to_z_closed_forms(spark, dof):
    ts = [-60.0, -3.0, -0.5, 0.0, 0.2, 1.0, 2.5, 40.0]
    tail = {
        1: lambda t: 0.5 - math.atan(t) / math.pi,
        2: lambda t: 0.5 * (1 - t / math.sqrt(2 + t * t)),
        4: lambda t: 0.5 - (s := t / math.sqrt(4 + t * t)) * (3 - s * s) / 4,
    }[dof]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)] + [(99, None)], "i int, t double")
    got = {r.i: r.z for r in df.select("i", stats.t_to_z(F.col("t"), dof).alias("z")).collect()}
    assert got[99] is None
    for i, t in enumerate(ts):
        assert got[i] == pytest.approx(math.copysign(1, t) * -NormalDist().inv_cdf(tail(abs(t))), rel=1e-6, abs=1e-9)


def test_generators():
    assert stats.lehmer(1, 2) == pytest.approx([16807 / 2147483647, 282475249 / 2147483647])
    u = stats.lehmer(7, 20000)
    n = stats.box_muller(u[::2], u[1::2])
    assert abs(n.mean()) < 0.05 and abs(n.std() - 1) < 0.05


def test_exchangeable_null_against_loops(spark):
    rng = np.random.default_rng(3)
    w, a = rng.normal(size=(4, 20)), rng.uniform(-0.2, 0.3, size=(4, 4))
    x, c = np.column_stack([np.arange(20) % 2, np.ones(20)]).astype(float), np.array([1.0, 0.0])
    perms = permutation.permutation_table(20, 5, 1)
    white = spark.createDataFrame([(i, 0, 0, t, float(w[i, t])) for i in range(4) for t in range(20)], "x int, y int, z int, t int, v double")
    ar = spark.createDataFrame([(i, 0, 0, *map(float, a[i])) for i in range(4)], "x int, y int, z int, a1 double, a2 double, a3 double, a4 double")
    got = {r.p: r.max_stat for r in permutation.exchangeable_null(white, ar, x, c, perms).collect()}
    for p, perm in enumerate(perms):
        best = -np.inf
        for i in range(4):
            y = []
            for t in range(20):
                y.append(w[i, perm[t]] + sum(a[i, k - 1] * y[t - k] for k in range(1, 5) if t >= k))
            b = np.linalg.lstsq(x, np.array(y), rcond=None)[0]
            e = np.array(y) - x @ b
            best = max(best, b[0] / math.sqrt(e.var(ddof=1) * np.linalg.inv(x.T @ x)[0, 0]))
        assert got[p] == pytest.approx(best, abs=1e-9)


def test_nuisance_and_run_blocks():
    x, c = design.with_nuisance(np.ones((4, 1)), np.array([1.0]), np.arange(8.0).reshape(4, 2), None, np.arange(4.0))
    assert x.shape == (4, 4) and c.tolist() == [[1, 0, 0, 0]]
    b = design.run_blocks([np.ones((2, 1)), np.full((3, 2), 2.0)])
    assert b.shape == (5, 3) and b[:2, 1:].sum() == 0 and b[2:, 0].sum() == 0 and b.sum() == 14


def test_linear_registration_over_scales():
    fixed, moving = blob((8, 7, 6)), blob((10.5, 7, 6))
    p = registration.align_scales(moving, fixed, registration.quadrature_filters(7), scales=2, iterations=10, kind="translation")
    assert p[0] == pytest.approx(2.5, abs=0.35)
    assert np.abs(registration.resample(moving, p) - fixed).mean() < 0.3 * np.abs(moving - fixed).mean()


def test_field_registration_lowers_the_error(spark):
    fixed, moving = blob((8, 7, 6)), blob((9.5, 6.5, 6))
    u = registration.align_field(moving, fixed, registration.quadrature_filters(7, registration.SIX), scales=2, iterations=5, sigma=3.0)
    assert np.abs(registration.warp(moving, u) - fixed).mean() < 0.5 * np.abs(moving - fixed).mean()
    out = registration.register_images(cells(spark, moving), cells(spark, fixed), (16, 14, 12), scales=2, iterations=5, field_iterations=3).toPandas()
    got = np.zeros(fixed.shape)
    got[out["z"], out["y"], out["x"]] = out["v"]
    assert np.abs(got - fixed).mean() < 0.5 * np.abs(moving - fixed).mean()


def test_text_files(spark, tmp_path):
    assert text.output_name("/a.b/f.nii.gz", "_beta") == "/a.b/f_beta.nii.gz" and text.output_name("f.nii", "_x", "g.nii") == "g.nii"
    (tmp_path / "d.mat").write_text("/NumWaves 2\n/Matrix\n1 2\n3 4\n")
    assert sorted(map(tuple, text.matrix_columns(spark, str(tmp_path / "d.mat")).collect())) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]
    text.write_design(str(tmp_path / "x.txt"), np.array([[1, 0.5]]))
    assert (tmp_path / "x.txt").read_text() == "1.000000  0.500000  \n"
    np.savetxt(tmp_path / "m.txt", np.zeros((3, 6)))
    assert text.motion(str(tmp_path / "m.txt"), 3).shape == (3, 6)
    with pytest.raises(ValueError):
        text.motion(str(tmp_path / "m.txt"), 4)
    null = spark.createDataFrame([(1, 2.5), (0, 1.5)], "p int, max_stat double")
    text.write_distribution(null, str(tmp_path / "null"))
    assert [r.value for r in spark.read.text(str(tmp_path / "null")).collect()] == ["1.5", "2.5"]
    ev = spark.createDataFrame([(1, "a", 2.0, 1.0, 1.0), (1, "a", 0.5, 1.0, 1.0)], "run int, trial_type string, onset double, duration double, value double")
    runs, conditions = spark.createDataFrame([(1,), (2,)], "run int"), spark.createDataFrame([("a",)], "trial_type string")
    files = {(r.run, r.trial_type): r.text for r in text.condition_files(text.pad_conditions(ev, runs, conditions)).collect()}
    assert files == {(1, "a"): "NumEvents 2\n0.5 1.0 1.0\n2.0 1.0 1.0", (2, "a"): "NumEvents 0"}


def test_streams_match_batches(spark, tmp_path):
    rows = [(x, 0, 0, t, float(x + 10 * t)) for x in range(3) for t in range(4)]
    schema = "x int, y int, z int, t int, v double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    mask = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 1.0), (2, 0, 0, 0.0)], "x int, y int, z int, m double")
    x = spark.createDataFrame([(t, float(t), 1.0) for t in range(4)], "t int, x0 double, x1 double")
    for name, f in (("roi", lambda s: series.roi_mean(s, mask)), ("betas", lambda s: series.running_betas(s, x))):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(spark.createDataFrame(rows, schema)).collect()))
