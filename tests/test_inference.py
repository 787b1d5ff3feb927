"""Known truths for what SQL can't say: whitened models, enhancement, clusters, motion, searchlights, sampling, components, whole analyses."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelframe.functions import stats
from voxelframe.operators import design, glm, learning, permutation, registration, spatial, temporal
from voxelframe.plans import analysis
from voxelframe.sources import nifti, text

SERIES = "x int, y int, z int, t int, v double"


def rows_of(a, t=None):
    """Rows of (t, z, y, x) or, with ``t``, of one volume (z, y, x)."""
    a = a[None] if t is not None else a
    n, z, y, x = (g.ravel() for g in np.meshgrid(*(np.arange(n) for n in a.shape), indexing="ij"))
    return pd.DataFrame({"x": x, "y": y, "z": z, "t": n + (t or 0), "v": a.ravel().astype(float)}).astype({k: "int32" for k in "xyzt"})


def volume_of(df, shape, column="v"):
    out, pdf = np.zeros(shape), df.toPandas()
    out[pdf["z"], pdf["y"], pdf["x"]] = pdf[column]
    return out


def null_series(n, times, rho, seed):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, times))
    for t in range(1, times):
        y[:, t] += rho * y[:, t - 1]
    return y


@pytest.fixture(scope="module")
def autocorrelated(spark):
    y = null_series(400, 120, 0.5, 1)
    x = np.column_stack([(np.arange(120) // 6 % 2).astype(float), np.ones(120)])
    df = spark.createDataFrame(pd.DataFrame({"x": np.repeat(np.arange(400), 120), "y": 0, "z": 0, "t": np.tile(np.arange(120), 400), "v": y.ravel()}).astype({k: "int32" for k in "xyzt"}))
    return df.cache(), x, y


@pytest.mark.parametrize("iterations", [1, 2, 3])
def test_null_t_keeps_unit_deviation(autocorrelated, iterations):
    df, x, _ = autocorrelated
    t = np.array([r.stat for r in glm.cochrane_orcutt(df, x, np.array([1.0, 0.0]), 120, iterations).collect()])
    assert abs(t.std() - 1) < 0.13 and abs(t.mean()) < 0.2


def test_second_iteration_takes_residuals_of_the_original(autocorrelated):
    df, x, y = autocorrelated

    def coefficients(e):
        c = [(e[k:] * e[: len(e) - k]).sum() / (119 - k) for k in range(5)]
        m = np.array([[1.0 if i == j else c[abs(i - j)] / c[0] + 0.001 for j in range(4)] for i in range(4)])
        return np.linalg.solve(m, np.array(c[1:]) / c[0])

    def white(a, v):
        return np.array([v[t] - sum(a[k] * v[t - 1 - k] for k in range(4) if t > k) for t in range(120)])[4:]

    got = {r.x: [r.a1, r.a2, r.a3, r.a4] for r in glm.estimate_ar(df.where("x < 5"), x, 120, 2).collect()}
    for i in range(5):
        a = coefficients(y[i] - x @ np.linalg.lstsq(x, y[i], rcond=None)[0])
        b = np.linalg.lstsq(np.column_stack([white(a, x[:, k]) for k in range(2)]), white(a, y[i]), rcond=None)[0]
        assert np.allclose(got[i], coefficients(y[i] - x @ b), atol=1e-9)


def plain_clusters(over):
    """{cell: frozenset of its 26-connected cluster}."""
    todo, out = set(over), {}
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            c = edge.pop()
            group.add(c)
            near = {(c[0] + a, c[1] + b, c[2] + d) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)} & todo
            todo -= near
            edge += near
        out.update(dict.fromkeys(group, frozenset(group)))
    return out


def test_enhancement_against_plain_sums(spark):
    rng = np.random.default_rng(5)
    vol = rng.gamma(1.0, 1.0, (4, 6, 5))
    levels, want = [0.5, 1.0, 1.5, 2.5], {}
    for h in levels:
        cells = {(x, y, z): vol[z, y, x] for z in range(4) for y in range(6) for x in range(5) if vol[z, y, x] > h}
        for c, group in plain_clusters(cells).items():
            want[c] = want.get(c, 0) + math.sqrt(len(group)) * h * h
    got = {(r.x, r.y, r.z): r.v for r in spatial.tfce(spark.createDataFrame(rows_of(vol, 0)).drop("t"), levels, 5, 6).collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


@pytest.mark.parametrize("what", ["size", "mass"])
def test_cluster_p_values_cover_every_voxel(spark, what):
    rng = np.random.default_rng(6)
    y = rng.normal(size=(8, 3, 5, 5))
    y[:, 1, 1:4, 1:4] += 1.5
    df, table = spark.createDataFrame(rows_of(y)), permutation.sign_table(8, 50, 3)
    sized = permutation.cluster_map(df, lambda ys: permutation.group_mean_t(ys, table[:1]), 2.0, 5, 5, what)
    null = permutation.null_of_clusters(df, permutation.group_mean_t, table, 2.0, 5, 5, what)
    got = {(r.x, r.y, r.z): (r.v, r.one_minus_p) for r in permutation.p_map(sized, null).collect()}
    largest, maps = [], permutation.group_mean_t(y.reshape(8, -1).T, table)
    for k in range(50):
        cells = {(x, b, z): maps[(z * 5 + b) * 5 + x, k] for z in range(3) for b in range(5) for x in range(5) if maps[(z * 5 + b) * 5 + x, k] > 2.0}
        groups = plain_clusters(cells)
        score = {c: len(g) if what == "size" else sum(cells[q] for q in g) for c, g in groups.items()}
        if not k:
            first = score
        largest.append(max(score.values(), default=0))
    assert len(got) == 75
    for c, (v, p) in got.items():
        assert v == pytest.approx(first.get(c, 0.0)) and p == pytest.approx(sum(m < v - 1e-9 for m in largest) / 50, abs=0.021)
    assert any(v == 0 and p == 0 for v, p in got.values()) and max(p for _, p in got.values()) > 0.9


def test_chunks_of_permutations_change_nothing(spark):
    rng = np.random.default_rng(7)
    df, table = spark.createDataFrame(rows_of(rng.normal(size=(10, 2, 3, 3)))), permutation.sign_table(10, 100, 4)
    one = sorted(map(tuple, permutation.null_of_max(df, permutation.group_mean_t, table, 7).collect()))
    assert one == sorted(map(tuple, permutation.null_of_max(df, permutation.group_mean_t, table, 1000).collect())) and len(one) == 100
    maps = permutation.permuted_maps(df, permutation.group_mean_t, table, 1.0, 9).collect()
    assert len(maps) == permutation.permuted_maps(df, permutation.group_mean_t, table).where("v > 1").count() and min(r.v for r in maps) > 1


def test_plans_of_contrasts():
    x = np.column_stack([np.ones(12), np.arange(12) < 5, np.arange(12.0)]).astype(float)
    assert permutation.plans(x, np.eye(3), 1000) == [("mean", 1), ("two_sample", 792), ("correlation", 1000)]
    assert permutation.plans(x, np.eye(3)[:2], 10_000, joint=True) == [("two_sample", 792)]
    assert permutation.plans(x, np.eye(3), 10_000, joint=True)[0][0] == "correlation"


def head(shape=(14, 16, 18), shift=(0.0, 0.0, 0.0), angle=0.0):
    """A smooth lopsided blob, moved by (x, y, z) and turned about z by ``angle`` degrees."""
    z, y, x = np.meshgrid(*(np.arange(n) - (n - 1) / 2 for n in shape), indexing="ij")
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    px, py, pz = x - shift[0], y - shift[1], z - shift[2]
    px, py = c * px + s * py, -s * px + c * py
    parts = ((100, 0, 0, 0), (90, 4.8, -3.6, 2.4), (80, -4.8, 3.6, -2.4), (70, 2.4, 4.8, 3.6), (60, -3.6, -4.8, 1.2), (80, 6, 2.4, -3.6), (70, -6, -1.2, 3.6), (60, 0, -6, -3.6))
    return sum(h * np.exp(-((px - a) ** 2 + (py - b) ** 2 + (pz - d) ** 2) / 5) for h, a, b, d in parts)


def test_motion_is_found_and_undone(spark):
    rng = np.random.default_rng(8)
    moves = [((0.0, 0.0, 0.0), 0.0)] + [(tuple(rng.uniform(-1, 1, 3)), float(rng.uniform(-3, 3))) for _ in range(5)]
    series = np.stack([head(shift=m, angle=a) for m, a in moves])
    got = registration.motion_correct(spark.createDataFrame(rows_of(series)), (18, 16, 14))
    params = {r.t: r for r in got.groupBy("t").agg(*(F.max(f"p{k}").alias(f"p{k}") for k in range(6))).collect()}
    for t, (m, a) in enumerate(moves):
        p = params[t]
        assert np.allclose([p.p0, p.p1, p.p2], m, atol=0.15) and abs(abs(p.p5) - abs(a)) < 0.5
        back = volume_of(got.where(F.col("t") == t), series.shape[1:])
        if t:
            assert np.abs(back - series[0]).mean() < 0.35 * np.abs(series[t] - series[0]).mean()


def test_affine_system_is_solved():
    rng = np.random.default_rng(9)
    p, row = rng.normal(size=12), {}
    for axis in range(3):
        g = rng.normal(size=200)
        places = np.stack([np.ones(200), *rng.normal(size=(3, 200))])
        d = g * (p[axis] * places[0] + places[1:].T @ p[3 + 3 * axis : 6 + 3 * axis])
        names = "1xyz"
        for i in range(4):
            row[f"h{axis}_{names[i]}"] = (g * d * places[i]).sum()
            for j in range(i, 4):
                key = "".join(k for k in names[i] + names[j] if k != "1") or "1"
                row[f"a{axis}_{key}"] = (g * g * places[i] * places[j]).sum()
    assert np.allclose(registration.solve_affine(row), p)


def test_functional_to_anatomical():
    t1 = head((20, 24, 26))
    small = registration.to_grid(head((20, 24, 26), (1.5, -1.0, 0.5)), (1, 1, 1), (2, 2, 2), (10, 12, 13))
    p, out = registration.epi_to_t1(1.0 + 0.5 * small, t1, (2, 2, 2), (1, 1, 1))
    assert np.allclose(p[:3], (1.5, -1.0, 0.5), atol=0.8)
    inside = t1 > 0.2 * t1.max()
    start = registration.to_grid(registration.segment(1.0 + 0.5 * small), (2, 2, 2), (1, 1, 1), t1.shape)
    assert np.corrcoef(out[inside], t1[inside])[0, 1] > np.corrcoef(start[inside], t1[inside])[0, 1]
    assert np.allclose(registration.to_grid(t1, (1, 1, 1), (1, 1, 1), t1.shape), t1)


def test_searchlight_against_loops(spark):
    rng = np.random.default_rng(10)
    classes = [int(t % 2) for t in range(10)] + [learning.CENSORED]
    y = rng.normal(size=(11, 3, 4, 3))
    y[:, 1, 1, 1] += 3 * np.array([1 if c == 0 else -1 for c in classes])
    got = {(r.x, r.y, r.z): r.accuracy for r in learning.searchlight(glm.pack(spark.createDataFrame(rows_of(y))), classes, (3, 4, 3), epochs=5).collect()}
    assert len(got) == 36 and got[0, 0, 0] == 0.0
    for b in (1, 2):
        f = np.array([y[:10, 1 + dz, b + dy, 1 + dx] for dx, dy, dz in learning.NEIGHBOURS] + [np.ones(10)])
        d, right = np.array([1.0 if c == 0 else -1.0 for c in classes[:10]]), 0
        for out in range(10):
            w = np.zeros(20)
            for _ in range(5):
                step = np.zeros(20)
                for t in range(10):
                    if t != out:
                        step += f[:, t] * (w @ f[:, t] - d[t])
                w = w - 0.01 / 10 * step
            right += (w @ f[:, out] > 0) == (d[out] > 0)
        assert got[1, b, 1] == pytest.approx(right / 10)


def test_gibbs_shares_follow_the_posterior(spark):
    rng = np.random.default_rng(11)
    x = np.column_stack([np.arange(80) // 8 % 2, np.ones(80)]) - [[0.5, 0]]
    y = null_series(40, 80, 0.3, 12) + np.linspace(-1, 1, 40)[:, None] * x[:, 0]
    df = spark.createDataFrame([(i, 0, 0, list(map(float, v))) for i, v in enumerate(y)], "x int, y int, z int, ys array<double>")
    got = learning.gibbs(df, x, 400, 50).toPandas().sort_values("x")
    again = learning.gibbs(df.repartition(7), x, 400, 50).toPandas().sort_values("x")
    assert np.array_equal(got.to_numpy(), again.to_numpy())
    z = []
    for v in y:
        wy, wx = v[1:] - 0.3 * v[:-1], x[1:] - 0.3 * x[:-1]
        b = np.linalg.lstsq(wx, wy, rcond=None)[0]
        s2 = ((wy - wx @ b) ** 2).sum() / 77
        z.append(b[0] / math.sqrt(s2 * np.linalg.inv(wx.T @ wx)[0, 0]))
    normal = np.array([0.5 * (1 + math.erf(k / math.sqrt(2))) for k in z])
    assert np.abs(got["p1"].to_numpy() - normal).mean() < 0.04 and np.allclose(got["p1"] + got["n1"], 1)
    assert abs(got["rho"].mean() - 0.3) < 0.1
    draws = learning.Draws(np.arange(20_000), 3)
    draws.next_step()
    g = draws.gamma(5.0)
    assert abs(g.mean() - 5) < 0.1 and abs(g.var() - 5) < 0.3


def test_components_are_separated(spark):
    rng = np.random.default_rng(13)
    s = np.stack([rng.laplace(size=4000), np.sign(rng.normal(size=4000)) * rng.exponential(size=4000) ** 1.5, rng.laplace(size=4000) ** 3])
    x = (rng.normal(size=(3, 3)) @ (s / s.std(axis=1, keepdims=True))).T
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id int, f array<double>")
    p = learning.pca(df, 1.0)
    assert np.allclose(p["values"], np.linalg.eigvalsh(np.cov(x.T))[::-1]) and np.allclose(np.cov(((x - p["mean"]) @ p["whiten"].T).T), np.eye(3), atol=1e-8)
    w = learning.infomax(((x - p["mean"]) @ p["whiten"].T).T)
    got = np.array([r.s for r in learning.project(df, w @ p["whiten"], p["mean"], ["id"]).orderBy("id").collect()]).T
    match = np.abs(np.corrcoef(np.vstack([got, s]))[:3, 3:])
    assert (match.max(axis=0) > 0.95).all()
    rows = learning.project(df, p["whiten"], p["mean"], ["id"])
    few, other = (learning.infomax_rows(r, 3, steps=8) for r in (rows, rows.repartition(7)))
    assert np.allclose(few, other, atol=1e-9)
    one = learning.infomax_rows(rows, 3, steps=100, rate=0.2)
    match = np.abs(np.corrcoef(np.vstack([one @ ((x - p["mean"]) @ p["whiten"].T).T, s]))[:3, 3:])
    assert (match.max(axis=0) > 0.95).all()


def test_first_level_from_volumes_to_reference(spark):
    rng = np.random.default_rng(14)
    times, shape = 40, (6, 8, 9)
    task = (np.arange(times) // 5 % 2).astype(float)
    base = head(shape) + 20
    active = np.zeros(shape)
    active[2:4, 3:5, 4:6] = 8
    series = base[None] + task[:, None, None, None] * active[None] + rng.normal(size=(times, *shape))
    df = spark.createDataFrame(rows_of(series))
    mask = spark.createDataFrame(rows_of((base > 22).astype(float), 0)).select("x", "y", "z", F.col("v").alias("m"))
    x = np.column_stack([task, np.ones(times)])
    move = np.zeros(12)
    move[0] = 1.0
    plan = analysis.FirstLevel((9, 8, 6), x, np.array([[1.0, 0.0]]), deltas=[0.0] * 6, motion=False, kernel=spatial.gaussian(2.0, taps=5), ar_kernel=spatial.gaussian(3.0, taps=5), affine=move)
    clock = analysis.StageTimes(lambda d, name: d.cache())
    out = plan.run(df, mask, clock)
    t = volume_of(out["maps"], shape, "t0")
    assert t[2:4, 3:5, 4:6].min() > 5 and np.abs(t[active == 0]).mean() < 3
    assert set(clock.seconds) == {"slice_timing", "smoothing", "model", "transform"}
    there = volume_of(out["reference"], shape, "t0")
    assert np.allclose(there[:, :, :-1], t[:, :, 1:], atol=1e-6)
    assert {r.map for r in out["results"].select("map").distinct().collect()} == {"b0", "b1", "c0", "t0"}
    plan.outputs = "preprocess"
    assert set(plan.run(df, mask)) == {"data"}
    plan.outputs = "regress"
    assert plan.run(df, mask)["residuals"].count() == times * 6 * 8 * 9


def test_interfaces(spark):
    vol = head((8, 9, 10))
    one = spark.createDataFrame(rows_of(vol, 0))
    out = analysis.Smoothing(3.0, automask=True).run(one)
    assert out["mask"].count() == vol.size and out["smoothed"].count() == vol.size
    series = spark.createDataFrame(rows_of(np.stack([vol, vol])))
    assert analysis.MotionCorrection(1).run(series, (10, 9, 8))["parameters"].count() == 2
    mask = one.select("x", "y", "z", F.lit(1.0).alias("m"))
    got = analysis.RegisterTwoVolumes(2, 1, scales=1, mask=mask).run(one.drop("t"), one.drop("t"), (10, 9, 8))
    assert set(got) == {"linear", "nonlinear", "masked"} and np.abs(volume_of(got["linear"], vol.shape) - vol).max() < 1.0


def test_tails_and_their_inverses():
    f = np.array([0.0, 0.1, 1.0, 3.5, 40.0])
    assert np.allclose(stats.f_tail(f, 2, 12), (1 + 2 * f / 12) ** -6) and np.allclose(stats.f_tail(f, 1, 7), 2 * stats.t_tail(np.sqrt(f), 7))
    x = np.array([0.0, 0.2, 2.0, 9.0, 60.0])
    assert np.allclose(stats.chi2_tail(x, 2), np.exp(-x / 2)) and np.allclose(stats.chi2_tail(x, 1), [math.erfc(math.sqrt(v / 2)) for v in x], atol=1e-12)
    assert np.allclose(stats.inverse_tail(lambda v: stats.chi2_tail(v, 5), stats.chi2_tail(x, 5))[:4], x[:4], atol=1e-7)


def test_files_of_a_dataset(spark, tmp_path):
    for s, runs in (("01", (1, 2)), ("02", (None,))):
        folder = tmp_path / f"sub-{s}" / "func"
        folder.mkdir(parents=True)
        for k in runs:
            stem = f"sub-{s}_task-rest" + (f"_run-{k}" if k else "")
            nifti.write_file(str(folder / f"{stem}_bold.nii.gz"), np.zeros((2, 2, 2, 2)))
            if k != 2:
                (folder / f"{stem}_events.tsv").write_text("onset\tduration\ttrial_type\n1\t2\ta b\n")
    got = sorted((r.subject, r.task, r.run, r.events is not None) for r in text.discover_runs(spark, str(tmp_path)).collect())
    assert got == [("01", "rest", 1, True), ("01", "rest", 2, False), ("02", "rest", 1, True)]
    (tmp_path / "a.txt").write_text("NumEvents 2\n0 2 1\n6 2 2\n")
    (tmp_path / "b.txt").write_text("NumEvents 0\n")
    (tmp_path / "list.txt").write_text("NumRegressors 2\na.txt b.txt\n")
    assert text.regressors(spark, str(tmp_path / "list.txt"), 2.0, 5).T.tolist() == [[1, 0, 0, 2, 0], [0] * 5]
    (tmp_path / "list.txt").write_text("NumRegressors 3\na.txt b.txt\n")
    with pytest.raises(ValueError):
        text.regressors(spark, str(tmp_path / "list.txt"), 2.0, 5)
    table = permutation.permutation_table(6, 4, 1)
    text.write_vectors(str(tmp_path / "p.txt"), table)
    assert np.array_equal(text.permutations(str(tmp_path / "p.txt"), count=4, subjects=6), table)
    for wrong in ({"count": 5}, {"subjects": 5}, {"one_based": False}):
        with pytest.raises(ValueError):
            text.permutations(str(tmp_path / "p.txt"), **wrong)
    text.write_vectors(str(tmp_path / "s.txt"), permutation.sign_table(3, 8), one_based=False)
    assert text.signs(str(tmp_path / "s.txt"), 8, 3).shape == (8, 3)
    with pytest.raises(ValueError):
        text.signs(str(tmp_path / "p.txt"))
    np.arange(24, dtype="<f4").tofile(tmp_path / "f.raw")
    raw = {(r.i0, r.i1, r.i2): r.v for r in text.raw_floats(spark, str(tmp_path / "f.raw"), (4, 3, 2)).collect()}
    assert raw[1, 0, 0] == 1 and raw[0, 1, 0] == 4 and raw[3, 2, 1] == 23
    copes = spark.createDataFrame([("b", 0, 0, 0, 2.0), ("a", 0, 0, 0, 1.0), ("c", 0, 0, 0, 3.0)], "subject string, x int, y int, z int, v double")
    assert sorted((r.t, r.v) for r in text.group_copes(copes, ["b", "a"]).collect()) == [(0, 2.0), (1, 1.0)]


def test_design_helpers():
    assert design.temporal_derivative(np.array([1.0, 4.0, 2.0])).tolist() == [0, 3, -2]
    x = np.column_stack([np.arange(4.0), np.ones(4)])
    assert np.allclose(design.demean(x, (1,)), np.column_stack([np.arange(4) - 1.5, np.ones(4)]))
    assert temporal.trends(5, 3).shape == (5, 3)
