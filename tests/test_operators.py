import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import design, glm, grid, learning, permutation, registration, spatial, temporal
from voxelframe.plans.further import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def series(spark, a):
    x, y, z, t = a.shape
    rows = [(i, j, k, m, float(a[i, j, k, m])) for i in range(x) for j in range(y) for k in range(z) for m in range(t)]
    return spark.createDataFrame(rows, "x int, y int, z int, t int, v double")


def test_t_map_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2, 2, 2, 12))
    x = np.column_stack([np.arange(12) % 2, np.ones(12)]).astype(float)
    got = {(r.x, r.y, r.z): r.stat for r in glm.t_map(series(spark, a), x, np.array([1.0, 0.0])).collect()}
    for i in np.ndindex(2, 2, 2):
        b = np.linalg.lstsq(x, a[i], rcond=None)[0]
        e = a[i] - x @ b
        assert got[i] == pytest.approx(b[0] / np.sqrt(e @ e / 10 * np.linalg.inv(x.T @ x)[0, 0]), abs=1e-9)


def test_whitening_round_trip_and_ar(spark):
    rng = np.random.default_rng(1)
    y = np.zeros((1, 1, 1, 400))
    for t in range(1, 400):
        y[0, 0, 0, t] = 0.6 * y[0, 0, 0, t - 1] + rng.normal()
    df = series(spark, y)
    ar = temporal.solve_ar(temporal.lag_products(df, 400))
    v = y[0, 0, 0]
    c = np.array([(v[k:] * v[: 400 - k]).sum() / (399 - k) for k in range(5)])
    lag = np.abs(np.subtract.outer(np.arange(4), np.arange(4)))
    want = np.linalg.solve((c / c[0])[lag] + 0.001 * (lag > 0), c[1:] / c[0])
    assert np.allclose([ar.first()[f"a{k}"] for k in range(1, 5)], want)
    back = temporal.inverse_whiten(temporal.whiten(df, ar), ar).orderBy("t").toPandas()["v"].to_numpy()
    assert np.allclose(back, y[0, 0, 0])


def test_clusters_match_flood_fill(spark):
    rng = np.random.default_rng(2)
    a = rng.random((6, 5, 4)) > 0.75
    df = spark.createDataFrame([(int(i), int(j), int(k), float(a[i, j, k])) for i, j, k in np.ndindex(a.shape)], "x int, y int, z int, v double")
    got = {(r.x, r.y, r.z): r.cluster for r in spatial.clusters(df, 0.5, 6, 5).collect()}
    seen = {}
    for start in zip(*np.nonzero(a)):
        if start in seen:
            continue
        todo, comp = [start], []
        seen[start] = start
        while todo:
            p = todo.pop()
            comp.append(p)
            for d in np.ndindex(3, 3, 3):
                q = tuple(int(u + v - 1) for u, v in zip(p, d))
                if all(0 <= u < n for u, n in zip(q, a.shape)) and a[q] and q not in seen:
                    seen[q] = start
                    todo.append(q)
        least = min(i + j * 6 + k * 30 for i, j, k in comp)
        assert {got[tuple(map(int, p))] for p in comp} == {least}


def test_smoothing_keeps_constants_inside_mask(spark):
    cells = grid.grid(spark, 5, 5, 4)
    mask = cells.withColumn("m", F.when(F.col("x") > 1, 1.0).otherwise(0.0))
    out = spatial.smooth(cells.withColumn("v", F.lit(3.0)), spatial.gaussian(4.0), mask).where("x > 1")
    assert all(abs(r.v - 3) < 1e-9 for r in out.collect())


def test_affine_algebra_and_alignment():
    p = np.array([1, -2, 0.5, 0.1, 0, 0.02, 0, -0.1, 0, 0.03, 0, 0.05])
    assert np.allclose(registration.compose(p, registration.invert(p)), 0)
    z, y, x = np.meshgrid(*(np.arange(20.0),) * 3, indexing="ij")
    blob = lambda dx: np.exp(-((x - 9.5 - dx) ** 2 + (y - 9.5) ** 2 * 0.7 + (z - 9.5) ** 2 * 1.3) / 18)
    got = registration.align(blob(1.0), blob(0.0), registration.quadrature_filters(7), iterations=8, kind="translation")
    assert abs(got[0] - 1.0) < 0.2 and abs(got[1]) < 0.2


def test_permutations():
    assert len(permutation.sign_table(4, 100)) == 16
    assert permutation.most_permutations("two_sample", 10, 5) == pytest.approx(252)
    assert permutation.classify(np.ones((4, 1)), np.array([1.0])) == "mean"
    rng = np.random.default_rng(3)
    ys, x, c = rng.normal(size=(5, 9)), np.column_stack([rng.normal(size=9), np.ones(9)]), np.array([1.0, 0.0])
    t = permutation.design_t(ys, x, c, np.arange(9)[None])[:, 0]
    f = permutation.design_f(ys, x, c[None], np.arange(9)[None])[:, 0]
    assert np.allclose(t**2, f)


def test_pca_and_gibbs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) * [5, 2, 0.1]
    p = learning.pca(spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id int, f array<double>"), 0.95)
    assert len(p["values"]) == 2 and p["values"][0] == pytest.approx(np.cov(x.T)[0, 0], rel=0.05)
    d = np.column_stack([np.arange(60) % 2, np.ones(60)]).astype(float)
    y = d @ [3, 1] + rng.normal(size=60)
    packed = spark.createDataFrame([(0, 0, 0, list(map(float, y)))], "x int, y int, z int, ys array<double>")
    r = learning.gibbs(packed, d, 200, 50).first()
    assert r.p1 > 0.95 and r.p12 > 0.9


def test_events_overwrite_and_contrast_parts(spark):
    e = spark.createDataFrame([(1, 0.0, 4.0, 1.0), (2, 2.0, 4.0, 2.0)], "idx int, onset double, duration double, value double")
    box = {r.i: r.v for r in design.boxcar(e, 2.0, 10).collect()}
    assert box[0] == 1.0 and box[100] == 2.0 and len(box) == 300
    x = np.column_stack([np.arange(6.0), np.ones(6), np.arange(6) % 2])
    w1, w2 = design.partition(x, [1.0, 0, 0])
    assert np.allclose(w1.T @ w2, 0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
@pytest.mark.parametrize("name", ["e16_zscore", "w1_slice_timing", "k8_second_level_f", "p11_p_map", "c2_clusters", "f3_normalised_smoothing", "r9_affine_cubic", "m4_searchlight"])
def test_query_against_sql(spark, name):
    import duckdb

    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        assert len(got)
        return
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{DATA}/lineitem.parquet'")
    want = con.execute(SQL[name]).df()[list(got.columns)]
    keys = [c for c in ("p", "x", "y", "z", "t") if c in got.columns]
    a, b = (d.sort_values(keys).to_numpy(float) for d in (got, want))
    assert np.allclose(a, b, atol=1e-5)


def test_entry_lists_every_sql(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
