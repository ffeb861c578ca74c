import random

import numpy as np
from pyspark.sql import functions as F

from framealign.operators import evaluation as E
from framealign.operators import fitting as FIT
from framealign.operators import matching as M


def test_two_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 7)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(30, 5)), rng.normal(size=(25, 5))
    b[3] = b[4]
    frame = lambda x: spark.createDataFrame([(1, k, [float(v) for v in r]) for k, r in enumerate(x)] + [(2, 99, [0.0] * 5)], "pair_id long, kp_id long, descriptor array<float>")
    got = {r.q: (r.t1, r.d1, r.d2) for r in M.two_nearest(frame(a), frame(b)).collect()}
    assert 99 not in got and len(got) == 30
    for q, x in enumerate(np.float32(a).astype(float)):
        d = np.sqrt(((x - np.float32(b).astype(float)) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(25), d))
        assert got[q][0] == order[0] and np.allclose(got[q][1:], d[order[:2]])


def test_hamming(spark):
    df = spark.createDataFrame([([7, 0], [0, -1])], "a array<long>, b array<long>")
    assert df.select(M.hamming(F.col("a"), F.col("b"))).first()[0] == 67


def test_greedy_cells_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(p, k, rng.randrange(6), rng.randrange(5), round(rng.random(), 1)) for p in range(4) for k in range(120)] + [(9, 0, 1, 1, 0.5)]
    df = spark.createDataFrame(rows, "pair_id long, row_ord long, s_cell int, r_cell int, score double").repartition(5)
    got = {(r.pair_id, r.row_ord) for r in M.greedy_cells(df, 4).collect()}
    want = set()
    for p in (0, 1, 2, 3, 9):
        s, t = {}, {}
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (r[4], r[1])):
            if s.get(r[2], 0) < 4 and t.get(r[3], 0) < 4:
                s[r[2]], t[r[3]] = s.get(r[2], 0) + 1, t.get(r[3], 0) + 1
                want.add(r[:2])
    assert got == want
    assert {r.pair_id: r.status for r in M.greedy_cells(df, 4).collect()}[9] == "FAILED"


def test_robust_fit_recovers_maps_under_outliers(spark):
    rng = np.random.default_rng(4)
    s = rng.uniform(0, 500, (200, 2))
    for model, h in (("Homography", np.array([[1.1, 0.05, 12], [-0.04, 0.95, -8], [1e-4, -5e-5, 1]])), ("Affine", np.array([[1.1, 0.05, 12], [-0.04, 0.95, -8], [0, 0, 1]]))):
        r = FIT.apply(h, s) + rng.normal(0, 0.2, s.shape)
        r[:60] = rng.uniform(0, 500, (60, 2))
        rows = [(1, *map(float, (*a, *b))) for a, b in zip(s, r)] + [(2, 1.0, 1.0, 1.0, 1.0)] * 5
        out = {x.pair_id: x for x in FIT.fit_pairs(spark.createDataFrame(rows, "pair_id long, sx double, sy double, rx double, ry double"), model).collect()}
        assert out[1].status == "OK" and 138 <= out[1].inlier_count <= 145 and out[2].status == "FAILED" and out[1].verifier == "RANSAC"
        assert np.abs(FIT.apply(np.reshape(out[1].h, (3, 3)), s) - FIT.apply(h, s)).max() < 1.5


def test_residual_field(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 100, (50, 2))
    u, v = p[:, 0] / 100, p[:, 1] / 100
    d = 1 + 2 * u - v
    df = spark.createDataFrame([(1, *map(float, (*a, b))) for a, b in zip(p, d)] + [(2, 1.0, 1.0, 1.0)], "g long, x double, y double, d double")
    sums = FIT.normal_sums(df, ["g"], FIT.design(F.col("x"), F.col("y"), F.lit(100.0), F.lit(100.0)), {"d": F.col("d")})
    got = {r.g: r.d for r in FIT.solve_field(sums, ["g"], ["d"]).collect()}
    a = np.c_[np.ones(50), u, v, u * u, u * v, v * v]
    assert np.allclose(got[1], np.linalg.solve(a.T @ a + np.diag([0, 0, 0, 0.05, 0.05, 0.05]), a.T @ d)) and got[2] is None


def test_transform_between_original_pixels(spark):
    h = F.array(*[F.lit(float(x)) for x in (1, 0, 5, 0, 1, 7, 0, 0, 1)])
    got = spark.range(1).select(E.original_transform(h, (F.lit(0.5), F.lit(0.5)), (F.lit(2.0), F.lit(2.0)))).first()[0]
    assert np.allclose(got, (np.diag([2, 2, 1]) @ np.array([[1, 0, 5], [0, 1, 7], [0, 0, 1]]) @ np.linalg.inv(np.diag([0.5, 0.5, 1]))).ravel())


def test_learned_matches_and_scales(spark):
    rows = [(1, 0.9, True, True, 0, 1.0), (2, 0.34, True, True, 1, 2.0), (3, 0.5, None, True, 2, 3.0), (4, 0.95, True, True, 3, 4.0)]
    df = spark.createDataFrame(rows, "id long, confidence double, s_valid boolean, r_valid boolean, row_ord long, sx double").withColumns({"sy": F.col("sx"), "rx": F.col("sx"), "ry": F.col("sx")})
    assert [r.id for r in M.confident(df).collect()] == [4, 1]
    assert tuple(M.rescaled(df, 2.0, 4.0).filter("id = 3").select("sx", "sy", "rx", "ry").first()) == (6.0, 6.0, 12.0, 12.0)


def test_fusion_takes_the_better_score_either_way(spark):
    rows = [(1, 0.04, 0.0, 0.0, 0.0, 0.5, 0, 0), (1, 0.0, 0.0, 0.0, 0.0, 0.2, 1, 0), (1, 0.0, 0.0, 0.0, 0.0, 0.2, 0, 1), (1, 0.2, 0.0, 0.0, 0.0, 0.9, 0, 2)]
    df = spark.createDataFrame(rows, "pair_id long, sx double, sy double, rx double, ry double, score double, run_ord int, row_ord int")
    best = lambda up: sorted((r.score, r.row_ord, r.run_ord) for r in M.fuse(df, up).collect())
    assert best(False) == [(0.2, 1, 0), (0.9, 2, 0)] and best(True) == [(0.5, 0, 0), (0.9, 2, 0)]


def test_robust_fit_query_takes_all_points(spark):
    from framealign.plans import registry, roles

    folder = "/root/testdata/sf0.001"
    got = {r.pair_id: r.inlier_count + r.outlier_count for r in registry.robust_fit(spark, folder).collect()}
    want = {r.pair_id: r["count"] for r in roles.points(spark, folder).groupBy("pair_id").count().collect()}
    assert got == want and max(want.values()) > 400
