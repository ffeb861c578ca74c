import numpy as np
import pytest
from pyspark.sql import functions as F

from framealign.operators import pixels as P
from framealign.operators import spectral as H
from framealign.sources import rasters, store
from framealign.streaming import refresh


def image(spark, a, valid=None):
    h, w = a.shape
    rows = [(1, y, x, float(a[y, x]), True if valid is None else bool(valid[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "product_id long, line int, sample int, value double, valid boolean").repartition(3)


def dense(df, h, w, col="value"):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r.line, r.sample] = r[col]
    return out


def test_readers_of_many_files_and_uris(spark, tmp_path):
    rasters.register(spark)
    cubes = {"A": np.arange(3 * 10 * 8, dtype=np.float32).reshape(3, 10, 8), "B": np.arange(12 * 9 * 2, dtype=np.int16).reshape(12, 9, 2), "C": np.arange(20.0).reshape(4, 5)}
    for name, a in cubes.items():
        np.save(tmp_path / f"{name.lower()}.npy", a)
        (tmp_path / f"{name.lower()}.img").write_bytes(bytes(range(1, 25)))
    (tmp_path / "_skipped.npy").write_bytes(b"no array")
    for path in (f"{tmp_path}/*.npy", f"file://{tmp_path}/?.npy", ",".join(f"{tmp_path}/{n}.npy" for n in "abc")):
        got = spark.read.format("npy_cube").options(path=path, rows=3).load().collect()
        assert len(got) == sum(a.size for a in cubes.values())
    for r in got:
        a = cubes[r.product_id]
        assert r.value == (a[r.line, r.sample] if a.ndim == 2 else a[r.line, r.sample, r.band] if r.product_id == "B" else a[r.band, r.line, r.sample])
    window = spark.read.format("raw_raster").options(path=f"file://{tmp_path}/*.img", lines=4, samples=6, dtype="u1").load().filter("line >= 1 and line <= 2 and sample > 1 and sample < 4")
    assert sorted((r.product_id, r.line, r.sample, r.value) for r in window.collect()) == [(p, y, x, y * 6 + x + 1) for p in "ABC" for y in (1, 2) for x in (2, 3)]
    reader = rasters.RawReader({"path": f"{tmp_path}/a.img", "lines": "4", "samples": "6", "dtype": "u1"})
    list(reader.pushFilters([rasters.GreaterThanOrEqual(("sample",), 2), rasters.LessThanOrEqual(("sample",), 3), rasters.EqualTo(("line",), 1)]))
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [2]
    with pytest.raises(FileNotFoundError):
        rasters.files_of(f"{tmp_path}/nothing*.npy")


@pytest.mark.parametrize("dtype", ["u1", ">i2", "<f4"])
def test_raw_reader(spark, tmp_path, dtype):
    a = (np.arange(20 * 7).reshape(20, 7) % 90).astype(dtype)
    path = tmp_path / "m1.img"
    path.write_bytes(b"L" * 11 + b"".join(b"PP" + r.tobytes() + b"S" for r in a))
    rasters.register(spark)
    read = spark.read.format("raw_raster").options(path=str(path), lines=20, samples=7, dtype=dtype, offset=11, prefix=2, suffix=1, rows=6).load()
    assert (dense(read, 20, 7) == a).all()
    assert read.filter("not valid").count() == (a <= 0).sum() and read.first().product_id == "M1"
    assert read.filter("line >= 5 and line < 8").count() == 21
    thin = spark.read.format("raw_raster").options(path=str(path), lines=20, samples=7, dtype=dtype, offset=11, prefix=2, suffix=1, stride=3).load()
    assert sorted({(r.line, r.sample) for r in thin.collect()}) == [(y, x) for y in range(0, 20, 3) for x in range(0, 7, 3)]
    assert {r.line: r.n for r in rasters.bounded_reads(read, 20).collect()} == {0: 7, 10: 7, 19: 7}
    with pytest.raises(Exception, match="shorter"):
        spark.read.format("raw_raster").options(path=str(path), lines=21, samples=7, dtype=dtype, offset=11, prefix=2, suffix=1).load().count()


def test_cube_reader(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(6, 9, 3)).astype(np.float32)
    np.save(tmp_path / "c.npy", a)
    rasters.register(spark)
    read = spark.read.format("npy_cube").options(path=str(tmp_path / "c.npy"), rows=2).load()
    assert all(np.float32(r.value) == a[r.line, r.sample, r.band] for r in read.collect()) and read.count() == a.size


def test_pixel_kernels(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 255, (14, 17)).astype(float)
    valid = rng.random(a.shape) > 0.05
    df = image(spark, a, valid)
    gx = sum(w * a[1 + dy : 13 + dy, 1 + dx : 16 + dx] for (dy, dx), w in P.SOBEL["gx"].items())
    gy = sum(w * a[1 + dy : 13 + dy, 1 + dx : 16 + dx] for (dy, dx), w in P.SOBEL["gy"].items())
    assert np.allclose(dense(P.gradient(df), 14, 17, "magnitude")[1:13, 1:16], np.hypot(gx, gy))
    er = np.ones_like(valid)
    for y in range(14):
        for x in range(17):
            er[y, x] = valid[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].all()
    assert (dense(P.eroded(df, 3), 14, 17, "valid") == er).all()
    flat = P.half(image(spark, np.full((9, 9), 5.0)))
    assert np.allclose(dense(flat, 5, 5), 5.0)
    shift = dense(P.warp(df.withColumn("valid", F.lit(True)), np.array([[1, 0, 2.5], [0, 1, 1], [0, 0, 1.0]]), 14, 17).filter("valid"), 14, 17)
    assert np.allclose(shift[1:14, 3:17], (a[:13, :14] + a[:13, 1:15]) / 2, equal_nan=True)
    same = P.tiled(df, lambda v, ok: v * 2, 3, tile=5)
    assert np.allclose(dense(same, 14, 17), a * 2) and same.count() == a.size
    assert P.stretch(image(spark, np.ones((20, 20)))).first().status == "FAILED"
    assert P.crop(df, F.lit(2), F.lit(5), F.lit(1), F.lit(4)).count() == 9


def test_spectral(spark):
    rng = np.random.default_rng(3)
    cube = rng.normal(50, 10, (4, 6, 8)) + np.arange(4)[:, None, None] * 30
    cube[1, 2, 3], cube[0, 0, 0], cube[2, 1, 1] = -9999, np.nan, 2e6
    rows = [(1, b, y, x, float(cube[b, y, x])) for b in range(4) for y in range(6) for x in range(8)]
    df = spark.createDataFrame(rows, "product_id long, band int, line int, sample int, value double")
    clean = H.clean(df)
    assert clean.filter("not valid").count() == 3
    got = {r.band: r for r in H.band_stats(clean).collect()}
    ok = [np.delete(cube[b].ravel(), i) if i is not None else cube[b].ravel() for b, i in ((0, 0), (1, 19), (2, 9), (3, None))]
    for b in range(4):
        assert np.allclose((got[b].p01, got[b].p99, got[b].median, got[b].mean, got[b]["std"]), (*np.percentile(ok[b], (1, 99, 50)), ok[b].mean(), ok[b].std()))
    z = H.normalise(clean, "standardize").filter("valid").groupBy("band").agg(F.avg("value"), F.stddev_pop("value")).collect()
    assert all(abs(r[1]) < 1e-9 and abs(r[2] - 1) < 1e-9 for r in z)
    vec = clean.groupBy("product_id", "line", "sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "value"))), lambda x: x["value"]).alias("v"))
    found = H.principal_components(vec, "v", 4)
    x = np.array([r.v for r in vec.collect()])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    share = found.first().share
    assert np.allclose(share, values / values.sum()) and (np.diff(share) <= 1e-12).all()
    pc = np.array([tuple(r)[-4:] for r in H.project_components(vec, "v", found, 4).collect()])
    assert np.allclose(np.cov(pc.T), np.diag(values), atol=1e-6)
    for mode in ("automatic", "pca", "composite", "selected_band", "gradient", "something else"):
        out = H.representation(clean, 4, mode).collect()
        assert len(out) == 48 and all(0 <= r.value <= 255 for r in out)
    assert H.validate(df.withColumn("valid", H.usable(F.col("value")))).first().status == "ok"


def test_components_are_of_each_product(spark):
    rng = np.random.default_rng(8)
    x = {p: rng.normal(size=(n, 3)) * scale + p for p, n, scale in ((1, 40, (5, 1, 0.1)), (2, 25, (0.1, 1, 7)), (3, 1, (1, 1, 1)))}
    rows = [(p, k, [float(a) for a in r]) for p, held in x.items() for k, r in enumerate(held)] + [(1, 99, None)]
    df = spark.createDataFrame(rows, "product_id long, k long, v array<double>").repartition(5)
    cov = {(r.product_id, r.i, r.j): r.cov for r in H.covariance(df, "v").collect()}
    assert len(cov) == 12 and all(np.isclose(cov[p, i, j], np.cov(x[p].T)[i, j]) for p, i, j in cov)
    found = {r.product_id: r for r in H.principal_components(df, "v").collect()}
    assert sorted(found) == [1, 2]
    assert abs(found[1].loadings[0][0]) > 0.9 and abs(found[2].loadings[0][2]) > 0.9 and all(max(row, key=abs) > 0 for r in found.values() for row in r.loadings)
    scored = H.project_components(df, "v", H.principal_components(df, "v")).collect()
    assert all((r.pc1 is None) == (r.product_id == 3 or r.v is None) for r in scored)


def equalised(image, limit=2.0, grid=8):
    """The same operator over a whole array."""
    h, w = image.shape
    fy, fx = (h - 1 + grid) // grid, (w - 1 + grid) // grid
    ny, nx = (h - 1) // fy + 1, (w - 1) // fx + 1
    maps = np.zeros((ny, nx, 256))
    for i in range(ny):
        for j in range(nx):
            part = image[i * fy : (i + 1) * fy, j * fx : (j + 1) * fx].ravel()
            hist = np.bincount(part, minlength=256).astype(float)
            most = max(1.0, limit * len(part) / 256)
            maps[i, j] = np.cumsum(np.minimum(hist, most) + np.maximum(hist - most, 0).sum() / 256) * 255 / len(part)
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            v, u = (y + 0.5) / fy - 0.5, (x + 0.5) / fx - 0.5
            i, j = min(ny - 1, max(0, int(np.floor(v)))), min(nx - 1, max(0, int(np.floor(u))))
            a, b = min(1, max(0, v - i)), min(1, max(0, u - j))
            i1, j1 = min(ny - 1, i + 1), min(nx - 1, j + 1)
            at = maps[:, :, image[y, x]]
            out[y, x] = (1 - a) * ((1 - b) * at[i, j] + b * at[i, j1]) + a * ((1 - b) * at[i1, j] + b * at[i1, j1])
    return np.rint(np.round(np.clip(out, 0, 255), 6)).astype(int)


def test_equalise_is_over_the_whole_image(spark):
    rng = np.random.default_rng(6)
    a = np.clip(rng.normal(90, 20, (37, 300)) + np.arange(300)[None, :] / 4, 0, 255).astype(np.uint8)
    rows = [(7, y, x, float(a[y, x]), True) for y in range(37) for x in range(300)]
    got = P.equalise(spark.createDataFrame(rows, "product_id long, line int, sample int, value double, valid boolean")).collect()
    out = np.zeros(a.shape, int)
    for r in got:
        out[r.line, r.sample] = r.value
    assert len(got) == a.size and (out == equalised(a)).all()


def test_resize_kinds(spark):
    a = np.arange(48, dtype=float).reshape(6, 8) ** 1.5
    df = spark.createDataFrame([(1, y, x, float(a[y, x]), (y, x) != (0, 0)) for y in range(6) for x in range(8)], "product_id long, line int, sample int, value double, valid boolean")

    def run(h, w, kind):
        out, ok = np.full((h, w), np.nan), np.zeros((h, w), bool)
        for r in P.resize(df, h, w, kind).collect():
            out[r.line, r.sample], ok[r.line, r.sample] = r.value, r.valid
        return out, ok

    assert np.allclose(run(3, 4, "area")[0], a.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert np.allclose(run(12, 16, "nearest")[0], np.kron(a, np.ones((2, 2)))) and run(12, 16, "nearest")[1].sum() == 12 * 16 - 4
    ys, xs = np.clip((np.arange(9) + 0.5) * 6 / 9 - 0.5, 0, 5), np.clip((np.arange(5) + 0.5) * 8 / 5 - 0.5, 0, 7)
    rows = np.array([np.interp(xs, np.arange(8), r) for r in a])
    assert np.allclose(run(9, 5, "linear")[0], np.array([np.interp(ys, np.arange(6), c) for c in rows.T]).T)
    assert np.allclose(run(6, 8, "lanczos")[0], a) and not np.isnan(run(7, 9, "lanczos")[0]).any()
    assert np.allclose(run(4, 3, "area")[0].mean(), a.mean())


def test_store_and_refresh(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0), (2, 3.0)], "pair_id long, e double")
    path = str(tmp_path / "runs")
    store.save_experiment(rows, path)
    store.save_experiment(spark.createDataFrame([(2, 9.0)], "pair_id long, e double"), path)
    assert [r.pair_id for r in store.list_experiments(spark, path).collect()] == [1, 2]
    assert store.load_experiment(spark, path, 2).first().e == 9.0 and store.load_experiment(spark, path, 7).count() == 0
    store.write_correspondences(rows, str(tmp_path / "csv"))
    store.write_report(rows, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2 and spark.read.json(str(tmp_path / "json")).count() == 2
    new = refresh.changed(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string"), spark.createDataFrame([("a", "1"), ("b", "0")], "path string, content_hash string"))
    assert [r.path for r in new.collect()] == ["b"]


def test_arriving_files_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m1le.img").write_bytes(b"abc")
    stream = refresh.arriving(spark, str(tmp_path / "in"))
    run = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = spark.table("arrived").collect()
    assert [(r.product_type, r.content_hash) for r in got] == [("LRO_PDS3_BINARY", "ba7816bf8f01cfea")]
