import io

import numpy as np
from pyspark.sql import functions as F

from framealign.functions import raster_spec as R
from framealign.functions import report as T
from framealign.operators import pixels as P
from framealign.sources import cubes


def test_texts(spark):
    got = spark.range(1).select(
        T.sample_name(F.lit("LSB_UNSIGNED_INTEGER"), F.lit(None)), T.sample_name(F.lit(None).cast("string"), F.lit("<i2")), T.sample_name(F.lit("odd"), F.lit(None).cast("string")), T.scale_text(F.lit(0.25), F.lit(1.945)),
        T.scale_text(F.lit(None).cast("double"), F.lit(1.0)), T.scale_text(F.lit(0.0), F.lit(1.0)), T.figure(F.lit(None).cast("double"), 2), T.percent(F.lit(0.8091)), T.corner_text(F.lit(-89.2), F.lit(10.0)), T.status_display(F.lit("DEMO")), T.elevation_difference(F.lit(3.0), F.lit(5.5)),
    ).first()
    assert tuple(got) == ("Unsigned integer (LSB)", "Signed 16-bit (LSB)", "odd", "7.78", "pending", "unavailable", "—", "80.91 %", "[-89.200000, 10.000000]", "demo", 2.5)


def test_nested_spec_hides_outer_values(spark):
    df = spark.createDataFrame([(5, "u1", (None, None)), (5, "u1", (7, "<i2")), (5, "u1", None)], "lines int, dtype string, raster_spec struct<lines:int,dtype:string>")
    assert [tuple(r) for r in R.normalised(df).collect()] == [(None, "u1"), (7, "<i2"), (5, "u1")]


def test_cube_files(spark):
    def npy(a):
        out = io.BytesIO()
        np.save(out, a)
        return out.getvalue()

    files = [("a", npy(np.zeros((3, 8, 9), np.float32))), ("b", npy(np.zeros((8, 9, 3), np.uint8))), ("c", npy(np.zeros((4, 5), ">i2"))), ("d", b"II*\0rest"), ("e", b"junk"), ("f", None), ("g", b"\x93NUMPY\x01\x00\xff\xff{")]
    got = {r.path: r for r in cubes.inspect(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert [(got[k].bands, got[k].lines, got[k].samples, got[k].band_axis) for k in "abc"] == [(3, 8, 9, 0), (3, 8, 9, 2), (1, 4, 5, None)]
    assert got["d"].container == "tiff" and not got["d"].valid and got["e"].error_message and got["f"].error_message and got["g"].error_message and got["a"].valid


def test_corner_refinement(spark):
    y, x = np.mgrid[0:40, 0:40]
    a = 200.0 / (1 + np.exp(-(x - 20.3) * 2)) / (1 + np.exp(-(y - 18.6) * 2))
    rows = [(1, int(i), int(j), float(a[i, j])) for i in range(40) for j in range(40)]
    image = spark.createDataFrame(rows, "product_id long, line int, sample int, value double")
    points = spark.createDataFrame([(1, 1, 19.5, 19.5), (1, 2, 1.0, 1.0), (1, 3, 5.0, 30.0)], "product_id long, id long, x double, y double")
    got = {r.id: r for r in P.refined(image, points).collect()}
    assert abs(got[1].tx - 20.3) < 0.6 and abs(got[1].ty - 18.6) < 0.6
    assert (got[2].tx, got[2].ty) == (1.0, 1.0)


def test_demo_pair_is_marked(spark):
    assert {r.metadata_source for r in cubes.demo_pair(spark).collect()} == {"DEMO"}
