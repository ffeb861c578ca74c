import numpy as np
import pytest
from pyspark.sql import functions as F

from framealign.functions import raster_spec as R
from framealign.functions import report as T
from framealign.functions import states as S
from framealign.operators import fitting as FIT
from framealign.operators import pixels as P
from framealign.plans import correspond as C
from framealign.plans import working as W
from framealign.sources import catalog, cubes, labels, rasters, store

PAIRS = "pair_id long, source_id string, reference_id string, s_sensor string, r_sensor string, s_width int, s_height int, r_width int, r_height int, s_scale double, r_scale double, gate_passed boolean"


def test_whole_run_over_a_table_of_pairs(spark):
    rng = np.random.default_rng(11)
    h = np.array([[1.02, 0.03, 12], [-0.02, 0.97, 20], [1e-5, -2e-5, 1]])
    pairs = [(1, "s", "r", "OHRC", "OHRC"), (2, "s", "r", "OHRC", "TMC"), (3, "s", "r", "OHRC", "TMC"), (4, "s", "r", "OHRC", "OHRC"), (5, "x", "y", "OHRC", "OHRC")]
    pairs = spark.createDataFrame([(*p, 600, 500, 640, 520, 2.0, 3.0, False if p[0] == 4 else None) for p in pairs], PAIRS)
    s = rng.uniform([5, 5], [590, 490], (160, 2))
    r = FIT.apply(h, s)
    d = rng.normal(size=(160, 16))
    keys = [(p, "half" if k % 4 == 3 else ("intensity", "structure", "gradient")[k % 4], k, *(xy[k] / (2 if k % 4 == 3 else 1)).tolist(), (d[k] + noise * rng.normal(size=16)).tolist()) for p, xy, noise in (("s", s, 0), ("r", r, 0.01)) for k in range(160)]
    keypoints = spark.createDataFrame(keys, "product_id string, representation string, kp_id long, x double, y double, descriptor array<float>")
    found = [(2, k, *s[k].tolist(), *(r[k] + (70 if k % 6 == 0 else 0)).tolist(), 0.3 if k > 150 else 0.9, True, k != 150) for k in range(160)] + [(3, k, 1.0 * k, 2.0, 3.0, 4.0, 0.9, True, True) for k in range(3)]
    learned = spark.createDataFrame(found, "pair_id long, row_ord long, sx double, sy double, rx double, ry double, confidence double, s_valid boolean, r_valid boolean")
    raw = C.raw_matches(pairs, keypoints, learned).cache()
    out = C.run(pairs, raw)
    report = {x.pair_id: x for x in out["report"].collect()}
    assert sorted(report) == [1, 2, 3, 4, 5]
    assert (report[1].status, report[1].route, report[1].raw_matches) == ("success", "same", 160) and report[1].inlier_ratio == 1.0 and report[1].fit_rmse < 1e-6 and report[1].holdout_rmse < 1e-6
    assert report[2].raw_matches == 150 and report[2].status == "success" and 20 < report[2].outlier_count + report[2].holdout_points and report[2].residual_field
    assert (report[1].verifier_requested, report[1].verifier, report[1].fallback_used) == ("MAGSAC++", "RANSAC", True)
    assert [report[k].failed_stage for k in (3, 4, 5)] == ["Feature Matching", "Geographic Gate", "Confidence Filtering"] and report[3].error_message.startswith("3 learned")
    table = out["correspondences"].filter("pair_id = 1").collect()
    assert len(table) == 160 and all(x.source_x_original_px == 2 * x.source_x_working_px and x.fit_error_original_px < 1e-5 and x.training_inlier != x.holdout_validation for x in table)
    assert {x.representation for x in table} == {"intensity", "structure", "gradient", "half"}
    steps = out["stages"].collect()
    assert [x.status for x in sorted((x for x in steps if x.pair_id == 3), key=lambda x: x.ord)] == ["success", "failed"] and sum(x.pair_id == 1 for x in steps) == 6
    empty = C.run(pairs, raw.limit(0))["report"].collect()
    assert all(x.status == "failed" for x in empty) and len(empty) == 5
    raw.unpersist()


def test_texts_and_gates(spark):
    one = spark.range(1).select(F.lit(1.5).alias("ul_lat"), F.lit(2.0).alias("ul_lon"), *[F.lit(None).cast("double").alias(f"{c}_{a}") for c in ("ur", "lr", "ll") for a in ("lat", "lon")])
    assert one.select(T.footprint_text()).first()[0] == "UL: [1.500000, 2.000000]; UR: —; LL: —; LR: —"
    get = lambda c: one.select(c).first()[0]
    null = F.lit(None).cast("double")
    assert get(T.elevation_text(F.lit(10.0), F.lit(12.5))) == "2.50°" and get(T.elevation_text(F.lit(1.0), null)) == "sun angles are pending"
    assert get(T.validity_text(F.lit(True), F.lit(True))).startswith("valid, ") and get(T.validity_text(F.lit(None).cast("boolean"), F.lit(True))) == "invalid"
    assert get(T.status_record(F.lit("DEMO"))).asDict() == {"status": "DEMO", "label": "Demo", "detail": "A fixture, not a product.", "display": "demo"}
    stage = get(T.stage_record(F.lit(3), F.lit("x"), F.lit("success"), F.lit("m"), F.struct(F.lit(1).alias("a")), F.struct(F.lit(2.0).alias("b")), F.lit(0.12345), F.lit(None).cast("string")))
    assert stage.stage_id == "03" and stage.parameters == '{"a":1}' and stage.result_metric == '{"b":2.0}' and stage.error_message is None
    reason = get(T.pair_reason(F.lit("INSUFFICIENT_OVERLAP"), F.lit("AVAILABLE"), F.lit("AVAILABLE"), F.lit(0.095), F.lit(0.1), null))
    assert "0.095%" in reason and "0.100%" in reason
    assert get(S.ready(F.lit(True), F.lit(None).cast("boolean"))) is False and get(S.ready()) is True


def test_contract_of_a_row(spark):
    rows = spark.createDataFrame([(4, 5, 8, "u1", 4, None, 1, None, 24), (None, 5, 8, None, None, None, None, None, None)], "lines int, samples int, sample_bits int, dtype string, image_offset int, record_bytes int, image_pointer int, image_pointer_unit string, length long")
    a, b = R.contract(rows).collect()
    assert (a.dimensions, a.expected_payload_bytes, a.size_status, a.pointer_unit, a.reader, a.resolved, a.missing) == ("4 x 5", 20, "VERIFIED", "RECORDS", "raw_raster", True, [])
    assert (b.size_status, b.resolved, b.missing, b.reader) == ("UNKNOWN", False, ["dimensions", "sample_type", "image_offset"], None)


CUBE = """<Product xmlns="urn:x"><name>Imaging Infrared Spectrometer (IIRS)</name><Array_3D_Spectrum><Axis_Array><axis_name>BAND</axis_name><elements>250</elements></Axis_Array>
<Axis_Array><axis_name>Line</axis_name><elements> 13 </elements></Axis_Array><Axis_Array><axis_name>Sample</axis_name><elements>7</elements></Axis_Array></Array_3D_Spectrum></Product>"""


def test_cube_labels_demo_pair_and_catalog_json(spark, tmp_path):
    files = spark.createDataFrame([("a", CUBE), ("b", "no xml"), ("c", "<p><lines>3</lines><samples>4</samples></p>")], "path string, text string")
    got = {r.path: r for r in cubes.parse_cube_labels(files).collect()}
    assert (got["a"].bands, got["a"].lines, got["a"].samples, got["a"].sensor_type) == (250, 13, 7, "IIRS") and got["b"].error_message and (got["c"].lines, got["c"].bands) == (3, None)
    demo = cubes.demo_pair(spark).collect()
    assert [r.product_id for r in demo][1] == "M1534362340LE" and round(demo[1].gsd_m_per_pixel / demo[0].gsd_m_per_pixel, 2) == 7.78
    texts = spark.createDataFrame([("x", '{"product_id": "P1", "gsd_m_per_pixel": 2.5}'), ("y", '[{"product_id": "P2"}, {"product_id": "P3"}]'), ("z", "broken")], "path string, text string")
    rows = sorted((r.path, r.product_id, r.gsd_m_per_pixel) for r in catalog.from_json(texts, "product_id string, gsd_m_per_pixel double").filter("product_id is not null").collect())
    assert rows == [("x", "P1", 2.5), ("y", "P2", None), ("y", "P3", None)] and catalog.from_json(texts, "product_id string").count() == 4
    assert catalog.manual_row(spark.createDataFrame([(71.5,)], "solar_incidence_deg double")).first().sun_elevation_deg == 18.5
    parts = {"metadata": spark.createDataFrame([(1, "a"), (2, "b")], "pair_id long, name string"), "metrics": spark.createDataFrame([(1, 0.5), (2, None)], "pair_id long, rmse double")}
    store.save_run(parts, str(tmp_path))
    store.save_run({"metrics": spark.createDataFrame([(2, 9.0)], "pair_id long, rmse double")}, str(tmp_path))
    assert [store.load_run(spark, str(tmp_path), "metrics", "rmse double, pair_id long", k).first().rmse for k in (1, 2)] == [0.5, 9.0]


def test_footprints_of_all_forms(spark):
    texts = ["[[1, 2], [3, 4], [5, 6], [7, 8], [9, 9]]", "[[1, 2], [3, 4]]", "1 2, 3 4; 5 6 / 7.5 -8", "1 2 3", None, "[1 2 3 4 5 6 7 8]"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).orderBy("k").select(labels.footprint_text(F.col("t"))).collect()]
    pairs = [None if g is None else [tuple(x) for x in g] for g in got]
    assert pairs == [[(1, 2), (3, 4), (5, 6), (7, 8)], None, [(1, 2), (3, 4), (5, 6), (7.5, -8)], None, None, [(1, 2), (3, 4), (5, 6), (7, 8)]]
    corners = "struct<upper_left:array<double>,upper_right:array<double>,lower_left:array<double>,lower_right:array<double>>"
    rows = spark.createDataFrame([(([1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]),), (([1.0, 2.0], None, [5.0, 6.0], [7.0, 8.0]),), (None,)], f"c {corners}")
    assert [None if r[0] is None else len(r[0]) for r in rows.select(labels.footprint_of(F.col("c"))).collect()] == [4, None, None]
    empty = labels.empty_metadata(spark).first()
    assert empty.sensor_type == "Unknown" and empty.valid is False and empty.product_id is None


def test_extent_gives_a_resolution():
    text = "<p><lines>100</lines><samples>50</samples><x_min>0</x_min><x_max>100</x_max><y_min>-300</y_min><y_max>0</y_max></p>"
    assert (lambda r: (r["gsd_m_per_pixel"], r["gsd_source"]))(labels.parse_xml(text)) == (2.5, "extent")


def test_working_images_of_rasters_and_cubes(spark):
    rng = np.random.default_rng(5)
    a = np.clip(rng.normal(100, 30, (12, 10)), 1, 255)
    rows = [(1, y, x, float(a[y, x]), (y, x) != (3, 4)) for y in range(12) for x in range(10)] + [(2, y, x, 7.0, True) for y in range(12) for x in range(10)]
    out = W.standard(spark.createDataFrame(rows, "product_id long, line int, sample int, value double, valid boolean").coalesce(1), 12, 10)
    got = out["pictures"].collect()
    assert {r.product_id for r in got} == {1} and len(got) == 4 * 120 and all(0 <= r.value <= 255 for r in got)
    assert {r.representation for r in got} == {"intensity", "local", "structure", "gradient"} and all(r.value == 0 for r in got if not r.valid)
    assert {r.product_id: r.status for r in out["status"].collect()} == {1: "OK", 2: "FAILED"}
    cube = [(p, b, y, x, float(a[y, x] * b + 40 * b) if p == 1 else -9999.0) for p in (1, 2) for b in (1, 2) for y in range(12) for x in range(10)]
    out = W.hyperspectral(spark.createDataFrame(cube, "product_id long, band int, line int, sample int, value double").coalesce(1), 2, 12, 10, mode="selected_band")
    got = out["pictures"].collect()
    assert {r.product_id for r in got} == {1} and len(got) == 4 * 120 and len({r.value for r in got if r.representation == "gradient"}) > 10
    assert W.working_size(5000, 100) == (2048, 41) and W.working_size(3, 2) == (3, 2) and W.to_original(24, 20, 12, 10) == [2.0, 0.0, 0.5, 0.0, 2.0, 0.5, 0.0, 0.0, 1.0]


def test_files_of_several_formats_are_one_table(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.ones((2, 3)))
    (tmp_path / "b.img").write_bytes(bytes(6))
    (tmp_path / "c.IMG").write_bytes(bytes(6))
    raw = {"lines": 2, "samples": 3, "dtype": "u1"}
    got = rasters.load(spark, [{"path": str(tmp_path / "a.npy")}, {"path": str(tmp_path / "b.img"), **raw}, {"path": str(tmp_path / "c.IMG"), **raw}])
    assert {(r.product_id, r["count"]) for r in got.groupBy("product_id").count().collect()} == {("A", 6), ("B", 6), ("C", 6)}
    for path in ("x.tif", "x.what"):
        with pytest.raises(ValueError):
            rasters.load(spark, [{"path": path}])
