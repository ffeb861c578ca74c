from pyspark.sql import functions as F

from framealign.functions import raster_spec as R
from framealign.functions import text as X
from framealign.sources import catalog as C
from framealign.sources import labels as L

KEYWORDS = """PDS_VERSION_ID = PDS3
RECORD_TYPE = FIXED_LENGTH
RECORD_BYTES = 5064
FILE_RECORDS = 52225
^IMAGE = 2
DATA_SET_ID = "LRO-L-LROC-2-EDR-V1.0"
PRODUCT_ID = "M1534362340LE"
INSTRUMENT_ID = "LROC"
START_TIME = 2016-01-02T03:04:05.1234Z
RESOLUTION = 0.93 <METERS/PIXEL>
INCIDENCE_ANGLE = 61.5 <DEG>
OBJECT = IMAGE
  LINES = 52224
  LINE_SAMPLES = 5064
  SAMPLE_BITS = 8
  SAMPLE_TYPE = UNSIGNED_INTEGER
CORNER1_LATITUDE = -89.1
CORNER1_LONGITUDE = 10
UPPER_RIGHT_LATITUDE = -89.2
UPPER_RIGHT_LONGITUDE = 20
MINIMUM_LATITUDE = -89.9
EASTERNMOST_LONGITUDE = 20
WESTERNMOST_LONGITUDE = 10
END
"""

XML = """<?xml version="1.0"?><Product_Observational xmlns="http://example.org/a" xmlns:x="http://example.org/b">
<Observation_Area><Time_Coordinates><start_date_time>2024-11-15T13:26:32.1339Z</start_date_time><stop_date_time>2024-11-15T15:25:00.4388Z</stop_date_time></Time_Coordinates>
<Primary_Result_Summary><processing_level>Calibrated</processing_level></Primary_Result_Summary><Investigation_Area><name>Chandrayaan-2</name></Investigation_Area>
<Observing_System><Observing_System_Component type="Spacecraft"><name>Chandrayaan-2</name></Observing_System_Component><Observing_System_Component><type>Instrument</type><name>orbiter high resolution camera</name></Observing_System_Component></Observing_System></Observation_Area>
<x:Geometry><x:spacecraft_altitude>93.67 km</x:spacecraft_altitude><x:%s><x:roll>14.567189</x:roll><x:projection>Polar stereographic</x:projection>
%s</x:Geometry><Axis_Array><axis_name>Line</axis_name><elements>101074</elements></Axis_Array><Axis_Array axis_name="Sample"><elements>12000</elements></Axis_Array></Product_Observational>"""
CORNERS = "".join(f"<x:{c}_{a}>{v}</x:{c}_{a}>" for c, lat, lon in (("upper_left", -89.19986, 222.25), ("upper_right", -89.2, 229.7), ("lower_left", -89.9, 110.2), ("lower_right", -89.94, 22.4)) for a, v in (("latitude", lat), ("longitude", lon)))


def frame(spark, *texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")


def test_keyword_label(spark):
    rows = L.parse_keyword_labels(frame(spark, KEYWORDS, KEYWORDS.replace("^IMAGE = 2", '^IMAGE = ("A.IMG", 700 <BYTES>)'), "", None)).orderBy("path").collect()
    m = rows[0]
    assert (m.product_id, m.lines, m.samples, m.sample_bits, m.dtype) == ("M1534362340LE", 52224, 5064, 8, "u1")
    assert (m.image_pointer, m.image_pointer_unit, m.image_offset, m.record_bytes) == (2, "RECORDS", 5064, 5064)
    assert m.gsd_m_per_pixel == 0.93 and m.sun_elevation_deg == 28.5 and str(m.started) == "2016-01-02 03:04:05.123400"
    assert (m.ul_lat, m.ul_lon, m.ur_lat, m.lr_lat, m.lr_lon, m.ll_lon) == (-89.1, 10.0, -89.2, -89.9, 20.0, 10.0)
    assert rows[1].image_offset == 700 and rows[1].image_pointer_unit == "BYTES"
    assert rows[2].product_id is None and rows[3].lines is None


def test_xml_label_and_fallbacks(spark):
    plain = "<p><comment>Map at 2.5 meter resolution</comment><Corner2>1 2</Corner2><Corner1><latitude>3</latitude><longitude>4</longitude></Corner1><Corner4>5 6</Corner4><Corner3>7 8</Corner3><image_height>10</image_height><width>20</width></p>"
    optics = "<p><altitude>100 km</altitude><focalLength>2000</focalLength><detector_pixel_width>10</detector_pixel_width><north_latitude>9</north_latitude><south_latitude>1</south_latitude><west_longitude>2</west_longitude><east_longitude>3</east_longitude></p>"
    rows = L.parse_xml_labels(frame(spark, XML % ("pixel_resolution>0.24 m/pixel</x:pixel_resolution", CORNERS), XML % ("pixelResolution>0.3</x:pixelResolution", ""), plain, optics, "no xml", None)).orderBy("path").collect()
    m = rows[0]
    assert (m.lines, m.samples, m.altitude_km, m.gsd_m_per_pixel, m.gsd_source) == (101074, 12000, 93.67, 0.24, "tag")
    assert (m.instrument, m.sensor_type, m.mission, m.processing_level, m.projection) == ("orbiter high resolution camera", "OHRC", "Chandrayaan-2", "Calibrated", "Polar stereographic")
    assert (m.ul_lat, m.lr_lon, m.roll_deg) == (-89.19986, 22.4, 14.567189)
    assert rows[1].gsd_m_per_pixel == 0.3 and rows[1].ul_lat is None
    assert (rows[2].gsd_m_per_pixel, rows[2].gsd_source, rows[2].lines, rows[2].samples) == (2.5, "comment", 10, 20)
    assert (rows[2].ul_lat, rows[2].ur_lon, rows[2].ll_lat, rows[2].lr_lat) == (3.0, 2.0, 7.0, 5.0)
    assert (rows[3].gsd_m_per_pixel, rows[3].gsd_source, rows[3].ul_lat, rows[3].lr_lon) == (0.5, "optics", 9.0, 3.0)
    assert rows[4].error_message and rows[5].error_message


def test_headers_kinds_and_footprint_text(spark):
    t = frame(spark, "ENVI\nsamples = 250\nlines   = 8\nbands = 3\nwavelength = {\n 800.5, 900,\n1000}", KEYWORDS, "<a/>")
    h = L.parse_headers(t).orderBy("path").first()
    assert (h.lines, h.samples, h.bands, h.wavelengths, h.wavelength_min, h.wavelength_max) == (8, 250, 3, [800.5, 900.0, 1000.0], 800.5, 1000.0)
    assert [r[0] for r in t.orderBy("path").select(L.label_kind(F.col("text"))).collect()] == ["keyword", "keyword", "xml"]
    f = spark.createDataFrame([("[[1, 2], [3.5, -4], [5, 6], [7, 8], [9, 9]]",), ("1 2 3",)], "t string").select(L.footprint_text(F.col("t"))).collect()
    assert [tuple(p) for p in f[0][0]] == [(1.0, 2.0), (3.5, -4.0), (5.0, 6.0), (7.0, 8.0)] and f[1][0] is None


def test_names(spark):
    names = ["a/M1438615574LE.IMG", "ch2_ohr_ncp.img", "x.tif", "scene.webp", "n.lbl", "b.raw", "", None, "ch2_iir_x.png"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k")
    got = df.select(X.product_type(F.col("n")), X.sensor_from_name(F.col("n")), X.product_label(F.col("n"))).collect()
    assert [g[0] for g in got] == ["LRO_PDS3_BINARY", "CHANDRAYAAN_PDS4_BINARY", "GEOTIFF", "STANDARD_IMAGE", "METADATA_LABEL", "SCIENTIFIC_BINARY", "UNKNOWN", "UNKNOWN", "STANDARD_IMAGE"]
    assert [g[1] for g in got][:2] == ["LROC_NAC", "OHRC"] and got[8][1] == "IIRS" and got[8][2] == "IIRS browse"
    one = spark.range(1).select(X.product_id(F.lit(' "m1.img" ')), X.tag(F.lit("Sun-AzimuthAngle")), X.number(F.lit("93.67 km")), X.number(F.lit("12 um")), X.whole(F.lit("7.9")), X.sensor_token(F.lit("tmc-2")), X.id_match(F.lit("d/m1le.IMG"), F.lit("M1LE.lbl")), X.id_match(F.lit(None).cast("string"), F.lit("M"))).first()
    assert tuple(one) == ("M1", "sun_azimuth_angle", 93.67, 12.0, 7, "TMC", "VERIFIED", "MISMATCH")


def test_size_rules(spark):
    want = 52224 * 5064
    rows = [(want + 5064, 5064, 5064), (want + 2000, 5064, 5064), (want - 6000, 5064, 5064), (want, None, None), (want + 1, None, None), (want - 1, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, size long, offset long, record long").orderBy("k")
    got = df.select(R.size_status(F.col("size"), F.lit(52224), F.lit(5064), F.lit(8), F.col("offset"), F.col("record"))).collect()
    assert [g[0] for g in got] == ["VERIFIED", "PARTIAL", "MISMATCH", "VERIFIED", "PARTIAL", "MISMATCH"]


def test_family_and_profile(spark):
    cols = "data_set_id string, instrument string, sensor_type string, product_type string, metadata_source string, format_profile string, product_id string, name string, record_bytes int, image_pointer int, sample_bits int, image_offset int, dtype string"
    rows = [(None,) * 6 + ("M15LE", "a.img") + (None,) * 5, (None, "OHRC") + (None,) * 4 + ("M15LE", "a.img") + (None,) * 5, ("LRO-L-LROC-2-EDR-V1.0",) + (None,) * 3 + ("UPLOADED_LABEL", None, "Q", "q.img", 100, None, None, 77, None)]
    got = R.profiled(spark.createDataFrame(rows, cols), R.is_nac_edr()).collect()
    assert (got[0].image_offset, got[0].dtype, got[0].format_profile) == (5064, "uint8", "LROC_NAC_EDR")
    assert got[1].image_offset is None and got[1].format_profile is None
    assert (got[2].image_offset, got[2].record_bytes, got[2].dtype) == (77, 100, "uint8")


def test_manual_values_win_unless_blank(spark):
    parsed = spark.createDataFrame([("a", "x", "y")], "product_id string, t string, u string")
    manual = spark.createDataFrame([("a", " ", "z")], "product_id string, t string, u string")
    assert tuple(C.merge_manual(parsed, manual, ["t", "u"]).first()) == ("a", "x", "z")
