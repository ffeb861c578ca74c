"""What a cube file is before it is read: container by magic bytes, array header, axes; its XML label; and the demo pair."""

from __future__ import annotations

import ast
import struct
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labels as L

HEAD = 1024


def container(content: Column) -> Column:
    """npy, tiff, header or unknown, by the first bytes."""
    head = F.upper(F.hex(F.substring(content, 1, 6)))
    return F.when(head == "934E554D5059", "npy").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").when(head.startswith("454E5649"), "header").otherwise("unknown")


def npy_header(head: bytes | None) -> tuple[str | None, list[int] | None, str | None]:
    """dtype, shape and error of a .npy file's first bytes."""
    try:
        if not head or head[:6] != b"\x93NUMPY":
            return None, None, "not a .npy file"
        wide = head[6] >= 2
        size = struct.unpack("<I" if wide else "<H", head[8 : 12 if wide else 10])[0]
        start = 12 if wide else 10
        about = ast.literal_eval(head[start : start + size].decode("latin-1"))
        return str(about["descr"]), [int(n) for n in about["shape"]], None
    except (struct.error, ValueError, SyntaxError, KeyError, TypeError) as e:
        return None, None, f"unreadable header: {e}"


def inspect(files: DataFrame) -> DataFrame:
    """path, container, dtype, lines, samples, bands, band_axis, valid, error_message of cube files (path, content).

    The band axis of three is the first one if it is the smallest, else the last if that is smallest. TIFF is recognised, not decoded.
    """

    @F.pandas_udf("dtype string, shape array<long>, error string")
    def header(head: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([npy_header(h) for h in head], columns=["dtype", "shape", "error"])

    kind = files.select("path", container(F.col("content")).alias("container"), header(F.substring(F.col("content"), 1, HEAD)).alias("h"))
    shape = F.col("h.shape")
    three = F.size(shape) == 3
    first = three & (shape[0] <= F.least(shape[1], shape[2]))
    axis = F.when(first, 0).when(three, 2)
    at = lambda front, back, flat: F.when(first, shape[front]).when(three, shape[back]).when(F.size(shape) == 2, flat)
    out = kind.select("path", "container", F.col("h.dtype").alias("dtype"), at(1, 0, shape[0]).alias("lines"), at(2, 1, shape[1]).alias("samples"), at(0, 2, F.lit(1).cast("long")).alias("bands"), axis.alias("band_axis"), F.when(F.col("container") == "tiff", "GeoTIFF decoding is not supported").when(F.col("container") != "header", F.col("h.error")).alias("error_message"))
    return out.withColumn("valid", F.coalesce((F.col("lines") > 0) & (F.col("samples") > 0), F.lit(False)))


def parse_cube_labels(files: DataFrame) -> DataFrame:
    """XML labels of cubes: the general fields, bands, lines and samples of the axes of 3-D or 2-D arrays, and the sensor by the instrument's name."""

    @F.pandas_udf("bands int, lines int, samples int, instrument string")
    def axes(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([array_axes(t) for t in text], columns=["bands", "lines", "samples", "instrument"]).astype({"bands": "Int32", "lines": "Int32", "samples": "Int32"})

    found = files.select("path", axes("text").alias("a")).select("path", F.col("a.bands").alias("bands"), F.col("a.lines").alias("al"), F.col("a.samples").alias("asm"), F.col("a.instrument").alias("ai"))
    general = L.parse_xml_labels(files).join(found, "path").withColumns({"lines": F.coalesce("al", "lines"), "samples": F.coalesce("asm", "samples"), "instrument": F.coalesce("ai", "instrument"), "sensor_type": F.when(F.col("ai").isNotNull(), "IIRS").otherwise(F.col("sensor_type"))})
    return general.select("path", "product_id", "instrument", "sensor_type", "bands", "lines", "samples", "gsd_m_per_pixel", "error_message")


def array_axes(text: str | None) -> tuple[int | None, int | None, int | None, str | None]:
    """bands, lines, samples of the arrays of a label, and the first name of an imaging infrared spectrometer in it."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return None, None, None, None
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    found: dict[str, int] = {}
    name = None
    for e in root.iter():
        said = (e.text or "").strip()
        if name is None and local(e).lower() in ("name", "instrument") and any(x in said.lower() for x in ("iirs", "imaging infrared spectrometer")):
            name = said
        if not local(e).startswith(("Array_3D", "Array_2D")):
            continue
        for axis in (a for a in e.iter() if local(a) == "Axis_Array"):
            held = {local(c): (c.text or "").strip() for c in axis.iter()}
            called, count = held.get("axis_name", "").lower(), held.get("elements", "")
            kind = next((k for k, words in (("bands", ("band", "spectr")), ("lines", ("line",)), ("samples", ("sample",))) if any(w in called for w in words)), None)
            if kind and count.isdigit():
                found[kind] = int(count)
    return found.get("bands"), found.get("lines"), found.get("samples"), name


# The two products of the demo pair.
DEMO = (
    ("ch2_ohr_ncp_20190906T2241285714_d_img_gds", "Chandrayaan-2", "OHRC", "OHRC", "2019-09-06T22:41:28.5714Z", 0.24, 80000, 12000, -70.85, 22.75, -70.86, 23.45, -71.46, 23.40, -71.45, 22.70, 65.4, 14.8, 75.2, 100.2, "DEMO"),
    ("M1534362340LE", "Lunar Reconnaissance Orbiter", "LROC NAC", "LROC_NAC", "2021-03-12T14:15:30.000Z", 1.8669, 52224, 5064, -70.60, 22.40, -70.62, 23.80, -71.72, 23.75, -71.70, 22.35, 72.1, 18.5, 71.5, 50.4, "DEMO"),
)


def demo_pair(spark: SparkSession) -> DataFrame:
    """The demo pair's source and reference as metadata rows, marked as such."""
    corners = ", ".join(f"{c}_{a} double" for c in L.CORNERS for a in ("lat", "lon"))
    return spark.createDataFrame(DEMO, f"product_id string, mission string, instrument string, sensor_type string, start_time string, gsd_m_per_pixel double, lines int, samples int, {corners}, sun_azimuth_deg double, sun_elevation_deg double, solar_incidence_deg double, altitude_km double, metadata_source string")
