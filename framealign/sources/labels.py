"""Product labels to typed rows: keyword labels, XML labels, cube headers; and the dispatch between them.

Input tables have (path, text). Keyword labels and headers are parsed by SQL functions; XML labels by one Arrow function, as names
are looked up in document order over a set of spellings, which XPath can't say.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.raster_spec import dtype, pointer_offset

HEAD = 65536
_NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
CORNERS = ("ul", "ur", "lr", "ll")


def read_labels(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, text, length, content_hash of label files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return raw.select("path", F.col("content").cast("string").alias("text"), "length", X.content_hash(F.col("content")).alias("content_hash"))


def label_kind(text: Column) -> Column:
    """keyword or xml, by the first 2000 characters."""
    head = F.lower(F.substring(text, 1, 2000))
    return F.when(head.contains("pds_version_id") | (head.contains("record_type") & ~head.contains("<?xml")) | (~head.contains("<") & head.contains("=")), "keyword").otherwise("xml")


def keyword(text: Column, key: str) -> Column:
    """Value of the first `KEY = VALUE` line, without quotes and units; null if there is none."""
    found = F.regexp_extract(text, rf"(?im)^\s*{re.escape(key)}\s*=\s*(.+?)\s*$", 1)
    bare = F.regexp_replace(F.regexp_replace(F.trim(found), "^[\"']+|[\"']+$", ""), "<.*?>", "")
    return X.blank_to_null(bare)


_LINE = r"(?im)^\s*([^\s=]+)\s*=(?=\s*(.+?)\s*$)"


def _lines(labels: DataFrame) -> DataFrame:
    """labels with the keys (upper case) and values of all `KEY = VALUE` lines, found in one pass; values as in `keyword`."""
    text = F.substring(F.col("text"), 1, HEAD)
    bare = lambda v: F.regexp_replace(F.regexp_replace(F.trim(v), "^[\"']+|[\"']+$", ""), "<.*?>", "")
    return labels.select(
        "path", text.alias("_text"), F.transform(F.regexp_extract_all(text, F.lit(_LINE), F.lit(1)), F.upper).alias("_keys"),
        F.transform(F.regexp_extract_all(text, F.lit(_LINE), F.lit(2)), bare).alias("_values"),
    )


def _value(key: str) -> Column:
    """Value of the first line of a key in `_lines`, null if there is none."""
    at = F.array_position("_keys", F.lit(key))
    return X.blank_to_null(F.when(at > 0, F.try_element_at(F.col("_values"), at.cast("int"))))


def _first(*columns: Column) -> Column:
    return F.coalesce(*columns)


def parse_keyword_labels(labels: DataFrame) -> DataFrame:
    """The metadata row of each keyword label."""
    labels, t, word = _lines(labels), F.col("_text"), _value
    num = lambda k: X.blank_to_null(F.regexp_extract(word(k), _NUMBER, 0)).cast("double")
    whole = lambda k: X.blank_to_null(F.regexp_extract(word(k), r"\d+", 0)).cast("int")
    positive = lambda c: F.when(c != 0, c)
    pointer = F.regexp_replace(F.regexp_extract(t, r"(?im)^\s*\^IMAGE\s*=\s*([^\r\n]+)", 1), r"\"[^\"]*\"", "")
    raw_unit = F.upper(X.blank_to_null(F.regexp_extract(pointer, r"<\s*([^>]+)>", 1)))
    unit = F.when(raw_unit.isNull(), "RECORDS").when(raw_unit.rlike("BYTE|IMAGE|OFFSET"), "BYTES").when(raw_unit.contains("RECORD"), "RECORDS").otherwise(raw_unit)
    at = X.blank_to_null(F.regexp_extract(pointer, r"\d+", 0)).cast("long")
    # fall-backs: named corner, numbered corner, box; the third corner is the lower right one
    boxes = {"ul": ("MAXIMUM_LATITUDE", "WESTERNMOST_LONGITUDE"), "ur": ("MAXIMUM_LATITUDE", "EASTERNMOST_LONGITUDE"), "lr": ("MINIMUM_LATITUDE", "EASTERNMOST_LONGITUDE"), "ll": ("MINIMUM_LATITUDE", "WESTERNMOST_LONGITUDE")}
    names = {"ul": ("UPPER_LEFT", "CORNER1"), "ur": ("UPPER_RIGHT", "CORNER2"), "lr": ("LOWER_RIGHT", "CORNER3"), "ll": ("LOWER_LEFT", "CORNER4")}
    corners = []
    for c in CORNERS:
        for k, axis in enumerate(("LATITUDE", "LONGITUDE")):
            corners.append(_first(num(f"{names[c][0]}_{axis}"), num(f"{names[c][1]}_{axis}"), num(boxes[c][k])).alias(f"{c}_{'lat' if k == 0 else 'lon'}"))
    order, record = _first(word("MSB"), word("BYTE_ORDER")), whole("RECORD_BYTES")
    incidence = num("INCIDENCE_ANGLE")
    return labels.select(
        "path", word("PRODUCT_ID").alias("product_id"), word("DATA_SET_ID").alias("data_set_id"), _first(word("INSTRUMENT_HOST_NAME"), word("MISSION_NAME")).alias("mission"),
        _first(word("INSTRUMENT_ID"), word("INSTRUMENT_NAME")).alias("instrument"), word("PRODUCT_TYPE").alias("product_type"), _first(word("TARGET_NAME"), word("TARGET")).alias("target"),
        word("START_TIME").alias("start_time"), word("STOP_TIME").alias("stop_time"), F.to_timestamp(word("START_TIME")).alias("started"),
        whole("LINES").alias("lines"), whole("LINE_SAMPLES").alias("samples"), whole("SAMPLE_BITS").alias("sample_bits"), word("SAMPLE_TYPE").alias("sample_type"),
        record.alias("record_bytes"), whole("FILE_RECORDS").alias("file_records"), whole("LABEL_RECORDS").alias("label_records"), at.alias("image_pointer"), F.when(at.isNotNull(), unit).alias("image_pointer_unit"),
        pointer_offset(at, F.when(at.isNotNull(), unit), record).alias("image_offset"), order.alias("byte_order"), dtype(word("SAMPLE_TYPE"), whole("SAMPLE_BITS"), order).alias("dtype"),
        _first(positive(whole("LINE_PREFIX_BYTES")), whole("LINE_PREFIX")).alias("line_prefix_bytes"), _first(positive(whole("LINE_SUFFIX_BYTES")), whole("LINE_SUFFIX")).alias("line_suffix_bytes"),
        _first(positive(num("SCALED_PIXEL_WIDTH")), positive(num("RESOLUTION"))).alias("gsd_m_per_pixel"), incidence.alias("solar_incidence_deg"), (90.0 - incidence).alias("sun_elevation_deg"),
        num("EMISSION_ANGLE").alias("emission_deg"), num("PHASE_ANGLE").alias("phase_deg"), _first(num("SUB_SOLAR_AZIMUTH"), num("SOLAR_AZIMUTH")).alias("sun_azimuth_deg"),
        _first(num("SPACECRAFT_ALTITUDE"), num("ALTITUDE")).alias("altitude_km"), word("MAP_PROJECTION_TYPE").alias("projection"), *corners,
    )


def parse_headers(headers: DataFrame) -> DataFrame:
    """lines, samples, bands, wavelengths and their range of cube headers."""
    t = F.col("text")
    waves = F.transform(F.split(X.blank_to_null(F.regexp_extract(t, r"(?is)wavelength\s*=\s*\{([^}]*)\}", 1)), ","), lambda w: F.trim(w).cast("double"))
    one = lambda key: X.blank_to_null(F.regexp_extract(t, rf"(?im)^\s*{key}\s*=\s*(\d+)", 1)).cast("int")
    return headers.select("path", one("lines").alias("lines"), one("samples").alias("samples"), one("bands").alias("bands"), waves.alias("wavelengths"), F.array_min(waves).alias("wavelength_min"), F.array_max(waves).alias("wavelength_max"))


# ---- XML labels ----

_TEXT = ("product_id", "title", "start_time", "stop_time", "processing_level", "mission", "instrument", "target", "projection", "area", "data_type", "gsd_source", "error_message")
_FLOAT = ("altitude_km", "gsd_m_per_pixel", "roll_deg", "pitch_deg", "yaw_deg", "sun_azimuth_deg", "sun_elevation_deg", "solar_incidence_deg", "focal_length_mm", "detector_pixel_width_um", *(f"{c}_{a}" for c in CORNERS for a in ("lat", "lon")))
_INT = ("orbit_number", "lines", "samples")
XML_SCHEMA = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXT), *(T.StructField(n, T.DoubleType()) for n in _FLOAT), *(T.StructField(n, T.IntegerType()) for n in _INT)])

#: Spellings of each field, as snake case; the first element in document order with one of them counts.
SPELLINGS = {
    "product_id": ("logical_identifier", "product_id"), "title": ("title",), "start_time": ("start_date_time", "start_time", "observation_start_time"), "stop_time": ("stop_date_time", "stop_time", "observation_stop_time"),
    "processing_level": ("processing_level",), "projection": ("projection", "map_projection_name", "map_projection"), "area": ("area",), "data_type": ("data_type",),
    "altitude_km": ("spacecraft_altitude", "altitude", "satellite_altitude"), "roll_deg": ("roll", "roll_angle"), "pitch_deg": ("pitch", "pitch_angle"), "yaw_deg": ("yaw", "yaw_angle"),
    "sun_azimuth_deg": ("sun_azimuth", "solar_azimuth"), "sun_elevation_deg": ("sun_elevation", "solar_elevation"), "solar_incidence_deg": ("solar_incidence", "incidence_angle"),
    "focal_length_mm": ("focal_length",), "detector_pixel_width_um": ("detector_pixel_width",), "orbit_number": ("imaging_orbit_number", "orbit_number"),
    "gsd": ("pixel_resolution", "gsd", "spatial_resolution", "ground_sampling_distance", "resolution"),
}


@lru_cache(maxsize=10_000)
def _snake(name: str) -> str:
    bare = name.rsplit("}", 1)[-1]
    return re.sub(r"[^A-Za-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", bare)).strip("_").lower()


def _float(text: str | None) -> float | None:
    m = re.fullmatch(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*(?:km|m/pixel|m|mm|um|deg|°)?\s*", text or "")
    return float(m[1]) if m else None


def parse_xml(text: str | None) -> dict:
    """The metadata of one XML label; `error_message` tells why there is none."""
    out: dict = dict.fromkeys(XML_SCHEMA.fieldNames())
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError as e:
        return out | {"error_message": f"not XML: {e}"}
    nodes = [(_snake(e.tag), e) for e in root.iter() if isinstance(e.tag, str)]
    value = lambda e: (e.text or "").strip() or None
    firsts: dict[str, tuple[int, str]] = {}  # place and value of the first element of each name that has one
    for at, (n, e) in enumerate(nodes):
        if n not in firsts and (v := value(e)):
            firsts[n] = (at, v)

    def first(*names: str) -> str | None:
        return min((firsts[n] for n in names if n in firsts), default=(0, None))[1]

    for field, names in SPELLINGS.items():
        found = first(*names)
        if field in _TEXT:
            out[field] = found
        elif field in _FLOAT:
            out[field] = _float(found)
        elif field in _INT and (x := _float(found)) is not None:
            out[field] = int(x)

    def child(e: ET.Element, name: str) -> str | None:
        return next((value(c) for c in e.iter() if isinstance(c.tag, str) and _snake(c.tag) == name and c is not e), None)

    for n, e in nodes:
        if n == "observing_system_component" and (e.attrib.get("type") or child(e, "type") or "").lower() == "instrument":
            out["instrument"] = out["instrument"] or child(e, "name")
        elif n == "investigation_area":
            out["mission"] = out["mission"] or child(e, "name")
        elif n == "target_identification":
            out["target"] = out["target"] or child(e, "name")
    out["instrument"] = out["instrument"] or first("instrument", "instrument_name", "sensor")
    out["mission"] = out["mission"] or first("mission", "mission_name")
    out["target"] = out["target"] or first("target", "target_name")
    for n, e in nodes:  # dimensions by axis name, else by plain tags
        if n in ("axis_array", "axis"):
            axis = (e.attrib.get("axis_name") or child(e, "axis_name") or "").lower()
            size = _float(e.attrib.get("elements") or child(e, "elements"))
            field = {"line": "lines", "lines": "lines", "sample": "samples", "samples": "samples"}.get(axis)
            if field and size and out[field] is None:
                out[field] = int(size)
    for field, names in (("lines", ("lines", "image_height", "height", "number_of_lines")), ("samples", ("samples", "image_width", "width", "number_of_samples"))):
        if out[field] is None and (x := _float(first(*names))):
            out[field] = int(x)
    _corners(out, nodes, first)
    _resolution(out, first)
    return out


def _corners(out: dict, nodes: list, first) -> None:  # noqa: ANN001
    long = {"ul": "upper_left", "ur": "upper_right", "lr": "lower_right", "ll": "lower_left"}
    named = {(c, a): _float(first(f"{long[c]}_{w}")) for c in CORNERS for a, w in (("lat", "latitude"), ("lon", "longitude"))}
    if all(v is not None for v in named.values()):
        out.update({f"{c}_{a}": v for (c, a), v in named.items()})
        return
    numbered = sorted(((int(m[1]), e) for n, e in nodes if (m := re.fullmatch(r"corner_?(\d+)", n))), key=lambda x: x[0])
    if len(numbered) >= 4:  # third and fourth are lower left and lower right here
        for c, (_, e) in zip(("ul", "ur", "ll", "lr"), numbered[:4], strict=True):
            pair = {_snake(x.tag): _float((x.text or "").strip()) for x in e if isinstance(x.tag, str)}
            text = [float(v) for v in re.findall(_NUMBER, e.text or "")]
            out[f"{c}_lat"] = pair.get("latitude", pair.get("lat", text[0] if len(text) > 1 else None))
            out[f"{c}_lon"] = pair.get("longitude", pair.get("lon", text[1] if len(text) > 1 else None))
        return
    sides = [_float(first(*names)) for names in (("west_bounding_coordinate", "west_longitude"), ("east_bounding_coordinate", "east_longitude"), ("south_bounding_coordinate", "south_latitude"), ("north_bounding_coordinate", "north_latitude"))]
    if all(v is not None for v in sides):
        west, east, south, north = sides
        for c, lat, lon in (("ul", north, west), ("ur", north, east), ("lr", south, east), ("ll", south, west)):
            out[f"{c}_lat"], out[f"{c}_lon"] = lat, lon


def _resolution(out: dict, first) -> None:  # noqa: ANN001
    """Explicit tag, pixel sizes, a phrase in a comment, optics, then a projected extent over the dimensions."""
    x, y = _float(first("pixel_resolution_x", "pixel_size_x", "x_pixel_size")), _float(first("pixel_resolution_y", "pixel_size_y", "y_pixel_size"))
    sizes = [v for v in (x, y) if v]
    phrase = re.search(r"(\d+(?:\.\d+)?)\s*(?:m|meter|metre)s?\b[^.]{0,20}resolution", " ".join(filter(None, (first("comment"), first("description"))))) if first("comment", "description") else None
    optics = None
    if out["altitude_km"] and out["focal_length_mm"] and out["detector_pixel_width_um"]:
        optics = out["altitude_km"] * out["detector_pixel_width_um"] / out["focal_length_mm"]
        optics = round(optics, 2) if 0.01 <= optics <= 1000 else None
    ends = [_float(first(*names)) for names in (("x_min", "minimum_x", "westing_min"), ("x_max", "maximum_x", "westing_max"), ("y_min", "minimum_y", "southing_min"), ("y_max", "maximum_y", "southing_max"))]
    extent = None
    if out["lines"] and out["samples"] and all(v is not None for v in ends):
        per = abs(ends[1] - ends[0]) / out["samples"], abs(ends[3] - ends[2]) / out["lines"]
        extent = sum(per) / 2 if min(per) > 0 else None
    for source, v in (("tag", _float(first(*SPELLINGS["gsd"]))), ("pixel_size", sum(sizes) / len(sizes) if sizes else None), ("comment", float(phrase[1]) if phrase else None), ("optics", optics), ("extent", extent)):
        if v:
            out["gsd_m_per_pixel"], out["gsd_source"] = v, source
            return


def parse_xml_labels(labels: DataFrame, spread: int | None = None) -> DataFrame:
    """The metadata row of each XML label; spread: tasks over which to deal out labels that come in few partitions."""
    if spread:
        labels = labels.repartition(spread)

    @F.pandas_udf(XML_SCHEMA)
    def parsed(text: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([parse_xml(t) for t in text], columns=XML_SCHEMA.fieldNames())
        for c in _FLOAT:
            rows[c] = rows[c].astype("float64")
        for c in _INT:
            rows[c] = rows[c].astype("Int32")
        return rows

    return labels.select("path", parsed("text").alias("m")).select("path", "m.*").withColumn("sensor_type", X.sensor_from_instrument(F.col("instrument")))


def footprint_text(c: Column) -> Column:
    """Four pairs of numbers of a text: a JSON list of pairs (fewer than four give null), else the first eight numbers; null if it has fewer."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    listed = F.from_json(c, "array<array<double>>")
    good = F.filter(F.slice(listed, 1, 4), lambda x: F.size(x) >= 2)
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"([-+]?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    free = F.when(F.size(numbers) >= 8, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: pair(numbers[2 * i], numbers[2 * i + 1])))
    as_json = F.trim(c).rlike(r"(?s)^\[\s*\[.*\]$") & listed.isNotNull()
    return F.when(as_json, F.when(F.size(good) == 4, F.transform(good, lambda x: pair(x[0], x[1])))).otherwise(free)


def footprint_of(corners: Column) -> Column:
    """The same four pairs of a struct with upper_left, upper_right, lower_left, lower_right (each an array of two); null if one is missing."""
    names = ("upper_left", "upper_right", "lower_left", "lower_right")
    ok = F.lit(True)
    for n in names:
        ok = ok & F.coalesce(F.size(corners[n]) >= 2, F.lit(False))
    return F.when(ok, F.array(*[F.struct(corners[n][0].cast("double").alias("a"), corners[n][1].cast("double").alias("b")) for n in names]))


def empty_metadata(spark: SparkSession) -> DataFrame:
    """One row without metadata: all fields null, sensor Unknown, not valid."""
    nothing = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in XML_SCHEMA.fields])
    return nothing.withColumns({"sensor_type": F.lit("Unknown"), "valid": F.lit(False), "validation_errors": F.array(F.lit("no metadata"))})
