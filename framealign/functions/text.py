"""Column functions over names, ids, units and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Product families by file name, and sensor tokens.
LABEL_EXT = (".xml", ".lbl", ".txt")
GEOTIFF_EXT = (".tif", ".tiff")
IMAGE_EXT = (".png", ".jpg", ".jpeg", ".webp", ".bmp")
BINARY_EXT = (".img", ".raw", ".dat", ".bin")
SENSOR_TOKENS = {
    "TMC-2": "TMC", "TMC2": "TMC", "LROC NAC": "LROC_NAC", "LROC_NAC": "LROC_NAC", "NAC": "LROC_NAC", "LRO": "LROC_NAC",
    "LRO / LROC NAC": "LROC_NAC", "LUNAR RECONNAISSANCE ORBITER": "LROC_NAC", "AUTO DETECT": "Unknown",
}


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, r"\\", "/"), "/"), -1)


def product_id(name: Column) -> Column:
    """Id of a product: base name without quotes and product extension, upper case."""
    bare = F.regexp_replace(F.trim(F.coalesce(base_name(name), F.lit(""))), "^[\"']+|[\"']+$", "")
    return blank_to_null(F.upper(F.regexp_replace(bare, r"(?i)\.(img|lbl|xml)$", "")))


def id_match(image: Column, label: Column) -> Column:
    """VERIFIED if both ids are there and equal, else MISMATCH."""
    return F.when(F.coalesce(product_id(image) == product_id(label), F.lit(False)), "VERIFIED").otherwise("MISMATCH")


def _ends(c: Column, endings: tuple[str, ...]) -> Column:
    out = c.endswith(endings[0])
    for e in endings[1:]:
        out = out | c.endswith(e)
    return out


def _holds(c: Column, *parts: str) -> Column:
    out = c.contains(parts[0])
    for p in parts[1:]:
        out = out | c.contains(p)
    return out


def product_type(name: Column) -> Column:
    """Family of a product by extension, then by name; the order of the tests matters."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    base = F.element_at(F.split(low, "/"), -1)
    binary = (
        F.when(base.rlike(r"^m\d+[lr]e") | _holds(base, "lroc", "nac", "lro"), "LRO_PDS3_BINARY")
        .when(_holds(base, "ch2_", "ohrc", "tmc", "iir"), "CHANDRAYAAN_PDS4_BINARY")
        .otherwise("SCIENTIFIC_BINARY")
    )
    return (
        F.when(_ends(low, LABEL_EXT), "METADATA_LABEL").when(_ends(low, GEOTIFF_EXT), "GEOTIFF")
        .when(_ends(low, IMAGE_EXT), "STANDARD_IMAGE").when(_ends(low, BINARY_EXT), binary).otherwise("UNKNOWN")
    )


def product_label(name: Column) -> Column:
    """Instrument family shown for a product: a short code, null where the type tells it all."""
    low = F.lower(F.coalesce(name, F.lit("")))
    browse = F.when(_holds(low, "ch2_ohr", "ohrc"), "OHRC browse").when(_holds(low, "ch2_tmc", "tmc"), "TMC-2 browse").when(_holds(low, "ch2_iir", "iirs"), "IIRS browse").otherwise("image")
    kind = product_type(name)
    return F.when(kind == "STANDARD_IMAGE", browse).when(kind == "LRO_PDS3_BINARY", "LROC NAC binary").when(kind == "CHANDRAYAAN_PDS4_BINARY", "Chandrayaan-2 binary").otherwise(F.lower(kind))


def sensor_token(c: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    known = F.create_map(*[F.lit(x) for kv in SENSOR_TOKENS.items() for x in kv])
    return F.coalesce(F.element_at(known, up), blank_to_null(up), F.lit("Unknown"))


def sensor_from_name(name: Column) -> Column:
    """Sensor by file name; any name that holds `m1` counts as LROC NAC, like the short NAC ids."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(_holds(low, "iirs", "ch2_iir", "_iir"), "IIRS").when(_holds(low, "ohrc", "ch2_ohr"), "OHRC").when(_holds(low, "tmc", "ch2_tmc"), "TMC")
        .when(_holds(low, "m1", "nac", "lro", "lroc"), "LROC_NAC").otherwise("Unknown")
    )


def sensor_from_instrument(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(_holds(low, "ohrc", "orbiter high resolution"), "OHRC").when(_holds(low, "tmc", "terrain mapping"), "TMC").when(_holds(low, "iirs", "imaging infrared"), "IIRS")
        .otherwise(F.coalesce(blank_to_null(F.upper(c)), F.lit("Unknown")))
    )


def sensor_route(source: Column, reference: Column) -> Column:
    return F.when(source == reference, "same").otherwise("different")


def number(c: Column) -> Column:
    """Double of a text with a unit; null if it isn't one."""
    bare = F.trim(F.regexp_replace(F.trim(c), "(km|m/pixel|mm|um|deg|°|m)", ""))
    return F.when(bare.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), bare.cast("double"))


def whole(c: Column) -> Column:
    """Int of a text by truncation of its double."""
    bare = F.trim(c)
    return F.when(bare.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), bare.cast("double").cast("long").cast("int"))


def tag(c: Column) -> Column:
    """Element names as snake case: camelCase split, separators as one underscore."""
    split = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(split, "^_+|_+$", ""))


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)
