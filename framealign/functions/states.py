"""State machines of metadata, footprints and pairs, as ordered conditions; and what a product still lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCES = ("PARSED_FROM_PRODUCT", "UPLOADED_LABEL", "CATALOG_METADATA", "MANUALLY_ENTERED")
#: Least overlap of the smaller footprint, in percent.
LEAST_OVERLAP = 0.1


def _given(name: str) -> Column:
    return F.col(name).isNotNull()


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) != ""


def has_footprint(prefix: str = "") -> Column:
    """All four corners with both coordinates."""
    out = F.lit(True)
    for corner in ("ul", "ur", "lr", "ll"):
        out = out & _given(f"{prefix}{corner}_lat") & _given(f"{prefix}{corner}_lon")
    return out


def missing_fields() -> Column:
    """Required fields that a metadata row lacks, in their fixed order; empty: valid."""
    sensor = (_text("sensor_type") & (F.col("sensor_type") != "Unknown")) | _text("instrument")
    tests = (
        ("sensor", sensor), ("processing_level", _text("processing_level")), ("start_time", _text("start_time")), ("stop_time", _text("stop_time")),
        ("altitude", _given("altitude_km")), ("sun", _given("sun_azimuth_deg") & _given("sun_elevation_deg") & _given("solar_incidence_deg")),
        ("camera", _given("roll_deg") & _given("pitch_deg") & _given("yaw_deg")), ("footprint", has_footprint()), ("projection", _text("projection")),
        ("dimensions", _given("lines") & _given("samples")),
    )
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in tests]))


def warnings() -> Column:
    return F.array_compact(F.array(F.when(F.col("gsd_m_per_pixel").isNull(), "gsd")))


def metadata_status(valid: Column, source: Column) -> Column:
    sized = (F.coalesce(F.col("lines"), F.lit(0)) > 0) & (F.coalesce(F.col("samples"), F.lit(0)) > 0)
    unlocated = (F.upper(F.coalesce(F.col("sensor_type"), F.lit(""))) == "LROC_NAC") & (F.col("gsd_m_per_pixel").isNull() | ~has_footprint())
    return (
        F.when(source.isNull() | (source == "NOT_PROVIDED"), "NOT_PROVIDED").when(source == "DEMO", "DEMO").when(~F.coalesce(valid, F.lit(False)), "INCOMPLETE")
        .when(~sized | unlocated, "INCOMPLETE").when(source.isin(*SOURCES), source).otherwise("INCOMPLETE")
    )


def footprint_status(status: Column, prefix: str = "") -> Column:
    return F.when(status.isin("NOT_PROVIDED", "INVALID"), "PENDING").when(has_footprint(prefix), "AVAILABLE").otherwise("UNAVAILABLE")


def pair_status(source: Column, reference: Column, evaluated: Column, overlaps: Column) -> Column:
    """VALID, PENDING, REJECTED or INSUFFICIENT_OVERLAP; pending as long as a footprint is missing."""
    return (
        F.when((source != "AVAILABLE") | (reference != "AVAILABLE"), "PENDING").when((evaluated == "rejected") | ~F.coalesce(overlaps, F.lit(True)), "REJECTED")
        .when(evaluated == "insufficient_overlap", "INSUFFICIENT_OVERLAP").when((evaluated == "validated") | F.coalesce(overlaps, F.lit(False)), "VALID").otherwise("PENDING")
    )


def ready(*conditions: Column) -> Column:
    """A gate that is open if all conditions hold; null counts as no."""
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def scientific_ready(side: str = "{}_{}") -> Column:
    """The gate of a run over a row with source_ and reference_ columns: file, status, decoding, projection; and id_status, pair_status."""
    one = lambda who: (
        F.col(side.format(who, "file")).isNotNull() & ~F.col(side.format(who, "status")).isin("INCOMPLETE", "NOT_PROVIDED")
        & (F.col(side.format(who, "decoding")) == "READY") & (F.col(side.format(who, "projection")) == "VALID")
    )
    return ready(one("source"), one("reference"), F.coalesce(F.col("id_status"), F.lit("")) != "MISMATCH", F.col("pair_status") == "VALID")


def image_only_ready() -> Column:
    """The gate without metadata: both files, and lines for a reference that is a raw binary."""
    binary = F.col("reference_type").isin("LRO_PDS3_BINARY", "CHANDRAYAAN_PDS4_BINARY", "SCIENTIFIC_BINARY")
    return ready(F.col("source_file").isNotNull(), F.col("reference_file").isNotNull(), ~F.coalesce(binary, F.lit(False)) | (F.coalesce(F.col("reference_lines"), F.lit(0)) > 0))
