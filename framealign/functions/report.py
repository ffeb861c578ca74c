"""Texts and small figures of a report: display names, scale texts, plausibility of sizes, refinement shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shown for a missing figure.
MISSING = "—"

# Display names of sample types and dtypes.
SAMPLE_NAMES = {
    "LSBUNSIGNEDINTEGER": "Unsigned integer (LSB)", "MSBUNSIGNEDINTEGER": "Unsigned integer (MSB)", "UNSIGNEDINTEGER": "Unsigned integer", "UNSIGNEDBYTE": "Unsigned byte",
    "LSBINTEGER": "Signed integer (LSB)", "MSBINTEGER": "Signed integer (MSB)", "INTEGER": "Signed integer", "IEEE754MSBSINGLE": "32-bit float (MSB)", "IEEE754LSBSINGLE": "32-bit float (LSB)",
}
DTYPE_NAMES = {"uint8": "Unsigned 8-bit", "u1": "Unsigned 8-bit", "<u2": "Unsigned 16-bit (LSB)", ">u2": "Unsigned 16-bit (MSB)", "<i2": "Signed 16-bit (LSB)", ">i2": "Signed 16-bit (MSB)", "<f4": "32-bit float (LSB)", ">f4": "32-bit float (MSB)"}


def _known(names: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def sample_name(sample_type: Column, dtype: Column) -> Column:
    """Display name of a sample type, else of a dtype, else what is there."""
    token = F.regexp_replace(F.upper(F.coalesce(sample_type, F.lit(""))), "[^A-Z0-9]", "")
    return F.coalesce(_known(SAMPLE_NAMES, token), _known(DTYPE_NAMES, F.coalesce(dtype, F.lit(""))), sample_type, dtype, F.lit("Unknown"))


def scale_text(source_gsd: Column, reference_gsd: Column, decimals: int = 2) -> Column:
    """The ratio of resolutions as a text; pending or unavailable if there is none."""
    ratio = F.format_string(f"%.{decimals}f", reference_gsd / source_gsd)
    return F.when(source_gsd.isNull() | reference_gsd.isNull(), "pending").when((source_gsd <= 0) | (reference_gsd <= 0), "unavailable").otherwise(ratio)


def figure(c: Column, decimals: int, unit: str = "") -> Column:
    """A number with fixed decimals and unit, a dash if it is missing."""
    return F.coalesce(F.when(c.isNotNull(), F.concat(F.format_string(f"%.{decimals}f", c.cast("double")), F.lit(unit))), F.lit(MISSING))


def percent(share: Column, decimals: int = 2) -> Column:
    return figure(share * 100.0, decimals, " %")


def corner_text(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("[%.6f, %.6f]", lat, lon))


def size_plausibility(source_pixels: Column, reference_pixels: Column) -> tuple[Column, Column]:
    """Ratio of the smaller to the larger pixel count, and whether it exceeds 0.15. It says nothing about geography and rejects nothing."""
    ratio = F.least(source_pixels, reference_pixels) / F.greatest(source_pixels, reference_pixels, F.lit(1))
    return ratio, ratio > 0.15


def refinement_shift(points: DataFrame, group: list[str]) -> DataFrame:
    """Mean distance by which refinement moved points (sx, sy) to (tx, ty)."""
    return points.groupBy(*group).agg(F.avg(F.hypot(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy"))).alias("mean_shift"))


def status_display(status: Column) -> Column:
    """Group of a state: ok, warning, error, or demo."""
    return (
        F.when(status.isin("PARSED_FROM_PRODUCT", "UPLOADED_LABEL", "CATALOG_METADATA", "MANUALLY_ENTERED", "AVAILABLE", "VALID"), "ok").when(status == "DEMO", "demo")
        .when(status.isin("INVALID", "REJECTED", "INSUFFICIENT_OVERLAP"), "error").otherwise("warning")
    )


#: Label and detail of each state of a metadata record, footprint or pair.
STATES = {
    "NOT_PROVIDED": ("Not provided", "There is no metadata yet."), "PARSED_FROM_PRODUCT": ("From the product", "Read from the product's own label."), "UPLOADED_LABEL": ("From a label", "Read from a separate label file."),
    "CATALOG_METADATA": ("From the catalog", "Taken from a catalog record."), "MANUALLY_ENTERED": ("Entered by hand", "Typed in."), "INCOMPLETE": ("Incomplete", "Required fields are missing."), "DEMO": ("Demo", "A fixture, not a product."),
    "INVALID": ("Invalid", "The metadata can't be read."), "AVAILABLE": ("Available", "All four corners are known."), "UNAVAILABLE": ("Unavailable", "Corners are missing."), "PENDING": ("Pending", "Metadata is needed first."),
    "VALID": ("Valid", "The footprints overlap."), "REJECTED": ("Rejected", "The footprints don't overlap."), "INSUFFICIENT_OVERLAP": ("Too little overlap", "The overlap is below the minimum."),
}


def status_record(status: Column) -> Column:
    """struct<status, label, detail, display> of a state; an unknown one is its own label."""
    label, detail = (F.create_map(*[F.lit(x) for k, v in STATES.items() for x in (k, v[n])]) for n in (0, 1))
    return F.struct(status.alias("status"), F.coalesce(F.try_element_at(label, status), status).alias("label"), F.coalesce(F.try_element_at(detail, status), F.lit("")).alias("detail"), status_display(status).alias("display"))


def pair_reason(status: Column, source: Column, reference: Column, percent_smaller: Column, least: Column, area: Column) -> Column:
    """Why a pair has its state, with the figures that decide it."""
    lacking = F.concat_ws(" and ", F.when(source != "AVAILABLE", "source footprint"), F.when(reference != "AVAILABLE", "reference footprint"))
    share = F.coalesce(percent_smaller, F.lit(0.0))
    return (
        F.when((status == "PENDING") & (lacking != ""), F.concat(F.lit("waiting for the "), lacking)).when(status == "REJECTED", "the footprints don't overlap; nothing was matched")
        .when(status == "INSUFFICIENT_OVERLAP", F.format_string("overlap is %.3f%% of the smaller footprint, at least %.3f%% is needed", share, F.coalesce(least, F.lit(0.1))))
        .when(status == "VALID", F.format_string("overlap is %.3f%% of the smaller footprint, %.6f square degrees", share, F.coalesce(area, F.lit(0.0)))).otherwise("the overlap isn't evaluated yet")
    )


def footprint_text(prefix: str = "") -> Column:
    """The four corners as one text, a dash for each that is missing."""
    one = lambda c: F.concat(F.lit(f"{c.upper()}: "), F.coalesce(corner_text(F.col(f"{prefix}{c}_lat"), F.col(f"{prefix}{c}_lon")), F.lit(MISSING)))
    return F.concat_ws("; ", *[one(c) for c in ("ul", "ur", "ll", "lr")])


def validity_text(valid: Column, warned: Column) -> Column:
    return F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.coalesce(warned, F.lit(False)), "valid, optional fields are missing").otherwise("valid")


def elevation_text(source: Column, reference: Column) -> Column:
    """Difference of sun elevations in degrees as a text; it says so if one is missing."""
    difference = elevation_difference(source, reference)
    return F.when(difference.isNull(), "sun angles are pending").otherwise(F.format_string("%.2f°", difference))


def stage_record(ord_: Column, name: Column, status: Column, method: Column, parameters: Column, metric: Column, seconds: Column, error: Column) -> Column:
    """A row of a stage trace; parameters and metric are structs or maps and become JSON."""
    number = F.lpad(ord_.cast("string"), 2, "0")
    return F.struct(number.alias("stage_id"), name.alias("name"), status.alias("status"), method.alias("processing_method"), F.to_json(parameters).alias("parameters"), F.to_json(metric).alias("result_metric"), F.bround(seconds, 4).alias("processing_time_seconds"), error.alias("error_message"))


def elevation_difference(source: Column, reference: Column) -> Column:
    """Difference of sun elevations, null if one is missing."""
    return F.abs(source - reference)
