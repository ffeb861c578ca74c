"""The byte contract of a raw raster: family, profile, completeness, consistency with the file, sanity checks, readiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the one known record-structured family.
PROFILE = {"profile_id": "LROC_NAC_EDR", "record_bytes": 5064, "label_records": 1, "image_pointer": 2, "sample_bits": 8, "sample_type": "LSB_UNSIGNED_INTEGER", "dtype": "uint8"}


def _up(name: str) -> Column:
    return F.upper(F.coalesce(F.col(name).cast("string"), F.lit("")))


def is_nac_edr() -> Column:
    """Whether a row (data_set_id, instrument, sensor_type, product_type, metadata_source, format_profile, product_id, name) is of
    the record-structured NAC family; other sensors are ruled out first."""
    instrument, dataset, sensor, name = _up("instrument"), _up("data_set_id"), _up("sensor_type"), F.lower(F.coalesce(F.col("name"), F.lit("")))
    stem = F.upper(F.regexp_replace(F.trim(F.coalesce(F.col("product_id"), F.element_at(F.split(F.col("name"), "/"), -1), F.lit(""))), r"(?i)\.(img|lbl|xml|json|dat|raw|bin)$", ""))
    family = stem.rlike(r"^M\d+[LR]E$")
    other = instrument.contains("OHRC") | dataset.contains("CH2") | instrument.contains("IIRS") | instrument.contains("TMC") | name.rlike("ch2_|ohrc|iir|tmc")
    return ~other & (
        _up("format_profile").contains("LROC_NAC_EDR") | family | (dataset == "LRO-L-LROC-2-EDR-V1.0")
        | (instrument.contains("LROC") & (instrument.contains("NAC") | (sensor == "LROC_NAC") | _up("product_type").contains("EDR")))
        | (sensor == "LROC_NAC") | (_up("metadata_source").isin("LROC_CATALOG", "CATALOG_METADATA") & (sensor.contains("LROC") | instrument.contains("LROC")))
    )


def dtype(sample_type: Column, bits: Column, order: Column) -> Column:
    """numpy name of explicit sample fields, null if unknown; little-endian unless told otherwise."""
    token = F.regexp_replace(F.upper(sample_type), "[^A-Z0-9]", "")
    end = F.when(F.upper(order).isin("MSB", "BIG_ENDIAN", "BIGENDIAN"), ">").otherwise("<")
    return (
        F.when(token.isin("UNSIGNEDINTEGER", "UNSIGNEDINT", "UNSIGNEDBYTE") & (bits == 8), F.lit("u1"))
        .when(token.isin("UNSIGNEDINTEGER", "UNSIGNEDINT") & (bits == 16), F.concat(end, F.lit("u2"))).when(token.isin("SIGNEDINTEGER", "INTEGER", "SIGNEDINT") & (bits == 16), F.concat(end, F.lit("i2")))
        .when(token.isin("IEEEREAL", "IEEE754", "IEEE754MSBSINGLE", "IEEE754LSBSINGLE") & (bits == 32), F.concat(end, F.lit("f4")))
    )


def profiled(rows, family: Column):  # noqa: ANN001, ANN201
    """Rows with the family's byte layout filled in; an uploaded label's own offset and type win."""
    own = F.col("metadata_source") == "UPLOADED_LABEL"
    at = (PROFILE["image_pointer"] - 1) * PROFILE["record_bytes"]
    fill = {"record_bytes": PROFILE["record_bytes"], "image_pointer": PROFILE["image_pointer"], "sample_bits": PROFILE["sample_bits"]}
    out = {k: F.when(family, F.coalesce(F.col(k), F.lit(v))).otherwise(F.col(k)) for k, v in fill.items()}
    out["image_offset"] = F.when(family & ~(own & F.col("image_offset").isNotNull()), F.lit(at)).otherwise(F.col("image_offset"))
    out["dtype"] = F.when(family & ~(own & F.col("dtype").isNotNull()), F.lit(PROFILE["dtype"])).otherwise(F.col("dtype"))
    out["format_profile"] = F.when(family, F.lit(PROFILE["profile_id"])).otherwise(F.col("format_profile"))
    return rows.withColumns(out)


def pointer_offset(pointer: Column, unit: Column, record_bytes: Column) -> Column:
    """Bytes before the image: a byte pointer as it is, a record pointer from the first record."""
    records = F.greatest(pointer - 1, F.lit(0))
    return F.when(pointer.isNull(), None).when(F.upper(unit).contains("BYTE"), pointer).when(unit.isNull() | F.upper(unit).contains("RECORD"), records * F.coalesce(record_bytes, F.lit(0))).otherwise(F.when(record_bytes > 0, records * record_bytes).otherwise(F.when(pointer > 1, records)))


def payload(lines: Column, samples: Column, bits: Column) -> Column:
    """Bytes of the image; null unless all are known and positive."""
    return F.when((lines > 0) & (samples > 0) & (bits > 0), F.floor(lines.cast("long") * samples.cast("long") * bits.cast("long") / 8).cast("long"))


def lacking(lines: Column, samples: Column, kind: Column, offset: Column) -> Column:
    unsized = ~F.coalesce((lines > 0) & (samples > 0), F.lit(False))
    return F.array_compact(F.array(F.when(unsized, "dimensions"), F.when(kind.isNull(), "sample_type"), F.when(offset.isNull(), "image_offset")))


def size_status(size: Column, lines: Column, samples: Column, bits: Column, offset: Column, record: Column) -> Column:
    """UNKNOWN, VERIFIED, PARTIAL or MISMATCH of a file size against the declared raster."""
    want, at = payload(lines, samples, bits), F.coalesce(offset, F.lit(0)).cast("long")
    there = F.greatest(size.cast("long") - at, F.lit(0).cast("long"))
    recorded = F.coalesce(record, F.lit(0)) > 0
    by_records = F.when(recorded, (F.floor(at / record).cast("long") + lines.cast("long")) * record.cast("long"))
    return (
        F.when(want.isNull(), "UNKNOWN").when(~recorded & (there == want), "VERIFIED").when(recorded & (size == by_records), "VERIFIED")
        .when(recorded & (size >= at + want - record), "PARTIAL").when(there < want, "MISMATCH").when(there > want, "PARTIAL").otherwise("UNKNOWN")
    )


def structure_status(size: Column, lines: Column, samples: Column, bits: Column, offset: Column) -> Column:
    """The same without a record rule; a size that isn't known yet contradicts nothing."""
    want = F.when((lines > 0) & (samples > 0) & (bits > 0), lines.cast("long") * samples.cast("long") * F.greatest(F.lit(1), F.floor(bits / 8)).cast("long"))
    there = F.greatest(size.cast("long") - F.coalesce(offset, F.lit(0)).cast("long"), F.lit(0).cast("long"))
    return F.when(want.isNull(), "UNKNOWN").when(size.isNull() | (there == want), "VERIFIED").when(there > want, "PARTIAL").otherwise("MISMATCH")


#: Names of the nine sanity checks, in order.
CHECKS = ("dimensions", "sample_type", "image_offset", "record_structure", "size_consistency", "bounded_read", "lines_readable", "values_in_range", "values_finite")


def sanity_checks() -> Column:
    """array<struct<ord, name, status>> of the nine checks over a row's contract and its bounded reads."""
    known = lambda c: F.coalesce(c, F.lit(False))
    reads = F.coalesce(F.col("n_reads"), F.lit(0)) > 0
    tests = (
        known((F.col("lines") > 0) & (F.col("samples") > 0)), F.col("dtype").isNotNull() | F.col("sample_type").isNotNull(), F.col("image_offset").isNotNull(),
        known(F.col("record_bytes") > 0) & F.col("image_pointer").isNotNull(), known(F.col("size_status").isin("VERIFIED", "PARTIAL")), reads | known(F.col("size_status") == "MISMATCH"),
        reads & known(F.col("all_nonempty")), reads & F.coalesce(F.col("all_in_range"), F.lit(True)), reads & F.coalesce(F.col("all_finite"), F.lit(True)),
    )
    return F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("name"), F.when(ok, "PASS").otherwise("FAIL").alias("status")) for k, (name, ok) in enumerate(zip(CHECKS, tests, strict=True))])


def contract(rows, file_size: str = "length"):  # noqa: ANN001, ANN201
    """rows with the summary of their raster contract: dimensions, payload, size status, reader, resolved and what is lacking."""
    c = F.col
    missing = lacking(c("lines"), c("samples"), c("dtype"), c("image_offset"))
    resolved = F.size(missing) == 0
    size = F.when(c(file_size).isNotNull(), size_status(c(file_size), c("lines"), c("samples"), c("sample_bits"), c("image_offset"), c("record_bytes"))).otherwise("UNKNOWN")
    return rows.withColumns({
        "dimensions": F.when((c("lines") > 0) & (c("samples") > 0), F.concat_ws(" x ", c("lines").cast("string"), c("samples").cast("string"))), "expected_payload_bytes": payload(c("lines"), c("samples"), c("sample_bits")),
        "size_status": size, "pointer_unit": F.coalesce(c("image_pointer_unit"), F.when(c("image_pointer").isNotNull(), "RECORDS")), "reader": F.when(resolved, "raw_raster"), "resolved": resolved, "missing": F.when(resolved, F.array().cast("array<string>")).otherwise(missing),
    })


def readiness(kind: Column, size: Column, missing: Column, reads_ok: Column) -> Column:
    """PENDING_METADATA, READY, PARTIAL, MISMATCH, FAILED or UNSUPPORTED."""
    binary = kind.isin("LRO_PDS3_BINARY", "CHANDRAYAAN_PDS4_BINARY", "SCIENTIFIC_BINARY")
    return (
        F.when(kind == "STANDARD_IMAGE", "READY").when(~binary, "UNSUPPORTED").when(F.size(missing) > 0, "PENDING_METADATA").when(size == "MISMATCH", "MISMATCH")
        .when(~F.coalesce(reads_ok, F.lit(False)), "FAILED").when(size == "PARTIAL", "PARTIAL").otherwise("READY")
    )


def normalised(rows, spec: str = "raster_spec"):  # noqa: ANN001, ANN201
    """Outer fields overridden by those of a nested spec where there is one: a present spec hides outer values even with nulls, except
    dtype, where the first that isn't null counts."""
    nested = [f.name for f in rows.schema[spec].dataType.fields]
    there = F.col(spec).isNotNull()
    out = {n: F.coalesce(F.col(f"{spec}.{n}"), F.col(n)) if n == "dtype" else F.when(there, F.col(f"{spec}.{n}")).otherwise(F.col(n)) for n in nested if n in rows.columns}
    return rows.withColumns(out).drop(spec)
